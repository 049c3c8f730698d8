import pytest

from loomspark.operators import graphs
from loomspark.plans import graph, search

NODES = "repo_path string, node_id string, kind string, label string, source_ref string, granularity string, signature string, span_start int, span_end int"
EDGES = "repo_path string, edge_id string, source string, target string, relation string, layer string, weight double, source_file string"
N = 60


def tables(spark, folder):
    """Sixty files on a chain of links of unequal weight; one of them the scanner."""
    paths = ["scanner.py"] + [f"f{i:02}.py" for i in range(1, N)]
    spark.createDataFrame([("r", f"file:{p}", "file", p, p, "file", "", None, None) for p in paths], NODES).write.parquet(f"{folder}/graph_nodes.parquet")
    links = [(paths[i], paths[i + 1], float(1 + i % 3)) for i in range(N - 1)]
    spark.createDataFrame([("r", f"{a}-{b}", f"file:{a}", f"file:{b}", "imports", "STRUCTURAL", w, a) for a, b, w in links], EDGES).write.parquet(f"{folder}/graph_edges.parquet")
    texts = [("r", p, "code", "stale lease ledger" if i % 2 else "stale", 20, 1e9, 1, "") for i, p in enumerate(paths)]
    spark.createDataFrame(texts, "repo_path string, path string, kind string, content string, size_bytes long, modified_at double, mtime_ns long, content_hash string").write.parquet(f"{folder}/sources.parquet")
    return str(folder), paths, links


def dense(paths, links, seeds, rounds=2000):
    near = {p: {} for p in paths}
    for a, b, w in links:
        near[a][b] = near[b][a] = w
    total = sum(seeds.values())
    v = {p: seeds.get(p, 0.0) / total for p in paths}
    r = dict(v)
    for _ in range(rounds):
        r = {p: 0.15 * v[p] + 0.85 * sum(r[q] * near[q][p] / sum(near[q].values()) for q in near[p]) for p in paths}
    return r


def test_queries_rank_to_convergence(spark, tmp_path):
    d, paths, links = tables(spark, tmp_path / "t")
    cases = [(graph.page_rank(spark, d), {"scanner.py": 1.0}), (graph.page_rank_converged(spark, d), dict.fromkeys(paths, 1.0))]
    for got, seeds in cases:
        want = dense(paths, links, seeds)
        assert sum(abs(r["rank"] - want[r.node_id[5:]]) for r in got.collect()) < 1e-4
    rows = search._bundle_scores(spark, d).collect()
    assert len(rows) == N and all(r.seed > 0 for r in rows)
    want = dense(paths, links, {r.path: r.seed for r in rows})
    assert sum(abs(r["rank"] - want[r.path]) for r in rows) < 1e-4


def test_task_and_rounds_agree(spark, tmp_path):
    d, _, _ = tables(spark, tmp_path / "t")
    n, e = graph._nodes(spark, d), graph._edges(spark, d)
    seeds = n.where("source_ref < 'f10'").selectExpr("repo_path", "node_id", "1.0D AS weight")
    one, far = ({r.node_id: r["rank"] for r in graphs.pagerank(n, e, seeds, rounds=3, tolerance=None, small=x).collect()} for x in (1000, 0))
    assert one == pytest.approx(far, abs=1e-12) and len(one) == N
