import json
from collections import Counter
from itertools import combinations

from loomspark.plans import graph, repository

COMMITS = {"1": ["a/x.py", "b/y.py"], "2": ["a/x.py", "b/y.py"], "3": ["b/y.py", "c/z.py"]}


def tables(spark, folder):
    spark.createDataFrame([("r", k, json.dumps(v)) for k, v in COMMITS.items()], "repo_path string, sha string, files_json string").write.parquet(f"{folder}/commits.parquet")
    files = sorted({p for v in COMMITS.values() for p in v})
    nodes = "repo_path string, node_id string, kind string, label string, source_ref string, granularity string, signature string, span_start int, span_end int"
    spark.createDataFrame([("r", f"file:{p}", "file", p, p, "file", "", None, None) for p in files], nodes).write.parquet(f"{folder}/graph_nodes.parquet")
    edges = "repo_path string, edge_id string, source string, target string, relation string, layer string, weight double, source_file string"
    spark.createDataFrame([], edges).write.parquet(f"{folder}/graph_edges.parquet")
    return str(folder)


def test_pairs_of_one_commit_count(spark, tmp_path):
    d = tables(spark, tmp_path / "t")
    n = Counter(x for v in COMMITS.values() for x in combinations(sorted(v), 2))
    top = max(n.values())
    want = {(a, b, k, k / top) for (a, b), k in n.items()}
    assert {(r.a, r.b, r.n, r.weight) for r in repository.cochange_edges(spark, d).collect()} == want
    both = {(x, y, 2 * w) for a, b, _, w in want for x, y in ((a, b), (b, a))}
    assert {(r.path, r.neighbour, r.score) for r in graph.file_impact(spark, d).collect()} == both
    assert {(r.a, r.b, r.weight) for r in graph.surprising_links(spark, d).collect()} == {(a, b, w) for a, b, _, w in want}
