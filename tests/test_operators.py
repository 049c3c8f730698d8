"""Small fixtures for the core operators; whole-table results are compared with SQL by the driver."""

import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as X
from loomspark.operators import governance, graphs, history, retrieval, scans


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_identifiers_and_tokens(spark):
    assert one(spark, X.identifier_tokens(F.lit("deviceListModel_v2 HTTPServer2"))) == ["device", "list", "model", "v2", "httpserver2"]
    assert one(spark, X.term_set(F.lit("where is the lease of leases"))) == ["lease", "leases"]
    assert one(spark, X.token_estimate(F.lit(""), F.lit("code"))) == 0
    assert one(spark, X.token_estimate(F.lit("a"), F.lit("code"))) == 1
    assert one(spark, X.segment_count(F.lit("ab cd; é"))) == 5


def test_paths(spark):
    cases = {"a/b.md": ("markdown", ".md"), "CMakeLists.txt": ("code", ".txt"), "x/.hidden": ("text", ""), "a.tar.gz": ("text", ".gz"), "p/q.py": ("code", ".py")}
    for path, (kind, suf) in cases.items():
        assert one(spark, X.classify_path(F.lit(path))) == kind
        assert one(spark, X.suffix(F.lit(path))) == suf
    assert one(spark, X.normalized_path(F.lit(".\\a\\b"))) == "a/b"
    assert one(spark, X.lines(F.lit("a\r\nb\n\n"))) == ["a", "b", ""]


@pytest.mark.parametrize("line,access", [("x += 1", "write"), ("x == 1", "read"), ("x = 1", "write"), ("y = x", "read"), ("del x", "write"), ("x.append(1)", "write"), ("x[0] = 1", "write"), ("f(x)", "read"), ("x => y", "read"), ("++x", "write")])
def test_line_access(spark, line, access):
    assert one(spark, X.line_access("x", F.lit(line))) == access


def test_latest_and_changes(spark):
    df = spark.createDataFrame([("r", "a", 1.0, "old"), ("r", "a", 2.0, "new"), ("r", "a", None, "never"), ("r", None, 9.0, "x")], "repo_path string, path string, modified_at double, v string")
    assert [r.v for r in scans.latest(df, ["repo_path", "path"], ["modified_at"]).collect()] == ["new"]
    old = spark.createDataFrame([("r", "a", "1", 1), ("r", "b", "1", 1), ("r", "c", "1", 1), ("r", "d", "1", 1)], "repo_path string, path string, content_hash string, mtime_ns long")
    new = spark.createDataFrame([("r", "a", "1", 1), ("r", "b", "2", 1), ("r", "c", "1", 2), ("r", "e", "1", 1)], "repo_path string, path string, content_hash string, mtime_ns long")
    got = {r.path: r.state for r in scans.classify_changes(old, new).collect()}
    assert got == {"a": "unchanged", "b": "changed", "c": "restat", "d": "deleted", "e": "new"}


def test_churn_and_cochange(spark):
    c = spark.createDataFrame([("r", "1", '["a", "./b", " ", "a"]'), ("r", "1", '["a"]'), ("r", "2", '["a", "b"]'), ("r", "3", "[]"), ("r", "4", None), ("r", "5", "no json")], "repo_path string, sha string, files_json string")
    assert {(r.path, r.churn) for r in history.churn(c).collect()} == {("a", 2), ("b", 2)}
    assert [(r.a, r.b, r.n, r.weight) for r in history.cochange(c).collect()] == [("a", "b", 2, 1.0)]


NODES = "repo_path string, node_id string, kind string, label string, source_ref string, granularity string"
EDGES = "repo_path string, edge_id string, source string, target string, relation string, layer string, weight double, source_file string"


def graph(spark):
    n = spark.createDataFrame([("r", x, "file", x, x, "file") for x in "abcde"] + [("r", "commit:1", "commit", "1", "", "file")], NODES)
    e = spark.createDataFrame([("r", "1", "a", "b", "calls", "STRUCTURAL", 1.0, "a"), ("r", "2", "b", "c", "calls", "STRUCTURAL", 1.0, "b"), ("r", "3", "c", "name:x", "calls", "STRUCTURAL", 1.0, "c"), ("r", "4", "d", "d", "calls", "STRUCTURAL", None, "d"), ("r", "5", "commit:1", "a", "touches", "COCHANGE", 1.0, "")], EDGES)
    return n, e


def test_pagerank_matches_dense_iteration(spark):
    n, e = graph(spark)
    seeds = spark.createDataFrame([("r", "a", 1.0)], "repo_path string, node_id string, weight double")
    got = {r.node_id: r["rank"] for r in graphs.pagerank(n, e, seeds, rounds=80).collect()}
    v = dict(zip("abcde", [1.0, 0, 0, 0, 0]))
    links = {"a": {"b": 1.0}, "b": {"a": 0.5, "c": 0.5}, "c": {"b": 1.0}}
    r = dict(v)
    for _ in range(200):
        lost = sum(r[x] for x in "de")
        r = {x: 0.15 * v[x] + 0.85 * (sum(r[s] * ts.get(x, 0) for s, ts in links.items()) + lost * v[x]) for x in "abcde"}
    assert set(got) == set("abcde")
    assert all(abs(got[x] - r[x]) < 1e-4 for x in "abcde")


def test_paths_degrees_and_communities(spark):
    n, e = graph(spark)
    ends = spark.createDataFrame([("r", "a", "c"), ("r", "a", "e"), ("r", "a", "a")], "repo_path string, a string, b string")
    assert [(r.b, r.hops, r.path) for r in graphs.shortest_paths(e, ends).collect()] == [("c", 2, ["1", "2"])]
    d = {r.node_id: r.degree for r in graphs.degrees(e).collect()}
    assert d["d"] == 2 and d["name:x"] == 1 and d["b"] == 2
    c = {r.node_id: r.community for r in graphs.communities(n, e).collect()}
    assert c["e"] == "e" and c["commit:1"] == "commit:1"


def test_rrf_and_packing(spark):
    r = spark.createDataFrame([("g", "l1", "x", 1), ("g", "l1", "x", 5), ("g", "l1", "y", 7), ("g", "l2", "y", 1)], "group string, list_id string, id string, pos int")
    got = {x.id: x.score for x in retrieval.rrf(r).collect()}
    assert got["x"] == pytest.approx(1 / 61) and got["y"] == pytest.approx(1 / 62 + 1 / 61)
    items = spark.createDataFrame([("g", "a", 9.0, 900), ("g", "b", 8.0, 100), ("g", "c", 7.0, 600), ("g", "d", 0.0, 1)], "group string, id string, score double, tokens long")
    assert {x.id: x.taken for x in retrieval.pack(items, 1000).collect()} == {"a": 400, "b": 100, "c": 400}


def test_truncation(spark):
    t = spark.createDataFrame([("k", "word " * 500), ("n", None), ("s", "short")], "key string, text string")
    got = {r.key: r.text for r in retrieval.truncate_texts(t, 50).collect()}
    assert got["n"] is None and got["s"] == "short" and got["k"].endswith("[truncated]") and len(got["k"]) < 400


def test_metrics_and_ledger_on_empty(spark):
    s = spark.createDataFrame([("t", "a", 1), ("t", "b", 2)], "task string, id string, rank int")
    x = spark.createDataFrame([("t", "a"), ("u", "z")], "task string, id string")
    m = {r.task: (r.precision, r.recall) for r in governance.retrieval_metrics(s, x).collect()}
    assert m["t"] == (0.5, 1.0) and m["u"] == (0.0, 0.0)
    empty = spark.createDataFrame([], "ts timestamp, tool string, a double, b double")
    assert governance.usage_rollup(empty, "ts", "tool", "a", "b").count() == 0
