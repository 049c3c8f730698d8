import json
from datetime import datetime, timedelta

from loomspark.sources import texts
from loomspark.streaming import ledger


def test_daily_usage_and_quiet_periods(spark, tmp_path):
    t0 = datetime(2024, 1, 1, 12)
    rows = [(t0, "click", 2.0, "r"), (t0 + timedelta(seconds=10), "click", 3.0, "r"), (t0 + timedelta(minutes=5), "view", 1.0, "r"), (t0 + timedelta(days=9), "click", 1.0, "s"), (None, "click", 9.0, "r")]
    df = spark.createDataFrame(rows, "ts timestamp, event_type string, value double, repo_path string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    s = ledger.read_events(spark, f"{tmp_path}/in", df.schema)
    ledger.append_result(ledger.daily_usage(s), f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination()
    got = {(r.day, r.tool): (r.calls, r.tokens) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("2024-01-01", "click"): (2, 5.0), ("2024-01-01", "view"): (1, 1.0)}
    ledger.append_result(ledger.quiet_periods(ledger.read_events(spark, f"{tmp_path}/in", df.schema)), f"{tmp_path}/q", f"{tmp_path}/c2").awaitTermination()
    assert sorted((r.repo_path, r.changes) for r in spark.read.parquet(f"{tmp_path}/q").collect()) == [("r", 1), ("r", 2)]
    seen = []
    ledger.refresh_on_change(ledger.read_events(spark, f"{tmp_path}/in", df.schema), lambda b, i: seen.append(b.count()), f"{tmp_path}/c3").awaitTermination()
    assert sum(seen) == 5


def test_tree_log_and_diff(spark, tmp_path):
    (tmp_path / "t/src/vendor").mkdir(parents=True)
    (tmp_path / "t/src/a.py").write_text("x = 1\n")
    (tmp_path / "t/src/bad.py").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "t/src/vendor/b.py").write_text("y")
    (tmp_path / "t/c.bin").write_text("z")
    got = texts.read_tree(spark, f"file://{tmp_path}/t", ["vendor"], "r").collect()
    assert [(r.path, r.kind, r.content) for r in got] == [("src/a.py", "code", "x = 1\n")]
    log = "s1\x1fann\x1f10\x1ffirst\na.py\nb.py\n\ns2\x1fbob\x1f20\x1fmerge\n\nnoise\n"
    c = {r.sha: r for r in texts.parse_log(spark.createDataFrame([(log,)], "value string"), "r").collect()}
    assert json.loads(c["s1"].files_json) == ["a.py", "b.py"] and c["s2"].files_json == "[]" and c["s2"].authored_at == 20
    d = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1 +1,2 @@\n-a\n+b\n+c\ndiff --git a/o b/n\nrename from o\nrename to n\ndiff --git a/p b/p\nBinary files a/p and b/p differ\n"
    f = {r.path: r for r in texts.parse_diffs(spark.createDataFrame([("1", d), ("2", None)], "change_id string, text string")).collect()}
    assert (f["x.py"].added, f["x.py"].removed) == (2, 1) and f["n"].previous_path == "o" and f["p"].binary


def test_graph_exports(spark, tmp_path):
    import xml.etree.ElementTree as ET

    n = spark.createDataFrame([("r", "a<b", "A & B"), ("r", "c", None)], "repo_path string, node_id string, label string")
    e = spark.createDataFrame([("r", "a<b", "c", "calls"), ("r", "a<b", "d", "calls")], "repo_path string, source string, target string, relation string")
    xml = "".join(r.xml for r in texts.graphml(n, e).orderBy("ord").collect())
    assert len(ET.fromstring(xml)[-1]) == 4
    m = {r.node_id: r.markdown for r in texts.notes(n, e, most_links=1).collect()}
    assert m["a<b"] == "# A & B\n\n- calls [[c]]\n- and 1 more" and m["c"].startswith("# c")
    texts.export_graph(n, e, f"file://{tmp_path}/x")
    assert spark.read.json(f"file://{tmp_path}/x/nodes").count() == 2
