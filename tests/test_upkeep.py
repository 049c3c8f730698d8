import json

import pytest
from pyspark.sql import functions as F

from loomspark.operators import answers, code_text, upkeep
from loomspark.sources import changes

NAMES = "M\0a.py\0R087\0old.py\0new.py\0A\0bin.png\0D\0gone.py\0"
COUNTS = "2\t1\ta.py\0" + "1\t0\t\0old.py\0new.py\0" + "-\t-\tbin.png\0" + "0\tx\tgone.py\0"
LINES = """diff --git a/a.py b/a.py
--- a/a.py
+++ b/a.py
@@ -1,1 +1,2 @@
--- not a header
+++ neither
+signal ready(int x)
diff --git a/gone.py b/gone.py
--- a/gone.py
+++ /dev/null
@@ -1 +0,0 @@
-void left(int y);
"""


def test_diff_reports(spark):
    one = lambda t: spark.createDataFrame([("c", t), ("n", None)], "change_id string, data string")
    got = {r.path: r for r in changes.diff_files(one(NAMES), one(COUNTS), one(LINES)).collect()}
    assert set(got) == {"a.py", "new.py", "bin.png", "gone.py"}
    assert (got["a.py"].additions, got["a.py"].deletions) == (2, 1) and got["a.py"].added_lines == ["++ neither", "signal ready(int x)"] and got["a.py"].removed_lines == ["-- not a header"]
    assert (got["new.py"].status, got["new.py"].previous_path, got["new.py"].rename_score, got["new.py"].additions) == ("R", "old.py", "087", 1)
    assert got["bin.png"].binary and got["gone.py"].removed_lines == ["void left(int y);"] and got["gone.py"].deletions == 0
    names = changes.diff_files(one(NAMES), one(COUNTS), one(LINES)).select(F.explode(changes.declared_signal_names(F.concat("added_lines", "removed_lines"))).alias("s"))
    assert {r.s for r in names.collect()} == {"ready", "left"}
    assert changes.valid_range("main..HEAD~2") and changes.valid_range("v1.0")
    for bad in ("", "-x", "a b", "a;b", "$(x)"):
        with pytest.raises(ValueError):
            changes.valid_range(bad)


def test_saves_and_resets(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    f = lambda rows: spark.createDataFrame(rows, "repo_path string, k string, v int")
    upkeep.replace_repositories(f([("/a b", "x", 1), ("/c", "y", 2), (None, "z", 3)]), at)
    upkeep.replace_repositories(f([("/c", "q", 9)]), at)
    assert {(r.repo_path, r.k) for r in spark.read.parquet(at).collect()} == {("/a b", "x"), ("/c", "q")}
    assert upkeep.reset_repository(spark, at, "/a b") and not upkeep.reset_repository(spark, at, "/none")
    assert {r.repo_path for r in spark.read.schema("k string, v int, repo_path string").parquet(at).collect()} == {"/c"}
    keyed = f"file://{tmp_path}/k"
    assert upkeep.stored(spark, keyed) is None
    for rows in ([("r", "a", 1), ("r", "b", 1)], [("r", "a", 2), ("r", "a", 1), (None, "a", 5)], [("r", "a", 2)], [("r", "c", 1)]):
        out = upkeep.save(f(rows), keyed, ["repo_path", "k"], ["v"])
    assert {(r.k, r.v) for r in out.collect()} == {("a", 2), ("b", 1), ("c", 1)}
    old, new = f([("r", "a", 1), ("r", "b", None)]), f([("r", "a", 2), ("r", "b", None), ("r", "n", 1)])
    assert {r.k for r in upkeep.changed_figures(old, new, ["repo_path", "k"], "v").collect()} == {"a", "n"}
    assert {(r.repo_path, r.n_gone, r.n_new, r.changed) for r in upkeep.set_changed(old, new, "repo_path", "k").collect()} == {("r", 0, 1, True)}


def test_configuration():
    assert upkeep.load_config(None)["connect_functions"] == ["connect"]
    c = upkeep.load_config('[query]\nsynonyms = {ledger = ["journal"]}\n[ingest]\nskip_dirs = ["out"]\n')
    assert c["synonyms"] == {"ledger": ["journal"]} and c["skip_dirs"] == ["out"]
    for bad in ("[", "[ingest]\nskip_dirs = 3", "ingest = 1", '[query]\nsynonyms = ["a"]', "[query]\nsynonyms = {a = [1]}"):
        with pytest.raises(ValueError):
            upkeep.load_config(bad)
    assert answers.expand_terms(["stale", "lease"], {"staleLease": ["expired"], "x": ["stale"], "y": ["not", "here"]}) == ["expired", "lease", "stale", "x"]


def test_providers(spark):
    texts = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "bad"), ("4", None), ("5", "x" * 9000)], "key string, text string")
    provider = lambda ts: ["no json" if t == "bad" else json.dumps({"n": len(t)}) for t in ts]
    got, new = upkeep.provide(texts, provider, "p")
    assert {r.key: r.answer for r in got.collect()} == {"1": '{"n": 1}', "2": '{"n": 1}', "3": "{}", "5": '{"n": 8000}'} and new.count() == 3

    def never(ts):
        raise RuntimeError("asked again")

    again, more = upkeep.provide(texts, never, "p", new)
    assert {r.key: r.answer for r in again.collect()}["5"] == '{"n": 8000}' and more.count() == 0
    assert {r.answer for r in upkeep.provide(texts, never, "other", new)[0].collect()} == {None}


def test_folders(spark, tmp_path):
    for n in "abc":
        (tmp_path / n).mkdir()
    at = lambda n: f"file://{tmp_path}/{n}"
    folders = spark.createDataFrame([(at("a"),), (at("b"),), (at("c"),)], "folder string")
    owners = spark.createDataFrame([(at("a"), "/r"), (at("b"), "/gone")], "folder string, repo_path string")
    state = upkeep.unowned_folders(folders, owners, spark.createDataFrame([("/r",)], "repo_path string"))
    assert {r.folder[-1]: r.state for r in state.collect()} == {"a": "active", "b": "orphaned", "c": "unknown"}
    assert upkeep.delete_folders(spark, state.where("state = 'orphaned'")) == 1 and sorted(p.name for p in tmp_path.iterdir()) == ["a", "c"]


def test_scalars_of_code_text(spark):
    r = spark.range(1).select(
        code_text.handler_signal(F.lit("onFooBar")).alias("a"), code_text.handler_signal(F.lit("once")).alias("b"), code_text.location(F.lit("a:b.py:12"))["line"].alias("c"), code_text.location(F.lit("a:b")).alias("d"),
        code_text.snippet(F.lit("one two Ledger four"), ["ledger"]).alias("e"), answers.shown_signature(F.lit("x" * 300)).alias("f"), answers.edge_origin(F.lit("ts:x"), F.lit("COCHANGE")).alias("g"), answers.edge_origin(F.lit("q:x"), F.lit("COCHANGE")).alias("h"),
        answers.canonical_key(F.lit("fp"), "t", {"b": 1, "a": [2], "repo_path": "/x"}).alias("i"), answers.canonical_key(F.lit("fp"), "t", {"a": [2], "b": 1}).alias("j"), answers.language_factor("c++ code", ["code"], F.lit("a/b.h")).alias("k"),
        *[answers.looks_like_identifier(F.lit(t)).alias(f"q{n}") for n, t in enumerate(["A::b", "device_list", "deviceList", "_x_", "plain words", "X9Y"])],
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e) == ("fooBar", None, 12, None, "one two [Ledger] four") and len(r.f) == 201 and (r.g, r.h) == ("treesitter-parser", "git-history")
    assert r.i == r.j and r.k == 1.5 and [r[f"q{n}"] for n in range(6)] == [True, True, True, False, False, True]


def test_exposed_names_and_markers(spark):
    rows = [("r", "p/__init__.py", "from a import b as c\nimport x.y\n__all__ = ['d']\n@dec\ndef e():\n    pass\n"), ("r", "bad.py", "def ("), ("r", "q.py", "@dec\nclass K:\n    pass\n"), ("r", "n.py", None)]
    src = spark.createDataFrame(rows, "repo_path string, path string, content string")
    got = {(r.path, r.what, r.name) for r in code_text.python_exposure(src).collect()}
    assert got == {("p/__init__.py", "handed on", n) for n in "cyd"} | {("p/__init__.py", "decorated", "e"), ("q.py", "decorated", "K")}
    text = "\n".join(["Q_INVOKABLE"] + ["x"] * 30 + ["int f();"])
    n = spark.createDataFrame([("r", "s1", "func", "f", "a.h", "symbol", "", 10, 12), ("r", "s2", "func", "g", "a.h", "symbol", "", 32, 32), ("r", "s3", "func", "h", "a.h", "symbol", "", None, None)], "repo_path string, node_id string, kind string, label string, source_ref string, granularity string, signature string, span_start int, span_end int")
    assert [r.node_id for r in code_text.near_markers(n, spark.createDataFrame([("r", "a.h", text)], "repo_path string, path string, content string"), r"\bQ_INVOKABLE\b").collect()] == ["s1"]
