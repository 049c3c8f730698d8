import json

from loomspark.operators import resolution as R

NODE = "repo_path string, node_id string, kind string, label string, source_ref string, granularity string, metadata_json string"
EDGE = "repo_path string, edge_id string, source string, target string, relation string, confidence string, source_file string, metadata_json string"


def _n(i, kind, label, ref, **m):
    return ("r", i, kind, label, ref, "symbol", json.dumps(m))


def _e(i, s, t, rel, file="", **m):
    return ("r", i, s, t, rel, "EXTRACTED", file, json.dumps(m))


def test_endpoints(spark):
    nodes = [
        _n("sig:a", "func", "ready", "a.h", qt="signal"), _n("sig:b", "func", "ready", "b.h", qt="signal"), _n("sig:only", "func", "once", "c.h", qt="signal"), _n("slot:a", "func", "go", "a.h", qt="slot"),
        _n("class:A", "class", "A", "a.h"), _n("sym:A.run", "func", "run", "a.h"), _n("class:W", "class", "Widget", "w.h"), _n("q:sig", "func", "value", "Item.qml", qt="signal"),
        _n("export:m:Box", "export", "Box", "mod", qml_kind="export", uri="my.mod", version="1.0"), _n("export:m2:Box", "export", "Box", "mod", qml_kind="export", uri="my.mod", version="2.0"), _n("f1", "file", "Box.qml", "x/Box.qml"), _n("f2", "file", "Box.qml", "y/Box.qml"),
    ]
    edges = [
        _e("1", "file:m.cpp", "file:b.h", "imports"), _e("2", "file:m.cpp", "file:a.h", "imports"),
        _e("em", "f", "module:ready", "emits", "m.cpp", signal_name="ready"), _e("em2", "f", "module:once", "emits", "z.cpp", signal_name="once"), _e("em3", "f", "module:ready", "emits", "z.cpp", signal_name="ready"),
        _e("co", "module:ready", "module:go", "connects", signal_name="ready", sender_class="A", slot_name="go", receiver_class="Unknown"),
        _e("nm", "name:A::run", "name:A::ready", "connects"), _e("self", "name:A::run", "sym:A.run", "connects"), _e("no", "name:B::run", "name:A::nothing", "connects"),
        _e("h1", "x", "module:valueChanged", "handles", signal_name="valueChanged", component_path="Item.qml"), _e("h2", "x", "module:lost", "handles", signal_name="lost", component_path="Item.qml"),
        _e("i0", "file:s.qml", "module:my.mod", "imports", uri="my.mod", version="1.0", alias="M"), _e("i1", "file:t.qml", "module:my.mod", "imports", uri="my.mod"), _e("x1", "export:m:Box", "file:x/Box.qml", "exports"), _e("x2", "export:m2:Box", "file:y/Box.qml", "exports"),
        _e("q1", "s", "module:Box", "instantiates", "s.qml", type_name="Box"), _e("q2", "s", "module:M.Box", "instantiates", "s.qml", type_name="M.Box"), _e("q3", "s", "module:Z.Box", "instantiates", "s.qml", type_name="Z.Box"),
        _e("q4", "s", "module:Box", "instantiates", "t.qml", type_name="Box"), _e("q5", "s", "module:Widget", "instantiates", "s.qml", type_name="Widget"),
    ]
    edges += [edges[2], (None, "n", "a", "b", "emits", "", "", "{}"), ("r", "bad", "a", "b", "emits", "", "", "no json"), ("r", "nul", "a", "b", "calls", None, None, None)]
    n, e = R.with_metadata(spark.createDataFrame(nodes, NODE)), R.with_metadata(spark.createDataFrame(edges, EDGE))
    got = {r.edge_id: r for r in R.resolve_endpoints(n, e).collect() if r.repo_path}
    assert got["em"].target == "sig:b" and got["em2"].target == "sig:only" and got["em3"].target == "module:ready"
    assert (got["co"].source, got["co"].target) == ("sig:a", "slot:a")
    assert (got["nm"].source, got["nm"].target) == ("sym:A.run", "sig:a") and "self" not in got and got["no"].source == "name:B::run"
    assert got["h1"].target == "q:sig" and not got["h1"].unverified and got["h2"].unverified and got["h2"].confidence == "LOW"
    assert got["q1"].target == got["q2"].target == "file:x/Box.qml" and got["q3"].unverified and got["q4"].unverified and got["q5"].target == "symbol:w.h:Widget"
    assert got["bad"].target == "b" and len(got) == 21
    assert R.resolve_endpoints(n.limit(0), e.limit(0)).count() == 0
    assert {(r.uri, r.version, tuple(r.targets)) for r in R.component_exports(n, e).collect()} == {("my.mod", "1.0", ("file:x/Box.qml",)), ("my.mod", "2.0", ("file:y/Box.qml",))}


def test_import_targets_and_numbers(spark):
    i = spark.createDataFrame([("r", "1", "a/x.py"), ("r", "2", "q/only.py"), ("r", "3", "q/x.py"), ("r", "4", None)], "repo_path string, edge_id string, wanted string")
    f = spark.createDataFrame([("r", "a/x.py"), ("r", "b/x.py"), ("r", "b/only.py"), ("r", None)], "repo_path string, path string")
    assert {r.edge_id: r.path for r in R.import_targets(i, f).collect()} == {"1": "a/x.py", "2": "b/only.py", "3": None, "4": None}
    d = spark.createDataFrame([("r", "p", 3), ("r", "p", 1), ("r", "q", 2)], "repo_path string, id string, line int")
    assert {(r.line, r.unique_id) for r in R.numbered_declarations(d, "id", ["line"]).collect()} == {(1, "p"), (3, "p#2"), (2, "q")}
