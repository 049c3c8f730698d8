from loomspark.operators.governance import test_directives as directives_of
from loomspark.operators.retrieval import pack_candidates

ITEM = "group string, id string, kind string, path string, score double, tokens long, is_code boolean, is_doc boolean, skeleton_tokens long, spans array<struct<score:double,id:string,tokens:bigint>>, file_id string, file_tokens long, extra int"


def _file(i, score, tokens, spans=(), bones=None, doc=False):
    return ("g", i, "file", i, score, tokens, not doc, doc, bones, [(s, n, t) for n, s, t in spans], None, None, 1)


def _symbol(i, path, score, tokens, file_tokens):
    return ("g", i, "symbol", path, score, tokens, True, False, None, None, path, file_tokens, 1)


def _run(spark, rows, budget=1000):
    return [(r.id, r.kind, r.taken) for r in sorted(pack_candidates(spark.createDataFrame(rows, ITEM), budget).collect(), key=lambda r: r.rank)]


def test_fold_rules(spark):
    # a symbol brings its file where that fits; the file is then not taken again
    assert _run(spark, [_symbol("a.f", "a", 9.0, 10, 100), _file("a", 5.0, 100), _file("b", 4.0, 50)]) == [("a", "file", 100), ("b", "file", 50)]
    # a file too large comes by its spans, best first; the rest of its symbols and the file itself follow no more
    big = _file("a", 9.0, 900, [("a.x", 3.0, 300), ("a.y", 5.0, 200), ("a.z", 1.0, 50)])
    assert _run(spark, [big, _file("b", 1.0, 50), _symbol("a.x", "a", 0.5, 300, 900)]) == [("a.y", "symbol", 200), ("a.z", "symbol", 50), ("b", "file", 50), ("a.x", "symbol", 300)]
    # no span fits: the skeleton; files with symbols are never cut, others are
    assert _run(spark, [_file("a", 9.0, 900, [("a.x", 3.0, 700)], bones=80), _file("c", 8.0, 900), _file("b", 1.0, 50)]) == [("a", "skeleton", 80), ("c", "file", 400), ("b", "file", 50)]
    # documents together stay below their share where code scores
    assert _run(spark, [_file("m.md", 9.0, 300, doc=True), _file("n.md", 8.0, 300, doc=True), _file("c", 1.0, 10)]) == [("m.md", "file", 300), ("n.md", "file", 100), ("c", "file", 10)]
    # one whole candidate may take everything; too little room is left alone
    assert _run(spark, [_file("a", 9.0, 2000)]) == [("a", "file", 1000)]
    assert _run(spark, [_file("a", 9.0, 30), _file("b", 8.0, 30), ("g", "c1", "commit", "", 7.0, 40, False, False, None, None, None, None, 1)], 80) == [("a", "file", 30), ("b", "file", 30), ("c1", "commit", 20)]
    dirty = [_file("a", None, 10), _file("b", 0.0, 10), _file("c", 1.0, 0), (None, *_file("d", 1.0, 5)[1:]), _file("e", 1.0, 5), _file("e", 1.0, 5)]
    assert _run(spark, dirty) == [("e", "file", 5)] and _run(spark, []) == []


def test_tests_that_did_not_change(spark):
    ch = spark.createDataFrame([("r", "1", "src/a.py"), ("r", "2", "src/a.py"), ("r", "2", "tests/test_a.py"), ("r", "2", None)], "repo_path string, change_id string, path string")
    src = spark.createDataFrame([("r", "src/a.py"), ("r", "tests/test_a.py"), ("r", "tests/a_test.py")], "repo_path string, path string")
    assert {(r.change_id, r.path): r.directives for r in directives_of(ch, src).collect()} == {("1", "src/a.py"): 2, ("2", "src/a.py"): 1}
