from loomspark.llm.code.parser import Parser

BROKEN = "if (a b c d) x;\n"


def test_cheap_calls_leave_no_costs_behind():
    fresh = Parser("js").file(BROKEN)[0]
    used = Parser("js")
    assert used.file(BROKEN, count=False)[0] >= 1
    assert used.file(BROKEN)[0] == fresh == 2


def test_long_statements_and_later_faults_are_searched():
    long = "x = " + " + ".join(["a"] * 24) + " b;\n"
    assert Parser("js").file(long)[0] == 1
    third = "x = a b;\ny = a b;\nz = a + + * b c;\n"
    alone = Parser("js").file("z = a + + * b c;\n")[0]
    assert alone > 1 and Parser("js").file(third)[0] == 2 + alone


def test_bounds_are_told_from_minima():
    p = Parser("js")
    assert p.file("x = a b;\n")[0] == 1 and p.minimal
    long = "x = " + " + ".join(["a"] * 40) + " b c d e;\n"
    p.file(long)
    assert not p.minimal
    p.file("x = a b;\n")
    assert p.minimal
    p.file(long)  # remembered costs keep their mark
    assert not p.minimal


BARRED = [("a.rs", "fn f() { 1 2 }"), ("a.go", "func f() {}\n"), ("a.rb", "class a\nend\n"), ("a.rb", "module b\nend\n"), ("a.js", "1 = 2;"), ("a.js", "let let = 1;"), ("a.js", "const a;"), ("a.py", "1 = 2\n")]
FINE = [("a.rs", "fn f() { if x { 1 } else { 2 } }"), ("a.go", "// only a comment\n"), ("a.rb", "class << self\nend\n"), ("a.rb", "x.class\ny = 1\n"), ("a.ts", 'enum A { "a" = 1 }'), ("a.ts", "declare const a: number;"), ("a.js", "for (const a of b) c();")]


def test_what_looks_like_a_statement_but_is_none():
    from loomspark.llm.syntax import judge

    assert [p for p, t in BARRED if not judge(p, t)[1]] == [] and [(p, t) for p, t in FINE if judge(p, t)[1]] == []
