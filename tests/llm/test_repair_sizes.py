import random

from loomspark.llm import docpairs
from loomspark.llm.code.chart import Chart, Grammar
from loomspark.llm.code.parser import Parser
from loomspark.llm.syntax import judge


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_costs_are_the_least_distance_to_the_language():
    rng = random.Random(3)
    pairs = Chart(Grammar("s = 'a' s 'b' | 'a' 'b'", {}), lambda k, r: 0)
    for _ in range(60):
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(30)))
        assert pairs.cost("s", tuple(t)) == min(distance(t, "a" * k + "b" * k) for k in range(1, 32)), t
    rules = {"E": ["E+T", "T"], "T": ["x", "(E)", "yO"], "O": ["", "!"]}
    words, seen, work = set(), {"E"}, ["E"]
    while work:
        w = work.pop()
        at = next((i for i, c in enumerate(w) if c.isupper()), None)
        if at is None:
            words.add(w)
            continue
        for body in rules[w[at]]:
            x = w[:at] + body + w[at + 1 :]
            if len(x) - x.count("O") <= 8 and x not in seen:
                seen.add(x)
                work.append(x)
    sums = Chart(Grammar("e = e '+' t | t\nt = 'x' | '(' e ')' | 'y' o\no = '!'?", {}), lambda k, r: 0)
    for _ in range(60):
        t = "".join(rng.choice("x+()y!z") for _ in range(rng.randrange(5)))
        want = min(distance(t, w) for w in words)
        assert sums.cost("e", tuple(t)) == want, t
        assert sums.cost("e", tuple(t), 2) == min(want, 2), t


def test_cost_does_not_depend_on_length():
    for n in (2, 20, 60, 400):
        p = Parser("js")
        assert p.file("x = " + " + ".join(["a"] * n) + " b c d e;\n")[0] == 2, n
        assert p.file("x = " + " + ".join(["a"] * n) + " b c d e f g h i j k;\n")[0] == 5, n


def test_cost_does_not_depend_on_earlier_faults():
    last = "z = a + + * b c;\n"
    alone = Parser("js").file(last)[0]
    assert alone == 2
    for n in (4, 50):
        assert Parser("js").file("x = a b;\n" * n + last)[0] == n + alone


def test_groups_that_fit_another_rule_are_searched():
    assert Parser("js").file("if (a; b; c) d(); else e();\n")[0] == 2


def test_only_proven_costs_are_called_minima():
    p = Parser("js")
    assert p.file("x = a ? b ;\n: c ;\n")[0] == 2 and not p.minimal  # dropping the first ';' mends both
    assert p.file("x = a ? b\n: c ;\n")[0] == 0 and p.minimal


def test_deep_files_are_parsed_to_the_bottom():
    for n in (3, 30_000):
        assert judge("a.js", "x = " + "(" * n + "1 2" + ")" * n + ";")[1] == 1
        assert judge("a.json", "[" * n + "1 2" + "]" * n)[1] == 1
        assert judge("a.json", "[" * n + "1" + "]" * n)[1] == 0
    for n in (3, 1_000):
        f = "function f() {" * n
        assert judge("a.js", f + "x = 1 2;" + "}" * n)[1] == 1
        assert judge("a.js", f + "x = 1;" + "}" * n)[1] == 0
    assert list(docpairs.pairs_of("a.js", "x = " + "(" * 30_000 + "1" + ")" * 30_000 + ";")) == []


def test_limits_of_the_interpreter_are_no_faults():
    for n in (3, 20_000):
        assert judge("a.py", "x = " + " + ".join(["1"] * n) + "\n")[1] == 0
        assert judge("a.py", "x = " + " + ".join(["1"] * n) + " 2\n")[1] == 1
    assert judge("a.py", "x = " + "(" * 300 + "1" + ")" * 300 + "\n")[1] == 0
    assert judge("a.py", "x = " + "1" * 5_000 + "\n")[1] == 0


def test_ruby_lines_go_on_after_any_number_of_comments():
    for n in (1, 60):
        assert judge("a.rb", "a = b\n" + "# c\n" * n + "  .c\n")[1] == 0
