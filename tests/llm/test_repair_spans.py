import random
from time import process_time

import pytest

from loomspark.llm.code.chart import Chart, Grammar, Spans
from loomspark.llm.code.parser import Parser
from tests.llm.test_repair_sizes import distance


@pytest.fixture
def only_spans(monkeypatch):
    monkeypatch.setattr(Spans, "steps", lambda self, n: 0)


def test_a_foreign_text_takes_no_more_than_a_share_of_its_search():
    began = process_time()
    x = 0
    for k in range(20_000_000):
        x += k
    unit = process_time() - began
    text = "def load(a, b):\n    for x in a.items(b, c):\n        if x not in b and a[x] is None:\n            y = x.get(a) or [b, c]\n    return y\n" * 10
    began = process_time()
    assert Parser("cpp").file(text)[0] > 40
    assert process_time() - began < 10 * unit


def test_costs_over_spans_are_the_least_distance(only_spans):
    rng = random.Random(5)
    pairs = Chart(Grammar("s = 'a' s 'b' | 'a' 'b'", {}), lambda k, r: 0)
    for _ in range(80):
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(30)))
        assert pairs.cost("s", tuple(t)) == min(distance(t, "a" * k + "b" * k) for k in range(1, 32)), t
    empty = Chart(Grammar("s = n 'x'\nn = ", {}), lambda k, r: 0)
    assert [empty.cost("n", tuple("x" * k)) for k in range(3)] == [0, 1, 2]
    assert [empty.cost("s", tuple("y" * k)) for k in range(3)] == [1, 1, 2]


RUNS = [(lang, start) for lang, start in (("js", "stm"), ("cpp", "unit"), ("java", "unit"), ("rust", "unit"), ("python", "unit"), ("ruby", "stmts"), ("go", "unit"), ("ts", "stm"))]


@pytest.mark.parametrize("lang,start", RUNS)
def test_both_ways_give_the_same_cost(lang, start, monkeypatch):
    rng = random.Random(lang)
    words = "ID ID ID NUM STR . , ; = + < > : ( [ if else for return class def in while -> & *".split()
    price = {}

    def inside(kind, rule):
        return price.setdefault((kind, rule), rng.randrange(1, 4))

    grammar = Parser(lang).g
    for _ in range(25):
        kinds = tuple(rng.choice([*words, "#P1", "#S2", "#B3", "#B4"]) for _ in range(rng.randrange(1, 22)))
        found = []
        for steps in (0, 1 << 60):
            monkeypatch.setattr(Spans, "steps", lambda self, n, steps=steps: steps)
            chart = Chart(grammar, inside, lambda k, r: price.setdefault((k, r), rng.randrange(4)) == 0)
            found.append(chart.cost(start, kinds))
        assert found[0] == found[1], kinds
