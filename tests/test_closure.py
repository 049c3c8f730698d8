import random
from collections import defaultdict

import pytest

from loomspark.operators.hierarchy import closure

SCHEMA = "repo_path string, source string, target string"


def brute(links):
    """(ancestor, node, distance) of every upward path; nothing for nodes on or below a loop."""
    parents = defaultdict(set)
    for s, t in links:
        parents[t].add(s)
    out = set()
    for n in list(parents):
        found, level, k = set(), {n}, 0
        while level and k <= len(parents) + 1:
            level, k = {p for x in level for p in parents.get(x, ())}, k + 1
            found |= {(p, n, k) for p in level}
        if not level:
            out |= found
    return out


def test_diamond(spark):
    links = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "d"), ("d", "e")]
    got = [(r.node, r.descendant, r.distance) for r in closure(spark.createDataFrame([("r", *x) for x in links], SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(links)
    assert ("c", "d", 1) in got and ("c", "e", 2) in got and ("a", "d", 1) in got and ("a", "d", 2) in got


@pytest.mark.parametrize("seed", [1, 2])
def test_random_links_match_brute_force(spark, seed):
    rng = random.Random(seed)
    links = [(f"n{a}", f"n{a + rng.randrange(1, 5)}") for a in range(20) for _ in range(2)]
    links += [("x", "y"), ("y", "x"), ("n3", "y"), ("y", "z"), ("self", "self")]
    rows = [("r", *x) for x in links] + [("r", *links[0]), ("q", "n0", "only"), (None, "a", "b"), ("r", None, "b"), ("r", "a", None)]
    got = [(r.g, r.node, r.descendant, r.distance) for r in closure(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got))
    assert {x[1:] for x in got if x[0] == "r"} == brute(links) and [x for x in got if x[0] == "q"] == [("q", "n0", "only", 1)]


def test_registered_and_empty(spark):
    import __spark_entry__

    assert "p6_descendants" in __spark_entry__.queries()
    assert closure(spark.createDataFrame([], SCHEMA)).count() == 0
