import random
from collections import defaultdict

import pytest

from loomspark.operators.hierarchy import default_locality, descendants, hierarchy

SCHEMA = "repo_path string, source string, target string, node string, root int"


def brute(links):
    """(node, root, depth) of every node by following parents upwards."""
    parents, nodes = defaultdict(set), set()
    for s, t in links:
        parents[t].add(s)
        nodes |= {s, t}
    bad = set()
    for n in nodes:  # on or below a loop: an ancestor reaches itself
        seen, todo = set(), [n]
        while todo:
            for p in parents[todo.pop()]:
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        for a in seen | {n}:
            up, todo = set(), [a]
            while todo:
                for p in parents[todo.pop()]:
                    if p not in up:
                        up.add(p)
                        todo.append(p)
            if a in up:
                bad.add(n)
    out = set()

    def climb(n, m, d):
        if not parents[m]:
            out.add((n, m, d))
        for p in parents[m]:
            climb(n, p, d + 1)

    for n in nodes:
        if n in bad:
            out.add((n, "", -1))
        else:
            climb(n, n, 0)
    return out


@pytest.mark.parametrize("small,hot", [(100_000, 100_000), (0, 3)])
@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs_match_brute_force(spark, small, hot, seed):
    rng = random.Random(seed)
    links = [(f"n:{rng.randrange(40) // 4}:{a}", f"n:{rng.randrange(40) // 4}:{a + rng.randrange(1, 6)}") for a in range(25) for _ in range(rng.randrange(0, 2))]
    links += [("n:a:x", "n:b:y"), ("n:b:y", "n:a:x"), ("n:b:y", "n:c:z"), ("self", "self"), ("n:c:z", "n:9:24"), ("n:9:24", "n:9:99")]
    rows = [("r", s, t, "clash", 1) for s, t in links] + [("r", *links[0], "again", 2), (None, "a", "b", "", 0), ("r", None, "b", "", 0), ("r", "a", None, "", 0)]
    tree = hierarchy(spark.createDataFrame(rows, SCHEMA), small=small, hot=hot, locality=(lambda c: [default_locality(c)[0]]) if hot == 3 else default_locality)
    got = [(r.node, r.root, r.depth) for r in tree.collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(links)
    for r in tree.collect():
        if r.depth >= 0:
            assert r.path[0] == r.root and r.path[-1] == r.node and len(r.path) == r.depth + 1
        else:
            assert r.path is None


def test_long_chain_across_partitions(spark):
    links = [("r", f"k:{i}:a", f"k:{i + 1}:a", "", 0) for i in range(60)]
    for small in (100_000, 0):
        got = {r.node: (r.root, r.depth) for r in hierarchy(spark.createDataFrame(links, SCHEMA), small=small).collect()}
        assert got["k:60:a"] == ("k:0:a", 60) and len(got) == 61


def test_descendants_and_empty(spark):
    rows = [("r", "a", "b", "", 0), ("r", "b", "c", "", 0), ("r", "a", "d", "", 0)]
    d = {(r.node, r.descendant, r.distance) for r in descendants(hierarchy(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert d == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("a", "d", 1)}
    assert hierarchy(spark.createDataFrame([], SCHEMA)).count() == 0


def test_deep_layers_and_loops_in_rounds(spark):
    """50 layers, a loop of single links, a loop through a node with two parents, with paths, in rounds."""
    links = [(f"k:{i}:a", f"k:{i + 1}:a") for i in range(50)] + [(f"k:{i}:b", f"k:{i + 1}:a") for i in range(0, 50, 10)]
    links += [(f"o:{i}:x", f"o:{(i + 1) % 7}:x") for i in range(7)] + [("o:3:x", "t:0:x")] + [(f"t:{i}:x", f"t:{i + 1}:x") for i in range(9)]
    links += [("m:0:x", "m:1:x"), ("m:1:x", "m:2:x"), ("m:2:x", "m:1:x"), ("m:2:x", "m:3:x")]
    rows = [("r", s, t, "", 0) for s, t in links]
    got = hierarchy(spark.createDataFrame(rows, SCHEMA), small=0, locality=lambda c: [c]).collect()
    assert {(r.node, r.root, r.depth) for r in got} == brute(links) and len(got) == len(brute(links))
    assert all(r.path[0] == r.root and len(r.path) == r.depth + 1 for r in got if r.depth >= 0)


def test_levels_contract_folders(spark):
    """Chains across files and folders are settled level by level, with whole paths."""
    ids = [f"file:a/b/{'xyz'[i % 3]}/f{i // 2}.py" for i in range(12)] + [f"symbol:a/c/g{i}.py:s" for i in range(5)]
    links = list(zip(ids, ids[1:]))
    got = {r.node: r for r in hierarchy(spark.createDataFrame([("r", s, t, "", 0) for s, t in links], SCHEMA), small=0).collect()}
    assert [got[x].path for x in ids] == [ids[: i + 1] for i in range(len(ids))]
