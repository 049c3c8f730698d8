import random

from loomspark.operators import graphs

NODE = "repo_path string, node_id string, kind string"
EDGE = "repo_path string, source string, target string, relation string, layer string, weight double"
SPAN = "repo_path string, node_id string, source_ref string, granularity string, span_start int, span_end int"


def test_one_task_and_rounds_agree(spark):
    rng = random.Random(5)
    nodes = [(r, f"n{i:02d}", "file") for r in "ab" for i in range(30)] + [("a", "c", "commit"), ("a", "n00", "file"), ("e", "lonely", "file")]
    edges = [(r, f"n{a:02d}", f"n{b:02d}", "calls", "STRUCTURAL", None) for r in "ab" for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(60))]
    edges += [("a", "c", "n01", "touches", "STRUCTURAL", 1.0), ("a", "n02", "gone", "calls", "STRUCTURAL", 1.0), ("a", "n03", "n04", "contains", "HEADING", 1.0), ("a", "n05", "n06", "cochange", "COCHANGE", 0.05)]
    n, e = spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)
    one = {(r.repo_path, r.node_id): r.community for r in graphs.communities(n, e).collect()}
    rounds = {(r.repo_path, r.node_id): r.community for r in graphs.communities(n, e, small=0).collect()}
    assert one == rounds and one["a", "c"] == "c" and one["e", "lonely"] == "lonely" and len(one) == 62
    assert graphs.communities(n.limit(0), e.limit(0)).count() == 0


def test_containers_match_brute_force(spark):
    rng = random.Random(6)
    spans = [("r", f"s{i}", f"f{i % 2}", "symbol", a, a + rng.choice([0, 3, 40, 70, 700, 5000, 60_000])) for i, a in enumerate(rng.randrange(1, 3000) for _ in range(120))]
    spans += [("r", "null", "f0", "symbol", None, 5), ("r", "back", "f0", "symbol", 9, 2), ("r", "file", "f0", "file", 1, 99_999)]
    want = {}
    for _, i, f, g, a, b in spans:
        if g == "symbol" and a is not None:
            held = [(y - x, o) for _, o, p, h, x, y in spans if h == "symbol" and o != i and p == f and x is not None and x <= a and b <= y and y >= x and (x, y) != (a, b)]
            if held:
                want[i] = min(held)[1]
    assert {r.node_id: r.container for r in graphs.containers(spark.createDataFrame(spans, SPAN)).collect()} == want
