import json
from collections import Counter
from itertools import combinations

import pytest

from loomspark.llm.queries import p5_odds


def test_rare_pairs_have_lift_and_odds(spark, tmp_path):
    lists = [["a", "b"], ["a", "b"], ["b", "c"], ["a"], ["d", "e", "f"]] + [["x", "y"]] * 7
    spark.createDataFrame([("r", str(i), json.dumps(x)) for i, x in enumerate(lists)], "repo_path string, sha string, files_json string").write.parquet(f"{tmp_path}/commits.parquet")
    one, two, n = Counter(f for x in lists for f in x), Counter(p for x in lists for p in combinations(sorted(x), 2)), len(lists)
    got = {(r.path_a, r.path_b): r for r in p5_odds(spark, str(tmp_path)).collect()}
    assert set(got) == set(two)
    for (a, b), k in two.items():
        r = got[a, b]
        assert (r.n_ab, r.n_a, r.n_b, r.n) == (k, one[a], one[b], n)
        assert r.lift == pytest.approx(k * n / (one[a] * one[b]), abs=1e-6)
        assert r.odds_ratio == pytest.approx((k + 0.5) * (n - one[a] - one[b] + k + 0.5) / ((one[a] - k + 0.5) * (one[b] - k + 0.5)), abs=1e-6)
