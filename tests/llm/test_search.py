"""Pair counts, neighbours, leaks, mixing and reading levels against brute force."""

import itertools
import json
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.llm import leak, mixing, neighbours, pairs, reading

COMMITS = "repo_path string, sha string, files_json string, g string, k long"


def test_pairs_match_brute_force(spark):
    rng = random.Random(3)
    rows, truth = [], {}
    for g in ("r", "s"):
        for c in range(120):
            files = [f"f{min(int(rng.expovariate(0.25)), 30)}" for _ in range(rng.randrange(0, 9))]
            truth[g, f"c{c}"] = set(files)
            rows.append((g, f"c{c}", json.dumps([*files, "", " ", f"./{files[0]}"] if files else []), "clash", 1))
    rows += [rows[0], ("r", "big", json.dumps([f"x{i}" for i in range(60)]), "", 0), ("r", None, '["a","b"]', "", 0), (None, "z", '["a","b"]', "", 0), ("r", "bad", "{", "", 0), ("r", "nul", None, "", 0), ("r", "nulls", '[null, "f1", "a\\\\b"]', "", 0)]
    truth["r", "nulls"] = {"f1", "a/b"}
    n, one, two = Counter(), Counter(), Counter()
    for (g, _), fs in truth.items():
        if fs:
            n[g] += 1
            one.update((g, f) for f in fs)
            two.update((g, *p) for p in itertools.combinations(sorted(fs), 2))
    df = spark.createDataFrame(rows, COMMITS)
    got = {(r.g, r.a, r.b): (r.n_ab, r.n_a, r.n_b, r.n, r.lift, r.odds_ratio) for r in pairs.together(df).collect()}
    assert got.keys() == two.keys()
    for (g, a, b), c in two.items():
        na, nb, nn = one[g, a], one[g, b], n[g]
        x = got[g, a, b]
        assert x[:4] == (c, na, nb, nn) and x[4] == pytest.approx(c * nn / (na * nb))
        assert x[5] == pytest.approx((c + 0.5) * (nn - na - nb + c + 0.5) / ((na - c + 0.5) * (nb - c + 0.5)))
    some = {k for k, c in two.items() if c >= 3 and c * n[k[0]] >= 2 * one[k[0], k[1]] * one[k[0], k[2]]}
    assert {(r.g, r.a, r.b) for r in pairs.together(df, min_count=3, min_lift=2.0).collect()} == some
    assert pairs.together(spark.createDataFrame([], COMMITS)).count() == 0


def test_run_lengths_across_batches():
    import pyarrow as pa

    b = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"]) for c, n in [([1, 1, 2], [1, 2, 3]), ([2], [4]), ([], []), ([2, 5], [1, 1])]]
    out = [r for x in pairs._run_lengths(iter(b)) for r in zip(x.column(0).to_pylist(), x.column(1).to_pylist())]
    assert out == [(1, 3), (2, 8), (5, 1)]


VECTORS = "repo_path string, node_id string, model_version string, vector array<float>, created_at long, similarity int"


def _vectors(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, 64))
    for i in range(0, n - 5, 6):  # families of near copies
        base[i + 1 : i + 3] = base[i] + 0.15 * rng.standard_normal((2, 64))
    return base.astype(np.float32)


@pytest.mark.parametrize("block", [16_384, 300])
def test_neighbour_recall(spark, block):
    x = _vectors(900, 1)
    rows = [("r", f"n{i:04d}", "1", v.tolist(), 5, 0) for i, v in enumerate(x)]
    rows += [("r", "n0000", "1", x[5].tolist(), 1, 0), ("r", "zero", "1", [0.0] * 64, 1, 0), ("r", "short", "1", [1.0] * 32, 1, 0), ("r", "nan", "1", [float("nan")] * 64, 1, 0), ("r", "inf", "1", [float("inf")] + [1.0] * 63, 1, 0), ("r", "null", "1", None, 1, 0), ("r", "hole", "1", [None] + [1.0] * 63, 1, 0), ("s", "alone", "1", x[0].tolist(), 1, 0), ("r", rows[0][1], "2", x[9].tolist(), 1, 0)]
    v = neighbours.usable(spark.createDataFrame(rows, VECTORS))
    assert v.count() == 902
    got = defaultdict(dict)
    for r in neighbours.nearest(v, 5, block=block).collect():
        got[r.node][r.other] = r.similarity
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = np.argsort(-s, axis=1)[:, :5]
    hit = sum(f"n{j:04d}" in got[f"n{i:04d}"] for i in range(900) for j in want[i])
    assert hit / 4500 >= 0.9
    assert all(len(got[f"n{i:04d}"]) == 5 for i in range(900)) and "alone" not in got
    near = {(f"n{min(i, j):04d}", f"n{max(i, j):04d}") for i in range(900) for j in want[i] if s[i, j] >= 0.9}
    found = {(r.a, r.b) for r in neighbours.close_pairs(v, block=block).where("g = 'r' AND v = '1'").collect()}
    assert len(near & found) >= 0.99 * len(near) and not found - near
    assert neighbours.nearest(neighbours.usable(spark.createDataFrame([], VECTORS))).count() == 0


def test_few_cells_are_probed_where_vectors_fall_into_clusters(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((20, 64)) * 3
    x = (centre[rng.integers(0, 20, 1500)] + rng.standard_normal((1500, 64))).astype(np.float32)
    v = spark.createDataFrame([("r", "1", f"n{i:04d}", a.tolist()) for i, a in enumerate(x)], "g string, v string, node string, vector array<float>")
    sizes = v.groupBy("g", "v").count().withColumnRenamed("count", "n")
    cells = neighbours._cells(v, sizes, 200, 64)
    p = neighbours.probed_cells(v, sizes, cells, 5, 64, -1.0).first()
    assert cells.count() >= 10 and p.probes <= 4 and p.recall >= neighbours.RECALL
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {(f"n{i:04d}", f"n{j:04d}") for i in range(1500) for j in np.argsort(-s[i])[:5]}
    got = {(r.node, r.other) for r in neighbours.nearest(v, 5, block=200).collect()}
    assert len(got) == 7500 and len(got & want) >= 0.9 * len(want)


def test_scan_without_limits_is_exact():
    x = _vectors(700, 2)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j, _ = neighbours.scan(x, x, np.arange(700), 3, probe=1.0, slack=1e9)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    assert {(a, b) for a, b in zip(i, j)} == {(a, b) for a in range(700) for b in np.argsort(-s[a])[:3]}


ITEM = "Show where lorgar loses the sparse ledger once pellor is initial for 18 ticks and name the venrus tag that the garnor handler would rename first of all"
STANDING = "Answer with the path of one file inside the repository and nothing else."


def test_leaks_in_every_dress(spark):
    w = ITEM.split()
    part = " ".join(w[3:19])
    forms = {
        1: ITEM, 2: part.upper(), 3: "> " + "\n> ".join(" ".join(w[i : i + 5]) for i in range(0, 20, 5)), 4: " ".join(f"**{x}**" if i % 3 == 0 else f"`{x}`" for i, x in enumerate(w[:16])), 5: "​".join(part[i : i + 7] for i in range(0, len(part), 7)),
        6: json.dumps({"p": "\n".join(w[2:18])}), 7: part.replace(" ", "&nbsp;"), 8: " ".join("WRONG" if i == 7 else x for i, x in enumerate(w[:15])), 9: part.replace("ledger", "led-\nger").replace("initial", "ini-\n  tial"), 10: "<p>" + part.replace("once", "<b>on</b>ce") + "</p>",
        11: "// " + "\n// ".join(" ".join(w[i : i + 4]) for i in range(0, 20, 4)), 12: " ".join("x" if i % 8 == 7 else v for i, v in enumerate(w)),
    }
    clean = {51: " ".join(w[:12]), 52: " ".join(reversed(w)), 53: STANDING * 3, 54: " ".join("x" if i % 4 == 3 else v for i, v in enumerate(w)), 55: "", 56: None, 57: "word " * 50_000, 58: " ".join(w[:8]) + " and then " + " ".join(w[20:])}
    docs = spark.createDataFrame([(k, v, 1) for k, v in {**forms, **clean}.items()] + [(None, ITEM, 1), (1, ITEM, 1)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, f"{ITEM}, {STANDING}", "a")] + [(i, " ".join(f"w{i}x{j}" for j in range(40)) + f" {STANDING}", None) for i in range(2, 6)] + [(9, None, None), (None, "x", None)], "item_id long, text string, answer string")
    got = {(r.doc_id, r.item_id) for r in leak.leaked(docs, items).collect()}
    assert got == {(k, 1) for k in forms}
    assert {(r.doc_id, r.item_id) for r in leak.leaked(docs, items, salts=1).collect()} == got
    assert [(r.sentence, r.n_items) for r in leak.standing_sentences(items).collect()] == [(" ".join(leak.words(STANDING)), 5)]
    assert leak.leaked(docs.limit(0), items).count() == 0 and leak.leaked(docs, items.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_winnowing_never_misses_a_span(data):
    words = [f"v{i}" for i in range(40)]
    a, n = data.draw(st.integers(0, 20)), data.draw(st.integers(13, 20))
    span = words[a : a + n]
    for i in data.draw(st.lists(st.integers(1, n - 2), max_size=n // 8, unique=True)):
        span[i] = "zz"
    doc = [f"o{i}" for i in range(data.draw(st.integers(0, 9)))] + span + [f"p{i}" for i in range(data.draw(st.integers(0, 9)))]
    x, y = leak.codes(words), leak.codes(doc)
    hx, hy = leak._grams(x), leak._grams(y)
    assert set(hx[leak._winnow(hx)]) & set(hy[leak._winnow(hy)])
    assert leak.measure(words, doc) >= n


def test_passages_of_several_items_and_other_scripts(spark):
    shared = " ".join(f"common{i}" for i in range(40)) + "."
    cyrillic = "Покажи где обработчик теряет запись журнала после восемнадцати шагов и назови метку которую он переименует первой"
    dense = "请说明处理程序在十八个步骤之后丢失了哪一条日志记录"
    tag = "<img data='" + "a " * 400 + "'>"
    items = spark.createDataFrame([(i, f"{shared} Question {'abc'[i]}?") for i in range(3)] + [(5, cyrillic), (6, dense)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {shared} y"), (2, cyrillic.upper()), (3, dense), (4, shared.replace("common7 ", f"common7 {tag} ")), (5, "common0 " * 3000)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leak.leaked(docs, items).collect()}
    assert got == {(1, 0), (1, 1), (1, 2), (2, 5), (3, 6), (4, 0), (4, 1), (4, 2)}


def test_repeated_words_stay_cheap():
    assert leak.measure(["a"] * 60, ["a"] * 3000) == 60
    assert leak.measure([*"abcdefgh", "w", "w", "w", "w", "w"], ["w"] * 3000) == 0


DOC = "doc_id long, text string, lang string, source string"
RATE = "doc_id long, rater string, rating int"


def test_mixture_shares_and_caps(spark):
    rng = random.Random(1)
    docs = [(i, "tok " * rng.randrange(5, 60), "en", s) for i, s in enumerate(rng.choice(["A:x", "a:X ", "b", "c", "d"]) for _ in range(400))] + [(900, None, "en", "b"), (901, "", "en", "b"), (902, "x", "en", None), (None, "x", "en", "b")]
    counts = mixing.token_counts(spark.createDataFrame(docs, DOC)).cache()
    t = spark.createDataFrame([("a:x", 0.5, 2), ("b", 0.3, 1), ("c", 0.1, 1), ("d", 0.0, 9), ("none", 0.4, 1), ("n", None, 1), ("N2", float("nan"), None)], "source string, target_share double, max_repeats int")
    for total, strict in ((None, True), (6000, False), (60_000, False)):
        plan = mixing.budgets(counts, t, total, strict)
        mixed = mixing.mixture(counts, plan)
        rep = {r.source: r for r in mixing.report(mixed, plan).collect()}
        assert sum(r.reached_share for r in rep.values()) == pytest.approx(1.0)
        assert all(r.most_copies <= r.max_repeats for r in rep.values()) and rep["d"].tokens == rep["none"].tokens == rep["n"].tokens == 0
        if total != 60_000:
            for s, share in (("a:x", 5 / 9), ("b", 3 / 9), ("c", 1 / 9)):
                assert rep[s].reached_share == pytest.approx(share, abs=0.001)
        else:  # more than there is: everything as often as allowed
            assert rep["b"].tokens == rep["b"].available_tokens and rep["a:x"].tokens == 2 * rep["a:x"].available_tokens
        copies = defaultdict(set)
        for r in mixed.collect():
            copies[r.source] |= {r.copies + (r.part_tokens > 0), r.copies}
        assert {s: r.tokens for s, r in rep.items()} == {r.source: r.budget for r in plan.collect()}
        assert all(max(c) - min(c) <= 1 for c in copies.values())
    # b is short of its share: the others make up for it in proportion, and the total is met
    short = {r.source: r.budget for r in mixing.budgets(counts, t.replace(0.3, 0.9, subset="target_share"), total_tokens=9000).collect()}
    size = {r.source: r.size for r in mixing.budgets(counts, t).collect()}
    assert short["b"] == size["b"] and abs(sum(short.values()) - 9000) <= 3 and short["a:x"] == pytest.approx(5 * short["c"], abs=5)
    loose = {r.source: r.budget for r in mixing.budgets(counts, t, strict=True, tolerance=0.2).collect()}
    tight = {r.source: r.budget for r in mixing.budgets(counts, t, strict=True).collect()}
    assert sum(loose.values()) > sum(tight.values())
    empty = spark.createDataFrame([], DOC)
    assert mixing.mix(empty, t)[0].count() == 0 and mixing.mix(spark.createDataFrame(docs, DOC), t.limit(0))[0].count() == 0


EASY = "The {a} is red. I like the {b}. Now open the {a}. We had one {b} and ten more. Do not read it yet. It did not run. "
HARD = "Notwithstanding the ostensible {c} of the {d}, any characterisation that presupposes {c} necessarily conflates the normal form with its counterpart. The distinction between {d} and {c}, frequently elided in the literature, becomes consequential whenever the hypothesis governing {d} is weakened. "


def _text(kind, rng):
    a, b = rng.sample("box tree row page book tool".split(), 2)
    c, d = rng.sample("canonicalisation linearisability factorisation monotonicity eigendecomposition amortisation".split(), 2)
    return " ".join((EASY if kind < 3 else HARD).format(a=a, b=b, c=c, d=d) for _ in range(4))


def test_reading_levels(spark):
    rng = random.Random(2)
    rows = [(i, _text(1 if i % 2 else 4, rng), "en", f"s{i % 6}") for i in range(160)]
    extra = [
        (900, None, "en", "x"), (901, "", "en", "x"), (902, "```\n" + "x = y(1)\n" * 60 + "```", "en", "x"), (903, "Die Datei wurde nach 27 Sekunden wieder geschlossen und der Dienst schreibt jede Zeile nur einmal. " * 6, "en", "x"),
        (904, _text(1, rng) + "\n\n> " + HARD.format(c="amortisation", d="monotonicity"), None, "x"), (905, "Some averyveryLongIdentifierName_withParts " * 3 + _text(1, rng), "de", "x"), (906, _text(4, rng), "de", None), (None, "x", "en", "x"),
    ]
    docs = spark.createDataFrame(rows + extra, DOC)
    ratings = spark.createDataFrame([(i, "q", 1 if i % 2 else 4) for i in range(0, 120)] + [(1, "z", None), (3, "z", 9), (None, "q", 1)], RATE)
    grader = reading.fit(docs, ratings)
    assert grader.error < 0.3
    g = {r.doc_id: r.grade for r in reading.grades(docs, grader).collect()}
    assert all((g[i] < 2) if i % 2 else (g[i] > 3.5) for i in range(120, 160))
    assert g[900] is None and g[901] is None and g[902] is None and g[903] is None and None not in g
    assert g[904] < 3 and g[905] < 3 and g[906] > 3.5
    assert reading.fit(docs, ratings.limit(0)) is None
    assert reading.grades(docs, None).where("grade IS NOT NULL").count() == 0 and reading.grades(docs.limit(0), grader).count() == 0


def test_isotonic_and_trees():
    x, y = reading.isotonic(np.array([1.0, 2, 3, 4]), np.array([1.0, 3, 2, 4]), np.ones(4))
    assert np.interp([1, 2.5, 4], x, y).tolist() == [1.0, 2.5, 4.0]
    rng = np.random.default_rng(0)
    a = rng.random((400, 3))
    t = a[:, 0] * 3 + (a[:, 1] > 0.5)
    assert math.sqrt(np.mean((reading.Trees().fit(a, t, np.ones(400)).predict(a) - t) ** 2)) < 0.2
