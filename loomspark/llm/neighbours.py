"""Most similar vectors for every vector: adaptive dimension scan inside probed lists.

Vectors are normalised and rotated (the same seeded orthogonal matrix everywhere). In a task the base
vectors are cut into lists by a few rounds of k-means; each list of queries probes the lists nearest
to it until they hold ``probe`` of the task's base. A query's bar comes from its nearest lists and
from ``least``. Other candidates are compared column block by column block (16 of the rotated
dimensions each); after every block a hypothesis test on the partial distance abandons those that
cannot pass the bar, the rest are finished.

A group of up to ``block`` vectors is one task. A larger one gets cells: centres are fitted on a
bounded sample, every vector is assigned to its nearest cell, and a query goes to as many of its
nearest cells as a measurement asks for: the exact neighbours of ``MEASURED`` queries of the group
are looked up, and the cells are counted that hold ``RECALL`` of them. So a vector is sent as often as
it has cells to probe, which depends on how well the data fall into cells and not on the group's size.
Cells and their queries are split into tasks of bounded size.

Defined results: vectors that are null, all zero, not finite, hold nulls or have another length are
left out; per node and version the row with the greatest ``created_at`` counts (then the greater
vector); a node is never its own neighbour; ties go to the smaller node id; a vector alone in its
group has no neighbours; empty input gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.session import materialize, sent

DIM = 64
#: Vectors of a group or cell in one task (4 MB of floats), and about as many in a list.
BLOCK, LIST = 16_384, 256
#: Share of a task's vectors that the probed lists hold, and the test's slack in deviations.
PROBE, SLACK = 0.85, 2.1
#: Dimensions of a column block; the test follows each.
COLUMNS = 16
#: Vectors of a group on which its cells' centres are fitted, the most cells of a group (larger cells
#: are split), queries measured exactly, and the share of their neighbours the probed cells must hold.
FITTED, CELLS, MEASURED, RECALL = 20_000, 1024, 64, 0.95
#: Vectors that one assigning task takes.
ASSIGNED = 65_536


def usable(embeddings: DataFrame, dim: int = DIM) -> DataFrame:
    """(g, v, node, vector): the current usable vector per node and version."""
    rows = embeddings.select(F.col("repo_path").alias("g"), F.col("model_version").alias("v"), F.col("node_id").alias("node"), "vector", "created_at")
    # a sum of squares over finite values is finite unless it overflows; null elements make it null
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ok = rows.where("g IS NOT NULL AND v IS NOT NULL AND node IS NOT NULL").where(F.size("vector") == dim).where(finite & F.exists("vector", lambda x: x != 0))
    best = ok.groupBy("g", "v", "node").agg(F.max(F.struct("created_at", "vector")).alias("x"))
    return best.select("g", "v", "node", F.col("x.vector").alias("vector"))


def _rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _lists(x: np.ndarray, size: int, fit: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """List of each row and the lists' centres; fitted on at most ``fit`` rows, all rows are assigned."""
    n = len(x)
    k = max(1, n // size)
    if k == 1:
        return np.zeros(n, np.int64), x.mean(axis=0, keepdims=True)
    rng = np.random.default_rng(11)
    fit = x[rng.choice(n, min(n, fit), replace=False)]
    centre = fit[rng.choice(len(fit), k, replace=False)]
    for _ in range(4):
        near = np.argmax(fit @ centre.T, axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, near, fit)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(norm > 0, total / np.maximum(norm, 1e-9), centre).astype(np.float32)
    return np.argmax(x @ centre.T, axis=1), centre


def scan(queries: np.ndarray, base: np.ndarray, own: np.ndarray, k: int, probe: float = PROBE, slack: float = SLACK, size: int = LIST, least: float = -1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, base row, similarity) of each query's k best base rows among the probed lists.

    Rows are normalised and rotated. ``own`` holds each query's row in the base, or -1; rows below
    ``least`` may be missing.
    """
    of_base, centre = _lists(base, size)
    order = np.argsort(of_base, kind="stable")
    starts = np.searchsorted(of_base[order], np.arange(len(centre) + 1))
    base, base_id = base[order], order
    of_query = np.argmax(queries @ centre.T, axis=1)
    dim = base.shape[1]
    cuts = [*range(0, dim, COLUMNS), dim]
    # squared length of each row's columns up to a cut
    lengths = np.cumsum(np.add.reduceat(base.astype(np.float64) ** 2, cuts[:-1], axis=1), axis=1).astype(np.float32)
    sizes = np.diff(starts)
    found: list[tuple] = []
    for q_list in np.unique(of_query):
        rows = np.flatnonzero(of_query == q_list)
        rank = np.argsort(-(centre @ centre[q_list]), kind="stable")
        held = np.cumsum(sizes[rank])
        n_first = int(np.searchsorted(held, 2 * k + 2)) + 1  # lists that set the bar
        n_all = max(n_first, int(np.searchsorted(held, probe * len(base))) + 1)
        near, far = rank[:n_first], rank[n_first:n_all]
        for s in range(0, len(rows), 1024):
            part = rows[s : s + 1024]
            q = queries[part]
            cols = np.concatenate([np.arange(starts[c], starts[c + 1]) for c in near])
            sim = q @ base[cols].T
            sim[base_id[cols][None, :] == own[part][:, None]] = -9.0
            kk = min(k, sim.shape[1])
            bar = -np.partition(-sim, kk - 1, axis=1)[:, kk - 1] if kk == k else np.full(len(part), -8.0, np.float32)
            bar = np.maximum(bar, np.float32(least - 1e-4))
            i, j = np.nonzero((sim >= bar[:, None]) & (sim > -8))
            got = [(i, cols[j], sim[i, j])]
            if len(far):
                cols = np.concatenate([np.arange(starts[c], starts[c + 1]) for c in far])
                i, j, sim = _columns(q, base[cols], lengths[cols], bar, cuts, slack)
                ok = base_id[cols[j]] != own[part][i]
                got.append((i[ok], cols[j[ok]], sim[ok]))
            i, j, sim = (np.concatenate(x) for x in zip(*got))
            o = np.lexsort((base_id[j], -sim, i))
            i, j, sim = i[o], j[o], sim[o]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            best = place < k
            found.append((part[i[best]], base_id[j[best]], sim[best]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return tuple(np.concatenate(x) for x in zip(*found))


def _columns(q: np.ndarray, b: np.ndarray, lengths: np.ndarray, bar: np.ndarray, cuts: list[int], slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, similarity) of the candidates that pass their query's bar, scanned block by block.

    While many candidates live their products are taken as matrices, later one by one.
    """
    dim = q.shape[1]
    own = np.cumsum(np.add.reduceat(q.astype(np.float64) ** 2, cuts[:-1], axis=1), axis=1).astype(np.float32)
    far = 2 - 2 * bar
    dense, alive = np.zeros((len(q), len(b)), np.float32), None
    i = j = sim = None
    for n, (a, e) in enumerate(zip(cuts, cuts[1:])):
        limit = far * (1 + slack / np.sqrt(e)) ** 2 * e / dim
        if i is None:
            dense += q[:, a:e] @ b[:, a:e].T
            if e == dim:
                i, j = np.nonzero(alive & (dense >= bar[:, None]) if alive is not None else dense >= bar[:, None])
                return i, j, dense[i, j]
            ok = own[:, n][:, None] + lengths[:, n][None, :] - 2 * dense <= limit[:, None]
            alive = ok if alive is None else alive & ok
            if np.count_nonzero(alive) <= 0.15 * alive.size:
                i, j = np.nonzero(alive)
                sim = dense[i, j]
        else:
            sim = sim + np.einsum("ij,ij->i", q[i, a:e], b[j, a:e])
            ok = sim >= bar[i] if e == dim else own[i, n] + lengths[j, n] - 2 * sim <= limit[i]
            i, j, sim = i[ok], j[ok], sim[ok]
    return i, j, sim


def _units(t: pa.Table, dim: int) -> np.ndarray:
    """Normalised vectors of a table in double precision."""
    flat = np.ascontiguousarray(t.column("vector").combine_chunks().flatten().to_numpy(), np.float64).reshape(-1, dim)
    unit = flat / np.abs(flat).max(axis=1, keepdims=True)  # large values must not overflow the norm
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


_NEAR = "g string, v string, node string, other string, similarity double"


def _task(k: int, probe: float, dim: int, least: float):
    """A task's queries against its base; ``part`` is 0 for base rows, 1 for queries, absent where all are both."""
    rotation = _rotation(dim)

    def run(t: pa.Table) -> pa.Table:
        # rows in the order of their ids, so that equal similarities go to the smaller id
        t = t.sort_by("node")
        unit = _units(t, dim)
        x = (unit @ rotation.astype(np.float64)).astype(np.float32)
        node = t.column("node").combine_chunks()
        if "part" in t.column_names:
            part = t.column("part").to_numpy()
            qs, bs = np.flatnonzero(part == 1), np.flatnonzero(part == 0)
            at = pc.index_in(node.take(pa.array(qs)), node.take(pa.array(bs)))
            own = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        else:
            qs = bs = np.arange(len(x))
            own = qs
        if len(qs) and len(bs):
            r, c, s = scan(x[qs], x[bs], own, k, probe, least=least)
            keep = s >= least - 1e-4
            r, c = qs[r[keep]], bs[c[keep]]
        else:
            r = c = np.zeros(0, np.int64)
        exact = np.einsum("ij,ij->i", unit[r], unit[c])
        return _rows(t, node.take(pa.array(r)), node.take(pa.array(c)), exact)

    return run


def _rows(t: pa.Table, node: pa.Array, other: pa.Array, similarity: np.ndarray, **more) -> pa.Table:
    g, v = t.column("g")[0].as_py(), t.column("v")[0].as_py()
    n = len(node)
    return pa.table({"g": pa.array([g] * n, pa.string()), "v": pa.array([v] * n, pa.string()), "node": node.cast(pa.string()), "other": other.cast(pa.string()), "similarity": pa.array(similarity, pa.float64()), **more})


def _cells(rows: DataFrame, sizes: DataFrame, block: int, dim: int) -> DataFrame:
    """(g, v, cell, vector): centres of each group's cells, fitted on about ``FITTED`` of its vectors."""

    def run(t: pa.Table) -> pa.Table:
        x = _units(t, dim).astype(np.float32)
        n = t.column("n")[0].as_py()
        want = min(CELLS, len(x), max(2, -(-2 * n // block)))
        _, centre = _lists(x, max(1, len(x) // want), fit=FITTED)
        g, v = t.column("g")[0].as_py(), t.column("v")[0].as_py()
        m = len(centre)
        return pa.table({"g": pa.array([g] * m, pa.string()), "v": pa.array([v] * m, pa.string()), "cell": pa.array(range(m), pa.int32()), "vector": pa.array(list(centre.astype(np.float32)), pa.list_(pa.float32()))})

    some = rows.join(sent(sizes), ["g", "v"]).where(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1_000_000)) < F.lit(FITTED * 1_000_000) / F.col("n"))
    return some.groupBy("g", "v").applyInArrow(run, "g string, v string, cell int, vector array<float>")


def _measure(k: int, dim: int):
    """Exact neighbours of the measured queries among one task's vectors, and how many cells are nearer to the
    query than the neighbour's own."""

    def run(t: pa.Table, guide: pa.Table) -> pa.Table:
        kind = guide.column("cell").to_numpy()
        centre = _units(guide.filter(pa.array(kind >= 0)).sort_by("cell"), dim)
        asked = guide.filter(pa.array(kind < 0)).sort_by("node")
        none = pa.array([], pa.string())
        if not len(t) or not len(asked):
            return _rows(guide, none, none, np.zeros(0), cells=pa.array([], pa.int32()))
        x, q = _units(t, dim), _units(asked, dim)
        sim = q @ x.T
        sim[pc.index_in(t.column("node"), asked.column("node").combine_chunks()).fill_null(-1).to_numpy()[None, :] == np.arange(len(q))[:, None]] = -9.0
        order = np.argsort(np.argsort(-(q @ centre.T), axis=1), axis=1)  # place of each cell for each query
        of = np.argmax(x @ centre.T, axis=1)
        kk = min(k, len(x))
        best = np.argpartition(-sim, kk - 1, axis=1)[:, :kk]
        i, j = np.repeat(np.arange(len(q)), kk), best.ravel()
        ok = sim[i, j] > -8
        i, j = i[ok], j[ok]
        node = asked.column("node").combine_chunks().take(pa.array(i))
        return _rows(guide, node, t.column("node").combine_chunks().take(pa.array(j)), sim[i, j], cells=pa.array(order[i, of[j]].astype(np.int32)))

    return run


def _assign(dim: int):
    """Each vector with its nearest cells, as many as its group probes; the first is its own."""

    def run(t: pa.Table, guide: pa.Table) -> pa.Table:
        guide = guide.sort_by("cell")
        centre, p = _units(guide, dim), guide.column("probes")[0].as_py()
        if not len(t):
            return t.select(["g", "v", "node", "vector"]).append_column("cells", pa.array([], pa.list_(pa.int32())))
        near = np.argsort(-(_units(t, dim) @ centre.T), axis=1, kind="stable")[:, :p].astype(np.int32)
        return t.select(["g", "v", "node", "vector"]).append_column("cells", pa.array(list(near), pa.list_(pa.int32())))

    return run


def probed_cells(rows: DataFrame, sizes: DataFrame, centres: DataFrame, k: int, dim: int, least: float) -> DataFrame:
    """(g, v, probes, recall): how many cells a query must probe so that they hold ``RECALL`` of the measured
    queries' exact neighbours, and the share they hold. Neighbours below ``least`` do not count where at
    least 100 others were measured."""
    salts = F.ceil(F.col("n") / F.lit(ASSIGNED)).cast("int")
    tasks = rows.join(sent(sizes), ["g", "v"]).select("g", "v", F.pmod(F.xxhash64("node"), salts).cast("int").alias("salt"), "node", "vector")
    w = Window.partitionBy("g", "v").orderBy(F.xxhash64("node", F.lit(9)), "node")
    asked = rows.join(sent(sizes), ["g", "v"]).where(F.pmod(F.xxhash64("node", F.lit(9)), F.lit(1_000_000)) < F.lit(4 * MEASURED * 1_000_000) / F.col("n"))
    asked = asked.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= MEASURED).select("g", "v", F.lit(-1).alias("cell"), "node", "vector")
    guide = centres.select("g", "v", "cell", F.lit("").alias("node"), "vector").unionByName(asked)
    guide = guide.join(sent(sizes), ["g", "v"]).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n")
    found = tasks.groupBy("g", "v", "salt").cogroup(guide.groupBy("g", "v", "salt")).applyInArrow(_measure(k, dim), _NEAR + ", cells int")
    best = Window.partitionBy("g", "v", "node").orderBy(F.col("similarity").desc(), "other")
    found = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
    counted = F.col("similarity") >= least
    at = lambda c: F.percentile(F.when(c, F.col("cells")), RECALL)
    probes = F.ceil(F.coalesce(F.when(F.count_if(counted) >= 100, at(counted)), at(F.lit(True)), F.lit(0))).cast("int") + 1
    found = materialize(found)
    per = materialize(found.groupBy("g", "v").agg(probes.alias("probes")))
    share = found.where(counted).join(sent(per), ["g", "v"]).groupBy("g", "v").agg(F.avg((F.col("cells") < F.col("probes")).cast("int")).alias("recall"))
    return per.join(share, ["g", "v"], "left")


def _large(rows: DataFrame, sizes: DataFrame, k: int, probe: float, block: int, dim: int, least: float) -> DataFrame:
    """Groups of more than ``block`` vectors, by cells."""
    rows, sizes = materialize(rows), materialize(sizes)
    centres = materialize(_cells(rows, sizes, block, dim))
    probes = materialize(probed_cells(rows, sizes, centres, k, dim, least).select("g", "v", "probes"))
    salts = F.ceil(F.col("n") / F.lit(ASSIGNED)).cast("int")
    tasks = rows.join(sent(sizes), ["g", "v"]).select("g", "v", F.pmod(F.xxhash64("node"), salts).cast("int").alias("salt"), "node", "vector")
    guide = centres.join(sent(probes), ["g", "v"]).join(sent(sizes), ["g", "v"]).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n")
    placed = tasks.groupBy("g", "v", "salt").cogroup(guide.groupBy("g", "v", "salt")).applyInArrow(_assign(dim), "g string, v string, node string, vector array<float>, cells array<int>")
    placed = materialize(placed)
    base = placed.select("g", "v", F.col("cells")[0].alias("cell"), "node", "vector")
    asks = placed.select("g", "v", F.explode("cells").alias("cell"), "node", "vector")
    # bounded tasks: a cell's base is cut into subs, its queries into turns; each sub meets each turn
    n_base = base.groupBy("g", "v", "cell").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("subs"))
    n_asks = asks.groupBy("g", "v", "cell").agg(F.ceil(F.count("*") / F.lit(4 * block)).cast("int").alias("turns"))
    plan = materialize(n_base.join(n_asks, ["g", "v", "cell"]))
    h = F.xxhash64("node")
    b = base.join(plan, ["g", "v", "cell"]).withColumn("sub", F.pmod(h, F.col("subs")).cast("int")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    a = asks.join(plan, ["g", "v", "cell"]).withColumn("turn", F.pmod(h, F.col("turns")).cast("int")).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
    cols = ["g", "v", "cell", "sub", "turn", "node", "vector"]
    both = b.select(*cols, F.lit(0).alias("part")).unionByName(a.select(*cols, F.lit(1).alias("part")))
    return both.groupBy("g", "v", "cell", "sub", "turn").applyInArrow(_task(k, probe, dim, least), _NEAR)


def nearest(vectors: DataFrame, k: int = 5, probe: float = PROBE, block: int = BLOCK, dim: int = DIM, least: float = -1.0) -> DataFrame:
    """(g, v, node, other, similarity, rank): each vector's k most similar others of its group.

    ``least`` leaves out neighbours below that similarity; the ranks of the others stay exact.
    """
    rows = vectors.select("g", "v", "node", "vector")
    big = rows.groupBy("g", "v").agg(F.count("*").alias("n")).where(F.col("n") > block)
    big = materialize(big)  # one row a group of over ``block`` vectors
    near = rows
    some = not big.isEmpty()
    if some:
        near = rows.join(big.select("g", "v"), ["g", "v"], "left_anti")
    near = near.groupBy("g", "v").applyInArrow(_task(k, probe, dim, least), _NEAR)
    if some:
        near = near.unionByName(_large(rows.join(big.select("g", "v"), ["g", "v"], "left_semi"), big, k, probe, block, dim, least))
    w = Window.partitionBy("g", "v", "node").orderBy(F.col("similarity").desc(), "other")
    return near.where(F.col("similarity") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def close_pairs(vectors: DataFrame, k: int = 5, least: float = 0.9, probe: float = PROBE, block: int = BLOCK) -> DataFrame:
    """(g, v, a, b): pairs at least ``least`` similar of which one is among the k nearest of the other; a < b."""
    n = nearest(vectors, k, probe, block, least=least)
    return n.select("g", "v", F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
