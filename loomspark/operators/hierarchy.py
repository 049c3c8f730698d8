"""Parent-child links to full hierarchies.

Weighted disjoint sets, merged hierarchically. Links are brought together by a locality key, and in
every partition the children with one parent are joined to their topmost local ancestor with their
distance to it. Only sets that other partitions refer to, nodes with several parents and loops go
on: they are the next level's links, brought together by a coarser key (the file, its folder, the
outermost folders, the group), each level contracting what the one below left. What the last level
leaves open is settled by distributed rounds. Then every level's sets take their root and depth
from the level above, and paths are put together from each level's pieces, found by their top.

Nodes with several parents do not fit a disjoint-set forest (they have several roots), so they end
a set at every level and are combined as sets of (root, depth) in the rounds. Loops are cut before
anything is doubled: a pointer that meets its own start is one.

Defined results: rows with a null group, parent or child are skipped; repeated links count once; a
node on a loop or below one has exactly one row with root '' and depth -1 and a null path; empty
input gives no rows; columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.session import materialize, sent

#: Links of one key in one task; a hotter key is spread by the child's hash.
HOT = 200_000
#: Links of one group that one task may settle after the last level; more are settled in rounds.
SMALL = 400_000

_LOCAL = T.StructType(
    [
        T.StructField("g", T.StringType()),
        T.StructField("node", T.StringType()),
        T.StructField("top", T.StringType()),
        T.StructField("off", T.IntegerType()),
        T.StructField("path", T.ArrayType(T.StringType())),
        T.StructField("multi", T.BooleanType()),
    ]
)
_FOUND = T.StructType(
    [
        T.StructField("g", T.StringType()),
        T.StructField("x", T.StringType()),
        T.StructField("root", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("path", T.ArrayType(T.StringType())),
    ]
)


def default_locality(child: Column) -> list[Column]:
    """Keys from fine to coarse: a node id's second part (its file, cut at the first dot where it has
    no folder), the file's folder, its two outermost folders, nothing."""
    part = F.get(F.split(child, ":"), F.lit(1))
    file = F.coalesce(F.when(F.instr(part, "/") > 0, part).otherwise(F.substring_index(part, ".", 1)), child)
    folder = F.regexp_replace(file, "/[^/]*$", "")
    return [file, folder, F.substring_index(folder, "/", 2), F.lit("")]


class _Forest:
    """Weighted disjoint sets over one task's links: each node knows its set's top and its distance to it."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}
        self.dist: dict[str, int] = {}

    def link(self, child: str, parent: str, distance: int) -> None:
        self.up[child], self.dist[child] = parent, distance

    def find(self, x: str) -> tuple[str, int] | None:
        """Top and distance of x with path compression; None on a loop."""
        trail, seen = [], set()
        while x in self.up:
            if x in seen:
                return None
            seen.add(x)
            trail.append(x)
            x = self.up[x]
        total = 0
        for y in reversed(trail):
            total += self.dist[y]
            self.up[y], self.dist[y] = x, total
        return x, total


def _local_sets(rows: list[tuple], paths: bool) -> Iterator[tuple]:
    """(node, top, distance, path below the top, has several) of links (child, parent or None, distance, path)."""
    parents: dict[str, dict] = {}
    for child, parent, d, way in rows:
        known = parents.setdefault(child, {})
        if (parent, d) not in known or (paths and way < known[parent, d]):
            known[parent, d] = way
    forest = _Forest()
    single: dict[str, tuple] = {}
    for c, ps in parents.items():
        if len(ps) == 1:
            ((p, d), way), *_ = ps.items()
            if p is not None:
                single[c] = (p, way)
                forest.link(c, p, d)

    def chain(c: str, top: str) -> list[str]:
        out: list[list[str]] = []
        while c != top:
            c, way = single[c]
            out.append(way)
        return [x for way in reversed(out) for x in way]

    for c, ps in parents.items():
        if c in single:
            hit = forest.find(c)
            yield (c, None, 0, None, False) if hit is None else (c, hit[0], hit[1], chain(c, hit[0]) if paths else None, False)
            continue
        best: dict = {}
        for (p, d), way in ps.items():
            hit = None if p is None else forest.find(p)
            key = (None, 0) if hit is None else (hit[0], hit[1] + d)
            full = [*chain(p, hit[0]), *way] if paths and hit is not None else None
            if key not in best or (paths and full is not None and full < best[key]):
                best[key] = full
        for (top, d), full in best.items():
            yield c, top, d, full, True


def _local(links: DataFrame, paths: bool) -> DataFrame:
    """Sets of each run of equal (g, loc, salt) in sorted partitions of (g, loc, salt, t, s, d, path)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
        key, held = None, []
        for frame in frames:
            ways = frame["path"] if paths else repeat(None)
            for g, loc, salt, t, s, d, way in zip(frame["g"], frame["loc"], frame["salt"], frame["t"], frame["s"], frame["d"], ways):
                if (g, loc, salt) != key:
                    if held:
                        yield [(key[0], *x) for x in _local_sets(held, paths)]
                    key, held = (g, loc, salt), []
                held.append((t, None if pd.isna(s) else s, int(d), list(way) if way is not None else None))
        if held:
            yield [(key[0], *x) for x in _local_sets(held, paths)]

    def batched(frames):
        wait: list[tuple] = []
        for rows in run(frames):
            wait += rows
            if len(wait) > 20_000:
                yield pd.DataFrame(wait, columns=_LOCAL.names)
                wait = []
        if wait:
            yield pd.DataFrame(wait, columns=_LOCAL.names)

    return links.mapInPandas(batched, _LOCAL)


def _merge_task(rows: list[tuple], paths: bool) -> Iterator[tuple]:
    """Topological merge of contracted links (x, top or None, distance, path) of one group."""
    parents: dict[str, list] = {}
    below: dict[str, list[str]] = {}
    for x, y, d, p in rows:
        parents.setdefault(x, []).append((y, d, p))
        below.setdefault(y, []).append(x)
    wait = {x: len(ps) for x, ps in parents.items()}
    found: dict[str, dict] = {}
    ready = [y for y in below if y is not None and y not in parents]
    for y in ready:
        found[y] = {(y, 0): [y] if paths else None}
    done: set[str] = set()
    while ready:
        y = ready.pop()
        for x in below.get(y, ()):
            wait[x] -= 1
            if wait[x]:
                continue
            best: dict = {}
            for top, d, p in parents[x]:
                for (root, depth), way in found[top].items():
                    k, v = (root, depth + d), ([*way, *p] if paths else None)
                    if k not in best or (paths and v < best[k]):
                        best[k] = v
            found[x] = best
            done.add(x)
            ready.append(x)
    for x in parents:
        if x in done:
            for (root, depth), way in found[x].items():
                yield x, root, depth, way
        else:
            yield x, "", -1, None


def _merge_small(contracted: DataFrame, paths: bool) -> DataFrame:
    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        tops = [None if pd.isna(t) else t for t in frame["top"]]
        rows = [(x, y, int(d), list(p) if p is not None else None) for x, y, d, p in zip(frame["node"], tops, frame["off"], frame["path"])]
        return pd.DataFrame([(key[0], *r) for r in _merge_task(rows, paths)], columns=["g", "x", "root", "depth", "path"])

    return contracted.groupBy("g").applyInPandas(run, _FOUND)


def _cut_loops(rows: DataFrame) -> DataFrame:
    """(g, x) of one node of every loop of links (g, x, top) in which every x has one top.

    Pointers double; with each goes the least id it has passed. A node whose pointer has passed
    the node itself, as the least of all, is a loop's mark. Whatever leads to a marked loop is
    dropped, and so is what leads out, so a round only keeps what is neither settled yet.
    """
    active = materialize(rows.select("g", "x", F.col("top").alias("p"), F.col("top").alias("lo")))
    found = None
    while True:
        to = active.select("g", F.col("x").alias("p"), F.col("p").alias("_p"), F.col("lo").alias("_lo"))
        marks = materialize(active.where("lo = x").select("g", "x"))
        found = marks if found is None else found.unionByName(marks)
        ahead = active.join(to, ["g", "p"])
        for c in ("lo", "_lo"):
            ahead = ahead.join(marks.withColumnRenamed("x", c), ["g", c], "left_anti")
        active = materialize(ahead.select("g", "x", F.col("_p").alias("p"), F.least("lo", "_lo").alias("lo")))
        if active.isEmpty():
            return found.distinct()


def _merge_large(contracted: DataFrame) -> DataFrame:
    """Distributed rounds: links to a resolved node are replaced by its (root, depth) sets, links to a
    node with one link are doubled. A round that resolves nothing has only loops left, which run
    through nodes with several parents; the others were cut before."""
    rows = materialize(contracted.select("g", F.col("node").alias("x"), "top", "off", "path").distinct())
    xs = rows.select("g", "x").distinct()
    # a top that is no x is a root
    rows = rows.join(xs.withColumnRenamed("x", "top").withColumn("open", F.lit(True)), ["g", "top"], "left").select(
        "g", "x", "top", F.col("off").cast("long").alias("off"), "path", F.col("top").isNull().alias("loop"), F.coalesce("open", F.lit(False)).alias("open")
    )
    rows = materialize(rows.withColumn("path", F.when(F.col("open"), F.col("path")).otherwise(F.concat(F.array("top"), F.col("path")))))
    alone = rows.groupBy("g", "x").agg(F.count("*").alias("n")).where("n = 1").select("g", "x")
    cut = _cut_loops(rows.where("open").join(alone, ["g", "x"], "left_semi")).withColumn("cut", F.lit(True))
    rows = rows.join(cut, ["g", "x"], "left").withColumn("cut", F.coalesce("cut", F.lit(False)))
    rows = rows.select("g", "x", F.when(~F.col("cut"), F.col("top")).alias("top"), "off", F.when(~F.col("cut"), F.col("path")).alias("path"), (F.col("loop") | F.col("cut")).alias("loop"), (F.col("open") & ~F.col("cut")).alias("open"))
    parts: list[DataFrame] = []
    lost = F.lit(None).cast("array<string>")
    while True:
        rows = materialize(rows)
        state = rows.groupBy("g", "x").agg(F.max(F.col("open").cast("int")).alias("wait"), F.max(F.col("loop").cast("int")).alias("loop_"), F.count("*").alias("n"))
        # one loop above a node decides it, whatever its other links are
        bad = state.where("loop_ = 1").select("g", "x", F.lit("").alias("root"), F.lit(-1).cast("long").alias("depth"), lost.alias("path"))
        fine = rows.join(state.where("wait = 0 AND loop_ = 0").select("g", "x"), ["g", "x"], "left_semi")
        ready = materialize(bad.unionByName(fine.groupBy("g", "x", F.col("top").alias("root"), F.col("off").alias("depth")).agg(F.min("path").alias("path"))))
        pending = rows.join(state.where("wait = 1 AND loop_ = 0").select("g", "x"), ["g", "x"], "left_semi")
        if ready.isEmpty():
            parts.append(pending.select("g", "x", F.lit("").alias("root"), F.lit(-1).cast("long").alias("depth"), lost.alias("path")).distinct())
            break
        parts.append(ready)
        # first all links to what this round resolved; what stays open leads to unresolved nodes only
        known = ready.select("g", F.col("x").alias("top"), F.col("root").alias("_t"), F.col("depth").alias("_d"), F.col("path").alias("_p"))
        moved, gone = F.col("open") & F.col("_t").isNotNull(), F.col("_d") == -1
        told = pending.join(known, ["g", "top"], "left").select(
            "g",
            "x",
            F.when(moved & gone, F.lit(None)).when(moved, F.col("_t")).otherwise(F.col("top")).alias("top"),
            (F.col("off") + F.when(moved & ~gone, F.col("_d")).otherwise(F.lit(0))).alias("off"),
            F.when(moved & gone, lost).when(moved, F.concat("_p", "path")).otherwise(F.col("path")).alias("path"),
            (F.col("loop") | (moved & gone)).alias("loop"),
            (F.col("open") & ~moved).alias("open"),
        )
        told = materialize(told.distinct())
        # then open links to nodes that have one link themselves
        single = told.groupBy("g", "x").agg(F.count("*").alias("n")).where("n = 1").select("g", "x")
        one = told.where("open").join(single, ["g", "x"], "left_semi").select("g", F.col("x").alias("top"), F.col("top").alias("_t"), F.col("off").alias("_d"), F.col("path").alias("_p"))
        moved = F.col("open") & F.col("_t").isNotNull()
        rows = told.join(one, ["g", "top"], "left").select(
            "g",
            "x",
            F.when(moved, F.col("_t")).otherwise(F.col("top")).alias("top"),
            F.when(moved, F.col("off") + F.col("_d")).otherwise(F.col("off")).alias("off"),
            F.when(moved, F.concat("_p", "path")).otherwise(F.col("path")).alias("path"),
            "loop",
            "open",
        )
        rows = rows.distinct()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("depth", F.col("depth").cast("int"))


def _place(links: DataFrame, loc: Column, hot: int) -> DataFrame:
    """Links sorted by (g, loc, salt) in the tasks that hold them; a key with over ``hot`` links is split
    by the child, so that all links of a child stay together."""
    e = links.withColumn("loc", loc)
    counts = e.groupBy("g", "loc").count().where(F.col("count") > hot).select("g", "loc", F.ceil(F.col("count") / hot).cast("int").alias("parts"))
    e = e.join(counts, ["g", "loc"], "left").withColumn("salt", F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("t"), F.col("parts")).cast("int"))).drop("parts")
    return e.repartition("g", "loc", "salt").sortWithinPartitions("g", "loc", "salt")


def hierarchy(edges: DataFrame, group: str = "repo_path", parent: str = "source", child: str = "target", locality=default_locality, paths: bool = True, small: int = SMALL, hot: int = HOT) -> DataFrame:
    """Every endpoint's (root, depth) and, with ``paths``, the smallest path of ids from the root.

    Columns: g, node, root, depth, path. ``locality`` gives the keys of the levels, fine to coarse.
    """
    e = edges.select(F.col(group).cast("string").alias("g"), F.col(parent).cast("string").alias("s"), F.col(child).cast("string").alias("t"))
    e = e.where("g IS NOT NULL AND s IS NOT NULL AND t IS NOT NULL")
    way = F.array("t") if paths else F.lit(None).cast("array<string>")
    links = e.select("g", "s", "t", F.lit(1).alias("d"), way.alias("path"))
    keys = locality(F.col("t"))
    levels: list[tuple[DataFrame, DataFrame]] = []  # sets of a level, and the links that go on
    for n, key in enumerate(keys if isinstance(keys, list) else [keys]):
        local = materialize(_local(_place(links, key, hot), paths))
        if n == 0:
            first = local
        tops = local.where("top IS NOT NULL").select("g", F.col("top").alias("node")).distinct()
        refer = local.join(tops, ["g", "node"], "left_semi")
        going = materialize(refer.unionByName(local.where("multi OR top IS NULL")).distinct())
        levels.append((local, going))
        if going.isEmpty():
            break
        links = going.select("g", F.col("top").alias("s"), F.col("node").alias("t"), F.col("off").alias("d"), "path")
    contracted = levels[-1][1]
    most = contracted.groupBy("g").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    found = materialize(_merge_small(contracted, paths) if most <= small else _merge_large(contracted))
    for local, going in reversed(levels):
        done = local.where("NOT multi AND top IS NOT NULL").join(going.select("g", "node").distinct(), ["g", "node"], "left_anti")
        f = sent(found).select("g", F.col("x").alias("top"), F.col("root").alias("_r"), F.col("depth").alias("_d"), F.col("path").alias("_p"))
        hit, bad = F.col("_r").isNotNull(), F.col("_d") == -1
        told = done.join(f, ["g", "top"], "left").select(
            "g",
            F.col("node").alias("x"),
            F.when(hit, F.col("_r")).otherwise(F.col("top")).alias("root"),
            F.when(hit & bad, F.lit(-1)).when(hit, F.col("_d") + F.col("off")).otherwise(F.col("off")).cast("int").alias("depth"),
            F.when(hit & bad, F.lit(None)).when(hit, F.concat("_p", "path")).otherwise(F.concat(F.array("top"), F.col("path"))).alias("path"),
        )
        found = found.unionByName(told)
        if local is not first:
            found = materialize(found)
    nodes = first.select("g", "node").distinct()
    tops = e.select("g", F.col("s").alias("node")).distinct()
    roots = tops.join(nodes, ["g", "node"], "left_anti").select("g", "node", F.col("node").alias("root"), F.lit(0).alias("depth"), F.array("node").alias("path"))
    out = found.withColumnRenamed("x", "node").unionByName(roots)
    return out if paths else out.drop("path")


def descendants(tree: DataFrame) -> DataFrame:
    """(g, node, descendant, distance) of a ``hierarchy`` result with paths; nodes without a place have none.

    Whole only where every node has one parent: with several paths to one (root, depth) the smallest
    path stands. ``closure`` lists every descendant of any links.
    """
    at = F.posexplode("path").alias("_i", "anc")
    rows = tree.where("path IS NOT NULL").select("g", F.col("node").alias("descendant"), F.size("path").alias("_n"), at)
    return rows.where("anc <> descendant").select("g", F.col("anc").alias("node"), "descendant", (F.col("_n") - 1 - F.col("_i")).cast("int").alias("distance")).distinct()


def closure(edges: DataFrame, group: str = "repo_path", parent: str = "source", child: str = "target") -> DataFrame:
    """(g, node, descendant, distance) of every path between two nodes, each distance once.

    Read off the links themselves, so all ways through nodes with several parents count; nodes
    without a place are nobody's descendants and have none. Distances double with every round.
    """
    e = edges.select(F.col(group).cast("string").alias("g"), F.col(parent).cast("string").alias("node"), F.col(child).cast("string").alias("descendant"))
    e = e.where("g IS NOT NULL AND node IS NOT NULL AND descendant IS NOT NULL").distinct()
    lost = hierarchy(edges, group, parent, child, paths=False).where("depth = -1").select("g", F.col("node").alias("descendant"))
    # a child with a place has only parents with a place, so what is left has no loops
    new = materialize(e.join(lost, ["g", "descendant"], "left_anti").select("g", "node", "descendant", F.lit(1).alias("distance")))
    out, reach = new, 1
    while True:
        # paths of up to 2 x reach: one of up to reach, then one of exactly reach
        far = new.where(F.col("distance") == reach).select("g", F.col("node").alias("_m"), F.col("descendant").alias("_d"))
        near = out.withColumnRenamed("descendant", "_m")
        new = materialize(near.join(far, ["g", "_m"]).select("g", "node", F.col("_d").alias("descendant"), (F.col("distance") + reach).alias("distance")).distinct())
        if new.isEmpty():
            return out
        out, reach = out.unionByName(new), 2 * reach
