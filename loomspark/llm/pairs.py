"""Items that appear together: pair counts per group and how far they exceed chance.

Every record's items become a sorted list of compact 32-bit ids, its pairs packed 64-bit codes. A
task sorts its codes in memory runs and run-length counts each run before anything is shuffled; the
shuffle brings equal codes together, sorts them externally (sorted runs are spilled and merged), and
a run-length pass over the merged order yields the counts. Lift and the odds ratio with continuity
correction follow from the counts.

Items that cannot be in a pair asked for are left out beforehand, exactly: a pair's count is at most
the rarer item's, and its lift at most N / n of the commoner one. No item, record or pair is
otherwise dropped.

Defined results: null groups, records or lists, lists that are not JSON, blank and null entries are
skipped; a record that comes several times counts once with the union of its lists; repeats within
a list count once; records without items or with more than ``max_items`` count nowhere; empty input
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.session import materialize

#: Codes that a task sorts at once (8 bytes each) before run-length counting.
RUN = 2_000_000
#: Hash buckets in an item id's upper bits; the rank inside the bucket takes the other 20.
ID_BUCKETS, RANK_BITS = 4096, 20
#: Salts on the record side of the id join, so one common item does not fill one task.
SALTS = 16


def normal_path(p: Column) -> Column:
    """Backslashes as slashes and a leading './' dropped; a name of blanks only becomes ''."""
    q = F.when(F.trim(p) == "", F.lit("")).otherwise(F.translate(p, "\\", "/"))
    return F.when(q.startswith("./"), F.substring(q, 3, 1 << 30)).otherwise(q)


def baskets(records: DataFrame, group: str, record: str, items_json: str, max_items: int) -> DataFrame:
    """(g, ch, cl, keys): one row per countable record with the distinct 64-bit keys of its items.

    ``ch`` and ``cl`` are a 96-bit hash of the record's id, enough to tell any number of records apart.
    """
    lists = F.from_json(F.col(items_json), "array<string>")
    named = F.filter(F.transform(lists, normal_path), lambda x: x.isNotNull() & (x != ""))
    keys = F.array_sort(F.array_distinct(F.transform(named, lambda x: F.xxhash64(F.col("g"), x))))
    base = records.select(F.col(group).alias("g"), F.col(record).alias("rec"), F.col(items_json)).where("g IS NOT NULL AND rec IS NOT NULL")
    rows = base.select("g", F.xxhash64("g", "rec").alias("ch"), F.hash("rec", "g").alias("cl"), F.coalesce(keys, F.array().cast("array<bigint>")).alias("keys"))
    merged = rows.groupBy("g", "ch", "cl").agg(F.collect_set("keys").alias("all"))
    one = F.when(F.size("all") == 1, F.element_at("all", 1)).otherwise(F.array_distinct(F.flatten("all")))
    return merged.select("g", "ch", "cl", one.alias("keys")).where((F.size("keys") > 0) & (F.size("keys") <= max_items))


def item_names(records: DataFrame, group: str, items_json: str) -> DataFrame:
    """(k, g, name) of every item; two names under one 64-bit key stop the run instead of being mixed up."""
    rows = records.select(F.col(group).alias("g"), F.explode(F.from_json(F.col(items_json), "array<string>")).alias("p")).where("g IS NOT NULL")
    rows = rows.select("g", normal_path(F.col("p")).alias("name")).where("name IS NOT NULL AND name <> ''")
    both = rows.groupBy(F.xxhash64("g", "name").alias("k")).agg(F.min(F.struct("g", "name")).alias("a"), F.max(F.struct("g", "name")).alias("b"))
    same = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.raise_error(F.lit("two items share a 64-bit key")).cast("struct<g:string,name:string>"))
    return both.select("k", same.alias("a")).select("k", "a.g", "a.name")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted id lists to run-length counted pair codes."""

    def count(parts: list[np.ndarray]) -> pa.RecordBatch:
        codes = np.concatenate(parts)
        codes.sort()
        start = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        return pa.RecordBatch.from_arrays([pa.array(codes[start]), pa.array(np.diff(np.r_[start, len(codes)]))], names=["code", "n"])

    held, size = [], 0
    for batch in batches:
        ids = batch.column(0)
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        ends = ids.offsets.to_numpy()
        ends = ends - ends[0]
        sizes = np.diff(ends)
        for m in np.unique(sizes):
            if m < 2:
                continue
            block = np.sort(flat[ends[:-1][sizes == m][:, None] + np.arange(m)], axis=1)
            i, j = np.triu_indices(m, 1)
            step = max(1, RUN // len(i))
            for s in range(0, len(block), step):
                codes = ((block[s : s + step][:, i] << 32) | block[s : s + step][:, j]).ravel()
                held.append(codes)
                size += len(codes)
                if size >= RUN:
                    yield count(held)
                    held, size = [], 0
    if size:
        yield count(held)


def _run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of equal neighbouring codes of a sorted stream."""
    last, total = None, 0
    for batch in batches:
        codes, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(codes):
            continue
        start = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        keys, sums = codes[start], np.add.reduceat(n, start)
        if last is not None and keys[0] == last:
            sums[0] += total
        elif last is not None:
            keys, sums = np.r_[last, keys], np.r_[total, sums]
        last, total = keys[-1], int(sums[-1])
        yield pa.RecordBatch.from_arrays([pa.array(keys[:-1]), pa.array(sums[:-1])], names=["code", "n_ab"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([total], pa.int64())], names=["code", "n_ab"])


def together(records: DataFrame, group: str = "repo_path", record: str = "sha", items_json: str = "files_json", max_items: int = 50, min_count: int = 1, min_lift: float = 0.0) -> DataFrame:
    """Pairs with their counts: g, a, b (names, the smaller first), n_ab, n_a, n_b, n, lift, odds_ratio."""
    base = materialize(baskets(records, group, record, items_json, max_items))
    totals = base.groupBy("g").agg(F.count("*").alias("n"))
    counts = base.select("g", F.explode("keys").alias("k")).groupBy("g", "k").agg(F.count("*").alias("nk"))
    # a pair's lift is at most n / max(n_a, n_b), its count at most min(n_a, n_b)
    usable = counts.join(totals, "g").where((F.col("nk") >= min_count) & (F.col("nk") * F.lit(float(min_lift)) <= F.col("n")))
    lane = F.pmod(F.col("k"), F.lit(ID_BUCKETS))
    rank = F.row_number().over(Window.partitionBy("lane").orderBy("k"))
    ids = usable.withColumn("lane", lane).withColumn("rank", rank)
    whole = F.when(F.col("rank") < (1 << RANK_BITS), F.shiftleft(F.col("lane").cast("long"), RANK_BITS).bitwiseOR(F.col("rank").cast("long")))
    ids = ids.select("k", "nk", "n", F.coalesce(whole, F.raise_error(F.lit("too many items for 32-bit ids")).cast("long")).alias("id"))
    salted = ids.select("k", "id").withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    seen = base.select("ch", "cl", F.explode("keys").alias("k")).withColumn("salt", F.pmod(F.col("ch"), F.lit(SALTS)).cast("int"))
    lists = seen.join(salted, ["k", "salt"]).groupBy("ch", "cl").agg(F.collect_list("id").alias("ids")).where(F.size("ids") > 1).select("ids")
    codes = lists.mapInArrow(_pack, "code long, n long")
    merged = codes.repartition("code").sortWithinPartitions("code").mapInArrow(_run_lengths, "code long, n_ab long").where(F.col("n_ab") >= min_count)
    names = ids.join(item_names(records, group, items_json), "k")
    low = F.lit(0xFFFFFFFF).cast("long")
    out = merged.select(F.shiftrightunsigned("code", 32).alias("ia"), F.col("code").bitwiseAND(low).alias("ib"), "n_ab")
    a = names.select(F.col("id").alias("ia"), "g", F.col("name").alias("name_a"), F.col("nk").alias("n1"), "n")
    b = names.select(F.col("id").alias("ib"), F.col("name").alias("name_b"), F.col("nk").alias("n2"))
    # the dictionary carries n; lift can be tested before the names are known
    small = ids.select("id", "nk", "n")
    out = out.join(small.select(F.col("id").alias("ia"), F.col("nk").alias("ta"), F.col("n").alias("tn")), "ia").join(small.select(F.col("id").alias("ib"), F.col("nk").alias("tb")), "ib")
    out = out.where(F.col("n_ab") * F.col("tn") >= F.lit(float(min_lift)) * F.col("ta") * F.col("tb")).drop("ta", "tb", "tn")
    out = out.join(a, "ia").join(b, "ib")
    swap = F.col("name_a") > F.col("name_b")
    out = out.select(
        "g",
        F.least("name_a", "name_b").alias("a"),
        F.greatest("name_a", "name_b").alias("b"),
        "n_ab",
        F.when(swap, F.col("n2")).otherwise(F.col("n1")).alias("n_a"),
        F.when(swap, F.col("n1")).otherwise(F.col("n2")).alias("n_b"),
        "n",
    )
    both, x, y = F.col("n_ab") + 0.5, F.col("n_a") - F.col("n_ab") + 0.5, F.col("n_b") - F.col("n_ab") + 0.5
    rest = F.col("n") - F.col("n_a") - F.col("n_b") + F.col("n_ab") + 0.5
    return out.withColumn("lift", F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))).withColumn("odds_ratio", both * rest / (x * y))
