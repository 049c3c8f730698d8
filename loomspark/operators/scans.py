"""Reading, classifying and comparing files, and the keyed sinks that keep tables current.

Defined results: rows with a null key are skipped; of several rows of one key the greatest order
value stands (nulls lowest), repeated rows change nothing; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions import text as X

#: Larger files are not read.
MOST_BYTES = 5 * 1024 * 1024
# Suffixes of indexed files.
INDEXED = ".md .txt .py .json .yaml .yml .toml .js .ts .tsx .jsx .swift .java .rb .c .h .cpp .cc .cxx .hpp .hh .hxx .qml .qmldir .qmltypes .qmlproject .go .rs .sh .cmake .qrc .ui .pro".split()


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keyed latest-wins, with a map-side combine: the greatest (order, rest) row of every key."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    has_key = F.lit(True)
    for k in keys:
        has_key = has_key & F.col(k).isNotNull()
    best = df.where(has_key).groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_x"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_x.{c}").alias(c) for c in df.columns])


def current_sources(sources: DataFrame) -> DataFrame:
    return latest(sources, ["repo_path", "path"], ["modified_at"])


def candidates(sources: DataFrame, skip_dirs: list[str], most_bytes: int = MOST_BYTES) -> DataFrame:
    """Files that are read: indexed suffix, no skipped folder among the parents, small enough, valid text."""
    parents = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    ok = F.lower(X.suffix(F.col("path"))).isin(INDEXED) & (F.octet_length("content") <= most_bytes)
    return sources.where(ok & ~F.arrays_overlap(parents, F.array(*[F.lit(d) for d in skip_dirs])))


def fingerprints(sources: DataFrame) -> DataFrame:
    """sha256 of the sorted 'path NUL size NUL mtime' lines of each repository.

    The hash needs all lines of a repository in order, so it is built from hashes of 4096 path
    ranges' lines: no task holds more than one range's lines and 4096 hashes.
    """
    line = F.concat_ws("\u0000", "path", F.col("size_bytes").cast("string"), F.col("mtime_ns").cast("string"))
    part = F.pmod(F.xxhash64("path"), F.lit(4096))
    parts = sources.groupBy("repo_path", part.alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("h"))
    return parts.groupBy("repo_path").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), "\n"), 256).alias("fingerprint"))


def plain_fingerprints(sources: DataFrame) -> DataFrame:
    """The flat form of the fingerprint, for repositories whose file list fits one row."""
    line = F.concat_ws("\u0000", "path", F.col("size_bytes").cast("string"), F.col("mtime_ns").cast("string"))
    return sources.groupBy("repo_path").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("fingerprint"), F.count("*").alias("n_files"))


def classify_changes(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """new, changed, restat (same content, other mtime), unchanged or deleted, per file of either side.

    Both sides carry repo_path, path, content_hash, mtime_ns.
    """
    s = stored.select("repo_path", "path", F.col("content_hash").alias("_h0"), F.col("mtime_ns").alias("_m0"), F.lit(True).alias("_s"))
    n = scanned.select("repo_path", "path", F.col("content_hash").alias("_h1"), F.col("mtime_ns").alias("_m1"), F.lit(True).alias("_n"))
    state = (
        F.when(F.col("_s").isNull(), "new").when(F.col("_n").isNull(), "deleted").when(~F.col("_h0").eqNullSafe(F.col("_h1")), "changed").when(~F.col("_m0").eqNullSafe(F.col("_m1")), "restat").otherwise("unchanged")
    )
    return s.join(n, ["repo_path", "path"], "full_outer").select("repo_path", "path", state.alias("state"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*old.columns))


def delete_owned(rows: DataFrame, paths: DataFrame, owner: str) -> DataFrame:
    """Rows whose owning file is not among ``paths`` (repo_path, path)."""
    gone = paths.select("repo_path", F.col("path").alias(owner)).distinct()
    return rows.join(gone, ["repo_path", owner], "left_anti")


def retain(rows: DataFrame, group: str, at: str, oldest: object, most: int, tie: str) -> DataFrame:
    """Rows not older than ``oldest``, and of these the ``most`` newest of each group."""
    w = Window.partitionBy(group).orderBy(F.col(at).desc(), F.col(tie).desc())
    return rows.where(F.col(at) >= oldest).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def sections(sources: DataFrame) -> DataFrame:
    """Headings of Markdown files: (repo_path, path, ordinal, line, title)."""
    md = sources.where(X.suffix(F.col("path")) == ".md").select("repo_path", "path", F.posexplode(X.lines(F.col("content"))).alias("n", "text"))
    title = F.trim(F.regexp_replace("text", "^#+", ""))
    heads = md.where(F.col("text").startswith("#")).withColumn("title", title).where("title <> ''")
    w = Window.partitionBy("repo_path", "path").orderBy("n")
    return heads.select("repo_path", "path", F.row_number().over(w).cast("long").alias("ordinal"), (F.col("n") + 1).cast("long").alias("line"), "title")
