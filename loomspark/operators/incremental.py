"""Processing only new or changed records.

Both sides, what is there now and what earlier runs recorded, are brought to one row per record,
written, and summed up per partition into a fingerprint: the row count and additive hashes. Equal
fingerprints rule a partition out; rows are read again and compared only in the others. ``IncrementalTable`` applies the same
plan to a stored result and replaces each changed partition atomically.

Defined results: null paths or repositories are skipped; a null content has no provable hash, so
its record is always due; of several states of one file the greatest ``modified_at`` is current
(nulls lowest, then the greater hash); repeated rows change nothing; an empty log makes every
current file due, empty sources make none due.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomspark.session import materialize

BUCKETS = 1024


def bucket(path: Column, buckets: int = BUCKETS) -> Column:
    """The partition of a record inside its repository; splits a hot repository evenly."""
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def fingerprint_columns(present: Column, *values: Column) -> list[Column]:
    """Count and additive hashes of the rows where ``present`` holds; independent of order.

    The 64-bit hash is summed in two halves, so no sum can overflow below 2**31 rows a partition.
    """
    h = F.xxhash64(*values)
    g = F.xxhash64(F.lit("second"), *values)
    return [
        F.sum(present.cast("long")),
        F.sum(F.when(present, h.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.lit(0))),
        F.sum(F.when(present, F.shiftrightunsigned(h, 32)).otherwise(F.lit(0))),
        F.sum(F.when(present, g.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.lit(0))),
    ]


def _current(sources: DataFrame) -> DataFrame:
    return sources.select(
        F.col("repo_path").alias("_r"),
        F.col("path").alias("_p"),
        F.struct(F.col("modified_at").alias("at"), F.sha2(F.col("content"), 256).alias("h")).alias("_now"),
    )


def _logged(runs: DataFrame, log: DataFrame) -> DataFrame:
    """Log rows of successful runs, with the run's start as the leading order."""
    ok = runs.where(F.col("status") == "ok").groupBy(F.col("repo_path").alias("_r"), F.col("run_id").alias("_run")).agg(F.max("started_at").alias("_started"))
    rows = log.select(
        F.col("repo_path").alias("_r"), F.col("run_id").alias("_run"), F.col("path").alias("_p"), F.col("recorded_at").alias("_rec"), F.col("op").alias("_op"), F.col("content_hash").alias("_h")
    )
    return rows.join(ok, ["_r", "_run"]).select(
        "_r", "_p", F.struct(F.col("_started").alias("started"), F.col("_rec").alias("rec"), F.col("_run").alias("run"), F.col("_op").alias("op"), F.col("_h").alias("h")).alias("_log")
    )


def _keyed(df: DataFrame, buckets: int) -> DataFrame:
    return df.where(F.col("_r").isNotNull() & F.col("_p").isNotNull()).withColumn("_b", bucket(F.col("_p"), buckets))


def current_states(sources: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(_r, _b, _p, _h): the hash of every file's current content; a hot repository lies in all its buckets."""
    files = _keyed(_current(sources), buckets).groupBy("_r", "_b", "_p").agg(F.max("_now").alias("_x"))
    return files.select("_r", "_b", "_p", F.col("_x.h").alias("_h"))


def logged_states(runs: DataFrame, log: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(_r, _b, _p, _h): the hash every file was last recorded with by a successful run; deleted files have no row."""
    files = _keyed(_logged(runs, log), buckets).groupBy("_r", "_b", "_p").agg(F.max("_log").alias("_x"))
    return files.where(F.coalesce(F.col("_x.op"), F.lit("")) != "delete").select("_r", "_b", "_p", F.col("_x.h").alias("_h"))


def partition_fingerprints(states: DataFrame) -> DataFrame:
    """(_r, _b, f0 .. f3, open): a partition's count and additive hashes; ``open`` where a hash is missing,
    which no fingerprint can vouch for."""
    sums = fingerprint_columns(F.lit(True), F.col("_p"), F.col("_h"))
    return states.groupBy("_r", "_b").agg(*[x.alias(f"f{i}") for i, x in enumerate(sums)], F.max(F.col("_h").isNull()).alias("open"))


def changed_partitions(now: DataFrame, then: DataFrame) -> DataFrame:
    """(_r, _b) of the partitions there are now whose fingerprints are new, different or open."""
    n, t = now.alias("n"), then.alias("t")
    j = n.join(t, (F.col("n._r") == F.col("t._r")) & (F.col("n._b") == F.col("t._b")), "left")
    differs = F.col("n.open") | F.col("t.f0").isNull()
    for i in range(4):
        differs = differs | ~F.col(f"n.f{i}").eqNullSafe(F.col(f"t.f{i}"))
    return j.where(differs).select(F.col("n._r").alias("_r"), F.col("n._b").alias("_b"))


def due_files(sources: DataFrame, runs: DataFrame, log: DataFrame, buckets: int = BUCKETS, recorded: DataFrame | None = None) -> DataFrame:
    """Files the next run has to process: current files that are unrecorded, were last recorded as
    deleted, or whose recorded hash is not the hash of the content.

    The states of both sides are written once. Their fingerprints are compared first; rows are
    looked at only in partitions that differ. ``recorded`` are ``partition_fingerprints`` an
    earlier call stored for the log side; then the log is read for changed partitions only.
    """
    now = materialize(current_states(sources, buckets))
    then = logged_states(runs, log, buckets)
    if recorded is None:
        then = materialize(then)
        recorded = partition_fingerprints(then)
    todo = materialize(changed_partitions(partition_fingerprints(now), recorded))
    seen = then.join(todo, ["_r", "_b"], "left_semi").where("_h IS NOT NULL").select("_r", "_b", "_p", "_h")
    return now.join(todo, ["_r", "_b"], "left_semi").join(seen, ["_r", "_b", "_p", "_h"], "left_anti").select(F.col("_r").alias("repo_path"), F.col("_p").alias("path"))


class KeyChanged(ValueError):
    """A computation moved a record out of the partitions that are recomputed."""


class IncrementalTable:
    """A derived table kept up to date partition by partition.

    ``refresh`` fingerprints the input per partition, compares with the fingerprints the last
    successful run stored, recomputes only changed partitions and replaces them by dynamic
    partition overwrite. What holds at each step:

    * the fingerprints are written first, as a draft, and exactly these are published last: a
      record that arrives in between is not in them, so the next run finds its partition changed;
    * a run that dies anywhere before the publication leaves the old fingerprints, so the next run
      repeats exactly the unfinished partitions, and as a partition is replaced as a whole nothing
      is skipped or doubled;
    * changed partitions for which nothing was written (their records are gone, or ``compute``
      yields none) are removed;
    * ``compute`` must keep the key columns: a row that falls outside the recomputed partitions
      stops the write before anything is replaced.

    Null keys make a key like any other; null contents count in the fingerprint; an empty input
    empties the table; a table never filled reads as no rows once a refresh has run.
    """

    def __init__(self, spark: SparkSession, location: str, key: list[str], content: list[str], buckets: int = 64):
        self.spark, self.location, self.key, self.content, self.buckets = spark, location, key, content, buckets

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.location)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _versions(self) -> list[str]:
        """Names of the published sets of fingerprints, oldest first."""
        fs, path = self._fs()
        at = path(f"{self.location}/fingerprints")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(c) for c in self.key]), F.lit(self.buckets)).cast("int")

    def fingerprints(self, df: DataFrame) -> DataFrame:
        sums = fingerprint_columns(F.lit(True), *[F.col(c) for c in [*self.key, *self.content]])
        # null positions are hashed beside the values, which xxhash64 alone would skip
        nulls = F.sum(F.xxhash64(F.concat_ws(",", *[F.col(c).isNull().cast("int") for c in [*self.key, *self.content]]), *[F.col(c) for c in [*self.key, *self.content]]).bitwiseAND(F.lit(0xFFFFFFFF)))
        return df.groupBy(self._bucket().alias("_bucket")).agg(*[s.alias(f"f{i}") for i, s in enumerate([*sums, nulls])])

    def changed(self, now: DataFrame) -> list[int]:
        """Buckets whose fingerprint is new, different or gone; at most ``buckets`` numbers reach the driver."""
        published = self._versions()
        if not published:
            return sorted(r[0] for r in now.select("_bucket").collect())
        old = self.spark.read.schema(now.schema).parquet(f"{self.location}/fingerprints/{published[-1]}")
        both = now.alias("n").join(old.alias("o"), "_bucket", "full_outer")
        return sorted(r[0] for r in both.where(" OR ".join(f"NOT (n.f{i} <=> o.f{i})" for i in range(5))).select("_bucket").collect())

    def refresh(self, df: DataFrame, compute, stop_after: str | None = None) -> list[int]:
        """Bring the stored result up to date; returns the recomputed buckets.

        ``stop_after`` ('draft', 'data' or 'removal') breaks the run off at that step, for tests.
        """
        fs, path = self._fs()
        published = self._versions()
        draft, final = f"{self.location}/draft", f"{self.location}/fingerprints/{int(published[-1] if published else 0) + 1:012d}"
        prints = self.fingerprints(df)
        prints.coalesce(1).write.mode("overwrite").parquet(draft)
        todo = self.changed(self.spark.read.schema(prints.schema).parquet(draft))
        self._stop(stop_after, "draft")
        if todo:
            out = compute(df.where(self._bucket().isin(todo)))
            lost = F.raise_error(F.lit("compute moved a record out of the partitions that are recomputed")).cast("int")
            seen = Observation()
            out = out.withColumn("_bucket", F.when(self._bucket().isin(todo), self._bucket()).otherwise(lost))
            if not fs.exists(path(f"{self.location}/shape")):
                out.limit(0).write.mode("overwrite").parquet(f"{self.location}/shape")
            try:
                out.observe(seen, F.collect_set("_bucket").alias("b")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{self.location}/data")
            except Exception as e:
                if "compute moved a record" in str(e):
                    raise KeyChanged(f"compute must keep {self.key}") from e
                raise
            self._stop(stop_after, "data")
            for b in sorted(set(todo) - set(seen.get["b"])):
                fs.delete(path(f"{self.location}/data/_bucket={b}"), True)
        self._stop(stop_after, "removal")
        fs.mkdirs(path(f"{self.location}/fingerprints"))
        if not fs.rename(path(draft), path(final)):
            raise OSError(f"fingerprints were not published: {final}")
        for old in published[:-1]:
            fs.delete(path(f"{self.location}/fingerprints/{old}"), True)
        return todo

    @staticmethod
    def _stop(asked: str | None, step: str) -> None:
        if asked == step:
            raise RuntimeError(f"stopped after {step}")

    def read(self) -> DataFrame:
        fs, path = self._fs()
        shape = self.spark.read.parquet(f"{self.location}/shape")
        if not fs.exists(path(f"{self.location}/data")):
            return shape.drop("_bucket")
        return self.spark.read.schema(shape.schema).parquet(f"{self.location}/data").drop("_bucket")
