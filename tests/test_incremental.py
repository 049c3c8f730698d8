import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomspark.operators.incremental import IncrementalTable, KeyChanged, due_files, logged_states, partition_fingerprints

SRC = "repo_path string, path string, modified_at double, content string, op string"
RUN = "repo_path string, run_id string, started_at timestamp_ntz, status string"
LOG = "repo_path string, run_id string, path string, recorded_at timestamp_ntz, op string, content_hash string"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def t(day):
    return datetime(2024, 1, day)


def test_due_files_cases(spark):
    src = [
        ("r", "same", 1.0, "x", ""), ("r", "same", 1.0, "x", ""), ("r", "changed", 2.0, "new", ""), ("r", "changed", 1.0, "old", ""), ("r", "unseen", 1.0, "u", ""),
        ("r", "deleted", 1.0, "d", ""), ("r", "failed", 1.0, "f", ""), ("r", "nohash", 1.0, "n", ""), ("r", "empty", 1.0, "", ""), ("r", "null", 1.0, None, ""), (None, "x", 1.0, "x", ""), ("r", None, 1.0, "x", ""),
    ]
    runs = [("r", "z1", t(1), "ok"), ("r", "a2", t(2), "ok"), ("r", "f3", t(3), "failed"), ("r", "n4", None, "running")]
    log = [
        ("r", "z1", "same", t(1), "upsert", "stale"), ("r", "a2", "same", t(2), "upsert", sha("x")), ("r", "a2", "same", t(2), "upsert", sha("x")), ("r", "a2", "changed", t(2), "upsert", sha("old")),
        ("r", "z1", "deleted", t(1), "upsert", sha("d")), ("r", "a2", "deleted", t(2), "delete", ""), ("r", "f3", "failed", t(3), "upsert", sha("f")), ("r", "a2", "nohash", t(2), "upsert", ""),
        ("r", "a2", "empty", t(2), "upsert", sha("")), ("r", "a2", "gone", t(2), "upsert", sha("g")), ("r", "a2", "null", t(2), "upsert", sha("")), ("r", None, "same", t(9), "delete", None),
    ]
    got = {r.path for r in due_files(spark.createDataFrame(src, SRC), spark.createDataFrame(runs, RUN), spark.createDataFrame(log, LOG)).collect()}
    assert got == {"changed", "unseen", "deleted", "failed", "nohash", "null"}
    none = spark.createDataFrame([], LOG)
    assert due_files(spark.createDataFrame(src, SRC), spark.createDataFrame([], RUN), none).count() == 8
    assert due_files(spark.createDataFrame([], SRC), spark.createDataFrame(runs, RUN), spark.createDataFrame(log, LOG)).count() == 0


def test_incremental_table_survives_failure(spark, tmp_path):
    rows = [(i, f"v{i}") for i in range(200)]
    table = IncrementalTable(spark, f"file://{tmp_path}/t", ["k"], ["v"], 16)
    compute = lambda df: df.withColumn("n", F.length("v"))
    frame = lambda r: spark.createDataFrame(r, "k int, v string")
    assert len(table.refresh(frame(rows), compute)) == 16
    assert table.refresh(frame(list(reversed(rows))), compute) == []
    rows[7] = (7, "longer value")
    with pytest.raises(RuntimeError):
        table.refresh(frame(rows), compute, stop_after="removal")
    assert len(table.refresh(frame(rows), compute)) == 1  # repeated, as the run before did not finish
    assert {(r.k, r.v, r.n) for r in table.read().collect()} == {(k, v, len(v)) for k, v in rows}
    rows = rows[:20]
    table.refresh(frame(rows), compute)
    assert {(r.k, r.v) for r in table.read().collect()} == set(rows)


def _table(spark, at):
    return IncrementalTable(spark, f"file://{at}/t", ["k"], ["v"], 8)


def _frame(spark, rows):
    return spark.createDataFrame(rows, "k int, v string")


def test_emptied_buckets_leave_nothing(spark, tmp_path):
    table, rows = _table(spark, tmp_path), [(i, "a") for i in range(40)]
    keep = lambda df: df.where("v = 'a'")
    table.refresh(_frame(spark, rows), keep)
    assert table.read().count() == 40
    table.refresh(_frame(spark, [(i, "b") for i in range(40)]), keep)  # input is there, output is not
    assert table.read().count() == 0
    table.refresh(_frame(spark, rows), keep)
    assert table.read().count() == 40
    table.refresh(_frame(spark, []), keep)
    assert table.read().count() == 0


def test_first_refresh_without_output_reads_empty(spark, tmp_path):
    table = _table(spark, tmp_path)
    table.refresh(_frame(spark, [(1, "a"), (None, None)]), lambda df: df.where("false"))
    assert table.read().collect() == []


def test_a_late_record_is_processed_by_the_next_run(spark, tmp_path):
    table, at = _table(spark, tmp_path), f"file://{tmp_path}/in"
    _frame(spark, [(1, "a"), (2, "a")]).write.parquet(at)
    lands = []

    def compute(df):
        if not lands:  # a record lands after the fingerprints were taken
            lands.append(1)
            _frame(spark, [(3, "a")]).write.mode("append").parquet(at)
        return df

    table.refresh(spark.read.parquet(at), compute)
    table.refresh(spark.read.parquet(at), compute)
    assert {r.k for r in table.read().collect()} == {1, 2, 3}


def test_a_key_change_is_refused_before_anything_is_replaced(spark, tmp_path):
    table, rows = _table(spark, tmp_path), [(i, "a") for i in range(40)]
    table.refresh(_frame(spark, rows), lambda df: df)
    rows[5] = (5, "new")
    with pytest.raises(KeyChanged):
        table.refresh(_frame(spark, rows), lambda df: df.withColumn("k", F.col("k") + 1))
    assert {(r.k, r.v) for r in table.read().collect()} == {(i, "a") for i in range(40)}


@pytest.mark.parametrize("step", ["draft", "data", "removal"])
def test_a_crash_at_any_step_is_repeated(spark, tmp_path, step):
    table, rows = _table(spark, tmp_path), [(i, "a") for i in range(40)]
    keep = lambda df: df.where("v <> 'drop'")
    table.refresh(_frame(spark, rows), keep)
    rows[3], rows[9] = (3, "drop"), (9, None)
    with pytest.raises(RuntimeError):
        table.refresh(_frame(spark, rows), keep, stop_after=step)
    assert table.refresh(_frame(spark, rows), keep)
    assert {(r.k, r.v) for r in table.read().collect()} == {(i, "a") for i in range(40)} - {(3, "a"), (9, "a")}
    assert table.refresh(_frame(spark, rows), keep) == []


def test_stored_fingerprints_rule_partitions_out(spark):
    src = [("r", f"p{i}", 1.0, "x", "") for i in range(30)]
    runs = spark.createDataFrame([("r", "a", t(1), "ok")], RUN)
    log = spark.createDataFrame([("r", "a", f"p{i}", t(1), "upsert", sha("x")) for i in range(30)], LOG)
    recorded = partition_fingerprints(logged_states(runs, log, 16))
    assert due_files(spark.createDataFrame(src, SRC), runs, log, 16, recorded).count() == 0
    src[4] = ("r", "p4", 2.0, "y", "")
    assert [r.path for r in due_files(spark.createDataFrame(src, SRC), runs, log, 16, recorded).collect()] == ["p4"]
