"""Keeping stored tables: replacing and emptying a repository, keyed saves, refreshed figures, configuration,
outside providers with a cache, and folders nobody owns.

Defined results: null keys are never stored; saving the same rows again changes nothing; a provider's
failure leaves the row without a result and is not cached.
"""

from __future__ import annotations

import json
import tomllib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators.scans import latest, upsert
from loomspark.session import materialize

#: Characters of a text that a provider receives.
PROVIDER_CHARS = 8000


def _fs(spark: SparkSession, location: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def replace_repositories(rows: DataFrame, location: str) -> None:
    """Replace the stored rows of every repository that has rows; others stay. One folder a repository."""
    rows.where("repo_path IS NOT NULL").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_path").parquet(location)


def reset_repository(spark: SparkSession, location: str, repo: str) -> bool:
    """Delete a repository's stored rows; tells whether there were any."""
    fs, path = _fs(spark, location)
    quoted = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(repo)
    return bool(fs.delete(path(f"{location}/repo_path={quoted}"), True))


def save(rows: DataFrame, location: str, keys: list[str], order: list[str]) -> DataFrame:
    """Keyed save: new rows replace stored ones of their key; of several new rows of a key the greatest order
    stands. The table is written to a new version beside the old one and read from the last whole one."""
    spark = rows.sparkSession
    fs, path = _fs(spark, location)
    new = latest(rows, keys, order)
    old = stored(spark, location)
    out = new if old is None else upsert(old, new, keys)
    number = 1 + max([int(v) for v in _versions(fs, path, location)], default=0)
    out.write.parquet(f"{location}/{number:012d}")
    for v in _versions(fs, path, location)[:-2]:
        fs.delete(path(f"{location}/{v}"), True)
    return stored(spark, location)


def _versions(fs, path, location: str) -> list[str]:
    if not fs.exists(path(location)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path(location))]
    return sorted(n for n in names if n.isdigit() and fs.exists(path(f"{location}/{n}/_SUCCESS")))


def stored(spark: SparkSession, location: str) -> DataFrame | None:
    """The last whole version of a saved table; None where nothing was saved."""
    fs, path = _fs(spark, location)
    versions = _versions(fs, path, location)
    return spark.read.parquet(f"{location}/{versions[-1]}") if versions else None


def changed_figures(old: DataFrame, new: DataFrame, keys: list[str], figure: str) -> DataFrame:
    """Rows of ``new`` whose figure differs from the stored one, or that are not stored yet."""
    o = old.select(*keys, F.col(figure).alias("_old"), F.lit(True).alias("_known"))
    j = new.join(o, keys, "left")
    return j.where(F.col("_known").isNull() | ~F.col("_old").eqNullSafe(F.col(figure))).select(*keys, figure, F.col("_old").alias("stored"))


def set_changed(old: DataFrame, new: DataFrame, group: str, member: str) -> DataFrame:
    """(group, n_gone, n_new, changed): whether two sets of members differ, per group of either side."""
    o = old.select(group, member).where(F.col(member).isNotNull()).distinct().withColumn("_o", F.lit(1))
    n = new.select(group, member).where(F.col(member).isNotNull()).distinct().withColumn("_n", F.lit(1))
    g = o.join(n, [group, member], "full_outer").groupBy(group).agg(F.count_if(F.col("_n").isNull()).alias("n_gone"), F.count_if(F.col("_o").isNull()).alias("n_new"))
    return g.withColumn("changed", (F.col("n_gone") > 0) | (F.col("n_new") > 0))


def load_config(text: str | None) -> dict:
    """Settings of a repository from TOML text; defaults where there is none, an error on a wrong type."""
    out = {"connect_functions": ["connect"], "noise_identifiers": [], "skip_dirs": [], "synonyms": {}}
    if not text:
        return out
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ValueError(f"malformed configuration: {e}") from e
    where = {"connect_functions": "parsing", "noise_identifiers": "parsing", "skip_dirs": "ingest", "synonyms": "query"}
    for key, section in where.items():
        part = data.get(section, {})
        if not isinstance(part, dict):
            raise ValueError(f"'{section}' must be a table")
        value = part.get(key, out[key])
        lists = value.values() if isinstance(value, dict) else [value]
        if isinstance(value, dict) != (key == "synonyms") or not all(isinstance(v, list) and all(isinstance(x, str) for x in v) for v in lists):
            raise ValueError(f"'{key}' must hold lists of strings")
        out[key] = value
    return out


Provider = Callable[[list[str]], list[str]]


def provide(texts: DataFrame, provider: Provider, name: str, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, additions to the cache): a provider's JSON answer for every text (key, text).

    Texts are known by their hash; what the cache (hash, provider, answer) holds is not asked again,
    equal texts are asked once, and the provider gets batches. An answer that is no JSON object counts
    as an empty one; a batch that fails stays without answers.
    """
    t = texts.where("key IS NOT NULL AND text IS NOT NULL").select("key", F.sha2("text", 256).alias("hash"), F.substring("text", 1, PROVIDER_CHARS).alias("_text"))
    schema = "hash string, provider string, answer string"
    known = texts.sparkSession.createDataFrame([], schema) if cache is None else cache.where(F.col("provider") == name).select("hash", "provider", "answer")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            try:
                got = provider(list(f["_text"]))
            except Exception:  # noqa: BLE001 - whatever a provider raises, the other rows go on
                continue
            rows = []
            for h, a in zip(f["hash"], got):
                try:
                    ok = isinstance(json.loads(a), dict)
                except (TypeError, ValueError):
                    ok = False
                rows.append((h, name, a if ok else "{}"))
            yield pd.DataFrame(rows, columns=["hash", "provider", "answer"])

    asked = t.join(known.select("hash").distinct(), "hash", "left_anti").dropDuplicates(["hash"]).select("hash", "_text")
    new = materialize(asked.mapInPandas(run, schema))
    answers = known.unionByName(new).dropDuplicates(["hash"])
    return t.join(answers.select("hash", "answer"), "hash", "left").select("key", "answer"), new


def unowned_folders(folders: DataFrame, owners: DataFrame, seen: DataFrame) -> DataFrame:
    """(folder, state): active where an owner uses the folder, orphaned where its owner is known and gone,
    unknown where nothing says whose it was. ``owners`` has folder, repo_path; ``seen`` has repo_path."""
    alive = seen.select("repo_path", F.lit(True).alias("_alive")).distinct()
    o = owners.join(alive, "repo_path", "left").groupBy("folder").agg(F.max(F.coalesce("_alive", F.lit(False))).alias("_alive"))
    state = F.when(F.col("_alive").isNull(), "unknown").when(F.col("_alive"), "active").otherwise("orphaned")
    return folders.select("folder").distinct().join(o, "folder", "left").select("folder", state.alias("state"))


def delete_folders(spark: SparkSession, folders: DataFrame) -> int:
    """Delete the folders of a listing, which is one row a repository; returns how many were there."""
    n = 0
    for r in folders.select("folder").toLocalIterator():
        fs, path = _fs(spark, r["folder"])
        n += bool(fs.delete(path(r["folder"]), True))
    return n
