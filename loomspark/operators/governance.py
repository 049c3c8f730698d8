"""Diff risk, unused symbols, references and the usage ledger.

Defined results: missing figures count as 0; null keys are skipped; repeated rows count once where
keys identify them; empty tables give no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions import text as X

# Weights and scales of the risk components.
RISK = {"diff": (0.30, 100.0), "hotspot": (0.20, 1000.0), "fan_in": (0.15, 10.0), "cochange": (0.15, 1.0), "directives": (0.20, 3.0)}
#: Partners above this weight are expected to change together.
PARTNER_WEIGHT = 0.5


def missing_partners(changed: DataFrame, pairs: DataFrame) -> DataFrame:
    """(repo_path, path, partner, weight): strong co-change partners of changed files that did not change.

    ``changed`` has repo_path, change_id, path; a partner must have changed under the same id.
    """
    both = pairs.where(F.col("weight") > PARTNER_WEIGHT).select("repo_path", F.col("a").alias("path"), F.col("b").alias("partner"), "weight")
    both = both.unionByName(both.select("repo_path", F.col("partner").alias("path"), F.col("path").alias("partner"), "weight"))
    j = changed.select("repo_path", "change_id", "path").distinct().join(both, ["repo_path", "path"])
    return j.join(changed.select("repo_path", "change_id", F.col("path").alias("partner")).distinct(), ["repo_path", "change_id", "partner"], "left_anti")


def test_directives(changed: DataFrame, sources: DataFrame) -> DataFrame:
    """(repo_path, change_id, path, directives): for changed sources, the tests of their name that did not change with them."""
    p = sources.select("repo_path", "path", X.test_base(F.col("path")).alias("base"), X.is_test_path(F.col("path")).alias("t"))
    pairs = p.where("NOT t").drop("t").join(p.where("t").select("repo_path", "base", F.col("path").alias("test")), ["repo_path", "base"]).select("repo_path", "path", "test")
    c = changed.select("repo_path", "change_id", "path").distinct()
    j = c.join(pairs, ["repo_path", "path"]).join(c.withColumnRenamed("path", "test"), ["repo_path", "change_id", "test"], "left_anti")
    return j.groupBy("repo_path", "change_id", "path").agg(F.countDistinct("test").alias("directives"))


def risk_scores(changed: DataFrame, spots: DataFrame, fan: DataFrame, missing: DataFrame) -> DataFrame:
    """Risk from 0 to 10 of every changed file: changed has repo_path, change_id, path, diff, directives."""
    m = missing.groupBy("repo_path", "change_id", "path").agg(F.max("weight").alias("cochange"))
    c = changed.join(spots.select("repo_path", "path", F.col("score").alias("hotspot")), ["repo_path", "path"], "left").join(fan, ["repo_path", "path"], "left").join(m, ["repo_path", "change_id", "path"], "left")
    total = F.lit(0.0)
    for name, (weight, scale) in RISK.items():
        total = total + weight * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col(name), F.lit(0)) / scale))
    return c.select("repo_path", "change_id", "path", F.round(total * 10, 2).alias("risk"))


def unused_symbols(nodes: DataFrame, edges: DataFrame, lines_with: DataFrame | None = None) -> DataFrame:
    """(repo_path, node_id, label, source_ref): functions and classes no credited edge leads to, by id or
    by name, outside tests, entry points and names with double underscores."""
    # Relations that credit a symbol.
    credit = ["calls", "imports", "inherits", "references", "reads", "writes", "aliases", "exports"]
    s = nodes.where("granularity = 'symbol' AND kind IN ('func', 'class')").where(~X.is_test_path(F.col("source_ref")))
    entry = F.col("label").isin("main", "__main__") | (X.file_name(F.lower("source_ref")) == "__main__.py") | (F.col("label").startswith("__") & F.col("label").endswith("__"))
    s = s.where(~F.coalesce(entry, F.lit(False)))
    e = edges.where(F.col("relation").isin(credit)).select("repo_path", "target").distinct()
    s = s.join(e.withColumnRenamed("target", "node_id"), ["repo_path", "node_id"], "left_anti")
    by_name = e.where("target LIKE 'name:%'").select("repo_path", F.expr("substring(target, 6)").alias("label")).distinct()
    return s.join(by_name, ["repo_path", "label"], "left_anti").select("repo_path", "node_id", "label", "source_ref")


def unused_tiers(unused: DataFrame, sources: DataFrame) -> DataFrame:
    """Confidence that an unused symbol is dead: high where no other file holds its name, medium where
    only documents do, else low. (repo_path, node_id, label, source_ref, tier)

    Files are reduced to their distinct words before the join, so no line meets every symbol.
    """
    words = F.array_distinct(F.regexp_extract_all("content", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))
    w = sources.where("content IS NOT NULL").select("repo_path", "path", (X.suffix_bucket(F.col("path")) == "doc").alias("doc"), F.explode(words).alias("label"))
    names = unused.select("repo_path", "label").distinct()
    w = w.join(names, ["repo_path", "label"], "left_semi")
    # counted per name first; a symbol's own file is taken off, so a common name never meets all its files
    total = w.groupBy("repo_path", "label").agg(F.count_if(~F.col("doc")).alias("_code"), F.count_if("doc").alias("_docs"))
    own = w.select("repo_path", "label", F.col("path").alias("source_ref"), F.col("doc").alias("_own_doc"))
    j = unused.join(total, ["repo_path", "label"], "left").join(own, ["repo_path", "label", "source_ref"], "left").fillna(0, ["_code", "_docs"])
    code = F.col("_code") - F.coalesce((~F.col("_own_doc")).cast("int"), F.lit(0))
    docs = F.col("_docs") - F.coalesce(F.col("_own_doc").cast("int"), F.lit(0))
    return j.select("repo_path", "node_id", "label", "source_ref", F.when((code == 0) & (docs == 0), "high").when(code == 0, "medium").otherwise("low").alias("tier"))


def mentions(sources: DataFrame, symbol: str) -> DataFrame:
    """(repo_path, path, line, bucket, access): lines that hold the symbol as a whole word."""
    pattern = r"\b" + re.escape(symbol) + r"\b"
    hit = sources.where(F.col("content").contains(symbol)).select("repo_path", "path", F.posexplode(X.lines(F.col("content"))).alias("n", "text")).where(F.col("text").rlike(pattern))
    return hit.select("repo_path", "path", (F.col("n") + 1).cast("long").alias("line"), X.suffix_bucket(F.col("path")).alias("bucket"), X.line_access(symbol, F.col("text")).alias("access"))


def usage_rollup(events: DataFrame, at: str, tool: str, response: str, baseline: str) -> DataFrame:
    """Calls, tokens and savings in total, by UTC day and by tool, in one pass of grouping sets."""
    e = events.select(F.date_format(F.col(at), "yyyy-MM-dd").alias("day"), F.col(tool).alias("tool"), F.col(response).alias("_r"), F.col(baseline).alias("_b"))
    g = e.groupingSets([[], [F.col("day")], [F.col("tool")]], F.col("day"), F.col("tool"))
    out = g.agg(F.count("*").alias("calls"), F.coalesce(F.sum("_r"), F.lit(0)).alias("response"), F.coalesce(F.sum("_b"), F.lit(0)).alias("baseline"), F.grouping_id().alias("_g"))
    saved = F.col("baseline") - F.col("response")
    return out.select("day", "tool", "calls", F.round("response", 4).alias("response"), F.round("baseline", 4).alias("baseline"), F.round(saved, 4).alias("saved"), F.when(F.col("baseline") > 0, F.round(100.0 * saved / F.col("baseline"), 1)).otherwise(F.lit(0.0)).alias("saved_pct"))


def retrieval_metrics(selected: DataFrame, expected: DataFrame) -> DataFrame:
    """Per task: precision, precision of the first three (always of three) and recall.

    ``selected`` has task, id, rank; ``expected`` has task, id. Nothing selected gives 0, or 1 where
    nothing was expected.
    """
    s = selected.select("task", "id", "rank").distinct()
    x = expected.select("task", "id").distinct().withColumn("wanted", F.lit(1))
    j = s.join(x, ["task", "id"], "full_outer")
    a = j.groupBy("task").agg(F.count("rank").alias("n"), F.count("wanted").alias("m"), F.count_if(F.col("rank").isNotNull() & F.col("wanted").isNotNull()).alias("hit"), F.count_if((F.col("rank") <= 3) & F.col("wanted").isNotNull()).alias("top"))
    return a.select("task", F.when(F.col("n") > 0, F.col("hit") / F.col("n")).otherwise(F.when(F.col("m") == 0, 1.0).otherwise(0.0)).alias("precision"), (F.col("top") / 3).alias("p_at_3"), F.when(F.col("m") > 0, F.col("hit") / F.col("m")).otherwise(1.0).alias("recall"))
