"""Queries of the training-text operators and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.docpairs import documented_functions
from loomspark.llm.handwritten import judge_files
from loomspark.llm.leak import leaked
from loomspark.llm.mixing import mix
from loomspark.llm.neighbours import close_pairs, nearest, usable
from loomspark.llm.pairs import together
from loomspark.llm.reading import fit, grades, level
from loomspark.llm.syntax import check_files, failure_rates
from loomspark.session import table


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources", "repo_path", "path", "modified_at", "content")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return documented_functions(_sources(spark, d)).select("repo_path", "path", "func_name", "func_line").distinct()


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Code and documentation of every documented function."""
    return documented_functions(_sources(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return judge_files(_sources(spark, d)).where("verdict <> ''").select("repo_path", "path")


def p2_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Files per repository, language and verdict."""
    v = judge_files(_sources(spark, d))
    return v.groupBy("repo_path", "language", F.when(F.col("verdict") == "", "hand-written").otherwise(F.col("verdict")).alias("verdict")).agg(F.count("*").alias("n_files"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return check_files(_sources(spark, d)).where("edit_cost > 0").select("repo_path", "path")


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of broken files per repository and language, with subtotals."""
    return failure_rates(check_files(_sources(spark, d)))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    commits = table(spark, d, "commits", "repo_path", "sha", "files_json")
    pairs = together(commits, max_items=50, min_count=6, min_lift=3.0)
    return pairs.select(F.col("g").alias("repo_path"), F.col("a").alias("path_a"), F.col("b").alias("path_b"))


def p5_odds(spark: SparkSession, d: str) -> DataFrame:
    """All pairs that change together, with counts, lift and odds ratio."""
    commits = table(spark, d, "commits", "repo_path", "sha", "files_json")
    p = together(commits, max_items=50)
    return p.select(F.col("g").alias("repo_path"), F.col("a").alias("path_a"), F.col("b").alias("path_b"), "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"), F.round("odds_ratio", 6).alias("odds_ratio"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text")).select("doc_id", "item_id")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return usable(table(spark, d, "chunk_embeddings", "repo_path", "node_id", "model_version", "vector", "created_at"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    p = close_pairs(_vectors(spark, d))
    return p.select(F.col("g").alias("repo_path"), F.col("v").alias("model_version"), F.col("a").alias("node_a"), F.col("b").alias("node_b"))


def p7_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar vectors of every vector."""
    n = nearest(_vectors(spark, d))
    return n.select(F.col("g").alias("repo_path"), F.col("v").alias("model_version"), F.col("node").alias("node_id"), F.col("other").alias("neighbour_id"), "rank", "similarity")


def _mix(spark: SparkSession, d: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    return mix(table(spark, d, "documents", "doc_id", "source", "text"), table(spark, d, "mix_targets", "source", "target_share", "max_repeats"), strict=strict)


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p9_strict_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of the largest mixture in which every source holds its share."""
    return _mix(spark, d, strict=True)[1]


def _graded(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents", "doc_id", "text", "source")
    return grades(documents, fit(documents, table(spark, d, "reading_ratings", "doc_id", "rating")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _graded(spark, d).where(F.col("english") & (level(F.col("grade")) == 4)).select("doc_id")


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    """Grade and level of every document; null where it has no English prose."""
    return _graded(spark, d).select("doc_id", "english", "prose_words", "grade", level(F.col("grade")).alias("level"))


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents per source and level."""
    g = _graded(spark, d).select("doc_id", level(F.col("grade")).alias("level"))
    s = table(spark, d, "documents", "doc_id", "source").select("doc_id", F.lower(F.trim("source")).alias("source"))
    return g.join(s, "doc_id").groupBy("source", "level").agg(F.count("*").alias("n_docs"))


QUERIES = {"p1_found": p1_found, "p1_pairs": p1_pairs, "p2_found": p2_found, "p2_verdicts": p2_verdicts, "p3_found": p3_found, "p3_rates": p3_rates, "p5_found": p5_found, "p5_odds": p5_odds, "p7_found": p7_found, "p7_neighbours": p7_neighbours, "p8_found": p8_found, "p10_found": p10_found, "p10_levels": p10_levels, "p10_profile": p10_profile, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_strict_shares": p9_strict_shares}

_P5 = """
WITH raw AS (SELECT repo_path g, sha, unnest(from_json(files_json, '["VARCHAR"]')) p FROM commits),
nm AS (SELECT DISTINCT g, sha, CASE WHEN q LIKE './%' THEN substr(q, 3) ELSE q END AS f FROM (SELECT g, sha, replace(p, '\\', '/') q FROM raw) WHERE trim(q) <> ''),
cnt AS (SELECT g, sha FROM nm GROUP BY 1, 2 HAVING count(*) <= 50),
ok AS (SELECT nm.g, nm.sha, nm.f FROM nm JOIN cnt USING (g, sha)),
tot AS (SELECT g, count(*) n FROM cnt GROUP BY 1),
one AS (SELECT g, f, count(*) nk FROM ok GROUP BY 1, 2),
two AS (SELECT x.g, x.f a, y.f b, count(*) n_ab FROM ok x JOIN ok y ON x.g = y.g AND x.sha = y.sha AND x.f < y.f GROUP BY 1, 2, 3),
j AS (SELECT two.*, p.nk n_a, q.nk n_b, tot.n FROM two JOIN one p ON p.g = two.g AND p.f = a JOIN one q ON q.g = two.g AND q.f = b JOIN tot ON tot.g = two.g)
"""

ORACLE = {
    "p5_found": _P5 + "SELECT g AS repo_path, a AS path_a, b AS path_b FROM j WHERE n_ab >= 6 AND n_ab * n >= 3 * n_a * n_b",
    "p5_odds": _P5
    + """SELECT g AS repo_path, a AS path_a, b AS path_b, n_ab, n_a, n_b, n, round(n_ab::DOUBLE * n / (n_a * n_b), 6) AS lift,
    round((n_ab + 0.5) * (n - n_a - n_b + n_ab + 0.5) / ((n_a - n_ab + 0.5) * (n_b - n_ab + 0.5)), 6) AS odds_ratio FROM j""",
}
