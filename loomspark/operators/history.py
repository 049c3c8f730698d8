"""What the commit log tells: churn, files that change together, hotspots, complexity.

Defined results: a commit delivered several times counts once (its lists are joined); null or
malformed file lists count as empty; blank paths are dropped; empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions import text as X

#: Commits with more files are left out of co-change.
MOST_FILES = 50
# Words that branch, by language.
BRANCH_WORDS = {
    "python": "if elif for while except and or".split(),
    "cpp": "if for while switch case catch".split(),
    "qml": "if for while switch case".split(),
    "generic": "if for while switch case catch".split(),
}


def commit_files(commits: DataFrame) -> DataFrame:
    """(repo_path, sha, path): distinct normalised paths of every commit."""
    raw = commits.where("repo_path IS NOT NULL AND sha IS NOT NULL").select("repo_path", "sha", F.explode(F.from_json("files_json", "array<string>")).alias("p"))
    return raw.select("repo_path", "sha", X.normalized_path(F.col("p")).alias("path")).where("path IS NOT NULL AND trim(path) <> ''").distinct()


def churn(commits: DataFrame) -> DataFrame:
    """Commits per file."""
    return commit_files(commits).groupBy("repo_path", "path").agg(F.count("*").alias("churn"))


def cochange(commits: DataFrame, most_files: int = MOST_FILES) -> DataFrame:
    """(repo_path, a, b, n, weight): pairs of a repository's files with weight n / its greatest n.

    A commit's own pairs are made inside its row, from at most ``most_files`` paths, and counted
    map-side before the shuffle by pair.
    """
    lists = commit_files(commits).groupBy("repo_path", "sha").agg(F.array_sort(F.collect_set("path")).alias("fs")).where((F.size("fs") > 1) & (F.size("fs") <= most_files))
    heads = lists.select("repo_path", F.posexplode("fs").alias("i", "a"), "fs")
    pairs = heads.select("repo_path", "a", F.explode(F.slice("fs", F.col("i") + 2, F.size("fs"))).alias("b"))
    n = pairs.groupBy("repo_path", "a", "b").agg(F.count("*").alias("n"))
    top = n.groupBy("repo_path").agg(F.max("n").alias("top"))
    return n.join(top, "repo_path").withColumn("weight", F.col("n") / F.col("top")).drop("top")


def touches(commits: DataFrame, sources: DataFrame) -> DataFrame:
    """(repo_path, sha, path) for paths that exist."""
    return commit_files(commits).join(sources.select("repo_path", "path").distinct(), ["repo_path", "path"], "left_semi")


# One scan of a text: comments become a blank, strings their opening or closing quote.
_PLAIN = "\"(?:[^\"\\\\\\n]|\\\\.)*(\")|'(?:[^'\\\\\\n]|\\\\.)*(')"
_TRIPLE = "\"\"\"(?s:.*?)\"\"(\")|'''(?s:.*?)''(')"
MASK_PYTHON = f"{_TRIPLE}|#[^\\n]*|{_PLAIN}"
MASK_OTHER = f"{_TRIPLE}|/\\*(?s:.*?)\\*/|//[^\\n]*|{_PLAIN}|`(?:[^`\\\\]|\\\\.)*(`)"
# Bindings and handlers of declarative files: a name, a colon and something after it.
_NAMED = r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*"
_FOLLOWED = r"[ \t]*:[ \t]*\S"
BINDING = rf"(?m)^[ \t]*(?:{_NAMED}|property\b[^:\n]*){_FOLLOWED}"
# Names before a colon that are labels and no bindings.
_LABELS = ["case", "default", "else"]
NO_BINDING = rf"(?m)^[ \t]*(?:{'|'.join(_LABELS)}){_FOLLOWED}"


def complexity(sources: DataFrame) -> DataFrame:
    """(repo_path, path, branches, complexity): branching words, operators and (in declarative and
    script files) bindings per thousand lines, at least 1 where there is any."""
    low = F.lower(X.suffix(F.col("path")))
    lang = F.when(low == ".py", "python").when(low.isin(".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx"), "cpp").when(low.isin(".qml", ".js", ".jsx", ".ts", ".tsx"), "qml").otherwise("generic")
    code = F.when(lang == "python", F.regexp_replace("content", MASK_PYTHON, " $1$2$3$4")).otherwise(F.regexp_replace("content", MASK_OTHER, " $1$2$3$4$5"))
    c = sources.where("content IS NOT NULL").select("repo_path", "path", lang.alias("lang"), F.size(X.lines(F.col("content"))).alias("n_lines"), code.alias("code"))
    words = F.lit(0)
    for name, ws in BRANCH_WORDS.items():
        words = F.when(F.col("lang") == name, F.regexp_count("code", F.lit(r"\b(?:" + "|".join(ws) + r")\b"))).otherwise(words)
    ops = F.when(F.col("lang").isin("cpp", "qml"), F.regexp_count("code", F.lit("&&")) + F.regexp_count("code", F.lit(r"\|\|")) + F.regexp_count("code", F.lit(r"\?")) - F.regexp_count("code", F.lit(r"\?="))).otherwise(0)
    binds = F.when(F.col("lang") == "qml", F.regexp_count("code", F.lit(BINDING)) - F.regexp_count("code", F.lit(NO_BINDING))).otherwise(0)
    c = c.withColumn("branches", (words + ops + binds).cast("long"))
    per = F.when(F.col("branches") <= 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.bround(F.col("branches") * 1000 / F.greatest(F.lit(1), F.col("n_lines"))).cast("long")))
    return c.select("repo_path", "path", "branches", per.cast("long").alias("complexity"))


def hotspots(sources: DataFrame, commits: DataFrame) -> DataFrame:
    """churn x complexity of every file; files without commits or branches score 0."""
    c = complexity(sources).join(churn(commits), ["repo_path", "path"], "left").fillna(0, ["churn"])
    return c.select("repo_path", "path", "churn", "complexity", (F.col("churn") * F.col("complexity")).alias("score"))


def top_hotspots(spots: DataFrame, k: int = 10) -> DataFrame:
    w = Window.partitionBy("repo_path").orderBy(F.desc("score"), F.desc("churn"), F.desc("complexity"), "path")
    return spots.where("score > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
