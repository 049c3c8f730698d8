"""Texts made from source files and the spans of their symbols: numbered bodies, skeletons, chunks,
neighbourhoods of lines, and where and how a name is used.

Defined results: spans that are null, begin before line 1 or end before they begin are skipped; lines
past a file's end are left out; null contents are skipped; repeated symbols count once.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions import text as X

#: Lines of a symbol's body in its chunk.
EXCERPT = 12


def file_lines(sources: DataFrame) -> DataFrame:
    """(repo_path, path, ls) with the lines as an array."""
    return sources.where("content IS NOT NULL").select("repo_path", "path", X.lines(F.col("content")).alias("ls"))


def spanned(nodes: DataFrame) -> DataFrame:
    """Symbols with a usable span, by the file they are in."""
    n = nodes.where("granularity = 'symbol' AND span_start >= 1 AND span_end >= span_start")
    return n.select("repo_path", F.col("source_ref").alias("path"), "node_id", "label", "kind", "signature", "span_start", "span_end").distinct()


def numbered_bodies(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """(repo_path, node_id, body): a symbol's lines, each with its number before it."""
    j = spanned(nodes).join(file_lines(sources), ["repo_path", "path"]).withColumn("part", F.slice("ls", F.col("span_start"), F.col("span_end") - F.col("span_start") + 1))
    body = F.transform("part", lambda x, i: F.concat((i + F.col("span_start")).cast("string"), F.lit(": "), x))
    return j.select("repo_path", "node_id", F.array_join(body, "\n").alias("body"))


def skeletons(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """(repo_path, path, skeleton, n_lines): import lines outside spans and the first line of every
    symbol, in the file's order; where a body follows, a line with '...' stands for it.

    A file's lines stay in its row; only its symbols' spans are brought to it.
    """
    spans = spanned(nodes).groupBy("repo_path", "path").agg(F.array_sort(F.collect_set(F.struct("span_start", "span_end"))).alias("spans"))
    j = file_lines(sources).join(spans, ["repo_path", "path"])
    starts = F.transform("spans", lambda x: x["span_start"])
    def piece(line: Column, i: Column) -> Column:
        n = i + 1
        first = F.array_contains(starts, n)
        inside = F.exists("spans", lambda x: (x["span_start"] <= n) & (n <= x["span_end"]))
        more = F.exists("spans", lambda x: (x["span_start"] == n) & (x["span_end"] > n))
        gap = F.concat(F.regexp_extract(line, r"^([ \t]*)", 1), F.lit("    ..."))
        return F.when(first & more, F.array(line, gap)).when(first | (~inside & X.is_import_line(line)), F.array(line)).otherwise(F.array().cast("array<string>"))
    out = F.flatten(F.transform("ls", piece))
    return j.select("repo_path", "path", F.array_join(out, "\n").alias("skeleton"), F.size(out).cast("long").alias("n_lines"))


def chunk_texts(nodes: DataFrame, sources: DataFrame, excerpt: int = EXCERPT) -> DataFrame:
    """(repo_path, node_id, path, chunk): what stands for a symbol in a vector index: its signature, the
    comment lines directly above it, and the first lines of its body (with its docstring, if any)."""
    j = spanned(nodes).join(file_lines(sources), ["repo_path", "path"]).where("span_start <= size(ls)")
    above = F.expr("slice(ls, 1, span_start - 1)")
    other = F.array_max(F.transform(F.filter(F.transform(above, lambda x, i: F.struct((i + 1).alias("n"), X.is_comment_line(x).alias("c"))), lambda x: ~x["c"]), lambda x: x["n"]))
    j = j.withColumn("_from", F.coalesce(other, F.lit(0)) + 1)
    notes = F.expr("slice(ls, _from, span_start - _from)")
    body = F.slice("ls", F.col("span_start"), F.least(F.lit(excerpt), F.col("span_end") - F.col("span_start") + 1))
    head = F.when(F.coalesce(F.col("signature"), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array("signature"))
    return j.select("repo_path", "node_id", "path", F.array_join(F.concat(head, notes, body), "\n").alias("chunk"))


def near_markers(nodes: DataFrame, sources: DataFrame, pattern: str, reach: int = 20) -> DataFrame:
    """(repo_path, node_id, n_lines, first_line): symbols with lines that match a pattern within ``reach`` lines of their span.

    A range join of symbols and lines inside a file: matching lines are found first and stay one
    array a file, so no symbol meets lines that do not match.
    """
    at = F.filter(F.transform("ls", lambda x, i: F.when(x.rlike(pattern), i + 1)), lambda x: x.isNotNull())
    marked = file_lines(sources).select("repo_path", "path", at.alias("at")).where("size(at) > 0")
    j = spanned(nodes).join(marked, ["repo_path", "path"]).withColumn("near", F.filter("at", lambda n: (n >= F.col("span_start") - reach) & (n <= F.col("span_end") + reach)))
    return j.where("size(near) > 0").select("repo_path", "node_id", F.size("near").cast("long").alias("n_lines"), F.array_min("near").cast("long").alias("first_line"))


def is_remark(path: Column, line: Column) -> Column:
    """Whether a hit on a line is documentation or a comment and not use."""
    stripped = F.trim(line)
    # What begins a comment line, and what begins a comment behind code.
    begins = stripped.rlike(r"^(?:#|//|/\*|\*|<!--)")
    behind = F.lit(False)
    for mark in (" #", " //", " /*", " <!--"):
        behind = behind | stripped.contains(mark)
    return F.lower(X.suffix(path)).isin(".md", ".rst", ".txt") | begins | behind


def usage_tiers(unused: DataFrame, nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """(repo_path, node_id, label, source_ref, code_hits, remark_hits, tier): unused symbols by the lines that
    hold their name outside their own span.

    Every file gives each word once a line with the line's kind; the counts per (label, kind) are made
    before they meet the symbols, and the own span's hits are taken off, so a common name never meets
    all lines of all its files.
    """
    names = unused.select("repo_path", "label").where("label IS NOT NULL").distinct()
    lines = file_lines(sources).select("repo_path", "path", F.posexplode("ls").alias("i", "line"))
    words = F.array_distinct(F.regexp_extract_all("line", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))
    hits = lines.select("repo_path", "path", (F.col("i") + 1).alias("n"), is_remark(F.col("path"), F.col("line")).alias("remark"), F.explode(words).alias("label"))
    hits = hits.join(names, ["repo_path", "label"], "left_semi")
    total = hits.groupBy("repo_path", "label").agg(F.count_if(~F.col("remark")).alias("_code"), F.count_if("remark").alias("_remark"))
    spans = nodes.select("repo_path", "node_id", "span_start", "span_end")
    u = unused.join(spans, ["repo_path", "node_id"], "left")
    own = u.join(hits.withColumnRenamed("path", "source_ref"), ["repo_path", "source_ref", "label"]).where("n BETWEEN span_start AND coalesce(span_end, span_start)")
    own = own.groupBy("repo_path", "node_id").agg(F.count_if(~F.col("remark")).alias("_own_code"), F.count_if("remark").alias("_own_remark"))
    j = unused.join(total, ["repo_path", "label"], "left").join(own, ["repo_path", "node_id"], "left").fillna(0, ["_code", "_remark", "_own_code", "_own_remark"])
    code, remark = F.col("_code") - F.col("_own_code"), F.col("_remark") - F.col("_own_remark")
    tier = F.when(F.lower(X.suffix(F.col("source_ref"))) != ".py", "low").when((code == 0) & (remark == 0), "high").when(code == 0, "medium").otherwise("low")
    return j.select("repo_path", "node_id", "label", "source_ref", code.alias("code_hits"), remark.alias("remark_hits"), tier.alias("tier"))


def python_exposure(sources: DataFrame) -> DataFrame:
    """(repo_path, path, what, name, line): decorated functions and classes of Python files, and the names a
    package hands on from its __init__ file. Files that do not parse give no rows."""

    def found(path: str, text: str) -> Iterator[tuple]:
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return
        package = path.rsplit("/", 1)[-1] == "__init__.py"
        for x in ast.walk(tree):
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and x.decorator_list:
                yield "decorated", x.name, x.lineno
            elif package and isinstance(x, ast.Import):
                yield from (("handed on", (a.asname or a.name).rsplit(".", 1)[-1], x.lineno) for a in x.names)
            elif package and isinstance(x, ast.ImportFrom):
                yield from (("handed on", a.asname or a.name, x.lineno) for a in x.names if a.name != "*")
            elif package and isinstance(x, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in x.targets) and isinstance(x.value, (ast.List, ast.Tuple, ast.Set)):
                yield from (("handed on", v.value, x.lineno) for v in x.value.elts if isinstance(v, ast.Constant) and isinstance(v.value, str))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(repo, path, *x) for repo, path, text in zip(f["repo_path"], f["path"], f["content"]) for x in found(path, text)]
            yield pd.DataFrame(rows, columns=["repo_path", "path", "what", "name", "line"])

    py = sources.where(F.lower("path").endswith(".py") & F.col("content").isNotNull()).select("repo_path", "path", "content")
    return py.mapInPandas(run, "repo_path string, path string, what string, name string, line int")


def qualified_name(node_id: Column, label: Column) -> Column:
    """A symbol's name with its owners: the third part of its id, or its label where the id has fewer."""
    rest = F.regexp_extract(node_id, r"^[^:]*:[^:]*:(?s:(.*))$", 1)
    return F.when(F.length(node_id) - F.length(F.replace(node_id, F.lit(":"), F.lit(""))) >= 2, rest).otherwise(label)


def safe_names(rows: DataFrame, group: str, name: str, order: str) -> DataFrame:
    """Rows with a column ``file_name``: names fit for files, equal ones numbered from the second on."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(F.col(name), r"[^A-Za-z0-9._-]+", "_")), r"^[_.]+|[_.]+$", "")
    plain = F.when(plain == "", "unnamed").otherwise(plain)
    w = Window.partitionBy(group, F.lower("_plain")).orderBy(order)
    r = rows.withColumn("_plain", plain).withColumn("_n", F.row_number().over(w))
    return r.withColumn("file_name", F.when(F.col("_n") == 1, F.col("_plain")).otherwise(F.concat("_plain", F.lit("_"), F.col("_n").cast("string")))).drop("_plain", "_n")


def location(value: Column) -> Column:
    """The path and line of 'path:line'; null where there is no line."""
    found = value.rlike(r"(?s)^.*:\d+$")
    return F.when(found, F.struct(F.regexp_extract(value, r"(?s)^(.*):(\d+)$", 1).alias("path"), F.regexp_extract(value, r"(?s)^(.*):(\d+)$", 2).cast("long").alias("line")))


def handler_signal(name: Column) -> Column:
    """The signal a handler property listens to: onFooBar listens to fooBar; null for other names."""
    return F.when(name.rlike(r"^on[A-Z]"), F.concat(F.lower(F.substring(name, 3, 1)), F.substring(name, 4, 1 << 30)))


def snippet(content: Column, terms: list[str], width: int = 12) -> Column:
    """Words around the first one that holds a term, which stands in brackets; null where none does."""
    words = F.filter(F.split(content, r"\s+"), lambda w: w != "")
    hit = lambda w: F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower(w), t))
    first = F.array_min(F.filter(F.transform(words, lambda w, i: F.when(hit(w), i + 1)), lambda i: i.isNotNull()))
    start = F.greatest(F.lit(1), first - width // 2)
    marked = F.transform(F.slice(words, start, F.lit(width)), lambda w, i: F.when(i + start == first, F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    return F.when(first.isNotNull(), F.array_join(marked, " "))
