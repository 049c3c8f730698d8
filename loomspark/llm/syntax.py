"""Source files that do not parse: minimum-cost syntax repair of every file by error-correcting chart
parsing.

Brackets (or indentation, or keywords) are matched first, unmatched ones at one edit each; the
statements between them go through the chart, whose memory of statement outlines is kept across
files. The cost of every faulty statement is a minimum, whatever its length or theirs in number; a
bracket group is one token of its statement and worth two edits at most, a new group in its place. A
file's cost is the sum over its statements as cut; one edit may mend two of them together, so only a
cost of 1 is certainly the file's minimum, and ``is_minimum`` says so.

Defined results: of several states of a file the greatest ``modified_at`` is current (nulls lowest,
then the greater content); null repositories, paths and contents are skipped; an empty code file is
valid, an empty JSON file is not; suffixes without a grammar are left out; files of any
length and depth are parsed; Python files are checked once more with the interpreter's own parser, which
clears those it accepts and counts one edit for others it refuses, but has no say on files that are
too deep or too long for it, since that is no matter of grammar.
"""

from __future__ import annotations

import ast
import sys
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.code.lexer import language
from loomspark.llm.code.parser import Parser
from loomspark.llm.code.tree import Tree

_PARSERS: dict[str, Parser] = {}


def parser(lang: str) -> Parser:
    """The process's parser of a language; it remembers what it has parsed."""
    if lang not in _PARSERS:
        _PARSERS[lang] = Parser(lang)
    return _PARSERS[lang]


def current(sources: DataFrame, *extra: str) -> DataFrame:
    """One row per file: repo_path, path, content and further columns of its current state."""
    rows = sources.where("repo_path IS NOT NULL AND path IS NOT NULL")
    best = rows.groupBy("repo_path", "path").agg(F.max(F.struct("modified_at", "content", *extra)).alias("x"))
    return best.select("repo_path", "path", "x.content", *[F.col(f"x.{c}") for c in extra])


#: What the interpreter's parser says of files beyond its limits of depth or length.
_LIMITS = ("too many nested parentheses", "too many levels of indentation", "nested too deeply", "Exceeds the limit", "too many nested f-strings")


def verdict(text: str) -> tuple[bool | None, int]:
    """Whether the interpreter's parser takes the text (None: it is beyond its limits), and where it stops."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except SyntaxError as e:
        if any(x in str(e.msg) for x in _LIMITS):
            return None, 0
        return False, sum(len(x) + 1 for x in text.split("\n")[: max(0, (e.lineno or 1) - 1)])
    except (MemoryError, RecursionError):
        return None, 0
    except ValueError:
        return False, 0
    return True, 0


def judge(path: str, text: str, count: bool = True) -> tuple[str, int, str, int, Tree, bool] | None:
    """(language, edit cost, reason, line of the first edit, tree, whether the cost is a minimum) of one
    file; None without a grammar.

    Without ``count`` only whether the cost is 0 matters to the caller.
    """
    lang = language(path)
    if lang is None:
        return None
    # groups are walked by recursion, one frame a level; the interpreter keeps these frames on the heap
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 12_000 + 2 * len(text)))
    cost, edits, tree, pieces = parser(lang).file(text, count)
    minimal = parser(lang).minimal
    if lang == "python":
        valid, at = verdict(text)
        if valid is not None and bool(cost) == valid:
            cost, edits, minimal = (0, [], True) if cost else (1, [(at, "statement")], False)
    if not cost:
        return lang, 0, "", 0, tree, True
    places = sorted(edits)
    line = text.count("\n", 0, places[0][0]) + 1
    if any(w == "conflict" for _, w in edits):
        why = "conflict"
    elif sum(w == "grammar" for _, w in edits) > max(1, pieces // 2) or text.lstrip()[:1] == "<" and lang not in ("js", "jsx", "tsx"):
        why = "mismatch"
    elif tree.truncated and places[-1][0] >= 0.6 * len(text.rstrip()):
        why = "truncation"
    elif tree.truncated or any(w == "bracket" for _, w in edits):
        why = "bracket"
    else:
        why = "statement"
    return lang, cost, why, line, tree, minimal


def check_files(sources: DataFrame) -> DataFrame:
    """(repo_path, path, language, edit_cost, is_minimum, reason, line) of every current file that has a grammar.

    Whether the cost is 0 is exact for the grammar; ``is_minimum`` tells whether a nonzero cost is
    certainly the least of the whole file, or the sum of its statements' least costs.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for repo, path, text in zip(f["repo_path"], f["path"], f["content"]):
                j = judge(path, text)
                if j is not None:
                    out.append((repo, path, j[0], j[1], j[5], j[2], j[3]))
            yield pd.DataFrame(out, columns=["repo_path", "path", "language", "edit_cost", "is_minimum", "reason", "line"])

    files = current(sources).where("content IS NOT NULL")
    return files.mapInPandas(run, "repo_path string, path string, language string, edit_cost int, is_minimum boolean, reason string, line int")


def failure_rates(checked: DataFrame) -> DataFrame:
    """Per repository and language, with null for all of them: files, broken files and their rate."""
    total = checked.cube("repo_path", "language").agg(F.count("*").alias("files"), F.sum((F.col("edit_cost") > 0).cast("long")).alias("broken"))
    return total.withColumn("rate", F.col("broken") / F.col("files"))
