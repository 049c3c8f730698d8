"""Changes between two states as version control reports them: names with status, line counts, lines.

Each source takes rows (change_id, data) with one report's raw text, NUL-separated where the
tool separates so; reports of any number of changes are parsed side by side.

Defined results: null reports give no rows; records that are cut off are skipped; counts that are no
numbers are 0; bytes that are no UTF-8 are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _text(data) -> str:
    if data is None:
        return ""
    return data.decode("utf-8", "replace") if isinstance(data, (bytes, bytearray)) else str(data)


def _status(data: str) -> Iterator[tuple]:
    fields = iter(data.split("\0"))
    for field in fields:
        if not field:
            continue
        moved = field[0] in "RC"
        names = [next(fields, None) for _ in range(2 if moved else 1)]
        if names[-1] is not None:
            yield field[0], field[1:] or None, names[-1], names[0] if moved else None


def _counts(data: str) -> Iterator[tuple]:
    fields = iter(data.split("\0"))
    for field in fields:
        parts = field.split("\t", 2)
        if len(parts) < 3:
            continue
        binary = "-" in parts[:2]
        added, removed = (0 if binary or not re.fullmatch(r"\s*\+?\d+\s*", x) else int(x) for x in parts[:2])
        old, new = None, parts[2]
        if not new:
            old, new = next(fields, None), next(fields, None)
        if new is not None:
            yield added, removed, binary, new, old


def _lines(data: str) -> Iterator[tuple]:
    """(path, added lines, removed lines): only what stands in a hunk is a line of the file."""
    path = old = None
    left = [0, 0]  # lines of the hunk still to come, removed and added
    found: dict[str, tuple[list, list]] = {}

    def name(x: str) -> str | None:
        x = x.strip().split("\t", 1)[0].strip('"')
        return None if x == "/dev/null" else re.sub(r"^[ab]/", "", x)

    for line in data.split("\n"):
        hunk = re.match(r"@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@", line)
        if hunk:
            left = [int(n) if n is not None else 1 for n in hunk.groups()]
        elif line[:1] == "-" and left[0] > 0 and path:
            found[path][1].append(line[1:].rstrip("\r"))
            left[0] -= 1
        elif line[:1] == "+" and left[1] > 0 and path:
            found[path][0].append(line[1:].rstrip("\r"))
            left[1] -= 1
        elif line.startswith("diff --git "):
            path, left = None, [0, 0]
        elif line.startswith("--- "):
            old = name(line[4:])
        elif line.startswith("+++ "):
            path = name(line[4:]) or old
            if path:
                found.setdefault(path, ([], []))
    yield from ((p, *x) for p, x in found.items())


def _parsed(reports: DataFrame, parse, schema: str) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(i, n, *x) for i, d in zip(f["change_id"], f["data"]) for n, x in enumerate(parse(_text(d)))], columns=["change_id", "pos", *columns])

    return reports.select("change_id", "data").mapInPandas(run, f"change_id string, pos int, {schema}")


def name_status(reports: DataFrame) -> DataFrame:
    """(change_id, pos, status, rename_score, path, previous_path)"""
    return _parsed(reports, _status, "status string, rename_score string, path string, previous_path string")


def line_counts(reports: DataFrame) -> DataFrame:
    """(change_id, pos, additions, deletions, binary, path, previous_path)"""
    return _parsed(reports, _counts, "additions long, deletions long, binary boolean, path string, previous_path string")


def changed_lines(reports: DataFrame) -> DataFrame:
    """(change_id, pos, path, added_lines, removed_lines)"""
    return _parsed(reports, _lines, "path string, added_lines array<string>, removed_lines array<string>")


def diff_files(names: DataFrame, counts: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per changed file: the three reports joined by path, or by the path before a rename."""
    s = name_status(names)
    c = line_counts(counts).groupBy("change_id", "path").agg(F.min_by(F.struct("additions", "deletions", "binary"), "pos").alias("c"))
    x = changed_lines(lines).select("change_id", "path", F.struct("added_lines", "removed_lines").alias("x"))
    for side, value in ((c, "c"), (x, "x")):
        old = side.select("change_id", F.col("path").alias("previous_path"), F.col(value).alias("_old"))
        s = s.join(side, ["change_id", "path"], "left").join(old, ["change_id", "previous_path"], "left").withColumn(value, F.coalesce(value, "_old")).drop("_old")
    none = F.array().cast("array<string>")
    return s.select(
        "change_id", "path", "status", F.coalesce("c.additions", F.lit(0)).alias("additions"), F.coalesce("c.deletions", F.lit(0)).alias("deletions"), "previous_path", "rename_score", F.coalesce("c.binary", F.lit(False)).alias("binary"),
        F.coalesce("x.added_lines", none).alias("added_lines"), F.coalesce("x.removed_lines", none).alias("removed_lines"),
    )


def valid_range(spec: str) -> str:
    """A range of two states as given, or an error: no blanks, no options, no characters of a shell."""
    if not re.fullmatch(r"(?!-)[\w./@{}^~-]+(?:\.{2,3}[\w./@{}^~-]+)?", spec or ""):
        raise ValueError(f"not a range of states: {spec!r}")
    return spec


def declared_signal_names(lines) -> object:
    """Names of signals that lines declare: 'signal name(...)' or 'void name(...);' (a column of arrays)."""
    found = F.transform(lines, lambda x: F.regexp_extract(x, r"^\s*(?:signal\s+|void\s+)([A-Za-z_]\w*)\s*\(", 1))
    return F.array_distinct(F.filter(found, lambda x: x != ""))
