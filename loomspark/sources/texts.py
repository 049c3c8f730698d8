"""Sources: commit logs, diffs and folders of files; sinks: graph exports and note folders.

Defined results: undecodable and oversized files are left out; blocks that are no commits and lines
that are no diff are skipped; empty input gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import text as X
from loomspark.operators.scans import INDEXED, MOST_BYTES


def read_tree(spark: SparkSession, root: str, skip_dirs: list[str], repo: str) -> DataFrame:
    """Files of a folder as a sources table: indexed suffix, not under a skipped folder, small, valid UTF-8."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = re.sub(r"^file:/*", "/", root).rstrip("/") + "/"
    path = F.expr(f"substring(regexp_replace(path, '^file:/*', '/'), {len(prefix) + 1})")
    f = raw.where(F.col("length") <= MOST_BYTES).select(path.alias("path"), F.col("length").alias("size_bytes"), F.unix_micros("modificationTime").alias("us"), "content")
    parents = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    f = f.where(F.lower(X.suffix(F.col("path"))).isin(INDEXED) & ~F.arrays_overlap(parents, F.array(*[F.lit(d) for d in skip_dirs])))
    text = f.withColumn("content", F.try_validate_utf8(F.col("content").cast("string"))).where("content IS NOT NULL")
    return text.select(F.lit(repo).alias("repo_path"), "path", X.classify_path(F.col("path")).alias("kind"), "size_bytes", (F.col("us") / 1e6).alias("modified_at"), "content", F.sha2("content", 256).alias("content_hash"), (F.col("us") * 1000).alias("mtime_ns"))


def parse_log(logs: DataFrame, repo: str) -> DataFrame:
    """Commits from text made with fields sha, author, time and summary split by 0x1f, a line each, followed
    by the names of the changed files, and a blank line between commits. Column of logs: value (a whole text)."""
    block = F.explode(F.split(F.regexp_replace("value", "\r", ""), "\n\n+"))
    b = logs.select(block.alias("b")).select(F.split("b", "\n").alias("ls"))
    head = F.split(F.get("ls", F.lit(0)), "\u001f")
    c = b.where(F.size(head) >= 4).select(head.alias("h"), F.filter(F.slice("ls", 2, F.size("ls")), lambda x: F.trim(x) != "").alias("fs"))
    return c.select(F.lit(repo).alias("repo_path"), F.get("h", F.lit(0)).alias("sha"), F.get("h", F.lit(3)).alias("summary"), F.get("h", F.lit(1)).alias("author"), F.get("h", F.lit(2)).try_cast("long").alias("authored_at"), F.to_json("fs").alias("files_json"))


_DIFF = "change_id string, path string, previous_path string, added long, removed long, binary boolean"


def parse_diffs(diffs: DataFrame) -> DataFrame:
    """Files of unified diffs (change_id, text): path, path before a rename, lines added and removed."""

    def files(text: str) -> Iterator[tuple]:
        cur = None
        for line in (text or "").split("\n"):
            if line.startswith("diff --git "):
                if cur:
                    yield tuple(cur)
                m = re.match(r'diff --git "?a/(.+?)"? "?b/(.+?)"?$', line)
                cur = [m[2] if m else None, None, 0, 0, False, False]
            elif cur is None:
                continue
            elif line.startswith("@@"):
                cur[5] = True
            elif not cur[5]:
                if line.startswith("rename from "):
                    cur[1] = line[12:]
                elif line.startswith("rename to "):
                    cur[0] = line[10:]
                elif line.startswith("Binary files"):
                    cur[4] = True
            elif line.startswith("+"):
                cur[2] += 1
            elif line.startswith("-"):
                cur[3] += 1
        if cur:
            yield tuple(cur)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, *x[:5]) for i, t in zip(f["change_id"], f["text"]) for x in files(t) if x[0]]
            yield pd.DataFrame(rows, columns=["change_id", "path", "previous_path", "added", "removed", "binary"])

    return diffs.select("change_id", "text").mapInPandas(run, _DIFF)


def export_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """The graph as line-delimited JSON in two folders, written in parallel."""
    nodes.write.mode("overwrite").json(f"{folder}/nodes")
    edges.write.mode("overwrite").json(f"{folder}/edges")


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GraphML elements (ord, xml): ord 0 opens, 1 nodes, 2 edges, 3 closes; joined in order they are a document."""

    def esc(c):
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    spark = nodes.sparkSession
    n = nodes.select(F.lit(1).alias("ord"), F.concat(F.lit('<node id="'), esc(F.col("node_id")), F.lit('"><data key="label">'), esc(F.coalesce("label", F.lit(""))), F.lit("</data></node>")).alias("xml"))
    e = edges.select(F.lit(2).alias("ord"), F.concat(F.lit('<edge source="'), esc(F.col("source")), F.lit('" target="'), esc(F.col("target")), F.lit('"><data key="relation">'), esc(F.coalesce("relation", F.lit(""))), F.lit("</data></edge>")).alias("xml"))
    frame = spark.createDataFrame([(0, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="label" for="node" attr.name="label" attr.type="string"/><key id="relation" for="edge" attr.name="relation" attr.type="string"/><graph edgedefault="directed">'), (3, "</graph></graphml>")], "ord int, xml string")
    return frame.unionByName(n).unionByName(e)


def notes(nodes: DataFrame, edges: DataFrame, most_links: int = 200) -> DataFrame:
    """(repo_path, node_id, markdown): a note per node with links to its neighbours (the first by id, and their number)."""
    from pyspark.sql import Window

    links = edges.select("repo_path", F.col("source").alias("node_id"), "relation", F.col("target").alias("other")).distinct()
    w = Window.partitionBy("repo_path", "node_id").orderBy("relation", "other")
    ranked = links.withColumn("n", F.row_number().over(w)).withColumn("total", F.count("*").over(Window.partitionBy("repo_path", "node_id"))).where(F.col("n") <= most_links)
    lines = ranked.groupBy("repo_path", "node_id").agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("n", F.concat(F.lit("- "), "relation", F.lit(" [["), "other", F.lit("]]")).alias("line")))).alias("ls"))
    j = nodes.select("repo_path", "node_id", "label").join(lines, ["repo_path", "node_id"], "left")
    body = F.array_join(F.transform("ls", lambda x: x["line"]), "\n")
    more = F.when(F.col("total") > most_links, F.concat(F.lit("\n- and "), (F.col("total") - most_links).cast("string"), F.lit(" more"))).otherwise("")
    return j.select("repo_path", "node_id", F.concat(F.lit("# "), F.coalesce("label", "node_id"), F.lit("\n\n"), F.coalesce(body, F.lit("")), F.coalesce(more, F.lit(""))).alias("markdown"))
