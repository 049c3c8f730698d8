"""Queries of the general training-data operators: incremental processing (p4) and hierarchies (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators.hierarchy import closure, hierarchy
from loomspark.operators.incremental import due_files
from loomspark.session import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return due_files(
        table(spark, d, "sources", "repo_path", "path", "modified_at", "content"),
        table(spark, d, "ingest_runs", "repo_path", "run_id", "started_at", "status"),
        table(spark, d, "ingest_log", "repo_path", "run_id", "path", "recorded_at", "op", "content_hash"),
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "graph_edges", "repo_path", "source", "target", "relation").where("relation = 'contains'")
    return hierarchy(links, paths=False).select(F.col("g").alias("repo_path"), F.col("node").alias("node_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"))


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every node's place with the full path from its root, one line per (node, root, depth)."""
    links = table(spark, d, "graph_edges", "repo_path", "source", "target", "relation").where("relation = 'contains'")
    return hierarchy(links).select(F.col("g").alias("repo_path"), F.col("node").alias("node_id"), F.col("root").alias("root_id"), F.col("depth").cast("long").alias("depth"), F.coalesce(F.array_join("path", " > "), F.lit("")).alias("full_path"))


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every node's descendants with their distances."""
    links = table(spark, d, "graph_edges", "repo_path", "source", "target", "relation").where("relation = 'contains'")
    return closure(links).select(F.col("g").alias("repo_path"), F.col("node").alias("node_id"), F.col("descendant").alias("descendant_id"), "distance")


QUERIES = {"p4_found": p4_found, "p6_found": p6_found, "p6_paths": p6_paths, "p6_descendants": p6_descendants}

_P6 = """
WITH RECURSIVE e AS (SELECT DISTINCT repo_path g, source s, target t FROM graph_edges
    WHERE relation = 'contains' AND repo_path IS NOT NULL AND source IS NOT NULL AND target IS NOT NULL),
n AS (SELECT g, s AS x FROM e UNION SELECT g, t FROM e),
lv AS (SELECT g, x, 0 AS k FROM n UNION SELECT e.g, e.t, lv.k + 1 FROM lv JOIN e ON e.g = lv.g AND e.s = lv.x WHERE lv.k < 200),
bad AS (SELECT DISTINCT g, x FROM lv WHERE k = 200),
w AS (SELECT n.g, n.x, n.x AS root, 0 AS depth, n.x AS path FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.g = n.g AND e.t = n.x)
    UNION SELECT e.g, e.t, w.root, w.depth + 1, w.path || ' > ' || e.t FROM w JOIN e ON e.g = w.g AND e.s = w.x
    WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.g = e.g AND b.x = e.t))
"""

ORACLE = {
    "p4_found": """
WITH cur AS (SELECT repo_path, path, sha256(arg_max(content, modified_at)) AS h FROM sources GROUP BY 1, 2),
ok AS (SELECT repo_path, run_id, max(started_at) AS started_at FROM ingest_runs WHERE status = 'ok' GROUP BY 1, 2),
lg AS (SELECT l.repo_path, l.path, l.op, l.content_hash, row_number() OVER (PARTITION BY l.repo_path, l.path
    ORDER BY ok.started_at DESC, l.recorded_at DESC, l.run_id DESC, l.op DESC, l.content_hash DESC) AS rn
    FROM ingest_log l JOIN ok ON l.repo_path = ok.repo_path AND l.run_id = ok.run_id)
SELECT c.repo_path, c.path FROM cur c LEFT JOIN lg ON lg.repo_path = c.repo_path AND lg.path = c.path AND lg.rn = 1
WHERE lg.path IS NULL OR lg.op = 'delete' OR lg.content_hash IS DISTINCT FROM c.h
""",
    "p6_found": _P6 + "SELECT DISTINCT g AS repo_path, x AS node_id, root AS root_id, depth FROM w UNION ALL SELECT g, x, '', -1 FROM bad",
    "p6_paths": _P6
    + "SELECT g AS repo_path, x AS node_id, root AS root_id, CAST(depth AS BIGINT) AS depth, min(path) AS full_path FROM w GROUP BY ALL UNION ALL SELECT g, x, '', -1, '' FROM bad",
    "p6_descendants": _P6
    + """, dn AS (SELECT g, s, t, 1 AS k FROM e WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.g = e.g AND b.x = e.t)
    UNION SELECT dn.g, dn.s, e.t, dn.k + 1 FROM dn JOIN e ON e.g = dn.g AND e.s = dn.t WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.g = e.g AND b.x = e.t))
SELECT g AS repo_path, s AS node_id, t AS descendant_id, k AS distance FROM dn""",
}
