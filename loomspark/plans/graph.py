"""Queries over the property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import text as X
from loomspark.operators import governance, graphs, history, resolution, scans, structure
from loomspark.session import materialize, table


def _nodes(s: SparkSession, d: str) -> DataFrame:
    return graphs.nodes_of(table(s, d, "graph_nodes", "repo_path", "node_id", "kind", "label", "source_ref", "granularity", "signature", "span_start", "span_end"))


def _edges(s: SparkSession, d: str) -> DataFrame:
    return graphs.edges_of(table(s, d, "graph_edges", "repo_path", "edge_id", "source", "target", "relation", "layer", "weight", "source_file"))


def _commits(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "commits", "repo_path", "sha", "files_json")


def _file_links(s: SparkSession, d: str) -> DataFrame:
    """Structural edges and all co-change edges as one layered edge set."""
    co = history.cochange(_commits(s, d)).select("repo_path", F.concat(F.lit("file:"), "a").alias("source"), F.concat(F.lit("file:"), "b").alias("target"), F.lit("cochange").alias("relation"), F.lit("COCHANGE").alias("layer"), "weight")
    return _edges(s, d).select("repo_path", "source", "target", "relation", "layer", "weight").unionByName(co)


def node_kinds(s, d):
    return _nodes(s, d).groupBy("repo_path", "kind", "granularity").agg(F.count("*").alias("n_nodes"))


def node_degrees(s, d):
    n = _nodes(s, d).select("repo_path", "node_id")
    return n.join(graphs.degrees(_edges(s, d)), ["repo_path", "node_id"], "left").select("repo_path", "node_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def god_nodes(s, d):
    from pyspark.sql import Window

    n = _nodes(s, d).where("kind = 'file'").select("repo_path", "node_id").join(graphs.degrees(_edges(s, d)), ["repo_path", "node_id"], "left").fillna(0, ["degree"])
    w = Window.partitionBy("repo_path").orderBy(F.desc("degree"), "node_id")
    return n.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("repo_path", "node_id", "degree", F.col("rank").cast("long").alias("rank"))


def file_fan_in(s, d):
    return graphs.fan_in(_nodes(s, d), _edges(s, d))


def dangling_edges(s, d):
    n = _nodes(s, d).select("repo_path", F.col("node_id").alias("target"))
    return _edges(s, d).join(n, ["repo_path", "target"], "left_anti").groupBy("repo_path", "relation").agg(F.count("*").alias("n_edges"))


def edge_relations(s, d):
    return graphs.relations(_nodes(s, d), _edges(s, d), "imports", "lease")


def tightest_containers(s, d):
    return graphs.containers(_nodes(s, d))


def unique_import_targets(s, d):
    """Import targets: the file of that path, else the only one of that base name, else none."""
    i = _edges(s, d).where("relation = 'imports'").select("repo_path", "edge_id", F.regexp_replace("target", "^[a-z]+:", "").alias("wanted"))
    files = _nodes(s, d).where("kind = 'file'").select("repo_path", F.col("source_ref").alias("path"))
    return resolution.import_targets(i, files)


def neighbour_bonus(s, d):
    seeds = _nodes(s, d).where("kind = 'class' AND label LIKE '%Lease%'").select("repo_path", "node_id")
    b = graphs.proximity(_edges(s, d), seeds)
    return b.select("repo_path", "node_id", F.round("bonus", 6).alias("bonus"))


def page_rank(s, d):
    """Converged ranks seeded with the scanner's nodes."""
    n = materialize(_nodes(s, d))
    seeds = n.where("source_ref LIKE '%scanner%'").select("repo_path", "node_id", F.lit(1.0).alias("weight"))
    r = graphs.pagerank(n, materialize(_edges(s, d)), seeds)
    return r.select("repo_path", "node_id", F.round("rank", 9).alias("rank"))


def page_rank_converged(s, d):
    n = _nodes(s, d)
    return graphs.pagerank(materialize(n), materialize(_edges(s, d))).select("repo_path", "node_id", F.round("rank", 6).alias("rank"))


def label_communities(s, d):
    c = graphs.communities(_nodes(s, d), _edges(s, d))
    return c.groupBy("repo_path", "community").agg(F.count("*").alias("size"))


def paths_between(s, d):
    """Shortest paths from the files that are imported most to the ones imported next."""
    from pyspark.sql import Window

    f = graphs.fan_in(_nodes(s, d), _edges(s, d))
    w = Window.partitionBy("repo_path").orderBy(F.desc("fan_in"), "path")
    t = f.withColumn("n", F.row_number().over(w)).where("n <= 2")
    p = t.groupBy("repo_path").agg(F.max(F.when(F.col("n") == 1, F.concat(F.lit("file:"), "path"))).alias("a"), F.max(F.when(F.col("n") == 2, F.concat(F.lit("file:"), "path"))).alias("b")).where("b IS NOT NULL")
    r = graphs.shortest_paths(_edges(s, d), p, most_depth=4)
    return r.select("repo_path", "a", "b", F.col("hops").cast("long").alias("hops"), F.array_join("path", " | ").alias("path"))


def file_impact(s, d):
    i = graphs.impact(_nodes(s, d), _file_links(s, d))
    return i.select("repo_path", "path", "neighbour", F.round("score", 6).alias("score"), "why", F.col("rank").cast("long").alias("rank"))


def surprising_links(s, d):
    """Strong co-change between folders, leaving out a source and its test."""
    from pyspark.sql import Window

    c = history.cochange(_commits(s, d))
    folder = lambda p: F.substring_index(p, "/", 2)
    pair = (X.is_test_path(F.col("a")) != X.is_test_path(F.col("b"))) & (X.test_base(F.col("a")) == X.test_base(F.col("b")))
    c = c.where((folder("a") != folder("b")) & ~pair)
    w = Window.partitionBy("repo_path").orderBy(F.desc("weight"), "a", "b")
    return c.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("repo_path", "a", "b", F.round("weight", 6).alias("weight"), F.col("rank").cast("long").alias("rank"))


def _changed(s: SparkSession, d: str) -> DataFrame:
    f = history.commit_files(_commits(s, d))
    return f.select("repo_path", F.col("sha").alias("change_id"), "path")


def missing_partners(s, d):
    return governance.missing_partners(_changed(s, d), history.cochange(_commits(s, d))).groupBy("repo_path", "path", "partner").agg(F.count("*").alias("n_changes"), F.round(F.max("weight"), 6).alias("weight"))


def change_risk(s, d):
    """Risk of every file of every commit: its size stands for the diff, tests that go with a changed file and
    were not changed are directives."""
    ch = materialize(_changed(s, d))
    size = ch.groupBy("repo_path", "change_id").agg(F.count("*").alias("diff"))
    src = scans.current_sources(table(s, d, "sources", "repo_path", "path", "modified_at", "content"))
    asked = governance.test_directives(ch, src.select("repo_path", "path"))
    ch2 = ch.join(size, ["repo_path", "change_id"]).join(asked, ["repo_path", "change_id", "path"], "left").fillna(0, ["directives"])
    r = governance.risk_scores(ch2, history.hotspots(src, _commits(s, d)), graphs.fan_in(_nodes(s, d), _edges(s, d)), governance.missing_partners(ch, history.cochange(_commits(s, d))))
    return r.groupBy("repo_path", "path").agg(F.max("risk").alias("risk"), F.count("*").alias("n_changes"))


def _extracted(s: SparkSession, d: str) -> DataFrame:
    src = scans.current_sources(table(s, d, "sources", "repo_path", "path", "modified_at", "content"))
    return structure.extract(src)


def extracted_symbols(s, d):
    """Nodes found in the files, by kind."""
    return _extracted(s, d).where("what = 'node'").groupBy("repo_path", "kind").agg(F.count("*").alias("n_nodes"))


def extracted_links(s, d):
    """Resolved edges found in the files."""
    return structure.resolve(materialize(_extracted(s, d))).groupBy("repo_path", "relation", "confidence").agg(F.count("*").alias("n_edges"), F.count_if(F.col("target").startswith("file:") | F.col("target").startswith("symbol:")).alias("n_resolved"))


def resolved_calls(s, d):
    """Calls by name whose name is the label of exactly one symbol of the repository."""
    n = _nodes(s, d).where("granularity = 'symbol'").groupBy("repo_path", "label").agg(F.count("*").alias("n"), F.min("node_id").alias("target_id")).where("n = 1")
    e = _edges(s, d).where("relation = 'calls' AND target LIKE 'name:%'").select("repo_path", "edge_id", "source", F.expr("substring(target, 6)").alias("label"))
    return e.join(n, ["repo_path", "label"]).where("source <> target_id").select("repo_path", "edge_id", "source", "target_id")


def unused_symbols(s, d):
    return governance.unused_symbols(_nodes(s, d), _edges(s, d))


def dead_code(s, d):
    src = scans.current_sources(table(s, d, "sources", "repo_path", "path", "modified_at", "content"))
    return governance.unused_tiers(governance.unused_symbols(_nodes(s, d), _edges(s, d)), src)


def symbol_bodies(s, d):
    """Every symbol's text by its span, as a hash and its number of lines."""
    src = scans.current_sources(table(s, d, "sources", "repo_path", "path", "modified_at", "content")).select("repo_path", F.col("path").alias("source_ref"), X.lines(F.col("content")).alias("ls"))
    n = _nodes(s, d).where("granularity = 'symbol' AND span_start >= 1 AND span_end >= span_start").select("repo_path", "node_id", "source_ref", "span_start", "span_end")
    j = n.join(src, ["repo_path", "source_ref"]).withColumn("body", F.slice("ls", F.col("span_start"), F.col("span_end") - F.col("span_start") + 1))
    return j.select("repo_path", "node_id", F.size("body").cast("long").alias("n_lines"), F.sha2(F.array_join("body", "\n"), 256).alias("body_sha"))


QUERIES = {f.__name__: f for f in [node_kinds, node_degrees, god_nodes, file_fan_in, dangling_edges, edge_relations, tightest_containers, unique_import_targets, neighbour_bonus, page_rank, page_rank_converged, label_communities, paths_between, file_impact, surprising_links, missing_partners, change_risk, extracted_symbols, extracted_links, resolved_calls, unused_symbols, dead_code, symbol_bodies]}

_N = "n AS (SELECT DISTINCT repo_path, node_id, kind, label, source_ref, granularity, signature, span_start, span_end FROM graph_nodes WHERE repo_path IS NOT NULL AND node_id IS NOT NULL)"
_E = """e AS (SELECT * FROM (SELECT repo_path, edge_id, source, target, relation, layer, weight, source_file, row_number() OVER (PARTITION BY repo_path, edge_id
  ORDER BY source DESC, target DESC, relation DESC, layer DESC, weight DESC NULLS LAST, source_file DESC) rn FROM graph_edges) WHERE rn = 1 AND source IS NOT NULL AND target IS NOT NULL)"""
_DEG = "dg AS (SELECT repo_path, node_id, count(*) AS degree FROM (SELECT repo_path, source AS node_id FROM e UNION ALL SELECT repo_path, target FROM e) GROUP BY 1, 2)"
_FAN = """fi AS (SELECT t.repo_path, t.source_ref AS path, count(*) AS fan_in FROM e JOIN n t ON t.repo_path = e.repo_path AND t.node_id = e.target LEFT JOIN n o ON o.repo_path = e.repo_path AND o.node_id = e.source
  WHERE e.layer = 'STRUCTURAL' AND (o.source_ref IS NULL OR o.source_ref <> t.source_ref) AND EXISTS (SELECT 1 FROM n f WHERE f.repo_path = t.repo_path AND f.kind = 'file' AND f.node_id NOT LIKE 'commit:%' AND f.source_ref = t.source_ref) GROUP BY 1, 2)"""
from loomspark.plans.repository import _BASE, _CPLX, _CUR, _FILES, _LINES, _STEM, _SUF  # noqa: E402

_CO = """okc AS (SELECT repo_path, sha FROM f GROUP BY 1, 2 HAVING count(*) <= 50), g AS (SELECT f.* FROM f JOIN okc USING (repo_path, sha)),
p0 AS (SELECT x.repo_path, x.path a, y.path b, count(*) n FROM g x JOIN g y ON x.repo_path = y.repo_path AND x.sha = y.sha AND x.path < y.path GROUP BY 1, 2, 3),
co AS (SELECT repo_path, a, b, n, n::DOUBLE / max(n) OVER (PARTITION BY repo_path) AS weight FROM p0)"""
_TP = lambda c: f"(list_contains(string_split({c}, '/'), 'tests') OR starts_with(lower({_STEM.replace('path', c)}), 'test_') OR ends_with(lower({_STEM.replace('path', c)}), '_test'))"
_LW = "CASE layer WHEN 'STRUCTURAL' THEN 3.0 WHEN 'COCHANGE' THEN 2.0 WHEN 'HEADING' THEN 1.5 WHEN 'SEMANTIC' THEN 0.5 ELSE 1.0 END"


def _ranked(seed: str, digits: int) -> str:
    """PageRank in SQL: rounds until a repository's ranks move by less than 1e-6 in all, at most 100."""
    return f"""WITH RECURSIVE {_N}, {_E}, ok AS (SELECT DISTINCT repo_path, node_id, source_ref FROM n WHERE kind <> 'commit' AND node_id NOT LIKE 'commit:%'),
w AS (SELECT e.repo_path, source, target, coalesce(weight, 0) * {_LW} AS w FROM e WHERE EXISTS (SELECT 1 FROM ok WHERE ok.repo_path = e.repo_path AND ok.node_id = e.source) AND EXISTS (SELECT 1 FROM ok WHERE ok.repo_path = e.repo_path AND ok.node_id = e.target)),
u AS (SELECT repo_path, s, t, sum(w) w FROM (SELECT repo_path, source s, target t, w FROM w WHERE w > 0 UNION ALL SELECT repo_path, target, source, w FROM w WHERE w > 0) GROUP BY 1, 2, 3),
l AS MATERIALIZED (SELECT repo_path, s, t, w / sum(w) OVER (PARTITION BY repo_path, s) AS p FROM u),
sd AS (SELECT repo_path, node_id, {seed} sw FROM ok),
base AS MATERIALIZED (SELECT repo_path, node_id, CASE WHEN sum(sw) OVER (PARTITION BY repo_path) > 0 THEN sw / sum(sw) OVER (PARTITION BY repo_path) ELSE 1.0 / count(*) OVER (PARTITION BY repo_path) END AS v,
  NOT EXISTS (SELECT 1 FROM l WHERE l.repo_path = sd.repo_path AND l.s = sd.node_id) AS lone FROM sd),
pr AS (SELECT repo_path, node_id, v, lone, v AS r, 0 AS k, 1.0::DOUBLE AS moved FROM base
UNION ALL SELECT repo_path, node_id, v, lone, nr, k + 1, sum(abs(nr - r)) OVER (PARTITION BY repo_path) FROM (
  SELECT q.repo_path, q.node_id, q.v, q.lone, q.r, q.k, 0.15 * q.v + 0.85 * (coalesce(g.g, 0) + sum(CASE WHEN q.lone THEN q.r ELSE 0 END) OVER (PARTITION BY q.repo_path) * q.v) AS nr
  FROM pr q LEFT JOIN (SELECT l.repo_path, l.t, sum(z.r * l.p) AS g FROM pr z JOIN l ON l.repo_path = z.repo_path AND l.s = z.node_id GROUP BY 1, 2) g ON g.repo_path = q.repo_path AND g.t = q.node_id WHERE q.moved >= 1e-6 AND q.k < 100) x)
SELECT repo_path, node_id, round(r / sum(r) OVER (PARTITION BY repo_path), {digits}) AS rank FROM (SELECT * FROM pr QUALIFY k = max(k) OVER (PARTITION BY repo_path))"""


ORACLE = {
    "node_kinds": f"WITH {_N} SELECT repo_path, kind, granularity, count(*) AS n_nodes FROM n GROUP BY 1, 2, 3",
    "node_degrees": f"WITH {_N}, {_E}, {_DEG} SELECT n.repo_path, n.node_id, coalesce(degree, 0) AS degree FROM n LEFT JOIN dg ON dg.repo_path = n.repo_path AND dg.node_id = n.node_id",
    "god_nodes": f"WITH {_N}, {_E}, {_DEG} SELECT * FROM (SELECT n.repo_path, n.node_id, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY n.repo_path ORDER BY coalesce(degree, 0) DESC, n.node_id) AS rank FROM n LEFT JOIN dg ON dg.repo_path = n.repo_path AND dg.node_id = n.node_id WHERE kind = 'file') WHERE rank <= 5",
    "file_fan_in": f"WITH {_N}, {_E}, {_FAN} SELECT * FROM fi",
    "dangling_edges": f"WITH {_N}, {_E} SELECT repo_path, relation, count(*) AS n_edges FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.repo_path = e.repo_path AND n.node_id = e.target) GROUP BY 1, 2",
    "edge_relations": f"""WITH {_N}, {_E} SELECT repo_path, edge_id, source, target, source_label, target_label FROM (SELECT e.repo_path, e.edge_id, e.source, e.target, a.label AS source_label, b.label AS target_label,
row_number() OVER (PARTITION BY e.repo_path ORDER BY e.edge_id) rn FROM e LEFT JOIN n a ON a.repo_path = e.repo_path AND a.node_id = e.source LEFT JOIN n b ON b.repo_path = e.repo_path AND b.node_id = e.target
WHERE e.relation = 'imports' AND (e.source ILIKE '%lease%' OR e.target ILIKE '%lease%' OR coalesce(a.label ILIKE '%lease%', false) OR coalesce(b.label ILIKE '%lease%', false))) WHERE rn <= 50""",
    "tightest_containers": f"""WITH {_N}, s AS (SELECT * FROM n WHERE span_start IS NOT NULL AND span_end IS NOT NULL AND granularity = 'symbol')
SELECT repo_path, node_id, o_id AS container FROM (SELECT s.repo_path, s.node_id, o.node_id AS o_id, row_number() OVER (PARTITION BY s.repo_path, s.node_id ORDER BY o.span_end - o.span_start, o.node_id) rn FROM s JOIN s o ON o.repo_path = s.repo_path AND o.source_ref = s.source_ref
AND o.node_id <> s.node_id AND o.span_start <= s.span_start AND s.span_end <= o.span_end AND NOT (o.span_start = s.span_start AND o.span_end = s.span_end)) WHERE rn = 1""",
    "unique_import_targets": f"""WITH {_N}, {_E}, fl AS (SELECT DISTINCT repo_path, source_ref AS path, list_last(string_split(source_ref, '/')) AS base FROM n WHERE kind = 'file' AND source_ref IS NOT NULL),
one AS (SELECT repo_path, base, min(path) AS path FROM fl GROUP BY 1, 2 HAVING count(*) = 1), i AS (SELECT DISTINCT repo_path, edge_id, regexp_replace(target, '^[a-z]+:', '') AS w FROM e WHERE relation = 'imports')
SELECT i.repo_path, i.edge_id, coalesce(x.path, one.path) AS path FROM i LEFT JOIN fl x ON x.repo_path = i.repo_path AND x.path = i.w LEFT JOIN one ON one.repo_path = i.repo_path AND one.base = list_last(string_split(i.w, '/'))""",
    "neighbour_bonus": f"""WITH {_N}, {_E}, l AS (SELECT repo_path, source a, target b, coalesce(weight, 0) w FROM e UNION ALL SELECT repo_path, target, source, coalesce(weight, 0) FROM e),
s AS (SELECT DISTINCT repo_path, node_id FROM n WHERE kind = 'class' AND label LIKE '%Lease%'),
o AS (SELECT l.repo_path, l.b AS node_id, max(l.w) * 5 AS bonus FROM l JOIN s ON s.repo_path = l.repo_path AND s.node_id = l.a WHERE NOT EXISTS (SELECT 1 FROM s z WHERE z.repo_path = l.repo_path AND z.node_id = l.b) GROUP BY 1, 2),
t AS (SELECT l.repo_path, l.b AS node_id, max(l.w) * 2 AS bonus FROM l JOIN o ON o.repo_path = l.repo_path AND o.node_id = l.a WHERE NOT EXISTS (SELECT 1 FROM s z WHERE z.repo_path = l.repo_path AND z.node_id = l.b)
  AND NOT EXISTS (SELECT 1 FROM o z WHERE z.repo_path = l.repo_path AND z.node_id = l.b) GROUP BY 1, 2)
SELECT repo_path, node_id, round(bonus, 6) AS bonus FROM o UNION ALL SELECT repo_path, node_id, round(bonus, 6) FROM t""",
    "page_rank": _ranked("CASE WHEN source_ref LIKE '%scanner%' THEN 1.0 ELSE 0.0 END", 9),
    "page_rank_converged": _ranked("0.0", 6),
    "surprising_links": f"""WITH {_FILES}, {_CO} SELECT repo_path, a, b, round(weight, 6) AS weight, row_number() OVER (PARTITION BY repo_path ORDER BY weight DESC, a, b) AS rank FROM co
WHERE list_slice(string_split(a, '/'), 1, 2) <> list_slice(string_split(b, '/'), 1, 2) AND NOT ({_TP('a')} <> {_TP('b')} AND {_BASE.replace('path', 'a')} = {_BASE.replace('path', 'b')}) QUALIFY rank <= 5""",
    "file_impact": f"""WITH {_N}, {_E}, {_FILES}, {_CO}, fl AS (SELECT DISTINCT repo_path, node_id, source_ref FROM n WHERE (granularity = 'file' OR kind = 'file') AND kind <> 'commit' AND node_id NOT LIKE 'commit:%'),
k AS (SELECT repo_path, source, target, relation, coalesce(weight, 0) AS w FROM e WHERE layer = 'STRUCTURAL' AND source <> target UNION ALL SELECT repo_path, 'file:' || a, 'file:' || b, 'cochange', 2 * weight FROM co),
u AS (SELECT repo_path, source x, target y, relation, w FROM k UNION ALL SELECT repo_path, target, source, relation, w FROM k),
j AS (SELECT u.repo_path, a.source_ref AS path, b.source_ref AS neighbour, relation, sum(w) w FROM u JOIN fl a ON a.repo_path = u.repo_path AND a.node_id = u.x JOIN fl b ON b.repo_path = u.repo_path AND b.node_id = u.y GROUP BY 1, 2, 3, 4),
s AS (SELECT repo_path, path, neighbour, sum(w) score, string_agg(relation, ',' ORDER BY w DESC, relation) AS why FROM j GROUP BY 1, 2, 3)
SELECT repo_path, path, neighbour, round(score, 6) AS score, why, row_number() OVER (PARTITION BY repo_path, path ORDER BY score DESC, neighbour) AS rank FROM s QUALIFY rank <= 10""",
    "missing_partners": f"""WITH {_FILES}, {_CO}, b2 AS (SELECT repo_path, a AS path, b AS partner, weight FROM co WHERE weight > 0.5 UNION ALL SELECT repo_path, b, a, weight FROM co WHERE weight > 0.5)
SELECT f.repo_path, f.path, b2.partner, count(*) AS n_changes, round(max(b2.weight), 6) AS weight FROM f JOIN b2 ON b2.repo_path = f.repo_path AND b2.path = f.path
WHERE NOT EXISTS (SELECT 1 FROM f z WHERE z.repo_path = f.repo_path AND z.sha = f.sha AND z.path = b2.partner) GROUP BY 1, 2, 3""",
    "change_risk": f"""WITH {_CUR}, {_CPLX}, {_N}, {_E}, {_FAN}, {_FILES}, {_CO}, ch AS (SELECT repo_path, path, count(*) AS churn FROM f GROUP BY 1, 2),
hs AS (SELECT cx.repo_path, cx.path, coalesce(churn, 0) * complexity AS score FROM cx LEFT JOIN ch ON ch.repo_path = cx.repo_path AND ch.path = cx.path),
sz AS (SELECT repo_path, sha, count(*) AS diff FROM f GROUP BY 1, 2),
b2 AS (SELECT repo_path, a AS path, b AS partner, weight FROM co WHERE weight > 0.5 UNION ALL SELECT repo_path, b, a, weight FROM co WHERE weight > 0.5),
ms AS (SELECT f.repo_path, f.sha, f.path, max(b2.weight) AS cw FROM f JOIN b2 ON b2.repo_path = f.repo_path AND b2.path = f.path WHERE NOT EXISTS (SELECT 1 FROM f z WHERE z.repo_path = f.repo_path AND z.sha = f.sha AND z.path = b2.partner) GROUP BY 1, 2, 3),
tp AS (SELECT repo_path, path, {_BASE} AS base, {_TP('path')} AS t FROM cur), dr AS (SELECT f.repo_path, f.sha, f.path, count(DISTINCT b.path) AS dn FROM f JOIN tp a ON a.repo_path = f.repo_path AND a.path = f.path AND NOT a.t JOIN tp b ON b.repo_path = a.repo_path AND b.base = a.base AND b.t
  WHERE NOT EXISTS (SELECT 1 FROM f z WHERE z.repo_path = f.repo_path AND z.sha = f.sha AND z.path = b.path) GROUP BY 1, 2, 3),
rk AS (SELECT f.repo_path, f.path, round(10 * (0.0 + 0.20 * least(1.0, coalesce(dr.dn, 0) / 3.0) + 0.30 * least(1.0, sz.diff / 100.0) + 0.20 * least(1.0, coalesce(hs.score, 0) / 1000.0) + 0.15 * least(1.0, coalesce(fi.fan_in, 0) / 10.0) + 0.15 * coalesce(ms.cw, 0)), 2) AS risk
  FROM f JOIN sz ON sz.repo_path = f.repo_path AND sz.sha = f.sha LEFT JOIN hs ON hs.repo_path = f.repo_path AND hs.path = f.path LEFT JOIN fi ON fi.repo_path = f.repo_path AND fi.path = f.path LEFT JOIN ms ON ms.repo_path = f.repo_path AND ms.sha = f.sha AND ms.path = f.path LEFT JOIN dr ON dr.repo_path = f.repo_path AND dr.sha = f.sha AND dr.path = f.path)
SELECT repo_path, path, max(risk) AS risk, count(*) AS n_changes FROM rk GROUP BY 1, 2""",
    "resolved_calls": f"""WITH {_N}, {_E}, u AS (SELECT repo_path, label, min(node_id) AS target_id FROM n WHERE granularity = 'symbol' GROUP BY 1, 2 HAVING count(*) = 1)
SELECT e.repo_path, e.edge_id, e.source, u.target_id FROM e JOIN u ON u.repo_path = e.repo_path AND u.label = substr(e.target, 6) WHERE e.relation = 'calls' AND e.target LIKE 'name:%' AND e.source <> u.target_id""",
    "unused_symbols": f"""WITH {_N}, {_E}, cr AS (SELECT DISTINCT repo_path, target FROM e WHERE relation IN ('calls','imports','inherits','references','reads','writes','aliases','exports'))
SELECT repo_path, node_id, label, source_ref FROM n WHERE granularity = 'symbol' AND kind IN ('func', 'class') AND NOT {_TP('source_ref')} AND label NOT IN ('main', '__main__') AND lower(split_part(source_ref, '/', -1)) <> '__main__.py' AND NOT (starts_with(label, '__') AND ends_with(label, '__'))
AND NOT EXISTS (SELECT 1 FROM cr WHERE cr.repo_path = n.repo_path AND cr.target = n.node_id) AND NOT EXISTS (SELECT 1 FROM cr WHERE cr.repo_path = n.repo_path AND cr.target = 'name:' || n.label)""",
    "symbol_bodies": f"""WITH {_CUR}, {_N}, l AS (SELECT repo_path, path, {_LINES} AS ls FROM cur), b AS (SELECT n.repo_path, n.node_id, list_slice(l.ls, n.span_start, n.span_end) AS body FROM n JOIN l ON l.repo_path = n.repo_path AND l.path = n.source_ref
WHERE granularity = 'symbol' AND span_start >= 1 AND span_end >= span_start) SELECT repo_path, node_id, len(body) AS n_lines, sha256(array_to_string(body, chr(10))) AS body_sha FROM b""",
}
ORACLE["dead_code"] = f"""WITH {_CUR}, u AS ({ORACLE["unused_symbols"]}), w AS (SELECT repo_path, path, lower({_SUF}) IN ('.md', '.txt', '.rst') AS doc, unnest(list_distinct(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*'))) AS label FROM cur),
g AS (SELECT u.repo_path, u.node_id, u.label, u.source_ref, count(CASE WHEN w.path <> u.source_ref AND NOT w.doc THEN 1 END) AS code, count(CASE WHEN w.path <> u.source_ref AND w.doc THEN 1 END) AS docs
FROM u LEFT JOIN w ON w.repo_path = u.repo_path AND w.label = u.label GROUP BY 1, 2, 3, 4)
SELECT repo_path, node_id, label, source_ref, CASE WHEN code = 0 AND docs = 0 THEN 'high' WHEN code = 0 THEN 'medium' ELSE 'low' END AS tier FROM g"""
