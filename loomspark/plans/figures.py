"""Queries of reports, totals, stored state and its refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions import text as X
from loomspark.operators import answers, graphs, history, resolution, scans, upkeep
from loomspark.plans import graph as G
from loomspark.plans import search as Q
from loomspark.plans.graph import _CO, _DEG, _E, _N, _edges, _nodes
from loomspark.plans.repository import _CUR, _FILES, _SUF, _TOK, _commits, _slim, _sources
from loomspark.session import materialize, table

ARGUMENTS = {"task": "stale lease", "budget": 4000, "repo_path": "/anywhere", "include": ["cochange", "hotspots"]}


def set_changes(s: SparkSession, d: str) -> DataFrame:
    """Whether the files the log knows are those that are there."""
    log = scans.latest(table(s, d, "ingest_log", "repo_path", "path", "recorded_at", "op"), ["repo_path", "path"], ["recorded_at"]).where("op <> 'delete'")
    return upkeep.set_changed(log, _slim(s, d), "repo_path", "path")


def degree_refresh(s, d):
    """File nodes whose stored degree is not the one their edges give."""
    raw = table(s, d, "graph_nodes", "repo_path", "node_id", "kind", "metadata_json").where("kind = 'file'")
    stored = scans.latest(raw.select("repo_path", "node_id", F.get_json_object("metadata_json", "$.degree").cast("long").alias("degree")), ["repo_path", "node_id"], ["degree"])
    now = stored.select("repo_path", "node_id").join(graphs.degrees(_edges(s, d)), ["repo_path", "node_id"], "left").fillna(0, ["degree"])
    return upkeep.changed_figures(stored, now, ["repo_path", "node_id"], "degree")


def metadata_lines(s, d):
    """Nodes whose metadata hold a line number, and how far it is from their span."""
    n = resolution.with_metadata(table(s, d, "graph_nodes", "repo_path", "node_id", "span_start", "metadata_json").where(F.col("metadata_json").contains('"lineno"')).distinct())
    line = F.col("metadata")["lineno"].cast("long")
    return n.where(line.isNotNull()).select("repo_path", "node_id", line.alias("line"), (line - F.col("span_start")).cast("long").alias("off"))


def latest_run_items(s, d):
    """The items of every repository's last run, largest first."""
    r = table(s, d, "ingest_runs", "repo_path", "run_id", "started_at").where("repo_path IS NOT NULL AND run_id IS NOT NULL")
    last = r.groupBy("repo_path").agg(F.max(F.struct("started_at", "run_id")).alias("x")).select("repo_path", F.col("x.run_id").alias("run_id"))
    i = table(s, d, "ingest_log", "repo_path", "run_id", "path", "size_bytes").where("path IS NOT NULL")
    i = i.join(last, ["repo_path", "run_id"]).groupBy("repo_path", "run_id", "path").agg(F.max("size_bytes").alias("size_bytes"))
    w = Window.partitionBy("repo_path").orderBy(F.desc_nulls_last("size_bytes"), "path")
    return i.withColumn("rank", F.row_number().over(w).cast("long"))


def repository_states(s, d):
    """Stored state of every repository, and whether files are newer."""
    r = scans.latest(table(s, d, "repos", "repo_path", "updated_at", "fingerprint"), ["repo_path"], ["updated_at"])
    f = _slim(s, d).groupBy("repo_path").agg(F.count("*").alias("n_files"), F.max("modified_at").alias("newest"))
    return r.join(f, "repo_path", "left").select("repo_path", "updated_at", "fingerprint", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce(F.col("newest") > F.col("updated_at"), F.lit(False)).alias("is_stale"))


def ingest_totals(s, d):
    i = table(s, d, "ingest_log", "repo_path", "run_id", "path", "op", "recorded_at", "size_bytes").distinct()
    return i.groupBy("repo_path").agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.count_if(F.col("op") == "delete").alias("deletes"), F.count("*").alias("n_rows"))


def suite_figures(s, d):
    """Mean and median size of the items of every suite."""
    t = table(s, d, "eval_items", "suite", "text", "answer")
    t = t.select("suite", X.token_estimate(F.coalesce("text", F.lit("")), F.lit("text")).alias("tokens"), F.col("answer").isNotNull().alias("known"))
    return t.groupBy("suite").agg(F.count("*").alias("n_items"), F.round(F.avg("tokens"), 6).alias("mean_tokens"), F.round(F.median("tokens"), 6).alias("median_tokens"), F.round(F.avg(F.col("known").cast("int")), 6).alias("answered"))


def token_reduction(s, d):
    """How much smaller a packed answer is than the whole corpus."""
    corpus = _sources(s, d).select("repo_path", X.token_estimate(F.col("content"), X.classify_path(F.col("path"))).alias("t")).groupBy("repo_path").agg(F.sum("t").alias("corpus_tokens"), F.count("*").alias("n_sources"))
    packed = Q.packed_context(s, d).groupBy("repo_path").agg(F.sum("taken").alias("query_tokens"), F.count("*").alias("n_items"))
    ratio = F.when(F.col("query_tokens") > 0, F.round(F.col("corpus_tokens") / F.col("query_tokens"), 1)).otherwise(0.0)
    return corpus.join(packed, "repo_path", "left").fillna(0, ["query_tokens", "n_items"]).select("repo_path", "corpus_tokens", "n_sources", "query_tokens", "n_items", ratio.alias("reduction"))


def referenced_baseline(s, d):
    """Tokens of all files that the twenty latest commits of a repository name."""
    c = scans.latest(table(s, d, "commits", "repo_path", "sha", "authored_at"), ["repo_path", "sha"], ["authored_at"])
    w = Window.partitionBy("repo_path").orderBy(F.desc("authored_at"), "sha")
    late = c.withColumn("n", F.row_number().over(w)).where("n <= 20").select("repo_path", "sha")
    paths = history.commit_files(_commits(s, d)).join(late, ["repo_path", "sha"], "left_semi").select("repo_path", "path").distinct()
    t = _sources(s, d).select("repo_path", "path", X.token_estimate(F.col("content"), X.classify_path(F.col("path"))).alias("t"))
    return paths.join(t, ["repo_path", "path"]).groupBy("repo_path").agg(F.count("*").alias("n_files"), F.sum("t").alias("tokens"))


def answer_keys(s, d):
    r = table(s, d, "repos", "repo_path", "fingerprint").where("repo_path IS NOT NULL").distinct()
    return r.select("repo_path", answers.canonical_key(F.col("fingerprint"), "bundle", ARGUMENTS).alias("key"))


def _communities(s, d):
    return materialize(graphs.communities(_nodes(s, d), _edges(s, d)))


def community_report(s, d):
    """The ten largest communities of a repository with up to five of their files."""
    c = _communities(s, d)
    n = _nodes(s, d).where("kind = 'file'").select("repo_path", "node_id")
    size = c.groupBy("repo_path", "community").agg(F.count("*").alias("size"))
    w = Window.partitionBy("repo_path").orderBy(F.desc("size"), "community")
    top = materialize(size.withColumn("rank", F.row_number().over(w)).where("rank <= 10"))
    f = c.join(n, ["repo_path", "node_id"]).join(top.select("repo_path", "community"), ["repo_path", "community"], "left_semi")
    wf = Window.partitionBy("repo_path", "community").orderBy("node_id")
    few = f.withColumn("n", F.row_number().over(wf)).where("n <= 5").groupBy("repo_path", "community").agg(F.array_join(F.array_sort(F.collect_list("node_id")), " ").alias("files"))
    return top.join(few, ["repo_path", "community"], "left").select("repo_path", "community", "size", F.col("rank").cast("long").alias("rank"), F.coalesce("files", F.lit("")).alias("files"))


def crossing_links(s, d):
    """The strongest co-change between files of different communities."""
    c = _communities(s, d).where("node_id LIKE 'file:%'").select("repo_path", F.expr("substring(node_id, 6)").alias("path"), "community")
    co = history.cochange(_commits(s, d)).select("repo_path", "a", "b", "weight")
    j = co.join(c.select("repo_path", F.col("path").alias("a"), F.col("community").alias("ca")), ["repo_path", "a"]).join(c.select("repo_path", F.col("path").alias("b"), F.col("community").alias("cb")), ["repo_path", "b"]).where("ca <> cb")
    w = Window.partitionBy("repo_path").orderBy(F.desc("weight"), "a", "b")
    return j.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("repo_path", "a", "b", F.round("weight", 6).alias("weight"), F.col("rank").cast("long").alias("rank"))


def latest_events(s, d):
    """The fifty latest rows of the ledger."""
    return table(s, d, "events", "event_id", "ts", "event_type", "value").orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "event_type", F.round("value", 4).alias("value"))


def file_symbols(s, d):
    """Every file's symbols in their order, by name."""
    n = _nodes(s, d).where("granularity = 'symbol'").select("repo_path", F.col("source_ref").alias("path"), F.struct(F.coalesce("span_start", F.lit(1 << 30)).alias("at"), "node_id", "label").alias("x"))
    g = n.groupBy("repo_path", "path").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return g.select("repo_path", "path", F.size("xs").cast("long").alias("n_symbols"), F.array_join(F.transform("xs", lambda x: x["label"]), " ").alias("symbols"))


def riskiest_files(s, d):
    r = G.change_risk(s, d)
    w = Window.partitionBy("repo_path").orderBy(F.desc("risk"), "path")
    return r.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("repo_path", "path", "risk", F.col("rank").cast("long").alias("rank"))


def dead_code_order(s, d):
    """The twenty surest unused symbols of a repository, surest first."""
    u = G.dead_code(s, d)
    w = Window.partitionBy("repo_path").orderBy(F.when(F.col("tier") == "high", 0).when(F.col("tier") == "medium", 1).otherwise(2), "source_ref", "label", "node_id")
    return u.withColumn("rank", F.row_number().over(w)).where("rank <= 20").select("repo_path", "node_id", "tier", F.col("rank").cast("long").alias("rank"))


def overview(s, d):
    """What there is of a repository: files by kind, commits, nodes by kind, edges by relation."""
    row = lambda df, section, name: df.groupBy("repo_path", F.lit(section).alias("section"), F.col(name).alias("name")).agg(F.count("*").alias("n"))
    f = _slim(s, d).select("repo_path", X.classify_path(F.col("path")).alias("name"))
    c = table(s, d, "commits", "repo_path", "sha").where("repo_path IS NOT NULL AND sha IS NOT NULL").distinct().select("repo_path", F.lit("all").alias("name"))
    return row(f, "files", "name").unionByName(row(c, "commits", "name")).unionByName(row(_nodes(s, d), "nodes", "kind")).unionByName(row(_edges(s, d), "edges", "relation"))


def context_cards(s, d):
    """For the five files of a repository with most changes: their symbols, partners and strongest links."""
    ch = history.churn(_commits(s, d))
    w = Window.partitionBy("repo_path").orderBy(F.desc("churn"), "path")
    t = ch.withColumn("n", F.row_number().over(w)).where("n <= 5").select("repo_path", "path")
    co = history.cochange(_commits(s, d))
    both = co.select("repo_path", F.col("a").alias("path"), F.col("b").alias("name"), "weight").unionByName(co.select("repo_path", F.col("b").alias("path"), F.col("a").alias("name"), "weight"))
    wp = Window.partitionBy("repo_path", "path").orderBy(F.desc("weight"), "name")
    partners = both.join(t, ["repo_path", "path"], "left_semi").withColumn("rank", F.row_number().over(wp)).where("rank <= 3").select("repo_path", "path", F.lit("partner").alias("section"), "name", F.col("rank").cast("long").alias("rank"))
    e = answers.best_neighbours(_edges(s, d), t.select("repo_path", F.concat(F.lit("file:"), "path").alias("node_id")))
    links = e.select("repo_path", F.expr("substring(node_id, 6)").alias("path"), F.lit("link").alias("section"), F.col("neighbour").alias("name"), F.col("rank").cast("long").alias("rank"))
    return partners.unionByName(links)


def declaration_ids(s, d):
    """Ids by name, with a number where a file declares a name more than once."""
    n = _nodes(s, d).where("granularity = 'symbol'").select("repo_path", "node_id", "span_start", F.concat_ws(":", F.lit("symbol"), "source_ref", "label").alias("base"))
    return resolution.numbered_declarations(n, "base", ["span_start", "node_id"]).select("repo_path", "node_id", "unique_id")


QUERIES = {f.__name__: f for f in [set_changes, degree_refresh, metadata_lines, latest_run_items, repository_states, ingest_totals, suite_figures, token_reduction, referenced_baseline, answer_keys, community_report, crossing_links, latest_events, file_symbols, riskiest_files, dead_code_order, overview, context_cards, declaration_ids]}

_COMM = f"""{_N}, {_E}, ids AS (SELECT DISTINCT repo_path, node_id, kind FROM n), lv AS (SELECT DISTINCT repo_path, node_id FROM n WHERE kind <> 'commit' AND node_id NOT LIKE 'commit:%'),
le AS (SELECT e.* FROM e WHERE NOT (layer = 'HEADING' AND relation = 'contains') AND NOT (layer = 'COCHANGE' AND coalesce(weight, 0) < 0.1) AND EXISTS (SELECT 1 FROM lv WHERE lv.repo_path = e.repo_path AND lv.node_id = e.source) AND EXISTS (SELECT 1 FROM lv WHERE lv.repo_path = e.repo_path AND lv.node_id = e.target)),
bo AS MATERIALIZED (SELECT repo_path, a, b, count(*) m FROM (SELECT repo_path, source a, target b FROM le UNION ALL SELECT repo_path, target, source FROM le) GROUP BY 1, 2, 3),
lab AS (SELECT repo_path, node_id, node_id AS label, 0 AS k, 1 AS moved FROM (SELECT DISTINCT repo_path, node_id FROM ids) UNION ALL
 SELECT repo_path, node_id, coalesce(new, label), k + 1, max(CASE WHEN new IS NOT NULL AND new <> label THEN 1 ELSE 0 END) OVER () FROM (SELECT q.*, v.label AS new FROM lab q LEFT JOIN (SELECT repo_path, a, label FROM
  (SELECT bo.repo_path, bo.a, z.label, sum(m) AS m FROM lab z JOIN bo ON bo.repo_path = z.repo_path AND bo.b = z.node_id GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY repo_path, a ORDER BY m DESC, label) = 1) v ON v.repo_path = q.repo_path AND v.a = q.node_id WHERE q.moved = 1 AND q.k < 30) x),
cm AS (SELECT repo_path, node_id, label AS community FROM lab WHERE k = (SELECT max(k) FROM lab))"""
G.ORACLE["label_communities"] = f"WITH RECURSIVE {_COMM} SELECT repo_path, community, count(*) AS size FROM cm GROUP BY 1, 2"


def _packed(items: str) -> str:
    """The greedy fold as recursion over ranks: ``items`` names repo_path, path, score, tokens."""
    return f"""bi AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY repo_path) AS many FROM (SELECT repo_path, path, tokens, row_number() OVER (PARTITION BY repo_path ORDER BY round(score, 9) DESC, path) AS rank FROM {items} WHERE score > 0 AND tokens > 0) WHERE rank <= {64 * (4000 // 16 + 1)}),
pk AS (SELECT repo_path, path, tokens, rank, least(tokens, CASE WHEN many > 1 THEN 1600 ELSE 4000 END, 4000)::BIGINT AS taken, (4000 - least(tokens, CASE WHEN many > 1 THEN 1600 ELSE 4000 END, 4000))::BIGINT AS room FROM bi WHERE rank = 1
UNION ALL SELECT b.repo_path, b.path, b.tokens, b.rank, least(b.tokens, CASE WHEN many > 1 THEN 1600 ELSE 4000 END, room)::BIGINT, (room - least(b.tokens, CASE WHEN many > 1 THEN 1600 ELSE 4000 END, room))::BIGINT FROM pk JOIN bi b ON b.repo_path = pk.repo_path AND b.rank = pk.rank + 1 WHERE pk.room > 16)"""


_TK = f"tk AS (SELECT repo_path, path, {_TOK} AS tokens FROM cur)"
_KW12 = Q._KW.replace("6) AS score\n  FROM cur c", "12) AS score\n  FROM cur c")
_PACKED = f"{_CUR}, {Q._SETS}, {_KW12}, {_TK}, it AS (SELECT sc.repo_path, sc.path, sc.score, tk.tokens FROM sc JOIN tk ON tk.repo_path = sc.repo_path AND tk.path = sc.path), {_packed('it')}"
Q.ORACLE["packed_context"] = f"WITH RECURSIVE {_PACKED} SELECT repo_path, path, tokens, taken FROM pk"

_SEEDS = f"""{_CUR}, {Q._SETS}, {_KW12}, {_TK}, ls AS (SELECT repo_path, 'keyword' AS l, path, row_number() OVER (PARTITION BY repo_path ORDER BY round(score, 9) DESC, path) AS pos FROM sc WHERE score > 0
UNION ALL SELECT repo_path, 'name', path, row_number() OVER (PARTITION BY repo_path ORDER BY path) FROM cur WHERE list_has_any(list_distinct({Q._tok(G._STEM)}), {Q._Q})),
fu AS (SELECT repo_path, path, sum(1.0 / (60 + r)) AS fused FROM (SELECT repo_path, path, row_number() OVER (PARTITION BY repo_path, l ORDER BY pos, path) AS r FROM ls) GROUP BY 1, 2),
se AS MATERIALIZED (SELECT sc.repo_path, sc.path, sc.score + 40 * coalesce(fused, 0) AS seed FROM sc LEFT JOIN fu ON fu.repo_path = sc.repo_path AND fu.path = sc.path)"""
_RANK = G._ranked("coalesce((SELECT max(seed) FROM se WHERE se.repo_path = ok.repo_path AND 'file:' || se.path = ok.node_id AND seed > 0), 0.0)", 15)
_RANK_WITH, _RANK_SELECT = _RANK[len("WITH RECURSIVE ") :].rsplit("\nSELECT ", 1)
Q.ORACLE["context_bundle"] = f"""WITH RECURSIVE {_SEEDS}, {_RANK_WITH}, rk AS (SELECT {_RANK_SELECT}),
it AS MATERIALIZED (SELECT se.repo_path, se.path, seed + 10 * coalesce(rank, 0) AS score, tk.tokens FROM se LEFT JOIN rk ON rk.repo_path = se.repo_path AND rk.node_id = 'file:' || se.path JOIN tk ON tk.repo_path = se.repo_path AND tk.path = se.path), {_packed('it')} SELECT repo_path, path, tokens, taken FROM pk"""

ORACLE = {
    "set_changes": f"""WITH {_CUR}, lg AS (SELECT repo_path, path FROM (SELECT *, row_number() OVER (PARTITION BY repo_path, path ORDER BY recorded_at DESC, op DESC) rn FROM ingest_log) WHERE rn = 1 AND op <> 'delete'),
j AS (SELECT coalesce(lg.repo_path, cur.repo_path) AS repo_path, lg.path a, cur.path b FROM lg FULL JOIN cur ON cur.repo_path = lg.repo_path AND cur.path = lg.path)
SELECT repo_path, count(CASE WHEN b IS NULL THEN 1 END) AS n_gone, count(CASE WHEN a IS NULL THEN 1 END) AS n_new, bool_or(a IS NULL OR b IS NULL) AS changed FROM j GROUP BY 1""",
    "degree_refresh": f"""WITH {_E}, {_DEG}, st AS (SELECT repo_path, node_id, max((metadata_json->>'$.degree')::BIGINT) AS stored FROM graph_nodes WHERE kind = 'file' GROUP BY 1, 2)
SELECT st.repo_path, st.node_id, coalesce(dg.degree, 0) AS degree, stored FROM st LEFT JOIN dg ON dg.repo_path = st.repo_path AND dg.node_id = st.node_id WHERE stored IS DISTINCT FROM coalesce(dg.degree, 0)""",
    "metadata_lines": "SELECT DISTINCT repo_path, node_id, (metadata_json->>'$.lineno')::BIGINT AS line, ((metadata_json->>'$.lineno')::BIGINT - span_start)::BIGINT AS off FROM graph_nodes WHERE metadata_json->>'$.lineno' IS NOT NULL",
    "latest_run_items": """WITH l AS (SELECT repo_path, run_id FROM ingest_runs QUALIFY row_number() OVER (PARTITION BY repo_path ORDER BY started_at DESC, run_id DESC) = 1),
i AS (SELECT g.repo_path, g.run_id, path, max(size_bytes) AS size_bytes FROM ingest_log g JOIN l ON l.repo_path = g.repo_path AND l.run_id = g.run_id GROUP BY 1, 2, 3) SELECT *, row_number() OVER (PARTITION BY repo_path ORDER BY size_bytes DESC NULLS LAST, path) AS rank FROM i""",
    "repository_states": f"WITH {_CUR}, f AS (SELECT repo_path, count(*) n, max(modified_at) m FROM cur GROUP BY 1) SELECT r.repo_path, updated_at, fingerprint, coalesce(n, 0) AS n_files, coalesce(m > updated_at, false) AS is_stale FROM repos r LEFT JOIN f ON f.repo_path = r.repo_path",
    "ingest_totals": "SELECT repo_path, coalesce(sum(size_bytes), 0)::BIGINT AS bytes, count(CASE WHEN op = 'delete' THEN 1 END) AS deletes, count(*) AS n_rows FROM (SELECT DISTINCT repo_path, run_id, path, op, recorded_at, size_bytes FROM ingest_log) GROUP BY 1",
    "suite_figures": f"""WITH t AS (SELECT suite, answer, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE greatest(1, round_even(len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^\\p{{L}}\\p{{N}}_\\s]|\\s+')) * 0.77, 0))::BIGINT END AS t FROM eval_items)
SELECT suite, count(*) AS n_items, round(avg(t), 6) AS mean_tokens, round(median(t), 6) AS median_tokens, round(avg(CASE WHEN answer IS NOT NULL THEN 1 ELSE 0 END), 6) AS answered FROM t GROUP BY 1""",
    "token_reduction": f"""WITH RECURSIVE {_PACKED}, c AS (SELECT repo_path, sum(tokens)::BIGINT AS corpus_tokens, count(*) AS n_sources FROM tk GROUP BY 1), p AS (SELECT repo_path, sum(taken)::BIGINT AS q, count(*) AS n FROM pk GROUP BY 1)
SELECT c.repo_path, corpus_tokens, n_sources, coalesce(q, 0) AS query_tokens, coalesce(n, 0) AS n_items, CASE WHEN q > 0 THEN round(corpus_tokens / q, 1) ELSE 0.0 END AS reduction FROM c LEFT JOIN p ON p.repo_path = c.repo_path""",
    "referenced_baseline": f"""WITH {_CUR}, {_FILES}, {_TK}, c AS (SELECT repo_path, sha, max(authored_at) AS latest FROM commits GROUP BY 1, 2), l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY repo_path ORDER BY latest DESC, sha) <= 20),
p AS (SELECT DISTINCT f.repo_path, f.path FROM f JOIN l ON l.repo_path = f.repo_path AND l.sha = f.sha) SELECT p.repo_path, count(*) AS n_files, sum(tokens)::BIGINT AS tokens FROM p JOIN tk ON tk.repo_path = p.repo_path AND tk.path = p.path GROUP BY 1""",
    "answer_keys": """SELECT DISTINCT repo_path, sha256(fingerprint || chr(30) || 'bundle' || chr(30) || '{"budget":4000,"include":["cochange","hotspots"],"task":"stale lease"}') AS key FROM repos""",
    "community_report": f"""WITH RECURSIVE {_COMM}, z AS (SELECT repo_path, community, count(*) AS size, row_number() OVER (PARTITION BY repo_path ORDER BY count(*) DESC, community) AS rank FROM cm GROUP BY 1, 2),
f AS (SELECT cm.repo_path, cm.community, cm.node_id FROM cm JOIN n ON n.repo_path = cm.repo_path AND n.node_id = cm.node_id AND n.kind = 'file' QUALIFY row_number() OVER (PARTITION BY cm.repo_path, cm.community ORDER BY cm.node_id) <= 5),
p AS (SELECT repo_path, community, string_agg(node_id, ' ' ORDER BY node_id) AS files FROM f GROUP BY 1, 2) SELECT z.repo_path, z.community, size, rank, coalesce(files, '') AS files FROM z LEFT JOIN p ON p.repo_path = z.repo_path AND p.community = z.community WHERE rank <= 10""",
    "crossing_links": f"""WITH RECURSIVE {_COMM}, {_FILES}, {_CO}, x AS (SELECT co.repo_path, co.a, co.b, co.weight FROM co JOIN cm p ON p.repo_path = co.repo_path AND p.node_id = 'file:' || co.a JOIN cm q ON q.repo_path = co.repo_path AND q.node_id = 'file:' || co.b WHERE p.community <> q.community)
SELECT repo_path, a, b, round(weight, 6) AS weight, row_number() OVER (PARTITION BY repo_path ORDER BY weight DESC, a, b) AS rank FROM x QUALIFY rank <= 5""",
    "latest_events": "SELECT event_id, event_type, round(value, 4) AS value FROM events ORDER BY ts DESC, event_id LIMIT 50",
    "file_symbols": f"WITH {_N} SELECT repo_path, source_ref AS path, count(*) AS n_symbols, string_agg(label, ' ' ORDER BY coalesce(span_start, 1073741824), node_id, label) AS symbols FROM n WHERE granularity = 'symbol' GROUP BY 1, 2",
    "riskiest_files": f"SELECT repo_path, path, risk, row_number() OVER (PARTITION BY repo_path ORDER BY risk DESC, path) AS rank FROM ({G.ORACLE['change_risk']}) QUALIFY rank <= 10",
    "dead_code_order": f"SELECT repo_path, node_id, tier, row_number() OVER (PARTITION BY repo_path ORDER BY CASE tier WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, source_ref, label, node_id) AS rank FROM ({G.ORACLE['dead_code']}) QUALIFY rank <= 20",
    "overview": f"""WITH {_CUR}, {_N}, {_E} SELECT repo_path, 'files' AS section, {Q._KIND} AS name, count(*) AS n FROM cur GROUP BY 1, 3 UNION ALL SELECT repo_path, 'commits', 'all', count(DISTINCT sha) FROM commits GROUP BY 1
UNION ALL SELECT repo_path, 'nodes', kind, count(*) FROM n GROUP BY 1, 3 UNION ALL SELECT repo_path, 'edges', relation, count(*) FROM e GROUP BY 1, 3""",
    "context_cards": f"""WITH {_E}, {_FILES}, {_CO}, t AS (SELECT repo_path, path FROM f GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY repo_path ORDER BY count(*) DESC, path) <= 5),
p AS (SELECT repo_path, a AS path, b AS name, weight FROM co UNION ALL SELECT repo_path, b, a, weight FROM co),
l AS (SELECT repo_path, source AS x, target AS y, coalesce(weight, 0) w, relation, edge_id FROM e WHERE layer = 'STRUCTURAL' AND source <> target UNION ALL SELECT repo_path, target, source, coalesce(weight, 0), relation, edge_id FROM e WHERE layer = 'STRUCTURAL' AND source <> target),
o AS (SELECT l.repo_path, t.path, y, w, relation, edge_id FROM l JOIN t ON t.repo_path = l.repo_path AND l.x = 'file:' || t.path QUALIFY row_number() OVER (PARTITION BY l.repo_path, l.x, y ORDER BY w DESC, relation DESC, edge_id DESC) = 1)
SELECT p.repo_path, p.path, 'partner' AS section, name, row_number() OVER (PARTITION BY p.repo_path, p.path ORDER BY weight DESC, name) AS rank FROM p JOIN t ON t.repo_path = p.repo_path AND t.path = p.path QUALIFY rank <= 3
UNION ALL SELECT repo_path, path, 'link', y, row_number() OVER (PARTITION BY repo_path, path ORDER BY w DESC, relation, y, edge_id) AS rank FROM o QUALIFY rank <= 3""",
    "declaration_ids": f"WITH {_N}, b AS (SELECT repo_path, node_id, 'symbol:' || source_ref || ':' || label AS base, row_number() OVER (PARTITION BY repo_path, source_ref, label ORDER BY span_start NULLS FIRST, node_id) AS i FROM n WHERE granularity = 'symbol') SELECT repo_path, node_id, CASE WHEN i = 1 THEN base ELSE base || '#' || i END AS unique_id FROM b",
}
