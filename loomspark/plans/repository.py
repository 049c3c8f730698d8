"""Queries over files and the commit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import text as X
from loomspark.operators import history, scans
from loomspark.session import table

SKIP = ["third_party", "thirdparty", "3rdparty", "vendor", "node_modules", ".git"]
_CUR = "cur AS (SELECT repo_path, path, arg_max(kind, modified_at) kind, max(modified_at) modified_at, arg_max(size_bytes, modified_at) size_bytes, arg_max(mtime_ns, modified_at) mtime_ns, arg_max(content, modified_at) AS content FROM sources GROUP BY 1, 2)"
#: A file's suffix and its lines in SQL.
_SUF = "coalesce(nullif(regexp_extract(split_part(path, '/', -1), '[^.](\\.[^.]+)$', 1), ''), '')"
_LINES = "CASE WHEN content = '' THEN [] ELSE string_split(regexp_replace(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n$', ''), chr(10)) END"


def _sources(s: SparkSession, d: str) -> DataFrame:
    return scans.current_sources(table(s, d, "sources", "repo_path", "path", "modified_at", "kind", "size_bytes", "mtime_ns", "content"))


def _slim(s: SparkSession, d: str) -> DataFrame:
    """Current files without their content, which then is never read."""
    return scans.current_sources(table(s, d, "sources", "repo_path", "path", "modified_at", "kind", "size_bytes", "mtime_ns"))


def _commits(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "commits", "repo_path", "sha", "files_json")


def source_stats(s, d):
    return _slim(s, d).select("repo_path", "path", "kind", "size_bytes", F.col("modified_at"))


def source_kinds(s, d):
    k = X.classify_path(F.col("path"))
    return _slim(s, d).groupBy("repo_path", k.alias("kind")).agg(F.count("*").alias("n_files"), F.count_if(F.col("kind").eqNullSafe(k)).alias("n_agree"))


def source_candidates(s, d):
    return scans.candidates(_sources(s, d), SKIP).select("repo_path", "path")


def content_hashes(s, d):
    return _sources(s, d).select("repo_path", "path", F.sha2("content", 256).alias("content_sha"))


def repo_fingerprints(s, d):
    line = F.concat_ws("\u0000", "path", F.col("size_bytes").cast("string"), F.col("mtime_ns").cast("string"))
    part = F.substring(F.sha2("path", 256), 1, 3)
    parts = _slim(s, d).groupBy("repo_path", part.alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("h"))
    return parts.groupBy("repo_path").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), "\n"), 256).alias("fingerprint"))


def change_classes(s, d):
    now = _sources(s, d).select("repo_path", "path", F.sha2("content", 256).alias("content_hash"), "mtime_ns")
    log = scans.latest(table(s, d, "ingest_log", "repo_path", "path", "recorded_at", "op", "content_hash", "mtime_ns"), ["repo_path", "path"], ["recorded_at"]).where("op <> 'delete'")
    return scans.classify_changes(log, now).groupBy("repo_path", "state").agg(F.count("*").alias("n_files"))


def upsert_log(s, d):
    """Stored hashes after the delta of the log has been applied to the oldest state."""
    old = scans.latest(table(s, d, "ingest_log", "repo_path", "path", "recorded_at", "op", "content_hash").withColumn("o", -F.unix_micros(F.col("recorded_at").cast("timestamp"))), ["repo_path", "path"], ["o"]).select("repo_path", "path", "content_hash")
    new = _sources(s, d).select("repo_path", "path", F.sha2("content", 256).alias("content_hash"))
    return scans.upsert(old, new, ["repo_path", "path"])


def markdown_sections(s, d):
    return scans.sections(_sources(s, d))


def token_counts(s, d):
    cur = _sources(s, d)
    return cur.select("repo_path", "path", X.segment_count(F.col("content")).cast("long").alias("segments"), X.token_estimate(F.col("content"), X.classify_path(F.col("path"))).alias("tokens"))


def corpus_tokens(s, d):
    cur = _sources(s, d).select("repo_path", X.classify_path(F.col("path")).alias("kind"), X.token_estimate(F.col("content"), X.classify_path(F.col("path"))).alias("t"))
    return cur.groupBy("repo_path", "kind").agg(F.sum("t").alias("tokens"), F.count("*").alias("n_files"))


def log_retention(s, d):
    runs = table(s, d, "ingest_runs", "repo_path", "run_id", "started_at")
    return scans.retain(runs, "repo_path", "started_at", F.lit("2023-08-15").cast("timestamp_ntz"), 8, "run_id").select("repo_path", "run_id")


def owned_edges(s, d):
    """Edges that stay when the files the log saw deleted are gone."""
    gone = scans.latest(table(s, d, "ingest_log", "repo_path", "path", "recorded_at", "op"), ["repo_path", "path"], ["recorded_at"]).where("op = 'delete'").select("repo_path", "path")
    e = table(s, d, "graph_edges", "repo_path", "edge_id", "source_file").distinct()
    return scans.delete_owned(e, gone, "source_file").groupBy("repo_path").agg(F.count("*").alias("n_edges"))


def file_churn(s, d):
    return history.churn(_commits(s, d))


def cochange_edges(s, d):
    return history.cochange(_commits(s, d)).select("repo_path", "a", "b", "n", F.round("weight", 6).alias("weight"))


def commit_touches(s, d):
    return history.touches(_commits(s, d), _slim(s, d)).groupBy("repo_path", "path").agg(F.count("*").alias("n_commits"))


def file_complexity(s, d):
    return history.complexity(_sources(s, d))


def file_hotspots(s, d):
    return history.top_hotspots(history.hotspots(_sources(s, d), _commits(s, d))).select("repo_path", "path", "churn", "complexity", "score")


def recent_commits(s, d):
    from pyspark.sql import Window

    c = scans.latest(table(s, d, "commits", "repo_path", "sha", "authored_at", "summary"), ["repo_path", "sha"], ["authored_at"])
    w = Window.partitionBy("repo_path").orderBy(F.desc("authored_at"), "sha")
    return c.withColumn("rank", F.row_number().over(w)).where("rank <= 20").select("repo_path", "sha", "authored_at", F.col("rank").cast("long").alias("rank"))


def test_pairs(s, d):
    p = _slim(s, d).select("repo_path", "path", X.test_base(F.col("path")).alias("base"), X.is_test_path(F.col("path")).alias("t"))
    a = p.where("NOT t").select("repo_path", "base", F.col("path").alias("source_path"))
    return a.join(p.where("t").select("repo_path", "base", F.col("path").alias("test_path")), ["repo_path", "base"]).select("repo_path", "source_path", "test_path")


def header_pairs(s, d):
    p = _slim(s, d).select("repo_path", "path", X.stem(F.col("path")).alias("st"), F.lower(X.suffix(F.col("path"))).alias("sf"))
    impl = p.where("sf IN ('.c', '.cpp', '.cc', '.cxx')").select("repo_path", "st", F.col("path").alias("implementation"))
    return p.where("sf IN ('.h', '.hpp', '.hh', '.hxx')").select("repo_path", "st", F.col("path").alias("header")).join(impl, ["repo_path", "st"]).select("repo_path", "header", "implementation")


QUERIES = {f.__name__: f for f in [source_stats, source_kinds, source_candidates, content_hashes, repo_fingerprints, change_classes, upsert_log, markdown_sections, token_counts, corpus_tokens, log_retention, owned_edges, file_churn, cochange_edges, commit_touches, file_complexity, file_hotspots, recent_commits, test_pairs, header_pairs]}

_CODE = "('.py','.js','.ts','.tsx','.jsx','.swift','.java','.rb','.c','.h','.cpp','.cc','.cxx','.hpp','.hh','.hxx','.qml','.go','.rs','.qmldir','.qmltypes','.qmlproject','.sh','.cmake','.qrc')"
_KIND = f"CASE WHEN {_SUF} = '.md' THEN 'markdown' WHEN lower(split_part(path, '/', -1)) = 'cmakelists.txt' OR {_SUF} IN {_CODE} THEN 'code' ELSE 'text' END"
_FILES = """f AS (SELECT DISTINCT repo_path, sha, CASE WHEN q LIKE './%' THEN substr(q, 3) ELSE q END AS path FROM
  (SELECT repo_path, sha, replace(p, '\\', '/') q FROM (SELECT repo_path, sha, unnest(from_json(files_json, '["VARCHAR"]')) p FROM commits)) WHERE trim(q) <> '')"""
_SEG = "len(regexp_extract_all(content, '[A-Za-z0-9_]+|[^\\p{L}\\p{N}_\\s]|\\s+'))"
_TOK = f"CASE WHEN content = '' THEN 0 ELSE greatest(1, round_even({_SEG} * CASE ({_KIND}) WHEN 'code' THEN 0.74 WHEN 'markdown' THEN 0.67 ELSE 0.77 END, 0))::BIGINT END"
_STEM = "regexp_replace(split_part(path, '/', -1), '([^.])\\.[^.]+$', '\\1')"
_TEST = f"(list_contains(string_split(path, '/'), 'tests') OR starts_with(lower({_STEM}), 'test_') OR ends_with(lower({_STEM}), '_test'))"
_BASE = f"regexp_replace(regexp_replace({_STEM}, '^(test_)+', ''), '(_test)+$', '')"
_LANG = f"CASE WHEN lower({_SUF}) = '.py' THEN 'python' WHEN lower({_SUF}) IN ('.c','.h','.cpp','.cc','.cxx','.hpp','.hh','.hxx') THEN 'cpp' WHEN lower({_SUF}) IN ('.qml','.js','.jsx','.ts','.tsx') THEN 'qml' ELSE 'generic' END"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_BY_WORDS = " ".join(f"WHEN '{k}' THEN len(regexp_extract_all(c, '\\b(?:{'|'.join(w)})\\b'))" for k, w in history.BRANCH_WORDS.items())
_CPLX = f"""code AS (SELECT repo_path, path, {_LANG} AS lang, len({_LINES}) AS nl, CASE WHEN ({_LANG}) = 'python' THEN regexp_replace(content, {_q(history.MASK_PYTHON)}, ' \\1\\2\\3\\4', 'g')
  ELSE regexp_replace(content, {_q(history.MASK_OTHER)}, ' \\1\\2\\3\\4\\5', 'g') END AS c FROM cur),
br AS (SELECT repo_path, path, nl, CASE lang {_BY_WORDS} END
  + CASE WHEN lang IN ('cpp', 'qml') THEN len(regexp_extract_all(c, '&&')) + len(regexp_extract_all(c, '\\|\\|')) + len(regexp_extract_all(c, '\\?')) - len(regexp_extract_all(c, '\\?=')) ELSE 0 END
  + CASE WHEN lang = 'qml' THEN len(regexp_extract_all(c, {_q(history.BINDING)})) - len(regexp_extract_all(c, {_q(history.NO_BINDING)})) ELSE 0 END AS b FROM code),
cx AS (SELECT repo_path, path, b::BIGINT AS branches, CASE WHEN b <= 0 THEN 0 ELSE greatest(1, round_even(b * 1000 / greatest(1, nl), 0))::BIGINT END AS complexity FROM br)"""

ORACLE = {
    "source_stats": f"WITH {_CUR} SELECT repo_path, path, kind, size_bytes, modified_at FROM cur",
    "source_kinds": f"WITH {_CUR} SELECT repo_path, {_KIND} AS kind, count(*) AS n_files, sum(CASE WHEN kind IS NOT DISTINCT FROM ({_KIND}) THEN 1 ELSE 0 END)::BIGINT AS n_agree FROM cur GROUP BY 1, ({_KIND})",
    "content_hashes": f"WITH {_CUR} SELECT repo_path, path, sha256(content) AS content_sha FROM cur",
    "repo_fingerprints": f"""WITH {_CUR}, p AS (SELECT repo_path, substr(sha256(path), 1, 3) part, sha256(string_agg(path || chr(0) || size_bytes || chr(0) || mtime_ns, chr(10) ORDER BY path || chr(0) || size_bytes || chr(0) || mtime_ns)) h FROM cur GROUP BY 1, 2)
SELECT repo_path, sha256(string_agg(h, chr(10) ORDER BY part, h)) AS fingerprint FROM p GROUP BY 1""",
    "change_classes": f"""WITH {_CUR}, n AS (SELECT repo_path, path, sha256(content) h, mtime_ns m FROM cur),
lg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_path, path ORDER BY recorded_at DESC, op DESC, content_hash DESC, mtime_ns DESC) rn FROM ingest_log) WHERE rn = 1 AND op <> 'delete'),
j AS (SELECT coalesce(n.repo_path, lg.repo_path) repo_path, CASE WHEN lg.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN lg.content_hash IS DISTINCT FROM n.h THEN 'changed' WHEN lg.mtime_ns IS DISTINCT FROM n.m THEN 'restat' ELSE 'unchanged' END AS state
FROM n FULL JOIN lg ON n.repo_path = lg.repo_path AND n.path = lg.path) SELECT repo_path, state, count(*) AS n_files FROM j GROUP BY 1, 2""",
    "upsert_log": f"""WITH {_CUR}, old AS (SELECT repo_path, path, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY repo_path, path ORDER BY recorded_at, op DESC, content_hash DESC) rn FROM ingest_log) WHERE rn = 1),
new AS (SELECT repo_path, path, sha256(content) AS content_hash FROM cur)
SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.repo_path = old.repo_path AND n.path = old.path) UNION ALL SELECT * FROM new""",
    "markdown_sections": f"""WITH {_CUR}, l AS (SELECT repo_path, path, unnest(range(1, len(x) + 1)) AS line, unnest(x) AS t FROM (SELECT repo_path, path, {_LINES} AS x FROM cur WHERE {_SUF} = '.md')),
h AS (SELECT repo_path, path, line, trim(ltrim(t, '#'), ' ') AS title FROM l WHERE t LIKE '#%')
SELECT repo_path, path, row_number() OVER (PARTITION BY repo_path, path ORDER BY line) AS ordinal, line, title FROM h WHERE title <> ''""",
    "token_counts": f"WITH {_CUR} SELECT repo_path, path, {_SEG}::BIGINT AS segments, {_TOK} AS tokens FROM cur",
    "corpus_tokens": f"WITH {_CUR}, t AS (SELECT repo_path, {_KIND} AS kind, {_TOK} AS t FROM cur) SELECT repo_path, kind, sum(t)::BIGINT AS tokens, count(*) AS n_files FROM t GROUP BY 1, 2",
    "log_retention": "SELECT repo_path, run_id FROM (SELECT *, row_number() OVER (PARTITION BY repo_path ORDER BY started_at DESC, run_id DESC) n FROM ingest_runs WHERE started_at >= TIMESTAMP '2023-08-15') WHERE n <= 8",
    "owned_edges": """WITH gone AS (SELECT repo_path, path FROM (SELECT *, row_number() OVER (PARTITION BY repo_path, path ORDER BY recorded_at DESC, op DESC) rn FROM ingest_log) WHERE rn = 1 AND op = 'delete')
SELECT repo_path, count(*) AS n_edges FROM (SELECT DISTINCT repo_path, edge_id, source_file FROM graph_edges) e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.repo_path = e.repo_path AND g.path = e.source_file) GROUP BY 1""",
    "file_churn": f"WITH {_FILES} SELECT repo_path, path, count(*) AS churn FROM f GROUP BY 1, 2",
    "cochange_edges": f"""WITH {_FILES}, ok AS (SELECT repo_path, sha FROM f GROUP BY 1, 2 HAVING count(*) <= 50), g AS (SELECT f.* FROM f JOIN ok USING (repo_path, sha)),
p AS (SELECT x.repo_path, x.path a, y.path b, count(*) n FROM g x JOIN g y ON x.repo_path = y.repo_path AND x.sha = y.sha AND x.path < y.path GROUP BY 1, 2, 3)
SELECT repo_path, a, b, n, round(n::DOUBLE / max(n) OVER (PARTITION BY repo_path), 6) AS weight FROM p""",
    "commit_touches": f"WITH {_CUR}, {_FILES} SELECT f.repo_path, f.path, count(*) AS n_commits FROM f JOIN cur ON cur.repo_path = f.repo_path AND cur.path = f.path GROUP BY 1, 2",
    "file_complexity": f"WITH {_CUR}, {_CPLX} SELECT repo_path, path, branches, complexity FROM cx",
    "file_hotspots": f"""WITH {_CUR}, {_CPLX}, {_FILES}, ch AS (SELECT repo_path, path, count(*) AS churn FROM f GROUP BY 1, 2),
h AS (SELECT cx.repo_path, cx.path, coalesce(churn, 0) AS churn, complexity, coalesce(churn, 0) * complexity AS score FROM cx LEFT JOIN ch ON ch.repo_path = cx.repo_path AND ch.path = cx.path)
SELECT * FROM h WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY repo_path ORDER BY score DESC, churn DESC, complexity DESC, path) <= 10""",
    "recent_commits": """WITH c AS (SELECT repo_path, sha, max(authored_at) authored_at FROM commits GROUP BY 1, 2)
SELECT * FROM (SELECT repo_path, sha, authored_at, row_number() OVER (PARTITION BY repo_path ORDER BY authored_at DESC, sha) AS rank FROM c) WHERE rank <= 20""",
    "test_pairs": f"WITH {_CUR}, p AS (SELECT repo_path, path, {_BASE} AS base, {_TEST} AS t FROM cur) SELECT a.repo_path, a.path AS source_path, b.path AS test_path FROM p a JOIN p b ON a.repo_path = b.repo_path AND a.base = b.base WHERE NOT a.t AND b.t",
    "header_pairs": f"WITH {_CUR}, p AS (SELECT repo_path, path, {_STEM} AS st, lower({_SUF}) AS sf FROM cur) SELECT a.repo_path, a.path AS header, b.path AS implementation FROM p a JOIN p b ON a.repo_path = b.repo_path AND a.st = b.st WHERE a.sf IN ('.h', '.hpp', '.hh', '.hxx') AND b.sf IN ('.c', '.cpp', '.cc', '.cxx')",
}
ORACLE["source_candidates"] = f"""WITH {_CUR} SELECT repo_path, path FROM cur WHERE octet_length(encode(content)) <= 5242880 AND (lower({_SUF}) IN ('.md','.txt','.json','.yaml','.yml','.toml','.ui','.pro') OR lower({_SUF}) IN {_CODE})
AND NOT list_has_any(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1), ['third_party','thirdparty','3rdparty','vendor','node_modules','.git'])"""
