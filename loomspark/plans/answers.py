"""Queries of explanations, references, rendered code, and lists cut to budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions import text as X
from loomspark.operators import answers, code_text, governance, graphs, history, retrieval, scans
from loomspark.plans.graph import _DEG, _E, _N, _TP, _edges, _nodes
from loomspark.plans.repository import _CPLX, _CUR, _FILES, _LINES, _SUF, _TOK, _commits, _slim, _sources
from loomspark.plans.search import _KW, _Q, _SETS, ORACLE as SEARCH, SYMBOL, TASK, WORDS, _bundle_scores, _tok
from loomspark.session import materialize, table

HINTED = "Where does the python scanner mask a stale lease of the ledger?"
SYNONYMS = {"ledger": ["journal", "audit log"], "stale lease": ["expired"]}


def edge_origins(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "graph_edges", "repo_path", "edge_id", "layer").where("repo_path IS NOT NULL AND edge_id IS NOT NULL").distinct()
    return e.groupBy("repo_path", answers.edge_origin(F.col("edge_id"), F.coalesce("layer", F.lit(""))).alias("origin")).agg(F.count("*").alias("n_edges"))


def _shown(s, d, direction):
    n, e = _nodes(s, d), _edges(s, d)
    hit = answers.with_endpoints(n, answers.matching_edges(n, e, "lease", direction))
    text = F.concat_ws(" | ", "relation", "source_shown", "target_shown")
    return answers.budget_prefix(hit.withColumn("text", text), ["repo_path"], ["edge_id"], X.token_estimate(F.col("text"), F.lit("text")), 2000).select("repo_path", "edge_id", "text", "used")


def relations_in(s, d):
    """Edges that lead to what matches, rendered, as many as 2000 tokens hold."""
    return _shown(s, d, "in")


def relations_out(s, d):
    return _shown(s, d, "out")


def context_neighbours(s, d):
    """The three best neighbours of every class."""
    n = _nodes(s, d)
    b = answers.best_neighbours(_edges(s, d), n.where("kind = 'class'"))
    return b.select("repo_path", "node_id", "neighbour", "relation", "direction", F.bround("weight", 3).alias("weight"), F.col("rank").cast("long").alias("rank"))


def why_chosen(s, d):
    """Edges from every function to the classes a task names."""
    n = _nodes(s, d)
    seeds = n.where("kind = 'class' AND label ILIKE '%lease%'")
    w = answers.seed_links(_edges(s, d), n.where("kind IN ('func', 'file')"), seeds)
    return w.select("repo_path", "node_id", "seed", "relation", F.bround("weight", 3).alias("weight"), F.col("rank").cast("long").alias("rank"))


def why_terms(s, d):
    """Up to eight of the task's terms that a file holds."""
    t = _sources(s, d).select("repo_path", "path", F.array_sort(F.array_intersect(X.term_set(F.col("content")), F.array(*[F.lit(t) for t in retrieval.query_terms(s, TASK)]))).alias("m"))
    return t.where("size(m) > 0").select("repo_path", "path", F.array_join(F.slice("m", 1, 8), " ").alias("matched"), F.size("m").cast("long").alias("n_matched"))


def target_status(s, d):
    """Whether the labels that begin with 'drain', and one that nothing has, name one node of a repository."""
    n = _nodes(s, d)
    t = n.where("label ILIKE 'drain%'").select("repo_path", F.col("label").alias("target")).unionByName(n.select("repo_path", F.lit("no such thing").alias("target")))
    return answers.match_status(n, t).select("repo_path", "target", "n_matches", "status")


def reference_union(s, d):
    """Uses of a symbol by the graph and by the text."""
    return answers.reference_hits(_nodes(s, d), _edges(s, d), _sources(s, d), governance.mentions(_sources(s, d), SYMBOL), SYMBOL)


def dead_code_lines(s, d):
    n = _nodes(s, d)
    return code_text.usage_tiers(governance.unused_symbols(n, _edges(s, d)), n, _sources(s, d))


def numbered_bodies(s, d):
    b = code_text.numbered_bodies(_nodes(s, d), _sources(s, d))
    return b.select("repo_path", "node_id", F.sha2("body", 256).alias("body_sha"))


def skeletons(s, d):
    k = code_text.skeletons(_nodes(s, d), _sources(s, d))
    return k.select("repo_path", "path", "n_lines", F.sha2("skeleton", 256).alias("skeleton_sha"))


def chunk_texts(s, d):
    c = code_text.chunk_texts(_nodes(s, d), _sources(s, d))
    return c.select("repo_path", "node_id", "path", F.sha2("chunk", 256).alias("chunk_sha"))


def near_markers(s, d):
    return code_text.near_markers(_nodes(s, d), _sources(s, d), r"\bLIMIT\b")


def python_exposure(s, d):
    """Decorated definitions and names handed on, per repository."""
    return code_text.python_exposure(_sources(s, d)).groupBy("repo_path", "what").agg(F.count("*").alias("n_names"))


def qualified_names(s, d):
    n = _nodes(s, d).where("granularity = 'symbol'")
    return n.select("repo_path", "node_id", code_text.qualified_name(F.col("node_id"), F.col("label")).alias("qualified"), answers.shown_signature(F.col("signature")).alias("signature"))


def note_names(s, d):
    """File names for all nodes, one folder a repository."""
    return code_text.safe_names(_nodes(s, d).select("repo_path", "node_id", "label"), "repo_path", "label", "node_id").select("repo_path", "node_id", "file_name")


def parsed_locations(s, d):
    n = _nodes(s, d).select("repo_path", "node_id", F.concat_ws(":", "source_ref", F.col("span_start").cast("string")).alias("text"))
    at = code_text.location(F.col("text"))
    return n.select("repo_path", "node_id", at["path"].alias("path"), at["line"].alias("line"))


def identifier_queries(s, d):
    """Which labels and section titles name a symbol."""
    return _nodes(s, d).select("repo_path", "node_id", answers.looks_like_identifier(F.col("label")).alias("is_identifier"))


def content_search(s, d):
    """BM25 over contents and their identifiers' parts, best fifty of all files, with a snippet of each."""
    src = _sources(s, d).where("content IS NOT NULL")
    key = src.select(F.struct("repo_path", "path").alias("k"), F.concat_ws(" ", "content", F.array_join(X.search_tokens(F.col("content")), " ")).alias("text"))
    top = retrieval.bm25(key, "k", "text", WORDS).select("key.repo_path", "key.path", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "repo_path", "path").limit(50)
    j = src.join(F.broadcast(top), ["repo_path", "path"])  # fifty rows
    return j.select("repo_path", "path", "score", F.coalesce(code_text.snippet(F.col("content"), WORDS.split()), F.lit("")).alias("snippet"))


def tuned_ranking(s, d):
    """Keyword scores with the query's synonyms, language and the files' hotspots."""
    src = _sources(s, d)
    terms = answers.expand_terms(retrieval.query_terms(s, HINTED), SYNONYMS)
    k = retrieval.keyword_scores(src, " ".join(terms))
    h = history.hotspots(src, _commits(s, d)).select("repo_path", "path", F.col("score").alias("hot"))
    most = h.groupBy("repo_path").agg(F.max("hot").alias("most"))
    j = k.join(h, ["repo_path", "path"], "left").join(most, "repo_path", "left")
    boosted = F.when(F.col("score") > 0, F.col("score") * answers.hotspot_factor(F.col("hot"), F.col("most")) * answers.language_factor(HINTED, terms, F.col("path"))).otherwise(F.col("score"))
    w = Window.partitionBy("repo_path").orderBy(F.desc("final"), "path")
    return j.withColumn("final", F.round(boosted, 5)).withColumn("rank", F.row_number().over(w)).where("rank <= 30").select("repo_path", "path", "final", F.col("rank").cast("long").alias("rank"))


def best_file_symbols(s, d):
    """The three best connected symbols of every file."""
    n = _nodes(s, d).where("granularity = 'symbol'").select("repo_path", F.col("source_ref").alias("path"), "node_id")
    j = n.join(graphs.degrees(_edges(s, d)), ["repo_path", "node_id"], "left").fillna(0, ["degree"])
    w = Window.partitionBy("repo_path", "path").orderBy(F.desc("degree"), "node_id")
    return j.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("repo_path", "path", "node_id", "degree", F.col("rank").cast("long").alias("rank"))


def best_labels(s, d):
    """For every vector whose id is divisible by 100: all labels by their nearest vector."""
    v = table(s, d, "embeddings", "vec_id", "embedding", "label").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    return retrieval.nearest_labels(v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"), q).select("qid", "label", "id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


def span_bundle(s, d):
    """Files, spans of symbols, skeletons and commits that 4000 tokens hold, for every repository."""
    src = materialize(_sources(s, d))
    terms = retrieval.query_terms(s, TASK)
    q = F.array(*[F.lit(t) for t in terms])
    idf = materialize(retrieval.task_idf(src.select("repo_path", "path", X.term_set(F.col("content")).alias("terms")), ["path"], terms))
    weigh = lambda rows, key: rows.select("repo_path", key, F.explode(F.array_intersect("terms", q)).alias("term")).join(idf, ["repo_path", "term"]).groupBy("repo_path", key).agg((10 * F.sum("idf")).alias("words"))
    files = materialize(_bundle_scores(s, d).select("repo_path", "path", "score", "tokens"))
    bodies = spans_of(s, d, src)
    named = F.when(F.arrays_overlap(X.term_set(F.col("label")), q), 100.0).otherwise(0.0)
    hit = bodies.join(weigh(bodies, "node_id"), ["repo_path", "node_id"], "left").withColumn("own", named + F.coalesce("words", F.lit(0.0))).where("own > 0")
    hit = hit.join(files.select("repo_path", "path", F.col("score").alias("file_score"), F.col("tokens").alias("file_tokens")), ["repo_path", "path"])
    hit = materialize(hit.select("repo_path", "path", "node_id", F.round(F.col("own") + 0.25 * F.col("file_score"), 9).alias("score"), "tokens", "file_tokens"))
    code = X.classify_path(F.col("path")) == "code"
    spans = hit.groupBy("repo_path", "path").agg(F.collect_list(F.struct("score", F.col("node_id").alias("id"), "tokens")).alias("spans"))
    bones = code_text.skeletons(_nodes(s, d), src).select("repo_path", "path", X.token_estimate(F.col("skeleton"), F.lit("code")).alias("skeleton_tokens"))
    f = files.join(spans, ["repo_path", "path"], "left").join(bones, ["repo_path", "path"], "left")
    none = F.lit(None).cast("long")
    of_file = f.select(F.col("repo_path").alias("group"), F.col("path").alias("id"), F.lit("file").alias("kind"), "path", F.round("score", 9).alias("score"), "tokens", code.alias("is_code"), (X.classify_path(F.col("path")) == "markdown").alias("is_doc"), "skeleton_tokens", "spans", F.lit(None).cast("string").alias("file_id"), none.alias("file_tokens"))
    of_symbol = hit.select(F.col("repo_path").alias("group"), F.col("node_id").alias("id"), F.lit("symbol").alias("kind"), "path", "score", "tokens", code.alias("is_code"), F.lit(False).alias("is_doc"), none.alias("skeleton_tokens"), F.lit(None).cast("array<struct<score:double,id:string,tokens:bigint>>").alias("spans"), F.col("path").alias("file_id"), "file_tokens")
    c = scans.latest(table(s, d, "commits", "repo_path", "sha", "authored_at", "summary"), ["repo_path", "sha"], ["authored_at"]).withColumn("terms", X.term_set(F.coalesce("summary", F.lit(""))))
    c = c.join(weigh(c, "sha"), ["repo_path", "sha"])
    of_commit = c.select(F.col("repo_path").alias("group"), F.col("sha").alias("id"), F.lit("commit").alias("kind"), F.lit("").alias("path"), F.round("words", 9).alias("score"), X.token_estimate(F.coalesce("summary", F.lit("")), F.lit("text")).alias("tokens"), F.lit(False).alias("is_code"), F.lit(False).alias("is_doc"), none.alias("skeleton_tokens"), F.lit(None).cast("array<struct<score:double,id:string,tokens:bigint>>").alias("spans"), F.lit(None).cast("string").alias("file_id"), none.alias("file_tokens"))
    p = retrieval.pack_candidates(of_file.unionByName(of_symbol).unionByName(of_commit))
    return p.select(F.col("group").alias("repo_path"), F.col("rank").cast("long").alias("rank"), "id", "kind", "path", "taken")


def spans_of(s, d, src):
    """Symbols with the terms and tokens of their bodies."""
    j = code_text.spanned(_nodes(s, d)).join(code_text.file_lines(src), ["repo_path", "path"])
    body = F.array_join(F.slice("ls", F.col("span_start"), F.col("span_end") - F.col("span_start") + 1), "\n")
    return j.withColumn("body", body).select("repo_path", "path", "node_id", "label", X.term_set(F.col("body")).alias("terms"), X.token_estimate(F.col("body"), F.lit("code")).alias("tokens"))


QUERIES = {f.__name__: f for f in [edge_origins, relations_in, relations_out, context_neighbours, why_chosen, why_terms, target_status, reference_union, dead_code_lines, numbered_bodies, skeletons, chunk_texts, near_markers, python_exposure, qualified_names, note_names, parsed_locations, identifier_queries, content_search, tuned_ranking, best_file_symbols, best_labels, span_bundle]}

_SHOW = lambda a, end: f"coalesce({a}.label || ' @ ' || {a}.source_ref || coalesce(':' || {a}.span_start, ''), CASE WHEN {end} LIKE 'symbol:%' THEN list_last(string_split({end}, ':')) ELSE regexp_replace({end}, '^(name|file|module):', '') END)"
_EST = lambda c: f"greatest(1, round_even(len(regexp_extract_all({c}, '[A-Za-z0-9_]+|[^\\p{{L}}\\p{{N}}_\\s]|\\s+')) * 0.77, 0))::BIGINT"


def _relations(end: str) -> str:
    a = "x" if end == "source" else "y"
    return f"""WITH {_N}, {_E}, h AS (SELECT e.repo_path, e.edge_id, e.relation || ' | ' || {_SHOW('x', 'e.source')} || ' | ' || {_SHOW('y', 'e.target')} AS text FROM e LEFT JOIN n x ON x.repo_path = e.repo_path AND x.node_id = e.source
LEFT JOIN n y ON y.repo_path = e.repo_path AND y.node_id = e.target WHERE e.{end} ILIKE '%lease%' OR coalesce({a}.label ILIKE '%lease%', false)),
c AS (SELECT *, sum({_EST('text')}) OVER (PARTITION BY repo_path ORDER BY edge_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM h) SELECT * FROM c WHERE used <= 2000"""


_L = f"l AS (SELECT repo_path, path, {_LINES} AS ls FROM cur)"
_S = "s AS (SELECT DISTINCT repo_path, source_ref AS path, node_id, label, kind, signature, span_start, span_end FROM n WHERE granularity = 'symbol' AND span_start >= 1 AND span_end >= span_start)"
_IMP = lambda x: f"regexp_matches({x}, '^\\s*(import |from |#include |use |require |package )')"
_COM = lambda x: f"regexp_matches({x}, '^\\s*(#|//|/\\*|\\*)')"
_X = f"lx AS (SELECT repo_path, path, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS line FROM l)"
_HQ = "['" + "','".join("audit expired journal lease ledger log mask python scanner stale".split()) + "']"


ORACLE = {
    "edge_origins": """SELECT repo_path, CASE WHEN edge_id LIKE 'regex:%' THEN 'regex-parser' WHEN edge_id LIKE 'treesitter:%' OR edge_id LIKE 'ts:%' THEN 'treesitter-parser' WHEN edge_id LIKE 'ast:%' THEN 'ast-parser' WHEN edge_id LIKE 'cochange:%' THEN 'git-history'
WHEN edge_id LIKE 'semantic:%' THEN 'llm' WHEN layer = 'COCHANGE' THEN 'git-history' WHEN layer = 'HEADING' THEN 'markdown-parser' ELSE 'unknown' END AS origin, count(*) AS n_edges FROM (SELECT DISTINCT repo_path, edge_id, layer FROM graph_edges) GROUP BY 1, 2""",
    "relations_in": _relations("target"),
    "relations_out": _relations("source"),
    "context_neighbours": f"""WITH {_N}, {_E}, b AS (SELECT repo_path, source AS node_id, target AS neighbour, coalesce(weight, 0) w, relation, edge_id, 'out' AS direction FROM e WHERE layer = 'STRUCTURAL' AND source <> target
UNION ALL SELECT repo_path, target, source, coalesce(weight, 0), relation, edge_id, 'in' FROM e WHERE layer = 'STRUCTURAL' AND source <> target),
o AS (SELECT b.* FROM b WHERE EXISTS (SELECT 1 FROM n WHERE n.repo_path = b.repo_path AND n.node_id = b.node_id AND kind = 'class') QUALIFY row_number() OVER (PARTITION BY repo_path, node_id, neighbour ORDER BY w DESC, relation DESC, edge_id DESC, direction DESC) = 1)
SELECT repo_path, node_id, neighbour, relation, direction, round_even(w, 3) AS weight, row_number() OVER (PARTITION BY repo_path, node_id ORDER BY w DESC, relation, neighbour, edge_id) AS rank FROM o QUALIFY rank <= 3""",
    "why_chosen": f"""WITH {_N}, {_E}, sd AS (SELECT DISTINCT repo_path, node_id FROM n WHERE kind = 'class' AND label ILIKE '%lease%'), it AS (SELECT DISTINCT repo_path, node_id FROM n WHERE kind IN ('func', 'file')),
b AS (SELECT repo_path, source AS node_id, target AS seed, relation, weight, edge_id FROM e WHERE coalesce(weight, 0) >= 0.3 AND source <> target UNION SELECT repo_path, target, source, relation, weight, edge_id FROM e WHERE coalesce(weight, 0) >= 0.3 AND source <> target)
SELECT b.repo_path, b.node_id, b.seed, relation, round_even(weight, 3) AS weight, row_number() OVER (PARTITION BY b.repo_path, b.node_id ORDER BY weight DESC, relation, seed, edge_id) AS rank FROM b JOIN sd ON sd.repo_path = b.repo_path AND sd.node_id = b.seed JOIN it ON it.repo_path = b.repo_path AND it.node_id = b.node_id QUALIFY rank <= 5""",
    "why_terms": f"WITH {_CUR}, m AS (SELECT repo_path, path, list_sort(list_intersect(list_distinct({_tok('content')}), {_Q})) AS m FROM cur) SELECT repo_path, path, array_to_string(list_slice(m, 1, 8), ' ') AS matched, len(m) AS n_matched FROM m WHERE len(m) > 0",
    "target_status": f"""WITH {_N}, t AS (SELECT DISTINCT repo_path, label AS target FROM n WHERE label ILIKE 'drain%' UNION SELECT DISTINCT repo_path, 'no such thing' FROM n),
k AS (SELECT repo_path, node_id, node_id AS target FROM n UNION SELECT repo_path, node_id, label FROM n UNION SELECT repo_path, node_id, source_ref FROM n WHERE granularity = 'file')
SELECT t.repo_path, t.target, count(DISTINCT k.node_id) AS n_matches, CASE count(DISTINCT k.node_id) WHEN 0 THEN 'missing' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status FROM t LEFT JOIN k ON k.repo_path = t.repo_path AND k.target = t.target GROUP BY 1, 2""",
    "reference_union": f"""WITH {_N}, {_E}, r AS ({SEARCH['references'].replace('LIMIT', SYMBOL)}),
h AS (SELECT e.* FROM e LEFT JOIN n y ON y.repo_path = e.repo_path AND y.node_id = e.target WHERE e.target ILIKE '%{SYMBOL}%' OR coalesce(y.label ILIKE '%{SYMBOL}%', false) QUALIFY row_number() OVER (PARTITION BY e.repo_path ORDER BY e.edge_id) <= 200),
u AS (SELECT repo_path, source AS node_id, edge_id, 0 AS side, CASE WHEN relation IN ('writes', 'binds', 'aliases') THEN 'write' WHEN relation IN ('reads', 'calls') THEN 'read' ELSE 'definition' END AS access FROM h
UNION ALL SELECT repo_path, target, edge_id, 1, CASE WHEN relation IN ('writes', 'binds', 'aliases', 'references', 'exports') THEN 'write' WHEN relation IN ('reads', 'calls') THEN 'read' ELSE 'definition' END FROM h),
g AS (SELECT n.repo_path, n.source_ref AS path, n.span_start::BIGINT AS line, arg_min(access, (edge_id, side)) AS access FROM u JOIN n ON n.repo_path = u.repo_path AND n.node_id = u.node_id WHERE span_start IS NOT NULL AND contains(lower(label), lower('{SYMBOL}')) GROUP BY 1, 2, 3)
SELECT repo_path, path, line, 'graph' AS origin, access FROM g UNION ALL SELECT repo_path, path, line, 'text', access FROM r WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.repo_path = r.repo_path AND g.path = r.path AND g.line = r.line)""",
    "numbered_bodies": f"""WITH {_CUR}, {_N}, {_L}, {_S} SELECT s.repo_path, node_id, sha256(array_to_string(list_transform(list_slice(ls, span_start, span_end), lambda x, i: (i + span_start - 1) || ': ' || x), chr(10))) AS body_sha FROM s JOIN l ON l.repo_path = s.repo_path AND l.path = s.path""",
    "skeletons": f"""WITH {_CUR}, {_N}, {_L}, {_S}, {_X}, k AS (SELECT lx.repo_path, lx.path, lx.n, lx.line, bool_or(coalesce(s.span_start = lx.n, false)) AS first, bool_or(coalesce(s.span_start = lx.n AND s.span_end > lx.n, false)) AS more, bool_or(s.span_start IS NOT NULL) AS inside
FROM lx LEFT JOIN s ON s.repo_path = lx.repo_path AND s.path = lx.path AND lx.n BETWEEN s.span_start AND s.span_end WHERE EXISTS (SELECT 1 FROM s z WHERE z.repo_path = lx.repo_path AND z.path = lx.path) GROUP BY 1, 2, 3, 4),
p AS (SELECT repo_path, path, n, 0 AS o, line AS t FROM k WHERE first OR (NOT inside AND {_IMP('line')}) UNION ALL SELECT repo_path, path, n, 1, regexp_extract(line, '^([ \\t]*)', 1) || '    ...' FROM k WHERE more),
a AS (SELECT repo_path, path, count(*) AS n_lines, string_agg(t, chr(10) ORDER BY n, o) AS sk FROM p GROUP BY 1, 2)
SELECT f.repo_path, f.path, coalesce(n_lines, 0) AS n_lines, sha256(coalesce(sk, '')) AS skeleton_sha FROM (SELECT DISTINCT s.repo_path, s.path FROM s JOIN l ON l.repo_path = s.repo_path AND l.path = s.path) f LEFT JOIN a ON a.repo_path = f.repo_path AND a.path = f.path""",
    "chunk_texts": f"""WITH {_CUR}, {_N}, {_L}, {_S}, j AS (SELECT s.*, ls, coalesce(list_max(list_filter(range(1, span_start), lambda i: NOT {_COM('ls[i]')})), 0) AS o FROM s JOIN l ON l.repo_path = s.repo_path AND l.path = s.path WHERE span_start <= len(ls))
SELECT repo_path, node_id, path, sha256(array_to_string(list_concat(list_concat(CASE WHEN coalesce(signature, '') = '' THEN []::VARCHAR[] ELSE [signature] END, list_slice(ls, o + 1, span_start - 1)), list_slice(ls, span_start, least(span_end, span_start + 11))), chr(10))) AS chunk_sha FROM j""",
    "near_markers": f"""WITH {_CUR}, {_N}, {_L}, {_S}, {_X} SELECT s.repo_path, s.node_id, count(DISTINCT lx.n) AS n_lines, min(lx.n) AS first_line FROM s JOIN lx ON lx.repo_path = s.repo_path AND lx.path = s.path AND lx.n BETWEEN s.span_start - 20 AND s.span_end + 20 WHERE regexp_matches(line, '\\bLIMIT\\b') GROUP BY 1, 2""",
    "qualified_names": f"WITH {_N} SELECT repo_path, node_id, CASE WHEN len(string_split(node_id, ':')) >= 3 THEN regexp_extract(node_id, '^[^:]*:[^:]*:(.*)$', 1, 's') ELSE label END AS qualified, CASE WHEN length(signature) > 200 THEN substr(signature, 1, 200) || '…' ELSE signature END AS signature FROM n WHERE granularity = 'symbol'",
    "note_names": f"""WITH {_N}, p AS (SELECT repo_path, node_id, regexp_replace(trim(regexp_replace(label, '[^A-Za-z0-9._-]+', '_', 'g')), '^[_.]+|[_.]+$', '', 'g') AS q FROM n), r AS (SELECT repo_path, node_id, CASE WHEN q = '' THEN 'unnamed' ELSE q END AS q FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY repo_path, lower(q) ORDER BY node_id) AS i FROM r) SELECT repo_path, node_id, CASE WHEN i = 1 THEN q ELSE q || '_' || i END AS file_name FROM k""",
    "parsed_locations": f"WITH {_N} SELECT repo_path, node_id, CASE WHEN span_start IS NOT NULL THEN source_ref END AS path, span_start::BIGINT AS line FROM n",
    "identifier_queries": f"WITH {_N} SELECT repo_path, node_id, contains(label, '::') OR len(list_filter(regexp_extract_all(label, '[A-Za-z_][A-Za-z0-9_:]*'), lambda x: contains(trim(x, '_'), '_') OR regexp_matches(x, '[a-z0-9][A-Z]'))) > 0 AS is_identifier FROM n",
    "best_file_symbols": f"WITH {_N}, {_E}, {_DEG} SELECT n.repo_path, n.source_ref AS path, n.node_id, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY n.repo_path, n.source_ref ORDER BY coalesce(degree, 0) DESC, n.node_id) AS rank FROM n LEFT JOIN dg ON dg.repo_path = n.repo_path AND dg.node_id = n.node_id WHERE granularity = 'symbol' QUALIFY rank <= 3",
    "best_labels": """WITH q AS (SELECT vec_id qid, embedding qv FROM embeddings WHERE vec_id % 100 = 0), c AS (SELECT qid, vec_id AS id, label, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), list_transform(qv, lambda x: x::DOUBLE)) AS score FROM embeddings, q WHERE vec_id <> qid),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, id) = 1) SELECT qid, label, id, round(score, 5) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM b""",
    "tuned_ranking": f"""WITH {_CUR}, {_SETS.replace(_Q, _HQ)}, {_KW.replace(_Q, _HQ)}, {_CPLX}, {_FILES}, ch AS (SELECT repo_path, path, count(*) AS churn FROM f GROUP BY 1, 2),
h AS (SELECT cx.repo_path, cx.path, coalesce(churn, 0) * complexity AS hot, max(coalesce(churn, 0) * complexity) OVER (PARTITION BY cx.repo_path) AS most FROM cx LEFT JOIN ch ON ch.repo_path = cx.repo_path AND ch.path = cx.path),
t AS (SELECT sc.repo_path, sc.path, round(score * CASE WHEN score > 0 THEN CASE WHEN most > 0 THEN 1 + 3.0 * hot / most ELSE 1.0 END * CASE WHEN lower({_SUF.replace('path', 'sc.path')}) = '.py' THEN 1.5 WHEN lower({_SUF.replace('path', 'sc.path')}) IN ('.js','.ts','.tsx','.jsx','.swift','.java','.rb','.c','.h','.cpp','.cc','.cxx','.hpp','.hh','.hxx','.qml','.go','.rs','.sh','.cmake','.qrc') THEN 0.5 ELSE 1.0 END ELSE 1.0 END, 5) AS final
FROM sc JOIN h ON h.repo_path = sc.repo_path AND h.path = sc.path)
SELECT *, row_number() OVER (PARTITION BY repo_path ORDER BY final DESC, path) AS rank FROM t QUALIFY rank <= 30""".replace("6) AS score\n  FROM cur c", "12) AS score\n  FROM cur c"),
    "content_search": f"""WITH {_CUR}, w AS (SELECT repo_path, path, content, regexp_extract_all(lower(content || ' ' || array_to_string(list_distinct({_tok('content')}), ' ')), '[\\p{{L}}\\p{{N}}]+') AS ws FROM cur WHERE content IS NOT NULL), q AS (SELECT unnest(['stale', 'lease', 'ledger']) AS term),
st AS (SELECT count(*) n, avg(len(ws)) av FROM w), t AS (SELECT repo_path, path, len(ws) dl, q.term, len(list_filter(ws, lambda x: x = q.term)) tf FROM w, q), df AS (SELECT term, count(*) df FROM t WHERE tf > 0 GROUP BY 1),
b AS (SELECT repo_path, path, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))), 6) AS score FROM t JOIN df USING (term), st WHERE tf > 0 GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 50),
s AS (SELECT b.*, list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '') AS ts FROM b JOIN w ON w.repo_path = b.repo_path AND w.path = b.path),
f AS (SELECT *, list_min(list_filter(range(1, len(ts) + 1), lambda i: contains(lower(ts[i]), 'stale') OR contains(lower(ts[i]), 'lease') OR contains(lower(ts[i]), 'ledger'))) AS i FROM s)
SELECT repo_path, path, score, coalesce(array_to_string(list_transform(list_slice(ts, greatest(1, i - 6), greatest(1, i - 6) + 11), lambda x, k: CASE WHEN k + greatest(1, i - 6) - 1 = i THEN '[' || x || ']' ELSE x END), ' '), '') AS snippet FROM f""",
}
_REM = "(lower({s}) IN ('.md', '.rst', '.txt') OR regexp_matches(trim(line, ' '), '^(#|//|/\\*|\\*|<!--)') OR contains(trim(line, ' '), ' #') OR contains(trim(line, ' '), ' //') OR contains(trim(line, ' '), ' /*') OR contains(trim(line, ' '), ' <!--'))"
from loomspark.plans.graph import ORACLE as GRAPH  # noqa: E402

ORACLE["dead_code_lines"] = f"""WITH {_CUR}, {_N}, {_L}, {_X}, u AS ({GRAPH['unused_symbols']}), h AS (SELECT repo_path, path, n, {_REM.replace('{s}', _SUF)} AS remark, unnest(list_distinct(regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]*'))) AS label FROM lx),
c AS (SELECT u.repo_path, u.node_id, u.label, u.source_ref, count(CASE WHEN NOT remark AND NOT own THEN 1 END) AS code_hits, count(CASE WHEN remark AND NOT own THEN 1 END) AS remark_hits FROM
 (SELECT u.*, h.remark, coalesce(h.path = u.source_ref AND h.n BETWEEN n.span_start AND coalesce(n.span_end, n.span_start), false) AS own FROM u JOIN n ON n.repo_path = u.repo_path AND n.node_id = u.node_id LEFT JOIN h ON h.repo_path = u.repo_path AND h.label = u.label) u GROUP BY 1, 2, 3, 4)
SELECT *, CASE WHEN lower({_SUF.replace('path', 'source_ref')}) <> '.py' THEN 'low' WHEN code_hits = 0 AND remark_hits = 0 THEN 'high' WHEN code_hits = 0 THEN 'medium' ELSE 'low' END AS tier FROM c"""
