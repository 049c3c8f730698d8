"""Queries of retrieval, fusion, packing, vectors and the usage ledger."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions import text as X
from loomspark.operators import governance, graphs, history, retrieval, scans
from loomspark.plans.graph import _DEG, _E, _N, _edges, _nodes
from loomspark.plans.repository import _CUR, _LINES, _STEM, _SUF, _sources
from loomspark.session import materialize, shared_dir, table
from loomspark.streaming import ledger

TASK = "Where does the scanner mask a stale lease of the ledger?"
WORDS = "stale lease ledger"
SYMBOL = "drainWindow"


def identifier_terms(s, d):
    n = _nodes(s, d).where("granularity = 'symbol'")
    return n.select("repo_path", "node_id", F.array_join(X.identifier_tokens(F.col("label")), " ").alias("tokens"), X.normalized_identifier(F.col("label")).alias("normalized"))


def _terms(s: SparkSession, d: str) -> DataFrame:
    c = _sources(s, d)
    return c.select("repo_path", "path", X.term_set(F.when(X.classify_path(F.col("path")) == "code", X.without_boilerplate(F.col("content"))).otherwise(F.col("content"))).alias("terms"))


def task_idf(s, d):
    terms = retrieval.query_terms(s, TASK)
    i = retrieval.task_idf(_terms(s, d), ["path"], terms)
    return i.select("repo_path", "term", F.round("idf", 6).alias("idf"))


def keyword_search(s, d):
    k = retrieval.keyword_scores(_sources(s, d), TASK)
    w = Window.partitionBy("repo_path").orderBy(F.desc("score"), "path")
    return k.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(w)).where("rank <= 50").select("repo_path", "path", F.round("keyword", 6).alias("keyword"), "score", F.col("rank").cast("long").alias("rank"))


def text_search(s, d):
    """BM25 over all documents, best fifty."""
    b = retrieval.bm25(table(s, d, "documents", "doc_id", "text"), "doc_id", "text", WORDS)
    return b.select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


def text_postings(s, d):
    """Documents and occurrences of every term."""
    p = retrieval.postings(table(s, d, "documents", "doc_id", "text"), "doc_id", "text")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def first_hit_lines(s, d):
    """First line of each file that holds a term of the query."""
    terms = retrieval.query_terms(s, WORDS)
    l = _sources(s, d).select("repo_path", "path", F.posexplode(X.lines(F.col("content"))).alias("n", "line"))
    pattern = r"\b(?:" + "|".join(terms) + r")\b"
    return l.where(F.lower("line").rlike(pattern)).groupBy("repo_path", "path").agg((F.min("n") + 1).cast("long").alias("line"))


def fused_ranking(s, d):
    """Keyword, name and churn lists of every repository's files, fused."""
    k = keyword_search(s, d).select(F.col("repo_path").alias("group"), F.lit("keyword").alias("list_id"), F.col("path").alias("id"), F.col("rank").alias("pos"))
    cur = _sources(s, d).select("repo_path", "path")
    w = Window.partitionBy("repo_path").orderBy("path")
    n = cur.where(F.arrays_overlap(X.term_set(X.stem(F.col("path"))), F.array(*[F.lit(t) for t in retrieval.query_terms(s, TASK)]))).withColumn("pos", F.row_number().over(w)).select(F.col("repo_path").alias("group"), F.lit("name").alias("list_id"), F.col("path").alias("id"), "pos")
    c = history.churn(table(s, d, "commits", "repo_path", "sha", "files_json"))
    wc = Window.partitionBy("repo_path").orderBy(F.desc("churn"), "path")
    c = c.withColumn("pos", F.row_number().over(wc)).where("pos <= 50").select(F.col("repo_path").alias("group"), F.lit("churn").alias("list_id"), F.col("path").alias("id"), "pos")
    r = retrieval.rrf(k.unionByName(n).unionByName(c))
    return r.select(F.col("group").alias("repo_path"), F.col("id").alias("path"), F.round("score", 9).alias("score"))


def symbol_search(s, d):
    return retrieval.search_symbols(_nodes(s, d), graphs.degrees(_edges(s, d)), "drain window").select("repo_path", "node_id", "label", F.col("bucket").cast("long").alias("bucket"), F.col("rank").cast("long").alias("rank"))


def references(s, d):
    return governance.mentions(_sources(s, d), "LIMIT")


def vector_search(s, d):
    """Ten nearest of all vectors for every vector whose id is divisible by 100."""
    v = table(s, d, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = v.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("qv"))
    n = retrieval.nearest_to(v, q)
    return n.select("qid", "id", F.round("score", 5).alias("score"))


def packed_context(s, d):
    """What a budget of 4000 tokens takes of the best keyword hits."""
    k = retrieval.keyword_scores(_sources(s, d), TASK)
    t = _sources(s, d).select("repo_path", "path", X.token_estimate(F.col("content"), X.classify_path(F.col("path"))).alias("tokens"))
    items = k.join(t, ["repo_path", "path"]).select(F.col("repo_path").alias("group"), F.col("path").alias("id"), F.round("score", 9).alias("score"), "tokens")
    return retrieval.pack(items).select(F.col("group").alias("repo_path"), F.col("id").alias("path"), "tokens", "taken")


def _bundle_scores(s, d):
    """(repo_path, path, seed, rank, score, tokens) of every file: seed = keyword score + 40 x fused
    score, score = seed + 10 x rank; all files with a positive seed are seeds of the rank."""
    cur = materialize(_sources(s, d))
    k = materialize(retrieval.keyword_scores(cur, TASK))
    w = Window.partitionBy("repo_path").orderBy(F.desc(F.round("score", 9)), "path")
    hits = k.where("score > 0").withColumn("pos", F.row_number().over(w))
    named = cur.where(F.arrays_overlap(X.term_set(X.stem(F.col("path"))), F.array(*[F.lit(t) for t in retrieval.query_terms(s, TASK)])))
    wn = Window.partitionBy("repo_path").orderBy("path")
    lists = hits.select(F.col("repo_path").alias("group"), F.lit("keyword").alias("list_id"), F.col("path").alias("id"), "pos").unionByName(named.select(F.col("repo_path").alias("group"), F.lit("name").alias("list_id"), F.col("path").alias("id"), F.row_number().over(wn).alias("pos")))
    fused = retrieval.rrf(lists).select(F.col("group").alias("repo_path"), F.col("id").alias("path"), F.col("score").alias("fused"))
    seeded = materialize(k.join(fused, ["repo_path", "path"], "left").select("repo_path", "path", (F.col("score") + 40 * F.coalesce("fused", F.lit(0.0))).alias("seed")))
    seeds = seeded.where("seed > 0").select("repo_path", F.concat(F.lit("file:"), "path").alias("node_id"), F.col("seed").alias("weight"))
    rank = graphs.pagerank(materialize(_nodes(s, d)), materialize(_edges(s, d)), seeds).select("repo_path", F.expr("substring(node_id, 6)").alias("path"), "rank")
    t = cur.select("repo_path", "path", X.token_estimate(F.col("content"), X.classify_path(F.col("path"))).alias("tokens"))
    final = seeded.join(rank, ["repo_path", "path"], "left").join(t, ["repo_path", "path"])
    return final.withColumn("score", F.col("seed") + 10 * F.coalesce("rank", F.lit(0.0)))


def context_bundle(s, d):
    """The flagship retrieval: keyword scores, fused lists and converged personalised rank, packed into a budget.

    final = keyword score + 40 x fused score + 10 x rank, for files of every repository.
    """
    packed = retrieval.pack(_bundle_scores(s, d).select(F.col("repo_path").alias("group"), F.col("path").alias("id"), F.round("score", 9).alias("score"), "tokens"))
    return packed.select(F.col("group").alias("repo_path"), F.col("id").alias("path"), "tokens", "taken")


def usage_ledger(s, d):
    e = table(s, d, "events", "ts", "event_type", "value").withColumn("base", F.col("value") * 3)
    return governance.usage_rollup(e.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value", "base")


def usage_stream(s, d):
    """The daily rollup as a stream over what is there, run to its end."""
    at = f"{shared_dir(s)}/streams/{uuid.uuid4().hex}"
    events = ledger.read_events(s, f"{d}/events.parque[t]", table(s, d, "events").schema)
    q = ledger.daily_usage(events).writeStream.outputMode("complete").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{at}/out"))
    q.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{at}/out").withColumn("tokens", F.round("tokens", 4))


def embedding_scan(s, d):
    e = table(s, d, "chunk_embeddings", "repo_path", "node_id", "source_path", "model_version", "created_at")
    c = scans.latest(e, ["repo_path", "node_id", "model_version"], ["created_at"])
    return c.groupBy("repo_path", "model_version").agg(F.count("*").alias("n_chunks"), F.countDistinct("source_path").alias("n_files"))


def retrieval_quality(s, d):
    """How well keyword search finds the files that changed most."""
    k = keyword_search(s, d).where("rank <= 10").select(F.col("repo_path").alias("task"), F.col("path").alias("id"), "rank")
    c = history.churn(table(s, d, "commits", "repo_path", "sha", "files_json"))
    w = Window.partitionBy("repo_path").orderBy(F.desc("churn"), "path")
    x = c.withColumn("n", F.row_number().over(w)).where("n <= 100").select(F.col("repo_path").alias("task"), F.col("path").alias("id"))
    m = governance.retrieval_metrics(k, x)
    return m.select("task", *[F.round(c, 6).alias(c) for c in ("precision", "p_at_3", "recall")])


QUERIES = {f.__name__: f for f in [identifier_terms, task_idf, keyword_search, text_search, text_postings, first_hit_lines, fused_ranking, symbol_search, references, vector_search, packed_context, context_bundle, usage_ledger, usage_stream, embedding_scan, retrieval_quality]}


def _tok(c: str) -> str:
    return f"list_transform(regexp_extract_all(regexp_replace(replace({c}, '_', ' '), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[A-Za-z0-9]+'), lambda x: lower(x))"


_STOP = "['" + "','".join(X.STOP_WORDS) + "']"
_Q = f"list_filter(list_distinct({_tok(repr(TASK))}), lambda x: NOT list_contains({_STOP}, x))"
_KIND = f"CASE WHEN {_SUF} = '.md' THEN 'markdown' WHEN lower({_SUF}) IN ('.py','.js','.ts','.tsx','.jsx','.swift','.java','.rb','.c','.h','.cpp','.cc','.cxx','.hpp','.hh','.hxx','.qml','.go','.rs','.sh','.cmake','.qrc') THEN 'code' ELSE 'text' END"
_BOIL = f"array_to_string(list_filter({_LINES}, lambda x: NOT regexp_matches(x, '^\\s*(import |from |#include |use |require |package )') AND NOT regexp_matches(x, '^\\s*(#|//|/\\*|\\*)')), chr(10))"
_SETS = f"""ts AS (SELECT repo_path, path, modified_at, list_distinct({_tok(f"CASE WHEN ({_KIND}) = 'code' THEN {_BOIL} ELSE content END")}) AS terms FROM cur), q AS (SELECT unnest({_Q}) AS term),
idf AS (SELECT ts.repo_path, q.term, ln((count(*) + 1) / greatest(1, sum(CASE WHEN list_contains(terms, q.term) THEN 1 ELSE 0 END))) AS idf FROM ts, q GROUP BY 1, 2)"""
_AUX = f"(list_has_any(string_split(path, '/'), {X.AUX_FOLDERS}) OR starts_with({_STEM}, 'test_') OR ends_with({_STEM}, '_test'))"
_FOLDER = "CASE WHEN contains(path, '/') THEN replace(regexp_replace(path, '/[^/]*$', ''), '/', ' ') ELSE '' END"
_KW = f"""kw AS (SELECT ts.repo_path, ts.path, coalesce(sum(CASE WHEN list_contains(terms, idf.term) THEN idf.idf ELSE 0 END), 0) * 10 AS keyword FROM ts JOIN idf ON idf.repo_path = ts.repo_path GROUP BY 1, 2),
nw AS (SELECT repo_path, max(floor(modified_at)) AS newest FROM cur GROUP BY 1),
sc AS (SELECT c.repo_path, c.path, kw.keyword, round((kw.keyword + greatest(0.0, 5 - log2(greatest(1, nw.newest - floor(c.modified_at) + 1))) + CASE WHEN list_has_any(list_distinct({_tok(_STEM.replace('path', 'c.path'))}), {_Q}) THEN 100 ELSE 0 END
  + CASE WHEN list_has_any(list_distinct({_tok(_FOLDER.replace('path', 'c.path'))}), {_Q}) THEN 40 ELSE 0 END) * CASE WHEN {_AUX.replace('path', 'c.path')} THEN 0.5 ELSE 1.0 END, 6) AS score
  FROM cur c JOIN kw ON kw.repo_path = c.repo_path AND kw.path = c.path JOIN nw ON nw.repo_path = c.repo_path),
ks AS (SELECT repo_path, path, round(keyword, 6) AS keyword, score, row_number() OVER (PARTITION BY repo_path ORDER BY score DESC, path) AS rank FROM sc)"""
_FILES2 = """f AS (SELECT DISTINCT repo_path, sha, CASE WHEN q LIKE './%' THEN substr(q, 3) ELSE q END AS path FROM
  (SELECT repo_path, sha, replace(p, '\\', '/') q FROM (SELECT repo_path, sha, unnest(from_json(files_json, '["VARCHAR"]')) p FROM commits)) WHERE trim(q) <> ''),
chn AS (SELECT repo_path, path, row_number() OVER (PARTITION BY repo_path ORDER BY count(*) DESC, path) AS pos FROM f GROUP BY 1, 2)"""
_W = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"

ORACLE = {
    "identifier_terms": f"WITH {_N} SELECT repo_path, node_id, array_to_string({_tok('label')}, ' ') AS tokens, array_to_string({_tok('label')}, '') AS normalized FROM n WHERE granularity = 'symbol'",
    "task_idf": f"WITH {_CUR}, {_SETS} SELECT repo_path, term, round(idf, 6) AS idf FROM idf",
    "keyword_search": f"WITH {_CUR}, {_SETS}, {_KW} SELECT * FROM ks WHERE rank <= 50",
    "text_search": f"""WITH w AS (SELECT doc_id, {_W} AS ws FROM documents WHERE text IS NOT NULL), q AS (SELECT unnest(['stale', 'lease', 'ledger']) AS term),
st AS (SELECT count(*) n, avg(len(ws)) av FROM w), t AS (SELECT doc_id, len(ws) dl, q.term, len(list_filter(ws, lambda x: x = q.term)) tf FROM w, q), df AS (SELECT term, count(*) df FROM t WHERE tf > 0 GROUP BY 1)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))), 6) AS score FROM t JOIN df USING (term), st WHERE tf > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""",
    "text_postings": f"WITH w AS (SELECT doc_id, unnest({_W}) AS term FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, term, count(*) tf FROM w GROUP BY 1, 2) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY 1",
    "first_hit_lines": f"WITH {_CUR}, l AS (SELECT repo_path, path, unnest(range(1, len(x) + 1)) AS line, unnest(x) AS t FROM (SELECT repo_path, path, {_LINES} AS x FROM cur)) SELECT repo_path, path, min(line) AS line FROM l WHERE regexp_matches(lower(t), '\\b(?:stale|lease|ledger)\\b') GROUP BY 1, 2",
    "fused_ranking": f"""WITH {_CUR}, {_SETS}, {_KW}, {_FILES2}, ls AS (SELECT repo_path, 'keyword' AS l, path, rank AS pos FROM ks WHERE rank <= 50 UNION ALL
SELECT repo_path, 'name', path, row_number() OVER (PARTITION BY repo_path ORDER BY path) FROM cur WHERE list_has_any(list_distinct({_tok(_STEM)}), {_Q}) UNION ALL SELECT repo_path, 'churn', path, pos FROM chn WHERE pos <= 50),
rk AS (SELECT repo_path, path, row_number() OVER (PARTITION BY repo_path, l ORDER BY pos, path) AS r FROM ls) SELECT repo_path, path, round(sum(1.0 / (60 + r)), 9) AS score FROM rk GROUP BY 1, 2""",
    "symbol_search": f"""WITH {_N}, {_E}, {_DEG}, m AS (SELECT n.*, lower(label) LIKE '%drain%window%' AS seq, contains(lower(label), 'drain')::INT + contains(lower(label), 'window')::INT AS hits,
coalesce(contains(lower(signature), 'drain') OR contains(lower(signature), 'window'), false) AS sig, coalesce(contains(lower(source_ref), 'drain') OR contains(lower(source_ref), 'window'), false) AS src FROM n WHERE granularity = 'symbol'),
c AS (SELECT * FROM m WHERE hits > 0 OR sig OR src QUALIFY row_number() OVER (PARTITION BY repo_path ORDER BY CASE WHEN seq THEN 0 WHEN hits > 0 THEN 1 WHEN sig THEN 2 ELSE 3 END, hits DESC, length(label), node_id) <= 160),
t AS (SELECT c.*, coalesce(dg.degree, 0) AS degree, list_distinct({_tok('label')}) lt, list_distinct({_tok("coalesce(signature, '')")}) sg, list_distinct({_tok("coalesce(source_ref, '')")}) sr, array_to_string({_tok('label')}, '') ln FROM c LEFT JOIN dg ON dg.repo_path = c.repo_path AND dg.node_id = c.node_id),
b AS (SELECT *, len(list_intersect(lt, ['drain', 'window'])) AS ov, CASE WHEN lower(label) = 'drain window' OR ln = 'drainwindow' THEN 0 WHEN starts_with(lower(label), 'drain window') OR starts_with(ln, 'drainwindow') THEN 1 WHEN contains(ln, 'drainwindow') THEN 2
WHEN list_has_all(lt, ['drain', 'window']) THEN 3 WHEN list_has_any(lt, ['drain', 'window']) THEN 4 WHEN list_has_all(sg, ['drain', 'window']) OR contains(lower(signature), 'drain window') THEN 5 WHEN list_has_all(sr, ['drain', 'window']) THEN 6 ELSE 7 END AS bucket FROM t)
SELECT repo_path, node_id, label, bucket::BIGINT AS bucket, row_number() OVER (PARTITION BY repo_path ORDER BY bucket, ov DESC, CASE kind WHEN 'class' THEN 0 WHEN 'func' THEN 1 ELSE 2 END, degree DESC, length(label), lower(label), node_id) AS rank FROM b QUALIFY rank <= 20""",
    "references": f"""WITH {_CUR}, l AS (SELECT repo_path, path, unnest(range(1, len(x) + 1)) AS line, unnest(x) AS t FROM (SELECT repo_path, path, {_LINES} AS x FROM cur))
SELECT repo_path, path, line, CASE WHEN lower({_SUF}) IN ('.json','.yaml','.yml','.toml','.qrc','.cmake','.pro','.ui') THEN 'config' WHEN lower({_SUF}) IN ('.py','.js','.ts','.tsx','.jsx','.swift','.java','.rb','.c','.h','.cpp','.cc','.cxx','.hpp','.hh','.hxx','.qml','.go','.rs') THEN 'code' WHEN lower({_SUF}) = '.sh' THEN 'script' WHEN lower({_SUF}) IN ('.md', '.txt', '.rst') THEN 'doc' ELSE 'other' END AS bucket,
CASE WHEN regexp_matches(t, '\\bLIMIT\\b\\s*(?:<<=|>>=|\\+=|-=|\\*=|/=|\\|=|&=|\\^=)') OR regexp_matches(t, '(?:\\+\\+|--)\\s*\\bLIMIT\\b') OR regexp_matches(t, '\\bLIMIT\\b\\s*(?:\\+\\+|--)') OR regexp_matches(t, '\\bLIMIT\\b\\s*(?:\\.\\s*(?:append|insert|push_back|clear|remove|pop|emplace_back|erase|update)\\s*\\(|\\[[^\\]]*\\]\\s*=(?:[^=>]|$))')
OR regexp_matches(t, '\\bdel\\s+\\bLIMIT\\b') OR regexp_matches(t, '\\bLIMIT\\b\\s*=(?:[^=>]|$)') THEN 'write' ELSE 'read' END AS access FROM l WHERE regexp_matches(t, '\\bLIMIT\\b')""",
    "vector_search": """WITH q AS (SELECT vec_id qid, embedding qv FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT qid, vec_id AS id, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), list_transform(qv, lambda x: x::DOUBLE)) AS score FROM embeddings, q)
SELECT qid, id, round(score, 5) AS score FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 10""",
    "usage_ledger": """SELECT day, tool, count(*) AS calls, round(sum(value), 4) AS response, round(sum(value * 3), 4) AS baseline, round(sum(value * 3) - sum(value), 4) AS saved, CASE WHEN sum(value * 3) > 0 THEN round(100.0 * (sum(value * 3) - sum(value)) / sum(value * 3), 1) ELSE 0.0 END AS saved_pct
FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS tool, value FROM events) GROUP BY GROUPING SETS ((), (day), (tool))""",
    "usage_stream": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS tool, count(*) AS calls, round(sum(value), 4) AS tokens FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
    "embedding_scan": "WITH c AS (SELECT repo_path, node_id, model_version, arg_max(source_path, created_at) source_path FROM chunk_embeddings WHERE repo_path IS NOT NULL AND node_id IS NOT NULL AND model_version IS NOT NULL GROUP BY 1, 2, 3) SELECT repo_path, model_version, count(*) AS n_chunks, count(DISTINCT source_path) AS n_files FROM c GROUP BY 1, 2",
    "retrieval_quality": f"""WITH {_CUR}, {_SETS}, {_KW}, {_FILES2}, k AS (SELECT repo_path, path, rank FROM ks WHERE rank <= 10), x AS (SELECT repo_path, path, 1 AS wanted FROM chn WHERE pos <= 100),
j AS (SELECT coalesce(k.repo_path, x.repo_path) AS task, k.rank, x.wanted FROM k FULL JOIN x ON x.repo_path = k.repo_path AND x.path = k.path),
a AS (SELECT task, count(rank) n, count(wanted) m, count(CASE WHEN rank IS NOT NULL AND wanted = 1 THEN 1 END) hit, count(CASE WHEN rank <= 3 AND wanted = 1 THEN 1 END) top FROM j GROUP BY 1)
SELECT task, round(CASE WHEN n > 0 THEN hit / n WHEN m = 0 THEN 1.0 ELSE 0.0 END, 6) AS precision, round(top / 3, 6) AS p_at_3, round(CASE WHEN m > 0 THEN hit / m ELSE 1.0 END, 6) AS recall FROM a""",
}
