"""Lexical and vector retrieval, rank fusion, symbol search and budgeted packing.

Defined results: null or empty texts match nothing; a query without terms gives no rows; ties are
broken by key; repeated terms of a query count once; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions import text as X
from loomspark.session import materialize


def query_terms(spark, query: str, drop_stop_words: bool = True) -> list[str]:
    """Distinct terms of a query, evaluated like the texts'."""
    row = spark.range(1).select(X.term_set(F.lit(query), drop_stop_words).alias("t")).first()
    return list(row["t"])


def task_idf(texts: DataFrame, key: list[str], terms: list[str], group: str = "repo_path") -> DataFrame:
    """(group, term, idf): ln((N + 1) / df), ln(N + 1) for terms no text has. Columns of texts: key, group, terms.

    One pass counts all terms of the query at once, without exploding the texts.
    """
    counts = texts.groupBy(group).agg(F.count("*").alias("n"), *[F.sum(F.array_contains("terms", t).cast("long")).alias(f"d{i}") for i, t in enumerate(terms)])
    rows = counts.select(group, "n", F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"d{i}").alias("df")) for i, t in enumerate(terms)])).alias("x"))
    return rows.select(group, "x.term", F.log((F.col("n") + 1) / F.greatest(F.col("x.df"), F.lit(1))).alias("idf"))


def keyword_scores(sources: DataFrame, query: str) -> DataFrame:
    """(repo_path, path, keyword, recency, score): ten times the weights of shared terms, plus recency,
    name and folder bonuses, halved for tests and samples unless the query is about them."""
    spark = sources.sparkSession
    terms = query_terms(spark, query)
    if not terms:
        return spark.createDataFrame([], "repo_path string, path string, keyword double, recency double, score double")
    # Query terms that ask for tests and samples; bonuses of names and folders.
    about_aux = {"test", "tests", "testing", "eval", "evals", "evaluation", "fixture", "fixtures", "benchmark", "benchmarks", "example", "examples", "sample", "samples"} & set(terms)
    name_bonus, folder_bonus = 100.0, 40.0
    q = F.array(*[F.lit(t) for t in terms])
    folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    t = sources.select("repo_path", "path", "modified_at", X.term_set(F.when(X.classify_path(F.col("path")) == "code", X.without_boilerplate(F.col("content"))).otherwise(F.col("content"))).alias("terms"))
    t = t.withColumn("overlap", F.array_intersect("terms", q)).withColumn("in_name", F.arrays_overlap(X.term_set(X.stem(F.col("path"))), q)).withColumn("in_folder", F.arrays_overlap(X.term_set(F.translate(folder, "/", " ")), q))
    idf = task_idf(t, ["path"], terms)
    newest = t.groupBy("repo_path").agg(F.max(F.col("modified_at").cast("long")).alias("newest"))
    word = t.select("repo_path", "path", F.explode("overlap").alias("term")).join(idf, ["repo_path", "term"]).groupBy("repo_path", "path").agg((F.sum("idf") * 10).alias("keyword"))
    rows = t.drop("terms", "overlap").join(word, ["repo_path", "path"], "left").join(newest, "repo_path")
    recency = F.greatest(F.lit(0.0), 5 - F.log2(F.greatest(F.lit(1), F.col("newest") - F.col("modified_at").cast("long") + 1).cast("double")))
    plain = F.coalesce("keyword", F.lit(0.0)) + F.col("recency") + F.when(F.col("in_name"), name_bonus).otherwise(0.0) + F.when(F.col("in_folder"), folder_bonus).otherwise(0.0)
    rows = rows.withColumn("recency", recency)
    aux = F.lit(1.0) if about_aux else F.when(X.is_aux_path(F.col("path")), 0.5).otherwise(1.0)
    return rows.select("repo_path", "path", F.coalesce("keyword", F.lit(0.0)).alias("keyword"), "recency", (plain * aux).alias("score"))


def postings(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, dl): the table that text search reads; terms are runs of letters and digits."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    w = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), words.alias("ws"))
    return w.select("key", F.size("ws").alias("dl"), F.explode("ws").alias("term")).groupBy("key", "dl", "term").agg(F.count("*").alias("tf"))


def _occurrences(term: str) -> Column:
    return F.size(F.filter("ws", lambda x: x == F.lit(term)))


def bm25(texts: DataFrame, key: str, text: str, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of texts that hold a term of the query. Only query terms are counted in each text,
    inside the row: nothing is exploded and one row a text reaches the aggregation."""
    spark = texts.sparkSession
    terms = list(dict.fromkeys(r for r in spark.range(1).select(F.regexp_extract_all(F.lower(F.lit(query)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("t")).first()["t"]))
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    w = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), words.alias("ws"))
    w = w.select("key", F.size("ws").alias("dl"), *[_occurrences(t).alias(f"t{i}") for i, t in enumerate(terms)])
    stats = w.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"t{i}") > 0).cast("long")).alias(f"d{i}") for i in range(len(terms))])
    j = w.where(" OR ".join(f"t{i} > 0" for i in range(len(terms))) or "false").crossJoin(F.broadcast(stats))  # one row of statistics
    score: Column = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        score = score + idf * F.col(f"t{i}") * (k1 + 1) / (F.col(f"t{i}") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return j.select("key", score.alias("score"))


def rrf(ranked: DataFrame, k: int = 60) -> DataFrame:
    """(group, id, score): reciprocal rank fusion of lists given as (group, list_id, id, pos).

    An id counts once a list, at its first place; ranks have no gaps.
    """
    first = ranked.groupBy("group", "list_id", "id").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("group", "list_id").orderBy("pos", "id")
    return first.withColumn("rank", F.row_number().over(w)).groupBy("group", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where a length differs or a norm is zero."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n)


#: Queries that all tasks receive at once; more are cut into blocks, each met by its own copy of the vectors.
QUERY_BLOCK = 4096


def _against(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """Every vector beside every query of a stated set, block by block."""
    query = materialize(query)
    blocks = max(1, -(-query.count() // QUERY_BLOCK))
    if blocks == 1:
        return vectors.crossJoin(F.broadcast(query))  # at most one block of queries
    q = query.withColumn("_b", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
    v = vectors.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(64)).cast("int"))
    return v.join(q.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(63)))), ["_b", "_s"]).drop("_b", "_s")


def nearest_to(vectors: DataFrame, query: DataFrame, k: int = 10) -> DataFrame:
    """The k vectors most similar to each query vector: vectors (id, vector), queries (qid, qv).

    The queries are a stated set that the scan of all vectors meets in blocks; each task keeps the
    best k of a query before anything is shuffled.
    """
    s = _against(vectors, query).select("qid", "id", cosine(F.col("vector"), F.col("qv")).alias("score")).where("score IS NOT NULL AND NOT isnan(score)")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search_symbols(nodes: DataFrame, degree: DataFrame, query: str, k: int = 20) -> DataFrame:
    """Symbols matching a query, best first, per repository: (repo_path, node_id, label, bucket, rank)."""
    spark = nodes.sparkSession
    row = spark.range(1).select(X.search_tokens(F.lit(query)).alias("t"), X.normalized_identifier(F.lit(query)).alias("n")).first()
    tokens, norm, low = list(row["t"]), row["n"], query.lower()
    like = {c: [F.coalesce(F.lower(F.col(c)).contains(t), F.lit(False)) for t in tokens] for c in ("label", "signature", "source_ref")}

    def any_of(xs: list[Column]) -> Column:
        out = F.lit(False)
        for x in xs:
            out = out | x
        return out

    n = nodes.where("granularity = 'symbol'").where(any_of([*like["label"], *like["signature"], *like["source_ref"]]))
    hits = sum((x.cast("int") for x in like["label"][1:]), like["label"][0].cast("int"))
    seq = F.coalesce(F.lower("label").like("%" + "%".join(tokens) + "%"), F.lit(False))
    n = n.withColumn("prio", F.when(seq, 0).when(any_of(like["label"]), 1).when(any_of(like["signature"]), 2).otherwise(3)).withColumn("hits", hits)
    w0 = Window.partitionBy("repo_path").orderBy("prio", F.desc("hits"), F.length("label"), "node_id")
    n = n.withColumn("_n", F.row_number().over(w0)).where(F.col("_n") <= max(8 * k, 50)).join(degree, ["repo_path", "node_id"], "left").fillna(0, ["degree"])
    q = F.array(*[F.lit(t) for t in tokens])
    lab, sig, src = X.search_tokens(F.col("label")), X.search_tokens(F.coalesce("signature", F.lit(""))), X.search_tokens(F.coalesce("source_ref", F.lit("")))
    ln, ll = X.normalized_identifier(F.col("label")), F.lower("label")
    inside = lambda part: F.size(F.array_except(q, part)) == 0
    overlap = F.size(F.array_intersect(q, lab))
    bucket = (
        F.when((ll == low) | (ln == norm), 0).when(ll.startswith(low) | ln.startswith(norm), 1).when(F.lit(bool(norm)) & ln.contains(norm), 2).when(inside(lab), 3).when(overlap > 0, 4).when(inside(sig) | F.lower("signature").contains(low), 5).when(inside(src), 6).otherwise(7)
    )
    n = n.withColumn("bucket", bucket).withColumn("ov", overlap).withColumn("kp", F.when(F.col("kind") == "class", 0).when(F.col("kind") == "func", 1).otherwise(2))
    w = Window.partitionBy("repo_path").orderBy("bucket", F.desc("ov"), "kp", F.desc("degree"), F.length("label"), F.lower("label"), "node_id")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("repo_path", "node_id", "label", "bucket", "rank")


def pack(items: DataFrame, budget: int = 4000, item_share: float = 0.4, least: int = 16) -> DataFrame:
    """Greedy packing into a token budget: items (group, id, score, tokens), best first.

    With more than one positive item, each is cut to ``item_share`` of the budget; an item that does
    not fit is cut to what is left, and skipped when at most ``least`` tokens remain. The fold runs
    over the best candidates of a group only: each taken item uses more than ``least`` tokens, so no
    more than budget / least items can be taken, and as many more can be too short to matter.
    """
    most = budget // least + 1
    w = Window.partitionBy("group").orderBy(F.desc("score"), "id")
    best = items.where("score > 0 AND tokens > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 64 * most)

    def fold(key, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("rank")
        cap = int(budget * item_share) if len(f) > 1 else budget
        left, out = budget, []
        for i, s, n in zip(f["id"], f["score"], f["tokens"]):
            if left <= least:
                break
            take = min(int(n), cap, left)
            out.append((key[0], i, s, int(n), take))
            left -= take
        return pd.DataFrame(out, columns=["group", "id", "score", "tokens", "taken"])

    return best.groupBy("group").applyInPandas(fold, "group string, id string, score double, tokens long, taken long")


def truncate_texts(texts: DataFrame, budget: int, marker: str = "\n...[truncated]") -> DataFrame:
    """Texts (key, text) cut at a segment so that their estimate fits the budget."""
    import re

    # ASCII letters, digits and '_' are words; letters and digits of other scripts are not counted
    parts = re.compile(r"[A-Za-z0-9_]+|[^\w\s]|\s+")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for key, t in zip(f["key"], f["text"]):
                if t is None:
                    out.append((key, None))
                    continue
                segments = [m.end() for m in parts.finditer(t)]
                cost = lambda n: max(1, round(n * X.TOKENS_PER_SEGMENT["text"])) if n else 0
                if cost(len(segments)) <= budget:
                    out.append((key, t))
                    continue
                room = budget - cost(len(parts.findall(marker)))
                n = 0
                while n < len(segments) and cost(n + 1) <= room:
                    n += 1
                out.append((key, (t[: segments[n - 1]] if n else "").rstrip() + marker))
            yield pd.DataFrame(out, columns=["key", "text"])

    return texts.mapInPandas(run, "key string, text string")


def nearest_labels(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """(qid, label, id, score, rank): every label by its nearest vector to each query, the query itself left out.

    ``vectors`` has id, vector, label; ``query`` has qid, qv. Queries travel in blocks to the vectors;
    the best of a label is kept map-side, so one row a query and label is shuffled from each task.
    """
    j = _against(vectors, query).where("id <> qid")
    s = j.select("qid", "label", F.struct(cosine(F.col("vector"), F.col("qv")).alias("score"), (-F.col("id")).alias("o")).alias("x"))
    best = s.groupBy("qid", "label").agg(F.max("x").alias("x")).select("qid", "label", (-F.col("x.o")).alias("id"), F.col("x.score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")))


_PICKED = "group string, rank int, id string, kind string, path string, taken long"


def pack_candidates(items: DataFrame, budget: int = 4000, share: float = 0.4, least: int = 16) -> DataFrame:
    """(group, rank, id, kind, path, taken): files, spans of their symbols, skeletons and commits that fit a budget.

    ``items`` has group, id, kind ('file', 'symbol' or 'commit'), path, score, tokens, is_code, is_doc, and
    of files skeleton_tokens (null without one) and spans, an array of (score, id, tokens) of their
    symbols; symbols have file_id and file_tokens. Visited best first (then by path and id):

    * nothing may take more than ``share`` of the budget where several files or commits score, documents
      together no more than that where code scores;
    * a symbol brings its whole file where that fits, else its span; a file none of whose spans was taken
      comes whole, else by its best spans, else by its skeleton; only files without symbols and
      commits are cut, and only to more than ``least`` tokens.

    Candidates stream through the task in order; it holds what is selected and one row. Scores that
    are null or not positive, and items without tokens, are left out; repeated rows count once.
    """
    live = items.where("score > 0 AND tokens > 0 AND group IS NOT NULL AND id IS NOT NULL").dropDuplicates(["group", "kind", "id"])
    facts = live.groupBy("group").agg(F.count_if(F.col("kind") != "symbol").alias("n_whole"), F.max(F.col("is_code")).alias("any_code"))
    rows = live.join(facts, "group").withColumn("o", -F.col("score")).repartition("group").sortWithinPartitions("group", "o", "path", "id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, state, out = None, {}, []
        for f in frames:
            for r in f.itertuples(index=False):
                if r.group != group:
                    group = r.group
                    state = {"left": budget, "docs": 0, "files": set(), "spans": set(), "parted": set(), "n": 0}
                if state["left"] > 0:
                    out.extend(_visit(r, state, budget, share, least))
            yield pd.DataFrame(out, columns=["group", "rank", "id", "kind", "path", "taken"])
            out = []

    columns = ["group", "id", "kind", "path", "tokens", "is_code", "is_doc", "skeleton_tokens", "spans", "file_id", "file_tokens", "n_whole", "any_code"]
    return rows.select(*columns).mapInPandas(run, _PICKED)


def _visit(r, s: dict, budget: int, share: float, least: int) -> list[tuple]:
    cap = int(budget * share)
    allowed = min(s["left"], cap if r.n_whole > 1 else budget)

    def take(i: str, kind: str, n: int) -> tuple:
        s["left"] -= n
        s["n"] += 1
        if kind == "file":
            s["files"].add(r.path)
        elif kind == "symbol":
            s["spans"].add(i)
            s["parted"].add(r.path)
        return (r.group, s["n"], i, kind, r.path, n)

    if r.kind == "symbol":
        if r.path in s["files"] or r.id in s["spans"]:
            return []
        if r.path not in s["parted"] and pd.notna(r.file_tokens) and r.file_tokens <= allowed:
            return [take(r.file_id, "file", int(r.file_tokens))]
        return [take(r.id, "symbol", int(r.tokens))] if r.tokens <= allowed else []
    if r.kind == "file" and (r.path in s["files"] or (r.is_code and r.path in s["parted"])):
        return []
    if r.is_doc:
        allowed = min(allowed, (cap if r.any_code else budget) - s["docs"])
    if r.tokens <= allowed:
        n = int(r.tokens)
    elif allowed <= least:
        return []
    elif r.kind == "file" and r.is_code and r.spans is not None and len(r.spans):
        got = []
        for x in sorted(r.spans, key=lambda x: (-x["score"], x["id"])):
            if x["id"] not in s["spans"] and 0 < x["tokens"] <= min(allowed, s["left"]):
                got.append(take(x["id"], "symbol", int(x["tokens"])))
                allowed -= int(x["tokens"])
        if not got and pd.notna(r.skeleton_tokens) and 0 < r.skeleton_tokens <= allowed:
            return [take(r.id, "skeleton", int(r.skeleton_tokens))]
        return got
    else:
        n = int(allowed)
    if r.is_doc:
        s["docs"] += n
    return [take(r.id, r.kind, n)]
