"""What answers are made of: where an edge comes from, how its ends are shown, the best neighbours of a
node, why an item was chosen, and how much of a list fits a budget.

Defined results: null ids are skipped; null weights count as 0; unknown ends are shown by their own
id; ties go to the smaller id; repeated rows count once; empty tables give no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions import text as X

#: Edge ends a node's best neighbours are chosen from at once; hotter nodes are reduced in parts first.
PARTS = 16
# What the first part of an edge id, or else its layer, says of its origin.
ORIGINS = {"regex": "regex-parser", "treesitter": "treesitter-parser", "ts": "treesitter-parser", "ast": "ast-parser", "cochange": "git-history", "semantic": "llm"}
LAYER_ORIGINS = {"COCHANGE": "git-history", "HEADING": "markdown-parser"}
#: Longest signature that is shown whole.
SIGNATURE_CHARS = 200


def edge_origin(edge_id: Column, layer: Column) -> Column:
    """Who found an edge."""
    head = F.substring_index(edge_id, ":", 1)
    out = F.when(layer == "COCHANGE", LAYER_ORIGINS["COCHANGE"]).when(layer == "HEADING", LAYER_ORIGINS["HEADING"]).otherwise("unknown")
    for prefix, name in ORIGINS.items():
        out = F.when((head == prefix) & F.contains(edge_id, F.lit(":")), name).otherwise(out)
    return out


def shown_signature(signature: Column) -> Column:
    """A signature cut to ``SIGNATURE_CHARS`` characters, the last being the sign that something is missing."""
    return F.when(F.length(signature) > SIGNATURE_CHARS, F.concat(F.substring(signature, 1, SIGNATURE_CHARS), F.lit("…"))).otherwise(signature)


def unresolved(node_id: Column) -> Column:
    """How an id without a node row is shown: without its kind, a symbol by its last part."""
    plain = F.regexp_replace(node_id, "^(?:name|file|module):", "")
    short = F.when(node_id.startswith("symbol:"), F.substring_index(node_id, ":", -1)).otherwise(plain)
    return F.when(short == "", node_id).otherwise(short)


def with_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the columns ``source_shown`` and ``target_shown``: 'label @ path:line', or the bare id."""
    n = nodes.select("repo_path", "node_id", "label", "source_ref", "span_start")
    for end in ("source", "target"):
        at = F.concat(F.col("label"), F.lit(" @ "), F.col("source_ref"), F.when(F.col("span_start").isNotNull(), F.concat(F.lit(":"), F.col("span_start").cast("string"))).otherwise(F.lit("")))
        edges = edges.join(n.withColumnRenamed("node_id", end), ["repo_path", end], "left").withColumn(f"{end}_shown", F.coalesce(at, unresolved(F.col(end)))).drop("label", "source_ref", "span_start")
    return edges


def matching_edges(nodes: DataFrame, edges: DataFrame, needle: str, direction: str = "both", relation: str | None = None) -> DataFrame:
    """Edges of which the source ('out'), the target ('in') or either end matches a pattern by id or label.

    The needle is a LIKE pattern without its outer signs: '_' and '%' inside stand for any character
    and any run of characters.
    """
    pattern = f"%{needle}%"
    named = nodes.where(F.col("label").ilike(pattern)).select("repo_path", "node_id").distinct()
    e = edges if relation is None else edges.where(F.col("relation") == relation)
    hit = F.lit(False)
    for end in {"out": ["source"], "in": ["target"], "both": ["source", "target"]}[direction]:
        e = e.join(named.select("repo_path", F.col("node_id").alias(end), F.lit(True).alias(f"_{end}")), ["repo_path", end], "left")
        hit = hit | F.col(end).ilike(pattern) | F.coalesce(F.col(f"_{end}"), F.lit(False))
    return e.where(hit).drop("_source", "_target")


def budget_prefix(rows: DataFrame, group: list[str], order: list, tokens: Column, budget: int) -> DataFrame:
    """The first rows of each group whose tokens add up to the budget at most; the first that overflows ends it."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_t", tokens).withColumn("used", F.sum("_t").over(w)).where(F.col("used") <= budget).drop("_t")


def best_neighbours(edges: DataFrame, of: DataFrame, k: int = 3) -> DataFrame:
    """(repo_path, node_id, neighbour, relation, weight, direction, rank): the ``k`` best STRUCTURAL neighbours.

    Of several edges to one neighbour the greatest (weight, relation, edge id) stands; this is reduced
    map-side, so a hub's edges never meet in one task before they are one row a neighbour, and the k
    best of each of a hub's parts are found before those of the hub.
    """
    e = edges.where("layer = 'STRUCTURAL' AND source <> target").select("repo_path", "edge_id", "source", "target", "relation", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    out = e.select("repo_path", F.col("source").alias("node_id"), F.col("target").alias("neighbour"), "weight", "relation", "edge_id", F.lit("out").alias("direction"))
    both = out.unionByName(e.select("repo_path", F.col("target").alias("node_id"), F.col("source").alias("neighbour"), "weight", "relation", "edge_id", F.lit("in").alias("direction")))
    mine = both.join(of.select("repo_path", "node_id").distinct(), ["repo_path", "node_id"], "left_semi")
    best = mine.groupBy("repo_path", "node_id", "neighbour").agg(F.max(F.struct("weight", "relation", "edge_id", "direction")).alias("x")).select("repo_path", "node_id", "neighbour", "x.*")
    order = [F.desc("weight"), "relation", "neighbour", "edge_id"]
    part = Window.partitionBy("repo_path", "node_id", F.pmod(F.xxhash64("neighbour"), F.lit(PARTS))).orderBy(*order)
    few = best.withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= k).drop("_n")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("repo_path", "node_id").orderBy(*order))).where(F.col("rank") <= k).drop("edge_id")


def seed_links(edges: DataFrame, items: DataFrame, seeds: DataFrame, least: float = 0.3, k: int = 5) -> DataFrame:
    """(repo_path, node_id, seed, relation, weight, rank): why an item was chosen, by its strongest edges to seeds."""
    e = edges.where((F.coalesce("weight", F.lit(0.0)) >= least) & (F.col("source") != F.col("target"))).select("repo_path", "edge_id", "source", "target", "relation", "weight")
    i, s = items.select("repo_path", "node_id").distinct(), seeds.select("repo_path", "node_id").distinct()
    parts = []
    for a, b in (("source", "target"), ("target", "source")):
        j = e.join(i.withColumnRenamed("node_id", a), ["repo_path", a], "left_semi").join(s.withColumnRenamed("node_id", b), ["repo_path", b], "left_semi")
        parts.append(j.select("repo_path", F.col(a).alias("node_id"), F.col(b).alias("seed"), "relation", "weight", "edge_id"))
    both = parts[0].unionByName(parts[1]).distinct()
    w = Window.partitionBy("repo_path", "node_id").orderBy(F.desc("weight"), "relation", "seed", "edge_id")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("edge_id")


def match_status(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """(repo_path, target, n_matches, status): whether a name means one node, several or none.

    ``targets`` has repo_path, target; a target is a node id, a path or a label.
    """
    n = nodes.select("repo_path", "node_id", F.explode(F.array_distinct(F.array("node_id", "label", F.when(F.col("granularity") == "file", F.col("source_ref"))))).alias("target")).where("target IS NOT NULL")
    j = targets.select("repo_path", "target").where("repo_path IS NOT NULL AND target IS NOT NULL").distinct().join(n, ["repo_path", "target"], "left")
    c = j.groupBy("repo_path", "target").agg(F.countDistinct("node_id").alias("n_matches"))
    return c.withColumn("status", F.when(F.col("n_matches") == 0, "missing").when(F.col("n_matches") == 1, "found").otherwise("ambiguous"))


def reference_hits(nodes: DataFrame, edges: DataFrame, sources: DataFrame, mentions: DataFrame, symbol: str, most_edges: int = 200) -> DataFrame:
    """(repo_path, path, line, origin, access): where a symbol is used, by the graph and by its text.

    The graph side takes the first edges that lead to the symbol, both their ends if the end's label
    holds the symbol and it has a line; one row a (path, line). Text hits on lines the graph has are
    left out.
    """
    e = matching_edges(nodes, edges, symbol, "in")
    w = Window.partitionBy("repo_path").orderBy("edge_id")
    e = e.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most_edges)
    # Relations that write, and those that read.
    writes, reads = ["writes", "binds", "aliases"], ["reads", "calls"]
    plain = F.when(F.col("relation").isin(writes), "write").when(F.col("relation").isin(reads), "read")
    src = e.select("repo_path", F.col("source").alias("node_id"), F.coalesce(plain, F.lit("definition")).alias("access"), "edge_id", F.lit(0).alias("side"))
    tgt = e.select("repo_path", F.col("target").alias("node_id"), F.coalesce(F.when(F.col("relation").isin("references", "exports"), F.lit("write")), plain, F.lit("definition")).alias("access"), "edge_id", F.lit(1).alias("side"))
    named = nodes.where(F.lower("label").contains(symbol.lower()) & F.col("span_start").isNotNull()).select("repo_path", "node_id", F.col("source_ref").alias("path"), F.col("span_start").cast("long").alias("line"))
    hits = src.unionByName(tgt).join(named, ["repo_path", "node_id"])
    g = hits.groupBy("repo_path", "path", "line").agg(F.min(F.struct("edge_id", "side", "access")).alias("x")).select("repo_path", "path", "line", F.lit("graph").alias("origin"), F.col("x.access").alias("access"))
    t = mentions.select("repo_path", "path", "line", "access").join(g.select("repo_path", "path", "line"), ["repo_path", "path", "line"], "left_anti")
    return g.unionByName(t.select("repo_path", "path", "line", F.lit("text").alias("origin"), "access"))


def canonical_key(fingerprint: Column, tool: str, arguments: dict) -> Column:
    """Key of a stored answer: it changes with the data's fingerprint, the tool and its arguments, whatever
    their order; the repository's own path is left out."""
    plain = json.dumps({k: v for k, v in arguments.items() if k != "repo_path"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return F.sha2(F.concat_ws("\u001e", fingerprint, F.lit(tool), F.lit(plain)), 256)


def expand_terms(terms: list[str], synonyms: dict[str, list[str]]) -> list[str]:
    """Query terms with their synonyms, both ways, once: a key whose words are all asked for brings its
    values' words, and a value brings its key's."""
    split = lambda s: {w.lower() for w in _parts(s)}
    asked, out = set(terms), set(terms)
    for key, values in synonyms.items():
        k, vs = split(key), [split(v) for v in values]
        if k and k <= asked:
            out |= set().union(*vs) if vs else set()
        if any(v and v <= asked for v in vs):
            out |= k
    return sorted(out)


def _parts(text: str) -> list[str]:
    import re

    return re.findall(r"[A-Za-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text.replace("_", " ")))


def looks_like_identifier(text: Column) -> Column:
    """Whether a text names a symbol: '::' inside a word, an inner '_', or a small letter before a capital."""
    return text.rlike(r"[A-Za-z_][A-Za-z0-9_:]*::") | text.rlike(r"[A-Za-z][A-Za-z0-9:]*_+[A-Za-z0-9:]|_[A-Za-z0-9:]+_+[A-Za-z0-9:]") | text.rlike(r"[A-Za-z_][A-Za-z0-9_:]*[a-z0-9][A-Z]|[a-z][A-Z]")


# Suffixes that a language's name in a query asks for, and the factors of a match.
LANGUAGE_SUFFIXES = {
    "qml": [".qml"], "cpp": [".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx", ".h"], "cplusplus": [".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx", ".h"], "python": [".py"], "javascript": [".js", ".jsx"],
    "typescript": [".ts", ".tsx"], "golang": [".go"], "rust": [".rs"], "java": [".java"], "ruby": [".rb"], "swift": [".swift"], "kotlin": [".kt", ".kts"],
}
LANGUAGE_MATCH, LANGUAGE_OTHER, HOTSPOT_MOST = 1.5, 0.5, 3.0


def language_factor(query: str, terms: list[str], path: Column) -> Column:
    """1.5 for files of a language the query names, 0.5 for other code, 1 where it names none."""
    wanted = sorted({s for t in terms for s in LANGUAGE_SUFFIXES.get(t, [])} | set(LANGUAGE_SUFFIXES["cpp"] if "c++" in query.lower() else []))
    if not wanted:
        return F.lit(1.0)
    suffix = F.lower(X.suffix(path))
    return F.when(suffix.isin(wanted), LANGUAGE_MATCH).when((X.classify_path(path) == "code") & (suffix != ""), LANGUAGE_OTHER).otherwise(1.0)


def hotspot_factor(hotspot: Column, greatest: Column) -> Column:
    """1 to 4, by a file's share of the repository's greatest hotspot score."""
    return F.when(greatest > 0, 1 + HOTSPOT_MOST * F.coalesce(hotspot, F.lit(0)) / greatest).otherwise(F.lit(1.0))
