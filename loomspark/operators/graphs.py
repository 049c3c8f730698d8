"""Graph operators over node and edge tables: degrees, neighbourhoods, ranking, communities, paths.

Edges are distinct by edge id. Endpoints without a node row are legal: ranking and communities leave
such edges out, degrees, paths and neighbourhoods keep them.

Defined results: null ids are skipped; null weights count as 0 where weights matter; repeated rows
count once; graphs without edges give the nodes' base values; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.scans import latest
from loomspark.session import materialize

#: Nodes and links of one repository that one task may rank; beyond it the rounds are distributed.
SMALL = 400_000
# How much an edge of each layer carries.
LAYER_WEIGHT = {"STRUCTURAL": 3.0, "COCHANGE": 2.0, "HEADING": 1.5, "SEMANTIC": 0.5}


def nodes_of(graph_nodes: DataFrame) -> DataFrame:
    return latest(graph_nodes, ["repo_path", "node_id"], ["kind"])


def edges_of(graph_edges: DataFrame) -> DataFrame:
    return latest(graph_edges.select("repo_path", "edge_id", "source", "target", "relation", "layer", "weight", "source_file"), ["repo_path", "edge_id"], ["source", "target"]).where("source IS NOT NULL AND target IS NOT NULL")


def degrees(edges: DataFrame) -> DataFrame:
    """Edge ends per node id; a self-link counts twice."""
    ends = edges.select("repo_path", F.explode(F.array("source", "target")).alias("node_id"))
    return ends.groupBy("repo_path", "node_id").agg(F.count("*").alias("degree"))


def fan_in(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """STRUCTURAL edges into any node of a file from elsewhere, per file that has a file node."""
    n = nodes.select("repo_path", "node_id", "source_ref")
    files = nodes.where("kind = 'file' AND node_id NOT LIKE 'commit:%'").select("repo_path", F.col("source_ref").alias("path")).distinct()
    e = edges.where("layer = 'STRUCTURAL'").select("repo_path", "source", "target")
    e = e.join(n.select("repo_path", F.col("node_id").alias("target"), F.col("source_ref").alias("path")), ["repo_path", "target"])
    e = e.join(n.select("repo_path", F.col("node_id").alias("source"), F.col("source_ref").alias("_from")), ["repo_path", "source"], "left")
    e = e.where(F.col("_from").isNull() | (F.col("_from") != F.col("path")))
    return e.join(files, ["repo_path", "path"], "left_semi").groupBy("repo_path", "path").agg(F.count("*").alias("fan_in"))


def _transitions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected weighted links between ranked nodes, parallel ones added, with the source's total."""
    ok = nodes.where("kind <> 'commit' AND node_id NOT LIKE 'commit:%'").select("repo_path", "node_id")
    factor = F.lit(1.0)
    for layer, w in LAYER_WEIGHT.items():
        factor = F.when(F.col("layer") == layer, w).otherwise(factor)
    e = edges.withColumn("w", F.coalesce("weight", F.lit(0.0)) * factor).where("w > 0")
    e = e.join(ok.select("repo_path", F.col("node_id").alias("source")), ["repo_path", "source"], "left_semi")
    e = e.join(ok.select("repo_path", F.col("node_id").alias("target")), ["repo_path", "target"], "left_semi")
    both = e.select("repo_path", F.col("source").alias("s"), F.col("target").alias("t"), "w").unionByName(e.select("repo_path", F.col("target").alias("s"), F.col("source").alias("t"), "w"))
    both = both.groupBy("repo_path", "s", "t").agg(F.sum("w").alias("w"))
    out = both.groupBy("repo_path", "s").agg(F.sum("w").alias("total"))
    return both.join(out, ["repo_path", "s"]).select("repo_path", "s", "t", (F.col("w") / F.col("total")).alias("p"))


def _rank_task(damping: float, rounds: int, tolerance: float | None):
    """A cogrouped function that ranks one repository, testing convergence after every round."""

    def run(key, base: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        base, links = base.sort_values("node_id"), links.sort_values(["s", "t"])
        index = pd.Index(base["node_id"])
        s, t = index.get_indexer(links["s"]), index.get_indexer(links["t"])
        p, v, lone = links["p"].to_numpy(float), base["v"].to_numpy(float), ~base["linked"].to_numpy(bool)
        r = v
        for _ in range(rounds):
            old = r
            r = (1 - damping) * v + damping * (np.bincount(t, old[s] * p, len(v)) + old[lone].sum() * v)
            if tolerance is not None and np.abs(r - old).sum() < tolerance:
                break
        return pd.DataFrame({"repo_path": base["repo_path"], "node_id": base["node_id"], "rank": r / r.sum()})

    return run


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame | None = None, damping: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6, test_every: int = 5, small: int = SMALL) -> DataFrame:
    """Personalised PageRank per repository: (repo_path, node_id, rank).

    ``seeds`` has repo_path, node_id, weight; a repository without a positive seed starts uniform.
    The mass of nodes without links goes to the seeds. Links are normalised and kept once. A
    repository of at most ``small`` nodes and links is ranked in one task; of larger ones each round
    is a table in the shared folder, and convergence is tested every few rounds.
    ``tolerance`` None runs all rounds.
    """
    ok = nodes.where("kind <> 'commit' AND node_id NOT LIKE 'commit:%'").select("repo_path", "node_id").distinct()
    links = materialize(_transitions(nodes, edges))
    base = ok
    if seeds is not None:
        base = base.join(seeds.where("weight > 0").groupBy("repo_path", "node_id").agg(F.sum("weight").alias("sw")), ["repo_path", "node_id"], "left")
    else:
        base = base.withColumn("sw", F.lit(None).cast("double"))
    sums = base.groupBy("repo_path").agg(F.sum("sw").alias("st"), F.count("*").alias("nn"))
    base = base.join(sums, "repo_path").select("repo_path", "node_id", F.when(F.col("st") > 0, F.coalesce("sw", F.lit(0.0)) / F.col("st")).otherwise(1.0 / F.col("nn")).alias("v"))
    sinks = links.select("repo_path", F.col("s").alias("node_id")).distinct().withColumn("linked", F.lit(True))
    base = materialize(base.join(sinks, ["repo_path", "node_id"], "left").withColumn("linked", F.coalesce("linked", F.lit(False))))
    sizes = base.select("repo_path").unionByName(links.select("repo_path")).groupBy("repo_path").count()
    big = materialize(sizes.where(F.col("count") > small).select("repo_path"))
    little = base.join(big, "repo_path", "left_anti").groupBy("repo_path").cogroup(links.join(big, "repo_path", "left_anti").groupBy("repo_path"))
    done = little.applyInPandas(_rank_task(damping, rounds, tolerance), "repo_path string, node_id string, rank double")
    if big.isEmpty():
        return done
    base, links = base.join(big, "repo_path", "left_semi"), links.join(big, "repo_path", "left_semi")
    rank = base.withColumn("r", F.col("v"))
    for i in range(1, rounds + 1):
        lost = rank.groupBy("repo_path").agg(F.sum(F.when(~F.col("linked"), F.col("r")).otherwise(0.0)).alias("lost"))
        got = rank.join(links.withColumnRenamed("s", "node_id"), ["repo_path", "node_id"]).groupBy("repo_path", F.col("t").alias("node_id")).agg(F.sum(F.col("r") * F.col("p")).alias("g"))
        nxt = rank.join(got, ["repo_path", "node_id"], "left").join(lost, "repo_path").select("repo_path", "node_id", "v", "linked", ((1 - damping) * F.col("v") + damping * (F.coalesce("g", F.lit(0.0)) + F.col("lost") * F.col("v"))).alias("r"), F.col("r").alias("old"))
        # a round reads its input three times, so each round is written once
        nxt = materialize(nxt)
        rank = nxt.drop("old")
        if tolerance is not None and i % test_every == 0:
            worst = nxt.groupBy("repo_path").agg(F.sum(F.abs(F.col("r") - F.col("old"))).alias("d")).agg(F.max("d")).first()[0]
            if worst is None or worst < tolerance:
                break
    total = rank.groupBy("repo_path").agg(F.sum("r").alias("rt"))
    return done.unionByName(rank.join(total, "repo_path").select("repo_path", "node_id", (F.col("r") / F.col("rt")).alias("rank")))


def proximity(edges: DataFrame, seeds: DataFrame, first: float = 5.0, second: float = 2.0) -> DataFrame:
    """(repo_path, node_id, bonus): neighbours of the seeds get first x weight, theirs second x weight.

    A node keeps the bonus of its nearest distance, and of several links there the greatest.
    """
    e = edges.select("repo_path", F.col("source").alias("a"), F.col("target").alias("b"), F.coalesce("weight", F.lit(0.0)).alias("w"))
    e = e.unionByName(e.select("repo_path", F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    s = seeds.select("repo_path", "node_id").distinct()
    one = e.join(s.withColumnRenamed("node_id", "a"), ["repo_path", "a"], "left_semi").groupBy("repo_path", F.col("b").alias("node_id")).agg((F.max("w") * first).alias("bonus")).join(s, ["repo_path", "node_id"], "left_anti")
    known = s.unionByName(one.select("repo_path", "node_id"))
    two = e.join(one.select("repo_path", F.col("node_id").alias("a")), ["repo_path", "a"], "left_semi").groupBy("repo_path", F.col("b").alias("node_id")).agg((F.max("w") * second).alias("bonus")).join(known, ["repo_path", "node_id"], "left_anti")
    return one.unionByName(two)


def _label_task(rounds: int):
    """A cogrouped function that spreads one repository's labels."""

    def run(key, ids: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        names = np.array(sorted(ids["node_id"]), object)
        index = pd.Index(names)
        a, b, m = index.get_indexer(links["a"]), index.get_indexer(links["b"]), links["m"].to_numpy(np.int64)
        n = len(names)
        label = np.arange(n)  # numbers in the order of the names, so the smallest name is the smallest number
        for _ in range(rounds):
            votes, at = np.unique(a * np.int64(n) + label[b], return_inverse=True)
            total = np.bincount(at, weights=m, minlength=len(votes))
            who, what = votes // n, votes % n
            o = np.lexsort((what, -total, who))
            first = o[np.concatenate([[True], who[o][1:] != who[o][:-1]])] if len(o) else o
            new = label.copy()
            new[who[first]] = what[first]
            if (new == label).all():
                break
            label = new
        return pd.DataFrame({"repo_path": key[0], "node_id": names, "community": names[label]})

    return run


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 30, floor: float = 0.1, small: int = SMALL) -> DataFrame:
    """Synchronous label propagation: (repo_path, node_id, community).

    Every node starts as its own label and takes its neighbours' commonest one, of equally common
    ones the smallest; rounds stop when nothing changes. Heading links and weak co-change links
    carry no labels; commits stay alone. A repository of at most ``small`` nodes and links is one
    task; of larger ones each round is a table in the shared folder, and a node's votes are added up
    map-side, so a hub brings one row a label and task and not one a link.
    """
    ids = nodes.select("repo_path", "node_id", (F.col("kind") == "commit").alias("c")).distinct()
    live = ids.where("NOT c AND node_id NOT LIKE 'commit:%'").select("repo_path", "node_id")
    e = edges.where("NOT (layer = 'HEADING' AND relation = 'contains') AND NOT (layer = 'COCHANGE' AND coalesce(weight, 0) < %s)" % floor)
    e = e.join(live.withColumnRenamed("node_id", "source"), ["repo_path", "source"], "left_semi").join(live.withColumnRenamed("node_id", "target"), ["repo_path", "target"], "left_semi")
    both = e.select("repo_path", F.col("source").alias("a"), F.col("target").alias("b")).unionByName(e.select("repo_path", F.col("target").alias("a"), F.col("source").alias("b")))
    both = materialize(both.groupBy("repo_path", "a", "b").agg(F.count("*").alias("m")))
    ids = materialize(ids.select("repo_path", "node_id").distinct())
    sizes = ids.select("repo_path").unionByName(both.select("repo_path")).groupBy("repo_path").count()
    big = materialize(sizes.where(F.col("count") > small).select("repo_path"))
    little = ids.join(big, "repo_path", "left_anti").groupBy("repo_path").cogroup(both.join(big, "repo_path", "left_anti").groupBy("repo_path"))
    done = little.applyInPandas(_label_task(rounds), "repo_path string, node_id string, community string")
    if big.isEmpty():
        return done
    both, labels = both.join(big, "repo_path", "left_semi"), ids.join(big, "repo_path", "left_semi").select("repo_path", "node_id", F.col("node_id").alias("label"))
    w = Window.partitionBy("repo_path", "node_id").orderBy(F.desc("m"), "label")
    for _ in range(rounds):
        votes = both.join(labels.select("repo_path", F.col("node_id").alias("b"), "label"), ["repo_path", "b"]).groupBy("repo_path", F.col("a").alias("node_id"), "label").agg(F.sum("m").alias("m"))
        best = votes.withColumn("n", F.row_number().over(w)).where("n = 1").select("repo_path", "node_id", F.col("label").alias("new"))
        nxt = materialize(labels.join(best, ["repo_path", "node_id"], "left").select("repo_path", "node_id", F.coalesce("new", "label").alias("label"), (F.col("new").isNotNull() & (F.col("new") != F.col("label"))).alias("moved")))
        labels = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            break
    return done.unionByName(labels.withColumnRenamed("label", "community"))


def shortest_paths(edges: DataFrame, starts: DataFrame, most_depth: int = 6, most_paths: int = 5) -> DataFrame:
    """(repo_path, a, b, hops, path): up to ``most_paths`` shortest undirected paths for every (a, b) of
    ``starts``; co-change links and commits are left out, parallel edges give paths of their own.

    Frontiers grow from a's side; a pair stops once b is reached, and a path never revisits a node.
    Paths carry edge ids; equal lengths are ordered by the edge ids.
    """
    e = edges.where("layer <> 'COCHANGE' AND source NOT LIKE 'commit:%' AND target NOT LIKE 'commit:%'")
    e = e.select("repo_path", "edge_id", F.col("source").alias("x"), F.col("target").alias("y")).unionByName(e.select("repo_path", "edge_id", F.col("target").alias("x"), F.col("source").alias("y"))).where("x <> y")
    e = materialize(e.distinct())
    front = starts.select("repo_path", "a", "b", F.col("a").alias("x"), F.array("a").alias("seen"), F.array().cast("array<string>").alias("path")).where("a <> b").distinct()
    done = None
    w = Window.partitionBy("repo_path", "a", "b").orderBy("path")
    for depth in range(1, most_depth + 1):
        step = front.join(e, ["repo_path", "x"]).where(~F.array_contains("seen", F.col("y")))
        step = materialize(step.select("repo_path", "a", "b", F.col("y").alias("x"), F.concat("seen", F.array("y")).alias("seen"), F.concat("path", F.array("edge_id")).alias("path")))
        hit = step.where("x = b").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most_paths).select("repo_path", "a", "b", F.lit(depth).alias("hops"), "path")
        done = hit if done is None else done.unionByName(hit)
        open_ = step.join(hit.select("repo_path", "a", "b").distinct(), ["repo_path", "a", "b"], "left_anti")
        # of many walks to one node only the first ones can be among the answers
        wx = Window.partitionBy("repo_path", "a", "b", "x").orderBy("path")
        front = open_.withColumn("n", F.row_number().over(wx)).where(F.col("n") <= most_paths).drop("n")
        if depth < most_depth:
            front = materialize(front)
            if front.isEmpty():
                break
    return done


def impact(nodes: DataFrame, links: DataFrame, k: int = 10) -> DataFrame:
    """(repo_path, path, neighbour, score, why, rank): for every file, the files linked to it.

    ``links`` are edges of both layers between file nodes; co-change counts twice.
    """
    files = nodes.where("(granularity = 'file' OR kind = 'file') AND kind <> 'commit' AND node_id NOT LIKE 'commit:%'").select("repo_path", "node_id", "source_ref").distinct()
    e = links.where("layer IN ('COCHANGE', 'STRUCTURAL') AND source <> target")
    e = e.select("repo_path", F.col("source").alias("a"), F.col("target").alias("b"), "relation", "layer", F.coalesce("weight", F.lit(0.0)).alias("w"))
    e = e.unionByName(e.select("repo_path", F.col("b").alias("a"), F.col("a").alias("b"), "relation", "layer", "w"))
    e = e.join(files.select("repo_path", F.col("node_id").alias("a"), F.col("source_ref").alias("path")), ["repo_path", "a"]).join(files.select("repo_path", F.col("node_id").alias("b"), F.col("source_ref").alias("neighbour")), ["repo_path", "b"])
    e = e.withColumn("w", F.col("w") * F.when(F.col("layer") == "COCHANGE", 2.0).otherwise(1.0))
    # parallel links of one relation are summed before the list, so a row's list stays short
    e = e.groupBy("repo_path", "path", "neighbour", "relation").agg(F.sum("w").alias("w"))
    s = e.groupBy("repo_path", "path", "neighbour").agg(F.sum("w").alias("score"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("o"), "relation"))), lambda x: x["relation"]), ",").alias("why"))
    w = Window.partitionBy("repo_path", "path").orderBy(F.desc("score"), "neighbour")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def relations(nodes: DataFrame, edges: DataFrame, relation: str, needle: str, most: int = 50) -> DataFrame:
    """Edges of a relation whose end matches a pattern by id or label, with both ends' labels."""
    n = nodes.select("repo_path", "node_id", "label")
    e = edges.where(F.col("relation") == relation)
    e = e.join(n.select("repo_path", F.col("node_id").alias("source"), F.col("label").alias("source_label")), ["repo_path", "source"], "left")
    e = e.join(n.select("repo_path", F.col("node_id").alias("target"), F.col("label").alias("target_label")), ["repo_path", "target"], "left")
    p = f"%{needle}%"
    hit = F.lit(False)
    for c in ("source", "target", "source_label", "target_label"):
        hit = hit | F.coalesce(F.col(c).ilike(p), F.lit(False))
    w = Window.partitionBy("repo_path").orderBy("edge_id")
    return e.where(hit).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("repo_path", "edge_id", "source", "target", "source_label", "target_label")


def containers(nodes: DataFrame) -> DataFrame:
    """(repo_path, node_id, container): the tightest other span of the same file that holds a node's span.

    Spans are brought to ranges of lines (of 64, 512, ... lines): a span stands in the ranges it
    covers at the scale of its own length, at most nine of them, and is looked up by the first line of
    others once a scale; so a file's spans meet only those that can hold them.
    """
    s = nodes.where("span_start IS NOT NULL AND span_end IS NOT NULL AND granularity = 'symbol'").select("repo_path", "source_ref", "node_id", F.col("span_start").cast("long").alias("span_start"), F.col("span_end").cast("long").alias("span_end"))
    widths = [64 * 8**k for k in range(8)]
    length = F.col("span_end") - F.col("span_start")
    scale = F.lit(len(widths) - 1)
    for k in reversed(range(len(widths) - 1)):
        scale = F.when(length < 8 * widths[k], k).otherwise(scale)
    width = F.element_at(F.array(*[F.lit(x).cast("long") for x in widths]), F.col("scale") + 1)
    o = s.where("span_end >= span_start").withColumn("scale", scale).withColumn("range", F.explode(F.sequence(F.floor(F.col("span_start") / width), F.floor(F.col("span_end") / width))))
    o = o.select("repo_path", "source_ref", "scale", "range", F.col("node_id").alias("o_id"), F.col("span_start").alias("o_s"), F.col("span_end").alias("o_e"))
    q = s.withColumn("scale", F.explode(F.array(*[F.lit(k) for k in range(len(widths))]))).withColumn("range", F.floor(F.col("span_start") / width))
    j = q.join(o, ["repo_path", "source_ref", "scale", "range"]).where("o_id <> node_id AND o_s <= span_start AND span_end <= o_e AND NOT (o_s = span_start AND o_e = span_end)")
    return j.groupBy("repo_path", "node_id").agg(F.min(F.struct((F.col("o_e") - F.col("o_s")).alias("len"), "o_id")).alias("x")).select("repo_path", "node_id", F.col("x.o_id").alias("container"))
