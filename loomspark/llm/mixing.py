"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source, key ranges (its upper bits) are summed up
first; their prefix sums over at most ``RANGES`` rows a source give each range its offset, and a
window inside each range finishes the distributed prefix sum of token counts. The source is cut
exactly where the prefix sum meets its budget, inside a document where it has to be; whole
repetitions (epochs) come before the cut, so no document is used more than one time more often
than another of its source.

Defined results: sources are compared without case and blanks; null, zero and negative shares and
sources without tokens take no part, and the other shares are scaled to sum to 1; null or empty
texts have no tokens and are never used; a null ``max_repeats`` counts as 1; empty tables give no
rows. Of a target source that is listed twice the greater share stands.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.session import materialize

#: Folder of the public vocabulary files, and the one used.
TOKENIZER_DIR, TOKENIZER = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Key ranges of a source: the unit of the distributed prefix sum.
RANGES = 4096

_ENCODER: dict = {}
#: The published pre-tokenisation pattern of this byte-level vocabulary (a fixed value).
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _encoder(folder: str, name: str):
    if (folder, name) not in _ENCODER:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{folder}/{name}", "rb"))}
        _ENCODER[folder, name] = tiktoken.Encoding("public", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODER[folder, name]


def token_counts(documents: DataFrame, folder: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) with the source spelled uniformly; documents without tokens are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(folder, name).encode_ordinary
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "source": f["source"], "n_tokens": [len(encode(t)) for t in f["text"]]})

    plain = F.lower(F.regexp_replace("source", r"\s+", ""))
    docs = documents.select("doc_id", plain.alias("source"), "text").where("doc_id IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL AND text <> ''")
    return docs.mapInPandas(run, "doc_id long, source string, n_tokens long").where("n_tokens > 0")


def _targets(targets: DataFrame) -> DataFrame:
    plain = F.lower(F.regexp_replace("source", r"\s+", ""))
    t = targets.select(plain.alias("source"), F.nanvl("target_share", F.lit(None).cast("double")).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("cap"))
    return t.where("source IS NOT NULL").groupBy("source").agg(F.max(F.struct(F.coalesce("share", F.lit(0.0)).alias("share"), "cap")).alias("x")).select("source", "x.share", "x.cap")


def budgets(counts: DataFrame, targets: DataFrame, total_tokens: int | None = None, strict: bool = False, tolerance: float = 0.0) -> DataFrame:
    """One row per target source: size, scaled share, its token budget and the largest total at which
    every source still holds its share within ``tolerance`` (a part of the share).

    The mixture aims at ``total_tokens``, by default all tokens of the participating sources. A
    source that cannot fill its share is used up to its cap; what it lacks is spread over the
    others in proportion to their shares, so the total is met wherever the caps allow it at all,
    and sources that are not used up stay in proportion to each other. ``strict`` takes the largest
    total that every source can fill to its share (less the tolerance) within its cap, however
    small that is.
    """
    sizes = counts.groupBy("source").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("n_docs"))
    t = _targets(targets).join(sizes, "source", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    w = Window.partitionBy(F.lit(1))  # one row per target source
    live = (F.col("share") > 0) & (F.col("size") > 0) & (F.col("cap") > 0)
    t = t.withColumn("scaled", F.when(live, F.col("share") / F.sum(F.when(live, F.col("share"))).over(w)).otherwise(F.lit(0.0)))
    t = t.withColumn("most", F.when(F.col("scaled") > 0, F.col("size") * F.col("cap")).otherwise(F.lit(0)).cast("double"))
    t = t.withColumn("room", F.when(F.col("scaled") > 0, F.col("most") / F.col("scaled")))
    t = t.withColumn("feasible", F.min("room").over(w) / F.lit(1.0 - tolerance))
    if strict:
        aim = F.col("feasible")
    else:
        aim = F.sum(F.when(live, F.col("size"))).over(w).cast("double") if total_tokens is None else F.lit(float(total_tokens))
    t = t.withColumn("aim", aim)
    # the level at which min(most, share x level) sums to the aim: with the sources of least room used up
    up = Window.partitionBy(F.lit(1)).orderBy(F.col("room").asc_nulls_last(), "source").rowsBetween(Window.unboundedPreceding, -1)
    used, left = F.coalesce(F.sum("most").over(up), F.lit(0.0)), F.lit(1.0) - F.coalesce(F.sum("scaled").over(up), F.lit(0.0))
    t = t.withColumn("_level", F.when((F.col("scaled") > 0) & (left > 1e-12), (F.col("aim") - used) / left))
    t = t.withColumn("level", F.greatest(F.lit(0.0), F.coalesce(F.max("_level").over(w), F.lit(0.0))))
    wanted = F.when(F.col("scaled") > 0, F.floor(F.col("scaled") * F.col("level") + F.lit(1e-6))).otherwise(F.lit(0))
    return t.withColumn("budget", F.least(wanted, F.col("most")).cast("long")).select("source", "share", "cap", "size", "n_docs", "scaled", "feasible", "budget")


def mixture(counts: DataFrame, plan: DataFrame, seed: int = 17) -> DataFrame:
    """(doc_id, source, n_tokens, copies, part_tokens) of the used documents: each is used ``copies`` times
    as a whole, and the one in which its source's budget ends once more with its first
    ``part_tokens`` tokens, so every source holds exactly its budget. A part counts as a use."""
    p = plan.where("budget > 0").select("source", "budget", "size", "cap")
    key = F.xxhash64(F.lit(seed), "doc_id")
    d = counts.join(p, "source").withColumn("key", key).withColumn("range", F.shiftrightunsigned("key", 64 - RANGES.bit_length() + 1))
    epochs = F.floor(F.col("budget") / F.col("size"))
    d = d.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - epochs * F.col("size"))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = d.groupBy("source", "range").agg(F.sum("n_tokens").alias("in_range"))
    offsets = ranges.select("source", "range", F.coalesce(F.sum("in_range").over(before), F.lit(0)).alias("offset"))
    d = d.join(offsets, ["source", "range"])
    d = d.withColumn("start", F.col("offset") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    open_ = (F.col("epochs") < F.col("cap")) & (F.col("start") < F.col("rest"))
    whole = open_ & (F.col("start") + F.col("n_tokens") <= F.col("rest"))
    d = d.withColumn("copies", (F.col("epochs") + whole.cast("int")).cast("int"))
    d = d.withColumn("part_tokens", F.when(open_ & ~whole, F.col("rest") - F.col("start")).otherwise(F.lit(0)).cast("long"))
    return d.where("copies > 0 OR part_tokens > 0").select("doc_id", "source", "n_tokens", "copies", "part_tokens")


def report(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """Per target source: wanted and reached share, tokens, documents, the most often a document is used, and the
    largest total at which all sources could hold their shares."""
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies") + F.col("part_tokens")).alias("tokens"), F.count("*").alias("docs"), F.max(F.col("copies") + (F.col("part_tokens") > 0).cast("int")).alias("most_copies"))
    w = Window.partitionBy(F.lit(1))  # one row per target source
    r = plan.select("source", "share", "scaled", "size", "cap", "feasible").join(got, "source", "left").fillna(0, ["tokens", "docs", "most_copies"])
    total = F.sum("tokens").over(w)
    reached = F.when(total > 0, F.col("tokens") / total).otherwise(F.lit(0.0))
    return r.select("source", F.col("share").alias("target_share"), F.col("scaled").alias("wanted_share"), reached.alias("reached_share"), "tokens", "docs", "most_copies", F.col("cap").alias("max_repeats"), F.col("size").alias("available_tokens"), F.floor("feasible").alias("feasible_total"))


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, strict: bool = False, tolerance: float = 0.0, seed: int = 17, folder: str = TOKENIZER_DIR, name: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The mixture and its report. Texts are tokenised once; the counts are kept in the shared folder."""
    counts = materialize(token_counts(documents, folder, name))
    plan = materialize(budgets(counts, targets, total_tokens, strict, tolerance))
    mixed = mixture(counts, plan, seed)
    return mixed, report(mixed, plan)
