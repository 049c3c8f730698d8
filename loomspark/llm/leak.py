"""Evaluation texts leaking into training text, by winnowing.

Both sides are brought to plain words. Of every window of consecutive k-gram hashes the smallest is
kept as a fingerprint (k + window - 1 equals the shortest unaltered run that a passage with the
allowed alterations must hold, so no passage can hide). Training and test fingerprints are joined by
shuffle, salted against hot fingerprints; every pair that shares one within a run of five equal words
is then extended to its longest passage and measured exactly.

Before the join, documents drop fingerprints that no item can have: two filters of fixed size, over
the items' fingerprints and their runs of five words, travel to the tasks. They never drop a
fingerprint that an item holds, whatever the number of items. The corpus is read once.

Defined results: null or empty texts match nothing; a closing sentence that at least ``shared``
different items end with, after other text, is a standing instruction and is left out of the items
wherever it stands in them (``standing_sentences`` lists them), nothing else is; a null id is
skipped; repeated documents are each reported; texts of any length and script are processed whole;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.session import materialize

#: Shortest passage in words, and one altered word allowed in so many.
MIN_WORDS, ONE_IN = 13, 8
#: k-gram length and window: k + window - 1 = 5. With a altered words of n >= 13 and a <= n / 8, the
#: longest unaltered run has at least ceil((n - a) / (a + 1)) >= 5 words.
K, WINDOW = 4, 2
#: Bits of a filter for each entry, and its greatest size in bits (16 MB), which the tasks receive.
FILTER_BITS, FILTER_MOST = 16, 1 << 27
#: Parts into which the documents of one fingerprint are spread; the items' side is repeated so often.
SALTS = 8

_WORD = re.compile(r"[a-z0-9]+")
# scripts written without blanks give one word a character
_DENSE = "\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"
_ANY_WORD = re.compile(rf"[{_DENSE}]|(?:(?![{_DENSE}])[^\W_])+")
_INLINE = re.compile(r"</?(?:b|i|u|s|em|strong|span|code|wbr|a|mark|sub|sup|font|tt|kbd|small|big)\b(?:[^<>]{0,200}|(?:\s+[\w:@.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))+\s*/?)>", re.I)
# a tag of any length has nothing but quoted attributes; other ones are told from comparisons by their length
_TAG = re.compile(r"<[!/]?[a-zA-Z][^<>]{0,300}>|<[a-zA-Z][\w:-]*(?:\s+[\w:@.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))+\s*/?>|<!--.*?-->", re.S)
_PREFIX = re.compile(r"^(?:[ \t]*(?:>+|//+[!/]?|#+|--+|[*+\-|;%]+)(?=[ \t]|$))+", re.M)
_NUMBERED = re.compile(r"^[ \t]*\d+[ \t]*[:|)\]][ \t]", re.M)
_HYPHEN = re.compile(r"(?<=\w)[-\u2010\u2011]\s*\n[ \t]*(?=\w)")
_UNICODE = re.compile(r"\\u([0-9a-fA-F]{4})")
_ESCAPE = re.compile(r"\\+[nrt\"'/]")
_PERCENT = re.compile(r"%20|%0A|%0D|%09", re.I)
_INVISIBLE = dict.fromkeys([0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, 0xFEFF, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10)])


def words(text: str | None) -> list[str]:
    """Plain lower-case words without mark-up, escapes, invisible characters and line prefixes."""
    if not text:
        return []
    t = text
    if "&" in t:
        t = html.unescape(t)
    if "\\" in t:
        t = _UNICODE.sub(lambda m: chr(int(m[1], 16)), t)
        t = _ESCAPE.sub(lambda m: "\n" if m[0][-1] in "nr" else " ", t)
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t.translate(_INVISIBLE))
        t = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))
    if "<" in t:
        t = _TAG.sub(" ", _INLINE.sub("", t))
    if "%" in t:
        t = _PERCENT.sub(" ", t)
    if "\n" in t:
        t = _PREFIX.sub("", t)
        if _NUMBERED.search(t):
            t = _NUMBERED.sub("", t)
        if "-\n" in t or "\u2010" in t or "- \n" in t:
            t = _HYPHEN.sub("", t)
    for mark in "*`~_":
        if mark in t:
            t = t.replace(mark, "")
    return _WORD.findall(t.lower()) if t.isascii() else _ANY_WORD.findall(t.lower())


def _grams(ids: np.ndarray) -> np.ndarray:
    """Hash of the k-gram that starts at each position; the largest value where a word is unknown."""
    n = len(ids) - K + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    known = np.ones(n, bool)
    with np.errstate(over="ignore"):
        for j in range(K):
            part = ids[j : j + n]
            h = (h ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            known &= part > 0
    return np.where(known, h >> np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF))


def _winnow(h: np.ndarray) -> np.ndarray:
    """Positions of the smallest hash of each window; on ties the rightmost."""
    if len(h) < WINDOW:
        return np.arange(len(h))
    keep = np.zeros(len(h), bool)
    first, second = h[:-1], h[1:]
    keep[:-1] |= first < second
    keep[1:] |= second <= first
    return np.flatnonzero(keep & (h != np.uint64(0xFFFFFFFFFFFFFFFF)))


_CODES: dict[str, int] = {}


def codes(ws: list[str | None]) -> np.ndarray:
    """A positive 62-bit number for every word, the same in every process; 0 for words left out."""
    if len(_CODES) > 500_000:
        _CODES.clear()
    out = np.zeros(len(ws), np.int64)
    for i, w in enumerate(ws):
        if w is None:
            continue
        c = _CODES.get(w)
        if c is None:
            c = _CODES[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 2 | 1
        out[i] = c
    return out


def _run_hashes(h: np.ndarray) -> np.ndarray:
    """Hashes of runs of k + window - 1 words, from those of the k-grams."""
    with np.errstate(over="ignore"):
        out = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
        out ^= out >> np.uint64(31)
    no = np.uint64(0xFFFFFFFFFFFFFFFF)
    return np.where((h[:-1] == no) | (h[1:] == no), no, out)


def _bits(h: np.ndarray, size: int) -> np.ndarray:
    """Four bit positions of each hash in a filter of ``size`` bits (a power of two)."""
    out = np.empty((len(h), 4), np.int64)
    with np.errstate(over="ignore"):
        for i, m in enumerate((0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)):
            x = (h ^ (h >> np.uint64(30))) * np.uint64(m)
            out[:, i] = ((x >> np.uint64(33)) & np.uint64(size - 1)).astype(np.int64)
    return out


def _held(bits: np.ndarray, size: int, h: np.ndarray) -> np.ndarray:
    at = _bits(h, size)
    return ((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)


def measure(item: list, doc: list) -> int:
    """Length of the longest passage of the item (None for words left out) in a document's words."""
    where: dict[tuple, list[int]] = {}
    for i in range(len(item) - K + 1):
        gram = tuple(item[i : i + K])
        if None not in gram:
            where.setdefault(gram, []).append(i)
    seeds = [(i, d) for d in range(len(doc) - K + 1) for i in where.get(tuple(doc[d : d + K]), ())]
    return longest_passage(item, doc, seeds)


def longest_passage(item: list, doc: list, seeds: list[tuple[int, int]]) -> int:
    """Length in item words of the longest passage around the seeds with few enough alterations.

    Seeds are (item position, document position) of equal k-grams. They grow to exact runs, and runs
    are chained in the item's order; between two runs the altered words are those that differ, or
    the longer side where words were inserted or left out.
    """
    runs, seen = [], set()
    for i, d in sorted(seeds):
        if (i, d) in seen:
            continue
        a, b = i, d
        while a and b and item[a - 1] == doc[b - 1] and item[a - 1] is not None:
            a, b = a - 1, b - 1
        e, f = a, b
        while e < len(item) and f < len(doc) and item[e] == doc[f] and item[e] is not None:
            seen.add((e, f))
            e, f = e + 1, f + 1
        runs.append((a, b, e - a))
    # runs shorter than a k-gram, beside an alteration or between two
    by_diag: dict[int, list] = {}
    for a, b, n in runs:
        by_diag.setdefault(b - a, []).append((a, a + n))
    more = []
    near: dict[int, list] = {}
    for diag, spans in by_diag.items():
        lo, hi = min(s for s, _ in spans) - 2 * ONE_IN, max(e for _, e in spans) + 2 * ONE_IN
        # a word put in or left out moves the passage to another diagonal, at most one an alteration
        most = (hi - lo) // ONE_IN
        for shifted in range(diag - most, diag + most + 1):
            near.setdefault(shifted, []).append((lo, hi))
    for diag, spans in near.items():
        lo, hi = min(s for s, _ in spans), max(e for _, e in spans)
        i = max(lo, 0, -diag)
        hi = min(hi, len(item), len(doc) - diag)
        while i < hi:
            if item[i] is not None and item[i] == doc[i + diag]:
                e = i
                while e < hi and item[e] is not None and item[e] == doc[e + diag]:
                    e += 1
                more.append((i, i + diag, e - i))
                i = e
            else:
                i += 1
    # in the document's order, so that a run only meets those that follow it closely
    runs = sorted(set(runs) | set(more), key=lambda r: (r[1], r[0]))
    longest = max((n for _, _, n in runs), default=0)
    best = 0
    for s, (a, b, n) in enumerate(runs):
        # passages that begin with run s: fewest alterations to reach each later run
        cost = {s: 0}
        if n > best and n >= MIN_WORDS:
            best = n
        todo = [s]
        while todo:
            j = todo.pop(0)
            ja, jb, jn = runs[j]
            length = ja + jn - a
            if cost[j] * ONE_IN <= length:
                best = max(best, length)
            for k in range(j + 1, len(runs)):
                ka, kb, kn = runs[k]
                gi, gd = ka - ja - jn, kb - jb - jn
                if gd > 3 * ONE_IN:
                    break
                if gi < 0 or gd < 0 or gi > 3 * ONE_IN or None in item[ja + jn : ka]:
                    continue
                c = cost[j] + max(gi, gd)
                if c < cost.get(k, 1 << 30) and c * ONE_IN <= ka + kn - a + max(2 * ONE_IN, longest):
                    if k not in cost:
                        insort(todo, k)
                    cost[k] = c
    return best if best >= MIN_WORDS else 0


_END = re.compile(r"(?<=[.!?])[\"')\]]*\s+")
_HEAD = re.compile(r"(?:(?<=\s)|^)[\"'(\[]*(?=\w)")


def closing_sentences(text: str, ws: list[str]) -> list[str]:
    """What may be the closing sentence, as plain words: the text after the last full stop, or its end
    from a capital letter on where no stop parts it from what stands before. Other text must stand
    before it, and it must be long enough to hold a fingerprint's run."""
    tail = _END.split(text.strip())[-1]
    out = []
    for m in _HEAD.finditer(tail):
        if m.start() == 0 or tail[m.end()].isupper():
            last = words(tail[m.start() :])
            if K + WINDOW - 1 <= len(last) < len(ws) and ws[-len(last) :] == last:
                out.append(" ".join(last))
    return out


def _plain_items(items: DataFrame) -> DataFrame:
    """(item_id, same, ws, last): plain words, a hash of them, and what may be the closing sentence."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ws = [words(t) for t in f["text"]]
            yield pd.DataFrame({"item_id": f["item_id"], "ws": ws, "last": [closing_sentences(t, w) for t, w in zip(f["text"], ws)]})

    rows = items.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    plain = rows.mapInPandas(run, "item_id long, ws array<string>, last array<string>").where(F.size("ws") > 0)
    return plain.select("item_id", F.xxhash64("ws").alias("same"), "ws", "last")


def _standing(plain: DataFrame, shared: int) -> DataFrame:
    return plain.select("same", F.explode("last").alias("last")).groupBy("last").agg(F.countDistinct("same").alias("n_items")).where(F.col("n_items") >= shared)


def standing_sentences(items: DataFrame, shared: int = 3) -> DataFrame:
    """(sentence, n_items): the closing sentences that are left out of the items, as plain words."""
    return _standing(_plain_items(items), shared).withColumnRenamed("last", "sentence")


def item_words(items: DataFrame, shared: int = 3) -> DataFrame:
    """(item_id, ids): coded words; 0 stands for each word of a standing instruction.

    A standing sentence is found in any item through a key of its first eight words (or all, if it
    has fewer), so items and sentences meet in a join and not in the driver.
    """
    plain = materialize(_plain_items(items))
    head = lambda ws: F.array_join(F.slice(ws, 1, 8), " ")
    sentence = F.split("last", " ")
    standing = _standing(plain, shared).select(sentence.alias("_s"), head(sentence).alias("_key"), F.least(F.size(sentence), F.lit(8)).alias("_k"))
    lengths = F.explode(F.sequence(F.lit(1), F.lit(8))).alias("_k")  # lengths of a key
    starts = plain.select("item_id", "ws", lengths).where("size(ws) >= _k")
    starts = starts.join(standing.select("_k").distinct(), "_k", "left_semi").select("item_id", "ws", "_k", F.explode(F.expr("sequence(1, size(ws) - _k + 1)")).alias("_p"))
    at = starts.withColumn("_key", F.array_join(F.slice("ws", F.col("_p"), F.col("_k")), " ")).join(standing, ["_k", "_key"])
    at = at.where(F.slice("ws", F.col("_p"), F.size("_s")) == F.col("_s")).groupBy("item_id").agg(F.collect_set(F.struct("_p", F.size("_s").alias("_n"))).alias("marks"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for ws, marks in zip(f["ws"], f["marks"]):
                ids = codes(list(ws))
                for m in marks if marks is not None else ():
                    ids[m["_p"] - 1 : m["_p"] - 1 + m["_n"]] = 0
                out.append(ids)
            yield pd.DataFrame({"item_id": f["item_id"], "ids": out})

    return plain.select("item_id", "ws").join(at, "item_id", "left").mapInPandas(run, "item_id long, ids array<long>")


def _prints(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint positions of a text, all its k-gram hashes, and those of its runs of five words."""
    h = _grams(ids)
    return _winnow(h), h, _run_hashes(h)


_PRINT = "h bigint, pos int, before bigint, after bigint"


def _print_rows(ids: np.ndarray, at: np.ndarray, h: np.ndarray) -> list[tuple]:
    n = len(ids)
    return [(int(h[p].astype(np.int64)), int(p), int(ids[p - 1]) if p else 0, int(ids[p + K]) if p + K < n else 0) for p in at]


def _item_prints(items: DataFrame) -> DataFrame:
    """(item_id, h, pos, before, after): an item's fingerprints with the words beside them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for item, ids in zip(f["item_id"], f["ids"]):
                ids = np.asarray(ids, np.int64)
                at, h, _ = _prints(ids)
                out += [(item, *r) for r in _print_rows(ids, at, h)]
            yield pd.DataFrame(out, columns=["item_id", "h", "pos", "before", "after"])

    return items.mapInPandas(run, f"item_id long, {_PRINT}")


def _filter(items: DataFrame, size: int, runs: bool) -> np.ndarray:
    """A filter over the items' fingerprints, or their runs of five words, as 64-bit words.

    The tasks give the words that have bits; they are united by word, at most size / 64 rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(size // 64, np.uint64)
        for f in frames:
            for ids in f["ids"]:
                at, h, r = _prints(np.asarray(ids, np.int64))
                b = _bits(r[r != np.uint64(0xFFFFFFFFFFFFFFFF)] if runs else h[at], size).ravel()
                np.bitwise_or.at(bits, b >> 6, np.uint64(1) << (b & 63).astype(np.uint64))
        some = np.flatnonzero(bits)
        yield pd.DataFrame({"w": some, "b": bits[some].astype(np.int64)})

    rows = items.select("ids").mapInPandas(run, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(size // 64, np.uint64)
    out[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64).astype(np.uint64)
    return out


def _candidates(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, ids, prints): documents that hold fingerprints which pass the filters."""
    n = items.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    size = min(FILTER_MOST, 1 << max(12, (FILTER_BITS * int(n)).bit_length()))
    prints, runs = _filter(items, size, False), _filter(items, size, True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lists = [codes(words(t)) for t in frame["text"]]
            flat = np.concatenate([x for ws in lists for x in (ws, [0])]) if lists else np.zeros(0, np.int64)
            ends = np.cumsum([len(x) + 1 for x in lists])  # one unknown word keeps documents apart
            at, h, r = _prints(flat.astype(np.int64))
            at = at[_held(prints, size, h[at])]
            whole = np.zeros(len(h) + 1, bool)
            near = np.unique(np.concatenate([at, at - 1]))
            near = near[(near >= 0) & (near < len(r))]
            whole[near] = _held(runs, size, r[near]) & (r[near] != np.uint64(0xFFFFFFFFFFFFFFFF))
            at = at[whole[at] | (whole[at - 1] & (at > 0))]
            out = []
            of = np.searchsorted(ends, at, "right")
            for d in np.unique(of):
                start = int(ends[d - 1]) if d else 0
                mine = at[of == d]
                rows = [(x, p - start, b, a) for x, p, b, a in _print_rows(flat, mine, h)]
                out.append((frame["doc_id"].iat[d], lists[d], [dict(zip(("h", "pos", "before", "after"), x)) for x in rows]))
            yield pd.DataFrame(out, columns=["doc_id", "ids", "prints"])

    docs = documents.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    return docs.mapInPandas(run, f"doc_id long, ids array<long>, prints array<struct<{_PRINT}>>")


def leaked(documents: DataFrame, items: DataFrame, shared: int = 3, salts: int = SALTS) -> DataFrame:
    """(doc_id, item_id, n_words): documents that hold a passage of an item, and the longest passage's length."""
    coded = materialize(item_words(items, shared))
    found = materialize(_candidates(documents, coded))
    d = found.select("doc_id", F.explode("prints").alias("x")).select("doc_id", "x.*", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    i = _item_prints(coded).select("item_id", "h", F.col("before").alias("_b"), F.col("after").alias("_a"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    # a fingerprint counts inside a run of five equal words: the word before or the one after agrees too
    run5 = ((F.col("before") == F.col("_b")) & (F.col("before") != 0)) | ((F.col("after") == F.col("_a")) & (F.col("after") != 0))
    pairs = materialize(d.join(i, ["h", "salt"]).where(run5).select("doc_id", "item_id").distinct())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for doc, item, ws, ids in zip(f["doc_id"], f["item_id"], f["ws"], f["ids"]):
                if n := measure([int(x) or None for x in ids], [int(x) for x in ws]):
                    out.append((doc, item, n))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "n_words"])

    # copies of a document id or an item id stand for themselves; the longest passage counts
    both = pairs.join(found.select("doc_id", F.col("ids").alias("ws")), "doc_id").join(coded, "item_id")
    out = both.select("doc_id", "item_id", "ws", "ids").mapInPandas(run, "doc_id long, item_id long, n_words int")
    return out.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"))
