"""Reading level of each document by gradient-boosted regression trees.

Prose is what remains of a text without code, traces, quotations, mark-up, addresses and
identifiers. Its features are distributions over words and sentences: length, vocabulary, syntax and
cohesion, with medians and quartiles over sentences, so that one hard sentence or one long run-on
does not decide. Trees are fitted on a bounded sample of rated documents; predictions for rated
documents come from folds that share no source, and an isotonic curve fitted on these calibrates
the grades.

Defined results: documents with a null id are skipped; null or empty texts, texts without prose and
texts in other languages have no grade and are never found; texts of any length are graded, a few
words only as far as they can carry a grade (``PRIOR_WORDS``); null ratings and ratings outside 1 to 4
are ignored; without any usable rating no document is graded; repeated documents get equal grades.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rated documents that the trees are fitted on, at most (the smallest hashes of their ids).
SAMPLE = 4000
#: Words of prose that a text needs for a grade: any.
LEAST_WORDS = 1
#: A grade is drawn towards the mean of all ratings as if the text had so many more words of mean
#: difficulty: no matter at 200 words, and one hard sentence alone is not a hard document.
PRIOR_WORDS = 10
#: Features for so many texts are made at once.
CHUNK = 2000

_CHAT = re.compile(r"\[\d\d:\d\d\] [\w-]+:[ \t]*")
_FRAME = re.compile(r"at [\w.$<>/]+\(|File \"|Traceback|Caused by|[A-Z]\w*(?:Error|Exception)\b|\{.*\}$|Title: ")
_CODE = re.compile(r"[=(){};]")
_QUOTED = re.compile(r"\"[^\"\n]{30,}\"|\u201c[^\u201d\n]{30,}\u201d")
_INLINE = re.compile(r"`[^`\n]*`|<[^<>\n]{1,200}>|&#?\w+;")
_NAME = re.compile(r"[a-z][A-Z]|[A-Za-z0-9]_[A-Za-z0-9]|\w/\w|::|\w\.\w|\d")
_VOWELS = re.compile(r"[aeiouy]+")
_ITEM = re.compile(r"(?:[-*+]|\d+[.)])[ \t]+")
_TOKEN = re.compile(r"[^\W\d_]+(?:['\u2019-][^\W\d_]+)*|[.!?]+(?=[\W_]*$)|[,;:]")

# Common function words that tell the language of a text.
_EN = frozenset("the of and to in is it that for on with as was be by are this from or an at not which have has but its their if when then you we they so had".split())
_DE = frozenset("der das und nicht ist von den dem ein eine wird wurde bleibt auf mit sich auch gilt nur wenn des bitte erst zu dann wieder jede".split())
_ES = frozenset("el los las que del se una por con para es esta este hay y luego vale si queda lo al como cada sola antes".split())
# Endings of abstract and derived words, and words that subordinate or oppose clauses.
_ABSTRACT = ("tion", "sion", "ity", "ism", "ness", "ment", "ence", "ance", "ology", "isation", "ization", "ability", "ical", "ial", "ive", "ous", "istic", "ular")
_CLAUSE = frozenset("although whereas notwithstanding inasmuch insofar thereby whose whether because since unless while which that hence albeit despite nevertheless".split())

NAMES = [
    "words_per_sentence", "sentence_q1", "sentence_median", "sentence_q3", "letters", "letters_sentence_q1", "letters_sentence_median", "letters_sentence_q3",
    "syllables", "long_words", "very_long_words", "abstract", "abstract_sentence_median", "abstract_sentence_q1", "function_words", "function_sentence_median",
    "clause_words", "commas", "distinct", "cohesion", "short_sentences", "long_sentences", "hard_sentences", "easy_words",
]


def prose(text: str) -> str:
    """Running text only; list items and paragraphs end with a full stop of their own."""
    keep: list[str] = []
    fence = ""
    for line in text.split("\n"):
        s = line.strip()
        if not s:
            keep.append(".")
            continue
        if s[0] == "[":
            m = _CHAT.match(s)
            if m:
                keep.append(".")
                s = s[m.end() :]
                if not s:
                    continue
        if s[:3] in ("```", "~~~"):
            fence = "" if fence else s[:3]
            keep.append(".")
            continue
        first = s[0]
        if fence or first == ">" or first == "#":
            continue
        if first in "-*+0123456789" and (m := _ITEM.match(s)):
            keep.append(".")
            s = s[m.end() :]
        elif (first in "aFTC{" or first.isupper()) and _FRAME.match(s):
            continue
        elif (line[0] == "\t" or line.startswith("    ")) and _CODE.search(s):
            continue
        keep.append(s)
    t = " ".join(keep)
    if '"' in t or "\u201c" in t:
        t = _QUOTED.sub(" ", t)
    if "`" in t or "<" in t or "&" in t:
        t = _INLINE.sub(" ", t)
    return t


class _Words:
    """Properties of each distinct word, looked up by number."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.chunks: dict[str, tuple] = {}

    def chunk(self, c: str) -> tuple:
        """Numbers of the words and marks in a piece of text without blanks; none for identifiers and the like."""
        if len(self.chunks) > 500_000:
            self.chunks.clear()
        x = self.chunks[c] = () if _NAME.search(c) else tuple(self(w[0] if w[0] in ".!?" else w) for w in _TOKEN.findall(c))
        return x

    def __call__(self, w: str) -> int:
        n = self.number.get(w)
        if n is None:
            v = w.lower()
            if w in ".!?":
                row = (-1, 0, 0, 0, 0, 0, 0, 0)
            elif w in ",;:":
                row = (-2, 0, 0, 0, 0, 0, 0, 0)
            else:
                row = (len(v), max(1, len(_VOWELS.findall(v))), v.endswith(_ABSTRACT) and len(v) > 6, v in _EN, v in _DE, v in _ES, v in _CLAUSE, self.number.get(v, -1))
                if v != w and row[7] < 0:
                    row = (*row[:7], self(v))
            n = self.number[w] = len(self.rows)
            self.rows.append((*row[:7], row[7] if row[7] >= 0 else n))
        return n


def features(texts: list[str | None], words: _Words | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature matrix, whether English, words of prose) of a list of texts."""
    words = words or _Words()
    n_docs = len(texts)
    flat: list[int] = []
    sizes = np.zeros(n_docs, np.int64)
    known = words.chunks
    for n, t in enumerate(texts):
        if t:
            had = len(flat)
            for c in prose(t).split():
                x = known.get(c)
                flat += words.chunk(c) if x is None else x
            sizes[n] = len(flat) - had
    ids = np.array(flat, np.int64)
    table = np.array(words.rows, np.int64).reshape(-1, 8)
    doc = np.repeat(np.arange(n_docs), sizes)
    if len(words.rows) > 2_000_000:
        words.__init__()
    row = table[ids] if len(ids) else np.zeros((0, 8), np.int64)
    kind = row[:, 0]
    new_doc = np.r_[False, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, bool)
    ended = np.r_[False, kind[:-1] == -1] if len(doc) else np.zeros(0, bool)
    sent = np.cumsum(new_doc | ended) if len(doc) else np.zeros(0, np.int64)
    is_word = kind > 0
    commas = np.bincount(doc[kind == -2], minlength=n_docs)
    doc, sent, row = doc[is_word], sent[is_word], row[is_word]
    count = np.bincount(doc, minlength=n_docs).astype(float)
    safe = np.maximum(count, 1)

    def per_doc(v: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=v, minlength=n_docs) / safe

    # sentences, numbered densely
    _, sent = np.unique(sent, return_inverse=True)
    n_sent = int(sent.max()) + 1 if len(sent) else 0
    size = np.bincount(sent, minlength=n_sent).astype(float)
    sdoc = np.zeros(n_sent, np.int64)
    sdoc[sent] = doc

    def per_sentence(v: np.ndarray) -> np.ndarray:
        return np.bincount(sent, weights=v, minlength=n_sent) / np.maximum(size, 1)

    real = size >= 3  # fragments are no sentences
    n_real = np.bincount(sdoc[real], minlength=n_docs)

    def quantiles(v: np.ndarray, qs: tuple) -> list[np.ndarray]:
        d, x = sdoc[real], v[real]
        o = np.lexsort((x, d))
        x = x[o]
        start = np.concatenate([[0], np.cumsum(n_real)[:-1]])
        out = []
        for q in qs:
            at = start + np.minimum((n_real * q).astype(int), np.maximum(n_real - 1, 0))
            out.append(np.where(n_real > 0, x[np.minimum(at, max(len(x) - 1, 0))] if len(x) else 0.0, 0.0))
        return out

    letters, abstract, function = row[:, 0].astype(float), row[:, 2].astype(float), row[:, 3].astype(float)
    s_letters, s_abstract, s_function = per_sentence(letters), per_sentence(abstract), per_sentence(function)
    n_s = np.maximum(n_real, 1)
    # cohesion: content words of a sentence that its predecessor in the document has too
    base = row[:, 7]
    content = (row[:, 3] == 0) & (letters > 3)
    width = int(base.max()) + 1 if len(base) else 1
    code = np.unique(sent[content] * width + base[content])
    again = np.isin(code + width, code, assume_unique=True)
    s_of = code // width
    nxt = np.minimum(s_of + 1, max(n_sent - 1, 0))
    again &= (sdoc[nxt] == sdoc[s_of]) if n_sent else again
    cohesion = np.bincount(sdoc[s_of], weights=again, minlength=n_docs) / np.maximum(np.bincount(sdoc[s_of], minlength=n_docs), 1) if n_sent else np.zeros(n_docs)
    distinct = np.bincount(np.unique(doc * width + base) // width, minlength=n_docs) if len(base) else np.zeros(n_docs)
    hard = np.bincount(sdoc[real], weights=(s_letters[real] > 6.0), minlength=n_docs) / n_s
    x = np.column_stack(
        [
            np.bincount(sdoc[real], weights=size[real], minlength=n_docs) / n_s, *quantiles(size, (0.25, 0.5, 0.75)), per_doc(letters), *quantiles(s_letters, (0.25, 0.5, 0.75)),
            per_doc(row[:, 1].astype(float)), per_doc(letters >= 7), per_doc(letters >= 11), per_doc(abstract), *quantiles(s_abstract, (0.5, 0.25)), per_doc(function), *quantiles(s_function, (0.5,)),
            per_doc(row[:, 6].astype(float)), commas / safe, distinct / np.sqrt(safe), cohesion,
            np.bincount(sdoc[real], weights=size[real] <= 8, minlength=n_docs) / n_s, np.bincount(sdoc[real], weights=size[real] >= 25, minlength=n_docs) / n_s, hard, per_doc(letters <= 4),
        ]
    )
    en, de, es = per_doc(function), per_doc(row[:, 4].astype(float)), per_doc(row[:, 5].astype(float))
    english = (en > 0.06) & (en > 1.5 * de) & (en > 1.5 * es)
    return x, english, count


class Trees:
    """Least-squares gradient boosting over binned features."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.12, bins: int = 32, least: int = 8):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._bin(x)
        self.start = float(np.average(y, weights=weight))
        f = np.full(len(y), self.start)
        self.trees: list[tuple] = []
        for _ in range(self.rounds):
            r, node = y - f, np.zeros(len(y), np.int64)
            feature, cut = np.full(2**self.depth - 1, -1), np.zeros(2**self.depth - 1, np.int64)
            for level in range(self.depth):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    at = np.flatnonzero(node == k)
                    if len(at) >= 2 * self.least:
                        feature[k], cut[k] = self._split(b[at], r[at], weight[at])
                go = feature[node]
                right = (go >= 0) & (b[np.arange(len(y)), np.maximum(go, 0)] > cut[node])
                node = np.where(node < 2**level - 1, node, 2 * node + 1 + right)
            leaf = node - (2**self.depth - 1)
            w = np.bincount(leaf, weights=weight, minlength=2**self.depth)
            value = self.rate * np.bincount(leaf, weights=weight * r, minlength=2**self.depth) / (w + 1.0)
            f += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T)]).astype(np.int64)

    def _split(self, b: np.ndarray, r: np.ndarray, w: np.ndarray) -> tuple[int, int]:
        best, found = 1e-9, (-1, 0)
        all_w, all_s = w.sum(), (w * r).sum()
        for j in range(b.shape[1]):
            cw = np.bincount(b[:, j], weights=w, minlength=self.bins).cumsum()[:-1]
            cs = np.bincount(b[:, j], weights=w * r, minlength=self.bins).cumsum()[:-1]
            n = np.bincount(b[:, j], minlength=self.bins).cumsum()[:-1]
            gain = cs**2 / np.maximum(cw, 1e-9) + (all_s - cs) ** 2 / np.maximum(all_w - cw, 1e-9) - all_s**2 / all_w
            gain = np.where((n >= self.least) & (len(b) - n >= self.least), gain, 0)
            k = int(gain.argmax())
            if gain[k] > best:
                best, found = gain[k], (j, k)
        return found

    def predict(self, x: np.ndarray) -> np.ndarray:
        b, f = self._bin(x), np.full(len(x), self.start)
        at = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                go = feature[node]
                node = 2 * node + 1 + ((go >= 0) & (b[at, np.maximum(go, 0)] > cut[node]))
            f += value[node - (2**self.depth - 1)]
        return f


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the best non-decreasing curve (pool adjacent violators)."""
    o = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b, c in zip(x[o], y[o], w[o]):
        blocks.append([a, a, b, c])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            p, q = blocks[-2], blocks.pop()
            blocks[-1] = [p[0], q[1], (p[2] * p[3] + q[2] * q[3]) / (p[3] + q[3]), p[3] + q[3]]
    return np.array([v for p in blocks for v in p[:2]]), np.array([p[2] for p in blocks for _ in (0, 1)])


def curve(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The isotonic curve as a line through the middles of its steps, so that grades inside a step still differ."""
    at, value = isotonic(x, y, w)
    middle, value = (at[::2] + at[1::2]) / 2, value[::2]
    return middle, value


class Grader:
    """Trees with their calibration and the error met on sources seen neither in fitting nor in calibrating."""

    def __init__(self, x: np.ndarray, y: np.ndarray, n: np.ndarray, source: np.ndarray, folds: int = 5):
        w = np.sqrt(n)
        _, fold = np.unique(source, return_inverse=True)
        rank = np.argsort(np.argsort(-np.bincount(fold), kind="stable"), kind="stable")
        fold = rank[fold] % folds
        out = np.full(len(y), np.nan)
        for k in range(folds):
            a, b = fold != k, fold == k
            if a.sum() >= 20 and b.any():
                out[b] = Trees().fit(x[a], y[a], w[a]).predict(x[b])
        self.trees = Trees().fit(x, y, w)
        seen = ~np.isnan(out)
        self.knots = curve(out[seen], y[seen], w[seen]) if seen.sum() >= 20 else None
        held = np.full(len(y), np.nan)
        for k in range(folds):
            a, b = seen & (fold != k), seen & (fold == k)
            if a.sum() >= 20 and b.any():
                held[b] = np.interp(out[b], *curve(out[a], y[a], w[a]))
        ok = ~np.isnan(held)
        self.mean = float(np.average(y, weights=w))
        self.error = float(np.sqrt(np.average((held[ok] - y[ok]) ** 2, weights=w[ok]))) if ok.any() else float("nan")

    def grade(self, x: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Calibrated grades of texts with so many words of prose."""
        f = self.trees.predict(x)
        f = f if self.knots is None else np.interp(f, *self.knots)
        return (words * f + PRIOR_WORDS * self.mean) / (words + PRIOR_WORDS)


def fit(documents: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> Grader | None:
    """A grader from at most ``sample`` rated documents; their ids, ratings and features come to the driver."""
    r = ratings.where("doc_id IS NOT NULL AND rating BETWEEN 1 AND 4").groupBy("doc_id").agg(F.avg("rating").alias("y"), F.count("*").alias("n"))
    rated = r.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x, english, count = features(list(f["text"]))
            ok = english & (count >= LEAST_WORDS)
            yield pd.DataFrame({"doc_id": f["doc_id"], "source": f["source"], "y": f["y"], "n": f["n"], "x": list(x)})[ok]

    texts = documents.select("doc_id", "text", "source").join(F.broadcast(rated), "doc_id").where("text IS NOT NULL AND text <> ''")
    rows = texts.mapInPandas(run, "doc_id long, source string, y double, n long, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    if len(rows) < 20:
        return None
    return Grader(np.array(rows["x"].tolist(), float), rows["y"].to_numpy(float), rows["n"].to_numpy(float), rows["source"].fillna("").str.strip().str.lower().to_numpy())


_GRADES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("english", T.BooleanType()), T.StructField("prose_words", T.LongType()), T.StructField("grade", T.DoubleType())])


def grades(documents: DataFrame, grader: Grader | None) -> DataFrame:
    """(doc_id, english, prose_words, grade): grade from 1 to 4, null where a text cannot be graded."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for frame in frames:
            for s in range(0, len(frame), CHUNK):
                part = frame.iloc[s : s + CHUNK]
                x, english, count = features(list(part["text"]), words)
                ok = english & (count >= LEAST_WORDS)
                g = np.full(len(part), np.nan)
                if grader is not None and ok.any():
                    g[ok] = np.clip(grader.grade(x[ok], count[ok]), 1, 4)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "english": english, "prose_words": count.astype(np.int64), "grade": pd.Series(g).astype(object).where(~np.isnan(g), None)})

    return documents.select("doc_id", "text").where("doc_id IS NOT NULL").mapInPandas(run, _GRADES)


def level(grade) -> object:
    """The whole level nearest to a grade."""
    return F.floor(grade + F.lit(0.5)).cast("int")
