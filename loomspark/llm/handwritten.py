"""Generated, minified or vendored source files.

Every file is lexed once into its figures: identifiers with their uses, counts of literals, and what
its comments say. From these a character trigram model of identifiers is trained per language, and
one of the words of paths (every distinct name of a file counts once; only n-gram counts reach the
driver, at most 40**3 a language). The files are judged by the models:

* mangled names: most uses are of names whose cross-entropy is high under the language's model, and
  the names are short: minified;
* template-like names: the entropy of the name patterns (running numbers left out) is low for their
  number: generated;
* literals instead of names: values make up nearly all tokens: data saved as code;
* foreign naming: the words of the file's own name are strange to the model of path words, in
  standard deviations over all files. With a comment that speaks of a licence, an origin or a
  version this decides; a folder for code of others or a header that says outright where the file
  comes from needs no strange name, only no very ordinary one; a very strange name needs neither.

Headers are read only from comments, only where the comment itself makes the statement (not where
it quotes or discusses one), and not where it names the repository itself.

Defined results: of several states of a file the greatest ``modified_at`` is current; null keys and
contents are skipped; empty files and suffixes other than code are never found; size_bytes is not
trusted (it may be wrong or null), sizes are taken from the content.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.code.lexer import language, lex
from loomspark.llm.code.tree import _known
from loomspark.llm.syntax import current
from loomspark.session import materialize

_ALPHABET = set("abcdefghijklmnopqrstuvwxyz0123456789_$^")
#: Bits a character from which a name counts as mangled, the share of uses of such names, the greatest
#: mean length of names, and the least number of uses, of a minified file.
MANGLED_BITS, MANGLED_SHARE, MANGLED_LENGTH, MANGLED_USES = 3.2, 0.8, 3.0, 20
#: Entropy of the name patterns as a share of the greatest possible, below which names follow a
#: template; asked of at least so many names.
TEMPLATE_DIVERSITY, TEMPLATE_COUNT = 0.6, 12
#: Literals that make a file data: at least so many, and this share of all words and values; or at
#: least so many characters in them, and this share of all characters but blanks.
DATA_COUNT, DATA_SHARE = 24, 0.85
DATA_CHARS, DATA_CHAR_SHARE = 400, 0.75
#: Strangeness of a file's name, in deviations, that makes it foreign: with a comment on its licence,
#: origin or version; where its place or header says so; by itself.
FOREIGN_TOLD, FOREIGN_PLACED, FOREIGN_ALONE = 0.5, -2.0, 5.0

# Folder names that hold code of others.
_PLACES = frozenset("vendor vendored third_party third-party thirdparty 3rdparty 3rd_party 3rd-party external externals extern deps node_modules bower_components site-packages jspm_packages godeps pods carthage submodules contrib-vendor vendor_modules".split())
_GENERATED_PLACES = frozenset("generated gen-src autogen __generated__ generated-sources".split())
_GENERATED_NAMES = re.compile(r"(?:_pb2(?:_grpc)?\.py|\.pb(?:\.\w+)?\.(?:go|cc|h|cpp)|\.g\.(?:js|ts|dart)|\.generated\.\w+|_generated\.\w+|\.designer\.\w+|^moc_\w+\.\w+|^ui_\w+\.h|^qrc_\w+\.\w+|\.freezed\.\w+|_string\.go|\.min\.\w+)$", re.I)
_MARK = re.compile(
    r"^(?:@generated\b|<auto-?generated\b|auto-?generated\b(?! (?:keys|names|ids|values|code is|files are))|automatically generated\b|code generated (?:by|from)\b|generated (?:by|from|with|using|automatically|code)\b|machine (?:written|generated|made)\b"
    r"|this (?:file|code|module|class|source|source code|script) (?:is|was|has been) (?:auto-?generated|automatically (?:generated|created|produced|written)|machine[- ](?:generated|written)|generated|produced|emitted|created) (?:by|from|with|using|automatically)\b"
    r"|this is (?:an? )?(?:auto-?generated|generated|machine[- ]generated)\b|do not (?:edit|modify|change)\b.*\b(?:generated|output of|overwritten|produced by|regenerate)\b|do not (?:edit|modify)[!.]*$|produced by \S+.*(?:do not|overwritten)|output of \S+.*do not|bundled by \S+|compiled (?:by|from|with) \S+|transpiled (?:by|from)\b|created by .{0,40}(?:generator|compiler)\b)",
    re.I,
)
_FOREIGN = [
    re.compile(r"^this file is part of (?:the )?(?P<who>[\w.@/-]+?)(?: (?:project|library|package))?[.,;]?$", re.I),
    re.compile(r"^(?P<who>[\w.@/-]+) is free software\b", re.I),
    re.compile(r"^upstream(?: source| version)?\s*:\s*(?P<who>[\w.@/:-]+)", re.I),
    re.compile(r"^@licen[sc]e\s+(?P<who>[\w.@/-]+)\s+v?\d", re.I),
    re.compile(r"^\(c\)\s+(?:\d{4}\S*\s+)?(?:the )?(?P<who>[\w.@/-]+) (?:authors|contributors|developers|team|project)\b", re.I),
    re.compile(r"^copyright\s+(?:\(c\)\s*)?(?:\d{4}\S*\s+)?(?:the )?(?P<who>[\w.@/-]+) (?:authors|contributors|developers|team|project|foundation)\b", re.I),
    re.compile(r"^(?:vendored|imported|copied|taken|adapted|forked|mirrored)(?: unchanged| verbatim)? from (?P<who>[\w.@/:-]+)", re.I),
    re.compile(r"^!?\s*(?P<who>[\w.@/-]+)\s+v?\d+\.\d+(?:\.\d+)*\s*(?:\||$|\(|-)", re.I),
]
_OWN = frozenset("this the our repository project maintainers".split())
# Comments that may speak of another project, and those that speak of this one.
_TOLD = re.compile(r"\blicen[sc]e|\bcopyright\b|\(c\)|\bupstream\b|\bimported\b|\bv?\d+\.\d+\.\d+\b|\bfree software\b|\bpart of\b", re.I)
_TOLD_OWN = re.compile(r"\bthis repository\b|\bmaintainers\b|\bour\b", re.I)


def identifiers(lang: str, text: str) -> tuple[Counter, int, list[str], int]:
    """(names with counts, literals, comment lines, characters in literals) of a file."""
    known = _known({"jsx": "js", "tsx": "ts"}.get(lang, lang))
    names: Counter = Counter()
    literals = chars = 0
    notes: list[str] = []
    for kind, t, _ in lex(lang, text):
        if kind == "id":
            if t not in known:
                names[t] += 1
        elif kind in ("num", "str"):
            if kind == "str" and lang == "python" and t[:3] in ('"""', "'''"):
                notes.extend(t.strip("\"'").split("\n"))
                continue
            literals += 1
            chars += len(t)
        elif kind == "com":
            notes.extend(t.split("\n"))
    return names, literals, notes, chars


def _trigrams(name: str) -> list[str]:
    s = "^" + "".join(c if c in _ALPHABET else "$" for c in name.lower()) + "^"
    return [s[max(0, i - 2) : i + 1] for i in range(1, len(s))]


class NameModel:
    """Character trigrams with interpolated shorter contexts."""

    def __init__(self, counts: dict[str, int]):
        self.tri = counts
        self.ctx: Counter = Counter()
        self.bi: Counter = Counter()
        self.mid: Counter = Counter()
        self.uni: Counter = Counter()
        for g, n in counts.items():
            self.ctx[g[:-1]] += n
            self.bi[g[-2:]] += n
            self.mid[g[-2:-1]] += n
            self.uni[g[-1]] += n
        self.total = sum(self.uni.values()) or 1
        self.known: dict[str, float] = {}

    def bits(self, name: str) -> float:
        """Mean bits a character, end included."""
        b = self.known.get(name)
        if b is None:
            if len(self.known) > 200_000:
                self.known.clear()
            total = 0.0
            grams = _trigrams(name)
            for g in grams:
                p = 0.01 / len(_ALPHABET) + 0.09 * self.uni[g[-1]] / self.total
                p += 0.3 * self.bi[g[-2:]] / (self.mid[g[-2:-1]] or 1)
                p += 0.6 * self.tri.get(g, 0) / (self.ctx[g[:-1]] or 1)
                total -= math.log2(p)
            b = self.known[name] = total / len(grams)
        return b


_FIGURES = "repo_path string, path string, language string, names array<string>, uses array<int>, literals int, chars int, solid int, made boolean, foreign boolean, told boolean"


def lexed(files: DataFrame) -> DataFrame:
    """The figures of every code file; each is lexed once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for repo, path, text in zip(f["repo_path"], f["path"], f["content"]):
                lang = language(path)
                if lang is None or lang == "json":
                    continue
                names, literals, notes, chars = identifiers(lang, text)
                out.append((repo, path, lang, list(names), list(names.values()), literals, chars, len(re.sub(r"\s+", "", text)), *_mentions(notes, repo)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _FIGURES.split(", ")])

    return files.select("repo_path", "path", "content").mapInPandas(run, _FIGURES)


def _own_words(path: str) -> list[str]:
    """Words of a file's own name, without its suffixes."""
    return re.findall(r"[^\W_\d]+", path.rsplit("/", 1)[-1].split(".")[0])


def strangeness(model: NameModel | None, path: str) -> float:
    """Mean bits a character of the words of a file's own name."""
    ws = _own_words(path) or [""]
    return sum(model.bits(w) for w in ws) / len(ws) if model else 0.0


def train(figures: DataFrame) -> tuple[dict[str, NameModel], tuple[float, float]]:
    """Models per language, and of path words under the key 'path'; mean and deviation of strangeness."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, Counter] = {}
        for f in frames:
            for path, lang, names in zip(f["path"], f["language"], f["names"]):
                c = seen.setdefault(lang, Counter())
                for name in names:
                    c.update(_trigrams(name))
                words = seen.setdefault("path", Counter())
                for w in set(re.findall(r"[^\W_\d]+", path.rsplit(".", 1)[0])):
                    words.update(_trigrams(w))
        yield pd.DataFrame([(k, g, n) for k, c in seen.items() for g, n in c.items()], columns=["lang", "gram", "n"])

    rows = figures.select("path", "language", "names").mapInPandas(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    counts: dict[str, dict[str, int]] = {}
    for r in rows:
        counts.setdefault(r["lang"], {})[r["gram"]] = r["n"]
    models = {k: NameModel(c) for k, c in counts.items()}
    paths = models.get("path")

    def strange(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"x": [strangeness(paths, p) for p in f["path"]]})

    mean, deviation = figures.select("path").mapInPandas(strange, "x double").agg(F.avg("x"), F.stddev_pop("x")).first()
    return models, (mean or 0.0, deviation or 1.0)


def _statement(line: str) -> str:
    """A comment line without its marks."""
    return re.sub(r"^[\s/*#!;\-\"'=]+|[\s*/\-\"'=]+$", "", line)


def _mentions(notes: list[str], repo: str) -> tuple[bool, bool, bool]:
    """(a comment states that the file is generated, one states that it comes from elsewhere, one speaks
    of a licence, an origin or a version without naming this repository)."""
    own = {w for w in re.split(r"[^a-z0-9]+", repo.lower().rstrip("/").rsplit("/", 1)[-1]) if w} | {repo.lower().rstrip("/").rsplit("/", 1)[-1]}
    made = foreign = told = False
    for line in notes:
        s = _statement(line)
        if not s:
            continue
        if line.lstrip().startswith(("//  <auto", "# <auto", "// <auto")) or _MARK.match(s):
            made = True
        if _TOLD.search(s) and not _TOLD_OWN.search(s):
            told = True
        for p in _FOREIGN:
            m = p.match(s)
            if m and m["who"].lower().strip(".") not in own and m["who"].lower() not in _OWN and re.search(r"[a-z]", m["who"], re.I):
                foreign = True
    return made, foreign, told


def diversity(names: list[str]) -> tuple[float, int]:
    """(entropy of the name patterns as a share of the greatest possible, names of the most frequent pattern).

    Numbers of three digits and more, or very many smaller ones, run on and count as one pattern;
    authors stop earlier.
    """
    smaller = Counter(re.sub(r"\d+", "#", n) for n in names)
    patterns = Counter()
    for n in names:
        few = re.sub(r"\d+", "#", n)
        patterns[few if re.search(r"\d{3}", n) or smaller[few] >= 100 else n] += 1
    total = len(names)
    if total < 2:
        return 1.0, total
    entropy = -sum(c / total * math.log2(c / total) for c in patterns.values())
    return entropy / math.log2(total), max(patterns.values())


def verdict(path: str, lang: str, names: list[str], uses: list[int], literals: int, chars: int, solid: int, made: bool, foreign: bool, told: bool, models: dict[str, NameModel], scale: tuple[float, float]) -> tuple[str, dict]:
    """(verdict, figures) of one lexed file: verdict is '' for hand-written files."""
    total = sum(uses)
    model = models.get(lang)
    bits = [model.bits(n) for n in names] if model else [0.0] * len(names)
    mangled = sum(u for b, u in zip(bits, uses) if b >= MANGLED_BITS) / total if total else 0.0
    length = sum(len(n) * u for n, u in zip(names, uses)) / total if total else 0.0
    various, top = diversity(names)
    share = literals / (literals + total) if literals + total else 0.0
    parts = [p.lower() for p in path.split("/")[:-1]]
    placed = any(p in _PLACES for p in parts)
    strange = (strangeness(models.get("path"), path) - scale[0]) / scale[1]
    figures = {"bits": sum(bits) / len(bits) if bits else 0.0, "mangled_share": mangled, "name_length": length, "diversity": various, "literal_share": share, "literals": literals, "strangeness": strange}
    if not solid:
        return "", figures
    if mangled >= MANGLED_SHARE and length <= MANGLED_LENGTH and total >= MANGLED_USES:
        return "minified", figures
    if made:
        return "generated", figures
    if len(names) >= TEMPLATE_COUNT and various < TEMPLATE_DIVERSITY:
        return "generated", figures
    if (literals >= DATA_COUNT and share >= DATA_SHARE) or (share >= 0.6 and chars >= DATA_CHARS and chars >= DATA_CHAR_SHARE * solid):
        return "data", figures
    if strange >= FOREIGN_ALONE or (told and strange >= FOREIGN_TOLD) or ((placed or foreign) and strange >= FOREIGN_PLACED):
        return "vendored", figures
    name = path.rsplit("/", 1)[-1]
    if (_GENERATED_NAMES.search(name) or any(p in _GENERATED_PLACES for p in parts)) and top >= TEMPLATE_COUNT // 2:
        return "generated", figures
    return "", figures


def evidence(repo: str, path: str, text: str, models: dict[str, NameModel], scale: tuple[float, float] = (0.0, 1.0)) -> tuple[str, dict]:
    """(verdict, figures) of one file's text."""
    lang = language(path)
    names, literals, notes, chars = identifiers(lang, text)
    return verdict(path, lang, list(names), list(names.values()), literals, chars, len(re.sub(r"\s+", "", text)), *_mentions(notes, repo), models, scale)


_COLUMNS = ["bits", "mangled_share", "name_length", "diversity", "literal_share", "literals", "strangeness"]


def judge_files(sources: DataFrame) -> DataFrame:
    """(repo_path, path, language, verdict, figures...) of every current code file; verdict '' is hand-written."""
    figures = materialize(lexed(current(sources).where("content IS NOT NULL")))
    models, scale = train(figures)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for repo, *row in f.itertuples(index=False):
                path, lang, names, uses, *rest = row
                found, fig = verdict(path, lang, list(names), [int(u) for u in uses], *rest, models, scale)
                out.append((repo, path, lang, found, *[float(fig[c]) for c in _COLUMNS]))
            yield pd.DataFrame(out, columns=["repo_path", "path", "language", "verdict", *_COLUMNS])

    return figures.mapInPandas(run, "repo_path string, path string, language string, verdict string, " + ", ".join(f"{c} double" for c in _COLUMNS))
