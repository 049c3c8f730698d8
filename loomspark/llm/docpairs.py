"""Functions paired with their documentation.

A string- and comment-aware lexer and bracket matching delimit the functions of a file; in Python
the docstring, elsewhere the comment that ends on the line above the declaration (annotations,
attributes and template heads may stand between) is the documentation. Documentation that tells no
more than the function's name is dropped.

Defined results: only files that parse are used; of several states of a file the greatest
``modified_at`` is current; null keys and contents are skipped; files without functions give no
rows; functions of one name on different lines are different rows, repeated rows of a file are one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from loomspark.llm.syntax import current, judge

_LANGS = {"python", "js", "jsx", "ts", "tsx", "java", "go", "rust", "cpp", "ruby"}
_CONTROL = frozenset("if for while switch catch with return else do try synchronized new throw await typeof sizeof alignof decltype noexcept static_assert function match loop unsafe elsif unless until case".split())
_MODIFIERS = frozenset("export default public private protected static final abstract async get set override readonly declare native synchronized strictfp inline virtual explicit constexpr consteval extern friend pub unsafe const crate".split())
# Texts that stand in for documentation, and the words of tool directives.
_PLACEHOLDER = frozenset("todo fixme tbd tba xxx hack wip none n a na no description doc docs documentation missing placeholder undocumented see above below describe me this function method comment here add write later summary description goes ignore internal".split())
_DIRECTIVE = re.compile(
    r"(?i)^\s*(?:noqa\b|nolint\w*|pylint\b|pyright\b|mypy\b|type:\s*ignore|flake8\b|isort\b|fmt:\s*(?:on|off|skip)|yapf\b|black\b|pragma\b|eslint\b[\w-]*|tslint\b[\w:-]*|jshint\b|jslint\b|prettier-ignore\w*|istanbul\b|c8 ignore|@ts-\w+|ts-\w+|@?suppresswarnings\b|noinspection\b|checkstyle\b|spotless\b|spotbugs\b|nosonar\b|cspell\b|codespell\b|clang-format\b|clang-tidy\b|clang\b|cppcheck\b|iwyu\b|rustfmt\b|clippy\b|allow\(|go:\w+|\+build\b|golangci\b|lint:\w*|exported\b|rubocop\b|steep\b|sorbet\b|typed:|frozen_string_literal\b|encoding:|coding[:=]|vim?:|-\*-|region\b|endregion\b|coverage\b|nocov\b|:nocov:|nosec\b|sourcemappingurl\b|@?generated\b|@formatter:\w+|skipcq\b|deepsource\b|biome-ignore\b|deno-\w+|webpack\w*|@__pure__|#__pure__|shellcheck\b).*$"
)
_TAG = re.compile(r"^\s*(?:[@\\][a-zA-Z]+\b|:[a-z]+(?:\s+[\w.*]+)?:|#\s+(?:Errors|Panics|Safety|Arguments|Returns|Examples?)\b|(?:Args|Arguments|Parameters|Params|Returns?|Raises|Yields|Throws|Errors|Panics|Safety|Examples?|Note|Notes)\s*:?\s*$).*$", re.I)
_STEM = re.compile(r"(?:ing|ed|es|s|e)$")
_FILLER = frozenset("the a an this that of to for and or in on it its is are be function method procedure routine subroutine func def fn callable helper class given from with by which does do will our all performs perform implements implementation simply just new member wrapper".split())


def split_name(name: str) -> list[str]:
    """Lower-case parts of an identifier."""
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]


_CODE_LINE = re.compile(
    r"[;{}]\s*$"
    r"|^[\w.\[\]]+\s*(?:[-+*/|&]?=|:=|<-)\s*\S"
    r"|^(?:return|if|for|while|def|fn|func|let|const|var|auto|int|elif|else|raise|throw|print|puts|assert|class)\b.*(?:[=(){};]|:\s*$)"
    r"|^(?:import|from|use|require|include)\s+[\w.:'\"{}*]+(?:\s+import\s+[\w, *]+)?$"
    r"|^[\w.:>-]+\([^)]*\)\s*[;:{]?\s*$|^@\w+\(|^end$|^[)\]}]+[;,]?$"
)
# Banners of a file that happen to stand above a function.
_BANNER = re.compile(r"(?i)^\s*[!*]?\s*(?:[\w./@-]+\s+v?\d+\.\d+(?:\.\d+)*\S*|.*\b(?:copyright|all rights reserved|spdx-license|licensed under|@license|@preserve)\b.*)\s*\*?$")


def _looks_like_code(line: str) -> bool:
    return _CODE_LINE.search(line.strip()) is not None


def plain_text(raw: list[str]) -> list[str]:
    """Documentation lines without comment marks, rulers and directives."""
    out = []
    for line in raw:
        s = line.strip()
        if not s or not re.search(r"\w", s) or _DIRECTIVE.match(s) or _BANNER.match(s):
            continue
        out.append(s)
    return out


def telling(name: str, lines: list[str], owner: str = "") -> bool:
    """Whether documentation tells a reader more than the function's name."""
    body = []
    for s in plain_text(lines):
        if _TAG.match(s):
            m = re.match(r"^\s*[@\\:]?(?:brief|summary|description|details|desc|short)\b:?\s*(.*)$", s, re.I)
            if not m:
                break  # tags come last, and what follows one describes a parameter or result
            if not m[1]:
                continue
            s = m[1]
        body.append(s)
    if not body:
        return False
    code = sum(_looks_like_code(s) for s in body)
    if code * 2 > len(body):
        return False
    words = [w.lower() for w in re.findall(r"[^\W_]+(?:'\w+)?", re.sub(r"<[^<>]*>|\{@\w+\s*|`", " ", " ".join(split_camel(s) for s in body)))]
    if not words:
        return False
    if all(w in _PLACEHOLDER or w.isdigit() for w in words):
        return False
    known = {_STEM.sub("", w) for w in split_name(name)} | {name.lower()} | {_STEM.sub("", w) for w in split_name(owner)}
    news = [w for w in words if w not in _FILLER and _STEM.sub("", w) not in known and w not in _PLACEHOLDER and not w.isdigit()]
    return len(news) >= 2


def split_camel(s: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|_", " ", s)


class _File:
    """Functions of one parsed file."""

    def __init__(self, lang: str, text: str, tree):
        self.lang, self.text, self.tree = lang, text, tree
        self.starts = [0, *[m.end() for m in re.finditer("\n", text)]]
        self.comments: dict[int, tuple[int, int, str]] = {}  # last line -> (first line, position, text)
        for kind, t, at in tree.tokens:
            if kind == "com" and not text[self.starts[self.line(at) - 1] : at].strip():
                rest = text[at + len(t) :].split("\n", 1)[0]
                if not rest.strip():
                    self.comments[self.line(at + len(t.rstrip()) - 1)] = (self.line(at), at, t)

    def line(self, at: int) -> int:
        lo, hi = 0, len(self.starts)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if self.starts[mid] <= at:
                lo = mid
            else:
                hi = mid
        return lo + 1

    def name_at(self, at: int) -> str:
        m = re.compile(r"[#@$~]?[^\W\d][\w$]*[?!=]?" if self.lang == "ruby" else r"#?[\w$]+").match(self.text, at)
        return m[0] if m else ""

    def functions(self) -> Iterator[tuple[str, int, int, int, list[str]]]:
        """(name, line of the declaration, start, end, documentation lines)."""
        if self.lang == "python":
            yield from self._python(self.tree.nodes)
        elif self.lang == "ruby":
            yield from self._ruby(self.tree.nodes)
        else:
            yield from self._braces(self.tree.nodes, "")

    # -- Python ---------------------------------------------------------------------------------

    def _python(self, nodes: list) -> Iterator[tuple]:
        for i, (kind, at, c) in enumerate(nodes):
            if kind == "def" and i + 1 < len(nodes):
                start = nodes[i - 1][1] if i and nodes[i - 1][0] == "async" else at
                k = i + 1
                while k < len(nodes) and nodes[k][0] != ":":
                    k += 1
                body = nodes[k + 1] if k + 1 < len(nodes) else None
                first = (body[2] if body and body[0] == "I" else nodes[k + 1 :]) or []
                n = 0
                while n < len(first) and first[n][0] == "STR":
                    n += 1
                doc = None
                if n and n < len(first) + 1 and (n == len(first) or first[n][0] in ("NL", ";")):
                    doc = self._strings([x[1] for x in first[:n]])
                end = self._end(body[2] if body and body[0] == "I" else nodes[k + 1 : k + 2 + n], at)
                yield self.name_at(nodes[i + 1][1]), self.line(start), start, end, doc or []
            if c:
                yield from self._python(c)

    def _strings(self, places: list[int]) -> list[str] | None:
        out = []
        for p in places:
            m = re.compile(r"(?i)([a-z]*)(\"\"\"|'''|\"|')").match(self.text, p)
            if not m or set(m[1].lower()) & set("fbt"):
                return None
            q = m[2]
            e = m.end()
            while not self.text.startswith(q, e):
                e += 2 if self.text[e] == "\\" else 1
                if e >= len(self.text):
                    return None
            out.append(self.text[m.end() : e])
        return re.split(r"\n|(?<!\\)\\n", "".join(out))

    def _end(self, nodes: list, at: int) -> int:
        last = at
        for _, p, c in nodes:
            last = max(last, p, self._end(c, p) if c else p)
        e = self.text.find("\n", last)
        return len(self.text) if e < 0 else e

    # -- Ruby -----------------------------------------------------------------------------------

    def _ruby(self, nodes: list) -> Iterator[tuple]:
        for i, (kind, at, c) in enumerate(nodes):
            inner = c if kind == "K" and c and c[0][0] == "def" else nodes[i : i + 4] if kind == "def" and (i or not nodes or nodes[0][0] == "def") else None
            if inner and len(inner) > 1 and (kind == "K" or nodes is not c):
                if kind == "K" or not self._inside_k:
                    k = 1
                    while k + 2 < len(inner) and inner[k + 1][0] in (".",):
                        k += 2
                    start = inner[0][1]
                    s = self.starts[self.line(start) - 1]
                    yield self.name_at(inner[k][1]), self.line(start), start, self._end(c or inner, start), self._above(self.line(s if self.text[s:start].strip() else start))
            if c:
                self._inside_k = kind == "K" and c[0][0] == "def"
                yield from self._ruby(c[1:] if self._inside_k else c)
                self._inside_k = False

    _inside_k = False

    # -- braces ---------------------------------------------------------------------------------

    def _braces(self, nodes: list, owner: str) -> Iterator[tuple]:
        start = 0  # first node of the current declaration
        for i, (kind, at, c) in enumerate(nodes):
            if kind == "B":
                head = nodes[start:i]
                hit = self._header(head)
                if hit is not None:
                    name_at, first = hit
                    begin = self._begin(head, first)
                    yield self.name_at(name_at).lstrip("#~") or "", self.line(begin), begin, self._close(at, c), self._leading(self._outer(head, begin))
                yield from self._braces(c, "")
                if i + 1 < len(nodes) and nodes[i + 1][0] in (";", ";nl", ",", ")", "else", "."):
                    pass
                start = i + 1
            elif kind in (";", ";nl", ",", "PP") or (kind == ":" and i and nodes[i - 1][0] in ("public", "private", "protected")):
                start = i + 1
            elif c:
                yield from self._braces(c, "")

    def _header(self, head: list) -> tuple[int, int] | None:
        """(position of the name, index of its node) if a block's head declares a named function."""
        kinds = [h[0] for h in head]
        lang = self.lang
        if not head:
            return None
        if lang == "go":
            if kinds[0] != "func":
                return None
            k = 2 if len(kinds) > 2 and kinds[1] == "P" else 1
            return (head[k][1], 0) if k < len(kinds) and kinds[k] == "ID" else None
        if lang == "rust":
            if "fn" not in kinds:
                return None
            k = kinds.index("fn")
            return (head[k + 1][1], k) if k + 1 < len(kinds) and head[k + 1][2] is None and kinds[k + 1] != "P" else None
        if "P" not in kinds and "=>" not in kinds:
            return None
        if lang in ("js", "jsx", "ts", "tsx"):
            if "function" in kinds:
                k = kinds.index("function")
                n = k + 1 + (k + 1 < len(kinds) and kinds[k + 1] == "*")
                if n < len(kinds) and kinds[n] not in ("P", "<"):
                    return head[n][1], k
                return self._assigned(head, kinds, k)
            if "=>" in kinds:
                return self._assigned(head, kinds, len(kinds) - 1 - kinds[::-1].index("=>"))
            if any(k in ("class", "interface", "enum", "namespace", "new", "=", "return", "import", "?", "&&", "||") for k in kinds):
                return None
            p = kinds.index("P")
            if p and kinds[p - 1] == ">":
                depth = 0
                for q in range(p - 1, -1, -1):
                    depth += (kinds[q] == ">") - (kinds[q] == "<")
                    if not depth:
                        p = q
                        break
            if p and kinds[0] == "@":
                # the member's own parameters are the last ones
                p = max(q for q, k in enumerate(kinds) if k == "P")
            n = p - 1
            if n < 0 or head[n][2] is not None or kinds[n] in _CONTROL or kinds[n] in (".", ")", "super") or (n and kinds[n - 1] in (".", "new", "+", "-", "!", "*") and kinds[n - 1] != "*"):
                return None
            return (head[n][1], n) if re.match(r"#?[\w$]", self.text[head[n][1]]) else None
        if lang == "java":
            if any(k in ("class", "interface", "enum", "record", "new", "=", "return", "switch", "->") for k in kinds if k != "record") or kinds[0] in _CONTROL:
                return None
            ps = [q for q, k in enumerate(kinds) if k == "P" and q and kinds[q - 1] not in (">",) and head[q - 1][2] is None]
            ps = [q for q in ps if not (kinds[q - 1] == "ID" and q >= 2 and kinds[q - 2] in ("@", ".") and self._annotated(kinds, q - 1))]
            if not ps or kinds[ps[-1] - 1] in _CONTROL:
                return None
            return head[ps[-1] - 1][1], ps[-1] - 1
        # C++
        if kinds[0] in _CONTROL or any(k in ("class", "struct", "union", "enum", "namespace", "=", "return", "new") for k in kinds if not (k in ("class", "struct") and "<" in kinds)) or "P" not in kinds:
            return None
        depth = 0
        for q, k in enumerate(kinds):
            depth += (k == "<") - (k == ">")
            if k == "P" and depth <= 0 and q:
                if kinds[q - 1] in ("alignas", "explicit", "noexcept", "decltype", "requires"):
                    continue
                if kinds[q - 1] in _CONTROL or kinds[q - 1] != "ID":
                    return None
                if "operator" in kinds[:q]:
                    return None
                return head[q - 1][1], q - 1
        return None

    @staticmethod
    def _annotated(kinds: list, k: int) -> bool:
        while k >= 0 and kinds[k] in ("ID", "."):
            k -= 1
        return k >= 0 and kinds[k] == "@"

    @staticmethod
    def _assigned(head: list, kinds: list, k: int) -> tuple[int, int] | None:
        """Name of the variable, field or property that an unnamed function is assigned to."""
        if "=" in kinds[:k]:
            e = kinds.index("=")
            n = next((q for q in range(e) if kinds[q] == "ID" and (q == 0 or kinds[q - 1] in ("const", "let", "var", "static", "readonly", "public", "private", "protected"))), None)
            if n is not None and (e == n + 1 or kinds[n + 1] in (":", "!", "?")) and all(x in ("async", "P", "=>", "=", "ID", ":", "<", ">", "function", "*", "S", "|", "[", ",", "STR", "NUM", "null", "void", "B", ".") for x in kinds[e:]):
                return head[n][1], n
        return None

    def _begin(self, head: list, first: int) -> int:
        """Where the declaration with the name begins: after annotations, attributes and template heads."""
        kinds = [h[0] for h in head]
        k, lang = 0, self.lang
        while k < first:
            if kinds[k] == "@" and lang in ("java", "ts", "tsx", "js", "jsx"):
                k += 2
                while k + 1 < len(kinds) and kinds[k] == ".":
                    k += 2
                if k < first and kinds[k] == "P":
                    k += 1
            elif kinds[k] == "#" and lang == "rust":
                k += 2 if kinds[k + 1] == "S" else 3
            elif kinds[k] == "S" and lang == "cpp":
                k += 1
            elif kinds[k] == "template" and lang == "cpp":
                k += 1
                depth = 0
                while k < first:
                    depth += (kinds[k] == "<") - (kinds[k] == ">")
                    k += 1
                    if not depth:
                        break
            elif kinds[k] == ";nl":
                k += 1
            else:
                break
        return head[min(k, len(head) - 1)][1]

    @staticmethod
    def _outer(head: list, begin: int) -> int:
        return next((h[1] for h in head if h[0] != ";nl"), begin)

    def _close(self, at: int, nodes: list) -> int:
        last = self._end_brace(nodes, at)
        e = self.text.find("}", last + 1 if nodes else at)
        return (e if e >= 0 else len(self.text) - 1) + 1

    def _end_brace(self, nodes: list, at: int) -> int:
        last = at
        for kind, p, c in nodes:
            if c is not None:
                last = max(last, self._close(p, c) - 1 if kind == "B" else self._end_brace(c, p))
            else:
                last = max(last, p)
        return last

    def _leading(self, at: int) -> list[str]:
        """Documentation above a declaration that is the first thing on its line."""
        line = self.line(at)
        return [] if self.text[self.starts[line - 1] : at].strip() else self._above(line)

    def _above(self, line: int) -> list[str]:
        """Lines of the comment that ends on the line above; neighbouring line comments are one."""
        hit = self.comments.get(line - 1)
        if hit is None:
            return []
        blocks = [hit]
        if not hit[2].startswith("/*"):
            while (up := self.comments.get(blocks[-1][0] - 1)) is not None and not up[2].startswith("/*"):
                blocks.append(up)
            # a directive may stand between a block comment and the function
            if not plain_text([re.sub(r"^(?:///?!?|#+)\s?", "", b[2]) for b in blocks]) and (up := self.comments.get(blocks[-1][0] - 1)) is not None:
                blocks.append(up)
        out: list[str] = []
        for _, _, t in reversed(blocks):
            if t.startswith("/*"):
                t = t[2:-2].lstrip("*!")
                out += [re.sub(r"^\s*\*+(?!/)\s?", "", s) for s in t.split("\n")]
            elif self.lang == "rust" and t.startswith("//!"):
                out = []
            elif t.startswith("=begin"):
                out += t.split("\n")[1:-1]
            else:
                out.append(re.sub(r"^(?:/{2,}[!<]?|#+:?)", "", t))
        return out


def pairs_of(path: str, text: str) -> Iterator[tuple[str, int, str, str]]:
    """(name, line, code, documentation) of the documented functions of a file that parses."""
    j = judge(path, text, count=False)
    if j is None or j[1] or j[0] not in _LANGS:
        return
    f = _File(j[0], text, j[4])
    for name, line, start, end, doc in f.functions():
        if name and doc and telling(name, doc):
            yield name, line, text[start:end], "\n".join(plain_text(doc))


def documented_functions(sources: DataFrame) -> DataFrame:
    """(repo_path, path, func_name, func_line, code, documentation) over all current files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(r, p, *x) for r, p, t in zip(f["repo_path"], f["path"], f["content"]) for x in pairs_of(p, t)]
            yield pd.DataFrame(out, columns=["repo_path", "path", "func_name", "func_line", "code", "documentation"])

    files = current(sources).where("content IS NOT NULL")
    return files.mapInPandas(run, "repo_path string, path string, func_name string, func_line int, code string, documentation string")
