"""Bracket trees: tokens grouped by brackets, indentation or keywords, with the repairs this takes.

A node is (kind, position, children); children are None for plain tokens. Groups with equal content
share one number (hash consing), so the parser meets every shape of content once.
"""

from __future__ import annotations

from loomspark.llm.code.grammars import RESERVED, SOFT
from loomspark.llm.code.lexer import lex

_OPEN = {"(": ("P", ")"), "[": ("S", "]"), "{": ("B", "}")}
_SHUT = {")": "(", "]": "[", "}": "{"}
_JS = {"js", "jsx", "ts", "tsx", "qml"}
_KIND = {"num": "NUM", "str": "STR", "jsx": "JSX", "life": "LIFE", "pp": "PP", "nl": "NL"}
_WORDS: dict[str, frozenset] = {}
# C preprocessor directives.
_DIRECTIVES = frozenset("include define undef if ifdef ifndef elif elifdef elifndef else endif line error warning pragma import include_next".split())


def _known(lang: str) -> frozenset:
    if lang not in _WORDS:
        base = {"ts": "js", "qml": "js", "jsx": "js", "tsx": "js"}.get(lang, lang)
        _WORDS[lang] = frozenset((RESERVED[base] + " " + SOFT[base]).split())
    return _WORDS[lang]


class Tree:
    """A file's nodes and the repairs made below the level of grammar: (position, what)."""

    __slots__ = ("nodes", "repairs", "tokens", "truncated")

    def __init__(self, lang: str, text: str):
        self.repairs: list[tuple[int, str]] = []
        self.truncated = False
        self.tokens = lex(lang, text)
        words = _known(lang)
        flat: list[tuple[str, int]] = []
        for kind, t, at in self.tokens:
            if kind == "com":
                continue
            if kind == "bad":
                what = "conflict" if t[:7] in ("<<<<<<<", ">>>>>>>", "=======", "|||||||") else "token"
                self.repairs.append((at, what))
                continue
            if kind == "pp" and not self._directive(t):
                self.repairs.append((at, "token"))
                continue
            flat.append(((t if t in words else "ID") if kind == "id" else t if kind == "op" else _KIND[kind], at))
        flat.append(("", len(text)))
        if lang == "python":
            flat = self._indent(flat, text)
        elif lang == "go":
            flat = self._go(flat)
        elif lang in _JS:
            flat = self._semicolons(flat)
        elif lang == "ruby":
            flat = self._ruby_lines(flat)
        self.nodes = self._group(flat, lang)
        if lang == "ruby":
            self.nodes = _keywords(self, self.nodes)

    @staticmethod
    def _directive(t: str) -> bool:
        word = t.lstrip().lstrip("#").strip().split(None, 1)
        return not word or word[0].split("(")[0].split("<")[0].split('"')[0] in _DIRECTIVES or word[0].isdigit()

    def _indent(self, flat: list, text: str) -> list:
        """Python: line ends outside brackets; IN and OUT marks around indented blocks."""
        out, stack, depth, start = [], [0], 0, True
        line_at = 0
        for k, (kind, at) in enumerate(flat):
            if kind == "NL":
                if not depth and not start:
                    out.append(("NL", at))
                    start = True
                continue
            if start and kind:
                line_at = text.rfind("\n", 0, at) + 1
                width = 0
                for c in text[line_at:at]:
                    width = width + 8 - width % 8 if c == "\t" else 0 if c == "\f" else width + 1
                if width > stack[-1]:
                    stack.append(width)
                    if len(out) > 1 and out[-1][0] == "NL" and out[-2][0] == ":":
                        out.pop()
                    out.append(("IN", at))
                else:
                    while width < stack[-1]:
                        stack.pop()
                        out.append(("OUT", at))
                    if width != stack[-1]:
                        self.repairs.append((at, "indent"))
                        stack.append(width)
                        out.append(("IN", at))
                start = False
            if kind in _OPEN:
                depth += 1
            elif kind in _SHUT:
                depth = max(0, depth - 1)
            if not kind:
                if not start:
                    out.append(("NL", at))
                out.extend(("OUT", at) for _ in stack[1:])
            out.append((kind, at))
        return out

    @staticmethod
    def _go(flat: list) -> list:
        out: list = []
        ends = {"ID", "NUM", "STR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}
        for kind, at in flat:
            if kind == "NL" or not kind:
                if out and out[-1][0] in ends:
                    out.append((";", at))
                if kind:
                    continue
            out.append((kind, at))
        return out

    @staticmethod
    def _semicolons(flat: list) -> list:
        """JavaScript: a soft ';' where a line end separates a value from what cannot continue it."""
        ends = {"ID", "NUM", "STR", "JSX", ")", "]", "}", "this", "null", "true", "false", "super", "break", "continue", "return", "++", "--", "debugger"} | set(SOFT["js"].split())
        goes_on = {"", ".", ",", "(", "[", "{", "?", ":", "=", "=>", "else", "catch", "finally", "instanceof", "in", "of", "?.", "&&", "||", "??", "+", "-", "*", "/", "%", "==", "!=", "===", "!==", "<", ">", "<=", ">=", "&", "|", "^", "<<", "+=", "-=", "*=", "/=", ")", "]", ";", "extends", "implements", "as", "satisfies", "is", "from"}
        out: list = []
        line = False
        braces: list[str] = []
        opened: list[int] = []
        headed = False  # the last ')' closes the head of if, while, for or with, or a decorator's arguments
        for kind, at in flat:
            if kind == "NL":
                line = True
                continue
            if line and out and (not braces or braces[-1] == "{"):
                last = out[-1][0]
                stop = last in ends and kind not in goes_on and not (last == ")" and headed) and not (last == "}" and kind == "while") and not (len(out) > 1 and out[-2][0] == "@")
                if stop:
                    out.append((";nl", out[-1][1]))
            line = False
            if kind in _OPEN:
                braces.append(kind)
                opened.append(len(out))
            elif kind in _SHUT and braces:
                braces.pop()
                o = opened.pop()
                before = out[o - 1][0] if o else ""
                back = o - 1
                while back > 0 and out[back][0] in ("ID", "."):
                    back -= 1
                headed = kind == ")" and (before in ("if", "while", "for", "with", "await") or (back >= 0 and out[back][0] == "@" and back < o - 1))
            out.append((kind, at))
        return out

    @staticmethod
    def _ruby_lines(flat: list) -> list:
        goes_on = {",", "(", "[", "{", ".", "&.", "&&", "||", "=", "+", "-", "*", "/", "%", "==", "!=", "<", "<=", ">=", "<<", "=~", "=>", "+=", "-=", "*=", "||=", "&&=", "?", "and", "or", "not", "::", "\\", "!", "NL"}
        out: list = []
        following, nxt = [""] * len(flat), ""  # the next kind that is no line end
        for n in range(len(flat) - 1, -1, -1):
            following[n] = nxt
            nxt = flat[n][0] if flat[n][0] != "NL" else nxt
        for n, (kind, at) in enumerate(flat):
            if kind == "NL":
                nxt = following[n]
                if not out or out[-1][0] in goes_on or nxt in (".", "&."):
                    continue
            if kind == "\\":
                continue
            out.append((kind, at))
        return out

    def _group(self, flat: list, lang: str) -> list:
        """Nested nodes; brackets that do not match are repaired at one edit each."""
        top: list = []
        stack: list[tuple[str, int, list]] = [("", 0, top)]
        for kind, at in flat:
            if kind in _OPEN or kind == "IN":
                stack.append((kind, at, []))
            elif kind in _SHUT or kind == "OUT":
                want = "IN" if kind == "OUT" else _SHUT[kind]
                depth = next((d for d in range(1, len(stack)) if stack[-d][0] == want), 0)
                if not depth or (depth > 1 and kind != "OUT" and any(stack[-d][0] == "IN" for d in range(1, depth))):
                    if kind == "OUT":
                        continue
                    self.repairs.append((at, "bracket"))
                    continue
                for d in range(depth):
                    o, a, inner = stack.pop()
                    if d < depth - 1:
                        self.repairs.append((a, "bracket"))
                    stack[-1][2].append(("I" if o == "IN" else _OPEN[o][0], a, inner))
            elif kind:
                stack[-1][2].append((kind, at, None))
        while len(stack) > 1:
            o, a, inner = stack.pop()
            if o != "IN":
                self.repairs.append((a, "bracket"))
                self.truncated = True
            stack[-1][2].append(("I" if o == "IN" else _OPEN[o][0], a, inner))
        return top


_OPENERS = {"def", "class", "module", "begin", "case", "for", "if", "unless", "while", "until"}
_CLAUSES = {"rescue", "else", "elsif", "ensure", "when"}
_VALUES = {"ID", "NUM", "STR", "P", "S", "B", "K", "D", "nil", "true", "false", "self", "super", "redo", "retry", "break", "next", "return", "yield"}


def _keywords(tree: Tree, nodes: list) -> list:
    """Ruby: groups from an opening keyword or 'do' to its 'end'; each clause's statements are a T group."""
    nodes = [(k, a, None if c is None else _keywords(tree, [n for n in c if k == "B" or n[0] != "NL"])) for k, a, c in nodes]
    out: list = []
    # frames: (kind, position, finished parts, statements of the open clause or None while in a head, loop head)
    frames: list[list] = [["", 0, [], out, False]]

    def emit(n: tuple) -> None:
        f = frames[-1]
        (f[2] if f[3] is None else f[3]).append(n)

    prev, before = "NL", ""
    for n, (kind, at, c) in enumerate(nodes):
        f = frames[-1]
        nxt = nodes[n + 1][0] if n + 1 < len(nodes) else ""
        named = prev in (".", "&.", "::") or (prev == "def" and kind != "self") or (nxt == ":" and prev in (",", "|", "NL", "STR", "ID") and kind in _OPENERS | _CLAUSES | {"end", "do", "in", "then"})
        word = None if named or c is not None else kind
        if word in _OPENERS and not (word in ("if", "unless", "while", "until") and prev in _VALUES) and not (word == "class" and prev == "."):
            if word == "def":
                k = n + 1
                while k < len(nodes) and nodes[k][0] not in ("NL", "P", ";", "="):
                    k += 1
                k += k < len(nodes) and nodes[k][0] == "P"
                if k < len(nodes) and nodes[k][0] == "=" and not (k + 1 < len(nodes) and nodes[k + 1][0] == "P"):
                    emit((kind, at, c))
                    prev = kind
                    continue
            frames.append(["K", at, [(kind, at, None)], [] if word == "begin" else None, word in ("while", "until", "for"), word])
        elif word == "do" and not (f[0] == "K" and f[3] is None and f[4]):
            frames.append(["D", at, [], None if nxt == "|" else [], False, "do"])
        elif f[0] and f[3] is None and (word in ("NL", "then", "do") or kind == ";" or (f[0] == "D" and kind == "|" and f[2] and len([x for x in f[2] if x[0] == "|"]) == 1)):
            if kind == "|":
                f[2].append((kind, at, None))
            f[3] = []
        elif f[0] and word in _CLAUSES and f[3] is not None and not (word == "rescue" and prev in _VALUES) or (f[0] == "K" and len(f) > 5 and f[5] == "case" and word == "in" and prev in ("NL", ";")):
            f[2] += [("T", at, f[3]), (kind, at, None)]
            f[3] = [] if word in ("else", "ensure") else None
        elif word == "end":
            if not f[0]:
                tree.repairs.append((at, "bracket"))
            else:
                frames.pop()
                f[2].append(("T", at, f[3] or []))
                emit((f[0], f[1], f[2]))
                kind = f[0]
        else:
            emit(("ID" if named and c is None and kind not in ("ID", "P", "S", "B", "NL", "STR", "NUM") and kind.isalpha() else kind, at, c))
        before, prev = prev, kind if word != "end" else "K"
    while len(frames) > 1:
        f = frames.pop()
        tree.repairs.append((f[1], "bracket"))
        tree.truncated = True
        f[2].append(("T", f[1], f[3] or []))
        emit((f[0], f[1], f[2]))
    return out
