"""Minimum-cost syntax repair of whole files."""

from __future__ import annotations

from loomspark.llm.code.chart import Chart
from loomspark.llm.code.grammars import COMMA, FAMILY, STATEMENTS, UNIT, grammar
from loomspark.llm.code.tree import Tree

_GROUPS = frozenset("PSBIKDT")
#: Levels of groups whose costs are found by recursion; those below are found first, on their own.
LEVELS = 40
# What follows a block and still belongs to its statement, by language.
_COMMON = {";", ";nl", ",", ".", "else", "catch", "finally", "while", "B", "="}
_AFTER = {
    "js": _COMMON | set("( [ ? : ) && || ?? + - * / in of from as == === != !== ?. instanceof = | & ^ % > <= >= ** << ??".split()) | {"P", "S", "satisfies"},
    "java": _COMMON | {")", "->", "::"},
    "cpp": _COMMON | {"(", ")", "P", "S", "ID", ":", "*", "&", "?", "||", "&&", "->", "..."} - {"ID"},
    "rust": {";", ",", ".", "?", "else", "=", "==", "as", "..", "=>", ")"},
}
_AFTER["ts"] = _AFTER["js"] | {"<"}
_AFTER["qml"] = _AFTER["js"]


class _Deeper(Exception):
    """A group too far down whose cost must be found first."""


class Parser:
    """Repair costs of one language's files. Costs of equal content are computed once."""

    def __init__(self, lang: str):
        self.lang = FAMILY.get(lang, lang)
        self.g = grammar(self.lang)
        self.chart = Chart(self.g, self._inside, self._admits)
        self.numbers: dict[tuple, str] = {}
        self.classes: dict[tuple, int] = {}
        self.modes: dict[str, frozenset] = {}
        self.costs: dict[tuple[str, str], int] = {}
        self.fine: dict[tuple, str] = {}
        self.coarse: dict[str, str] = {}
        self.kinds: dict[str, tuple] = {}
        self.named: dict[int, str] = {}
        self.rules: dict[str, set] = {}
        for _, body in self.g.flat:
            for t in body:
                if t[1:2] == ":" and t[0] != "'":
                    self.rules.setdefault(t[0], set()).add(t[2:])
        self.valid: dict[tuple, bool] = {}
        self.level = 0
        self.strict = False  # whether the caller asks only for costs of 0
        self.minimal = True  # whether the cost of the last file is certainly the least of the whole file

    def kind(self, node: tuple) -> str:
        """A token's kind, or a group's: valid groups are told apart only by the rules their content
        fits, so that equal outlines of different code share their parse; others by their content."""
        k, _, c = node
        if c is None:
            return k
        name = self.named.get(id(node))
        if name is not None:
            return name
        key = (k, tuple([x[0] if x[2] is None else self.kind(x) for x in c]))
        name = self.numbers.get(key)
        if name is None:
            fits = frozenset(r for r in self.rules.get(k, ()) if self._fits(k, r, key[1]))
            if fits:
                n = self.classes.setdefault((k, fits), len(self.classes))
                name = f"#{k}~{n}"
                self.modes[name] = fits
            else:
                name = f"#{k}{len(self.numbers)}"
            self.numbers[key] = name
        self.named[id(node)] = name
        return name

    def _exactly(self, node: tuple) -> str:
        """The kind of a token or group whose cost is asked for: all different contents are told apart."""
        k, _, c = node
        if c is None:
            return k
        kinds = tuple([x[0] if x[2] is None else self._exactly(x) for x in c])
        key = (self.kind(node), kinds)
        name = self.fine.get(key)
        if name is None:
            name = self.fine[key] = f"{key[0]}.{len(self.fine)}"
            self.coarse[name], self.kinds[name] = key
        return name

    def _fits(self, bracket: str, rule: str, kinds: tuple) -> bool:
        held, self.strict = self.strict, True
        try:
            return self.content(bracket, rule, kinds) == 0
        finally:
            self.strict = held

    def _admits(self, kind: str, rule: str) -> bool:
        return rule in self.modes.get(self.coarse.get(kind, kind), ())

    def _inside(self, kind: str, rule: str) -> int:
        """Cost of a group's content: 0, 1, or 2 for all above, since the chart can put a new group in its
        place for two edits."""
        if self._admits(kind, rule):
            return 0
        key = (kind, rule)
        c = self.costs.get(key)
        if c is None:
            if self.level == LEVELS:
                raise _Deeper(key)
            self.level += 1
            try:
                c = self.costs[key] = max(1, self.content(kind[1], rule, self.kinds[kind], 2))
            finally:
                self.level -= 1
        return c

    def _priced(self, rule: str, kinds: tuple) -> int:
        """Repair cost of one piece with groups nested to any depth."""
        waiting: list[tuple[str, str]] = []
        while True:
            try:
                if not waiting:
                    return self._statement(rule, kinds)
                self._inside(*waiting[-1])
                waiting.pop()
            except _Deeper as e:
                waiting.append(e.args[0])

    def content(self, bracket: str, rule: str, kinds: tuple, cap: int | None = None) -> int:
        """Cost of a group's content under a rule; where it is ``cap`` or more, at least ``cap``."""
        if rule == "any":
            return 0
        if rule in STATEMENTS[self.lang] and bracket not in "PS":
            total = 0
            for part in self.statements(kinds):
                total += self._statement(STATEMENTS[self.lang][rule], part, cap)
                if total and (self.strict or total == cap):
                    break
            return total if cap is None else min(total, cap)
        if (bracket, rule) in COMMA[self.lang]:
            kinds = tuple(k for k in kinds if k not in (";nl", "NL", "PP"))
            if self.lang == "python" and (rule == "group" or rule == "elems" or rule == "entries" or rule == "args") and "for" in kinds:
                return self._statement({"entries": "entry", "args": "arg"}.get(rule, rule), kinds, cap)
            return self._commas(*COMMA[self.lang][bracket, rule], kinds, rule, cap)
        if self.lang == "ruby" and bracket in "PS":
            kinds = tuple(k for k in kinds if k != "NL")
        elif bracket in "PS":
            kinds = tuple(k for k in kinds if k not in (";nl", "PP"))
        return self._statement(rule, kinds, cap)

    def _commas(self, element: str, empty: bool, trailing: bool, kinds: tuple, rule: str, cap: int | None = None) -> int:
        if not kinds:
            return 0
        parts: list[list] = [[]]
        open_ = 0
        for n, k in enumerate(kinds):
            if k == "<":
                open_ += 1
            elif k == ">" and open_:
                open_ -= 1
            if k == "," and not (open_ and self._closes(kinds, n)):
                parts.append([])
            else:
                parts[-1].append(k)
        total = 0
        if not parts[-1] and len(parts) > 1:
            parts.pop()
            total += 0 if trailing or empty or rule == "group" else 1
        for p in parts:
            if not p:
                total += 0 if empty else 1
            else:
                total += self._statement(element, tuple(p), cap)
            if total and (self.strict or total == cap):
                break
        return total if cap is None else min(total, cap)

    def _closes(self, kinds: tuple, n: int) -> bool:
        """Whether the angle bracket open at a comma is closed by what may only be type arguments."""
        if self.lang not in ("ts", "java", "rust", "cpp"):
            return False
        depth = 1
        for k in kinds[n + 1 :]:
            if k == "<":
                depth += 1
            elif k == ">":
                depth -= 1
                if not depth:
                    return True
            elif k in ("&&", "||", ";", "+", "-", "/", "==", "NUM", "STR") and self.lang != "rust" and self.lang != "cpp":
                return False
        return False

    def _statement(self, rule: str, kinds: tuple, cap: int | None = None) -> int:
        """Repair cost of one piece; only whether it is 0 where the caller asks no more."""
        key = (rule, tuple([self.coarse.get(k, k) for k in kinds]))
        known = self.valid.get(key)
        if known is None:
            if len(self.valid) > 300_000:
                self.valid.clear()
            known = self.valid[key] = not self._barred(*key) and (self.chart._exact(*key) or self._soft(*key))
        if known:
            return 0
        return 1 if self.strict else max(1, self.chart.cost(rule, kinds, cap))

    def _barred(self, rule: str, kinds: tuple) -> bool:
        """JavaScript: what the grammar would take for an assignment or a declaration, but is none."""
        if self.lang not in ("js", "ts", "qml") or rule != "stm" or len(kinds) < 2:
            return False
        if kinds[0] in ("NUM", "STR") and kinds[1] == "=":
            return True
        if kinds[0] in ("let", "const") and kinds[1] == "let":
            return True
        return self.lang == "js" and kinds[:2] == ("const", "ID") and (len(kinds) == 2 or kinds[2:] in ((";",), (";nl",)))

    def _soft(self, rule: str, kinds: tuple) -> bool:
        """JavaScript: the statement is whole with the ';' that its end supplies."""
        return self.lang in ("js", "ts", "qml") and rule in ("stm", "class_body", "qml", "cases") and kinds and kinds[-1] not in (";", ";nl") and self.chart._exact(rule, (*kinds, ";nl"))

    def statements(self, kinds: tuple) -> list[tuple]:
        """Pieces of a statement list that the grammar can parse one by one."""
        return [tuple(kinds[a:b]) for a, b in self.cuts(kinds)]

    def cuts(self, kinds: tuple) -> list[tuple[int, int]]:
        lang, n = self.lang, len(kinds)
        out, start = [], 0
        if lang == "python":
            for i, k in enumerate(kinds):
                if k == "NL" or k[:2] == "#I":
                    nxt = kinds[i + 1] if i + 1 < n else ""
                    if nxt in ("elif", "else", "except", "finally") or (kinds[start] == "@" and self._decorating(kinds, start, i)):
                        continue
                    out.append((start, i + 1))
                    start = i + 1
        elif lang == "ruby":
            for i, k in enumerate(kinds):
                if k in ("NL", ";"):
                    out.append((start, i + 1))
                    start = i + 1
        elif lang == "go":
            for i, k in enumerate(kinds):
                if k == ";":
                    head = kinds[start + 2] if kinds[start + 1 : start + 2] == (":",) and start + 2 < n else kinds[start]
                    if head in ("for", "if", "switch") and kinds[i - 1][:2] != "#B":
                        continue  # a clause of the statement's head
                    out.append((start, i + 1))
                    start = i + 1
        else:
            after = _AFTER[lang]
            for i, k in enumerate(kinds):
                nxt = kinds[i + 1] if i + 1 < n else ""
                if k in (";", ";nl") or k == "PP":
                    if nxt in ("else", "while") and nxt == "else" or (k == ";nl" and nxt in ("else", "catch", "finally")):
                        continue
                    if nxt == "while" and "do" in kinds[start : i + 1]:
                        continue
                    out.append((start, i + 1))
                    start = i + 1
                elif k[:2] == "#B":
                    if nxt[:1] == "#" and len(nxt) > 2:
                        nxt = nxt[1]
                    if nxt in after or (lang == "rust" and kinds[start] == "let") or (lang == "cpp" and kinds[start] in ("struct", "union", "class", "enum", "typedef") and nxt in ("ID", "*")):
                        continue
                    out.append((start, i + 1))
                    start = i + 1
        if start < n:
            out.append((start, n))
        return out

    @staticmethod
    def _decorating(kinds: tuple, start: int, i: int) -> bool:
        """Whether the line that ends at i is still a decorator."""
        a = i
        while a > start and kinds[a - 1] != "NL":
            a -= 1
        return kinds[a] == "@"

    def file(self, text: str, count: bool = True) -> tuple[int, list[tuple[int, str]], Tree, int]:
        """(edit cost, edits as (position, what), tree, number of top-level statements).

        Without ``count`` only whether the cost is 0 is certain; each faulty statement counts as one edit.
        """
        self.named.clear()  # nodes are known by their identity while their tree lives
        tree = Tree(self.lang, text)
        edits = list(tree.repairs)
        cost = len(edits)
        kinds = tuple(self.kind(n) for n in tree.nodes)
        rule = UNIT[self.lang]
        if rule in STATEMENTS[self.lang]:
            cuts, start = self.cuts(kinds), STATEMENTS[self.lang][rule]
        else:
            cuts, start = [(0, len(kinds))], rule
            kinds = tuple(kinds)
        for at in self._misnamed(tree, kinds):
            cost += 1
            edits.append((at, "grammar"))
        for a, b in cuts:
            piece = kinds[a:b]
            if start == "unit" and self.lang == "json" and not piece:
                c = 1
            else:
                c = self._faulty(start, piece)
            if c and count and piece:
                c = self._priced(start, tuple([self._exactly(x) for x in tree.nodes[a:b]]))
            if c:
                cost += c
                edits.append((self._where(tree.nodes[a:b], start), "grammar"))
        if self.lang == "json" and not kinds:
            cost += 1
            edits.append((0, "grammar"))
        self.minimal = cost <= 1
        self.named.clear()
        if len(self.numbers) + len(self.fine) + len(self.costs) > 400_000:  # bounded memory; shapes are learned again
            self.__init__(self.lang)
        return cost, edits, tree, len(cuts)

    def _faulty(self, rule: str, kinds: tuple) -> int:
        """1 for a piece that does not parse, else 0."""
        held, self.strict = self.strict, True
        try:
            return self._statement(rule, kinds)
        finally:
            self.strict = held

    def _misnamed(self, tree: Tree, kinds: tuple) -> list[int]:
        """Positions of faults beyond token kinds: a Go file that does not begin with its package, a Ruby
        class or module whose name is no constant."""
        if self.lang == "go" and kinds and next((k for k in kinds if k != ";"), "package") != "package":
            return [0]
        if self.lang != "ruby":
            return []
        found, words = [], [t for t in tree.tokens if t[0] not in ("com", "nl")]
        for before, word, name in zip([("", "", 0), *words], words, words[1:]):
            if word[0] == "id" and word[1] in ("class", "module") and before[1] not in (".", "&.", ":", "def", "::") and name[0] == "id" and name[1][:1].islower() and name[2] > word[2] + len(word[1]):
                found.append(name[2])
        return found

    def _where(self, nodes: list, rule: str) -> int:
        """Position of the innermost faulty group, as far as statement lists show it."""
        at = nodes[0][1] if nodes else 0
        stmts = STATEMENTS[self.lang]
        for node in nodes:
            if node[2] and node[0] in "BIKDT":
                kinds = tuple(self.kind(x) for x in node[2])
                for r in dict.fromkeys(stmts.values()):
                    if node[0] == "B" and any(self._faulty(r, s) == 0 for s in self.statements(kinds)) or node[0] != "B":
                        for a, b in self.cuts(kinds):
                            if self._faulty(r, kinds[a:b]):
                                return self._where(node[2][a:b], r)
                        break
        return at
