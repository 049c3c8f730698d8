"""Error-correcting chart parsing: the least number of token insertions, deletions and
substitutions that bring a token sequence into a grammar's language.

Grammars are written in a small EBNF (``rule = alt | alt``; ``( )``, ``?``, ``*``, ``+``; quoted
terminals; ALL-CAPS token classes; ``P:x``, ``S:x``, ``B:x`` for a bracket group whose content is
parsed as ``x``). The chart is Earley's with a cost on every item; a group is one token, and matching
it costs what the repair of its content costs, two edits at most: a new group in its place. A first
pass without repairs settles valid sequences. Others are parsed cheapest first (Knuth's generalisation
of shortest paths, A*): by the cost of all before an item's end and a lower bound of what comes after,
so the first parse of the whole sequence is a minimum, whatever the length or the number of edits. The
bound is the cost of bringing the other tokens into a regular language that holds the grammar's: rules
may return to any place that calls them. Where the bound says too little (texts of another language) the
search would meet nearly all items; after as many steps as the costs of all spans would take in arrays,
it is left for these, which give the same minimum.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

import numpy as np

_EBNF = re.compile(r"'[^']+'|[A-Z]:[a-z_]+|[A-Z][A-Z0-9_]*|[a-z_][a-z_0-9]*|[=|()?*+;]")


class Grammar:
    """A context-free grammar with numbered symbols; terminals are strings, rules are tuples."""

    def __init__(self, text: str, classes: dict[str, frozenset | set]):
        self.classes = classes
        self.rules: dict[str, list[tuple]] = {}
        self._fresh = 0
        for line in re.split(r"\n(?=[a-z_0-9]+ *=)", text.strip()):
            name, body = line.split("=", 1)
            self._tokens, self._at = _EBNF.findall(body), 0
            self.rules.setdefault(name.strip(), []).extend(self._alternatives())
        self.nullable: set[str] = set()
        grew = True
        while grew:
            grew = False
            for n, alts in self.rules.items():
                if n not in self.nullable and any(all(s in self.nullable for s in a) for a in alts):
                    self.nullable.add(n)
                    grew = True
        self.flat: list[tuple[str, tuple]] = []
        self.by_name: dict[str, list[int]] = {}
        for n, alts in self.rules.items():
            for a in alts:
                self.by_name.setdefault(n, []).append(len(self.flat))
                self.flat.append((n, a))
        self.accepts: dict[str, Callable] = {}
        self._first()

    def _alternatives(self) -> list[tuple]:
        alts, seq = [], []
        t = self._tokens
        while self._at < len(t) and t[self._at] != ")":
            s = t[self._at]
            self._at += 1
            if s == "|":
                alts.append(tuple(seq))
                seq = []
                continue
            if s == "(":
                inner = self._alternatives()
                self._at += 1
                s = self._new(inner)
            after = t[self._at] if self._at < len(t) else ""
            if after == "?":
                s = self._new([(), (s,)])
            elif after == "*":
                n = self._new([])
                self.rules[n] += [(), (n, s)]
                s = n
            elif after == "+":
                n = self._new([])
                self.rules[n] += [(s,), (n, s)]
                s = n
            if after and after in "?*+":
                self._at += 1
            seq.append(s)
        alts.append(tuple(seq))
        return alts

    def _new(self, alts: list[tuple]) -> str:
        self._fresh += 1
        name = f"_{self._fresh}"
        self.rules[name] = alts
        return name

    def _first(self) -> None:
        """Terminals a rule can begin with, to predict only what the next token allows."""
        first: dict[str, set] = {n: set() for n in self.rules}
        grew = True
        while grew:
            grew = False
            for n, alts in self.rules.items():
                for a in alts:
                    for s in a:
                        new = first[s] if s in first else {s}
                        if not new <= first[n]:
                            first[n] |= new
                            grew = True
                        if s not in self.nullable:
                            break
        self.first = first
        self._cache: dict[tuple[str, str], bool] = {}

    def can_begin(self, name: str, kind: str) -> bool:
        k = (name, kind)
        x = self._cache.get(k)
        if x is None:
            x = self._cache[k] = name in self.nullable or any(self.match(t, kind) for t in self.first[name])
        return x

    def match(self, terminal: str, kind: str) -> bool:
        """Whether a token of a kind (or group bracket) can stand for a terminal."""
        if terminal[0] == "'":
            return terminal[1:-1] == kind or (kind == ";nl" and terminal == "';'")
        if terminal[1:2] == ":":
            return len(kind) > 2 and kind[0] == "#" and kind[1] == terminal[0]
        return kind in self.classes[terminal]


class Paths:
    """Lower bounds of costs: a rule's language where rules may return to any place that calls them."""

    #: More than any cost.
    FAR = 1 << 30

    def __init__(self, g: Grammar, start: str, after: list[str | None], name: list[str], starts: dict[str, list[int]]):
        reached, work, items = {start}, [start], []
        back: dict[str, list[int]] = {}  # name -> dotted rules after a call of it
        while work:
            for d in starts[work.pop()]:
                items.append(d)
                while (s := after[d]) is not None:
                    if s in g.rules:
                        back.setdefault(s, []).append(d + 1)
                        if s not in reached:
                            reached.add(s)
                            work.append(s)
                    d += 1
                    items.append(d)
        # places before a terminal, as bits, that a dotted rule comes to without a token; 1: the end
        bit = {d: 2 << n for n, d in enumerate(x for x in items if after[x] is not None and after[x] not in g.rules)}
        reach = {d: bit.get(d, 0) for d in items}
        call, ret = dict.fromkeys(reached, 0), dict.fromkeys(reached, 0)
        ret[start] = 1
        grew = True
        while grew:
            grew = False
            for d in items:
                if d not in bit:
                    s = after[d]
                    x = ret[name[d]] if s is None else call[s]
                    if x != reach[d]:
                        reach[d], grew = x, True
            for s in reached:
                x, y = call[s], ret[s]
                for d in starts[s]:
                    x |= reach[d]
                for d in back.get(s, ()):
                    y |= reach[d]
                if x != call[s] or y != ret[s]:
                    call[s], ret[s], grew = x, y, True
        # places with the same terminal before the same places are one
        kinds: dict[tuple, int] = {}
        place = {d: kinds.setdefault((after[d], reach[d + 1]), len(kinds)) for d in bit}
        self.terminals = [t for t, _ in kinds]
        of = {b: place[d] for d, b in bit.items()}
        self.follow = self._table([x for _, x in kinds], of)
        rows: dict[int, int] = {}
        self.row = [0] * len(after)
        for d in items:
            self.row[d] = rows.setdefault(reach[d], len(rows))
        self.first, self.last = rows.setdefault(call[start], len(rows)), rows.setdefault(ret[start], len(rows))
        self.sets = self._table(list(rows), of)
        self.misses: dict[str, tuple[dict[str, int], np.ndarray]] = {}

    def _table(self, sets: list[int], of: dict[int, int]) -> np.ndarray:
        t = np.zeros((len(sets), len(self.terminals) + 1), dtype=bool)
        for n, x in enumerate(sets):
            t[n, -1] = x & 1
            x &= ~1
            while x:
                low = x & -x
                t[n, of[low]] = True
                x ^= low
        return t

    def bounds(self, missing: list[np.ndarray]) -> list[list[int]]:
        """By position, then by row: the least cost of the tokens from there on; ``missing`` tells by
        position which terminals the token there is not."""
        n, far, size = len(missing), self.FAR, len(self.terminals)
        out: list[list[int]] = [[]] * (n + 1)
        base = np.full(size + 1, far, dtype=np.int64)
        for p in range(n, -1, -1):
            if p < n:
                base[:size] = np.minimum(missing[p] + after, 1 + least[:size])
            base[size] = n - p  # all tokens too many
            least = base.copy()
            while True:
                after = np.where(self.follow, least, far).min(axis=1)
                better = np.minimum(base[:size], after + 1)
                if (better == least[:size]).all():
                    break
                least[:size] = better
            out[p] = np.where(self.sets, least, far).min(axis=1).tolist()
        return out


class Spans:
    """Least costs of a rule for every span of a sequence, from short to long, all spans of a length at once.

    Beginnings of rules are the rows; equal beginnings are one. Every span begins with a token that stays or
    is replaced, superfluous tokens follow such a token, so those before the first are dropped ahead of all.
    """

    #: Steps of the search by cost that take as long as a length's share and as a million sums of two spans.
    LENGTH, SUMS = 150, 60

    def __init__(self, g: Grammar, start: str, shortest: dict[str, int]):
        names, work = {start: 0}, [start]
        while work:
            for body in g.rules[work.pop()]:
                for s in body:
                    if s in g.rules and s not in names:
                        names[s] = len(names)
                        work.append(s)
        gap = lambda body: sum([shortest.get(x, 1) for x in body])
        rows = sorted(dict.fromkeys([(start,), *[b[:k] for x in names for b in g.rules[x] for k in range(1, len(b) + 1)]]), key=len)
        at = {b: k for k, b in enumerate(rows)}
        none = len(rows)  # a row of costs beyond all
        self.size, self.least = none + 1, shortest[start]
        self.before = np.array([gap(b[:-1]) for b in rows])[:, None]
        own = np.array([gap(b[-1:]) for b in rows])[:, None]
        parent = np.array([at.get(b[:-1], none) for b in rows])
        depths = [np.flatnonzero([len(b) == k for b in rows]) for k in range(2, len(rows[-1]) + 1)]
        self.chain = [(slice(d[0], d[-1] + 1), parent[d], own[d]) for d in depths if len(d)]
        self.terminals = list(dict.fromkeys(b[-1] for b in rows if b[-1] not in g.rules))
        number = {t: k for k, t in enumerate(self.terminals)}
        self.ends = np.flatnonzero([b[-1] not in g.rules for b in rows])
        self.kind, self.to = np.array([number[rows[k][-1]] for k in self.ends], dtype=int), parent[self.ends]
        self.calls = np.flatnonzero([b[-1] in g.rules for b in rows])
        self.called = np.array([names[rows[k][-1]] for k in self.calls], dtype=int)
        self.pairs = np.array([k for k in self.calls if len(rows[k]) > 1], dtype=int)
        self.left, self.right = parent[self.pairs], np.array([names[rows[k][-1]] for k in self.pairs], dtype=int)
        whole, edges = [], []
        for x in names:
            whole.append({at[b]: 0 for b in g.rules[x] if b} or {none: 0})
            found = {names[x]: 0}
            for b in g.rules[x]:
                for s in b:
                    if s in names:
                        found[names[s]] = min(found.get(names[s], Paths.FAR), gap(b) - shortest[s])
            edges.append(found)
        self.count = len(names)
        self.whole, self.edges = self._groups(whole), [e for e in self._groups(edges) if e[1].shape[1] > 1]

    @staticmethod
    def _groups(parts: list[dict[int, int]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, what they are the least of and what is added; together, rows of about as many of them."""
        by: dict[int, list[int]] = {}
        for k, p in enumerate(parts):
            by.setdefault((len(p) - 1).bit_length(), []).append(k)
        out = []
        for rows in by.values():
            most = max(len(parts[k]) for k in rows)
            full = [[*parts[k].items()] + [next(iter(parts[k].items()))] * (most - len(parts[k])) for k in rows]
            out.append((np.array(rows), np.array([[x for x, _ in f] for f in full]), np.array([[[c] for _, c in f] for f in full])))
        return out

    def steps(self, n: int) -> int:
        """About how many steps of the search by cost take as long as this."""
        return self.LENGTH * n + self.SUMS * len(self.pairs) * n**3 // 6_000_000

    def cost(self, misses: list[dict[str, int]]) -> int:
        """``misses`` tells by position what it costs to take the token there for a terminal."""
        n = len(misses)
        if not n:
            return self.least
        kind, far = (np.int16, 15_000) if n < 10_000 else (np.int32, 1 << 29)
        before = self.before.astype(kind)
        chain, edges = [[(to, of, more.astype(kind)) for to, of, more in x] for x in (self.chain, self.edges)]
        miss = np.array([[m[t] for m in misses] for t in self.terminals], dtype=kind).reshape(-1, n)[self.kind]
        lefts: list[np.ndarray] = [np.empty(0)]  # by length, then by start: what comes before a call
        rights: list[np.ndarray] = [np.empty(0)]  # and what is called
        sums = np.empty((n, len(self.pairs)), dtype=kind)
        best, last = n + self.least, None
        for length in range(1, n + 1):
            w = n - length + 1
            x = np.full((self.size, w), far, dtype=kind)
            if last is None:
                x[self.ends] = before[self.ends] + miss
            else:
                x[self.ends] = np.minimum(np.minimum(last[self.ends, :w] + 1, last[self.to, :w] + miss[:, length - 1 :]), far)
            total = np.full((w, len(self.pairs)), far, dtype=kind)
            for k in range(1, length):
                np.add(lefts[k][:w], rights[length - k][k : k + w], out=sums[:w])
                np.minimum(total, sums[:w], out=total)
            x[self.pairs] = total.T
            self._insert(x, chain)
            c, known = np.empty((self.count, w), dtype=kind), None
            for to, of, _ in self.whole:
                c[to] = x[of].min(axis=1)
            while known is None or (known != c).any():
                known = c.copy()
                for to, of, more in edges:
                    c[to] = (c[of] + more).min(axis=1)
            x[self.calls] = np.minimum(x[self.calls], before[self.calls] + c[self.called])
            self._insert(x, chain)
            best = min(best, n - length + int(c[0, -1]))
            lefts.append(np.ascontiguousarray(x[self.left].T))
            rights.append(np.ascontiguousarray(c[self.right].T))
            last = x
        return best

    @staticmethod
    def _insert(x: np.ndarray, chain: list) -> None:
        for rows, parent, own in chain:
            x[rows] = np.minimum(x[rows], x[parent] + own)


class Chart:
    """Parses sequences of token kinds. A bracket group's kind is '#' + bracket + number; ``inside``
    gives the repair cost of a group's content under a content rule."""

    def __init__(self, grammar: Grammar, inside: Callable[[str, str], int], fits: Callable[[str, str], bool] | None = None):
        self.g, self.inside = grammar, inside
        self.fits = fits or (lambda kind, rule: inside(kind, rule) == 0)
        self.memo: dict[tuple, int] = {}
        #: Dotted rules by number: the symbol after the dot, the rule's name.
        self.after: list[str | None] = []
        self.name: list[str] = []
        self.starts: dict[str, list[int]] = {}
        for name, body in grammar.flat:
            self.starts.setdefault(name, []).append(self._dotted(name, body))
        self.paths: dict[str, tuple[int, Paths]] = {}
        self.spans: dict[str, Spans] = {}
        self.shortest = dict.fromkeys(grammar.rules, Paths.FAR)
        grew = True
        while grew:
            grew = False
            for name, body in grammar.flat:
                least = sum([self.shortest.get(x, 1) for x in body])
                if least < self.shortest[name]:
                    self.shortest[name], grew = least, True

    def _dotted(self, name: str, body: tuple) -> int:
        at = len(self.after)
        self.after += [*body, None]
        self.name += [name] * (len(body) + 1)
        return at

    def cost(self, start: str, kinds: tuple[str, ...], cap: int | None = None) -> int:
        """Least number of edits; where it is ``cap`` or more, ``cap``."""
        key = (start, kinds, cap)
        c = self.memo.get(key)
        if c is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
                self.paths.clear()
            c = 0 if self._exact(start, kinds) else self._repair(start, kinds, cap)
            self.memo[key] = -1 if c is None else c
        if c is None or c < 0:
            c = self.memo[key] = self._spanned(start, kinds)
        return c

    def _misses(self, terminal: str, kind: str) -> int:
        """1 if a token is not what a terminal stands for, or is a group that its rule does not fit."""
        return 0 if self.g.match(terminal, kind) and (terminal[1:2] != ":" or terminal[0] == "'" or self.fits(kind, terminal[2:])) else 1

    def _spanned(self, start: str, kinds: tuple[str, ...]) -> int:
        """Least repair cost, by the costs of all spans."""
        misses: dict[str, dict[str, int]] = {}
        for k in dict.fromkeys(kinds):
            misses[k] = m = {t: self._misses(t, k) for t in self.spans[start].terminals}
            for t, c in m.items():
                if c and t[1:2] == ":" and t[0] != "'" and self.g.match(t, k):
                    m[t] = min(2, self.inside(k, t[2:]))
        return self.spans[start].cost([misses[k] for k in kinds])

    def _exact(self, start: str, kinds: tuple[str, ...]) -> bool:
        g, flat, n = self.g, self.g.flat, len(kinds)
        sets: list[set] = [set() for _ in range(n + 1)]
        waits: list[dict] = [{} for _ in range(n + 1)]  # nonterminal -> items that wait for it
        for r in g.by_name[start]:
            sets[0].add((r, 0, 0))
        goal = {r for r in g.by_name[start]}
        for i in range(n + 1):
            here, wait = sets[i], waits[i]
            kind = kinds[i] if i < n else ""
            work = list(here)
            while work:
                item = work.pop()
                r, dot, origin = item
                name, body = flat[r]
                if dot == len(body):
                    if origin == i:
                        continue  # empty: handled at prediction
                    for q, d, o in waits[origin].get(name, ()):
                        nxt = (q, d + 1, o)
                        if nxt not in here:
                            here.add(nxt)
                            work.append(nxt)
                    continue
                s = body[dot]
                if s in g.rules:
                    known = wait.get(s)
                    if known is None:
                        wait[s] = [item]
                        if i == n or g.can_begin(s, kind):
                            for q in g.by_name[s]:
                                nxt = (q, 0, i)
                                if nxt not in here:
                                    here.add(nxt)
                                    work.append(nxt)
                    else:
                        known.append(item)
                    if s in g.nullable:
                        nxt = (r, dot + 1, origin)
                        if nxt not in here:
                            here.add(nxt)
                            work.append(nxt)
                elif i < n and g.match(s, kind) and (s[1:2] != ":" or s[0] == "'" or self.fits(kind, s[2:])):
                    sets[i + 1].add((r, dot + 1, origin))
            if i < n and not sets[i + 1]:
                return False
        return any(r in goal and o == 0 and d == len(flat[r][1]) for r, d, o in sets[n]) or (n == 0 and start in g.nullable)

    def _repair(self, start: str, kinds: tuple[str, ...], cap: int | None = None) -> int | None:
        """Least repair cost, ``cap`` at most; None where the costs of all spans are found sooner.

        Items are (position, dotted rule, origin), taken in the order of the least cost of everything up
        to their position and the bound of the rest, which never falls from one item to the next. Origins
        of one position, rule and cost are the bits of one number and go on together. Superfluous tokens
        are dropped right after a token that stays, a group or nothing: after an inserted or replaced
        token the edits can change places. Rules after which tokens have just been dropped have numbers
        of their own.
        """
        after, name, starts = self.after, self.name, self.starts
        g, n = self.g, len(kinds)
        if start not in self.paths:
            goal = self._dotted("", (start,))
            paths = Paths(g, start, after, name, starts)
            paths.row[goal : goal + 2] = paths.first, paths.last
            self.paths[start] = goal, paths
        goal, paths = self.paths[start]
        if len(paths.misses) > 5_000:
            paths.misses.clear()
        for k in kinds:
            if k not in paths.misses:
                m = {t: self._misses(t, k) for t in dict.fromkeys(paths.terminals)}
                paths.misses[k] = m, np.array([m[t] for t in paths.terminals], dtype=np.int64)
        missing = [paths.misses[k][0] for k in kinds]
        bounds = paths.bounds([paths.misses[k][1] for k in kinds])
        row, size = paths.row, len(after)
        # all tokens can be dropped and the shortest sequence inserted
        top = n + self.shortest[start] + 1 if cap is None else cap
        shelves: list[dict[int, int]] = [{} for _ in range(top)]  # origins by cost and bound, then by position and rule
        done: list[dict[int, int]] = [{} for _ in range(n + 1)]  # origins by rule
        waits: list[dict] = [{} for _ in range(n + 1)]  # name -> what waits for it: cost over the least and rule -> origins
        least: list[dict[str, int]] = [{} for _ in range(n + 1)]  # name -> least cost of what waits for it
        ends: list[dict] = [{} for _ in range(n + 1)]  # name -> lengths (as bits) and, by length, least costs of constituents from here
        code = "H" if top < 1 << 16 else "L"
        steps = -1
        if cap is None:
            if start not in self.spans:
                self.spans[start] = Spans(g, start, self.shortest)
            steps = self.spans[start].steps(n)
        later: list[tuple] = []  # items that ask for the cost of a group's content, when all others of their cost are done

        def put(i: int, d: int, origins: int, cost: int) -> None:
            x = cost + bounds[i][row[d if d < size else d - size]]
            if x < top and (origins := origins & ~done[i].get(d, 0)):
                shelf, key = shelves[x], i * 2 * size + d
                shelf[key] = shelf.get(key, 0) | origins

        put(0, goal, 1, 0)
        if n:
            put(1, goal + size, 1, 1)
        for at, shelf in enumerate(shelves):
            while shelf or later:
                if not shelf:
                    i, d, origins, cost = later.pop()
                    m = min(2, self.inside(kinds[i], after[d][2:]))
                    put(i + 1, d + 1, origins, cost + m)
                    if i + 1 < n:
                        put(i + 2, d + 1 + size, origins, cost + m + 1)
                    continue
                key, origins = shelf.popitem()
                i, d = divmod(key, 2 * size)
                old = done[i].get(d, 0)
                origins &= ~old
                if not origins:
                    continue
                done[i][d] = old | origins
                if not steps:
                    return None
                steps -= 1
                if d >= size:
                    d -= size
                    cost = at - bounds[i][row[d]]
                    put(i, d, origins, cost)
                    if i < n:
                        put(i + 1, d + size, origins, cost + 1)
                    continue
                cost = at - bounds[i][row[d]]
                s = after[d]
                if s is None:
                    if d == goal + 1:
                        if i == n:
                            return cost
                        continue
                    x = name[d]
                    on: dict[int, int] = {}
                    while origins:
                        low = origins & -origins
                        origins ^= low
                        k = low.bit_length() - 1
                        closed = ends[k].get(x)
                        if closed is None:
                            closed = ends[k][x] = [0, array(code)]
                        if not closed[0] >> (i - k) & 1:
                            closed[0] |= 1 << (i - k)
                            if len(closed[1]) <= i - k:
                                closed[1].frombytes(bytes(closed[1].itemsize * (i - k + 1 - len(closed[1]))))
                            closed[1][i - k] = cost - least[k][x]
                            for to, origins_ in waits[k][x].items():
                                on[to] = on.get(to, 0) | origins_
                    for to, origins_ in on.items():
                        more, d_ = divmod(to, size)
                        put(i, d_, origins_, cost + more)
                elif s in starts:
                    base = least[i].get(s)
                    if base is None:
                        base = least[i][s] = cost
                        waits[i][s] = {}
                        for q in starts[s]:
                            put(i, q, 1 << i, cost)
                    waiting, to = waits[i][s], (cost - base) * size + d + 1
                    waiting[to] = waiting.get(to, 0) | origins
                    if (found := ends[i].get(s)) is not None:
                        lengths, costs = found
                        while lengths:
                            low = lengths & -lengths
                            lengths ^= low
                            j = low.bit_length() - 1
                            put(i + j, d + 1, origins, cost + costs[j])
                else:
                    put(i, d + 1, origins, cost + 1)  # a missing token
                    if i < n:
                        m = missing[i][s]  # 1: another token in its place
                        group = s[1:2] == ":" and s[0] != "'"
                        if m and group and g.match(s, kinds[i]):
                            later.append((i, d, origins, cost))
                            continue
                        put(i + 1, d + 1, origins, cost + m)
                        if i + 1 < n and (group or not m):
                            put(i + 2, d + 1 + size, origins, cost + m + 1)  # a token too many
        return top
