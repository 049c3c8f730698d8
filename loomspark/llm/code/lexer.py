"""String- and comment-aware lexers. Every token is (kind, text, position); kinds: id, num, str, op,
com (comment), nl (line end where it matters), pp (directive), jsx, bad (an error of the lexer).
"""

from __future__ import annotations

import re
from functools import cache

#: Language of a file suffix.
SUFFIX = {
    ".py": "python", ".js": "js", ".jsx": "jsx", ".mjs": "js", ".ts": "ts", ".tsx": "tsx", ".java": "java", ".go": "go", ".rs": "rust", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp",
    ".hpp": "cpp", ".h": "cpp", ".hh": "cpp", ".c": "cpp", ".rb": "ruby", ".qml": "qml", ".json": "json",
}


def language(path: str | None) -> str | None:
    name = (path or "").rsplit("/", 1)[-1]
    return SUFFIX.get("." + name.rsplit(".", 1)[-1].lower()) if "." in name else None


_NAME = r"[^\W\d]\w*"
_NUM_C = r"(?:0[xX][0-9a-fA-F_']+|0[bB][01_']+|0[oO][0-7_]+|(?:\d[\d_']*)?\.?\d[\d_']*(?:[eEpP][+-]?\d[\d_]*)?|\d[\d_]*\.)"
_STR = r'"(?:[^"\\\n]|\\[\s\S])*"'
_CHR = r"'(?:[^'\\\n]|\\[\s\S])*'"
_C_OPS = r">>>=|\.\.\.=?|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|<=>|->\*|=>|->|::|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|&\^=|&\^|:=|<-|<<|\*\*|\.\.|[-+*/%<>=!&|^~?:;,.@#$(){}\[\]\\`]"
_CONFLICT = r"^(?:<{7}|>{7}|={7}|\|{7})(?=[ \r\n]|\Z).*"

_SPEC: dict[str, list[tuple[str, str]]] = {
    "python": [
        ("com", r"#[^\n]*"),
        ("str", r"(?i:[rbuft]|br|rb|fr|rf|tr|rt)?(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')"),
        ("bad", r"(?i:[rbuft]|br|rb|fr|rf)?(?:\"\"\"[\s\S]*|'''[\s\S]*|[\"'][^\n]*)"),
        ("join", r"\\\r?\n"),
        ("num", r"(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:0(?:_?0)*|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?!\w)"),
        ("bad", r"\d\w*"),
        ("id", _NAME),
        ("op", r"\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|\*\*|//|>>|<<|<=|>=|==|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|[-+*/%@<>=&|^~:;,.(){}\[\]]"),
    ],
    "json": [("str", r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"'), ("num", r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])"), ("id", r"(?:true|false|null|NaN|-?Infinity)\b"), ("op", r"[{}\[\]:,]"), ("bad", r"[^\s{}\[\]:,]+")],
    "js": [("com", r"//[^\n]*|/\*[\s\S]*?\*/|\A#![^\n]*"), ("bad", r"/\*[\s\S]*"), ("str", f"{_STR}|{_CHR}"), ("bad", r"[\"'][^\n]*"), ("num", _NUM_C + r"n?(?!\w)"), ("bad", r"\d\w*"), ("id", r"#?[^\W\d]\w*|\$[\w$]*"), ("op", _C_OPS)],
    "java": [("com", r"//[^\n]*|/\*[\s\S]*?\*/"), ("bad", r"/\*[\s\S]*"), ("str", r'"""(?:[^\\]|\\[\s\S])*?"""|' + f"{_STR}|" + r"'(?:[^'\\\n]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\.)'"), ("bad", r"[\"'][^\n]*"), ("num", _NUM_C + r"[lLfFdD]?(?!\w)"), ("bad", r"\d\w*"), ("id", r"[^\W\d]\w*"), ("op", _C_OPS)],
    "go": [("com", r"//[^\n]*|/\*[\s\S]*?\*/"), ("bad", r"/\*[\s\S]*"), ("str", f"{_STR}|`[^`]*`|" + r"'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|.))'"), ("bad", r"`[\s\S]*|[\"'][^\n]*"), ("num", _NUM_C + r"i?(?!\w)"), ("bad", r"\d\w*"), ("id", _NAME), ("op", _C_OPS)],
    "rust": [
        ("com", r"//[^\n]*"),
        ("str", r'b?r(#*)"[\s\S]*?"\1|[bc]?"(?:[^"\\]|\\[\s\S])*"|b?' + r"'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.))'"),
        ("life", r"'[^\W\d]\w*(?!')"),
        ("bad", r'"[\s\S]*|\'[^\n]*'),
        ("num", r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.(?!\.|[^\W\d])[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:[iuf](?:8|16|32|64|128|size))?(?!\w)"),
        ("bad", r"\d\w*"),
        ("id", r"r#[^\W\d]\w*|" + _NAME),
        ("op", r"\.\.=|" + _C_OPS),
    ],
    "cpp": [
        ("com", r"//(?:[^\n\\]|\\[\s\S])*|/\*[\s\S]*?\*/"),
        ("bad", r"/\*[\s\S]*"),
        ("pp", r"^[ \t]*#(?:[^\n\\/]|\\\r?\n|\\|/(?![*/]))*"),
        ("str", r'(?:u8|[uUL])?R"([^()\\\s]{0,16})\([\s\S]*?\)\1"|(?:u8|[uUL])?' + f"(?:{_STR}|{_CHR})"),
        ("bad", r"[\"'][^\n]*"),
        ("num", r"(?:0[xX][0-9a-fA-F'.]+(?:[pP][+-]?\d+)?|0[bB][01']+|(?:\d[\d']*)?\.?\d[\d']*(?:[eE][+-]?\d+)?|\d[\d']*\.)(?:[uUlLzZfF]{0,3}|_\w+)(?!\w)"),
        ("bad", r"\d\w*"),
        ("id", _NAME),
        ("op", _C_OPS),
    ],
    "ruby": [("com", r"^=begin\b[\s\S]*?^=end\b[^\n]*|#[^\n]*"), ("num", _NUM_C + r"[ri]?(?!\w)"), ("bad", r"\d\w*"), ("id", r"(?:@@?|\$)?[^\W\d]\w*[?!]?(?!=(?![=~>]))|(?:@@?|\$)?[^\W\d]\w*|\$[\W\d]"), ("op", r"\.\.\.|\*\*=|<=>|===|&&=|\|\|=|<<=|>>=|&\.|=>|->|::|&&|\|\||==|!=|=~|!~|<=|>=|<<|>>|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|\.\.|[-+*/%<>=!&|^~?:;,.(){}\[\]\\]")],
}
_SPEC["jsx"] = _SPEC["tsx"] = _SPEC["ts"] = _SPEC["qml"] = _SPEC["js"]
_LINES = {"python", "go", "ruby", "js", "jsx", "ts", "tsx", "qml"}
_ENDS = {")", "]", "}"}
#: Words after which a slash or an angle bracket begins a literal, not an operator.
_BEFORE = frozenset("return typeof case in of delete void throw new else do yield await instanceof if while and or not unless until when puts".split())


@cache
def _master(lang: str) -> tuple[re.Pattern, list[str]]:
    kinds, parts = [], [f"(?P<k0>{_CONFLICT})"]
    kinds.append("conflict")
    for n, (kind, pattern) in enumerate(_SPEC[lang], 1):
        kinds.append(kind)
        # numbered groups of a pattern are shifted by the groups before it
        used = re.compile("|".join(parts), re.M).groups
        pattern = re.sub(r"\\(\d)", lambda m: f"\\{int(m[1]) + used + 1}", pattern) if r"\1" in pattern else pattern
        parts.append(f"(?P<k{n}>{pattern})")
    parts += [r"(?P<ws>[ \t\f\r\ufeff\xa0]+)", r"(?P<nl>\n)", r"(?P<other>[\s\S])"]
    return re.compile("|".join(parts), re.M), kinds


def _value_before(last: tuple | None) -> bool:
    """Whether a value ends before this place, so that a slash divides."""
    if last is None or last[0] == "nl":
        return False
    if last[0] in ("num", "str", "jsx"):
        return True
    return last[1] not in _BEFORE if last[0] == "id" else last[1] in _ENDS


def _template(text: str, at: int) -> int:
    """End of a back-quoted literal with nested ${...}; -1 if it never ends."""
    i, n = at + 1, len(text)
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1
        elif c == "$" and text[i + 1 : i + 2] == "{":
            i = _braced(text, i + 1, True)
            if i < 0:
                return -1
        else:
            i += 1
    return -1


def _braced(text: str, at: int, js: bool) -> int:
    """End of a {...} that may hold strings and, in JavaScript, templates; -1 if it never ends."""
    depth, i, n = 0, at, len(text)
    while i < n:
        c = text[i]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return i + 1
        elif c in "\"'":
            m = re.compile(_STR if c == '"' else _CHR).match(text, i)
            if m:
                i = m.end()
                continue
        elif c == "`" and js:
            i = _template(text, i)
            if i < 0:
                return -1
            continue
        elif c == "\\":
            i += 1
        i += 1
    return -1


_TAG = re.compile(r"<(/?)([\w.:-]*)")


def _element(text: str, at: int) -> int:
    """End of a JSX element that begins at ``at``; -1 if none does."""
    depth, i, n = 0, at, len(text)
    while i < n:
        c = text[i]
        if c == "{":
            i = _braced(text, i, True)
            if i < 0:
                return -1
        elif c == "<":
            m = _TAG.match(text, i)
            i = m.end()
            closing, own = bool(m[1]), False
            while i < n and text[i] != ">":
                if text[i] in "\"'":
                    e = text.find(text[i], i + 1)
                    if e < 0:
                        return -1
                    i = e + 1
                elif text[i] == "{":
                    i = _braced(text, i, True)
                    if i < 0:
                        return -1
                elif text[i] in ";<":
                    return -1
                else:
                    own = text[i] == "/"
                    i += 1
            if i >= n:
                return -1
            i += 1
            depth += -1 if closing else 0 if own else 1
            if depth <= 0:
                return i if depth == 0 else -1
        else:
            i += 1
    return -1


_REGEX = re.compile(r"/(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_HERE = re.compile(r"<<[~-]?(?:\"(\w+)\"|'(\w+)'|([A-Z_]\w*))")
_PERCENT = re.compile(r"%[qQwWiIrsx]?([\[({<|!/])")
_CLOSE = {"[": "]", "(": ")", "{": "}", "<": ">"}


def _ruby_string(text: str, at: int, close: str, open_: str = "") -> int:
    i, n, depth = at, len(text), 0
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "#" and text[i + 1 : i + 2] == "{" and close != "'":
            i = _braced(text, i + 1, False)
            if i < 0:
                return -1
        elif c == close and not depth:
            return i + 1
        else:
            depth += (c == open_) - (c == close)
            i += 1
    return -1


def lex(lang: str, text: str) -> list[tuple[str, str, int]]:
    master, kinds = _master(lang)
    out: list[tuple[str, str, int]] = []
    i, n, last, depth = 0, len(text), None, 0
    js, ruby, rust, lines = lang in ("js", "jsx", "ts", "tsx", "qml"), lang == "ruby", lang == "rust", lang in _LINES
    pending: list[str] = []  # Ruby here-documents that begin on the next line
    while i < n:
        c = text[i]
        end = 0
        if js:
            if c == "`":
                e = _template(text, i)
                out.append(last := ("str" if e > 0 else "bad", text[i : e if e > 0 else n], i))
                i = e if e > 0 else n
                continue
            if c == "/" and text[i + 1 : i + 2] not in ("/", "*") and not _value_before(last) and (m := _REGEX.match(text, i)):
                end, kind = m.end(), "str"
            elif c == "<" and lang in ("jsx", "tsx", "js") and not _value_before(last) and _TAG.match(text, i) and (e := _element(text, i)) > 0:
                end, kind = e, "jsx"
        elif ruby:
            spaced = i == 0 or text[i - 1] in " \t\n(,=[{|&!"
            if c in "\"`" or c == "'":
                e = _ruby_string(text, i + 1, c)
                end, kind = (e, "str") if e > 0 else (n, "bad")
            elif c == "<" and (m := _HERE.match(text, i)) and (not _value_before(last) or spaced) and text[i + 2 : i + 3] in "~-\"'" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ_":
                pending.append(m[1] or m[2] or m[3])
                end, kind = m.end(), "str"
            elif c == "%" and (not _value_before(last) or (spaced and text[i + 1 : i + 2] not in " =")) and (m := _PERCENT.match(text, i)):
                e = _ruby_string(text, m.end(), _CLOSE.get(m[1], m[1]), m[1] if m[1] in _CLOSE else "")
                end, kind = (e, "str") if e > 0 else (n, "bad")
            elif c == "/" and not _value_before(last) and (m := _REGEX.match(text, i)):
                end, kind = m.end(), "str"
            elif c == ":" and text[i + 1 : i + 2] == '"':
                e = _ruby_string(text, i + 2, '"')
                end, kind = (e, "str") if e > 0 else (n, "bad")
            elif c == ":" and text[i + 1 : i + 2] != ":" and text[i - 1 : i] != ":" and (m := re.compile(r":(?:[^\W\d]\w*[?!=]?(?![>=~])|[^\W\d]\w*|\[\]=?|[-+*/<>=!~%&|^]{1,3})").match(text, i)):
                end, kind = m.end(), "str"
            elif c == "?" and not _value_before(last) and re.compile(r"\?\w(?!\w)").match(text, i):
                end, kind = i + 2, "str"
            elif c == "_" and text.startswith("__END__", i) and (i == 0 or text[i - 1] == "\n"):
                break
        elif rust and c == "/" and text[i + 1 : i + 2] == "*":
            level, e = 1, i + 2
            while level and e < n:
                a, b = text.find("/*", e), text.find("*/", e)
                if b < 0:
                    e = n
                    break
                level, e = (level + 1, a + 2) if 0 <= a < b else (level - 1, b + 2)
            end, kind = e, "com" if not level else "bad"
        if end:
            tok = (kind, text[i:end], i)
            out.append(tok)
            if kind != "com":
                last = tok
            i = end
            continue
        m = master.match(text, i)
        g = m.lastgroup
        i = m.end()
        if g == "ws":
            continue
        if g == "nl":
            if pending:
                for word in pending:
                    e = re.compile(rf"^[ \t]*{word}\r?$", re.M).search(text, i)
                    if e is None:
                        out.append(("bad", "heredoc", i))
                        i = n
                        break
                    i = min(n, e.end() + 1)
                pending = []
            if lines:
                out.append(("nl", "\n", m.start()))
                if not js:
                    last = out[-1]
            continue
        kind = kinds[int(g[1:])] if g[0] == "k" else "bad"
        if kind == "join":
            continue
        if kind == "str" and m[0] == "" or kind == "other":
            kind = "bad"
        tok = ("bad", m[0], m.start()) if kind == "conflict" else (kind, m[0], m.start())
        out.append(tok)
        if kind != "com":
            last = tok
    return out
