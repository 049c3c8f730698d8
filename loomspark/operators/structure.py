"""Symbols and links of source files: a table function per language family, and the joins that turn
names into nodes.

Extraction sees one file at a time and leaves every name unresolved (``name:x``, ``module:x`` or a
path candidate); resolution is relational: candidates are joined with the known files, names with
labels that are unique in their repository.

Defined results: files that the language's parser refuses give no rows beyond their file node;
null contents are skipped; repeated definitions of one name get '#2', '#3' in order; links to
unknown names stay as they are.
"""

from __future__ import annotations

import ast
import posixpath
import re
import warnings
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_ROWS = "repo_path string, path string, what string, id string, kind string, label string, signature string, span_start int, span_end int, source string, target string, relation string, confidence string, candidates array<string>"
_COLUMNS = [c.split()[0] for c in _ROWS.split(", ")]

# Comments and literals, blanked before patterns are matched; line ends stay.
_NOISE = {
    "c": re.compile(r"//[^\n]*|/\*.*?\*/|R\"(\w*)\(.*?\)\1\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S),
    "hash": re.compile(r"#[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"),
}
_WORD = r"[A-Za-z_]\w*"
# Definitions and imports by suffix: (kind, pattern with a group 'name') and patterns with a group 'module'.
_DEFS: dict[str, list[tuple[str, str]]] = {
    "js": [("class", rf"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>{_WORD})(?:\s*<[^>{{]*>)?(?:\s+extends\s+(?P<base>[\w.]+))?"), ("func", rf"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>{_WORD})"), ("func", rf"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<name>{_WORD})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)]*\)|{_WORD})\s*(?::[^=\n{{]+)?=>"), ("func", rf"^[ \t]+(?:static\s+|async\s+|get\s+|set\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)(?P<name>{_WORD})\s*\([^()\n]*\)\s*(?::[^{{\n]+)?\{{")],
    "java": [("class", rf"^[ \t]*(?:(?:public|protected|private|static|final|abstract|sealed)\s+)*(?:class|interface|enum|record)\s+(?P<name>{_WORD})(?:[^{{\n]*?\bextends\s+(?P<base>[\w.]+))?"), ("func", rf"^[ \t]+(?:(?:public|protected|private|static|final|abstract|synchronized|native)\s+)*(?!return\b|new\b|else\b|throw\b)[\w.<>\[\], ?]+\s+(?P<name>{_WORD})\s*\([^()\n]*\)\s*(?:throws [^{{;\n]+)?[{{;]")],
    "go": [("class", rf"^type\s+(?P<name>{_WORD})\s"), ("func", rf"^func\s+(?:\([^)]*\)\s*)?(?P<name>{_WORD})\s*[\[(]")],
    "rs": [("class", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|union)\s+(?P<name>{_WORD})"), ("func", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern)\s+)*fn\s+(?P<name>{_WORD})")],
    "cpp": [("class", rf"^[ \t]*(?:template\s*<[^>\n]*>\s*)?(?:class|struct)\s+(?:[A-Z_]+\s+)?(?P<name>{_WORD})\s*(?:final\s*)?(?::\s*(?:public|private|protected|virtual)?\s*(?P<base>[\w:]+)[^{{;\n]*)?\{{"), ("func", rf"^[ \t]*(?!return\b|else\b|new\b|delete\b|throw\b|if\b|for\b|while\b|switch\b|case\b)(?:[\w:<>,*&~]+[ \t*&]+)+(?:\w+::)*(?P<name>~?{_WORD})\s*\([^;{{}}]*\)\s*(?:const|noexcept|override|final|\s)*(?::[^;{{]*)?\{{")],
    "rb": [("class", rf"^[ \t]*(?:class|module)\s+(?P<name>[A-Z]\w*)(?:\s*<\s*(?P<base>[\w:]+))?"), ("func", r"^[ \t]*def\s+(?:self\.)?(?P<name>\w+[?!=]?)")],
    "swift": [("class", rf"^[ \t]*(?:(?:public|open|final|private|internal)\s+)*(?:class|struct|enum|protocol)\s+(?P<name>{_WORD})"), ("func", rf"^[ \t]*(?:(?:public|open|private|static|override|internal)\s+)*func\s+(?P<name>{_WORD})")],
    "sh": [("func", rf"^[ \t]*(?:function\s+)?(?P<name>{_WORD})\s*\(\)\s*\{{")],
}
_IMPORTS = {
    "js": [r"^[ \t]*(?:import|export)\b[^'\"\n]*['\"](?P<module>[^'\"\n]+)['\"]", r"\brequire\(\s*['\"](?P<module>[^'\"\n]+)['\"]"], "java": [r"^import\s+(?:static\s+)?(?P<module>[\w.]+)"], "go": [r"^\s*(?:import\s+)?(?:\w+\s+)?\"(?P<module>[\w./-]+)\"\s*$"],
    "rs": [r"^[ \t]*(?:pub\s+)?use\s+(?P<module>[\w:]+)"], "cpp": [r"^[ \t]*#\s*include\s*[<\"](?P<module>[^>\"\n]+)[>\"]"], "rb": [r"^[ \t]*require(?:_relative)?\s+['\"](?P<module>[^'\"\n]+)['\"]"], "swift": [r"^import\s+(?P<module>\w+)"], "sh": [r"^[ \t]*(?:source|\.)\s+(?P<module>\S+)"],
}
_FAMILY = {".js": "js", ".jsx": "js", ".ts": "js", ".tsx": "js", ".java": "java", ".go": "go", ".rs": "rs", ".c": "cpp", ".h": "cpp", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp", ".rb": "rb", ".swift": "swift", ".sh": "sh"}


def _row(path: str, what: str, **k) -> dict:
    return {"path": path, "what": what, **k}


def _node(path: str, qual: str, kind: str, label: str, signature: str, a: int, b: int | None, parent: str) -> Iterator[dict]:
    me = f"symbol:{path}:{qual}"
    yield _row(path, "node", id=me, kind=kind, label=label, signature=signature, span_start=a, span_end=b)
    yield _row(path, "edge", source=parent, target=me, relation="contains", confidence="EXTRACTED")


def _link(path: str, source: str, target: str, relation: str, confidence: str = "EXTRACTED", candidates: list[str] | None = None) -> dict:
    return _row(path, "edge", source=source, target=target, relation=relation, confidence=confidence, candidates=candidates)


def python_rows(path: str, text: str) -> Iterator[dict]:
    """Imports, classes, functions, bases and calls of a Python file, by its own parser."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    here, folder = f"file:{path}", path.rsplit("/", 1)[0] + "/" if "/" in path else ""
    # a stack of (statement list, owner id, qualified prefix, function that calls belong to)
    todo: list[tuple[list, str, str]] = [(tree.body, here, "")]
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            for a in n.names:
                p = a.name.replace(".", "/")
                yield _link(path, here, f"module:{a.name}", "imports", candidates=[f"{p}.py", f"{p}/__init__.py"])
        elif isinstance(n, ast.ImportFrom) and n.module:
            p = n.module.replace(".", "/")
            yield _link(path, here, f"module:{n.module}", "imports", candidates=[f"{folder}{p}.py"] if n.level else [f"{p}.py", f"{p}/__init__.py"])
    counts: dict[str, int] = {}
    while todo:
        body, owner, prefix = todo.pop()
        for n in body:
            if not isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            qual = f"{prefix}{n.name}"
            counts[qual] = counts.get(qual, 0) + 1
            unique = qual if counts[qual] == 1 else f"{qual}#{counts[qual]}"
            me, is_class = f"symbol:{path}:{unique}", isinstance(n, ast.ClassDef)
            head = text.split("\n")[n.lineno - 1].strip()
            yield from _node(path, unique, "class" if is_class else "func", n.name, head, n.lineno, n.end_lineno, owner)
            if is_class:
                for b in n.bases:
                    if isinstance(b, ast.Name):
                        yield _link(path, me, f"name:{b.id}", "inherits")
            else:
                seen, inner = set(), list(n.body)
                while inner:
                    x = inner.pop()
                    if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                        continue
                    if isinstance(x, ast.Call):
                        name = x.func.id if isinstance(x.func, ast.Name) else x.func.attr if isinstance(x.func, ast.Attribute) else None
                        if name and name not in seen:
                            seen.add(name)
                            yield _link(path, me, f"name:{name}", "calls")
                    inner.extend(ast.iter_child_nodes(x))
            todo.append((n.body, me, f"{unique}."))


def _blank(text: str, how: str) -> str:
    """Text of equal length and lines without comments and literals."""
    return _NOISE[how].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _closing(code: str, at: int) -> int:
    """Position of the brace that closes the first one at or after ``at``; -1 without one."""
    i = code.find("{", at)
    if i < 0:
        return -1
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, i):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.start()
    return -1


def pattern_rows(path: str, text: str, family: str) -> Iterator[dict]:
    """Definitions, spans, bases and imports of a file by patterns; spans nest by containment."""
    code = _blank(text, "hash" if family in ("rb", "sh") else "c")
    here, folder = f"file:{path}", path.rsplit("/", 1)[0] if "/" in path else ""
    found: dict[str, tuple] = {}
    for kind, pattern in _DEFS[family]:
        for m in re.compile(pattern, re.M).finditer(code):
            end = _closing(code, m.end() - 1) if family not in ("rb",) else -1
            if family == "rb":
                indent = re.match(r"[ \t]*", code[code.rfind("\n", 0, m.start()) + 1 :])[0]
                e = re.compile(rf"^{indent}end\b", re.M).search(code, m.end())
                end = e.start() if e else -1
            found.setdefault(m["name"], (m.start("name"), end, kind, m.groupdict().get("base")))
    spans = sorted((a, -(b if b >= 0 else a), name) for name, (a, b, _, _) in found.items())
    stack: list[tuple[int, str]] = []
    for a, neg, name in spans:
        _, b, kind, base = found[name]
        while stack and stack[-1][0] < a:
            stack.pop()
        outer = stack[-1][1] if stack else ""
        qual = f"{outer}.{name}" if outer else name
        line = code.count("\n", 0, a) + 1
        yield from _node(path, qual, kind, name, text.split("\n")[line - 1].strip().rstrip("{").strip(), line, code.count("\n", 0, b) + 1 if b >= 0 else None, f"symbol:{path}:{outer}" if outer else here)
        if base:
            yield _link(path, f"symbol:{path}:{qual}", f"name:{base.split('.')[-1].split('::')[-1]}", "inherits")
        if b >= 0:
            if kind == "class":
                stack.append((b, qual))
            else:
                for callee in dict.fromkeys(re.findall(rf"\b({_WORD})\s*\(", code[a + len(name) : b])):
                    if callee not in ("if", "for", "while", "switch", "catch", "return", "sizeof", "function", "match", "loop", name):
                        yield _link(path, f"symbol:{path}:{qual}", f"name:{callee}", "calls", "LOW")
    raw = re.compile(r"//[^\n]*|/\*.*?\*/", re.S).sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text) if family != "rb" else text
    for pattern in _IMPORTS[family]:
        for m in re.compile(pattern, re.M).finditer(raw):
            mod = m["module"]
            near = posixpath.normpath(f"{folder}/{mod}") if mod.startswith(".") and folder else posixpath.normpath(mod) if mod.startswith(".") else mod
            suffixes = {"js": ["", ".js", ".jsx", ".ts", ".tsx", "/index.js", "/index.ts"], "cpp": [""], "rb": ["", ".rb"], "java": [], "go": [], "rs": [], "swift": [], "sh": [""]}[family]
            options = [near + s for s in suffixes] + ([f"{folder}/{mod}"] if family in ("cpp", "sh") and folder else []) + ([mod.replace(".", "/") + ".java"] if family == "java" else [])
            yield _link(path, here, f"module:{mod}", "imports", candidates=options or None)
    if family == "cpp":
        yield from _signals(path, text, code)


def _arguments(code: str, at: int) -> list[str]:
    """Arguments of the call whose bracket was opened before a position; none where it is never closed."""
    out, depth, start = [], 0, at
    for i in range(at, len(code)):
        c = code[i]
        if c in ")]}":
            if not depth:
                return [*out, code[start:i].strip()]
            depth -= 1
        elif c in "([{":
            depth += 1
        elif c == "," and not depth:
            out.append(code[start:i].strip())
            start = i + 1
    return []


def _signal_end(argument: str) -> str | None:
    """The member an argument of a connection names: '&Class::member' or a macro around 'member(...)'."""
    member = re.fullmatch(rf"&?((?:{_WORD}::)*)({_WORD})::({_WORD})", argument)
    if member:
        return f"{member[2]}::{member[3]}"
    macro = re.match(rf"(?:SIGNAL|SLOT)\s*\(\s*({_WORD})", argument)
    return macro[1] if macro else None


def _signals(path: str, text: str, code: str) -> Iterator[dict]:
    """Signal and slot sections, emits, connects and registrations of C++ files."""
    here = f"file:{path}"
    for m in re.compile(rf"^[ \t]*(?:public\s+|protected\s+|private\s+)?(signals|Q_SIGNALS|slots|Q_SLOTS)\s*:(.*?)(?=^[ \t]*(?:public|protected|private|signals|Q_SIGNALS)\b|^\}}|\Z)", re.M | re.S).finditer(code):
        kind = "signal" if "ignal" in m[1].lower() else "slot"
        for d in re.finditer(rf"\b({_WORD})\s*\([^)]*\)\s*;", m[2]):
            line = code.count("\n", 0, m.start(2) + d.start()) + 1
            yield from _node(path, f"{kind}.{d[1]}", kind, d[1], d[0].strip(), line, line, here)
    for name in dict.fromkeys(re.findall(rf"\b(?:emit|Q_EMIT)\s+({_WORD})\s*\(", code)):
        yield _link(path, here, f"name:{name}", "emits")
    for call in re.finditer(r"\bconnect\s*\(", code):
        ends = [e for e in map(_signal_end, _arguments(code, call.end())) if e]
        if len(ends) == 2 and ends[0] != ends[1]:
            yield _link(path, f"name:{ends[0]}", f"name:{ends[1]}", "connects", "EXTRACTED" if "::" in ends[0] + ends[1] else "LOW")
    for name in re.findall(rf"\bqmlRegister\w*Type\s*<\s*(?:\w+::)*({_WORD})\s*>", code):
        yield _link(path, here, f"name:{name}", "registers")
    for t, name in re.findall(rf"\bQ_PROPERTY\s*\(\s*([\w:<>*& ]+?)\s+({_WORD})\b", code):
        yield from _node(path, f"property.{name}", "property", name, f"{t} {name}", 1, None, here)


def qml_rows(path: str, text: str) -> Iterator[dict]:
    """Objects, ids, properties, signals, handlers and imports of a QML file; objects nest by braces."""
    code = _blank(text, "c")
    here = f"file:{path}"
    stack: list[tuple[int, str]] = []
    n = 0
    for m in re.compile(rf"(?P<close>\}})|\b(?P<type>[A-Z]\w*(?:\.[A-Z]\w*)?)\s*\{{|\bid\s*:\s*(?P<id>{_WORD})|\bproperty\s+(?:[\w<>.]+)\s+(?P<prop>{_WORD})|\bsignal\s+(?P<signal>{_WORD})|\b(?P<handler>on[A-Z]\w*)\s*:|(?P<open>\{{)").finditer(code):
        owner = next((o for _, o in reversed(stack) if o), here)
        line = code.count("\n", 0, m.start()) + 1
        if m["close"]:
            if stack:
                stack.pop()
        elif m["open"]:
            stack.append((m.start(), ""))
        elif m["type"]:
            n += 1
            end = _closing(code, m.start())
            me = f"symbol:{path}:o{n}"
            yield from _node(path, f"o{n}", "object", m["type"], m["type"], line, code.count("\n", 0, end) + 1 if end >= 0 else None, owner)
            yield _link(path, me, f"name:{m['type'].split('.')[-1]}", "instantiates")
            stack.append((m.start(), me))
        else:
            kind = m.lastgroup
            name = m[kind]
            local = owner.rsplit(":", 1)[-1] if owner != here else "file"
            yield from _node(path, f"{local}.{kind}.{name}", {"prop": "property"}.get(kind, kind), name, name, line, line, owner)
            if kind == "handler":
                yield _link(path, owner, f"name:{name[2].lower()}{name[3:]}", "handles")
    for m in re.compile(r"^[ \t]*import\s+(?:\"([^\"]+)\"|([\w.]+))", re.M).finditer(text):
        yield _link(path, here, f"module:{m[1] or m[2]}", "imports")


def _listed(text: str) -> Iterator[str]:
    """Names in the file elements of a resource list; none where it is no XML."""
    try:
        root = ElementTree.fromstring(text)
    except (ElementTree.ParseError, ValueError):
        return
    for x in root.iter("file"):
        if x.text and x.text.strip():
            yield x.text.strip()


def build_rows(path: str, text: str) -> Iterator[dict]:
    """What build files, resource lists and module descriptions name."""
    name, folder = path.rsplit("/", 1)[-1].lower(), path.rsplit("/", 1)[0] + "/" if "/" in path else ""
    if name == "cmakelists.txt" or name.endswith(".cmake"):
        code = re.sub(r"#[^\n]*", "", text)
        for m in re.finditer(r"\b(add_executable|add_library|qt_add_executable|qt_add_library|qt_add_qml_module)\s*\(\s*([\w.-]+)([^)]*)\)", code, re.I):
            yield _row(path, "node", id=f"target:{m[2]}", kind="target", label=m[2], signature=m[1])
            for f in re.findall(r"[\w./-]+\.\w+", m[3]):
                yield _link(path, f"target:{m[2]}", f"file:{folder}{f}", "builds", candidates=[folder + f])
    elif name.endswith(".qrc"):
        for f in _listed(text):
            yield _link(path, f"file:{path}", f"file:{folder}{f}", "registers", candidates=[folder + f])
    elif name == "qmldir" or name.endswith(".qmldir"):
        uri = (re.search(r"^module\s+(\S+)", text, re.M) or [None, ""])[1]
        for t, v, f in re.findall(r"^(?:singleton\s+)?([A-Z]\w*)\s+(\d+\.\d+)\s+(\S+)", text, re.M):
            yield _row(path, "node", id=f"export:{uri}:{t}:{v}", kind="module", label=t, signature=f"{t} {v}")
            yield _link(path, f"export:{uri}:{t}:{v}", f"file:{folder}{f}", "exports", candidates=[folder + f])


def extract(sources: DataFrame) -> DataFrame:
    """Node and edge rows of every file (columns of one wide schema; ``what`` tells them apart)."""

    def rows(path: str, text: str) -> Iterator[dict]:
        yield _row(path, "node", id=f"file:{path}", kind="file", label=path.rsplit("/", 1)[-1], signature="")
        suffix = "." + path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
        if suffix == ".py":
            yield from python_rows(path, text)
        elif suffix == ".qml":
            yield from qml_rows(path, text)
        elif suffix in _FAMILY:
            yield from pattern_rows(path, text, _FAMILY[suffix])
        else:
            yield from build_rows(path, text)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [{"repo_path": r, **x} for r, p, t in zip(f["repo_path"], f["path"], f["content"]) for x in rows(p, t)]
            frame = pd.DataFrame(out, columns=_COLUMNS)
            for c in ("span_start", "span_end"):
                frame[c] = frame[c].astype("Int32")
            yield frame.astype(object).where(frame.notna(), None)

    return sources.select("repo_path", "path", "content").where("repo_path IS NOT NULL AND path IS NOT NULL AND content IS NOT NULL").mapInPandas(run, _ROWS)


def resolve(rows: DataFrame) -> DataFrame:
    """(repo_path, source, target, relation, confidence, path): edges whose candidates or names are known.

    The first candidate that is a file wins; a name becomes the one symbol with that label, if there
    is exactly one; what stays unknown keeps its placeholder; links to themselves are dropped.
    """
    e = rows.where("what = 'edge'").select("repo_path", "path", "source", "target", "relation", "confidence", "candidates")
    nodes = rows.where("what = 'node'").select("repo_path", "id", "kind", "label").distinct()
    files = nodes.where("kind = 'file'").select("repo_path", F.expr("substring(id, 6)").alias("candidate"))
    c = e.where("candidates IS NOT NULL").select("repo_path", "path", "target", F.posexplode("candidates").alias("n", "candidate")).distinct()
    hit = c.join(files, ["repo_path", "candidate"]).groupBy("repo_path", "path", "target").agg(F.min(F.struct("n", "candidate")).alias("x")).select("repo_path", "path", "target", F.concat(F.lit("file:"), F.col("x.candidate")).alias("file"))
    unique = nodes.where("kind <> 'file'").groupBy("repo_path", "label").agg(F.count("*").alias("n"), F.min("id").alias("symbol")).where("n = 1").select("repo_path", F.concat(F.lit("name:"), "label").alias("target"), "symbol")
    r = e.join(hit, ["repo_path", "path", "target"], "left").join(unique, ["repo_path", "target"], "left")
    r = r.select("repo_path", "source", F.coalesce("file", "symbol", "target").alias("target"), "relation", "confidence", "path")
    return r.where("source <> target").distinct()


def numbered(rows: DataFrame) -> DataFrame:
    """Edges with ids that are stable for a file: path, relation and running number."""
    w = Window.partitionBy("repo_path", "path").orderBy("relation", "source", "target")
    return rows.withColumn("edge_id", F.concat_ws(":", F.lit("st"), "path", "relation", F.row_number().over(w).cast("string")))
