"""Lexical column functions: identifiers, terms, lines, paths and token estimates. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a task.
STOP_WORDS = "a an the in on of for to is are and or with from by at it this that be as do does how what where when why i we you".split()
# Suffixes by what a reference found in them means.
CODE_SUFFIXES = ".py .js .ts .tsx .jsx .swift .java .rb .c .h .cpp .cc .cxx .hpp .hh .hxx .qml .go .rs".split()
SCRIPT_SUFFIXES = [".sh"]
DOC_SUFFIXES = [".md", ".txt", ".rst"]
CONFIG_SUFFIXES = ".json .yaml .yml .toml .qrc .cmake .pro .ui".split()
# Methods that change the object they are called on.
MUTATING = "append insert push_back clear remove pop emplace_back erase update".split()
# Folders of files that only accompany code; words that begin an import line; marks that
# begin a comment line.
AUX_FOLDERS = "test tests testing eval evals fixture fixtures example examples benchmark benchmarks sample samples".split()
IMPORT_WORDS = ["import", "from", "#include", "use", "require", "package"]
COMMENT_MARKS = ["#", "//", "/*", "*"]
# Operators that change their left side, beside the plain '='.
CHANGING = ["<<=", ">>=", "+=", "-=", "*=", "/=", "|=", "&=", "^="]
# Tokens a segment stands for, by kind of text.
TOKENS_PER_SEGMENT = {"code": 0.74, "markdown": 0.67, "text": 0.77}


def identifier_tokens(c: Column) -> Column:
    """Lower-case parts of identifiers, split at '_' and at a small letter or digit before a capital."""
    apart = F.regexp_replace(F.translate(c, "_", " "), "([a-z0-9])([A-Z])", "$1 $2")
    return F.transform(F.regexp_extract_all(apart, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)


def search_tokens(c: Column) -> Column:
    return F.array_distinct(identifier_tokens(c))


def term_set(c: Column, drop_stop_words: bool = True) -> Column:
    terms = search_tokens(c)
    return F.array_except(terms, F.array(*[F.lit(w) for w in STOP_WORDS])) if drop_stop_words else terms


def normalized_identifier(c: Column) -> Column:
    return F.array_join(identifier_tokens(c), "")


def segment_count(c: Column) -> Column:
    """Words of ASCII letters, digits and '_', single marks, and runs of blanks."""
    return F.regexp_count(c, F.lit(r"[A-Za-z0-9_]+|[^\p{L}\p{N}_\s]|\s+"))


def token_estimate(c: Column, kind: Column) -> Column:
    """Estimated tokens; 0 for empty text, else at least 1, halves rounded to even."""
    factor = F.when(kind == "code", TOKENS_PER_SEGMENT["code"]).when(kind == "markdown", TOKENS_PER_SEGMENT["markdown"]).otherwise(TOKENS_PER_SEGMENT["text"])
    return F.when(F.length(c) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.bround(segment_count(c) * factor).cast("long"))).cast("long")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Last suffix of the file name with its dot; '' for none or a name that only begins with a dot."""
    return F.regexp_extract(file_name(path), r"[^.](\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=[^.])\.[^.]+$", "")


def classify_path(path: Column) -> Column:
    """markdown, code or text."""
    # Suffixes that are indexed as code.
    code = [*CODE_SUFFIXES, ".qmldir", ".qmltypes", ".qmlproject", ".sh", ".cmake", ".qrc"]
    s = suffix(path)
    return F.when(s == ".md", "markdown").when((F.lower(file_name(path)) == "cmakelists.txt") | s.isin(code), "code").otherwise("text")


def suffix_bucket(path: Column) -> Column:
    s = F.lower(suffix(path))
    return (
        F.when((F.lower(file_name(path)) == "cmakelists.txt") | s.isin(CONFIG_SUFFIXES), "config").when(s.isin(CODE_SUFFIXES), "code").when(s.isin(SCRIPT_SUFFIXES), "script").when(s.isin(DOC_SUFFIXES), "doc").otherwise("other")
    )


def is_aux_path(path: Column) -> Column:
    """Tests, evaluations, fixtures, examples, benchmarks and samples."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in AUX_FOLDERS])) | stem(path).startswith("test_") | stem(path).endswith("_test")


def is_test_path(path: Column) -> Column:
    s = F.lower(stem(path))
    return F.array_contains(F.split(path, "/"), "tests") | s.startswith("test_") | s.endswith("_test")


def test_base(path: Column) -> Column:
    """A file's stem without test marks: equal for a source and its test."""
    return F.regexp_replace(F.regexp_replace(stem(path), "^(test_)+", ""), "(_test)+$", "")


def normalized_path(p: Column) -> Column:
    """Backslashes as slashes; one leading './' dropped."""
    q = F.translate(p, "\\", "/")
    return F.when(q.startswith("./"), F.substring(q, 3, 1 << 30)).otherwise(q)


def lines(content: Column) -> Column:
    """Lines without their ends; a line end at the very end adds no line."""
    plain = F.regexp_replace(F.regexp_replace(content, "\r\n?", "\n"), r"\n\z", "")
    return F.when(F.length(content) == 0, F.array().cast("array<string>")).otherwise(F.split(plain, "\n"))


def is_import_line(line: Column) -> Column:
    first = F.regexp_replace(line, r"^\s+", "")
    return F.exists(F.array(*[F.lit(w + " ") for w in IMPORT_WORDS]), lambda w: F.startswith(first, w))


def is_comment_line(line: Column) -> Column:
    first = F.regexp_replace(line, r"^\s+", "")
    return F.exists(F.array(*[F.lit(m) for m in COMMENT_MARKS]), lambda m: F.startswith(first, m))


def without_boilerplate(content: Column) -> Column:
    return F.array_join(F.filter(lines(content), lambda x: ~is_import_line(x) & ~is_comment_line(x)), "\n")


def line_access(symbol: str, line: Column) -> Column:
    """Whether a line writes the symbol or only reads it: it is assigned to, itself or one of its items, is
    counted up or down, deleted, or asked to change itself by one of its methods."""
    name = r"\b\Q" + symbol + r"\E\b"
    plain = r"=(?![=>])"
    changing = "|".join(r"\Q" + op + r"\E" for op in CHANGING)
    after = rf"(?:{changing}|\+\+|--|{plain}|\[[^\]]*\]\s*{plain}|\.\s*(?:{'|'.join(MUTATING)})\s*\()"
    before = r"(?:(?:\+\+|--)\s*|\bdel\s+)"
    return F.when(line.rlike(rf"{name}\s*{after}") | line.rlike(before + name), "write").otherwise("read")
