"""Syntax check, documentation pairs and hand-written classifier."""

import ast
import json
import random

import pytest

from loomspark.llm import docpairs, handwritten, syntax
from loomspark.llm.code.chart import Chart, Grammar

VALID = {
    "a.py": "import os\n\n@dec(1)\nasync def f(a, *, b: int = 2, **k) -> int:\n    '''Doc { not a brace'''\n    x = [i for i in range(3) if i]\n    return {**k, 'a': f\"{x}\"}\n\nclass C(B, metaclass=M):\n    x: int = 1\n    def g(self):\n        try:\n            pass\n        except (A, B) as e:\n            raise X from e\n        else:\n            y = lambda q, *r: q if r else None\n        finally:\n            del y\n",
    "b.js": "import a, { b as c } from './x'\nexport default class A extends B {\n  #p = 1\n  static async *gen(x = {}, ...r) { yield* r }\n  get v() { return this.#p ?? `t${`n${1}`}` }\n}\nconst f = async ({ a, b: [c] }, d = 1) => ({ a, ...d })\nfor (const x of y) if (x) continue; else break\nlabel: while (true) { switch (x) { case 1: default: break } }\nvar re = /[/{]\"/g.test(s), t = a / b / c\nlet {q = 1} = z\n",
    "c.jsx": "const A = () => {\n  return <div a={x > 1 ? 'y' : {z: 1}}>text {list.map(i => <b key={i}/>)} it's</div>;\n}\n",
    "d.ts": "interface A<T extends object = {}> extends B { readonly x?: Map<string, number[]>; f(a: T): void; [k: string]: any }\ntype U = 'a' | { t: number } | ((x: string) => Promise<void>);\nenum E { A = 1, B }\nabstract class C<T> implements D { constructor(private readonly a: number) { super() } abstract g(): T; m<K>(this: C<K>, x?: K): x is T { return x as unknown as T } }\nexport const f = <T,>(x: T): T => x!;\ndeclare module 'm' { export function g(a: string): number; }\n",
    "E.java": "package a.b;\nimport static a.C.*;\n@Ann(value = {1, 2}) public final class E<T extends Comparable<T>> extends B implements C, D {\n  private static final int[] X = {1, 2};\n  public E() { this(1); }\n  @Override public <R> Map<String, List<R>> f(final int... a) throws X, Y {\n    for (int i = 0, j = 1; i < 3; i++) { if (x instanceof String s && s.length() > 1) continue; }\n    Runnable r = () -> { int y = (int) z; };\n    return switch (k) { case A, B -> 1; default -> { yield 2; } };\n  }\n  enum Q { A(1) { void x() {} }, B; int y; }\n  record P(int a, String b) {}\n}\n",
    "f.go": "package main\n\nimport (\n\t\"fmt\"\n\tm \"math\"\n)\n\ntype S[T any] struct {\n\tA, b int `json:\"a\"`\n\t*E\n}\n\nfunc (s *S[T]) F(a, b int, c ...string) (x int, err error) {\n\tfor i := range c {\n\t\tif v, ok := m[i]; !ok {\n\t\t\tcontinue\n\t\t} else if v > 1 {\n\t\t\treturn\n\t\t}\n\t}\n\tswitch t := x.(type) {\n\tcase int, string:\n\t\tgo func() { ch <- 1 }()\n\tdefault:\n\t\tdefer f()\n\t}\n\ty := map[string][]int{\"a\": {1, 2}}\n\treturn y[\"a\"][1:], nil\n}\n",
    "g.rs": "use std::{fmt, io::*};\n#[derive(Debug)]\npub struct S<'a, T: Clone + 'a> where T: Copy { pub a: &'a [T], b: Option<Box<dyn Fn(i32) -> i32>> }\nimpl<'a, T> Tr for S<'a, T> {\n    type O = i32;\n    pub(crate) async fn f(&mut self, (a, b): (i32, u8)) -> Result<(), E> {\n        let x = if let Some(y) = z { y } else { return Err(e)? };\n        match x { 0..=9 | 11 => {}, n if n > 3 => println!(\"{}\", n), _ => () }\n        for i in (0..n).rev().step_by(2) { v[i] += 1; }\n        let c = move |a: i32, b| -> i32 { a + b };\n        x as u64 >> 2\n    }\n}\nmacro_rules! m { ($a:expr) => { $a } }\n",
    "h.cpp": "#include <vector>\n#define X(a) \\\n  ((a) + 1)\nnamespace a::b {\ntemplate <typename T, int N = 3>\nclass C final : public B<T>, private D {\npublic:\n  explicit C(int a) : B<T>(a), x_{a} {}\n  virtual ~C() = default;\n  C& operator=(const C&) = delete;\n  std::map<std::string, std::vector<int>> f(const T& t, int* p = nullptr) const noexcept override;\nprivate:\n  int x_[3] = {1, 2};\n};\nenum class E : int { A = 1, B };\nauto g() -> int { auto l = [&, x = 1](auto&& a) mutable { return a << 2; }; for (auto& [k, v] : m) { if (v > 1) return static_cast<int>(v); } return l(1); }\n}\n",
    "i.rb": "require 'x'\nmodule A\n  class B < C::D\n    attr_reader :a, :b\n    X = %w[a b].freeze\n    def f(a, b = 1, *c, d:, e: 2, **f, &g)\n      return if a.nil?\n      a.each_with_index do |x, i|\n        puts \"#{x[\"k\"]} #{i}\" unless i > 1\n      end\n      h = { a: 1, 'b' => ->(z) { z } }\n      case a\n      when 1, 2 then 3\n      else 4\n      end\n    rescue E => e\n      raise\n    ensure\n      z\n    end\n    def self.g = 1\n    def ok?() = true\n  end\nend\n",
    "j.qml": "import QtQuick 2.15\nimport \"x.js\" as X\nItem {\n    id: a\n    property int b: 1\n    property var c: [1, 2]\n    signal d(int e)\n    width: parent.width / 2\n    onWidthChanged: { if (a) b = 2 }\n    anchors { fill: parent; margins: 3 }\n    Rectangle { color: \"red\" }\n    function f(x) { return x }\n}\n",
    "k.json": '{"a": [1, -2.5e3, true, null, {"b": "\\u00e9"}], "c": {}}',
}
EMPTY_OK = [p for p in VALID if not p.endswith((".json", ".qml"))]


@pytest.mark.parametrize("path", VALID)
def test_valid_files_have_no_cost(path):
    lang, cost, why, line, *_ = syntax.judge(path, VALID[path])
    assert cost == 0, (why, line)


@pytest.mark.parametrize("path", EMPTY_OK)
def test_empty_code_is_valid(path):
    assert syntax.judge(path, "")[1] == 0 and syntax.judge(path, "\n\n")[1] == 0


@pytest.mark.parametrize("path", VALID)
def test_truncation_and_conflicts_are_found(path):
    text = VALID[path]
    cut = text.rstrip()[: len(text) * 2 // 3].rsplit("(", 1)[0] + "(" if path != "k.json" else text[:20]
    assert syntax.judge(path, cut)[1] > 0
    lines = text.split("\n")
    at = len(lines) // 2
    j = syntax.judge(path, "\n".join([*lines[:at], "<<<<<<< HEAD", lines[at], "=======", ">>>>>>> b", *lines[at:]]))
    assert j[1] > 0 and j[2] == "conflict"


def test_other_language_is_a_mismatch():
    for path in VALID:
        if path not in ("a.py", "k.json"):
            assert syntax.judge(path, "def f(x):\n    return x\n\nclass A:\n    def g(self):\n        pass\n")[1] > 0
    assert syntax.judge("x.js", "#include <a>\nint main() { return 0; }\n")[1] > 0
    assert syntax.judge("x.md", "anything") is None


def test_python_agrees_with_interpreter_on_mutations():
    rng = random.Random(5)
    text = VALID["a.py"]
    for _ in range(60):
        i = rng.randrange(len(text))
        t = text[:i] + rng.choice(["", "(", ")", ":", " ", "x", "=", '"']) + text[i + rng.randrange(2) :]
        try:
            ast.parse(t)
            valid = True
        except SyntaxError:
            valid = False
        got = syntax.judge("a.py", t)[1] == 0
        assert got or not valid, t  # nothing valid is flagged


def test_json_agrees_with_the_library():
    for t in ['{"a": 1,}', "[1,,2]", "{'a': 1}", "[1 2]", "", "nul", '{"a" 1}', "[1]]", "01", '"a\nb"', "[]", " 1 ", '{"a":{"a":[]}}']:
        try:
            json.loads(t)
            valid = True
        except ValueError:
            valid = False
        assert (syntax.judge("x.json", t)[1] == 0) == valid, t


def test_chart_costs():
    g = Grammar("s = 'a' s 'b' | 'a' 'b'", {})
    c = Chart(g, lambda k, r: 0)
    assert [c.cost("s", tuple(x)) for x in ("ab", "aabb", "aab", "aabbb", "ba", "a")] == [0, 0, 1, 1, 2, 1]


def test_deep_nesting_does_not_crash():
    assert syntax.judge("x.js", "x = " + "(" * 30_000 + "1" + ")" * 30_000 + ";")[1] == 0
    assert syntax.judge("x.js", "x = " + "(" * 30_000)[1] > 0


DOCS = {
    "a.js": ("/**\n * Moves the frame to disk while the lock is held.\n * @param x\n */\nexport async function moveFrame(x) {\n  return x;\n}\n\n// Far above.\n\nfunction gap() {}\n// move frame\nfunction moveFrame2() {}\nconst c = (a) => {\n  return a;\n};\n// Keeps only the newest rows of each group.\nconst keepNewest = (rows) => {\n  return rows;\n};\n// TODO\nfunction todo() {}\n// eslint-disable-next-line\nfunction lint() {}\nclass A {\n  // Reads the header before anything else happens.\n  static readHeader(x) { return x; }\n}\n", {("moveFrame", 5), ("keepNewest", 18), ("readHeader", 27)}),
    "a.py": ("# Above does not count in this language at all.\ndef f():\n    return 1\n\n@dec\ndef g(\n    a,\n):\n    '''Merges two sorted runs without copying.'''\n    def inner():\n        f'''Not a docstring, whatever it says here.'''\n    return a\n\nclass C:\n    async def h(self):\n        r'''\n        Waits for the slowest worker and returns its rows.\n        '''\n\n    def bare(self):\n        '''\n        Args:\n            x: the row\n        '''\n", {("g", 6), ("h", 15)}),
    "a.rs": ("//! Inner text about the whole file here.\nfn a() {}\n\n/// Returns the budget that remains after packing.\n#[must_use]\npub(crate) fn budget_left(x: i64) -> i64 { x }\n", {("budget_left", 6)}),
    "A.java": ("class A {\n  // Decides which pool may keep the lease.\n  @Override\n  @X(\"a\")\n  public int pick(int a) { return a; }\n  /** Pick. */\n  int pick2() { return 1; }\n  // int old = pick(3);\n  int older() { return 1; }\n}\n", {("pick", 5)}),
    "a.cpp": ("//! Trims every scope that the gateway left behind.\ntemplate <typename T>\nint A::trimScope(T a) { return a; }\n// ------------\nint ruler() { return 1; }\n", {("trimScope", 3)}),
    "a.rb": ("class A\n  # Returns the matrix that was last written.\n  # @param [Integer] x\n  def last_matrix(x)\n    x\n  end\n\n  # last matrix\n  def self.last_matrix2\n    1\n  end\nend\n", {("last_matrix", 4)}),
    "a.go": ("package a\n\n// Walk visits all entries once the index has settled.\nfunc (s *S) Walk(a int) int {\n\treturn a\n}\n", {("Walk", 4)}),
    "bad.js": ("// Moves the frame to disk while the lock is held.\nfunction f( {\n", set()),
}


@pytest.mark.parametrize("path", DOCS)
def test_documented_functions(path):
    text, want = DOCS[path]
    got = list(docpairs.pairs_of(path, text))
    assert {(n, line) for n, line, _, _ in got} == want
    for name, _, code, doc in got:
        assert name in code and doc


def test_evidence_of_other_hands():
    m = {}
    judge = lambda path, text, repo="/srv/holnor": handwritten.evidence(repo, path, text, m)[0]
    code = "def fold_frame(ticket):\n    total = ticket + 1\n    return total\n"
    assert judge("src/a.py", code) == ""
    assert judge("src/vendors/a.py", code) == ""
    assert judge("third_party/x/a.py", code) == "vendored"
    assert judge("a.py", "# This file is part of tamsol.\n" + code) == "vendored"
    assert judge("a.py", "# This file is part of holnor.\n" + code) == ""
    assert judge("a.py", "# Copyright the maintainers of this repository.\n" + code) == ""
    assert judge("a.py", "# Code generated by x. DO NOT EDIT.\n" + code) == "generated"
    assert judge("a.py", "# Skips files that say \"Code generated by x. DO NOT EDIT.\"\n" + code) == ""
    assert judge("a.py", "# generated keys are never reused\n" + code) == ""
    assert judge("a.py", "T = [\n" + '    "' + "x" * 70 + '",\n' * 1 + ('    "' + "y" * 70 + '",\n') * 20 + "]\n") == "data"
    assert judge("a.rs", "".join(f"pub const F_{i:04d}: u32 = {i};\n" for i in range(60))) == "generated"
    assert judge("a.py", "") == ""


def test_models_decide_without_the_lists():
    common = "scanner ledger frame ticket total render window channel record planner".split()
    counts = handwritten.Counter(g for w in common for _ in range(50) for g in handwritten._trigrams(w))
    m = {"js": handwritten.NameModel(counts), "path": handwritten.NameModel(counts)}
    calm = sum(handwritten.strangeness(m["path"], f"{w}.js") for w in common) / len(common)
    judge = lambda path, text: handwritten.evidence("/srv/holnor", path, text, m, (calm, 0.3))[0]
    short = ";\n".join(f"{a}={b}({c})" for a, b, c in zip("qxzkvjwq", "zkvjwqxz", "vjwqxzkv")) + ";\n"
    plain = ";\n".join(f"{a} = {b}({c})" for a, b, c in zip(common, common[1:], common[2:])) + ";\n"
    assert judge("ledger.js", short) == "minified" and judge("ledger.js", plain) == ""
    told = "// Distributed as part of the upstream package.\n" + plain
    assert judge("src/zxqvwk.js", told) == "vendored" and judge("src/ledger.js", told) == ""
    assert handwritten.diversity([f"row_{i:04d}" for i in range(40)])[0] < 0.1 and handwritten.diversity(common)[0] == pytest.approx(1.0)


def test_tables_with_nulls_and_repeats(spark):
    schema = "repo_path string, path string, modified_at double, content string, g string"
    rows = [("r", "a.js", 2.0, DOCS["a.js"][0], "x"), ("r", "a.js", 2.0, DOCS["a.js"][0], "x"), ("r", "a.js", 1.0, "function (", "x"), ("r", "b.js", None, None, ""), (None, "c.js", 1.0, "x", ""), ("r", None, 1.0, "(", ""), ("r", "d.js", 1.0, "f(", ""), ("r", "e.json", 1.0, "", "")]
    df = spark.createDataFrame(rows, schema)
    assert {(r.func_name, r.func_line) for r in docpairs.documented_functions(df).collect()} == DOCS["a.js"][1]
    assert {r.path for r in syntax.check_files(df).where("edit_cost > 0").collect()} == {"d.js", "e.json"}
    assert {r.path for r in handwritten.judge_files(df).collect()} == {"a.js", "d.js"}
    empty = spark.createDataFrame([], schema)
    assert docpairs.documented_functions(empty).count() == syntax.check_files(empty).count() == handwritten.judge_files(empty).count() == 0
