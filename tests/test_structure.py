from loomspark.operators.structure import extract, resolve

FILES = {
    "pkg/a.py": "import pkg.b\nfrom .c import z\n\nclass A(B):\n    def f(self):\n        g(); self.h()\n        def inner():\n            k()\n\ndef g():\n    pass\n",
    "pkg/b.py": "x = 1\n", "pkg/c.py": "def z(:\n", "pkg/d.py": None,
    "src/a.ts": "import { b } from './b';\nexport class T extends U {\n  static run(x: number): number {\n    // go(1)\n    return go(x, 'stop()');\n  }\n}\nconst f = (a) => {\n  return a;\n};\n", "src/b.ts": "export function go(x) {\n  return x;\n}\n",
    "c/m.cpp": "#include \"m.h\"\nclass M : public Q {\nsignals:\n    void done(int x);\n};\nvoid M::leap() {\n    emit done(1);\n    connect(a, &M::done, b, &N::take);\n}\n", "c/m.h": "",
    "q/x.qml": "import QtQuick 2.0\nItem {\n  id: top\n  property int n: 1\n  onClicked: go()\n  Rect { }\n}\n", "CMakeLists.txt": "add_executable(app c/m.cpp c/none.cpp)\n", "r.rb": "require 'x'\nclass K < L\n  def m\n    p(1)\n  end\nend\n",
}


def test_extraction_and_resolution(spark):
    rows = extract(spark.createDataFrame([("r", p, t) for p, t in FILES.items()] + [(None, "x.py", "")], "repo_path string, path string, content string")).cache()
    nodes = {(r.id, r.kind) for r in rows.where("what = 'node'").collect()}
    for want in [("symbol:pkg/a.py:A.f", "func"), ("symbol:pkg/a.py:A.f.inner", "func"), ("symbol:src/a.ts:T.run", "func"), ("symbol:src/a.ts:f", "func"), ("symbol:c/m.cpp:signal.done", "signal"), ("symbol:q/x.qml:o2", "object"), ("target:app", "target"), ("symbol:r.rb:K.m", "func"), ("file:pkg/c.py", "file")]:
        assert want in nodes, want
    edges = {(r.source, r.target, r.relation) for r in resolve(rows).collect()}
    for want in [
        ("file:pkg/a.py", "file:pkg/b.py", "imports"), ("file:pkg/a.py", "file:pkg/c.py", "imports"), ("symbol:pkg/a.py:A.f", "symbol:pkg/a.py:g", "calls"), ("symbol:pkg/a.py:A.f", "name:h", "calls"), ("symbol:pkg/a.py:A", "name:B", "inherits"),
        ("file:src/a.ts", "file:src/b.ts", "imports"), ("symbol:src/a.ts:T.run", "symbol:src/b.ts:go", "calls"), ("file:c/m.cpp", "file:c/m.h", "imports"), ("file:c/m.cpp", "symbol:c/m.cpp:signal.done", "emits"), ("name:M::done", "name:N::take", "connects"),
        ("target:app", "file:c/m.cpp", "builds"), ("symbol:q/x.qml:o1", "symbol:q/x.qml:o2", "contains"), ("symbol:q/x.qml:o1", "name:clicked", "handles"), ("symbol:r.rb:K", "name:L", "inherits"),
    ]:
        assert want in edges, want
    assert not any(t == "name:k" and s.endswith("A.f") for s, t, _ in edges) and not any(t in ("name:stop",) for _, t, _ in edges)
    assert extract(spark.createDataFrame([], "repo_path string, path string, content string")).count() == 0
