"""Symbols, chunks and imports of sources in many languages."""

import time

import pytest

from siftwell.operators import parsing

#: language, source, (name, kind, first line, last line, parent) of its symbols.
CASES = [
    ("rust", "use foo;\nuse std::io;\n/// Doc\n/// more\npub fn long_name(\n    a: u32,\n    b: &str, // x {\n) -> u32 {\n    let s = \"fn not_me() {\";\n    a\n}\nimpl Calc {\n    fn add(&self) -> i32 {\n        1\n    }\n}\n",
     [("foo", "import", 1, 1, None), ("long_name", "function", 5, 11, None), ("Calc", "class", 12, 16, None), ("add", "function", 13, 15, "Calc")]),
    ("typescript", "import {\n  a,\n} from './x';\nexport const f = () => {\n  return 1;\n};\nconst config = { debug: true };\nlet counter = 0;\nconst g = function(name: string): string {\n  return name;\n};\nfunction greet(\n  name: string,\n): string {\n  return `function no() {`;\n}\nclass A {\n  foo(x: number) {\n    return 1;\n  }\n}\n/*\nfunction commented() {}\n*/\n",
     [("f", "function", 4, 6, None), ("config", "variable", 7, 7, None), ("counter", "variable", 8, 8, None), ("g", "function", 9, 11, None), ("greet", "function", 12, 16, None), ("A", "class", 17, 21, None), ("foo", "method", 18, 20, "A")]),
    ("python", 'import os\nimport numpy as np\nfrom .models import (\n    User,\n    Other,\n)\n\nclass User:\n    """def not_me(): a class\n    class Nor:\n    """\n    def __init__(\n        self,\n        name: str,\n    ):\n        self.name = name\n\n    async def greet(self) -> str:\n        return "def x"\n\ndef last():\n    pass\n',
     [("os", "import", 1, 1, None), ("numpy as np", "import", 2, 2, None), ("User", "import", 3, 6, None), ("User", "class", 8, 19, None), ("__init__", "function", 12, 16, "User"), ("greet", "function", 18, 19, "User"), ("last", "function", 21, 22, None)]),
    ("go", "package main\n\nimport \"fmt\"\n\ntype User struct {\n\tName string\n}\n\nfunc (u *User) Greet() string {\n\treturn fmt.Sprintf(\"}\")\n}\n\nfunc main() {\n}\n", [("User", "type", 5, 7, None), ("Greet", "method", 9, 11, None), ("main", "function", 13, 14, None)]),
    ("java", "import java.util.List;\npublic class Calculator {\n    private int value;\n\n    public Calculator(int initial) {\n        this.value = initial;\n    }\n\n    public int add(\n        int n\n    ) {\n        return value + n;\n    }\n}\n\ninterface Computable {\n    int compute();\n}\n",
     [("Calculator", "class", 2, 14, None), ("value", "variable", 3, 3, "Calculator"), ("add", "method", 9, 13, "Calculator"), ("Computable", "interface", 16, 18, None), ("compute", "method", 17, 17, "Computable")]),
    ("c", "#include <stdio.h>\n\nstruct Point {\n    int x;\n};\nenum Color {\n    RED\n};\nint add(int a, int b) {\n    return a + b;\n}\nstatic int\nmain2(int argc,\n      char **argv)\n{\n    printf(\"}\");\n    return 0;\n}\n",
     [("Point", "struct", 3, 5, None), ("Color", "enum", 6, 8, None), ("add(int a, int b)", "function", 9, 11, None), ("main2(int argc, char **argv)", "function", 12, 18, None)]),
    ("csharp", "using System;\nusing System.Text;\nnamespace A.B {\n    public class C {\n        public int P { get; set; }\n        public C(int x) {\n        }\n        public void Run(\n            int n)\n        {\n        }\n    }\n}\n",
     [("System", "import", 1, 1, None), ("A.B", "module", 3, 13, None), ("C", "class", 4, 12, "A.B"), ("P", "variable", 5, 5, "C"), ("Run", "method", 8, 11, "C")]),
    ("kotlin", "import kotlin.math.max\nclass A {\n    fun f(x: Int): Int {\n        return x\n    }\n}\n", [("kotlin.math.max", "import", 1, 1, None), ("A", "class", 2, 6, None), ("f", "function", 3, 5, "A")]),
    ("ruby", "module A\n  class B\n    def c?(x)\n      1\n    end\n  end\nend\n", [("A", "module", 1, 7, None), ("B", "class", 2, 6, "A"), ("c?", "function", 3, 5, "B")]),
    ("elixir", "defmodule A.B do\n  def c(x) do\n    1\n  end\nend\n", [("A.B", "module", 1, 5, None), ("c", "function", 2, 4, "A.B")]),
    ("php", "<?php\nnamespace App\\X;\nclass C {\n    public function f() {\n    }\n}\nfunction g() {\n}\n", [("App\\X", "module", 2, 2, None), ("C", "class", 3, 6, None), ("f", "method", 4, 5, "C"), ("g", "function", 7, 8, None)]),
    ("json", '{\n  "a": {\n    "b": [1, 2],\n    "c": "x: y"\n  }\n}\n', [("a", "variable", 2, 5, None), ("b", "variable", 3, 3, "a"), ("c", "variable", 4, 4, "a")]),
    ("yaml", "a:\n  b: 1\n  c:\n    d: 2\ne: 3\n", [("a", "variable", 1, 4, None), ("b", "variable", 2, 2, "a"), ("c", "variable", 3, 4, "a"), ("d", "variable", 4, 4, "c"), ("e", "variable", 5, 5, None)]),
    ("toml", '[table]\nkey = "v"\n', [("table", "struct", 1, 1, None), ("key", "variable", 2, 2, None)]),
    ("bash", "foo() {\n  X=1 # } \n}\n", [("foo", "function", 1, 3, None), ("X", "variable", 2, 2, "foo")]),
]


@pytest.mark.parametrize("language,source,want", CASES, ids=[c[0] for c in CASES])
def test_symbols(language, source, want):
    got = parsing.extract_symbols(source, language)
    assert [(s["name"], s["kind"], s["start_line"], s["end_line"], s["parent"]) for s in got] == want
    lines = source.split("\n")
    for s in got:
        assert source.encode()[s["start_byte"] : s["end_byte"]].decode() == "\n".join(lines[s["start_line"] - 1 : s["end_line"]]).lstrip()
        assert s["signature"] == lines[s["start_line"] - 1].strip()


def test_doc_comments_and_odd_sources():
    rust = {s["name"]: s for s in parsing.extract_symbols(CASES[0][1], "rust")}
    assert rust["long_name"]["doc_comment"] == "/// Doc\n/// more" and rust["Calc"]["doc_comment"] is None
    for language in (*parsing.RULES, "unknown"):
        for source in ("", "\n\n", "{" * 50, "((((\n" * 100, '"unclosed', "/* unclosed\nfn x() {}", "\u00e9\ud7ff\n", "x" * 5000):
            assert isinstance(parsing.extract_symbols(source, language), list)
            assert isinstance(parsing.chunk_source(source, language), list)


def test_chunks_at_boundaries():
    source = "".join(f"def f{k}():\n    return '{'x' * 300}'\n\n" for k in range(12))
    got = parsing.chunk_source(source, "python")
    assert got[0]["start_line"] == 1 and got[-1]["end_line"] == 36 and [n for c in got for n in c["symbols"]] == [f"f{k}" for k in range(12)]
    assert all(b["start_line"] == a["end_line"] - 2 for a, b in zip(got, got[1:], strict=False))
    assert all(len(c["content"]) >= 1490 for c in got[:-1])


def test_long_files_take_linear_time():
    began = time.time()
    source = "".join(f"pub fn f_{k}() {{\n    // {'x ' * 60}\n}}\n\n" for k in range(60_000))
    got = parsing.chunk_source(source, "rust")
    assert got[0]["start_line"] == 1 and got[-1]["end_line"] == 240_000 and got[-1]["end_byte"] == len(source) - 1
    assert [n for c in got for n in c["symbols"]] == [f"f_{k}" for k in range(60_000)]
    assert all(source[c["start_byte"] : c["end_byte"]] == c["content"] for c in (got[0], got[7], got[-1]))
    assert time.time() - began < 25
    # blocks that stay open to the end
    began = time.time()
    open_ = parsing.extract_symbols("".join(f"fn f_{k}() {{\n" for k in range(20_000)), "rust")
    assert len(open_) == 20_000 and {s["end_line"] for s in open_} == {20_000} and open_[-1]["parent"] == "f_19998"
    nested = parsing.extract_symbols("".join(f"{' ' * k}a{k}:\n" for k in range(300)) + "\n" * 300_000 + "b: 1\n", "yaml")
    assert [s["end_line"] for s in nested] == [300] * 300 + [300_301]
    assert time.time() - began < 25


def test_texts_without_boundaries_are_only_cut(monkeypatch):
    """No symbols are sought in a text whose chunks do not depend on them, and a long one takes linear time."""
    def fail(*_):
        raise AssertionError("parsed for symbols")

    monkeypatch.setattr(parsing, "_code", fail)
    for language in ("", "unknown", "json", "yaml"):
        assert [c["end_line"] for c in parsing.chunk_source('"x": 1\n' * 400, language)] == [215, 400, 400]
    began = time.time()
    got = parsing.chunk_source("ab\n" * 1_000_000, "")
    assert got[1]["start_line"] == 498 and got[-1]["end_line"] == 1_000_000 and max(c["end_byte"] for c in got) == 2_999_999
    assert time.time() - began < 20


def test_far_blocks_end_where_near_ones_do():
    body = "    if x {\n    }\n" * 200
    for language, head, tail in (("rust", "fn a() {\n", "}\nfn b() {\n}\n"), ("typescript", "function a() {\n", "}\nfunction b() {\n}\n")):
        assert [(s["name"], s["end_line"]) for s in parsing.extract_symbols(head + body + tail, language)] == [("a", 402), ("b", 404)]
    ruby = "module A\n" + "".join(f"  def f{k}\n    1\n  end\n" for k in range(100)) + "end\n"
    assert [s["end_line"] for s in parsing.extract_symbols(ruby, "ruby")] == [302] + [3 * k + 4 for k in range(100)]


def test_rows_leave_in_batches(spark, monkeypatch):
    monkeypatch.setattr(parsing, "BATCH_ROWS", 5)
    source = "".join(f"def f{k}():\n    return '{'x' * 300}'\n\n" for k in range(40))
    files = spark.createDataFrame([(1, source, "python"), (2, None, "python"), (3, "a\nb", None), (4, "", "rust")], "file_id long, content string, language string")
    for rows, one in ((parsing.parse_symbols(files), parsing.extract_symbols), (parsing.parse_chunks(files), parsing.chunk_source)):
        got = [r.asDict() for r in rows.orderBy("file_id", "start_line").collect()]
        assert got == [{"file_id": i, **row} for i, text, language in ((1, source, "python"), (3, "a\nb", ""), (4, "", "rust")) for row in one(text, language)]


def test_imports_over_lines(spark):
    rows = [(1, "rust", "use a::{\n    b,\n    c,\n};\nuse d;\npub use x::y;\n"), (2, "typescript", "import {\n  a,\n  b,\n} from './utils';\nimport \"side\";\nexport { z } from './no';\nconst s = 'import x from \"no\"';\n"), (3, "go", 'import (\n\t"fmt"\n\te "github.com/pkg/errors"\n)\n'),
            (4, "python", "from .m import (\n    A,\n)\r\nimport os, sys\n"), (5, "java", None), (6, "nothing", "import x"), (7, "c", '#include <a.h>\n#include "b.h"\n'), (8, "php", "use A\\B as C;\n"), (9, "rust", "")]
    df = spark.createDataFrame(rows, "file_id long, language string, content string")
    got = sorted((r["file_id"], r["line"], r["target_path"], r["kind"]) for r in parsing.extract_imports(df).collect())
    assert got == [(1, 1, "a::{\n    b,\n    c,\n}", "external"), (1, 5, "d", "external"), (2, 1, "./utils", "local"), (2, 5, "side", "external"), (3, 2, "fmt", "std"), (3, 3, "github.com/pkg/errors", "external"),
                   (4, 1, ".m", "local"), (4, 4, "os", "std"), (7, 1, "a.h", "std"), (7, 2, "b.h", "local"), (8, 1, "A\\B", "external")]
