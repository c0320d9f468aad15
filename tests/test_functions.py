import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell.functions import expansion, scoring, text
from siftwell.operators import calibration, parsing

EXPAND = {
    "get_user": ["getUser"], "getUser": ["get_user"], "HelloWorld": ["hello_world"], "hello-world": ["hello_world", "helloWorld"], "getUserByID": ["get_user_by_i_d"], "HTTPServer": [], "HELLO": [], "test": [],
    "_private": ["Private"], "my_Var-name": ["myVar-name", "my__var-name", "my_Var_name", "myVarName"], "a_b cD EfG": ["aB", "c_d", "ef_g", "efG"], "snake_case other_thing": ["snakeCase", "otherThing"],
}


@pytest.mark.parametrize("query", EXPAND)
def test_expand(query):
    assert expansion.expand(query) == EXPAND[query]


def test_expand_column_agrees(spark):
    rows = spark.createDataFrame([(q,) for q in EXPAND], "q string").select("q", expansion.expand_col(F.col("q")).alias("t")).collect()
    assert {r["q"]: r["t"] for r in rows} == EXPAND


@given(st.text("abcXYZ_- ", max_size=30))
def test_expand_has_no_repeats(query):
    out = [t.lower() for t in expansion.expand(query)]
    assert len(out) == len(set(out)) and query.lower() not in out


def test_only_ten_tokens():
    assert len(expansion.expand(" ".join(f"a_{c}" for c in "bcdefghijklmn"))) == 10


def _one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


@pytest.mark.parametrize("name,term,kind,want", [
    ("get_user", "get_user", "function", 1.0), ("users", "user", "variable", 0.8415), ("USER", "user", "constant", 1.0), ("reuser", "user", "module", 0.763636),
    ("forget_user_cfg", "get_user", "variable", 0.6615), ("User", "get_user", "struct", 0.611111), ("x", "user", "variable", 0.525)])
def test_symbol_score(spark, name, term, kind, want):
    assert _one(spark, scoring.symbol_score(F.col("n"), F.col("t"), F.col("k")), n=name, t=term, k=kind) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("line,term,want", [("main", "main", 0.9), ("main = 1", "main", 0.7), ("let main = 1", "main", 0.674545), ("fn main() {", "MAIN", 0.68), ("domain()", "main", 0.488889), ("éé main", "main", 0.473684)])
def test_line_score(spark, line, term, want):
    assert _one(spark, scoring.line_score(F.col("l"), F.col("t")), l=line, t=term) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("path,lang", [("a/b.RS", "rust"), ("x.tar.py", "python"), ("Makefile", None), (".gitignore", None), ("d.x/file", None), ("a.hh", "cpp")])
def test_language(spark, path, lang):
    assert _one(spark, text.language(F.col("p")), p=path) == lang


@pytest.mark.parametrize("path,out", [("src/a.rs", False), ("node_modules/x.js", True), ("./a", False), ("../a", False), ("a/.x/b", True), ("a/build", True), ("abuild/x", False)])
def test_excluded_path(spark, path, out):
    assert _one(spark, text.excluded_path(F.col("p")), p=path) is out


def test_lines(spark):
    for source, want in (("a\r\nb\n", ["a", "b"]), ("", []), ("\n", [""]), ("a", ["a"]), ("a\n\nb", ["a", "", "b"])):
        assert _one(spark, text.lines(F.col("s")), s=source) == want
    assert _one(spark, text.line_slice(F.col("s"), 2, 3), s="a\nb\nc\nd") == "b\nc"
    assert _one(spark, text.line_slice(F.col("s"), 3, 2), s="a\nb\nc") == ""


def test_validation():
    assert text.validate(" x ") == "x" and text.validate("a" * 500)
    for value, what, code in (("", "QUERY", "INVALID_QUERY"), ("a" * 501, "QUERY", "QUERY_TOO_LONG"), (" ", "SYMBOL", "INVALID_SYMBOL"), ("a/../b", "PATH", "PATH_TRAVERSAL"), ("é" * 251, "PATH", "PATH_TOO_LONG")):
        with pytest.raises(text.RequestError) as e:
            text.validate(value, what)
        assert e.value.code == code
    assert text.parse_csv(" Rs, ,PY ") == ["rs", "py"] and text.parse_csv(" , ") is None
    assert text.capped(None, 20, 100) == 20 and text.capped(5000, 20, 100) == 100


@pytest.mark.parametrize("lines,size,want", [
    (["x" * 9] * 10, 1500, [(1, 10), (8, 10)]), (["x" * 9] * 10, 50, [(1, 5), (3, 7), (5, 9), (7, 10), (8, 10)]), (["x" * 9] * 4, 1500, [(1, 4), (2, 4)]), (["x" * 9] * 3, 1500, [(1, 3)]),
    (["x" * 5000, "a", "b", "c", "d"], 1500, [(1, 1), (2, 5), (3, 5)]), ([], 1500, [])])
def test_chunk_lines(lines, size, want):
    assert [(a + 1, b) for a, b in parsing.chunk_lines(lines, size)] == want


@given(st.lists(st.text("ab\n", max_size=40), max_size=30), st.integers(1, 60))
def test_chunks_cover_every_line(lines, size):
    flat = "\n".join(lines).split("\n")
    covered = {k for a, b in parsing.chunk_lines(flat, size) for k in range(a, b)}
    assert covered == set(range(len(flat)))


def test_semantic_chunks():
    source = "\n".join(["fn a() {", "x" * 900, "}", "fn b() {", "y" * 900, "}", "fn c() {", "}"])
    out = parsing.chunk_source(source, "rust", 1500)
    assert [(c["start_line"], c["end_line"], c["symbols"]) for c in out] == [(1, 6, ["a", "b"]), (4, 8, ["c"])]


def test_symbols():
    found = parsing.extract_symbols("/// Says hello.\n/// Twice.\npub fn hello() {\n    x();\n}\npub struct User {\n    id: u32,\n}\nimpl User {\n    pub fn new() -> Self { User }\n}\n", "rust")
    assert [(s["name"], s["kind"], s["start_line"], s["end_line"], s["parent"]) for s in found] == [("hello", "function", 3, 5, None), ("User", "struct", 6, 8, None), ("User", "class", 9, 11, None), ("new", "function", 10, 10, "User")]
    assert found[0]["doc_comment"] == "/// Says hello.\n/// Twice." and found[0]["signature"] == "pub fn hello() {"
    ts = parsing.extract_symbols("const f = (a) => a;\nlet g = 1;\nclass A {\n  run() {\n  }\n}\n", "typescript")
    assert [(s["name"], s["kind"]) for s in ts] == [("f", "function"), ("g", "variable"), ("A", "class"), ("run", "method")]
    py = parsing.extract_symbols("class User:\n    def name(self):\n        return 1\n\ndef process_data():\n    pass\n", "python")
    assert [(s["name"], s["kind"], s["end_line"], s["parent"]) for s in py] == [("User", "class", 3, None), ("name", "function", 3, "User"), ("process_data", "function", 6, None)]
    c = parsing.extract_symbols("int add(int a, int b) {\n  return a + b;\n}\nint main() {\n}\nstruct P { int x; };\n", "c")
    assert [(s["name"], s["kind"]) for s in c] == [("add(int a, int b)", "function"), ("main()", "function"), ("P", "struct")]


def test_statistics(spark):
    obs = spark.createDataFrame([("a", float(i)) for i in range(100)] + [("b", 0.5)], "language string, distance double")
    rows = {r["language"]: r for r in calibration.distance_stats(obs).collect()}
    a = rows["a"]
    assert [a[f"p{p}"] for p in (10, 25, 50, 75, 90, 95)] == pytest.approx([9.9, 24.75, 49.5, 74.25, 89.1, 94.05])
    assert rows["b"]["mean"] == rows["b"]["min"] == rows["b"]["max"] == 0.5


def test_calibration(spark):
    values = [0.8 + (2 * i / 100 - 1) * 0.3 for i in range(100)]
    obs = spark.createDataFrame([("rust", v) for v in values] + [("go", 0.1)] * 5, "language string, distance double")
    rows = {r["language"]: r for r in calibration.calibrate(obs.filter("language = 'rust'")).collect()}
    assert rows["rust"]["max_distance"] == pytest.approx(1.0346, abs=1e-4) and rows["rust"]["min_similarity"] == pytest.approx(0.6413, abs=1e-4) and rows["rust"]["confidence"] == "low"
    assert {r["language"] for r in calibration.calibrate(obs, 10).collect()} == {"rust", "_global"}
    low = calibration.calibrate(spark.createDataFrame([("x", i / 1000) for i in range(100)], "language string, distance double")).first()
    assert (low["max_distance"], low["min_similarity"]) == (0.5, 0.8)


def test_lookup_and_sampling(spark):
    rows = spark.createDataFrame([("a", 1.0, 0.5, "high"), ("b", 1.1, 0.4, "low"), ("_global", 0.9, 0.6, "medium")], "language string, max_distance double, min_similarity double, confidence string")
    langs = spark.createDataFrame([("a",), ("b",), ("c",)], "language string")
    assert {r["language"]: r["max_distance"] for r in calibration.lookup(langs, rows).collect()} == {"a": 1.0, "b": 0.9, "c": 0.9}
    assert {r["max_distance"] for r in calibration.lookup(langs, rows.filter("confidence = 'low'")).collect()} == {1.2}
    assert [calibration.sample_every(r) for r in (0, 0.1, 0.5, 1, 2)] == [0, 10, 2, 1, 1]
    assert calibration.bootstrap(250) == (True, 50) and calibration.bootstrap(600) == (False, 100)


def test_newer_versions(spark):
    rows = [("1.2.3", "1.2.2", True), ("1.2.3", "1.2.3", False), ("1.10.0", "1.9.9", True), ("v2.0.0", "1.9.9", True), ("1.2", "1.2.0", False), ("x.y", "0.0.1", False), ("2", "1.9.9", True)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert [r["got"] for r in df.select(scoring.newer(F.col("a"), F.col("b")).alias("got")).collect()] == [w for *_, w in rows]


def test_vectors_of_bytes(spark):
    import struct

    vectors = [[1.0, -2.5, 0.1, 3.4e38, 1e-45, -0.0, 0.0], [float("inf"), -float("inf")], []]
    rows = [(bytearray(struct.pack(f"<{len(v)}f", *v)),) for v in vectors] + [(bytearray(b"abc"),), (None,)]
    got = [r["v"] for r in spark.createDataFrame(rows, "b binary").select(scoring.vector_of_bytes(F.col("b")).alias("v")).collect()]
    assert got == [list(struct.unpack(f"<{len(v)}f", struct.pack(f"<{len(v)}f", *v))) for v in vectors] + [[], None]
