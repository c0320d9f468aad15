import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.engine import Engine, format_results
from siftwell.functions.text import RequestError
from siftwell.operators import calibration, retrieval
from siftwell.operators.embedding import HashedTokens, Stub
from siftwell.operators.collector import Collector, query_hash
from siftwell.sources.store import ConcurrentWrite, Store
from siftwell.sources.tree import FileList, read_slice, read_tree, walk
from siftwell.streaming import changes

SOURCES = {
    "src/users.rs": "use std::collections::HashMap;\nuse crate::shared;\n\n/// Finds a user.\npub fn get_user(id: u32) -> User {\n    load(id)\n}\n\npub struct User {\n    id: u32,\n}\n",
    "src/shared.rs": "pub fn calculate_total() -> u32 {\n    let user = get_user(1);\n    user.id\n}\n",
    "app/_main.py": "import os\nfrom .models import User\n\ndef run():\n    return getUser()\n",
    "README.md": "get_user is here\n", "node_modules/x.js": "function get_user() {}\n", ".hidden/a.py": "def get_user(): pass\n", "skip/me.py": "def get_user(): pass\n", ".gitignore": "skip/\n*.log\n",
}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "project"
    for path, content in SOURCES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(content)
    (root / "src/bad.rs").write_bytes(b"\xff\xfe")
    return str(root)


def test_walk_and_read(spark, tree):
    assert list(walk(tree)) == ["README.md", "app/_main.py", "src/bad.rs", "src/shared.rs", "src/users.rs"]
    assert {r["path"] for r in read_tree(spark, tree).collect()} == {"README.md", "app/_main.py", "src/shared.rs", "src/users.rs"}
    assert read_slice(tree, "src/shared.rs", 2, 3) == "    let user = get_user(1);\n    user.id"
    with pytest.raises(RequestError):
        read_slice(tree, "../../etc/passwd", 1, 1)


def test_engine(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"))
    assert engine.index(tree) == {"added": 3, "changed": 0, "removed": 0, "same": 0}
    assert engine.index(tree) == {"added": 0, "changed": 0, "removed": 0, "same": 3}
    stats = {r["table_name"]: r["n"] for r in engine.stats().collect()}
    assert stats["files"] == 3 and stats["dependencies"] == 4
    rows = engine.search("get_user", 10).collect()
    assert rows[0]["symbol_name"] == "get_user" and rows[0]["score"] == 1.0
    assert len({(r["path"], r["start_line"], r["end_line"]) for r in rows}) == len(rows) <= 10
    assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
    assert "users.rs" in format_results(engine.search("get_user", 3))
    refs = engine.find_refs("get_user").collect()
    assert refs[0]["content"].startswith("pub fn get_user") and {r["path"] for r in refs if r["part"] == 1} == {"src/shared.rs", "app/_main.py"}
    assert {r["source_path"] for r in engine.dependents("src/shared.rs").collect()} == {"src/users.rs"}
    answer = engine.respond("/deps", {"file_path": "src/users.rs"})
    assert answer["imports"][0] == {"target": "std::collections::HashMap", "kind": "std", "symbols": ["HashMap"]}
    assert engine.respond("/search", {"query": "x" * 501})["code"] == "QUERY_TOO_LONG" and engine.respond("/explain", {"symbol": ""})["code"] == "INVALID_SYMBOL"
    assert engine.respond("/explain", {"symbol": "get_user"})["related"] == ["User"]
    os.remove(os.path.join(tree, "src/shared.rs"))
    with open(os.path.join(tree, "app/_main.py"), "a") as file:
        file.write("\ndef added_later():\n    pass\n")
    assert engine.index(tree) == {"added": 0, "changed": 1, "removed": 1, "same": 1}
    incremental = {(r["name"], r["kind"], r["start_line"]) for r in engine.store.table("symbols").collect()}
    other = Engine(spark, str(tmp_path / "db2"))
    other.index(tree)
    assert incremental == {(r["name"], r["kind"], r["start_line"]) for r in other.store.table("symbols").collect()}
    engine.observe("get_user")
    assert engine.flush_observations() > 0 == engine.flush_observations()
    engine.observe("get_user")
    assert engine.flush_observations() == 0  # the first observation of a query counts
    assert engine.calibrate(min_samples=1, dry_run=True).count() >= 1 and engine.store.table("calibrations").count() == 0


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.needs_full_reindex() and store.prepare_for_reindex() and not store.needs_full_reindex()
    for value, want in (("3", False), ("999", True), ("not_a_number", True)):
        store.set_metadata("parser_version", value)
        assert store.needs_full_reindex() is want
    rows = [("rust", 0.5, 12345, 100), ("rust", 0.6, 12345, 101), ("python", 0.7, 12345, 102)]
    obs = spark.createDataFrame(rows, "language string, distance float, query_hash long, ts long")
    assert store.add_observations(obs) == 2 and store.add_observations(obs) == 0
    assert store.age_out(max_age=10, now=111) == 1
    store.save_calibrations(calibration.calibrate(spark.createDataFrame([("a", 0.5)] * 100, "language string, distance double")), now=1)
    assert store.table("calibrations").count() == 2
    store.clear_calibrations()
    store.vacuum()
    assert store.table("calibrations").count() == 0 and store.table("observations").count() == 1


def test_store_survives_a_crash(spark, tmp_path, monkeypatch):
    """A writer that dies before its pointer is published changes nothing; readers never see an empty index."""
    store = Store(spark, str(tmp_path / "s"))
    files = lambda *rows: spark.createDataFrame(list(rows), "path string, content string, size long, last_modified long, language string")
    store.replace_files(files(("a.rs", "one", 3, 1, "rust"), ("b.rs", "two", 3, 1, "rust")))
    before = sorted(map(tuple, store.table("files").collect()))

    def die(*_):
        raise OSError("gone")

    for step in ("_publish", "_replaced"):
        with monkeypatch.context() as m:
            m.setattr(Store, step, die)
            with pytest.raises(OSError):
                store.replace_files(files(("a.rs", "changed", 7, 2, "rust")))
        assert sorted(map(tuple, Store(spark, str(tmp_path / "s")).table("files").collect())) == before
    store.vacuum()
    assert sorted(map(tuple, store.table("files").collect())) == before
    store.replace_files(files(("a.rs", "changed", 7, 2, "rust")))
    assert {r["path"]: r["content"] for r in store.table("files").collect()} == {"a.rs": "changed", "b.rs": "two"}


def test_store_refuses_a_second_writer(spark, tmp_path):
    one, two = (Store(spark, str(tmp_path / "s")) for _ in range(2))
    one.set_metadata("k", "1")
    state = two._state()
    one.set_metadata("k", "2")
    with pytest.raises(ConcurrentWrite):
        two._publish(*state)
    assert two.metadata("k") == "2"


def test_store_rewrites_touched_buckets_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    kind = "path string, content string, size long, last_modified long, language string"
    store.replace_files(spark.createDataFrame([(f"f{k}.rs", "x", 1, 1, "rust") for k in range(200)], kind),
                        chunks=spark.createDataFrame([(f"f{k}.rs", "x", j, j) for k in range(200) for j in (1, 2)], "path string, content string, start_line long, end_line long"))
    before = store._state()[1]
    ids = {r["path"]: r["file_id"] for r in store.table("files").collect()}
    assert len(set(ids.values())) == 200 and store.table("chunks").select("chunk_id").distinct().count() == 400
    store.replace_files(spark.createDataFrame([("f7.rs", "new", 3, 2, "rust")], kind))
    store.set_embeddings(store.table("chunks").orderBy("chunk_id").limit(1).select("chunk_id", F.array(F.lit(1.0).cast("float")).alias("embedding")))
    after = store._state()[1]
    assert sum(before["files"][b] != after["files"][b] for b in before["files"]) == 1
    assert sum(before["chunks"][b] != after["chunks"].get(b) for b in before["chunks"]) <= 2
    now = {r["path"]: r["file_id"] for r in store.table("files").collect()}
    assert now.pop("f7.rs") != ids.pop("f7.rs") and now == ids and store.table("chunks").count() == 398
    store.delete_files(spark.createDataFrame([("f8.rs",)], "path string"))
    assert store.table("files").count() == 199 and store.table("chunks").count() == 396


def test_collector():
    c = Collector(existing=490, rate=0.5, threshold=500, buffer_rows=20)
    assert c.bootstrap and c.progress == 98 and c.record("a", [("rust", 0.1)] * 9 + [(None, 0.2)], 5) and c.bootstrap and not c.should_calibrate()
    assert c.record("b", [("go", 0.3)] * 2, 6) and not c.bootstrap and c.should_calibrate() and not c.should_calibrate()
    assert [c.should_sample() for _ in range(4)] == [True, False, True, False]
    assert not c.needs_flush() and len(c.take()) == 11 and c.take() == []
    assert c.record("c", [("go", 0.3)] * 20, 7) and c.needs_flush() and not c.should_calibrate()
    assert query_hash("a") == query_hash("a") != query_hash("b")
    assert not Collector(existing=1000, rate=0).should_sample()


def test_file_list(tree):
    now = [0.0]
    listed = FileList(tree, 30, lambda: now[0])
    first = listed.paths()
    os.remove(os.path.join(tree, "README.md"))
    now[0] = 29.9
    assert listed.paths() == first
    now[0] = 30.0
    assert "README.md" not in listed.paths()


def test_watch_reads_what_changed(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"), None)
    engine.watch(tree, str(tmp_path / "cp"), once=True).awaitTermination(120)
    assert {r["path"] for r in engine.store.table("files").collect()} == {"app/_main.py", "src/shared.rs", "src/users.rs"}
    ids = {r["path"]: r["file_id"] for r in engine.store.table("files").collect()}
    os.remove(os.path.join(tree, "app/_main.py"))
    with open(os.path.join(tree, "src/users.rs"), "a") as file:
        file.write("pub fn one_more() {}\n")
    engine.watch(tree, str(tmp_path / "cp"), once=True).awaitTermination(120)
    now = {r["path"]: r["file_id"] for r in engine.store.table("files").collect()}
    assert set(now) == {"src/shared.rs", "src/users.rs"} and now["src/shared.rs"] == ids["src/shared.rs"] and now["src/users.rs"] != ids["src/users.rs"]
    assert engine.store.symbols_named("one_more").count() == 1
    assert len(os.listdir(tmp_path / "cp/snapshots")) <= 2


def test_knn_batch_of_alike_vectors(spark):
    import tracemalloc

    rng = np.random.default_rng(3)
    few = rng.random((7, 16), np.float32)
    rows = [(i, few[i % 7].tolist()) for i in range(300)] + [(1000 + i, rng.random(16, np.float32).tolist()) for i in range(300)]
    for kind in ("float", "double"):
        chunks = spark.createDataFrame(rows, f"chunk_id long, embedding array<{kind}>").repartition(3)
        got = retrieval.knn_batch(chunks, chunks.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding"), 10, 64).collect()
        v, ids = np.array([x for _, x in rows]), np.array([i for i, _ in rows])
        want = set()
        for q in ids[ids % 20 == 0]:
            d = np.round(np.sqrt(((v - v[ids == q]) ** 2).sum(1)), 6)
            want |= {(int(q), int(ids[j]), float(d[j])) for j in np.lexsort((ids, d))[:10]}
        assert len(got) == len(want) and {(r["query_id"], r["chunk_id"], r["distance"]) for r in got} == want
    # a block of one vector: all pairs are candidates
    same = np.ones((2048, 64))
    tracemalloc.start()
    out = [(at, near, d) for at, near, d in retrieval._nearest(same, same, np.arange(2048), 10)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(at) for at, _, _ in out) == 20480 and all((near.reshape(-1, 10) == np.arange(10)).all() and (d == 0).all() for _, near, d in out)
    assert peak < 150e6


def test_knn(spark):
    rows = [(k, [i * 0.001 * k for i in range(384)]) for k in (1, 2, 3)]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    near = retrieval.knn(chunks, retrieval.vector([i * 0.0011 for i in range(384)]), 2).collect()
    assert [r["chunk_id"] for r in near] == [1, 2]


def test_fts(spark):
    symbols = spark.createDataFrame([(1, "calculate_total", None, None), (2, "total", "fn calculate the total", None), (3, "x", None, "recalculate")], "symbol_id long, name string, signature string, doc_comment string")
    assert [r["symbol_id"] for r in retrieval.fts_match(symbols, "calculate").collect()] == [1, 2]
    assert [r["symbol_id"] for r in retrieval.fts_match(symbols, "calculate tot").collect()] == [1]
    assert retrieval.fts_match(symbols, '"*(').count() == 0


def test_providers():
    assert not Stub().embed(["a"]).any()
    v = HashedTokens().embed(["a b", "a b", ""])
    assert np.allclose(v[0], v[1]) and np.isclose(np.linalg.norm(v[0]), 1) and not v[2].any()


def test_change_stream(spark, tree, tmp_path):
    seen: list = []
    checkpoint = str(tmp_path / "cp")

    def on_batch(df, n):
        seen.extend((r["path"], r["event"]) for r in df.collect())

    changes.watch(spark, tree, on_batch, checkpoint, once=True).awaitTermination(60)
    assert ("src/users.rs", "created") in seen
    seen.clear()
    os.remove(os.path.join(tree, "README.md"))
    time.sleep(0.01)
    with open(os.path.join(tree, "src/users.rs"), "a") as file:
        file.write("// more\n")
    changes.watch(spark, tree, on_batch, checkpoint, once=True).awaitTermination(60)
    assert sorted(seen) == [("README.md", "deleted"), ("src/users.rs", "modified")]


def test_observation_streams(spark, tmp_path):
    rows = [("a", 1, "2024-01-01 00:00:00"), ("a", 1, "2024-01-01 00:00:05"), ("b", 1, "2024-01-01 00:00:06"), ("a", 2, "2024-01-01 00:00:07")]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "language string, query_hash long, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(path)
    stream = lambda: spark.readStream.schema("language string, query_hash long, ts timestamp").parquet(path)
    q = changes.first_observations_stream(stream()).writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("firsts").count() == 3
    q = changes.counted_observations_stream(stream(), 3).writeStream.format("memory").queryName("counts").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["language"], r["total"], r["calibrate"]) for r in spark.table("counts").collect()} == {("a", 3, True), ("b", 1, False)}


def test_command_line(spark, tree, tmp_path, capsys):
    from siftwell import __main__ as cli

    db = str(tmp_path / "db")
    say = lambda *a: (cli.main(list(a)), capsys.readouterr())
    code, out = say("index", tree, "-d", db)
    assert code == 0 and "added 3" in out.out
    assert "files: 3" in say("stats", "-d", db)[1].out
    assert "get_user (function)" in say("search", "get_user", "-d", db, "--file-type", "rs")[1].out
    assert "Definitions:\n  src/users.rs:5" in say("refs", "get_user", "-d", db)[1].out
    assert "std::collections::HashMap as HashMap [std]" in say("deps", "src/users.rs", "-d", db)[1].out
    assert "function at src/users.rs:5-7" in say("explain", "get_user", "-d", db)[1].out and "not in the index" in say("explain", "nothing", "-d", db)[1].out
    assert "not calibrated" in say("calibrate", "-d", db, "--dry-run")[1].out
    assert say("deps", "../x", "-d", db)[0] == 2


def test_texts_are_exchanged_once(spark, tmp_path):
    kind = "path string, content string, size long, last_modified long, language string"
    old = spark.createDataFrame([(1, "a", "rust", "h1", 1, 1, 1, "one"), (2, "b", "rust", "h2", 1, 1, 1, "two")], "file_id long, path string, language string, hash string, size long, last_modified long, indexed_at long, content string")
    new = spark.createDataFrame([("b", "new", 3, 2, "rust"), ("c", "x", 1, 2, "rust"), ("c", "y", 1, 2, "rust")], kind).withColumn("hash", F.sha2("content", 256)).withColumn("indexed_at", F.lit(2))
    ids = spark.createDataFrame([("b", 66), ("c", 67)], "path string, file_id long")
    store = Store(spark, str(tmp_path / "s"))
    got = store._merged(old, ids, new)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    rows = {r["path"]: (r["file_id"], r["content"]) for r in got.collect()}
    assert got.count() == 3 and rows["a"] == (1, "one") and rows["b"] == (66, "new") and rows["c"][0] == 67
    assert [r["path"] for r in store._merged(old, ids.select("path")).collect()] == ["a"]
