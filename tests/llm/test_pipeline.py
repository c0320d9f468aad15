import os
from collections import Counter

import sentencepiece

import corpus_pipeline
from siftwell.llm import piece_codec, quality_rules

from . import brute


def plain(spark, rows, labels, items, docs):
    """The five stages in plain Python over (doc_id, text, lang, source, n_chars) rows."""
    field = quality_rules.train(docs, labels)  # the fit is tested elsewhere; here its decisions are followed
    verdict = {r["text"]: r["kept"] for r in quality_rules.assess(docs.select("doc_id", "text"), field).collect()}
    rows = [r for r in rows if verdict[r[1]]]
    cleaned = brute.line_dedup([(r[0], r[1]) for r in rows])
    rows = [(i, (t if not d else new), lang, src, len(new) if d else n) for (i, t, lang, src, n), (_, d, new) in zip(rows, cleaned, strict=True)]
    found = brute.simhash([(r[0], r[1]) for r in rows])
    kept, seen = [], set()
    for r, (i, _, c) in zip(rows, found, strict=True):
        if i == c and i not in seen:
            seen.add(i)
            kept.append(r)
    hits = brute.decontaminate([r[1] for r in kept], items)
    return [r for r, (_, _, ids) in zip(kept, hits, strict=True) if not ids]


def test_pipeline_agrees_with_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    want = plain(spark, [tuple(r) for r in docs.collect()], labels, [tuple(r) for r in items.collect()], docs)
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.DEFAULT_MODEL)
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)
    assert all(r["round_trip"] and r["piece_ids"] == sp.encode(r["text"]) for r in got)


def test_stages_take_odd_tables(spark, odd, odd_rows, empty, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(6, 1, 0), (9, 1, 0), (13, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "a few words"), (None, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, odd, sf)
        assert out.columns[: len(odd.columns)] == odd.columns and out.count() <= len(odd_rows)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == odd.columns
        assert stage(spark, empty, sf).count() == 0


def test_five_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece"]


def test_entry_without_the_folders(tmp_path):
    """Without the subpackage and the pipeline the entry still imports and keeps its other queries."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(os.path.join(root, "siftwell"), tmp_path / "siftwell", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_search' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
