"""Benchmark decontamination: a prefix-filtered join of item windows against documents.

A window is ``size`` consecutive words of an item (an item of fewer words, but not none, is one
window).  A window's tokens are its shingles of up to ``GRAM`` words; an exact occurrence has them
all, so its rarest one is a sufficient prefix.  Rarity is counted over all documents.  Documents are
then probed for prefix shingles only, and a candidate is checked by position, by length and at last
word by word against the window.

Windows of one or two words are their own shingle, so a text sends one suspect for each of them with the list of its
places, however often the word stands there.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text after A-Z are lower-cased.  Null and
empty texts have no words; long ones are taken whole.  Items that repeat an item_id count once; the words of an item
without one are hit, but it is not counted.  Rows without a doc_id and rows that share one are judged row by row, each
by its own text (``drop_contaminated`` compares 128 bits of XXH64 of texts, so equal texts share their verdict).
Empty tables give no hits.  Extra columns pass through or are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ALNUM, LOWER, Bloom, as_long, bloom_of, freeing, fresh, gram_hashes, span_hashes, stash, text_blocks, word_spans

SIZE = 8
GRAM = 3


def _words(buf: np.ndarray, offs: np.ndarray):
    low = LOWER[buf]
    starts, ends, rows = word_spans(ALNUM[low], offs)
    return low, starts, ends, rows, span_hashes(low, starts, ends)


def windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """(window, n, item_id, grams): each item's distinct windows; ``grams`` in order of position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for lo, hi, buf, offs in text_blocks(batch.column(1)):
                low, starts, ends, rows, hashes = _words(buf, offs)
                raw = low.tobytes()
                cuts = np.searchsorted(rows, np.arange(hi - lo + 1))
                for r in range(hi - lo):
                    a, b = int(cuts[r]), int(cuts[r + 1])
                    if a == b:
                        continue
                    n = min(size, b - a)
                    g = min(GRAM, n)
                    grams, _ = gram_hashes(hashes[a:b], np.zeros(b - a, np.int64), g)
                    grams = as_long(grams).tolist()
                    for s in range(b - a - n + 1):
                        out[0].append(b" ".join(raw[starts[i] : ends[i]] for i in range(a + s, a + s + n)).decode())
                        out[1].append(n)
                        out[2].append(batch.column(0)[lo + r].as_py())
                        out[3].append(grams[s : s + n - g + 1])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string()), pa.array(out[3], pa.list_(pa.int64()))], names=["window", "n", "item_id", "grams"])

    slim = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return slim.mapInArrow(freeing(run), "window string, n int, item_id string, grams array<long>")


def prefixes(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """(gram, off, n, window): each distinct window with its rarest shingle over all ``docs``."""
    spark = docs.sparkSession
    each = wins.select("window", "n", "grams").distinct()
    listed = each.select("window", "n", F.posexplode("grams").alias("off", "gram"))
    grams = stash(listed.select("gram", F.least("n", F.lit(GRAM)).alias("g")).distinct(), "grams")
    lengths = sorted(r["g"] for r in grams.select("g").distinct().collect())  # 1 to GRAM: at most three rows
    known = spark.sparkContext.broadcast(bloom_of(grams, "gram").words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, total = Bloom(known.value), Counter()
        for batch in batches:
            for _, _, buf, offs in text_blocks(batch.column(0)):
                _, _, _, rows, hashes = _words(buf, offs)
                for g in lengths:
                    h, _ = gram_hashes(hashes, rows, g)
                    values, n = np.unique(h[bloom.has(h)], return_counts=True)
                    for v, k in zip(as_long(values).tolist(), n.tolist(), strict=True):
                        total[v] += k
                if len(total) > 1 << 18:
                    yield _counted(total)
                    total = Counter()
        if total:
            yield _counted(total)

    seen = docs.select("text").mapInArrow(freeing(count), "gram long, k long").groupBy("gram").agg(F.sum("k").alias("k"))
    ranked = listed.join(stash(seen, "rarity"), "gram", "left").groupBy("window", "n").agg(
        F.min(F.struct(F.coalesce("k", F.lit(0)).alias("k"), "off", "gram")).alias("p"))
    return ranked.select(F.col("p.gram").alias("gram"), F.col("p.off").alias("off"), "n", "window")


def _counted(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["gram", "k"])


def probe(docs: DataFrame, prefix: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, h1, h2, n_words, suspects) of each row: places of prefix shingles with the words around them."""
    shapes = prefix.select(F.least("n", F.lit(GRAM)).alias("g")).distinct()
    lengths = sorted(r["g"] for r in shapes.collect())  # at most three rows
    known = docs.sparkSession.sparkContext.broadcast(bloom_of(prefix.select("gram").distinct(), "gram").words)
    suspect = pa.list_(pa.struct([("gram", pa.int64()), ("places", pa.list_(pa.int64())), ("lead", pa.int32()), ("words", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = Bloom(known.value)
        for batch in batches:
            for lo, hi, buf, offs in text_blocks(batch.column(3)):
                low, starts, ends, rows, hashes = _words(buf, offs)
                cuts = np.searchsorted(rows, np.arange(hi - lo + 1))
                found: list[dict] = [{} for _ in range(hi - lo)]
                for g in lengths:
                    h, at = gram_hashes(hashes, rows, g)
                    hit = bloom.has(h)
                    for v, i in zip(as_long(h[hit]).tolist(), at[hit].tolist(), strict=True):
                        r = int(rows[i])
                        # a window has GRAM words or more, or is this shingle
                        a, b = (max(int(cuts[r]), i - size + 1), min(int(cuts[r + 1]), i + size)) if g == GRAM else (i, i + g)
                        around = tuple(low[starts[j] : ends[j]].tobytes().decode("utf-8", "replace") for j in range(a, b))
                        found[r].setdefault((v, i - a, around), []).append(i - int(cuts[r]))
                listed = [[{"gram": v, "places": at, "lead": lead, "words": words} for (v, lead, words), at in f.items()] for f in found]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in range(3)), pa.array(np.diff(cuts)), pa.array(listed, suspect)], names=["doc_id", "h1", "h2", "n_words", "suspects"])

    kind = "doc_id long, h1 long, h2 long, n_words long, suspects array<struct<gram:long,places:array<long>,lead:int,words:array<string>>>"
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    return slim.mapInArrow(freeing(run), kind)


def _judged(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """(doc_id, h1, h2, n_words, n_hit, n_items, items) of each row."""
    wins = stash(windows(items, size), "windows")
    prefix = stash(prefixes(docs, wins), "prefixes")
    probed = stash(probe(docs, prefix, size).withColumn("row", F.monotonically_increasing_id()), "probed")
    places = probed.select("row", F.explode("suspects").alias("s")).select("row", "s.*")
    first = F.col("lead") - F.col("off")
    starts = F.transform("places", lambda p: F.struct((p - F.col("off")).alias("start"), F.col("n").alias("n")))
    hits = places.join(prefix, "gram").filter(
        (first >= 0) & (first + F.col("n") <= F.size("words"))  # position and length
        & (F.concat_ws(" ", F.slice("words", F.when(first >= 0, first).otherwise(0) + 1, F.col("n"))) == F.col("window"))
    ).select("row", "window", starts.alias("spans"))
    hits = stash(hits, "hits")
    spans = hits.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    owners = wins.select("window", "item_id").filter("item_id is not null").distinct()
    named = hits.select("row", "window").distinct().join(owners, "window").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    # spans in order; each adds the words behind the end reached so far
    covered = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("sum")),
                          lambda acc, x: F.struct(F.greatest(acc["end"], x["start"] + x["n"]).alias("end"),
                                                  (acc["sum"] + F.greatest(F.lit(0), x["start"] + x["n"] - F.greatest(acc["end"], x["start"]))).alias("sum")),
                          lambda acc: acc["sum"])
    out = probed.drop("suspects").join(spans.select("row", covered.alias("n_hit")), "row", "left").join(named, "row", "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "h1", "h2", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"))


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items) of each row; items are sorted item_ids as strings."""
    return _judged(docs, items, size).drop("h1", "h2")


def drop_contaminated(docs: DataFrame, items: DataFrame, min_items: int = 1, size: int = SIZE) -> DataFrame:
    """``docs`` without rows whose text holds windows of ``min_items`` or more items."""
    h1, h2 = fresh(docs, "decontaminate_h1", "decontaminate_h2")
    bad = _judged(docs, items, size).filter(F.col("n_items") >= min_items).select(F.col("h1").alias(h1), F.col("h2").alias(h2)).distinct()
    named = docs.withColumns({h1: F.xxhash64("text"), h2: F.xxhash64(F.lit(1), "text")})
    return named.join(stash(bad, "contaminated"), [h1, h2], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
