"""SimHash near-dedup: fingerprints linked through a covering family of bit masks.

A text's fingerprint has bit i set if over half of its 3-word shingles' XXH64 (seed 42) have it.
Fingerprints link at ``RADIUS`` or fewer differing bits.  Each bit gets a non-zero vector of RADIUS + 1
bits, and mask v keeps the bits whose vector has an odd product with v: up to RADIUS positions span
less than the whole space, so some v is orthogonal to all of them and its mask hides every difference.
Every pair within the radius thus agrees in at least one of the 2^(RADIUS+1) - 1 tables.

Work is done on distinct fingerprints, so copies never meet as pairs.  A bucket gives a forest that
connects what is linked in it, never all pairs.  A bucket over ``MOST`` fingerprints is split by the values of four
blocks of its hidden bits (a pair that differs in three positions agrees on one of four blocks), and
split again until all are small: exact, and no task holds an unbounded group.

Null or empty text, or text without words: fingerprint zero, linked like any other.  Fewer than three
words: the whole sequence is one shingle.  Rows without a doc_id take part; a class without any id
has a null component.  Repeated rows share fingerprint and component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOWER_BYTES, freeing, fresh, id_key, real_id, stash, unstash
from .components import connected_components

RADIUS = 3
BITS = 64
MOST = 4096


def fingerprint(text: bytes) -> int:
    words = text.translate(LOWER_BYTES).split()  # bytes.split() cuts at \x20 and \x09-\x0D, no more
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    if n <= 3:
        hashes = np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    else:
        ends, end = [], -1
        for w in words:
            end += len(w) + 1
            ends.append(end)
        digest = xxhash.xxh64_intdigest
        starts = [0] + [e + 1 for e in ends[:-3]]
        hashes = np.array([digest(line[a:b], 42) for a, b in zip(starts, ends[2:], strict=True)], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    counts = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[lo : lo + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    set_bits = np.flatnonzero(2 * counts > len(hashes))
    return sum(1 << int(b) for b in set_bits)


def masks() -> np.ndarray:
    """Mask v - 1 keeps bit i if the vector of i, 1 + i mod 15, has an odd product with v."""
    many = 2 ** (RADIUS + 1) - 1
    return np.array([sum(1 << i for i in range(BITS) if ((1 + i % many) & v).bit_count() % 2) for v in range(1, many + 1)], np.uint64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """(id, fp, hash) of each row; fp is the fingerprint's bits as a long, hash one of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_signed(fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), batch.column(2)], names=["id", "fp", "hash"])

    return docs.select(id_key().alias("id"), "text", F.xxhash64("text").alias("hash")).mapInArrow(freeing(run), "id long, fp long, hash long")


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what is linked among distinct fingerprints: a breadth-first search, each node
    meeting only those not reached yet."""
    left, edges = fps, []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= RADIUS
            if near.any():
                found = left[near]
                left = left[~near]
                edges += [(int(x), int(y)) for y in found]
                queue += list(found)
    return edges


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mask, key, fp) in order; buckets may span batches."""
    held: list[np.ndarray] = []

    def out(parts: list[np.ndarray], last: bool) -> tuple[pa.RecordBatch | None, list[np.ndarray]]:
        rows = np.concatenate(parts)
        new = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
        cuts = np.concatenate([[0], new, [len(rows)]])
        if not last:
            cuts = cuts[:-1]
        sizes = np.diff(cuts)
        edges: list[tuple[int, int]] = []
        pairs = cuts[:-1][sizes == 2]
        a, b = rows[pairs, 2], rows[pairs + 1, 2]
        near = np.bitwise_count((a ^ b).view(np.uint64)) <= RADIUS
        edges += list(zip(a[near].tolist(), b[near].tolist(), strict=True))
        for k in np.flatnonzero(sizes > 2):
            fps = np.ascontiguousarray(rows[cuts[k] : cuts[k + 1], 2]).view(np.uint64)
            edges += [(_signed(x), _signed(y)) for x, y in forest(fps)]
        batch = pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["a", "b"]) if edges else None
        return batch, [rows[cuts[-1] :]]

    for batch in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1))
        if sum(map(len, held)) > MOST + 8192:
            made, held = out(held, False)
            if made:
                yield made
    if held:
        made, _ = out(held, True)
        if made:
            yield made


def split(mask: int) -> list[int]:
    """Four masks, each keeping a quarter more of the bits that ``mask`` hides."""
    hidden = [i for i in range(BITS) if not mask >> i & 1]
    return [mask | sum(1 << i for i in hidden[j::4]) for j in range(RADIUS + 1)]


def links(distinct: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b): a forest over the linked fingerprints in the column ``fp`` (distinct values)."""
    spark = distinct.sparkSession
    level = [int(m) for m in masks()]
    tables = F.explode(F.array(*[F.lit(_signed(m)) for m in level]))
    rows = distinct.select(tables.alias("mask"), "fp").select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    edges = []
    while True:
        # a bucket has at most 2 ** hidden fingerprints, so after four splits none is over ``MOST``
        hot = stash(rows.groupBy("mask", "key").count().filter(F.col("count") > most).select("mask", "key"), "hot")
        if hot.isEmpty() or min(m.bit_count() for m in level) >= BITS - 3:
            break
        large = stash(rows.join(hot, ["mask", "key"], "left_semi"), "large")
        edges.append(_edges(rows.join(hot, ["mask", "key"], "left_anti")))
        # 4 rows for each mask of this level: 15 * 4 ** level, whatever the input
        finer = F.broadcast(spark.createDataFrame([(_signed(m), _signed(x)) for m in level for x in split(m)], "mask long, finer long"))
        level = sorted({x for m in level for x in split(m)})
        rows = large.join(finer, "mask").select(F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("key"), "fp")
    edges.append(_edges(rows))
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out


def _edges(rows: DataFrame) -> DataFrame:
    dealt = rows.select("mask", "key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
    return dealt.mapInArrow(freeing(_bucket_edges), "a long, b long")


def classes(docs: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """The table (id, fp, hash) of rows, and the table (fp, root, component) of fingerprints; root names a class."""
    rows = stash(fingerprints(docs), "fingerprints")
    distinct = stash(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    pairs = links(distinct.select("fp"), most)
    # fingerprints are nodes; a component's id is the least of its members' first ids
    nodes = connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnsRenamed({"id": "fp", "component": "root"})
    known = stash(distinct.join(nodes, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "nodes")
    least = stash(known.groupBy("root").agg(F.min("first").alias("component")), "least")
    labels = stash(known.join(least, "root").select("fp", "root", "component"), "components")
    unstash(distinct), unstash(known), unstash(least)
    return rows, labels


def simhash_components(docs: DataFrame, most: int = MOST) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of ``docs``."""
    rows, labels = classes(docs, most)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(labels, "fp").select(real_id(F.col("id")).alias("doc_id"), hexed.alias("fingerprint"), real_id(F.col("component")).alias("component_id"))


def keep_first(docs: DataFrame, most: int = MOST) -> DataFrame:
    """``docs`` with one row of each component: one with the smallest doc_id (ties: the smallest hash of the text).

    Of rows that share both the one whose other columns have the smallest hash stays; they are pre-aggregated, so copies
    without a doc_id do not gather in one task.
    """
    rows, labels = classes(docs, most)
    k, h, n = fresh(docs, "simhash_id", "simhash_hash", "simhash_row")
    heads = rows.join(labels, "fp").groupBy("root").agg(F.min(F.struct("id", "hash")).alias("f"))
    heads = stash(heads.select(F.col("f.id").alias(k), F.col("f.hash").alias(h)).distinct(), "heads")
    kept = docs.withColumns({k: id_key(), h: F.xxhash64("text")}).join(heads, [k, h], "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    tie = F.xxhash64(F.to_json(F.struct(*[c for c, name in zip(columns, docs.columns, strict=True) if name != "text"])))
    first = kept.groupBy(k, h).agg(F.min_by(F.struct(*columns), F.struct(tie, "text")).alias(n))
    return first.select(*[F.col(n)[c].alias(c) for c in docs.columns])
