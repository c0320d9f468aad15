"""Suffix-array dedup: every byte covered by a ``span``-byte string that also starts elsewhere goes.

Not all suffixes are sorted, only those that can matter.  Each window of ``span`` bytes has an anchor: the
leftmost smallest hash among its ``GRAM``-byte strings, so equal windows have equal anchors at the
same offset.  Anchors whose string comes once are dropped; those left are the suffixes to sort:

1. each task sorts the suffixes at its anchors and writes them as runs, one for each target
   partition, front-coded (shared prefix length, rest);
2. a partition merges its runs with a loser tree that keeps, for each loser, the prefix it shares with
   the winner, so known prefixes are never compared again; the merged order comes with its common prefixes;
3. for each offset of a window before its anchor, suffixes that share the right part (common prefixes in
   the merged order) and the left part (the same over reversed left contexts) hold equal windows.

All comparisons are of bytes; hashes only choose what to compare.  Equal contexts are merged to one
record in each task before they are sent.  Anchors that more than ``hot`` texts share are not gathered but exploded to digests of their windows
(128 bits), which are counted with pre-aggregation.

Null text: no bytes, nothing removed.  Texts under ``span`` bytes lose nothing.  Equal texts (repeated
rows included) of at least ``span`` bytes lose everything.  Ids only pass through; extra columns too.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Bloom, _powers, as_long, bloom_of, freeing, fresh, mix, power_of_two, prefix_sums, stash, text_blocks, unstash
from .line_dedup import joined_batches

SPAN, GRAM = 200, 80
#: Bound of a filter that is broadcast: 2^22 words, 32 MB.  More strings than it is good for are taken in several rounds.
MOST_WORDS = 1 << 22
RUN_BYTES = 8 << 20
_HEAD = struct.Struct("<HHHHHqqqq")  # shared, rest, left, first and last offset; smallest and largest place; record id


def anchors(buf: np.ndarray, offs: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, first window, last window, row, hash of the anchor's string) of a block of texts."""
    none = np.zeros(0, np.int64)
    n, width = len(buf), span - gram + 1
    if n < span:
        return none, none, none, none, none.view(np.uint64)
    p = prefix_sums(buf)
    _, inv = _powers(n + 1)
    h = mix((p[gram:] - p[:-gram]) * inv[: n - gram + 1])
    place = np.uint64((1 << 28) - 1)
    key = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    # sliding minimum: prefix minima and suffix minima of blocks as wide as the window
    pad = -len(key) % width
    grid = np.concatenate([key, np.full(pad, np.uint64(2**64 - 1))]).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - span + 1
    low = (np.minimum(behind[:m], ahead[width - 1 : width - 1 + m]) & place).astype(np.int64)
    sizes = np.diff(offs)
    room = np.repeat(offs[1:], sizes)[:m] - np.arange(m) >= span
    at = np.flatnonzero(room)
    if not len(at):
        return none, none, none, none, none.view(np.uint64)
    own = low[at]
    new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)))
    first, last, where = at[new], at[np.append(new[1:], len(at)) - 1], own[new]
    return where, first, last, np.searchsorted(offs, where, "right") - 1, h[where]


def texts_of(docs: DataFrame) -> DataFrame:
    """(h1, h2, text): two 64-bit hashes name a text."""
    return docs.filter(F.col("text").isNotNull()).select(F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")


def repeated_strings(texts: DataFrame, span: int, gram: int) -> DataFrame:
    """(k, texts): anchor strings (by hash) that stand in two texts, or twice in one; texts counts rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, buf, offs in text_blocks(batch.column(1)):
                _, _, _, rows, h = anchors(buf, offs, span, gram)
                order = np.lexsort((rows, h))
                h, rows = h[order], rows[order]
                new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (rows[1:] != rows[:-1]))) if len(h) else np.zeros(0, np.int64)
                twice = np.diff(np.append(new, len(h))) > 1
                yield pa.RecordBatch.from_arrays([pa.array(as_long(h[new])), pa.array(names[lo:hi][rows[new]], pa.int64()), pa.array(twice)], names=["k", "h1", "twice"])

    found = texts.select("h1", "text").mapInArrow(freeing(run), "k long, h1 long, twice boolean")
    held = found.groupBy("k").agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.bool_or("twice").alias("twice"), F.count("*").alias("texts"))
    return held.filter("a <> b or twice").select("k", "texts")


def front_code(records: list[tuple]) -> bytes:
    """Sorted records (right, left, first, last, low, high, id) as one run."""
    out, before = [], b""
    for right, left, first, last, low, high, (x1, x2) in records:
        shared = common(before, right, 0)
        out += [_HEAD.pack(shared, len(right) - shared, len(left), first, last, low, high, x1, x2), right[shared:], left]
        before = right
    return b"".join(out)


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are not looked at."""
    most = min(len(a), len(b))
    if a[known:most] == b[known:most]:
        return most
    lo, hi = known, most  # equal up to lo, not up to hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def unfold(run: bytes) -> Iterator[tuple[int, bytes, tuple]]:
    """(prefix shared with the record before, right context, rest of the record)."""
    at, right = 0, b""
    while at < len(run):
        shared, rest, n_left, first, last, low, high, x1, x2 = _HEAD.unpack_from(run, at)
        at += _HEAD.size
        right = right[:shared] + run[at : at + rest]
        at += rest
        yield shared, right, (run[at : at + n_left], first, last, low, high, (x1, x2))
        at += n_left


def merge_runs(runs: list[bytes]) -> Iterator[tuple[int, bytes, tuple]]:
    """The records of all runs in order, each with the prefix it shares with the one before.

    A tournament tree of losers.  ``shared[r]`` is what the head of run r shares with the last record that went
    out; of two heads the one that shares more is smaller, and only heads that share equally much are
    compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    sources = [unfold(r) for r in runs] + [iter(())] * (k - len(runs))
    heads: list[tuple | None] = [None] * k
    shared = [0] * k

    def pull(r: int) -> None:
        x = next(sources[r], None)
        heads[r] = None if x is None else x[1:]
        shared[r] = -1 if x is None else x[0]  # of its run's last record, which is the one that went out

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser keeps what it shares with the winner."""
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        if heads[a] is None:
            return a, b
        x, y = heads[a][0], heads[b][0]
        n = common(x, y, shared[a])
        if x[n : n + 1] <= y[n : n + 1]:
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    for r in range(k):
        pull(r)
        shared[r] = min(shared[r], 0)
    losers = [0] * k
    level = list(range(k))
    size = k
    while size > 1:
        size //= 2
        for i in range(size):
            level[i], losers[size + i] = play(level[2 * i], level[2 * i + 1])
    best = level[0]
    while heads[best] is not None:
        yield shared[best], *heads[best]
        pull(best)
        node = (k + best) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2


def shared_with_previous(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For sorted rows of padded bytes: the common prefix with the row before."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differs = rows[1:] != rows[:-1]
        first = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
        out[1:] = np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))
    return out


def equal_windows(runs: list[bytes], span: int, gram: int) -> tuple[list[tuple], list[tuple]]:
    """(record ids, and for each the (id, smallest offset, largest offset) of repeated windows)."""
    right_lcp, lefts, first, last, low, high, ids = [], [], [], [], [], [], []
    block: dict[tuple, int] = {}  # records with the right context that the merge is at
    size, lowest = -1, 1 << 30
    for shared, right, (left, f, e, a, b, x) in merge_runs(runs):
        if shared < max(size, len(right)):
            block, size = {}, len(right)
        lowest = min(lowest, shared)
        if (at := block.get(x)) is not None:  # one context, sent by several tasks
            low[at], high[at] = min(low[at], a), max(high[at], b)
            continue
        block[x] = len(ids)
        right_lcp.append(lowest), lefts.append(left[::-1]), first.append(f), last.append(e), low.append(a), high.append(b), ids.append(x)
        lowest = 1 << 30
    n = len(ids)
    if not n:
        return [], []
    first, last, many = np.array(first), np.array(last), np.array(low) != np.array(high)
    depth = span - gram
    sizes = np.array([len(x) for x in lefts])
    grid = np.frombuffer(b"".join(x.ljust(depth, b"\0") for x in lefts), np.uint8).reshape(n, -1) if depth else np.zeros((n, 0), np.uint8)
    order = np.array(sorted(range(n), key=lefts.__getitem__))
    left_lcp = shared_with_previous(grid[order], sizes[order])
    right_lcp = np.array(right_lcp)
    repeated = np.zeros((n, depth + 1), bool)
    left_class = np.empty(n, np.int64)
    for o in range(depth + 1):
        at = np.flatnonzero((first <= o) & (o <= last))
        if not len(at):
            continue
        right_class = np.cumsum(right_lcp < span - o)
        left_class[order] = np.cumsum(left_lcp < o) if o else 0
        key = right_class[at] * (n + 1) + left_class[at]
        by = np.argsort(key, kind="stable")
        new = np.append(True, key[by][1:] != key[by][:-1])
        group = np.cumsum(new) - 1
        weight = np.bincount(group, weights=1.0 + many[at][by])
        repeated[at[by], o] = weight[group] > 1
    flags = np.zeros((n, depth + 3), np.int8)
    flags[:, 1:-1] = repeated
    rows, a = np.nonzero(np.diff(flags, axis=1) == 1)
    _, b = np.nonzero(np.diff(flags, axis=1) == -1)
    return ids, [(*ids[r], int(i), int(j) - 1) for r, i, j in zip(rows, a, b, strict=True)]


def _emit(texts: DataFrame, wanted: Bloom, hot: Bloom | None, parts: int, span: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Runs (part, run) and places (x1, x2, h1, h2, at) of the wanted anchors' contexts.

    Anchors in ``hot`` give their windows' digests as records of their own, without a run.
    """
    spark = texts.sparkSession
    known = spark.sparkContext.broadcast(wanted.words)
    often = spark.sparkContext.broadcast(hot.words if hot else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, skip = Bloom(known.value), Bloom(often.value) if often.value is not None else None
        held: dict[bytes, list] = {}
        places: list[list] = [[], [], [], [], []]
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            by: dict[int, list] = {}
            for part, right, left, f, e, a, b, x in held.values():
                by.setdefault(part, []).append((right, left, f, e, a, b, x))
            runs = [(part, front_code(sorted(rs, key=lambda r: (r[0], r[6], r[2], r[3])))) for part, rs in by.items()]
            n, m = len(places[0]), len(runs)
            cols = [pa.array([None] * n + [p for p, _ in runs], pa.int32()), pa.array([None] * n + [r for _, r in runs], pa.binary())]
            cols += [pa.array(c + [None] * m, pa.int64()) for c in places]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "run", "x1", "x2", "h1", "h2", "at"])
            held.clear()
            for c in places:
                c.clear()

        for batch in batches:
            h1, h2 = (batch.column(i).to_pylist() for i in (0, 1))
            for lo, _, buf, offs in text_blocks(batch.column(2)):
                where, first, last, rows, h = anchors(buf, offs, span, gram)
                hit = bloom.has(h)
                if not hit.any():
                    continue
                raw = buf.tobytes()
                heavy = skip.has(h) if skip else np.zeros(len(h), bool)
                for i in np.flatnonzero(hit).tolist():
                    a, f, e, r = int(where[i]), int(first[i]), int(last[i]), int(rows[i])
                    doc = (h1[lo + r], h2[lo + r])
                    begin = int(offs[r])
                    if heavy[i]:
                        for p in range(f, e + 1):
                            x = struct.unpack("<qq", xxhash.xxh3_128_digest(raw[p : p + span]))
                            for c, v in zip(places, (*x, *doc, -1 - (p - begin)), strict=True):
                                c.append(v)
                        size += 40 * (e - f + 1)
                        continue
                    context = raw[f : e + span]
                    x = struct.unpack("<qq", xxhash.xxh3_128_digest(struct.pack("<HH", a - f, e - f) + context))
                    place = struct.unpack("<q", xxhash.xxh3_64_digest(struct.pack("<qqq", *doc, a - begin)))[0]
                    for c, v in zip(places, (*x, *doc, a - begin), strict=True):
                        c.append(v)
                    size += 40
                    key = x
                    if key in held:
                        rec = held[key]
                        rec[5], rec[6] = min(rec[5], place), max(rec[6], place)
                    else:
                        held[key] = [int(h[i] >> np.uint64(8)) % parts, raw[a : e + span], raw[f:a], a - e, a - f, place, place, x]
                        size += 100 + len(context)
                if size > RUN_BYTES * 4:
                    yield from flush()
                    size = 0
        if held or places[0]:
            yield from flush()

    out = stash(texts.mapInArrow(freeing(run), "part int, run binary, x1 long, x2 long, h1 long, h2 long, at long"), "contexts")
    return out.filter("run is not null").select("part", "run"), out.filter("run is null").select("x1", "x2", "h1", "h2", "at").distinct()


def repeated_spans(docs: DataFrame, span: int = SPAN, gram: int = GRAM, hot: int = 1 << 20) -> DataFrame:
    """(h1, h2, spans): byte ranges [start, end) of repeated windows, for each text with any.

    Texts that several rows hold have one range over all their bytes.
    """
    texts = texts_of(docs)
    strings = stash(repeated_strings(texts, span, gram), "strings")
    n = strings.count()
    rounds = max(1, -(-n * 8 // (MOST_WORDS * 64)))  # 16 bits a string, 8 at least
    heavy = strings.filter(F.col("texts") > hot)
    hot_bloom = None if heavy.isEmpty() else bloom_of(heavy, "k")
    pieces, stored = [], [strings]
    for j in range(rounds):
        own = strings.filter(F.pmod(F.col("k"), F.lit(rounds)) == j)
        parts = int(max(8, min(100_000, n // rounds // 8_000)))
        words = power_of_two(n / rounds / 4, 1 << 10, MOST_WORDS)
        runs, places = _emit(texts, bloom_of(own, "k", words), hot_bloom, parts, span, gram)

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, []

            def windows() -> Iterator[pa.RecordBatch]:
                _, found = equal_windows(held, span, gram)
                held.clear()
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["x1", "x2", "lo", "hi"])

            for batch in joined_batches(batches):
                for part, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if part != at:  # parts come in order, so one part's runs are held at a time
                        yield from windows()
                        at = part
                    held.append(run)
            yield from windows()

        sorted_runs = runs.repartition(parts, "part").sortWithinPartitions("part")
        found = stash(sorted_runs.mapInArrow(freeing(merge), "x1 long, x2 long, lo long, hi long"), "windows")
        stored += [found, runs]
        near = places.filter("at >= 0").join(found, ["x1", "x2"]).select("h1", "h2", (F.col("at") - F.col("hi")).alias("start"), (F.col("at") - F.col("lo") + span).alias("end"))
        pieces.append(near)
        if hot_bloom is not None:
            digests = places.filter("at < 0")
            twice = stash(digests.groupBy("x1", "x2").agg(F.min(F.struct("h1", "h2", "at")).alias("a"), F.max(F.struct("h1", "h2", "at")).alias("b")).filter("a <> b").select("x1", "x2"), "twice")
            pieces.append(digests.join(twice, ["x1", "x2"]).select("h1", "h2", (-1 - F.col("at")).alias("start"), (-1 - F.col("at") + span).alias("end")))
    names = docs.filter(F.col("text").isNotNull()).select(F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.octet_length("text").cast("long").alias("n"))
    copies = names.filter(F.col("n") >= span).groupBy("h1", "h2").agg(F.count("*").alias("c"), F.max("n").alias("n")).filter("c > 1")
    spans = copies.select("h1", "h2", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"))
    for p in pieces:
        spans = spans.unionByName(p)
    # as many ranges as a text has anchors at most
    out = stash(spans.groupBy("h1", "h2").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")), "spans")
    for df in stored:
        unstash(df)
    return out


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, hot: int = 1 << 20) -> DataFrame:
    """``docs`` followed by n_bytes, n_removed, removed (maximal runs of removed bytes) and kept (binary; null for null text).

    ``text`` stays as it was; ``kept`` may cut a character in two, so it is bytes.
    """
    h1, h2, spans = fresh(docs, "text_h1", "text_h2", "text_spans")
    found = repeated_spans(docs, span, gram, hot).withColumnsRenamed({"h1": h1, "h2": h2, "spans": spans})
    named = docs.withColumn(h1, F.xxhash64("text")).withColumn(h2, F.xxhash64(F.lit(1), "text"))
    joined = named.join(found, [h1, h2], "left").select(*docs.columns, spans)
    names = fresh(docs, "n_bytes", "n_removed", "removed", "kept")
    at, n = docs.columns.index("text"), len(docs.columns)
    pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    kinds = [T.LongType(), T.LongType(), T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])), T.BinaryType()]
    schema = T.StructType(docs.schema.fields + [T.StructField(x, k) for x, k in zip(names, kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in joined_batches(batches):
            out: list[list] = [[], [], [], []]
            for x, found in zip(batch.column(at), batch.column(n).to_pylist(), strict=True):
                raw = x.as_buffer().to_pybytes() if x.is_valid else b""
                merged: list[list[int]] = []
                for s in found or ():
                    if merged and s["start"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["end"])
                    else:
                        merged.append([s["start"], s["end"]])
                kept, end = [], 0
                for a, b in merged:
                    kept.append(raw[end:a])
                    end = b
                kept.append(raw[end:])
                left = b"".join(kept)
                out[0].append(len(raw)), out[1].append(len(raw) - len(left))
                out[2].append([{"start": a, "end": b} for a, b in merged]), out[3].append(left if x.is_valid else None)
            cols = [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.list_(pair), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *cols], names=schema.names)

    return joined.mapInArrow(freeing(run), schema)
