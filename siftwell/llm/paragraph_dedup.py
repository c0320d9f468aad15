"""Substring dedup: MinHash banding of paragraphs, exact Jaccard, removals by components.

Paragraphs are lines of at least ``min_words`` words; in such lines of several sentences, each sentence of at least
``min_sentence`` words is a unit as well, so a passage set into another paragraph is found by its
sentences.  Words are runs of other than ASCII white space, A-Z lower-cased.

Lines with the same words, and sentences with the same words as a line or sentence, link (by a
128-bit digest of the sequence).  Other lines link at a Jaccard similarity of their 5-word shingles of ``similarity`` or
more (over 64-bit digests of shingles), among those that share a band of their MinHash signature: 12 bands of 4 rows
find 99.8 % of pairs at 0.8 and more above.

Colliding lines are joined in rounds that are linear in the members of buckets.  First each member meets its bucket's
pivot; pivots follow one order in all bands, so most bands name the same pair, which is verified once.  Only buckets
whose members are not yet one component go on.  There members stand in the order of their other band keys, next to
those they share most with, and are cut into chunks of up to ``CHUNK``; chunks of two or more components compare all
members across components exactly and give a forest of links, never all pairs.  A bucket of up to ``CHUNK`` members is one chunk,
so its components are exact.  Larger ones are searched again in the order of another band, ``TURNS`` times or until a
round merges nothing.  What is open then is compared whole: its largest component need not meet itself, all other
members meet all of the bucket, dealt into pairs of parts.  So no bucket is capped, and components are those of all
similar pairs that share a band.

Two Bloom filters over all keys (see line_dedup) keep units that nothing can match out of the shuffle.

Null and empty texts, and units of fewer words, have no part.  Repeats within a text count too.
Of a component the unit with the smallest (doc_id, start) stays.  Rows that share a doc_id are one document
if their texts agree; rows without a doc_id sort last.  A text of any length is taken whole.  Extra columns are
ignored by ``clusters`` and pass through ``drop_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import BLOCK, LOWER, SPACE, Bloom, _powers, as_long, freeing, fresh, gram_hashes, id_key, mix, power_of_two, real_id, span_hashes, stash, text_blocks, unstash, word_spans
from .components import connected_components, smallest_nodes
from .line_dedup import MOST_WORDS, joined_batches, twice_filter

SHINGLE = 5
BANDS, ROWS = 12, 4
#: A paragraph's least words: shorter lines repeat as headings, notices and menus do.
MIN_WORDS = 20
#: Members of a bucket that are compared with each other at once.
CHUNK = 128
#: Orders in which buckets over ``CHUNK`` are searched before the rest is compared whole, at most.
TURNS = 3
#: Members and bytes of the parts into which what is left of a bucket is dealt, and members of a part that are compared at once.
PART, PART_BYTES, SIDE = 4096, 4 << 20, 256
_rng = np.random.default_rng(77)
_MUL = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_BAND = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?"]] = True


@dataclass
class Units:
    """Lines and sentences of a block: row, byte range within the row, digests of the word sequence, band keys (lines)."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    key: np.ndarray
    key2: np.ndarray
    bands: np.ndarray  # BANDS columns, for the first len(bands) units


def _runs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    return first, np.append(first[1:], len(ids))


def units(buf: np.ndarray, offs: np.ndarray, min_words: int, min_sentence: int) -> Units | None:
    low = LOWER[buf]
    starts, ends, rows = word_spans(~SPACE[low], offs)
    if not len(starts):
        return None
    words = span_hashes(low, starts, ends)
    bounds = np.unique(np.concatenate([np.flatnonzero(buf == 10), offs]))
    line = np.searchsorted(bounds, starts, "right")
    a, b = _runs(line)
    # a sentence ends with a line, or with a word that ends so
    closed = np.append(True, (_END[low[ends[:-1] - 1]]) | (line[1:] != line[:-1]))
    sent = np.cumsum(closed)
    c, d = _runs(sent)
    length = np.bincount(line)[line[c]]
    part = (d - c >= min_sentence) & (length > d - c) & (length >= min_words)
    c, d = c[part], d[part]
    whole = b - a >= min_words
    a, b = a[whole], b[whole]
    lo, hi = np.concatenate([a, c]), np.concatenate([b, d])
    if not len(lo):
        return None
    pw, inv = _powers(len(words) + 1)
    sums = [np.append(np.uint64(0), np.cumsum(w * pw[: len(words)])) for w in (words, mix(words ^ _BAND[0]))]
    key, key2 = (mix((p[hi] - p[lo]) * inv[lo] + (hi - lo).astype(np.uint64)) for p in sums)
    bands = np.zeros((len(a), BANDS), np.uint64)
    if len(a):
        grams, at = gram_hashes(words, line, SHINGLE)
        # lines of min_words words have a shingle if that is SHINGLE or more
        first = np.searchsorted(at, a)
        lengths = np.maximum(b - a - SHINGLE + 1, 0)
        idx = np.repeat(first, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        grams = grams[idx]
        cuts = np.cumsum(lengths) - lengths
        for j in range(BANDS):
            h = np.full(len(a), _BAND[j], np.uint64)
            for k in range(j * ROWS, (j + 1) * ROWS):
                h = mix(h ^ np.minimum.reduceat(grams * _MUL[k] + _ADD[k], cuts))
            bands[:, j] = h
    row = rows[lo]
    return Units(row, starts[lo] - offs[row], ends[hi - 1] - offs[row], key, key2, bands)


def _pairs(docs: DataFrame, bloom_words: int, min_words: int, min_sentence: int) -> DataFrame:
    """(uid, id, start, end, k1, k2, bands, text) of units that may match.

    ``bands`` (null where nothing can match) and ``text`` are set for lines with a band that may match.
    """

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        out = [np.zeros(0, np.uint64)]
        for _, _, buf, offs in text_blocks(batch.column(1)):
            u = units(buf, offs, min_words, min_sentence)
            if u is not None:
                out += [u.key, u.bands.ravel()]
        return np.concatenate(out)

    twice = docs.sparkSession.sparkContext.broadcast(twice_filter(docs, bloom_words, keys).words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, uid = Bloom(twice.value), TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, buf, offs in text_blocks(batch.column(1)):
                u = units(buf, offs, min_words, min_sentence)
                if u is None:
                    continue
                exact = bloom.has(u.key)
                near = bloom.has(u.bands.ravel()).reshape(u.bands.shape) if len(u.bands) else np.zeros((0, BANDS), bool)
                some = exact.copy()
                some[: len(near)] |= near.any(axis=1)
                at = np.flatnonzero(some)
                if not len(at):
                    continue
                raw = buf.tobytes()
                lists, texts = [], []
                for i in at.tolist():
                    own = i < len(near) and bool(near[i].any())
                    lists.append([k if hit else None for k, hit in zip(as_long(u.bands[i]).tolist(), near[i].tolist(), strict=True)] if own else None)
                    begin = int(offs[u.row[i]])
                    texts.append(raw[begin + int(u.start[i]) : begin + int(u.end[i])] if own else None)
                cols = [pa.array(np.arange(uid, uid + len(at))), pa.array(ids[lo + u.row[at]], pa.int64()), pa.array(u.start[at]), pa.array(u.end[at]),
                        pa.array(as_long(u.key[at])), pa.array(as_long(u.key2[at])), pa.array(lists, pa.list_(pa.int64())), pa.array(texts, pa.binary()).view(pa.string())]
                uid += len(at)
                yield pa.RecordBatch.from_arrays(cols, names=["uid", "id", "start", "end", "k1", "k2", "bands", "text"])

    return docs.mapInArrow(freeing(run), "uid long, id long, start long, end long, k1 long, k2 long, bands array<long>, text string")


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram): the distinct shingles of each text, in order of row and gram; about ``BLOCK`` bytes at a time."""
    rows_, grams_, lo = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while lo < len(texts):
        hi, size = lo + 1, len(texts[lo])
        while hi < len(texts) and size + len(texts[hi]) <= BLOCK:
            size += len(texts[hi])
            hi += 1
        offs = np.append(0, np.cumsum([len(t) for t in texts[lo:hi]])).astype(np.int64)
        low = LOWER[np.frombuffer(b"".join(texts[lo:hi]), np.uint8)]
        starts, ends, rows = word_spans(~SPACE[low], offs)
        grams, at = gram_hashes(span_hashes(low, starts, ends), rows, SHINGLE)
        rows = rows[at]
        order = np.lexsort((grams, rows))
        rows, grams = rows[order], grams[order]
        new = np.append(True, (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1]))[: len(rows)]
        rows_.append(rows[new] + lo), grams_.append(grams[new])
        lo = hi
    return np.concatenate(rows_), np.concatenate(grams_)


def _raw(column: pa.Array) -> list[bytes]:
    return column.view(pa.binary()).to_pylist() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().view(pa.binary()).to_pylist()


def _verify(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the candidate pairs that are similar, by exact Jaccard similarity."""
    both = pairs.join(texts.withColumnsRenamed({"uid": "b", "text": "tb"}), "b").join(texts.withColumnsRenamed({"uid": "a", "text": "ta"}), "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in joined_batches(batches, BLOCK):
            a = batch.column(0).to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            run_of = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(a))))
            own_row, own = _grams(_raw(batch.column(2).take(pa.array(heads))))
            row, gram = _grams(_raw(batch.column(3)))
            cuts = np.searchsorted(own_row, np.arange(len(heads) + 1))
            hit = np.zeros(len(row), bool)
            for k in range(len(heads)):  # rows of one pivot stand together, as the last join sorts by it
                lo, hi = np.searchsorted(row, [heads[k], heads[k + 1] if k + 1 < len(heads) else len(a)])
                mine = own[cuts[k] : cuts[k + 1]]
                if len(mine):
                    at = np.minimum(np.searchsorted(mine, gram[lo:hi]), len(mine) - 1)
                    hit[lo:hi] = mine[at] == gram[lo:hi]
            shared, size = np.bincount(row, hit, len(a)), np.bincount(row, minlength=len(a))
            near = pa.array(shared >= similarity * (size + np.diff(cuts)[run_of] - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], names=["a", "b"])

    return both.mapInArrow(freeing(run), "a long, b long")


def similar(texts: list[bytes], similarity: float) -> np.ndarray:
    """Which of the texts are similar to which, exactly; shingles are taken in slices, so memory is bounded."""
    n = len(texts)
    row, gram = _grams(texts)
    size = np.bincount(row, minlength=n)
    _, which, count = np.unique(gram, return_inverse=True, return_counts=True)
    often = count > 1
    dense = np.cumsum(often) - 1
    keep = often[which]
    row, col = row[keep], dense[which[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    shared = np.zeros((n, n))
    for lo in range(0, int(often.sum()), 1024):
        a, b = np.searchsorted(col, [lo, lo + 1024])
        grid = np.zeros((n, 1024), np.float32)
        grid[row[a:b], col[a:b] - lo] = 1
        shared += grid @ grid.T
    return shared >= similarity * (size[:, None] + size[None, :] - shared)


def _forest(chunk: list[tuple[int, int, bytes]], similarity: float) -> list[tuple[int, int]]:
    """Links between the components of (uid, component, text) rows, as pairs of components, no more than connect them."""
    near = similar([t for _, _, t in chunk], similarity)
    parent = {c: c for _, c, _ in chunk}

    def find(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    out = []
    comps = np.array([c for _, c, _ in chunk])
    for i, j in zip(*np.nonzero(np.triu(near & (comps[:, None] != comps[None, :]), 1)), strict=True):
        x, y = find(int(comps[i])), find(int(comps[j]))
        if x != y:
            parent[x] = y
            out.append((int(comps[i]), int(comps[j])))
    return out


def _chunks(live: DataFrame, most: int) -> DataFrame:
    """(chunk, uid, comp) of the chunks with two or more components, from (band, n, keys, uid, comp) in range order."""
    large = F.col("n") > most
    # a small bucket has one range key, so that no border cuts it; a large one is cut anywhere
    ranged = live.select("band", F.when(large, F.col("keys")).alias("keys"), F.when(large, F.col("uid")).alias("tie"), "uid", "comp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 33
        left: list[np.ndarray] = [np.zeros(0, np.int64)] * 3

        def cut(cols: list[np.ndarray], last: bool) -> tuple[pa.RecordBatch, list[np.ndarray]]:
            nonlocal chunk
            band = cols[0]
            heads = np.flatnonzero(np.append(True, band[1:] != band[:-1])) if len(band) else np.zeros(0, np.int64)
            within = np.arange(len(band)) - np.repeat(heads, np.diff(np.append(heads, len(band))))
            cuts = np.append(np.flatnonzero(within % most == 0), len(band))
            if not last:
                cuts = cuts[:-1]
            end = int(cuts[-1]) if len(cuts) else 0
            number = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)) if len(cuts) > 1 else np.zeros(0, np.int64)
            comp = cols[2][:end]
            mixed = np.zeros(len(cuts), bool)
            if len(number):
                mixed[:-1] = np.minimum.reduceat(comp, cuts[:-1]) != np.maximum.reduceat(comp, cuts[:-1])
            out = mixed[number]
            made = pa.RecordBatch.from_arrays([pa.array(chunk + number[out]), pa.array(cols[1][:end][out]), pa.array(comp[out])], names=["chunk", "uid", "comp"])
            chunk += len(cuts)
            return made, [c[end:] for c in cols]

        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1, 2)]
            made, left = cut([np.concatenate(x) for x in zip(left, now, strict=True)], False)
            yield made
        yield cut(left, True)[0]

    dealt = ranged.repartitionByRange("band", "keys", "tie").sortWithinPartitions("band", "keys", "tie", "uid")
    return dealt.select("band", "uid", "comp").mapInArrow(freeing(run), "chunk long, uid long, comp long")


def _linked(chunks: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between components that the chunks show."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in joined_batches(batches, BLOCK):
            found = []
            for c, u, k, t in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), _raw(batch.column(3)), strict=True):
                if c != at:
                    found += _forest(held, similarity) if held else []
                    held, at = [], c
                held.append((u, k, t))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])
        if held and (found := _forest(held, similarity)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    rows = chunks.join(texts, "uid").select("chunk", "uid", "comp", "text")
    return rows.repartition("chunk").sortWithinPartitions("chunk", "uid").mapInArrow(freeing(run), "a long, b long")


def _across(comps: np.ndarray, part: np.ndarray, texts: list[bytes], similarity: float) -> list[tuple[int, int]]:
    """Links between the components of two parts of a bucket, or within one: every pair across components is decided."""
    row, gram = _grams(texts)
    size = np.bincount(row, minlength=len(texts))
    _, which, count = np.unique(gram, return_inverse=True, return_counts=True)
    dense = np.cumsum(count > 1) - 1
    keep = count[which] > 1
    row, col = row[keep], dense[which[keep]]
    at = np.full(int((count > 1).sum()) + 1, -1)
    names, root = np.unique(comps, return_inverse=True)
    cuts = np.concatenate([np.arange(lo, hi, SIDE) for lo, hi in zip(*_runs(part), strict=True)] + [[len(texts)]])
    bounds = np.searchsorted(row, cuts)
    out = []

    def grid(k: int, lo: int, hi: int) -> np.ndarray:
        r, c = row[bounds[k] : bounds[k + 1]], at[col[bounds[k] : bounds[k + 1]]]
        held = (c >= lo) & (c < hi)
        made = np.zeros((cuts[k + 1] - cuts[k], hi - lo), np.float32)
        made[r[held] - cuts[k], c[held] - lo] = 1
        return made

    one = part[0] == part[-1]
    for i in range(len(cuts) - 1):
        own = slice(cuts[i], cuts[i + 1])
        seen = np.unique(col[bounds[i] : bounds[i + 1]])
        for j in range(i, len(cuts) - 1):
            other = slice(cuts[j], cuts[j + 1])
            if not one and part[cuts[i]] == part[cuts[j]]:
                continue  # a cell of their own compares these
            apart = root[own][:, None] != root[other][None, :]
            apart &= np.minimum(size[own][:, None], size[other][None, :]) >= similarity * np.maximum(size[own][:, None], size[other][None, :])
            if not apart.any():
                continue
            both = np.intersect1d(seen, col[bounds[j] : bounds[j + 1]])
            at[both] = np.arange(len(both))
            shared = np.zeros(apart.shape)
            for lo in range(0, len(both), 1024):
                hi = min(lo + 1024, len(both))
                shared += grid(i, lo, hi) @ grid(j, lo, hi).T
            at[both] = -1
            x, y = np.nonzero(apart & (shared >= similarity * (size[own][:, None] + size[other][None, :] - shared)))
            if len(x):
                ids, least = smallest_nodes(root[own][x], root[other][y])
                out += [(int(names[a]), int(names[b])) for a, b in zip(ids, least, strict=True) if a != b]
                whole = np.arange(len(names))
                whole[ids] = least
                root = whole[root]
    return out


def _rest(live: DataFrame, texts: DataFrame, similarity: float, part: int) -> DataFrame:
    """(a, b): links between components in the buckets of (band, uid, comp) rows, by comparing all members across components.

    A bucket's largest component need not meet itself.  It and the others are dealt into parts of about ``part`` members
    (fewer where lines are long), and each pair of parts that holds two components is a cell of its own.
    """
    live = stash(live.join(texts.select("uid", F.octet_length("text").alias("size")), "uid"), "rest")
    of = live.groupBy("band", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    top = F.max(F.struct("n", "size", "comp"))
    plan = of.groupBy("band").agg(top.alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    parts = lambda n, size: F.ceil(F.greatest(n / part, size / PART_BYTES)).cast("int")
    plan = plan.select("band", F.col("top.comp").alias("most"), parts(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("few"), parts(F.col("top.n"), F.col("top.size")).alias("many"))
    rows = live.join(stash(plan, "parts"), "band")
    own = F.col("comp") == F.col("most")
    rows = rows.withColumn("part", F.when(own, F.col("few") + F.pmod(F.xxhash64("uid"), "many")).otherwise(F.pmod(F.xxhash64("uid"), "few")).cast("int"))
    rows = rows.join(texts, "uid").select("band", "uid", "comp", "part", "size", "text", F.explode(F.sequence(F.lit(0), F.when(own, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)).alias("other"))
    cells = rows.select(F.xxhash64("band", F.least("part", "other"), F.greatest("part", "other")).alias("cell"), "band", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "comp", "size", "uid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def found() -> Iterator[pa.RecordBatch]:
            if held and (links := _across(np.array([h[1] for h in held]), np.array([h[0] for h in held]), [h[2] for h in held], similarity)):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], names=["a", "b"])

        for batch in joined_batches(batches, BLOCK):
            for band, x, y, p, c, t in zip(*(batch.column(i).to_pylist() for i in range(5)), _raw(batch.column(5)), strict=True):
                if (band, x, y) != at:
                    yield from found()
                    held, at = [], (band, x, y)
                held.append((p, c, t))
        yield from found()

    dealt = cells.repartition("cell").sortWithinPartitions("band", "x", "y", "part", "comp", "size", "uid")
    return dealt.select("band", "x", "y", "part", "comp", "text").mapInArrow(freeing(run), "a long, b long")


def _coloured(members: DataFrame, comps: DataFrame) -> DataFrame:
    return members.select("band", "j", "n", "uid").join(comps.withColumnRenamed("id", "uid"), "uid", "left").select("band", "j", "n", "uid", F.coalesce("component", "uid").alias("comp"))


def _open(rows: DataFrame) -> DataFrame:
    """The buckets whose members are not yet one component."""
    return rows.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("band")


def _merged(comps: DataFrame, found: DataFrame) -> DataFrame:
    """The components after the links ``found`` between them; a line alone is its own component."""
    joined = connected_components(found.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("id").alias("component"), F.col("component").alias("whole"))
    out = comps.join(joined, "component", "left").select("id", F.coalesce("whole", "component").alias("component")).unionByName(
        joined.select(F.col("component").alias("id"), F.col("whole").alias("component")).join(comps.select("id"), "id", "left_anti"))
    out = stash(out, "components")
    unstash(comps), unstash(joined), unstash(found)
    return out


def near_components(lines: DataFrame, texts: DataFrame, similarity: float, most: int = CHUNK, part: int = PART) -> DataFrame:
    """The stored components (id, component) of similar lines of (uid, bands) and (uid, text); lines alone have no row."""
    each = stash(lines.select("uid", F.posexplode("bands").alias("j", "band")).filter("band is not null"), "members")
    sizes = each.groupBy("band").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("uid").alias("h"), "uid")).alias("p")).filter("n > 1")
    sizes = stash(sizes.select("band", "n", F.col("p.uid").alias("pivot")), "buckets")
    members = stash(each.join(sizes, "band"), "colliding")
    unstash(each), unstash(sizes)
    # texts are shuffled once, and from then on only those of lines that collide
    wide = stash(lines.join(members.select("uid").distinct(), "uid", "left_semi").join(texts, "uid"), "wide")
    lines, texts = wide.select("uid", "bands"), wide.select("uid", "text")
    met = stash(members.filter("uid <> pivot").select(F.col("pivot").alias("a"), F.col("uid").alias("b")).distinct(), "meetings")
    near = stash(_verify(met, texts, similarity), "near")
    comps = connected_components(near.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    unstash(met), unstash(near)
    for turn in range(1, TURNS + 1):
        rows = stash(_coloured(members, comps), "coloured")
        keys = F.slice(F.array_compact(F.slice(F.concat("bands", "bands"), (F.col("j") + turn) % BANDS + 1, F.lit(BANDS - 1))), 1, 4)
        live = stash(rows.join(stash(_open(rows), "open"), "band").join(lines, "uid").select("band", "n", keys.alias("keys"), "uid", "comp"), "live")
        unstash(rows)
        chunks = stash(_chunks(live, most), "chunks")
        unstash(live)
        found = stash(_linked(chunks, texts, similarity), "near")
        unstash(chunks)
        if found.isEmpty():
            unstash(found)
            break
        comps = _merged(comps, found)
        # buckets of one chunk have been searched whole
        old, members = members, stash(members.filter(F.col("n") > most), "colliding")
        unstash(old)
        if members.isEmpty():
            break
    # what the rounds have left open in larger buckets is compared whole
    rows = stash(_coloured(members.filter(F.col("n") > most), comps).select("band", "uid", "comp"), "coloured")
    unstash(members)
    open_ = stash(_open(rows), "open")
    if not open_.isEmpty():
        comps = _merged(comps, stash(_rest(rows.join(open_, "band"), texts, similarity, part), "near"))
    unstash(rows), unstash(open_), unstash(wide)
    return comps


def clusters(docs: DataFrame, similarity: float = 0.8, min_words: int = MIN_WORDS, min_sentence: int = 8, bloom_words: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(id, start, end, first_id, first_start, first_end, removed): units in components of two or more."""
    if min_words < SHINGLE:
        raise ValueError("a paragraph needs a whole shingle")
    slim = docs.select(id_key().alias("id"), "text")
    bloom_words = bloom_words or power_of_two(docs.count() * 32, 1 << 12, MOST_WORDS)
    found = stash(_pairs(slim, bloom_words, min_words, min_sentence), "units")
    # one line of each word sequence stands for all units with it on the way through the bands
    same = found.groupBy("k1", "k2").agg(F.min("uid").alias("head"), F.max("uid").alias("tail"), F.min(F.when(F.col("text").isNotNull(), F.col("uid"))).alias("line")).filter("head < tail")
    same = stash(same.select("k1", "k2", F.coalesce("line", "head").alias("node")), "same")
    lines = found.filter("text is not null").select("uid", "k1", "k2", "bands").join(same, ["k1", "k2"], "left").filter("node is null or node = uid")
    lines = stash(lines.select("uid", "bands"), "lines")
    labels = near_components(lines, found.filter("text is not null").select("uid", "text"), similarity, chunk).withColumnRenamed("id", "node")
    unstash(lines)
    placed = found.select("uid", "id", "start", "end", "k1", "k2").join(same.withColumn("alike", F.lit(True)), ["k1", "k2"], "left").withColumn("node", F.coalesce("node", "uid"))
    units_ = placed.join(labels, "node", "left").filter("alike or component is not null")
    units_ = stash(units_.select("uid", "id", "start", "end", F.coalesce("component", "node").alias("component")), "labelled")
    unstash(found), unstash(same), unstash(labels)
    heads = stash(units_.groupBy("component").agg(F.min(F.struct("id", "start", "end", "uid")).alias("f")), "heads")
    return units_.join(heads, "component").select(
        "id", "start", "end", F.col("f.id").alias("first_id"), F.col("f.start").alias("first_start"), F.col("f.end").alias("first_end"), (F.col("uid") != F.col("f.uid")).alias("removed"))


def repeated_paragraphs(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, start, end, first_doc_id, first_start, first_end, removed); bytes, end exclusive."""
    out = clusters(docs, **options)
    return out.select(real_id(F.col("id")).alias("doc_id"), "start", "end", real_id(F.col("first_id")).alias("first_doc_id"), "first_start", "first_end", "removed")


def drop_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the removed units cut out of ``text`` (their line breaks stay)."""
    k, spans = fresh(docs, "paragraph_id", "paragraph_spans")
    gone = clusters(docs, **options).filter("removed").groupBy("id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(spans)).withColumnRenamed("id", k)
    joined = docs.withColumn(k, id_key()).join(gone, k, "left").select(*docs.columns, spans)
    columns = docs.columns
    at, n = columns.index("text"), len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in joined_batches(batches):
            texts = []
            for x, found in zip(batch.column(at), batch.column(n).to_pylist(), strict=True):
                raw = x.as_buffer().to_pybytes() if x.is_valid else None
                if raw is not None and found:
                    kept, end = [], 0
                    for s in found:
                        if s["start"] > end:
                            kept.append(raw[end : s["start"]])
                        end = max(end, s["end"])
                    raw = b"".join([*kept, raw[end:]])
                texts.append(raw)
            cols = batch.columns[:n]
            cols[at] = pa.array(texts, pa.binary()).view(pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=columns)

    return joined.mapInArrow(freeing(run), T.StructType(docs.schema.fields))
