"""Line dedup: two Bloom filters find the lines that may repeat; only those are shuffled.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased.  Keys of at least
``min_chars`` code points that two or more documents hold lose all their lines except in the document
with the smallest doc_id.  The ``once`` filter has every key, the ``twice`` filter every key that some
second document may hold; a false hit only costs one more row in the exact step, so the result does not depend on
the filters' size.  Only suspected keys are shuffled to find the first holder, and only texts that lose lines are shuffled
to meet their drops: a third filter, of those texts, lets all others pass as they stand.

Null or empty text: one empty line, which is never dropped.  Rows without a doc_id are one document
that sorts last; rows that share a doc_id are one document.  Drops are listed for each doc_id and text (128 bits of
XXH64), so such rows are no group of their own.  Long texts are taken whole; an empty table gives no rows.  Other
columns pass through unchanged; where they have the name of a new column, that gets ``_``.
Exact confirmation compares 128-bit XXH3 digests of keys.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import LOWER_BYTES, Bloom, bloom_of, freeing, fresh, id_key, power_of_two, stash, unstash

_STRIP = b" \t\n\x0b\x0c\r"
SEGMENTS = 64
#: Bound of the twice filter, which is broadcast: 32 MB.  Beyond it more false hits are shuffled.
MOST_WORDS = 1 << 22


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """A 16-byte key for each line; None for lines that are always kept."""
    out: list[bytes | None] = []
    digest = xxhash.xxh3_128_digest
    for line in text.translate(LOWER_BYTES).split(b"\n"):
        key = line.strip(_STRIP)
        out.append(digest(key) if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars) else None)
    return out


def _hashes(keys) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64)[::2]


def _text(value: pa.Scalar) -> bytes:
    return b"" if not value.is_valid else value.as_buffer().to_pybytes()


def twice_filter(rows: DataFrame, n_words: int, keys_of: Callable[[pa.RecordBatch], np.ndarray]) -> Bloom:
    """The keys that may come twice among the 64-bit keys that ``keys_of`` finds in batches of ``rows``.

    Each task fills its own two filters and sends their segments compressed (size in proportion to
    its own keys); a segment's merge streams over them with two arrays in memory.
    """
    width = n_words // SEGMENTS

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(n_words, np.uint64), np.zeros(n_words, np.uint64)
        for batch in batches:
            at, bits = Bloom.place(keys_of(batch), n_words)
            order = np.lexsort((bits, at))
            at, bits = at[order], bits[order]
            again = np.zeros(len(at), bool)
            again[1:] = (at[1:] == at[:-1]) & (bits[1:] == bits[:-1])
            again |= (once[at] & bits) == bits
            np.bitwise_or.at(once, at, bits)
            np.bitwise_or.at(twice, at[again], bits[again])
        for s in range(SEGMENTS):
            part = slice(s * width, (s + 1) * width)
            if once[part].any():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *(pa.array([zlib.compress(a[part].tobytes(), 1)], pa.binary()) for a in (once, twice))], names=["seg", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for s, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                once, twice = (np.frombuffer(zlib.decompress(x), np.uint64) for x in (a, b))
                if s not in held:
                    held[s] = [np.zeros(width, np.uint64), np.zeros(width, np.uint64)]
                o, t = held[s]
                t |= twice | (o & once)
                o |= once
        for s, (_, t) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([zlib.compress(t.tobytes(), 1)], pa.binary())], names=["seg", "twice"])

    parts = rows.mapInArrow(freeing(build), "seg int, once binary, twice binary").repartition(SEGMENTS, "seg")
    words = np.zeros(n_words, np.uint64)
    for row in parts.mapInArrow(freeing(merge), "seg int, twice binary").toLocalIterator():  # at most n_words words, a bounded size
        words[row["seg"] * width : (row["seg"] + 1) * width] = np.frombuffer(zlib.decompress(row["twice"]), np.uint64)
    return Bloom(words)


def _named(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` with its id and the digest of its text under the three names."""
    return docs.withColumns(dict(zip(names, (id_key(), F.xxhash64("text"), F.xxhash64(F.lit(1), "text")), strict=True)))


def repeated_lines(docs: DataFrame, min_chars: int = 10, n_words: int | None = None) -> DataFrame:
    """(id, h1, h2, keys): the line keys that the document with that id must drop from the text of that digest."""
    spark = docs.sparkSession
    slim = _named(docs.select("doc_id", "text"), "id", "h1", "h2").select("id", "h1", "h2", "text")
    if n_words is None:  # about 16 bits a line, from the number of documents; only the share of false hits depends on it
        n_words = power_of_two(docs.count() * 4, 1 << 12, MOST_WORDS)

    def keys_of(batch: pa.RecordBatch) -> np.ndarray:
        return _hashes([k for x in batch.column(3) for k in {k for k in line_keys(_text(x), min_chars) if k}])

    shared = spark.sparkContext.broadcast(twice_filter(slim, n_words, keys_of).words)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = Bloom(shared.value)
        for batch in batches:
            rows, keys = [], []
            for i, x in enumerate(batch.column(3)):
                own = {k for k in line_keys(_text(x), min_chars) if k}
                keys += own
                rows += [i] * len(own)
            if keys:
                hit = np.flatnonzero(bloom.has(_hashes(keys)))
                held = pa.array(np.array(rows, np.int64)[hit])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(held) for k in range(3)), pa.array(keys, pa.binary()).take(pa.array(hit))], names=["id", "h1", "h2", "key"])

    maybe = stash(slim.mapInArrow(freeing(suspects), "id long, h1 long, h2 long, key binary"), "suspects")
    held = maybe.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    # read from a table, so that both sides of the join are dealt anew and a hot key's rows can be split
    held = stash(held.select("key", "first"), "repeated")
    # of each text no more than its own keys
    lost = stash(maybe.join(held, "key").filter("id > first").groupBy("id", "h1", "h2").agg(F.collect_set("key").alias("keys")), "drops")
    unstash(maybe), unstash(held)
    return lost


def dedup_lines(docs: DataFrame, min_chars: int = 10, n_words: int | None = None) -> DataFrame:
    """``docs`` with ``text`` cleaned, and its columns followed by n_lines and n_dropped.

    A row whose text loses nothing keeps it (null stays null); one that loses every line has ''.
    """
    k, h1, h2, drops, n_lines, n_dropped = fresh(docs, "line_id", "line_h1", "line_h2", "line_drops", "n_lines", "n_dropped")
    lost = repeated_lines(docs, min_chars, n_words)
    losers = docs.sparkSession.sparkContext.broadcast(bloom_of(lost.select(F.xxhash64("id", "h1", "h2").alias("row")), "row").words)

    @F.arrow_udf(T.BooleanType())
    def loses(row: pa.Array) -> pa.Array:
        return pa.array(Bloom(losers.value).has(row.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))

    named = _named(docs, k, h1, h2)
    row = loses(F.xxhash64(k, h1, h2))
    # a plain line count for texts that lose nothing; only the row's hash goes to Python
    whole = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(1)).cast("long")
    same = named.filter(~row).withColumns({n_lines: whole, n_dropped: F.lit(0).cast("long")}).drop(k, h1, h2)
    lost = lost.select(F.col("id").alias(k), F.col("h1").alias(h1), F.col("h2").alias(h2), F.col("keys").alias(drops))
    joined = named.filter(row).join(lost, [k, h1, h2], "left").select(*[F.col(f"`{c}`") for c in docs.columns], drops)
    at, lost_at = docs.columns.index("text"), len(docs.columns)
    schema = T.StructType(docs.schema.fields + [T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in joined_batches(batches):
            texts, lines, dropped = [], [], []
            for x, gone in zip(batch.column(at), batch.column(lost_at), strict=True):
                text, keys = _text(x), gone.as_py()
                if keys:
                    keys, parts = set(keys), text.split(b"\n")
                    stay = [p for p, key in zip(parts, line_keys(text, min_chars), strict=True) if key not in keys]
                    texts.append(b"\n".join(stay))
                    lines.append(len(parts)), dropped.append(len(parts) - len(stay))
                else:
                    texts.append(text if x.is_valid else None)
                    lines.append(text.count(b"\n") + 1), dropped.append(0)
            cols = [*batch.columns[:lost_at], pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
            cols[at] = pa.array(texts, pa.binary()).view(pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return same.unionByName(joined.mapInArrow(freeing(run), schema))


def clean_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """The columns of ``docs`` with ``text`` cleaned; an ``n_chars`` column follows a text that lost lines."""
    out = dedup_lines(docs, min_chars)
    lost = F.col(out.columns[-1]) > 0
    if "n_chars" in docs.columns:
        size = F.when(lost, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def joined_batches(batches: Iterator[pa.RecordBatch], limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes, as texts differ in length."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * limit / max(batch.nbytes, 1)))
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
