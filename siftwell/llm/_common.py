"""What the operators share: scratch tables, fresh names, text blocks, word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_root

#: Rows without a doc_id are one document that sorts after all others.
NO_ID = 2**63 - 1
#: Bytes of text that the array code takes at a time; a longer text is a block of its own.
BLOCK = 2 << 20


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, executors may be lost.

    The folder goes when the JVM ends, as the returned (lazy) frames still read it.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/siftwell/{uuid.uuid4().hex}-{label}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def unstash(df: DataFrame) -> None:
    """Delete a stashed table that no frame reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, which at its end returns freed memory to the machine, as a Python worker lives on after its task."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        for k in (0, 1):
            if len(_POW[k]) > 2 * BLOCK:  # of a long text
                _POW[k] = np.ones(1, np.uint64)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return inner


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, whatever its extra columns are called."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def id_key(doc_id="doc_id"):
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))


def real_id(col):
    return F.when(col != NO_ID, col)


def text_blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets within them) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(offs, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def table_of(chars: str) -> np.ndarray:
    lut = np.zeros(256, bool)
    lut[np.frombuffer(chars.encode("latin-1"), np.uint8)] = True
    return lut


SPACE = table_of(" \t\n\x0b\x0c\r")
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased: digits, a-z, all of non-ASCII.
ALNUM = table_of("0123456789abcdefghijklmnopqrstuvwxyz")
ALNUM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = LOWER.tobytes()


def word_spans(is_word: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each run of word bytes; runs end with their row."""
    n = len(is_word)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = is_word[:-1]
    starts = np.flatnonzero(is_word & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = is_word[1:]
    ends = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        inv = np.uint64(pow(int(_BASE), -1, 2**64))
        for k, base in ((0, _BASE), (1, inv)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POW[k] = np.cumprod(p, dtype=np.uint64)
    return _POW[0][:n], _POW[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] the polynomial of bytes s to e, times the base to the power s."""
    pw, _ = _powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * pw[:-1], out=out[1:])
    return out


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, alike wherever the bytes stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    p = prefix_sums(buf)
    _, inv = _powers(len(buf) + 1)
    return mix((p[ends] - p[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


_GRAM = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words in one row, and the index of each run's first word."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h += words[k : k + m] * _GRAM[k]
    at = np.flatnonzero(rows[:m] == rows[n - 1 :])
    return mix(h[at] + np.uint64(n)), at


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


class Bloom:
    """Blocked Bloom filter: all bits of a key lie in one 64-bit word."""

    def __init__(self, words: np.ndarray, k: int = 4):
        self.words, self.k = words, k

    @staticmethod
    def place(h: np.ndarray, n_words: int, k: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The word of each key, and the bits it sets there. ``n_words`` is a power of two."""
        h = mix(h)
        at = (h & np.uint64(n_words - 1)).astype(np.int64)
        bits = np.zeros(len(h), np.uint64)
        for j in range(k):
            bits |= np.uint64(1) << ((h >> np.uint64(40 + 6 * j)) & np.uint64(63))
        return at, bits

    def has(self, h: np.ndarray) -> np.ndarray:
        at, bits = self.place(h, len(self.words), self.k)
        return (self.words[at] & bits) == bits


def power_of_two(n: float, least: int, most: int) -> int:
    return int(min(most, max(least, 2 ** int(np.ceil(np.log2(max(n, 1)))))))


#: Bound of a filter of keys that is broadcast: 2^21 words, 16 MB.  A fuller one only lets more rows through.
MOST_KEY_WORDS = 1 << 21


def bloom_of(keys: DataFrame, name: str, n_words: int | None = None) -> Bloom:
    """A filter of the column ``name``; what is collected is bounded by its size in words."""
    n_words = n_words or power_of_two(keys.count(), 1 << 10, MOST_KEY_WORDS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, bits = Bloom.place(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), n_words)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(as_long(bits))], names=["at", "bits"])

    words = np.zeros(n_words, np.int64)
    for row in keys.select(name).mapInArrow(place, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        words[row["at"]] = row["bits"]
    return Bloom(words.view(np.uint64))
