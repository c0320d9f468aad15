"""Token counts: delta-maintained totals by source, language and tokenizer version.

Changes are signed rows: an insert adds a document's count, a delete takes it away, a revision takes the
old count away and adds the new one.  A batch of changes is summed by key (pre-aggregated, so a source
with a third of all rows is no heavier than others) and committed under its id: its sums are written to a folder of
their own, then one small file, named by the id, that names the folder is renamed into place, which fails if the name is
taken.  So a batch counts whole or not at all, of two writers of one id one wins, and a repeated commit changes nothing.
Totals are sums over committed batches.

Null and empty text has no tokens and counts as a document; long texts are taken whole.  Null source or lang is a key of
its own.  Repeated rows count each.  Keys whose sums are zero have no row.  Empty tables give no rows.  Extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import Files
from ._common import freeing, scratch_root, stash, text_blocks

KEYS = ["source", "lang", "tokenizer_version"]
COUNTS = "doc_id long, source string, lang string, tokenizer_version string, n_tokens long"
TOTALS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that belongs to these ranks (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODINGS: dict = {}


def encoding_of(ranks_path: str):
    if ranks_path not in _ENCODINGS:
        import tiktoken

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _ENCODINGS[ranks_path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[ranks_path]


def count_tokens(docs: DataFrame, ranks_path: str = DEFAULT_RANKS, bpe_version: str = "byte_bpe_50k", word_version: str = "words_v1", old_version: str | None = None) -> DataFrame:
    """A row for each document and tokenizer version: byte-pair tokens, and words between ASCII white space.

    ``old_version`` adds the counts of an earlier word tokenizer, which cut at spaces alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding_of(ranks_path).encode_ordinary
        counters = [(word_version, lambda t: len(t.encode().split())), (bpe_version, lambda t: len(encode(t)))]
        if old_version:
            counters.append((old_version, lambda t: sum(map(bool, t.split(" ")))))
        for batch in batches:
            for lo, hi, _, _ in text_blocks(batch.column(3)):
                part = batch.slice(lo, hi - lo)
                texts = part.column(3).to_pylist()
                for version, count in counters:
                    n = pa.array([count(t) if t else 0 for t in texts], pa.int64())
                    yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([version] * len(texts)), n], names=["doc_id", *KEYS, "n_tokens"])

    slim = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), "text")
    return slim.mapInArrow(freeing(run), COUNTS)


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), "n_tokens")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """The changes that turn the counts ``old`` of some documents into ``new``, whatever keys they move between."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """Additive totals in a folder that all executors and the driver share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path, Files(spark, path)

    @staticmethod
    def _name(batch_id: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9-]*", batch_id):
            raise ValueError(f"not a batch id: {batch_id!r}")
        return f"batches/{batch_id}"

    def committed(self, batch_id: str) -> bool:
        return self.files.exists(self._name(batch_id))

    def stage(self, changes: DataFrame) -> str:
        """Write the sums of a batch; the name of their folder, which counts for nothing yet."""
        folder = f"sums/{uuid.uuid4().hex}"
        summed = changes.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        summed.filter("n_docs <> 0 or n_tokens <> 0").write.parquet(f"{self.path}/{folder}")
        return folder

    def publish(self, batch_id: str, folder: str) -> bool:
        """Let a staged folder count as the batch; False, and the folder goes, if the batch is there already."""
        won = self.files.publish(self._name(batch_id), folder)
        if not won:
            self.files.delete(folder)
        return won

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch once; False if it is there already (its changes are then not even read)."""
        return not self.committed(batch_id) and self.publish(batch_id, self.stage(changes))

    def batches(self) -> list[str]:
        return self.files.names("batches")

    def totals(self) -> DataFrame:
        names = self.batches()
        if not names:
            return self.spark.createDataFrame([], TOTALS)
        folders = [self.files.read(f"batches/{n}") for n in names]
        rows = self.spark.read.schema(TOTALS).parquet(*[f"{self.path}/{f}" for f in folders])
        out = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return out.filter("n_docs <> 0 or n_tokens <> 0")


def token_totals(docs: DataFrame, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """Totals over ``docs``, kept up to date by a rollup of its own in the shared folder.

    All documents are loaded with byte-pair tokens and the words of an old tokenizer; the words are then revised to those
    of the new one; documents without a token are taken out and put back; every batch is sent twice.  So each row of
    the result has gone through inserts, deletes, revisions and replays over the whole table.
    """
    spark = docs.sparkSession
    rollup = Rollup(spark, f"{scratch_root(spark)}/siftwell/{uuid.uuid4().hex}-rollup")
    counts = stash(count_tokens(docs, ranks_path, old_version="words_v0"), "counts")
    of = lambda version: counts.filter(F.col("tokenizer_version") == version)
    bare = counts.filter((F.col("n_tokens") == 0) & (F.col("tokenizer_version") != "words_v0"))
    steps = [("load", inserts(counts.filter("tokenizer_version <> 'words_v1'"))), ("revise", revisions(of("words_v0"), of("words_v1"))),
             ("retract", deletes(bare)), ("restore", inserts(bare))]
    for batch_id, changes in steps:
        for _ in range(2):
            rollup.commit(batch_id, changes)
    return rollup.totals()
