"""The corpus pipeline: five operators in a row, each stage written and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftwell.llm import decontaminate, line_dedup, piece_codec, quality_rules, simhash
from siftwell.llm._common import stash

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null and empty texts are among them.

    Each row is judged by its own text, whatever its id; long texts whole; an empty table stays empty; all columns of
    ``docs`` pass through, and none is added, so clashing names do no harm (so in the next three stages).
    """
    field = quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.assess(docs, field, only_kept=True)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; n_chars follows the text.

    Null stays null, and a text that loses all lines becomes ''.  Ties: the smallest doc_id keeps a line; rows without
    one sort last, as one document; rows that share one are one document.
    """
    return line_dedup.clean_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the row with the smallest doc_id, then the smallest digest of the text.

    Rows without an id are kept only if no member of their group has one.  Null and empty texts are one group.
    """
    return simhash.keep_first(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of one or more benchmark items go: a leaked passage is of one item as a rule.

    Rows without an id, or with one that others have too, go by their own text.  Null and empty texts stay.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents followed by piece_ids, n_pieces, ids_sha256 and round_trip (whether the ids decode to the text).

    Null text: null ids.  New columns get ``_`` where their names are taken.
    """
    return piece_codec.encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("sentencepiece", pieces),
]

#: The field's labels and the pieces are beyond SQL; a test compares run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stash(docs, name)
    return docs
