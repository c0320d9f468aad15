"""Line search, full-text symbol match, vector search and their fusion; every operator is one lazy plan.

Tables: files (file_id, path, content), symbols and chunks as in ``sources.schemas``.  Orders that the
plans rely on are total, so results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import expansion, scoring, text

RESULT = ["strategy", "kind", "path", "start_line", "end_line", "score", "content", "symbol_name", "symbol_kind", "term_ord", "row_ord"]


@dataclass(frozen=True)
class SearchOptions:
    min_score: float | None = None
    file_types: tuple[str, ...] | None = None
    symbol_kinds: tuple[str, ...] | None = None

    @property
    def floor(self) -> float:
        return C.DEFAULT_MIN_SCORE if self.min_score is None else min(1.0, max(0.0, self.min_score))


def _numbered_lines(files: DataFrame, keep: Column, maybe: Callable[[Column], Column] | None = None) -> DataFrame:
    """(all columns but content, line_number, line) of trimmed, searchable lines of files that ``keep`` lets pass.

    Lines for which ``maybe`` is false of the raw line are dropped before they become rows and are trimmed.
    """
    others = [c for c in files.columns if c != "content"]
    numbered = F.transform(text.lines(F.col("content")), lambda x, k: F.struct((k + 1).cast("long").alias("line_number"), x.alias("raw")))
    if maybe is not None:
        numbered = F.filter(numbered, lambda x: maybe(x["raw"]))
    rows = files.filter(keep).select(*others, F.explode(numbered).alias("x"))
    rows = rows.select(*others, "x.line_number", text.trim(F.col("x.raw")).alias("line"))
    return rows.filter(scoring.searchable(F.col("line")))


def line_search(files: DataFrame, pattern: str, mode: str = "literal") -> DataFrame:
    """Lines that match: ``literal`` (any case), ``word`` (whole word, any case) or ``regex`` (any case).

    Files without a match are dropped before their lines are told apart.
    """
    if mode == "regex" and len(pattern.encode()) > C.MAX_REGEX_BYTES:
        raise text.RequestError("PATTERN_TOO_LONG", f"pattern is longer than {C.MAX_REGEX_BYTES} bytes")
    if mode == "literal":
        test = lambda c: F.lower(c).contains(pattern.lower())
    else:
        quoted = "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        found = "(?i)" + (rf"\b{quoted}\b" if mode == "word" else pattern)
        test = lambda c: c.rlike(found)
    whole = test(F.col("content")) if mode == "literal" else F.lit(True)  # anchors hold for lines only
    rows = _numbered_lines(files, whole, None if mode == "regex" else test).filter(test(F.col("line")))
    return rows.withColumn("score", F.round(scoring.line_score(F.col("line"), F.lit(pattern)), C.DIGITS))


def term_matches(files: DataFrame, terms: list[str]) -> DataFrame:
    """Matching lines; the first of ``terms`` that a line holds owns and scores it."""
    has = [F.lower("line").contains(t.lower()) for t in terms]
    any_file = has_any = F.lit(False)
    for t, h in zip(terms, has, strict=True):
        any_file, has_any = any_file | F.lower("content").contains(t.lower()), has_any | h
    owner = score = F.lit(None)
    for k in range(len(terms) - 1, -1, -1):
        owner = F.when(has[k], k).otherwise(owner)
        score = F.when(has[k], scoring.line_score(F.col("line"), F.lit(terms[k]))).otherwise(score)
    def maybe(raw: Column) -> Column:
        out = F.lit(False)
        for t in terms:
            out = out | F.lower(raw).contains(t.lower())
        return out

    return _numbered_lines(files, any_file, maybe).filter(has_any).select("*", owner.alias("term_ord"), F.round(score, C.DIGITS).alias("score"))


def text_strategy(files: DataFrame, terms: list[str], limit: int, options: SearchOptions = SearchOptions()) -> DataFrame:
    """The first ``limit`` matches: files in path order, best lines of a file first. Needs an extension."""
    ext = text.extension(F.col("path"))
    rows = term_matches(files.filter((ext != "") & text.accepts_extension(ext, options.file_types)), terms)
    first = rows.orderBy("path", F.desc("score"), "term_ord", "line_number").limit(limit)
    return first.select(F.lit(2).alias("strategy"), F.lit("text_match").alias("kind"), "path", F.col("line_number").alias("start_line"), F.col("line_number").alias("end_line"), "score",
                        F.col("line").alias("content"), F.lit(None).cast("string").alias("symbol_name"), F.lit(None).cast("string").alias("symbol_kind"), "term_ord",
                        F.row_number().over(Window.orderBy("path", F.desc("score"), "term_ord", "line_number")).cast("long").alias("row_ord"))


def normal(column: Column) -> Column:
    """Folded tokens, each behind a space."""
    return F.concat(F.lit(" "), F.array_join(F.filter(F.split(F.lower(F.coalesce(column, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != ""), " "))


def phrase(term: str) -> str:
    import re

    tokens = [t for t in re.split(r"[\W_]+", term.lower()) if t]
    return " " + " ".join(tokens) if tokens else ""


def fts_match(symbols: DataFrame, term: str, limit: int = C.FTS_CAP) -> DataFrame:
    """Symbols with the adjacent tokens of ``term``, the last as a prefix, in name, signature or doc comment; in id order."""
    want = phrase(term)
    hit = F.lit(False)
    for c in ("name", "signature", "doc_comment"):
        hit = hit | normal(F.col(c)).contains(want)
    return symbols.filter(hit if want else F.lit(False)).orderBy("symbol_id").limit(min(limit, C.FTS_CAP))


def symbol_strategy(symbols: DataFrame, files: DataFrame, terms: list[str], limit: int, options: SearchOptions = SearchOptions()) -> DataFrame:
    """Per term the first ``limit`` matching symbols, then the filters; a symbol may come once a term."""
    wanted = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(t).alias("term"), F.lit(phrase(t)).alias("want")) for k, t in enumerate(terms)])
    norms = F.array(*[normal(F.col(c)) for c in ("name", "signature", "doc_comment")])
    rows = symbols.withColumn("norms", norms).withColumn("t", F.explode(F.filter(wanted, lambda t: (t["want"] != "") & F.exists("norms", lambda n: n.contains(t["want"])))))
    rank = F.row_number().over(Window.partitionBy("t.ord").orderBy("symbol_id"))
    rows = rows.withColumn("rank", rank).filter(F.col("rank") <= min(limit, C.FTS_CAP)).join(files.select("file_id", "path"), "file_id")
    ext = text.extension(F.col("path"))
    rows = rows.filter(text.accepts_kind(F.col("kind"), options.symbol_kinds) & ((ext == "") | text.accepts_extension(ext, options.file_types)))
    score = F.round(scoring.symbol_score(F.col("name"), F.col("t.term"), F.col("kind")), C.DIGITS)
    return rows.select(F.lit(1).alias("strategy"), F.lit("symbol").alias("result_kind"), "path", "start_line", "end_line", score.alias("score"), F.coalesce("signature", "name").alias("content"),
                       F.col("name").alias("symbol_name"), F.col("kind").alias("symbol_kind"), F.col("t.ord").alias("term_ord"), F.col("symbol_id").alias("row_ord")).withColumnRenamed("result_kind", "kind")


def vector(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def knn(chunks: DataFrame, query: Column, k: int, metric: str = "l2") -> DataFrame:
    """The ``k`` nearest rows with an embedding, by distance then id; an exact scan with a bounded heap per task."""
    near = scoring.l2(F.col("embedding"), query) if metric == "l2" else F.abs(1.0 - scoring.cosine(F.col("embedding"), query))
    return chunks.filter(F.col("embedding").isNotNull()).withColumn("distance", F.round(near, 6)).orderBy("distance", "chunk_id").limit(k)


#: Elements of a distance matrix, and candidate pairs whose differences are taken, at a time.
KNN_CELLS, KNN_PAIRS = 1 << 19, 1 << 15


def _distances(q: np.ndarray, c: np.ndarray, at: np.ndarray, near: np.ndarray) -> np.ndarray:
    out = np.empty(len(at))
    for lo in range(0, len(at), KNN_PAIRS):
        hi = lo + KNN_PAIRS
        out[lo:hi] = ((q[at[lo:hi]] - c[near[lo:hi]]) ** 2).sum(1)
    return np.round(np.sqrt(out), 6)


def _nearest(q: np.ndarray, c: np.ndarray, ci: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in q, place in c, distance) of the ``k`` nearest of each query, a few queries at a time."""
    m = min(k, len(ci))
    of_c, step = (c * c).sum(1), max(1, KNN_CELLS // len(ci))
    for lo in range(0, len(q), step):
        some = q[lo : lo + step]
        rough = (some * some).sum(1)[:, None] + of_c[None, :] - 2 * (some @ c.T)
        # all that rounding may place among the first m; their distances are taken from the differences
        reach = np.partition(rough, m - 1, axis=1)[:, m - 1] + 1e-4 * (1 + np.abs(rough).max(axis=1) ** 0.5)
        at, near = np.nonzero(rough <= reach[:, None])
        d = _distances(some, c, at, near)
        order = np.lexsort((ci[near], d, at))
        at, near, d = at[order], near[order], d[order]
        keep = np.arange(len(at)) - np.searchsorted(at, at) < k
        yield at[keep] + lo, near[keep], d[keep]


def knn_batch(chunks: DataFrame, queries: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """(query_id, chunk_id, distance): the ``k`` nearest rows of each row of ``queries`` (query_id, embedding), by distance then id.

    Both sides are packed into blocks of vectors; each block of queries meets each block of rows in matrix products of a
    bounded size, which keep ``k`` rows a query, and those are ranked again over all blocks.  Exact, and neither the rows that
    leave a block nor the memory it takes depend on how many or how alike the vectors are: pairs of blocks come in Arrow
    batches that Spark ends at 64 MB, and are read in place, one at a time.
    """
    def pack(df: DataFrame, key: str, side: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                rows = rows if rows.dtype == np.float32 else rows.astype(np.float64)
                for lo in range(0, len(ids), block):
                    part = ids[lo : lo + block]
                    yield pa.RecordBatch.from_arrays([pa.array([part.tobytes()], pa.binary()), pa.array([rows[lo : lo + block].tobytes()], pa.binary()), pa.array([rows.dtype.itemsize], pa.int32())], names=[f"{side}_ids", f"{side}_rows", f"{side}_size"])

        kept = df.filter(F.col("embedding").isNotNull()).select(F.col(key).cast("long"), "embedding")
        return kept.mapInArrow(run, f"{side}_ids binary, {side}_rows binary, {side}_size int")

    def vectors(ids: pa.BinaryScalar, rows: pa.BinaryScalar, size: pa.Int32Scalar) -> tuple[np.ndarray, np.ndarray]:
        i = np.frombuffer(ids.as_buffer(), np.int64)
        return i, np.frombuffer(rows.as_buffer(), np.float32 if size.as_py() == 4 else np.float64).reshape(len(i), -1).astype(np.float64)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                (qi, q), (ci, c) = vectors(*row[:3]), vectors(*row[3:])
                for at, near, d in _nearest(q, c, ci, k):
                    yield pa.RecordBatch.from_arrays([pa.array(qi[at]), pa.array(ci[near]), pa.array(d)], names=["query_id", "chunk_id", "distance"])

    # blocks, not rows: a query set against all rows
    pairs = pack(queries, "query_id", "q").crossJoin(pack(chunks, "chunk_id", "c"))
    found = pairs.mapInArrow(nearest, "query_id long, chunk_id long, distance double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).drop("rank")


def dominant_language(near: DataFrame, n: int = 5) -> DataFrame:
    """The commonest language among the ``n`` nearest; ties go to the first name."""
    first = near.orderBy("distance", "chunk_id").limit(n).filter(F.col("language").isNotNull())
    return first.groupBy("language").count().orderBy(F.desc("count"), "language").limit(1)


def semantic_strategy(chunks: DataFrame, query: Column, limit: int, max_distance: float = C.DEFAULT_MAX_DISTANCE, min_similarity: float = C.DEFAULT_MIN_SIMILARITY,
                      options: SearchOptions = SearchOptions(), order: str = "distance") -> DataFrame:
    """Twice ``limit`` neighbours, thresholds, extension filter, then ``limit`` rows by distance (``order='id'``: by id)."""
    near = knn(chunks, query, 2 * limit)
    ext = text.extension(F.col("path"))
    rows = near.withColumn("score", F.round(scoring.similarity(F.col("distance")), 6)).filter((F.col("distance") < max_distance) & (F.col("score") >= min_similarity) & ((ext == "") | text.accepts_extension(ext, options.file_types)))
    keys = [F.col("chunk_id")] if order == "id" else [F.col("distance"), F.col("chunk_id")]
    none = F.lit(None).cast("string")
    return rows.orderBy(*keys).limit(limit).select(F.lit(0).alias("strategy"), F.lit("semantic_match").alias("kind"), "path", "start_line", "end_line", "score", "content", none.alias("symbol_name"), none.alias("symbol_kind"),
                                                   F.lit(0).alias("term_ord"), F.col("chunk_id").alias("row_ord"))


def fuse(semantic: DataFrame | None, symbols: DataFrame, lines: DataFrame, limit: int, min_score: float) -> DataFrame:
    """Line matches only fill up what the other strategies leave; best score first, one row a place, at most ``limit``."""
    first = symbols.select(*RESULT) if semantic is None else semantic.select(*RESULT).unionByName(symbols.select(*RESULT))
    room = F.greatest(F.lit(0), F.lit(limit) - F.col("n"))
    # a count is one row
    rest = lines.crossJoin(F.broadcast(first.agg(F.count("*").alias("n")))).filter(F.col("row_ord") <= room).select(*RESULT)
    order = [F.desc("score"), F.asc("strategy"), F.asc("term_ord"), F.asc("row_ord")]
    best = F.row_number().over(Window.partitionBy("path", "start_line", "end_line").orderBy(*order))
    rows = first.unionByName(rest).withColumn("place", best).filter((F.col("place") == 1) & (F.col("score") >= min_score)).drop("place")
    return rows.orderBy(*order).limit(limit)


def hybrid_search(files: DataFrame, symbols: DataFrame, query: str, limit: int = C.LIMITS["search"], options: SearchOptions = SearchOptions(), chunks: DataFrame | None = None, embedding: Column | None = None,
                  thresholds: tuple[float, float] = (C.DEFAULT_MAX_DISTANCE, C.DEFAULT_MIN_SIMILARITY)) -> DataFrame:
    """The semantic strategy takes part if there is an embedding of the query."""
    query, limit = text.validate(query), min(limit, C.RESULT_CAP)
    terms = expansion.all_terms(query)
    semantic = semantic_strategy(chunks, embedding, limit, *thresholds, options) if chunks is not None and embedding is not None else None
    return fuse(semantic, symbol_strategy(symbols, files, terms, limit, options), text_strategy(files, terms, limit, options), limit, options.floor)


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both result sets by score; nothing is dropped."""
    return a.unionByName(b).orderBy(F.desc("score"), "strategy", "term_ord", "row_ord")
