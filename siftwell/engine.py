"""The engine over a store: index a tree, search it, navigate, calibrate.

Searching has no side effects: observations are written by ``observe``, thresholds by ``calibrate``.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants as C
from .functions import scoring, text
from .operators import calibration, embedding, navigation, parsing, retrieval
from .operators.collector import Collector
from .operators.retrieval import SearchOptions
from .sources.store import Store
from .sources.tree import read_paths, read_tree
from .streaming.changes import watch


class Engine:
    def __init__(self, spark: SparkSession, database: str, provider: Callable[[], embedding.Provider] | None = embedding.HashedTokens):
        self.spark, self.store, self.provider = spark, Store(spark, database), provider
        self.collector = Collector(self.store.table("observations").count())
        self._limits: dict[str, tuple[float, float]] | None = None

    # -- index -------------------------------------------------------------------------------------

    def index(self, root: str, force: bool = False, remove_missing: bool = True) -> dict[str, int]:
        """Index changed files; counts of added, changed, removed and same files."""
        if self.store.prepare_for_reindex() or force:
            self.store.clear()
        # written once: a file that changes meanwhile has the content that its hash is of
        files, staged = self._staged(read_tree(self.spark, root))
        changes = self.store.changes(files).cache()
        counts = {"added": 0, "changed": 0, "removed": 0, "same": 0} | {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
        todo = files.join(changes.filter(F.col("change").isin("added", "changed")).select("path"), "path", "left_semi")
        if counts["added"] + counts["changed"]:
            self._replace(todo)
        if remove_missing and counts["removed"]:
            self.store.delete_files(changes.filter("change = 'removed'"))
        changes.unpersist()
        self.store.drop_folder(staged)
        return counts

    def _staged(self, files: DataFrame) -> tuple[DataFrame, str]:
        """Files of known languages as a stored table, and its folder."""
        files = files.withColumn("language", text.language(F.col("path"))).filter("language is not null")
        folder = f".staged/{uuid.uuid4().hex}"
        files.filter(~text.excluded_path(F.col("path"))).write.parquet(f"{self.store.root}/{folder}")
        return self.spark.read.schema("path string, content string, size long, last_modified long, language string").parquet(f"{self.store.root}/{folder}"), folder

    def _replace(self, files: DataFrame) -> None:
        named = files.select(F.col("path").alias("file_id"), "content", "language")  # the path stands in for the id
        symbols = parsing._rows(named, parsing.extract_symbols, parsing.SYMBOL_ROWS.replace("file_id long", "file_id string")).withColumnRenamed("file_id", "path")
        chunks = parsing._rows(named, parsing.chunk_source, parsing.CHUNK_ROWS.replace("file_id long", "file_id string")).withColumnRenamed("file_id", "path")
        if self.provider:
            chunks = embedding.embed(chunks, self.provider)
        deps = parsing.extract_imports(named).select(F.col("file_id").alias("path"), F.col("line").alias("start_line"), "target_path", "import_name", "kind")
        self.store.replace_files(files, symbols=symbols, chunks=chunks, dependencies=deps)

    def watch(self, root: str, checkpoint: str, once: bool = False):
        """Keep the index up to date with a tree; each batch reads the files that changed, once, and no others."""

        def on_batch(changes: DataFrame, _: int) -> None:
            gone = changes.filter("event = 'deleted'")
            if not gone.isEmpty():
                self.store.delete_files(gone)
            files, staged = self._staged(read_paths(changes.filter("event <> 'deleted'"), root))
            if not files.isEmpty():
                self._replace(files)
            self.store.drop_folder(staged)

        return watch(self.spark, root, on_batch, checkpoint, once=once)

    # -- search ------------------------------------------------------------------------------------

    def _thresholds(self, near: DataFrame) -> tuple[float, float]:
        if self._limits is None:  # a row for each language
            self._limits = {r["language"]: (r["max_distance"], r["min_similarity"]) for r in self.store.table("calibrations").filter(scoring.sufficient(F.col("confidence"))).collect()}
        row = retrieval.dominant_language(near).select("language").first()
        default = self._limits.get(C.GLOBAL_KEY, (C.DEFAULT_MAX_DISTANCE, C.DEFAULT_MIN_SIMILARITY))
        return self._limits.get(row["language"], default) if row else default

    def search(self, query: str, limit: int | None = None, options: SearchOptions = SearchOptions()) -> DataFrame:
        query, limit = text.validate(query), text.capped(limit, C.LIMITS["search"], C.LIMITS["tool_cap"])
        chunks = vec = None
        limits = (C.DEFAULT_MAX_DISTANCE, C.DEFAULT_MIN_SIMILARITY)
        if self.provider:
            vec = retrieval.vector(self.provider().embed([query])[0])
            chunks = self.store.chunks_with_embedding()
            limits = self._thresholds(retrieval.knn(chunks, vec, 5))
        return retrieval.hybrid_search(self.store.table("files"), self.store.table("symbols"), query, limit, options, chunks, vec, limits)

    def find_refs(self, symbol: str, limit: int | None = None) -> DataFrame:
        return navigation.find_refs(self.store.table("files"), self.store.table("symbols"), symbol, text.capped(limit, C.LIMITS["refs"], C.LIMITS["tool_cap"]))

    def dependencies(self, path: str) -> DataFrame:
        return navigation.imports_of(self.store.table("files"), self.store.table("dependencies"), text.validate(path, "PATH"))

    def dependents(self, path: str) -> DataFrame:
        return navigation.dependents_of(self.store.table("files"), self.store.table("dependencies"), text.validate(path, "PATH"))

    def explain(self, symbol: str) -> DataFrame:
        return navigation.explain_symbol(self.store.table("files"), self.store.table("symbols"), symbol)

    def stats(self) -> DataFrame:
        return navigation.index_stats(*(self.store.table(t) for t in ("files", "symbols", "chunks", "dependencies")))

    # -- feedback ----------------------------------------------------------------------------------

    def observe(self, query: str, limit: int = C.LIMITS["search"]) -> int:
        """Record the distances of a query's candidates, if it is sampled; full buffers are flushed and the end of
        bootstrap calibrates.  The number of rows that came into the store."""
        vec = retrieval.vector(self.provider().embed([text.validate(query)])[0])
        near = retrieval.knn(self.store.chunks_with_embedding(), vec, 2 * limit).select("language", "distance").collect()  # 2 * limit rows
        self.collector.record(query, [(r["language"], r["distance"]) for r in near])
        new = self.flush_observations() if self.collector.needs_flush() else 0
        if self.collector.should_calibrate():
            new += self.flush_observations()
            self.auto_calibrate()
        return new

    def flush_observations(self) -> int:
        """Store what is buffered; the number of rows that are new."""
        rows = self.collector.take()
        return self.store.add_observations(self.spark.createDataFrame(rows, "language string, distance float, query_hash long, ts long")) if rows else 0

    def calibrate(self, language: str | None = None, min_samples: int = C.MIN_SAMPLES, dry_run: bool = False) -> DataFrame:
        rows = self.store.table("observations")
        rows = calibration.calibrate_one(rows, language, min_samples) if language else calibration.calibrate(rows, min_samples)
        if not dry_run:
            self.store.save_calibrations(rows)
            self.reload_thresholds()
        return rows

    def reload_thresholds(self) -> None:
        """Forget the thresholds in memory; the next search reads the stored ones."""
        self._limits = None

    def auto_calibrate(self) -> bool:
        """Calibrate with the automatic minimum once enough was observed; whether it did."""
        if calibration.bootstrap(self.store.table("observations").count())[0]:
            return False
        self.calibrate(min_samples=C.AUTO_MIN_SAMPLES)
        return True

    # -- service shapes ----------------------------------------------------------------------------

    def respond(self, route: str, request: dict) -> dict:
        """What the HTTP routes answer: search, find-refs, deps, explain, stats, health; errors carry a code."""
        try:
            return getattr(self, "_" + route.strip("/").replace("-", "_"))(request)
        except text.RequestError as e:
            return {"error": str(e), "code": e.code}

    def _health(self, _: dict) -> dict:
        return {"status": "ok"}

    def _stats(self, _: dict) -> dict:
        return {r["table_name"]: r["n"] for r in self.stats().collect()}

    def _search(self, r: dict) -> dict:
        began = time.time()
        types, kinds = (tuple(x) if (x := text.parse_csv(r.get(k))) else None for k in ("file_type", "symbol_kind"))
        limit = text.capped(r.get("limit"), C.LIMITS["search"], C.LIMITS["http_cap"])
        rows = self.search(r.get("query", ""), limit, SearchOptions(r.get("min_score"), types, kinds)).collect()
        found = [{"file_path": x["path"], "start_line": x["start_line"], "end_line": x["end_line"], "score": x["score"], "content": x["content"],
                  "metadata": {k: x[k] for k in ("symbol_name", "symbol_kind") if x[k] is not None}} for x in rows]
        return {"query": r["query"].strip(), "results": found, "total_count": len(found), "search_time_ms": int(1000 * (time.time() - began))}

    def _find_refs(self, r: dict) -> dict:
        rows = self.find_refs(r.get("symbol", ""), text.capped(r.get("limit"), C.LIMITS["refs"], C.LIMITS["http_cap"])).collect()
        shape = lambda p: [{"file_path": x["path"], "line": x["start_line"], "content": x["content"]} for x in rows if x["part"] == p]
        return {"symbol": r["symbol"].strip(), "definitions": shape(0), "usages": shape(1)}

    def _deps(self, r: dict) -> dict:
        path = text.validate(r.get("file_path", ""), "PATH")
        imports = [{"target": x["target_path"], "kind": x["kind"], "symbols": [x["import_name"]] if x["import_name"] else []} for x in self.dependencies(path).collect()]
        return {"file_path": path, "imports": imports, "imported_by": [{"source": x["source_path"], "kind": "import"} for x in self.dependents(path).collect()]}

    def _explain(self, r: dict) -> dict:
        row = self.explain(r.get("symbol", "")).first()
        return {"symbol": row["name"], "found": row["found"], "definitions": [{"file_path": d["path"], "line": d["start_line"], "signature": d["signature"], "doc_comment": d["doc_comment"]} for d in row["definitions"]], "related": row["related"]}


def format_results(rows: DataFrame, chars: int = 200) -> str:
    """Numbered results with location, kind, score and snippet."""
    shown = rows.select(text.location(F.col("path"), F.col("start_line"), F.col("end_line")).alias("at"), "kind", "score", text.snippet(F.col("content"), chars).alias("s")).collect()
    return "\n\n".join(f"{k}. {r['at']} [{r['kind']}] {r['score']:.2f}\n   {r['s']}" for k, r in enumerate(shown, 1)) or "no results"


def to_json(rows: DataFrame) -> str:
    return json.dumps([json.loads(x) for x in rows.toJSON().collect()])
