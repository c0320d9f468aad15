"""The index as Parquet tables: each change writes new folders, then publishes one numbered pointer file.

A pointer names the folders of each table.  Readers take the newest pointer, so they see the old tables or the new ones,
never a mixture, and a writer that dies before its pointer is there has changed nothing.  A pointer's number can be
taken once: of two writers that started from the same state one fails and may try again.

Files and what hangs on them are kept in ``BUCKETS`` folders by a hash of the path; ids name their bucket (``id mod
BUCKETS``), so a change reads and writes the buckets it touches and no others.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import calibration
from .files import Files
from .schemas import CHILDREN, KEYS, TABLES

BUCKETS = 64
#: Pointers kept behind the newest one, for readers that are about to open an older one.
KEPT_POINTERS = 8
ID = {"files": "file_id", "symbols": "symbol_id", "chunks": "chunk_id", "dependencies": "dep_id"}


def content_hash(column="content"):
    return F.sha2(F.col(column), 256)


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) by content hash: added, changed, removed or same."""
    o = old.select("path", F.col("hash").alias("old_hash"), F.lit(1).alias("o"))
    n = new.select("path", F.col("hash").alias("new_hash"), F.lit(1).alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "same").otherwise("changed")
    return o.join(n, "path", "full_outer").select("path", change.alias("change"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


class ConcurrentWrite(RuntimeError):
    """Another writer has published a state in the meantime."""


def bucket_of(path: str | Column = "path") -> Column:
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


def bucket_of_id(column: str) -> Column:
    return F.pmod(F.col(column), F.lit(BUCKETS)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._files = Files(spark, self.root)

    # -- pointer ---------------------------------------------------------------------------------

    def _state(self) -> tuple[int, dict]:
        """(number of the newest pointer, what it names: table -> bucket -> folder)."""
        numbers = [int(n) for n in self._files.names("pointers") if n.isdigit()]
        if not numbers:
            return 0, {}
        return max(numbers), json.loads(self._files.read(f"pointers/{max(numbers):012d}"))

    def _publish(self, number: int, pointer: dict) -> None:
        if not self._files.publish(f"pointers/{number + 1:012d}", json.dumps(pointer)):
            raise ConcurrentWrite(f"state {number + 1} is taken")

    def _read(self, name: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*[f"{self.root}/{f}" for f in folders])

    def table(self, name: str) -> DataFrame:
        return self._read(name, list(self._state()[1].get(name, {}).values()))

    def write(self, **tables: DataFrame) -> None:
        """New versions of some tables, visible together."""
        number, pointer = self._state()
        for name, df in tables.items():
            pointer[name] = self._store(name, df)
        self._publish(number, pointer)

    def _store(self, name: str, df: DataFrame) -> dict[str, str]:
        """Write rows to a new folder; bucket -> folder.  Rows with a column ``bucket`` stand together by it already."""
        version = f"{name}/v-{uuid.uuid4().hex}"
        empty = self.spark.createDataFrame([], TABLES[name])
        rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in empty.schema.fields])
        if name not in ID:
            rows.write.parquet(f"{self.root}/{version}")
            return {"": version}
        key = "file_id" if name == "files" else CHILDREN[name]
        rows = df.select(*rows.columns, "bucket") if "bucket" in df.columns else rows.withColumn("bucket", bucket_of_id(key)).repartition("bucket")
        rows.sortWithinPartitions("bucket", ID[name]).write.partitionBy("bucket").parquet(f"{self.root}/{version}")
        return {n.partition("=")[2]: f"{version}/{n}" for n in self._files.names(version) if n.startswith("bucket=")}

    def drop_folder(self, name: str) -> None:
        self._files.delete(name)

    def vacuum(self) -> None:
        """Delete folders that no kept pointer names, and old pointers."""
        numbers = sorted(n for n in self._files.names("pointers") if n.isdigit())
        for n in numbers[: -KEPT_POINTERS]:
            self._files.delete(f"pointers/{n}")
        live = {"/".join(f.split("/")[:2]) for n in numbers[-1:] for fs in json.loads(self._files.read(f"pointers/{n}")).values() for f in fs.values()}
        for name in TABLES:
            for version in self._files.names(name):
                if f"{name}/{version}" not in live:
                    self._files.delete(f"{name}/{version}")

    # -- files and what hangs on them --------------------------------------------------------------

    def changes(self, files: DataFrame) -> DataFrame:
        return snapshot_diff(self.table("files"), files.withColumn("hash", content_hash()))

    def _touched(self, pointer: dict, name: str, buckets: set[str]) -> DataFrame:
        return self._read(name, [f for b, f in pointer.get(name, {}).items() if b in buckets])

    def _replaced(self, pointer: dict, buckets: set[str], tables: dict[str, DataFrame]) -> dict:
        """The pointer with the touched buckets of some tables written anew."""
        out = dict(pointer)
        for name, df in tables.items():
            out[name] = {b: f for b, f in pointer.get(name, {}).items() if b not in buckets} | self._store(name, df)
        return out

    def _merged(self, old: DataFrame, ids: DataFrame, new: DataFrame | None = None) -> DataFrame:
        """Rows of ``old`` whose path is not in ``ids``, and of ``new`` one for each path, with its id; dealt out by bucket.

        All come to their bucket once and meet there, so texts are exchanged once, and not for each join.
        """
        columns = old.columns
        parts = [(1, old), (0, ids.select("path", *[F.col(c) for c in ids.columns if c == "file_id"]))] + ([(2, new)] if new is not None else [])
        both = None
        for side, rows in parts:
            rows = rows.withColumn("side", F.lit(side))
            both = rows if both is None else both.unionByName(rows, allowMissingColumns=True)
        path = Window.partitionBy("bucket", "path")
        rows = both.withColumn("bucket", bucket_of()).repartition("bucket")
        rows = rows.withColumn("named", F.min("side").over(path) == 0).withColumn("given", F.max(F.when(F.col("side") == 0, F.col("file_id"))).over(path))
        rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("bucket", "path", "side").orderBy("hash")))
        rows = rows.filter(((F.col("side") == 1) & ~F.col("named")) | ((F.col("side") == 2) & (F.col("nth") == 1)))
        return rows.withColumn("file_id", F.when(F.col("side") == 2, F.col("given")).otherwise(F.col("file_id"))).select(*columns, "bucket")

    def _numbered(self, name: str, rows: DataFrame, old: DataFrame, order: list[str]) -> DataFrame:
        """Rows of (bucket, ...) with ids behind those of ``old``: dense in each bucket, in ``order``, and equal to the bucket modulo BUCKETS."""
        own = ID[name]
        top = old.groupBy(bucket_of_id(own).alias("bucket")).agg(F.max(F.expr(f"{own} div {BUCKETS}")).alias("top"))  # a row for each bucket
        within = F.row_number().over(Window.partitionBy("bucket").orderBy(*order))
        rows = rows.withColumn("nth", within).join(F.broadcast(top), "bucket", "left")
        return rows.withColumn(own, (F.coalesce("top", F.lit(0)) + F.col("nth")) * BUCKETS + F.col("bucket")).drop("nth", "top", "bucket")

    def replace_files(self, files: DataFrame, **children: DataFrame) -> None:
        """Upsert files by path with fresh ids; their old children go, the given ones (by ``path``) come."""
        number, pointer = self._state()
        paths = files.select("path").distinct().withColumn("bucket", bucket_of())
        buckets = {str(r["bucket"]) for r in paths.select("bucket").distinct().collect()}  # BUCKETS at most
        if not buckets:
            return
        old = self._touched(pointer, "files", buckets)
        # written once, as ids are read several times
        staged = f".ids/{uuid.uuid4().hex}"
        self._numbered("files", paths, old, ["path"]).write.parquet(f"{self.root}/{staged}")
        ids = self.spark.read.schema("path string, file_id long").parquet(f"{self.root}/{staged}")
        new = files.withColumn("hash", content_hash()).withColumn("indexed_at", F.lit(int(time.time())))
        new = new.select(*[c for c in new.columns if c in old.columns and c != "file_id"])
        gone = old.join(ids, "path", "left_semi").select("file_id")
        out = {"files": self._merged(old, ids, new)}
        for name, key in CHILDREN.items():
            before = self._touched(pointer, name, buckets)
            kept = before.join(gone.withColumnRenamed("file_id", key), key, "left_anti")
            if name in children:
                rows = children[name].join(ids.withColumnRenamed("file_id", key), "path").drop("path").withColumn("bucket", bucket_of_id(key))
                # a file's rows stand together and in order, so their ids do too
                order = [c for c in (key, "start_line", "end_line", *sorted(set(rows.columns) - {key, "bucket", "embedding", "symbols"})) if c in rows.columns]
                kept = kept.unionByName(self._numbered(name, rows, before, list(dict.fromkeys(order))), allowMissingColumns=True)
            out[name] = kept
        self._publish(number, self._replaced(pointer, buckets, out))
        self._files.delete(staged)

    def delete_files(self, paths: DataFrame) -> None:
        number, pointer = self._state()
        buckets = {str(r["b"]) for r in paths.select(bucket_of().alias("b")).distinct().collect()}
        old = self._touched(pointer, "files", buckets)
        gone = old.join(paths.select("path"), "path", "left_semi").select("file_id")
        out = {name: self._touched(pointer, name, buckets).join(gone.withColumnRenamed("file_id", key), key, "left_anti") for name, key in CHILDREN.items()}
        self._publish(number, self._replaced(pointer, buckets, {"files": self._merged(old, paths), **out}))

    def set_embeddings(self, embedded: DataFrame) -> None:
        """(chunk_id, embedding) into chunks; other chunks keep theirs."""
        number, pointer = self._state()
        buckets = {str(r["b"]) for r in embedded.select(bucket_of_id("chunk_id").alias("b")).distinct().collect()}
        new = embedded.select("chunk_id", F.col("embedding").alias("new"))
        chunks = self._touched(pointer, "chunks", buckets).join(new, "chunk_id", "left")
        self._publish(number, self._replaced(pointer, buckets, {"chunks": chunks.withColumn("embedding", F.coalesce("new", "embedding")).drop("new")}))

    def clear(self) -> None:
        """Files and all that hangs on them; observations and calibrations stay."""
        number, pointer = self._state()
        self._publish(number, {n: f for n, f in pointer.items() if n not in ID})

    def needs_reindex(self, path: str, content: str) -> bool:
        import hashlib

        row = self.table("files").filter(F.col("path") == path).select("hash").first()
        return row is None or row["hash"] != hashlib.sha256(content.encode()).hexdigest()

    # -- versions ----------------------------------------------------------------------------------

    def metadata(self, key: str) -> str | None:
        row = self.table("metadata").filter(F.col("key") == key).first()
        return row["value"] if row else None

    def set_metadata(self, key: str, value: str) -> None:
        new = self.spark.createDataFrame([(key, value)], TABLES["metadata"])
        self.write(metadata=upsert(self.table("metadata"), new, KEYS["metadata"]))

    def needs_full_reindex(self) -> bool:
        value = self.metadata("parser_version")
        return value is None or not value.lstrip("+-").isdigit() or int(value) != C.PARSER_VERSION

    def prepare_for_reindex(self) -> bool:
        """Whether all must be indexed anew; if so the tables are emptied and the version is set."""
        if not self.needs_full_reindex():
            return False
        self.clear()
        self.set_metadata("parser_version", str(C.PARSER_VERSION))
        return True

    # -- lookups -----------------------------------------------------------------------------------

    def file(self, path: str) -> DataFrame:
        return self.table("files").filter(F.col("path") == path)

    def of_file(self, name: str, file_id: int) -> DataFrame:
        rows = self.table(name).filter(F.col(CHILDREN[name]) == file_id)
        return rows.orderBy("start_line", "symbol_id") if name == "symbols" else rows

    def symbols_named(self, name: str) -> DataFrame:
        return self.table("symbols").filter(F.col("name") == name)

    def chunks_by_ids(self, ids: DataFrame) -> DataFrame:
        return self.table("chunks").join(ids.select("chunk_id"), "chunk_id", "left_semi").orderBy("chunk_id")

    def chunks_without_embedding(self, limit: int) -> DataFrame:
        return self.table("chunks").filter("embedding is null").orderBy("chunk_id").limit(limit)

    def chunks_with_embedding(self) -> DataFrame:
        return self.table("chunks").filter("embedding is not null").join(self.table("files").select("file_id", "path", "language"), "file_id")

    # -- feedback ----------------------------------------------------------------------------------

    def add_observations(self, rows: DataFrame) -> int:
        """Insert, first one wins; the number of rows that came in."""
        old = self.table("observations")
        before = old.count()
        self.write(observations=old.unionByName(calibration.first_observations(rows, old)))
        return self.table("observations").count() - before

    def age_out(self, max_age: int = C.MAX_AGE_SECONDS, now: int | None = None) -> int:
        old = self.table("observations")
        before = old.count()
        self.write(observations=calibration.aged(old, int(time.time()) if now is None else now, max_age))
        return before - self.table("observations").count()

    def save_calibrations(self, rows: DataFrame, now: int | None = None) -> None:
        new = rows.withColumn("calibrated_at", F.lit(int(time.time()) if now is None else now))
        old = self.table("calibrations")
        self.write(calibrations=upsert(old, new.select(*old.columns), KEYS["calibrations"]))

    def clear_calibrations(self) -> None:
        self.write(calibrations=self.spark.createDataFrame([], TABLES["calibrations"]))
