"""The driver's tables in the shape of the engine's, as frames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "de", ".rs").when(F.col("lang") == "fr", ".md").otherwise("")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("path"), F.col("text").alias("content"), F.col("lang").alias("language"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in C.SYMBOL_KINDS])
    size = F.col("p_size").cast("long")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("symbol_id"), (F.col("p_partkey") % 200).alias("file_id"), F.col("p_name").alias("name"), kinds[(F.col("p_partkey") % len(C.SYMBOL_KINDS)).cast("int")].alias("kind"),
        size.alias("start_line"), (size + 2).alias("end_line"), F.concat_ws(" ", "p_type", "p_brand").alias("signature"), F.when(size >= 10, F.col("p_brand")).alias("doc_comment"), F.col("p_brand").alias("parent"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.when(F.col("label") % 3 == 0, ".json").when(F.col("label") % 3 == 1, ".py").otherwise("")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.concat(F.lit("c/"), F.col("vec_id").cast("string"), ext).alias("path"), F.concat(F.lit("lang"), F.col("label").cast("string")).alias("language"),
        F.lit(1).cast("long").alias("start_line"), F.col("vec_id").alias("end_line"), F.concat(F.lit("chunk "), F.col("vec_id").cast("string")).alias("content"), "embedding")


def deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("pos", "target_path"))
    return pages.select((F.col("page_id") * 1000 + F.col("pos")).alias("dep_id"), F.col("page_id").alias("source_file_id"), "target_path", F.element_at(F.split("target_path", "/"), -1).alias("import_name"), F.lit("external").alias("kind"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), F.col("url").alias("path"), F.col("html").alias("content"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("language"), (F.col("value") / 100).alias("distance"), F.col("user_id").alias("query_hash"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"))


KINDS_SQL = "[" + ", ".join(f"'{k}'" for k in C.SYMBOL_KINDS) + "]"
SQL = f"""
files AS (SELECT doc_id AS file_id, source || '/' || doc_id || CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.rs' WHEN 'fr' THEN '.md' ELSE '' END AS path, text AS content, lang AS language FROM documents),
symbols AS (SELECT p_partkey AS symbol_id, p_partkey % 200 AS file_id, p_name AS name, {KINDS_SQL}[p_partkey % {len(C.SYMBOL_KINDS)} + 1] AS kind, p_size::BIGINT AS start_line, p_size::BIGINT + 2 AS end_line,
  p_type || ' ' || p_brand AS signature, CASE WHEN p_size >= 10 THEN p_brand END AS doc_comment, p_brand AS parent FROM part),
chunks AS (SELECT vec_id AS chunk_id, 'c/' || vec_id || CASE label % 3 WHEN 0 THEN '.json' WHEN 1 THEN '.py' ELSE '' END AS path, 'lang' || label AS language, 1::BIGINT AS start_line, vec_id AS end_line, 'chunk ' || vec_id AS content,
  [x::DOUBLE FOR x IN embedding] AS embedding FROM embeddings),
hrefs AS (SELECT page_id, unnest(hs) AS target_path, unnest(range(len(hs))) AS pos FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS hs FROM pages)),
deps AS (SELECT page_id * 1000 + pos AS dep_id, page_id AS source_file_id, target_path, string_split(target_path, '/')[-1] AS import_name, 'external' AS kind FROM hrefs),
page_files AS (SELECT page_id AS file_id, url AS path, html AS content FROM pages),
observations AS (SELECT event_type AS language, value / 100 AS distance, user_id AS query_hash, floor(epoch(ts))::BIGINT AS ts FROM events)"""

_EDGE = r"[\s\x0B\x{85}\p{Z}]+"


def trim_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^{_EDGE}|{_EDGE}$', '', 'g')"


def lines_sql(x: str) -> str:
    parts = rf"string_split_regex(coalesce({x}, ''), '\r?\n')"
    return f"CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END"


def numbered_sql(source: str, columns: str, content: str = "content") -> str:
    """CTE numbered(columns, line_number, line) of trimmed, searchable lines."""
    return f"""
split AS (SELECT {columns}, {lines_sql(content)} AS ls FROM {source}),
raw AS (SELECT {columns}, unnest(range(1, len(ls) + 1)) AS line_number, unnest(ls) AS raw FROM split),
numbered AS (SELECT {columns}, line_number, line FROM (SELECT *, {trim_sql("raw")} AS line FROM raw) WHERE line <> '' AND NOT starts_with(line, '//') AND NOT starts_with(line, '#'))"""


def line_score_sql(line: str, term: str) -> str:
    low, want = f"lower({line})", f"lower('{term}')"
    at = f"strlen(substr({low}, 1, greatest(0, instr({low}, {want}) - 1)))"
    edge = f"({at} = 0 OR NOT regexp_matches(substr({line}, {at}, 1), '[\\p{{L}}\\p{{N}}]'))"
    return f"least(1.0::DOUBLE, (CASE WHEN {low} = {want} THEN 0.9 WHEN {edge} THEN 0.7 ELSE 0.5 END)::DOUBLE * (1.0::DOUBLE - {at}::DOUBLE / (strlen({line}) + 10)::DOUBLE * 0.2::DOUBLE))"


def symbol_score_sql(name: str, term: str, kind: str) -> str:
    low, want = f"lower({name})", f"lower({term})"
    boost = "CASE " + " ".join(f"WHEN {kind} = '{k}' THEN {v}" for k, v in C.KIND_BOOST.items()) + " ELSE 1.0 END"
    base = f"CASE WHEN {low} = {want} THEN 1.0 WHEN starts_with({low}, {want}) THEN 0.85 WHEN contains({low}, {want}) THEN 0.7 ELSE 0.5 END"
    return f"least(1.0::DOUBLE, ({base})::DOUBLE * ({boost})::DOUBLE * (1.0::DOUBLE + 1.0::DOUBLE / (strlen({name}) + 5)::DOUBLE))"


def norm_sql(x: str) -> str:
    return rf"' ' || array_to_string([t FOR t IN string_split_regex(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}]+') IF t <> ''], ' ')"


def ext_sql(path: str) -> str:
    return rf"lower(regexp_extract({path}, '[^/.][^/]*\.([^./]+)$', 1))"


EXCLUDED_EXT_SQL = "(" + ", ".join(f"'{x}'" for x in C.EXCLUDED_EXTENSIONS) + ")"
EXCLUDED_DIRS_SQL = "[" + ", ".join(f"'{x}'" for x in C.EXCLUDED_DIRS) + "]"
