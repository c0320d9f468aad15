"""All registered queries, by name, and the SQL that each must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import expansion, scoring, text
from ..operators import calibration, navigation, parsing, retrieval
from ..operators.retrieval import SearchOptions
from ..session import scratch_root
from ..sources import store
from ..streaming import changes
from . import model as M

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, ctes: str = ""):
    """Register a query under its function's name; ``sql`` may read the model's tables and ``ctes``."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = f"WITH {M.SQL}{',' + ctes if ctes else ''}\n{sql}"
        return function

    return add


# -- lines (R4-R8, X8) -----------------------------------------------------------------------------------


def _line_sql(term: str, test: str) -> str:
    return f"SELECT file_id, line_number, line, round({M.line_score_sql('line', term)}, {C.DIGITS}) AS score FROM numbered WHERE {test}"


def _lines(spark, d, pattern, mode):
    return retrieval.line_search(M.files(spark, d).select("file_id", "content"), pattern, mode).select("file_id", "line_number", "line", "score")


@query(_line_sql("the", "contains(lower(line), 'the')"), M.numbered_sql("files", "file_id"))
def line_search_scored(spark, d):
    return _lines(spark, d, "the", "literal")


@query(_line_sql("was", r"regexp_matches(line, '(?i)\bwas\b')"), M.numbered_sql("files", "file_id"))
def line_search_word(spark, d):
    return _lines(spark, d, "was", "word")


@query(_line_sql("an[sd]+ th", "regexp_matches(line, '(?i)an[sd]+ th')"), M.numbered_sql("files", "file_id"))
def line_search_regex(spark, d):
    return _lines(spark, d, "an[sd]+ th", "regex")


@query(f"SELECT conv_id, turn, line_number, line, round({M.line_score_sql('line', 'and')}, {C.DIGITS}) AS score FROM numbered WHERE contains(lower(line), 'and')", M.numbered_sql("conversations", "conv_id, turn", "text"))
def line_search_dialogue(spark, d):
    rows = M.table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("content"))
    return retrieval.line_search(rows, "and").select("conv_id", "turn", "line_number", "line", "score")


_TERMS = ["thenin", "heen", "und"]
_OWNER = "CASE " + " ".join(f"WHEN contains(lower(line), '{t}') THEN {k}" for k, t in enumerate(_TERMS)) + " END"
_OWNED = "CASE " + " ".join(f"WHEN contains(lower(line), '{t}') THEN {M.line_score_sql('line', t)}" for t in _TERMS) + " END"


def _text_ctes(limit: int, terms_owner: str = _OWNER, terms_score: str = _OWNED) -> str:
    return f"""{M.numbered_sql("files", "path")},
matches AS (SELECT * FROM (SELECT path, line_number, line, {terms_owner} AS term_ord, round({terms_score}, {C.DIGITS}) AS score FROM numbered) WHERE term_ord IS NOT NULL AND {M.ext_sql("path")} NOT IN ('') AND {M.ext_sql("path")} NOT IN {M.EXCLUDED_EXT_SQL}),
text_rows AS (SELECT 2 AS strategy, 'text_match' AS kind, path, line_number AS start_line, line_number AS end_line, score, line AS content, NULL::VARCHAR AS symbol_name, NULL::VARCHAR AS symbol_kind, term_ord, row_number() OVER (ORDER BY path, score DESC, term_ord, line_number) AS row_ord FROM matches
  QUALIFY row_ord <= {limit})"""


@query("SELECT path, start_line, term_ord, score, content, row_ord FROM text_rows", _text_ctes(50))
def text_strategy_topk(spark, d):
    return retrieval.text_strategy(M.files(spark, d), _TERMS, 50).select("path", "start_line", "term_ord", "score", "content", "row_ord")


@query("SELECT file_id, line_number, term_ord, score FROM (SELECT file_id, line_number, " + _OWNER + " AS term_ord, round(" + _OWNED + f", {C.DIGITS}) AS score FROM numbered) WHERE term_ord IS NOT NULL", M.numbered_sql("files", "file_id"))
def text_term_matches(spark, d):
    return retrieval.term_matches(M.files(spark, d).select("file_id", "content"), _TERMS).select("file_id", "line_number", "term_ord", "score")


# -- symbols (R2, R3, X7) -----------------------------------------------------------------------------------

_FTS = " OR ".join(f"contains({M.norm_sql(c)}, ' red wi')" for c in ("name", "signature", "doc_comment"))


@query(f"SELECT symbol_id, name, signature FROM symbols WHERE {_FTS} ORDER BY symbol_id LIMIT {C.FTS_CAP}")
def fts_phrase_prefix(spark, d):
    return retrieval.fts_match(M.symbols(spark, d), "red wi").select("symbol_id", "name", "signature")


@query(f"SELECT symbol_id, round({M.symbol_score_sql('name', repr('red'), 'kind')}, {C.DIGITS}) AS score FROM symbols")
def symbol_score(spark, d):
    return M.symbols(spark, d).select("symbol_id", F.round(scoring.symbol_score(F.col("name"), F.lit("red"), F.col("kind")), C.DIGITS).alias("score"))


def _symbol_ctes(terms: list[str], limit: int, filters: str = "TRUE") -> str:
    values = ", ".join(f"({k}, '{t}', '{retrieval.phrase(t)}')" for k, t in enumerate(terms))
    hit = " OR ".join(f"contains({M.norm_sql(c)}, want)" for c in ("name", "signature", "doc_comment"))
    return f"""
terms(ord, term, want) AS (VALUES {values}),
ranked AS (SELECT s.*, t.*, row_number() OVER (PARTITION BY ord ORDER BY symbol_id) AS rank FROM symbols s, terms t WHERE want <> '' AND ({hit})),
symbol_rows AS (SELECT 1 AS strategy, 'symbol' AS kind, path, start_line, end_line, round({M.symbol_score_sql("name", "term", "kind")}, {C.DIGITS}) AS score, coalesce(signature, name) AS content, name AS symbol_name, kind AS symbol_kind, ord AS term_ord, symbol_id AS row_ord
  FROM (SELECT * FROM ranked WHERE rank <= {limit}) JOIN (SELECT file_id, path FROM files) USING (file_id) WHERE {M.ext_sql("path")} NOT IN {M.EXCLUDED_EXT_SQL} AND {filters})"""


@query("SELECT path, start_line, score, content, symbol_name, symbol_kind, term_ord, row_ord FROM symbol_rows", _symbol_ctes(["red", "small ring", "blue b"], 40, "kind IN ('function', 'class', 'type')"))
def symbol_strategy_topk(spark, d):
    options = SearchOptions(symbol_kinds=("function", "Class", "type"))
    return retrieval.symbol_strategy(M.symbols(spark, d), M.files(spark, d), ["red", "small ring", "blue b"], 40, options).select("path", "start_line", "score", "content", "symbol_name", "symbol_kind", "term_ord", "row_ord")


# -- vectors (V1, V2, V7, R14, X6, F8) -------------------------------------------------------------------------

_Q = "q AS (SELECT embedding AS v FROM chunks WHERE chunk_id = 7)"
_NEAR = f"{_Q}, near AS (SELECT c.*, round(list_distance(embedding, v), 6) AS distance FROM chunks c, q)"


def _vector(spark, d, vec_id: int = 7):
    row = M.table(spark, d, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()  # one row
    return retrieval.vector(row["embedding"])


@query("SELECT chunk_id, distance FROM near ORDER BY distance, chunk_id LIMIT 20", _NEAR)
def knn_l2(spark, d):
    return retrieval.knn(M.chunks(spark, d), _vector(spark, d), 20).select("chunk_id", "distance")


@query("SELECT chunk_id, abs(round(1 - list_cosine_similarity(embedding, v), 6)) AS distance FROM chunks, q ORDER BY distance, chunk_id LIMIT 20", _Q)
def knn_cosine(spark, d):
    return retrieval.knn(M.chunks(spark, d), _vector(spark, d), 20, "cosine").select("chunk_id", "distance")


@query("""SELECT query_id, chunk_id, distance FROM (SELECT q.chunk_id AS query_id, c.chunk_id, round(list_distance(c.embedding, q.embedding), 6) AS distance FROM chunks c, chunks q WHERE q.chunk_id % 20 = 0)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) <= 10""")
def knn_batch(spark, d):
    """The query set is every vector whose id is divisible by 20, against all vectors."""
    queries = M.chunks(spark, d).filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    return retrieval.knn_batch(M.chunks(spark, d), queries, 10)


def _semantic_ctes(limit: int, far: float, least: float) -> str:
    return f"""{_NEAR},
wide AS (SELECT *, round(1 / (1 + distance), 6) AS score FROM near ORDER BY distance, chunk_id LIMIT {2 * limit}),
semantic AS (SELECT 0 AS strategy, 'semantic_match' AS kind, path, start_line, end_line, score, content, NULL::VARCHAR AS symbol_name, NULL::VARCHAR AS symbol_kind, 0 AS term_ord, chunk_id AS row_ord FROM wide
  WHERE distance < {far} AND score >= {least} AND {M.ext_sql("path")} NOT IN {M.EXCLUDED_EXT_SQL} ORDER BY distance, chunk_id LIMIT {limit})"""


@query("SELECT path, score, content, row_ord FROM semantic", _semantic_ctes(30, 1.3, 0.3))
def semantic_filter(spark, d):
    return retrieval.semantic_strategy(M.chunks(spark, d), _vector(spark, d), 30, 1.3, 0.3).select("path", "score", "content", "row_ord")


@query("SELECT language, count(*) AS count FROM (SELECT language FROM near ORDER BY distance, chunk_id LIMIT 5) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1", _NEAR)
def dominant_label(spark, d):
    return retrieval.dominant_language(retrieval.knn(M.chunks(spark, d), _vector(spark, d), 10))


@query("SELECT query_hash, ts, round(1 / (1 + distance), 6) AS similarity, round(1 / (1 / (1 + distance)) - 1, 6) AS back FROM observations")
def distance_similarity(spark, d):
    sim = scoring.similarity(F.col("distance"))
    return M.observations(spark, d).select("query_hash", "ts", F.round(sim, 6).alias("similarity"), F.round(scoring.distance_of(sim), 6).alias("back"))


# -- fusion (R1) ------------------------------------------------------------------------------------------------

_HYBRID = expansion.all_terms("red")


@query("""SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY path, start_line, end_line ORDER BY score DESC, strategy, term_ord, row_ord) AS place FROM both_) WHERE place = 1 AND score >= 0.35
ORDER BY score DESC, strategy, term_ord, row_ord LIMIT 100""", _semantic_ctes(100, 1.2, 0.3) + "," + _symbol_ctes(["red"], 100) + "," + _text_ctes(100, "CASE WHEN contains(lower(line), 'red') THEN 0 END", M.line_score_sql("line", "red")) + """,
first_ AS (SELECT * FROM semantic UNION ALL SELECT * FROM symbol_rows),
both_ AS (SELECT * FROM first_ UNION ALL SELECT * FROM text_rows WHERE row_ord <= greatest(0, 100 - (SELECT count(*) FROM first_)))""")
def hybrid_search(spark, d):
    return retrieval.hybrid_search(M.files(spark, d), M.symbols(spark, d), "red", 100, chunks=M.chunks(spark, d), embedding=_vector(spark, d))


# -- navigation (R9-R13) -------------------------------------------------------------------------------------------


@query(f"""SELECT * FROM (SELECT 0 AS part, 'symbol' AS kind, path, start_line, end_line, 1.0::DOUBLE AS score, array_to_string(({M.lines_sql('content')})[start_line : end_line], chr(10)) AS content, symbol_id AS row_ord FROM symbols JOIN files USING (file_id) WHERE name = 'red ring'
UNION ALL SELECT 1, 'reference', path, start_line, end_line, score, content, row_ord FROM text_rows t WHERE NOT EXISTS (SELECT 1 FROM symbols s JOIN files f USING (file_id) WHERE s.name = 'red ring' AND f.path = t.path AND s.start_line = t.start_line))
ORDER BY part, row_ord LIMIT 200""", _text_ctes(200, "CASE WHEN contains(lower(line), 'red ring') THEN 0 END", M.line_score_sql("line", "red ring")))
def find_refs(spark, d):
    return navigation.find_refs(M.files(spark, d), M.symbols(spark, d), "red ring", 200)


@query("SELECT dep_id, target_path, import_name, kind FROM deps WHERE source_file_id = (SELECT min(file_id) FROM page_files WHERE path = (SELECT path FROM page_files WHERE file_id = 5))")
def deps_imports(spark, d):
    path = M.page_files(spark, d).filter("file_id = 5").first()["path"]
    return navigation.imports_of(M.page_files(spark, d), M.deps(spark, d), path)


@query(r"SELECT dep_id, path AS source_path, target_path, import_name, kind FROM deps JOIN (SELECT file_id AS source_file_id, path FROM page_files) USING (source_file_id) WHERE ends_with(target_path, 'the.html') OR ends_with(lower(target_path), 'the')")
def deps_dependents(spark, d):
    return navigation.dependents_of(M.page_files(spark, d), M.deps(spark, d), "site/the.html")


@query(r"""SELECT DISTINCT path, dep_id FROM names JOIN deps ON ends_with(target_path, name) OR (stem <> '' AND ends_with(lower(target_path), stem)) WHERE name <> ''""",
       r"""names AS (SELECT path, name, lower(CASE WHEN instr(substr(name, 2), '.') > 0 THEN regexp_replace(name, '\.[^.]*$', '') ELSE name END) AS stem FROM (SELECT path, regexp_extract(path, '[^/]*$', 0) AS name FROM (SELECT DISTINCT 'site' || target_path || '.html' AS path FROM deps)))""")
def all_dependents(spark, d):
    sites = M.deps(spark, d).select(F.concat(F.lit("site"), "target_path", F.lit(".html")).alias("path")).distinct()
    return navigation.all_dependents(sites, M.deps(spark, d))


@query("""SELECT src, dst, min(hops)::INTEGER AS hops FROM (SELECT src, dst, 1 AS hops FROM e UNION ALL SELECT a.src, b.dst, 2 FROM e a JOIN e b ON a.dst = b.src UNION ALL SELECT a.src, c.dst, 3 FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src) GROUP BY 1, 2""",
       "e AS (SELECT DISTINCT target_path AS src, lead(target_path) OVER (PARTITION BY source_file_id ORDER BY dep_id) AS dst FROM deps QUALIFY dst IS NOT NULL)")
def transitive_imports(spark, d):
    """Edges from each link of a page to the next one on it."""
    after = F.lead("target_path").over(Window.partitionBy("source_file_id").orderBy("dep_id"))
    edges = M.deps(spark, d).select(F.col("target_path").alias("src"), after.alias("dst")).filter("dst is not null")
    return navigation.transitive_imports(edges.distinct(), 3)


@query(f"""SELECT 'red ring' AS name, (SELECT count(*) FROM firsts) > 0 AS found, (SELECT count(*) FROM firsts) AS n_definitions,
coalesce((SELECT string_agg(name, '|' ORDER BY name) FROM (SELECT DISTINCT name FROM symbols WHERE file_id IN (SELECT file_id FROM firsts) AND name <> 'red ring')), '') AS related,
greatest(0, (SELECT count(*) FROM (SELECT 1 FROM symbols WHERE {_FTS.replace(' red wi', ' red ring')} LIMIT 100)) - (SELECT count(*) FROM firsts)) AS usage_count""",
       "firsts AS (SELECT * FROM symbols WHERE name = 'red ring' ORDER BY symbol_id LIMIT 20)")
def explain_symbol(spark, d):
    row = navigation.explain_symbol(M.files(spark, d), M.symbols(spark, d), "red ring")
    return row.select("name", "found", F.size("definitions").cast("long").alias("n_definitions"), F.array_join("related", "|").alias("related"), "usage_count")


@query("SELECT 'files' AS table_name, count(*) AS n FROM files UNION ALL SELECT 'symbols', count(*) FROM symbols UNION ALL SELECT 'chunks', count(*) FROM chunks UNION ALL SELECT 'dependencies', count(*) FROM deps")
def index_stats(spark, d):
    return navigation.index_stats(M.files(spark, d), M.symbols(spark, d), M.chunks(spark, d), M.deps(spark, d))


# -- query expansion (X1-X5) ----------------------------------------------------------------------------------------

#: Identifiers of two words in four spellings, from the names of parts ("red ring"), and what they expand to.
_SPELLED = """
words AS (SELECT p_partkey, p_partkey % 4 AS form, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b FROM part),
forms AS (SELECT *, upper(a[1]) || a[2:] AS aa, upper(b[1]) || b[2:] AS bb FROM words),
terms AS (SELECT p_partkey, CASE form WHEN 0 THEN a || '_' || b WHEN 1 THEN a || bb WHEN 2 THEN aa || bb ELSE a || '-' || b END AS term,
  CASE form WHEN 0 THEN [a || bb, aa || bb] WHEN 1 THEN [a || '_' || b] WHEN 2 THEN [a || '_' || b, a || bb] ELSE [a || '_' || b, a || bb] END AS variants FROM forms)"""


def _spelled(spark, d) -> DataFrame:
    a, b = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    form = F.col("p_partkey") % 4
    term = F.when(form == 0, F.concat(a, F.lit("_"), b)).when(form == 1, F.concat(a, F.initcap(b))).when(form == 2, F.concat(F.initcap(a), F.initcap(b))).otherwise(F.concat(a, F.lit("-"), b))
    return M.table(spark, d, "part").select("p_partkey", term.alias("term"))


@query("""SELECT p_partkey, term || ' ' || term AS query, array_to_string(list_filter([variants[1], CASE WHEN lower(variants[2]) <> lower(variants[1]) THEN variants[2] END], lambda v: lower(v) <> lower(term || ' ' || term)), ',') AS terms FROM terms""", _SPELLED)
def expand_query(spark, d):
    """Each identifier twice in a query: what only repeats in another case is left out."""
    rows = _spelled(spark, d).select("p_partkey", F.concat_ws(" ", "term", "term").alias("query"))
    return rows.select("p_partkey", "query", F.array_join(expansion.expand_col(F.col("query")), ",").alias("terms"))


@query("SELECT p_partkey, term, array_to_string(variants, ',') AS variants FROM terms", _SPELLED)
def case_variants(spark, d):
    return _spelled(spark, d).select("p_partkey", "term", F.array_join(expansion.variants_col(F.col("term")), ",").alias("variants"))


# -- observations and calibration (M9, M10, K1-K6) -------------------------------------------------------------------


@query("SELECT query_hash, language, (min({'ts': ts, 'd': distance})).ts AS ts, round((min({'ts': ts, 'd': distance})).d, 6) AS distance FROM observations GROUP BY 1, 2")
def observations_dedup(spark, d):
    return calibration.first_observations(M.observations(spark, d)).select("query_hash", "language", "ts", F.round("distance", 6).alias("distance"))


@query("SELECT language, query_hash, ts, round(distance, 6) AS distance FROM observations WHERE ts >= 1706000000 - 604800")
def observations_aged(spark, d):
    return calibration.aged(M.observations(spark, d), 1706000000, 604800).select("language", "query_hash", "ts", F.round("distance", 6).alias("distance"))


@query("SELECT event_id AS query_no, event_type FROM events WHERE event_id % 10 = 0")
def observations_sampled(spark, d):
    return calibration.sampled(M.table(spark, d, "events").select(F.col("event_id").alias("query_no"), "event_type"))


_QUANTILES = ", ".join(f"round(quantile_cont(distance, {p}), 6) AS p{int(p * 100)}" for p in calibration.PERCENTILES)


@query(f"SELECT language, count(*) AS n, round(avg(distance), 6) AS mean, round(stddev_pop(distance), 6) AS std, round(min(distance), 6) AS min, round(max(distance), 6) AS max, {_QUANTILES} FROM observations GROUP BY 1")
def distance_stats(spark, d):
    return calibration.distance_stats(M.observations(spark, d))


_LEVEL = "CASE WHEN n < 100 THEN 'none' WHEN n < 500 THEN 'low' WHEN n < 2000 THEN 'medium' ELSE 'high' END"
_CALIBRATED = f"""stats AS (SELECT CASE WHEN grouping(language) = 1 THEN '_global' ELSE language END AS language, count(*) AS n, avg(distance) AS mean, stddev_pop(distance) AS std, {', '.join(f'quantile_cont(distance, {p}) AS p{int(p * 100)}' for p in calibration.PERCENTILES)} FROM observations GROUP BY ROLLUP (language)),
calibrated AS (SELECT language, round(least(3.0, greatest(0.5, p90)), 6) AS max_distance, round(least(0.8, greatest(0.1, 1 / (1 + p10))), 6) AS min_similarity, {_LEVEL} AS confidence, n AS sample_count, round(p50, 6) AS p50, round(p90, 6) AS p90, round(p95, 6) AS p95, round(mean, 6) AS mean, round(std, 6) AS std FROM stats WHERE n >= 100)"""


@query("SELECT * FROM calibrated", _CALIBRATED)
def calibrate_all(spark, d):
    return calibration.calibrate(M.observations(spark, d))


@query("""SELECT l.language, coalesce(o.max_distance, g.max_distance, 1.2) AS max_distance, coalesce(o.min_similarity, g.min_similarity, 0.3) AS min_similarity FROM (SELECT DISTINCT language FROM observations UNION ALL SELECT 'unseen') l
LEFT JOIN (SELECT * FROM calibrated WHERE confidence IN ('medium', 'high') AND language <> '_global') o ON l.language = o.language LEFT JOIN (SELECT * FROM calibrated WHERE confidence IN ('medium', 'high') AND language = '_global') g ON TRUE""", _CALIBRATED)
def threshold_lookup(spark, d):
    languages = M.observations(spark, d).select("language").distinct().unionByName(spark.createDataFrame([("unseen",)], "language string"))
    return calibration.lookup(languages, calibration.calibrate(M.observations(spark, d)))


@query("SELECT query_no, sum(k) OVER (ORDER BY query_no)::BIGINT AS total, (sum(k) OVER (ORDER BY query_no) >= 500 AND sum(k) OVER (ORDER BY query_no) - k < 500) AS calibrate FROM (SELECT user_id AS query_no, count(*) AS k FROM events GROUP BY 1)")
def bootstrap_progress(spark, d):
    return calibration.running_bootstrap(M.table(spark, d, "events").select(F.col("user_id").alias("query_no")))


# -- filters (F1-F6, P1, X9) --------------------------------------------------------------------------------------------


@query(f"SELECT path, {M.ext_sql('path')} AS ext, {M.ext_sql('path')} NOT IN {M.EXCLUDED_EXT_SQL} AS accepted, {M.ext_sql('path')} IN ('py', 'md') AS listed FROM files")
def ext_filter(spark, d):
    ext = text.extension(F.col("path"))
    return M.files(spark, d).select("path", ext.alias("ext"), text.accepts_extension(ext).alias("accepted"), text.accepts_extension(ext, ["PY", "md"]).alias("listed"))


@query("SELECT symbol_id, kind FROM symbols WHERE kind IN ('function', 'trait')")
def kind_filter(spark, d):
    return M.symbols(spark, d).filter(text.accepts_kind(F.col("kind"), ["Function", "trait", "nothing"])).select("symbol_id", "kind")


_PATH = "CASE doc_id % 4 WHEN 0 THEN 'src/' WHEN 1 THEN 'node_modules/' WHEN 2 THEN './.hidden/' ELSE 'a/build' END || source || '/' || doc_id"


@query(f"SELECT doc_id, len([c FOR c IN string_split({_PATH}, '/') IF c NOT IN ('', '.', '..') AND (starts_with(c, '.') OR list_contains({M.EXCLUDED_DIRS_SQL}, c))]) > 0 AS excluded FROM documents")
def path_exclusion(spark, d):
    return M.table(spark, d, "documents").select("doc_id", text.excluded_path(F.expr(_PATH.replace("doc_id %", "doc_id %"))).alias("excluded"))


@query("SELECT doc_id FROM documents WHERE n_chars * 100 > 1048576")
def size_exclusion(spark, d):
    return M.table(spark, d, "documents").filter(text.too_large(F.col("n_chars") * 100)).select("doc_id")


_LANG = "map_from_entries([" + ", ".join(f"('{k}', '{v}')" for k, v in C.LANGUAGE_OF.items()) + "])"


@query(f"SELECT path, {_LANG}[{M.ext_sql('path')}] AS language FROM files")
def language_from_path(spark, d):
    return M.files(spark, d).select("path", text.language(F.col("path")).alias("language"))


@query("SELECT symbol_id, 'f' || file_id || ':' || start_line || CASE WHEN start_line = end_line THEN '' ELSE '-' || end_line END AS location FROM symbols")
def location_strings(spark, d):
    return M.symbols(spark, d).select("symbol_id", text.location(F.concat(F.lit("f"), F.col("file_id").cast("string")), F.col("start_line"), F.col("end_line")).alias("location"))


@query("SELECT symbol_id, CASE WHEN start_line <= 10 THEN 10 WHEN start_line <= 25 THEN 25 WHEN start_line <= 50 THEN 50 ELSE 95 END AS stands_for FROM symbols")
def percentile_lookup(spark, d):
    return M.symbols(spark, d).select("symbol_id", scoring.percentile_value(F.col("start_line"), *[F.lit(x) for x in (10, 25, 50, 75, 90, 95)]).alias("stands_for"))


# -- files, chunks, imports (S5, S6, S13, P10-P12, M1, M12) ------------------------------------------------------------------


@query(f"SELECT file_id, array_to_string(({M.lines_sql('content')})[2:4], chr(10)) AS slice FROM files")
def lines_slice(spark, d):
    return M.files(spark, d).select("file_id", text.line_slice(F.col("content"), 2, 4).alias("slice"))


@query("SELECT file_id, path, language FROM files WHERE file_id = 17")
def point_lookup(spark, d):
    return M.files(spark, d).filter("file_id = 17").select("file_id", "path", "language")


@query("SELECT symbol_id, name, start_line FROM symbols WHERE file_id = 3 ORDER BY start_line, symbol_id")
def symbols_of_file(spark, d):
    return M.symbols(spark, d).filter("file_id = 3").orderBy("start_line", "symbol_id").select("symbol_id", "name", "start_line")


@query("SELECT chunk_id, path, language FROM chunks WHERE embedding IS NOT NULL")
def chunks_with_embedding(spark, d):
    return M.chunks(spark, d).filter("embedding is not null").select("chunk_id", "path", "language")


_CHUNKS = f"""sized AS (SELECT file_id, {M.lines_sql('content')} AS ls FROM files),
sums AS (SELECT file_id, len(ls) AS n, list_prepend(0, [list_sum([strlen(x) + 1 FOR x IN ls[1:k]]) FOR k IN range(1, len(ls) + 1)]) AS off FROM sized WHERE len(ls) > 0),
walk AS (SELECT file_id, n, off, 0 AS a, least(n, len([x FOR x IN off[1:] IF x < 1500])) AS b FROM sums
  UNION ALL SELECT file_id, n, off, a2, least(n, a2 + len([x FOR x IN off[a2 + 1 :] IF x - off[a2 + 1] < 1500])) FROM (SELECT *, CASE WHEN b - 3 > a THEN b - 3 ELSE b END AS a2 FROM walk) WHERE a2 < n)"""


@query(None)
def chunk_lines(spark, d):
    return parsing.parse_chunks(M.files(spark, d).withColumn("language", F.lit(None).cast("string"))).select("file_id", "start_line", "end_line", "start_byte", "end_byte")


ORACLE_SQL["chunk_lines"] = f"""WITH RECURSIVE {M.SQL},{_CHUNKS}
SELECT file_id, a + 1 AS start_line, b AS end_line, least(off[a + 1], total)::BIGINT AS start_byte, least(off[b + 1] - 1, total)::BIGINT AS end_byte FROM walk JOIN (SELECT file_id, strlen(content) AS total FROM files) USING (file_id)"""

def _sources(spark, d) -> DataFrame:
    """A source file for each part, in eight languages, around names made of the part's."""
    a, b = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    k = F.col("p_partkey").cast("string")
    name = F.concat_ws("_", a, b)
    lines = lambda *x: F.concat_ws("\n", *[F.concat(*[F.lit(y) if isinstance(y, str) else y for y in part]) for part in x])
    rust = lines(["use crate::", a, "::{"], ["    ", b, ","], ["    Other", "};"], ["use ", a, ";"], ["/// Says ", b, "."], ["pub fn ", name, "("], ["    x: u32, // fn no(", ") {"], [") -> u32 {"], ['    let s = "fn never() {";'], ["    x"], ["}"], ["struct S", k, " {"], ["    v: u32,"], ["}"])
    typescript = lines(["import {"], ["  ", a, ","], ["} from './", b, "';"], ["export const ", name, " = (", "x: number", ") => {"], ["  return x;"], ["};"], ["const c", k, " = { debug: true };"])
    python = lines(["from .", a, " import ("], ["    ", b, ","], [")"], ["import os"], ["class C", k, ":"], ['    """def never(): ', b, '"""'], ["    def ", name, "("], ["        self,"], ["    ):"], ["        pass"])
    go = lines(["import ("], ['\t"fmt"'], ['\tx "example.org/', a, "/", b, '"'], [")"], ["type T", k, " struct {"], ["\tV int"], ["}"], ["func (t *T", k, ") ", name, "() int {"], ["\treturn 1"], ["}"])
    java = lines(["import java.util.", F.initcap(a), ";"], ["public class C", k, " {"], ["    public C", k, "(int v) {"], ["    }"], ["    public int ", name, "("], ["        int n"], ["    ) {"], ["        return n;"], ["    }"], ["}"])
    c = lines(["#include <", a, ".h>"], ['#include "', a, "/", b, '.h"'], ["static int"], [name, "(int n)"], ["{"], ['    puts("}");'], ["    return n;"], ["}"])
    ruby = lines(["require_relative '", a, "/", b, "'"], ["module M", k], ["  def ", name, "?(x)"], ["    x"], ["  end"], ["end"])
    php = lines(["<?php"], ["use App\\", F.initcap(a), "\\", F.initcap(b), " as U;"], ["class C", k, " {"], ["    public function ", name, "() {"], ["    }"], ["}"])
    languages = ["rust", "typescript", "python", "go", "java", "c", "ruby", "php"]
    form = F.col("p_partkey") % len(languages)
    content = F.lit(None).cast("string")
    for at, source in enumerate((rust, typescript, python, go, java, c, ruby, php)):  # a row's own text only
        content = F.when(form == at, source).otherwise(content)
    # the table is small beside the work on its rows, so a few of its files would keep a few cores busy
    part = M.table(spark, d, "part").select("p_partkey", "p_name").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    return part.select(F.col("p_partkey").alias("file_id"), F.array(*[F.lit(x) for x in languages])[form.cast("int")].alias("language"), content.alias("content"))


_NAMES = """
named AS (SELECT p_partkey AS file_id, p_partkey % 8 AS form, p_partkey::VARCHAR AS k, a, b, a || '_' || b AS n, upper(a[1]) || a[2:] AS aa, upper(b[1]) || b[2:] AS bb FROM (SELECT p_partkey, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b FROM part))"""


@query("""SELECT file_id, x.line::BIGINT AS line, x.target_path, x.import_name, x.kind FROM (SELECT file_id, unnest(CASE form
WHEN 0 THEN [{'line': 1, 'target_path': 'crate::' || a || '::{' || chr(10) || '    ' || b || ',' || chr(10) || '    Other}', 'import_name': NULL, 'kind': 'local'}, {'line': 4, 'target_path': a, 'import_name': a, 'kind': 'external'}]
WHEN 1 THEN [{'line': 1, 'target_path': './' || b, 'import_name': b, 'kind': 'local'}]
WHEN 2 THEN [{'line': 1, 'target_path': '.' || a, 'import_name': a, 'kind': 'local'}, {'line': 4, 'target_path': 'os', 'import_name': 'os', 'kind': 'std'}]
WHEN 3 THEN [{'line': 2, 'target_path': 'fmt', 'import_name': 'fmt', 'kind': 'std'}, {'line': 3, 'target_path': 'example.org/' || a || '/' || b, 'import_name': b, 'kind': 'external'}]
WHEN 4 THEN [{'line': 1, 'target_path': 'java.util.' || aa, 'import_name': aa, 'kind': 'std'}]
WHEN 5 THEN [{'line': 1, 'target_path': a || '.h', 'import_name': a || '.h', 'kind': 'std'}, {'line': 2, 'target_path': a || '/' || b || '.h', 'import_name': b || '.h', 'kind': 'local'}]
WHEN 6 THEN [{'line': 1, 'target_path': a || '/' || b, 'import_name': b, 'kind': 'local'}]
ELSE [{'line': 2, 'target_path': 'App\\' || aa || '\\' || bb, 'import_name': bb, 'kind': 'external'}] END) AS x FROM named)""", _NAMES)
def extract_imports(spark, d):
    return parsing.extract_imports(_sources(spark, d))


@query("""SELECT file_id, x.name, x.kind, x.s::BIGINT AS start_line, x.e::BIGINT AS end_line, x.parent FROM (SELECT file_id, unnest(CASE form
WHEN 0 THEN [{'name': a, 'kind': 'import', 's': 4, 'e': 4, 'parent': NULL}, {'name': n, 'kind': 'function', 's': 6, 'e': 11, 'parent': NULL}, {'name': 'S' || k, 'kind': 'struct', 's': 12, 'e': 14, 'parent': NULL}]
WHEN 1 THEN [{'name': n, 'kind': 'function', 's': 4, 'e': 6, 'parent': NULL}, {'name': 'c' || k, 'kind': 'variable', 's': 7, 'e': 7, 'parent': NULL}]
WHEN 2 THEN [{'name': b, 'kind': 'import', 's': 1, 'e': 3, 'parent': NULL}, {'name': 'os', 'kind': 'import', 's': 4, 'e': 4, 'parent': NULL}, {'name': 'C' || k, 'kind': 'class', 's': 5, 'e': 10, 'parent': NULL}, {'name': n, 'kind': 'function', 's': 7, 'e': 10, 'parent': 'C' || k}]
WHEN 3 THEN [{'name': 'T' || k, 'kind': 'type', 's': 5, 'e': 7, 'parent': NULL}, {'name': n, 'kind': 'method', 's': 8, 'e': 10, 'parent': NULL}]
WHEN 4 THEN [{'name': 'C' || k, 'kind': 'class', 's': 2, 'e': 10, 'parent': NULL}, {'name': n, 'kind': 'method', 's': 5, 'e': 9, 'parent': 'C' || k}]
WHEN 5 THEN [{'name': n || '(int n)', 'kind': 'function', 's': 3, 'e': 8, 'parent': NULL}]
WHEN 6 THEN [{'name': 'M' || k, 'kind': 'module', 's': 2, 'e': 6, 'parent': NULL}, {'name': n || '?', 'kind': 'function', 's': 3, 'e': 5, 'parent': 'M' || k}]
ELSE [{'name': 'C' || k, 'kind': 'class', 's': 3, 'e': 6, 'parent': NULL}, {'name': n, 'kind': 'method', 's': 4, 'e': 5, 'parent': 'C' || k}] END) AS x FROM named)""", _NAMES)
def extract_symbols(spark, d):
    """Symbols of the planted sources, and of the documents taken for TOML (few have a rule's form, and those are left out here)."""
    return parsing.parse_symbols(_sources(spark, d)).select("file_id", "name", "kind", "start_line", "end_line", "parent")


_FUNCTIONS = """
snippets AS (SELECT p_partkey, p_partkey % 20 AS file_id, row_number() OVER (PARTITION BY p_partkey % 20 ORDER BY p_partkey) AS i, 'f_' || p_partkey AS name,
  ['pub fn f_' || p_partkey || '() {', '    // ' || repeat(p_name || ' ', (p_size % 30 + 1)::BIGINT), '}', ''] AS ls FROM part),
sized AS (SELECT file_id, i, name, list_sum([strlen(x) + 1 FOR x IN ls])::BIGINT AS bytes, strlen(ls[2]) + 1 AS second FROM snippets),
placed AS (SELECT *, 4 * (i - 1) AS at, sum(bytes) OVER (PARTITION BY file_id ORDER BY i) - bytes AS off, max(i) OVER (PARTITION BY file_id) AS n, sum(bytes) OVER (PARTITION BY file_id) AS total FROM sized),
cuts AS (SELECT file_id, 1::BIGINT AS i, 0::BIGINT AS line, 0::BIGINT AS start, 1::BIGINT AS first, NULL::BIGINT AS done_line, NULL::BIGINT AS done_end, NULL::BIGINT AS done_first FROM placed WHERE i = 1
  UNION ALL SELECT c.file_id, p.i, CASE WHEN p.off - c.start >= 1500 THEN p.at - 3 ELSE c.line END, CASE WHEN p.off - c.start >= 1500 THEN p.off - prev.second - 3 ELSE c.start END, CASE WHEN p.off - c.start >= 1500 THEN p.i ELSE c.first END,
    CASE WHEN p.off - c.start >= 1500 THEN c.line END, CASE WHEN p.off - c.start >= 1500 THEN p.at END, CASE WHEN p.off - c.start >= 1500 THEN c.first END
  FROM cuts c JOIN placed p ON p.file_id = c.file_id AND p.i = c.i + 1 JOIN placed prev ON prev.file_id = c.file_id AND prev.i = c.i)"""


@query(None)
def chunk_semantic(spark, d):
    """Chunks of Rust files cut at their functions: twenty files of many short functions each."""
    snippet = F.concat(F.lit("pub fn f_"), F.col("p_partkey").cast("string"), F.lit("() {\n    // "), F.expr("repeat(concat(p_name, ' '), cast(p_size % 30 + 1 as int))"), F.lit("\n}\n\n"))
    rows = M.table(spark, d, "part").select((F.col("p_partkey") % 20).alias("file_id"), "p_partkey", snippet.alias("s"))
    files = rows.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "s"))), lambda x: x["s"]), "").alias("content")).withColumn("language", F.lit("rust"))
    return parsing.parse_chunks(files).select("file_id", "start_line", "end_line", F.array_join("symbols", ",").alias("symbols"))


ORACLE_SQL["chunk_semantic"] = f"""WITH RECURSIVE {M.SQL},{_FUNCTIONS},
ranges AS (SELECT file_id, done_line AS a, done_end AS b, done_first AS first, i - 1 AS last FROM cuts WHERE done_line IS NOT NULL UNION ALL SELECT c.file_id, c.line, 4 * p.n, c.first, p.n FROM cuts c JOIN placed p ON p.file_id = c.file_id AND p.i = c.i WHERE p.i = p.n)
SELECT r.file_id, r.a + 1 AS start_line, r.b AS end_line, (SELECT string_agg(name, ',' ORDER BY i) FROM placed p WHERE p.file_id = r.file_id AND p.i BETWEEN r.first AND r.last) AS symbols FROM ranges r"""


def _perturbed(files: DataFrame) -> DataFrame:
    """Without every 10th file, with every 7th changed, with new ones."""
    changed = files.filter("file_id % 10 <> 0").withColumn("content", F.when(F.col("file_id") % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return changed.unionByName(files.filter("file_id % 50 = 1").withColumn("path", F.concat(F.lit("new/"), "path")))


_NEW = """new_files AS (SELECT path, CASE WHEN file_id % 7 = 0 THEN content || '!' ELSE content END AS content, language FROM files WHERE file_id % 10 <> 0 UNION ALL SELECT 'new/' || path, content, language FROM files WHERE file_id % 50 = 1)"""


@query("SELECT path, CASE WHEN o.content IS NULL THEN 'added' WHEN n.content IS NULL THEN 'removed' WHEN o.content = n.content THEN 'same' ELSE 'changed' END AS change FROM files o FULL OUTER JOIN new_files n USING (path)", _NEW)
def snapshot_diff(spark, d):
    files = M.files(spark, d)
    hashed = lambda df: df.withColumn("hash", store.content_hash())
    return store.snapshot_diff(hashed(files), hashed(_perturbed(files)))


@query("SELECT path, sha256(content) AS hash FROM new_files UNION ALL SELECT path, sha256(content) FROM files WHERE path NOT IN (SELECT path FROM new_files)", _NEW)
def upsert_files(spark, d):
    files = M.files(spark, d).select("path", "content")
    return store.upsert(files, _perturbed(M.files(spark, d)).select("path", "content"), ["path"]).select("path", store.content_hash().alias("hash"))


_KEPT = """
new_rows AS (SELECT path, content, language, 2 AS turn FROM new_files),
stored AS (SELECT path, content, language, 1 AS turn FROM files WHERE path NOT IN (SELECT path FROM new_files) UNION ALL SELECT * FROM new_rows),
left_ AS (SELECT * FROM stored WHERE NOT contains(path, '/1'))"""


def _child_rows(files: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Two chunks and a symbol for each file."""
    n = F.explode(F.array(F.lit(1), F.lit(2)))
    chunks = files.select("path", n.alias("start_line"), F.substring("content", 1, 20).alias("content")).withColumn("end_line", F.col("start_line"))
    return chunks, files.select("path", F.concat(F.lit(f"s{turn}_"), "language").alias("name"), F.lit("function").alias("kind"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"))


@query("""SELECT path, sha256(content) AS hash, language, 2::BIGINT AS n_chunks, CASE WHEN contains(path, '/2') THEN 2 ELSE 0 END::BIGINT AS n_embedded, 's' || turn || '_' || language AS symbol FROM left_""", _NEW + "," + _KEPT)
def store_upkeep(spark, d):
    """A store through its whole life: load, upsert with children, delete, set embeddings, and its lookups joined."""
    shelf = store.Store(spark, f"{scratch_root(spark)}/siftwell/{uuid.uuid4().hex}-store")
    files = M.files(spark, d).select("path", "content", "language", F.octet_length("content").alias("size"), F.lit(0).alias("last_modified"), "file_id")
    for turn, rows in ((1, files), (2, _perturbed(files))):
        chunks, symbols = _child_rows(rows, turn)
        shelf.replace_files(rows.drop("file_id"), chunks=chunks, symbols=symbols)
    shelf.delete_files(shelf.table("files").filter(F.col("path").contains("/1")).select("path"))
    marked = shelf.table("chunks").join(shelf.table("files").filter(F.col("path").contains("/2")).select("file_id"), "file_id", "left_semi")
    shelf.set_embeddings(marked.select("chunk_id", F.array(F.lit(1.0).cast("float")).alias("embedding")))
    counts = shelf.table("chunks").groupBy("file_id").agg(F.count("*").alias("n_chunks"))
    embedded = shelf.chunks_with_embedding().groupBy("path").agg(F.count("*").alias("n_embedded"))
    names = shelf.table("symbols").select("file_id", F.col("name").alias("symbol"))
    out = shelf.table("files").join(counts, "file_id", "left").join(embedded, "path", "left").join(names, "file_id", "left")
    return out.select("path", "hash", "language", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("n_embedded", F.lit(0)).alias("n_embedded"), "symbol")


# -- streams over the event log (ST1-ST4) ----------------------------------------------------------------------------------------


_EVENTS = "log AS (SELECT 'u' || user_id AS path, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS event, event_id AS seq FROM events)"


def _streamed(spark, d) -> tuple[DataFrame, str]:
    """The log as a stream of several micro-batches, and a folder for what comes of it."""
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "deleted").otherwise("modified")
    log = M.table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), kind.alias("event"), F.col("event_id").alias("seq"))
    folder = f"{scratch_root(spark)}/siftwell/{uuid.uuid4().hex}-stream"
    log.repartition(3).write.parquet(f"{folder}/in")
    return spark.readStream.schema(changes.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), folder


def _latest(spark, d) -> DataFrame:
    events, folder = _streamed(spark, d)
    latest = changes.LatestEvents(spark, f"{folder}/latest")
    changes.keep_latest(events, latest, f"{folder}/checkpoint").awaitTermination()
    return latest.table()


@query("SELECT path, event, seq FROM log QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1", _EVENTS)
def stream_changes(spark, d):
    """The last event of each path, kept by a running query over three micro-batches."""
    return _latest(spark, d)


@query("SELECT path, seq FROM (SELECT path, event, seq FROM log QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1) WHERE event <> 'deleted'", _EVENTS)
def stream_applied(spark, d):
    """The paths that are left once all micro-batches have been applied."""
    last = _latest(spark, d)
    content = last.select("path", "seq")
    return changes.apply_changes(content.limit(0), last, content)
