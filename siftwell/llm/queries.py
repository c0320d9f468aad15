"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, license_scan, line_dedup, paragraph_dedup, piece_codec, quality_rules, secret_scan, simhash, suffix_dedup, token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_totals(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.repeated_paragraphs(table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False).drop("text")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_items") >= 2).alias("contaminated"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return license_scan.scan(table(spark, sf_dir, "documents"), path)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    return quality_rules.assess(docs.select("doc_id", "text"), field).drop("text", "content_words")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_token_counts": op2_token_counts,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_line_dedup": op7_line_dedup,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_license_scan": op9_license_scan,
    "op10_quality_rules": op10_quality_rules,
}

_LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"



def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def _spans_sql(name: str, pattern: str, group: int = 0) -> str:
    """Rows (r, kind, s, e, value) of a pattern's matches, placed by the lengths of what lies between."""
    p = pattern.replace("'", "''")
    return f"""
{name}_m AS (SELECT r, regexp_extract_all(text, '{p}', 0) AS ms, regexp_extract_all(text, '{p}', {group}) AS vs, string_split_regex(text, '{p}') AS gs FROM docs),
{name}_x AS (SELECT r, ms, vs, gs, unnest(range(1, len(ms) + 1)) AS k FROM {name}_m),
{name} AS (SELECT r, coalesce(list_sum([length(g) FOR g IN gs[1:k]]), 0) + coalesce(list_sum([length(m) FOR m IN ms[1 : k - 1]]), 0) AS s, length(ms[k]) AS n, vs[k] AS value FROM {name}_x)"""


def _entropy_sql(cls: secret_scan.CharClass) -> str:
    token = "lower(value)" if cls.fold else "value"
    has = lambda p: "regexp_matches(value, '" + p.replace("(?i)", "(?i:").replace("'", "''") + (")" if "(?i)" in p else "") + "')"
    known = " OR ".join("(" + " AND ".join([has(p), *(f"NOT {has(x)}" for x in but)]) + ")" for p, *but in secret_scan.ALLOWED)
    units = "[" + ", ".join(str(cls.units(n)) for n in range(cls.window + 1)) + "]"
    w = cls.window
    return f"""
{cls.name}_w AS (SELECT r, s, i, substr({token}, i, {w}) AS win FROM (SELECT *, unnest(range(1, n - {w} + 2)) AS i FROM {cls.name} WHERE n >= {w} AND NOT ({known}))),
{cls.name}_h AS (SELECT r, s, i, list_sum([{units}[length(win) - length(replace(win, c, '')) + 1] FOR c IN list_distinct(string_split(win, ''))]) AS u FROM {cls.name}_w),
{cls.name}_f AS (SELECT r, s + min(i) - 1 AS s, s + max(i) - 1 + {w} AS e FROM {cls.name}_h WHERE u <= {cls.most} GROUP BY r, s)"""


_ASSIGN_SQL = "(" + "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key"))) + """)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
OP1_SQL = (
    "WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),"
    + ",".join([_spans_sql("assign", _ASSIGN_SQL, 2), _spans_sql("access", secret_scan.ACCESS), _spans_sql("hex", secret_scan.HEX), *(_spans_sql(c.name, c.pattern) for c in secret_scan.CLASSES), *map(_entropy_sql, secret_scan.CLASSES)])
    + f""",
base AS (SELECT r, 0 AS kind, s, s + n AS e FROM assign WHERE length(value) >= {secret_scan.MIN_VALUE}
  UNION ALL SELECT r, 1, s, s + n FROM access UNION ALL SELECT r, 2, s, s + n FROM hex),
more AS (SELECT r, 3 AS kind, s, e FROM entropy_hex_f UNION ALL SELECT r, 4, s, e FROM entropy_base64_f),
clear AS (SELECT * FROM more m WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = m.r AND b.s < m.e AND m.s < b.e)),
spelled AS (SELECT r, kind, s, e, ['assign', 'access', 'hex', 'entropy_hex', 'entropy_base64'][kind + 1] || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR) AS x FROM (SELECT * FROM base UNION ALL SELECT * FROM clear))
SELECT d.doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  sha256(coalesce(string_agg(x, ',' ORDER BY s, kind) FILTER (WHERE kind < 3), '')) AS base_sha256,
  coalesce(string_agg(x, ',' ORDER BY s, kind), '') AS spans
FROM docs d LEFT JOIN spelled p ON d.r = p.r GROUP BY d.r, d.doc_id
"""
)

OP7_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM docs),
keyed AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''), {_LOW}) AS key FROM lines),
held AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT k.r, k.doc_id, k.line, k.pos, h.key IS NOT NULL AND k.doc_id <> h.first AS gone FROM keyed k LEFT JOIN held h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""

OP8_SQL = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOW}), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_LOW}), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(8, len(ws)) AS n, array_to_string(ws[s : s + least(8, len(ws)) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(8, len(ws)) + 2)) AS s FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, s, n, array_to_string(ws[s : s + n - 1], ' ') AS win FROM (SELECT r, n, ws, unnest(range(1, len(ws) - n + 2)) AS s FROM w, sizes WHERE len(ws) >= n)),
hits AS (SELECT dw.r, dw.s, dw.n, iw.item_id FROM dw JOIN iw USING (n, win)),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hits) GROUP BY r),
owners AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY r)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(o.n_items, 0) AS n_items,
  sha256(coalesce(o.ids, '')) AS items_sha256, coalesce(o.n_items, 0) >= 2 AS contaminated
FROM w LEFT JOIN cover c USING (r) LEFT JOIN owners o USING (r)
"""



def _cued_sql(x: str) -> str:
    return "(" + " OR ".join(f"contains({x}, '{c}')" for c in license_scan.CUES) + ")"


_TEMPLATES_SQL = ", ".join(f"({k}, '{name}', '{body}')" for k, (name, body) in enumerate(license_scan.TEMPLATES))
_PAIRS_SQL = "[" + ", ".join(f"'{p}'" for p in license_scan.TEMPLATE_PAIRS) + "]"
_WORDS_SQL = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_PAIR_SQL = "list_transform(list_zip(ws[:-2], ws[2:]), lambda p: p[1] || ' ' || p[2])"
_COMMENT_SQL = license_scan.COMMENT.replace("'", "''")
OP9_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, concat_ws('/', source, lang, doc_id || '.txt') AS path FROM documents),
begun AS (SELECT *, string_split(regexp_replace(text, '^[ \\t\\r\\n]+', ''), chr(10)) AS all_lines FROM docs),
cut AS (SELECT *, CASE WHEN {_cued_sql("lower(text)")} THEN [x FOR x IN string_split(text, chr(10)) IF {_cued_sql("lower(x)")}] ELSE [] END AS ls,
  CASE WHEN {_cued_sql("lower(text)")} THEN [x FOR x IN string_split_regex(text, '{license_scan.GAP}') IF {_cued_sql("lower(x)")}] ELSE [] END AS blocks,
  coalesce(list_position([regexp_matches(x, '{_COMMENT_SQL}') FOR x IN all_lines], false), 0) AS p, regexp_matches(path, '{license_scan.FILE_NAME}') AS named,
  nullif(regexp_extract(text, '{license_scan.SPDX}', 1), '') AS spdx FROM begun),
cues AS (SELECT r, doc_id, path, spdx, list_distinct([x FOR x IN list_concat([array_to_string(all_lines[1 : CASE WHEN p = 0 THEN len(all_lines) WHEN p = 1 THEN 1 ELSE p - 1 END], chr(10)), CASE WHEN named THEN text END, array_to_string(ls, chr(10))], ls, blocks) IF x <> '']) AS units,
  named OR (len(ls) > 0 AND 2 * len(string_split_regex(trim(array_to_string(ls, ' ')), '\\s+')) > len(string_split_regex(trim(text), '\\s+'))) AS file FROM cut),
unit AS (SELECT r, u, {_WORDS_SQL.format("line")} AS ws FROM (SELECT r, unnest(range(len(units))) AS u, unnest(units) AS line FROM cues)),
paired AS (SELECT r, u, ws, {_PAIR_SQL} AS ps FROM unit),
every AS (SELECT r, u, term, count(*) AS tf FROM (SELECT r, u, unnest(list_concat(ws, ps)) AS term FROM paired) GROUP BY ALL),
alike AS (SELECT r, u, ws, ps FROM paired WHERE len(list_intersect(list_distinct(ps), {_PAIRS_SQL})) >= {license_scan.MIN_SHARED}),
counts AS (SELECT r, u, term, count(*) AS tf FROM (SELECT r, u, unnest(list_concat(ws, ps)) AS term FROM alike) GROUP BY ALL),
base AS (SELECT t, license, term, count(*) AS tf FROM (SELECT t, license, unnest(list_concat(ws, {_PAIR_SQL})) AS term FROM (SELECT t, license, {_WORDS_SQL.format("body")} AS ws FROM (VALUES {_TEMPLATES_SQL}) v(t, license, body))) GROUP BY ALL),
total AS (SELECT count(DISTINCT r)::DOUBLE AS n FROM counts),
df AS (SELECT term, count(DISTINCT r) AS df FROM counts GROUP BY 1),
idf AS (SELECT term, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS idf FROM (SELECT term FROM base UNION SELECT term FROM every) LEFT JOIN df USING (term), total),
w AS (SELECT t, license, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY t)) AS w FROM base JOIN idf USING (term)),
norms AS (SELECT r, u, sqrt(sum((tf * idf) ** 2)) AS norm FROM every JOIN idf USING (term) GROUP BY 1, 2),
dots AS (SELECT c.r, c.u, w.t, w.license, sum(c.tf * i.idf * w.w) AS dot FROM every c JOIN idf i USING (term) JOIN w USING (term) GROUP BY ALL),
best AS (SELECT r, license, round(dot / norm, 6) AS score FROM dots JOIN norms USING (r, u) QUALIFY row_number() OVER (PARTITION BY r ORDER BY round(dot / norm, 6) DESC, license) = 1),
own AS (SELECT c.r, doc_id, path, file, coalesce(spdx, CASE WHEN score >= 0.5 THEN license END) AS license, CASE WHEN spdx IS NOT NULL THEN 1.0 WHEN score >= 0.5 THEN score END AS score FROM cues c LEFT JOIN best USING (r)),
holders AS (SELECT * FROM (SELECT array_to_string(string_split(path, '/')[:-2], '/') AS dir, score, path AS file_path, license AS file_license FROM own WHERE file AND license IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, file_path) = 1),
seek AS (SELECT r, k, array_to_string(string_split(path, '/')[1:k], '/') AS dir FROM (SELECT r, path, unnest(range(len(string_split(path, '/')))) AS k FROM own WHERE license IS NULL)),
near AS (SELECT s.r, h.score AS near_score, file_path, file_license FROM seek s JOIN holders h USING (dir) QUALIFY row_number() OVER (PARTITION BY s.r ORDER BY s.k DESC) = 1)
SELECT doc_id, path, coalesce(license, file_license) AS license, coalesce(score, near_score) AS score,
  CASE WHEN license IS NOT NULL THEN CASE WHEN file THEN 'file' ELSE 'header' END WHEN file_license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, CASE WHEN license IS NOT NULL THEN path ELSE file_path END AS from_path
FROM own LEFT JOIN near USING (r)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_secret_scan": OP1_SQL,
    "op7_line_dedup": OP7_SQL,
    "op8_benchmark_decontamination": OP8_SQL,
    "op9_license_scan": OP9_SQL,
}
