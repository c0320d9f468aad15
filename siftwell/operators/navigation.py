"""References, dependencies, explanations and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import expansion, text
from .retrieval import fts_match, text_strategy


def find_refs(files: DataFrame, symbols: DataFrame, name: str, limit: int = C.LIMITS["refs"]) -> DataFrame:
    """Definitions by exact name first, then usages that are not on a definition's line; (ord, kind, path, lines, score, content)."""
    name = text.validate(name, "SYMBOL")
    found = symbols.filter(F.col("name") == name).join(files.select("file_id", "path", F.col("content").alias("body")), "file_id")
    code = F.array_join(F.slice(text.lines(F.col("body")), F.col("start_line").cast("int"), F.greatest(F.lit(0), F.col("end_line") - F.col("start_line") + 1).cast("int")), "\n")
    definitions = found.select(F.lit(0).alias("part"), F.lit("symbol").alias("kind"), "path", "start_line", "end_line", F.lit(1.0).alias("score"), code.alias("content"), F.col("symbol_id").alias("row_ord"))
    usages = text_strategy(files, expansion.all_terms(name), limit)
    usages = usages.join(definitions.select("path", "start_line").distinct(), ["path", "start_line"], "left_anti")
    usages = usages.select(F.lit(1).alias("part"), F.lit("reference").alias("kind"), "path", "start_line", "end_line", "score", "content", "row_ord")
    return definitions.unionByName(usages).orderBy("part", "row_ord").limit(limit)


def imports_of(files: DataFrame, deps: DataFrame, path: str) -> DataFrame:
    return deps.join(files.filter(F.col("path") == path).select(F.col("file_id").alias("source_file_id")), "source_file_id").select("dep_id", "target_path", "import_name", "kind").orderBy("dep_id")


def is_dependent(target: Column, name: Column) -> Column:
    """An import's text ends with the file's name, or in any case with its stem (not aligned to segments)."""
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return target.endswith(name) | F.lower(target).endswith(F.lower(stem))


def dependents_of(files: DataFrame, deps: DataFrame, path: str) -> DataFrame:
    """Import records that may name the file ``path``, with the importing file."""
    name = F.lit(path.rsplit("/", 1)[-1])
    return deps.filter(is_dependent(F.col("target_path"), name)).join(files.select(F.col("file_id").alias("source_file_id"), F.col("path").alias("source_path")), "source_file_id").select("dep_id", "source_path", "target_path", "import_name", "kind")


def all_dependents(files: DataFrame, deps: DataFrame) -> DataFrame:
    """(path, dep_id) for all files at once, by equality: suffixes of an import's text meet names and stems.

    Only suffixes as long as some name or stem are made; the set of those lengths is no larger than the longest name.
    """
    base = files.select("path", F.regexp_extract("path", r"[^/]*$", 0).alias("name"))
    keys = base.select("path", F.lit(False).alias("folded"), F.col("name").alias("key")).unionByName(base.select("path", F.lit(True).alias("folded"), F.lower(F.regexp_replace("name", r"(?<=.)\.[^.]*$", "")).alias("key"))).filter("key <> ''")
    sizes = {f: sorted(r["n"] for r in rows) for f, rows in ((f, keys.filter(F.col("folded") == f).select(F.length("key").alias("n")).distinct().collect()) for f in (False, True))}
    n, target = F.length("target_path"), F.col("target_path")

    def ends(folded: bool) -> Column:
        lengths = F.array(*[F.lit(k) for k in sizes[folded]]) if sizes[folded] else F.array().cast("array<int>")
        whole = F.lower(target) if folded else target
        return F.transform(F.filter(lengths, lambda k: k <= F.length(whole)), lambda k: F.struct(F.lit(folded).alias("folded"), F.substring(whole, F.length(whole) - k + 1, k).alias("key")))

    suffixes = deps.filter(n > 0).select("dep_id", F.explode(F.concat(ends(False), ends(True))).alias("s")).select("dep_id", "s.folded", "s.key")
    return suffixes.join(keys, ["folded", "key"]).select("path", "dep_id").distinct()


def transitive_imports(edges: DataFrame, depth: int = 5) -> DataFrame:
    """(src, dst, hops) up to ``depth`` hops along resolved edges (src, dst); an extension of ours."""
    reach = edges.select("src", "dst", F.lit(1).alias("hops")).distinct()
    front = reach
    for k in range(2, depth + 1):
        front = front.select("src", F.col("dst").alias("mid")).join(edges.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst", F.lit(k).alias("hops")).distinct()
        front = front.join(reach.select("src", "dst"), ["src", "dst"], "left_anti")
        reach = reach.unionByName(front)
    return reach


def explain_symbol(files: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """One row: definitions (at most 20), related names (sorted) and the number of other symbols that mention it (at most 100 are counted)."""
    name = text.validate(name, "SYMBOL")
    first = symbols.filter(F.col("name") == name).orderBy("symbol_id").limit(C.EXPLAIN_DEFINITIONS)
    placed = first.join(files.select("file_id", "path"), "file_id")
    definition = F.struct("symbol_id", "path", "kind", "start_line", "end_line", "signature", "doc_comment")
    definitions = placed.agg(F.array_sort(F.collect_list(definition)).alias("definitions"))
    related = symbols.join(first.select("file_id").distinct(), "file_id", "left_semi").filter(F.col("name") != name).agg(F.array_sort(F.collect_set("name")).alias("related"))
    mentions = fts_match(symbols, name, C.EXPLAIN_MENTIONS).agg(F.count("*").alias("mentions"))
    # three single rows
    row = definitions.crossJoin(related).crossJoin(mentions)
    return row.select(F.lit(name).alias("name"), (F.size("definitions") > 0).alias("found"), "definitions", "related", F.greatest(F.lit(0).cast("long"), F.col("mentions") - F.size("definitions")).alias("usage_count"))


def index_stats(files: DataFrame, symbols: DataFrame, chunks: DataFrame, deps: DataFrame) -> DataFrame:
    out = None
    for name, df in (("files", files), ("symbols", symbols), ("chunks", chunks), ("dependencies", deps)):
        one = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
