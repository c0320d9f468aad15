"""Secret scans, with DataFrame functions only.

Base spans come from three patterns.  The method adds candidates of two character classes (hex digits,
base-64 letters): a window slides over each candidate, the counts of its characters are updated by one
character out and one in, and with them the sum of n * log2(n) that gives Shannon's entropy.  Windows
at or over the class's threshold make a span, from the first window's start to the last one's end, unless the
allow-list knows the candidate or a base span overlaps it.

Positions are code points, ends exclusive.  Sums are whole micro-bits, so results do not depend on the
order of additions.  Null text is empty: no spans.  Each row is judged by itself, whatever its id (null or repeated);
an empty table gives no rows; extra columns, whatever their names, are left out of the result.  Texts, candidates and
lists of matches of any length are taken whole, in time in proportion to their length: characters are read from arrays,
lists grow in blocks, and overlaps are found in one pass over both lists in order of start.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: As ``AKIA[A-Z0-9]+`` of 20 or more characters and ``[0-9a-f]+`` of 24 or more: both match whole runs.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_VALUE = 6


@dataclass(frozen=True)
class CharClass:
    name: str
    pattern: str
    alphabet: str
    window: int
    bits: float
    fold: bool = False

    def units(self, n: int) -> int:
        return round(n * log2(n) * 1e6) if n else 0

    @property
    def most(self) -> int:
        """Sum of n * log2(n) below which a window's entropy is at least ``bits``."""
        return int(self.window * (log2(self.window) - self.bits) * 1e6)


CLASSES = (
    CharClass("entropy_hex", r"[0-9A-Fa-f]{20,}", "0123456789abcdef", 20, 2.9, fold=True),
    CharClass("entropy_base64", r"[A-Za-z0-9+/_-]{24,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 24, 4.0),
)
#: Candidates that are known not to be secrets: numbers, words and paths of words, UUIDs, digests of
#: packages, placeholders, runs of the keyboard or alphabet.  Each has a pattern to match and patterns not to match
#: (no repeated groups, which would need a stack as deep as the candidate is long).
ALLOWED = (
    (r"^[0-9]+$",), (r"^[A-Za-z/_-]*[a-z]$", r"^[/_-]", r"[A-Za-z][A-Z]", r"[A-Z][/_-]"), (r"^[A-Z/_-]*[A-Z]$", r"^[/_-]"), (r"^[/_+-]+$",),
    (r"(^|-)[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",), (r"^sha(1|256|384|512)-",),
    (r"(?i)example|sample|dummy|placeholder|changeme|redacted|xxxx|your[_-]",), (r"(?i)0123456789|abcdefghij|qwertyuiop",),
)
KINDS = ("assign", "access", "hex", *(c.name for c in CLASSES))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


#: Elements of a list that grow in place of the whole, so that appending costs no copy of all.
BLOCK = 64


def grown(acc: Column, x: Column) -> list[Column]:
    """The fields ``cur`` and ``done`` of a growing list after ``x``."""
    full = F.size(acc["cur"]) >= BLOCK
    return [F.when(full, F.array(x)).otherwise(F.array_append(acc["cur"], x)).alias("cur"),
            F.when(full, F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]).alias("done")]


def listed(acc: Column) -> Column:
    return F.flatten(F.array_append(acc["done"], acc["cur"]))


def matches(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """array<struct<start, kind, end, value>>: leftmost matches, placed by the lengths of what lies between."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    row = "array<struct<start:int,kind:int,end:int,value:string>>"
    empty = F.array().cast(row)
    start = F.struct(F.lit(0).alias("at"), empty.alias("cur"), F.array().cast(f"array<{row}>").alias("done"))

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        end = begin + x["size"]
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), *grown(acc, span))

    rows = F.zip_with(F.slice(gaps, 1, F.size(found)), F.arrays_zip(found.alias("hit"), value.alias("value")),
                      lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h["hit"]).alias("size"), h["value"].alias("value")))
    return F.when(text.rlike(pattern), F.aggregate(rows, start, step, listed)).otherwise(empty)


def hot_span(token: Column, cls: CharClass) -> Column:
    """struct<first, last> of the windows at or over the threshold (1-based; null if none).

    ``counts`` holds one character for each letter of the alphabet, '0' standing for zero, so that an
    update replaces one character; no window counts over 24, so all stay in ASCII.
    """
    units = F.array(*[F.lit(cls.units(n)).cast("long") for n in range(cls.window + 1)])
    text = F.lower(token) if cls.fold else token
    empty = F.struct(F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    zero = F.struct(F.lit("0" * len(cls.alphabet)).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def change(counts: Column, total: Column, char: Column, by: int) -> Column:
        def at(place):
            def with_n(n):
                return F.struct(F.overlay(counts, F.char(n + 48 + by), place, 1).alias("counts"),
                                (total - units[n] + units[n + by]).alias("sum"))
            return let(F.ascii(F.substring(counts, place, F.lit(1))) - 48, with_n)
        return let(F.instr(F.lit(cls.alphabet), char), at)

    def slide(chars: Column) -> Column:
        def step(acc, i):
            without = F.when(i > cls.window, change(acc["counts"], acc["sum"], F.get(chars, i - 1 - cls.window), -1)).otherwise(
                F.struct(acc["counts"].alias("counts"), acc["sum"].alias("sum")))
            both = let(without, lambda o: change(o["counts"], o["sum"], F.get(chars, i - 1), 1))

            def judge(s):
                hot = (i >= cls.window) & (s["sum"] <= cls.most)
                return F.struct(s["counts"].alias("counts"), s["sum"].alias("sum"),
                                F.when(hot & acc["first"].isNull(), i - cls.window + 1).otherwise(acc["first"]).alias("first"),
                                F.when(hot, i).otherwise(acc["last"]).alias("last"))
            return let(both, judge)

        return F.aggregate(F.sequence(F.lit(1), F.size(chars)), zero, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    return F.when(F.length(token) < cls.window, empty).otherwise(let(F.split(text, ""), slide))


def entropy_spans(text: Column, cls: CharClass) -> Column:
    """Spans of one class, before the base spans are looked at."""
    allowed = F.lit(False)

    def known(x):
        out = allowed
        for pattern, *but in ALLOWED:
            one = x["value"].rlike(pattern)
            for p in but:
                one = one & ~x["value"].rlike(p)
            out = out | one
        return out

    found = F.filter(matches(text, cls.pattern, KINDS.index(cls.name)), lambda x: ~known(x))
    scanned = F.transform(found, lambda x: let(hot_span(x["value"], cls), lambda s: F.struct(
        (x["start"] + s["first"] - 1).alias("start"), x["kind"].alias("kind"), (x["start"] + s["last"]).alias("end"))))
    return F.filter(scanned, lambda x: x["start"].isNotNull())


def _bare(found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


def _spelled(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))))


def clear_of(base: Column, more: Column) -> Column:
    """The spans of ``more`` that no span of ``base`` overlaps, in order.

    One pass over both in order of start.  A span of ``more`` is dropped if a base span before it reaches into it, or
    waits (one of each class, as spans of a class are apart) until something starts behind it or a base span within it.
    """
    kinds = [KINDS.index(c.name) for c in CLASSES]
    span = "struct<start:int,kind:int,end:int>"
    none = F.lit(None).cast(span)
    zero = F.struct(F.lit(0).alias("reach"), *[none.alias(f"wait{k}") for k in kinds], F.array().cast(f"array<{span}>").alias("cur"), F.array().cast(f"array<array<{span}>>").alias("done"))

    def flushed(acc: Column, past: Column | None) -> Column:
        for k in kinds:
            w = acc[f"wait{k}"]
            over = w.isNotNull() if past is None else w.isNotNull() & (w["end"] <= past)
            fields = [F.when(over, none).otherwise(acc[f"wait{j}"]).alias(f"wait{j}") if j == k else acc[f"wait{j}"].alias(f"wait{j}") for j in kinds]
            cur, done = grown(acc, w)
            acc = F.struct(acc["reach"].alias("reach"), *fields, F.when(over, cur).otherwise(acc["cur"]).alias("cur"), F.when(over, done).otherwise(acc["done"]).alias("done"))
        return acc

    def step(acc, x):
        def take(a):
            is_base = x["kind"] < kinds[0]
            waits = [F.when(is_base, none).when((x["kind"] == k) & (a["reach"] <= x["start"]), x).otherwise(a[f"wait{k}"]).alias(f"wait{k}") for k in kinds]
            return F.struct(F.when(is_base, F.greatest(a["reach"], x["end"])).otherwise(a["reach"]).alias("reach"), *waits, a["cur"].alias("cur"), a["done"].alias("done"))
        return let(flushed(acc, x["start"]), take)

    merged = F.aggregate(F.array_sort(F.concat(base, more)), zero, step, lambda acc: listed(flushed(acc, None)))
    return F.when(F.size(more) == 0, more).when(F.size(base) == 0, F.array_sort(more)).otherwise(F.array_sort(merged))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added): spans as array<struct<start, kind, end>> in order; kind is an index of KINDS."""
    text = F.coalesce("text", F.lit(""))
    assign = F.filter(matches(text, ASSIGN, 0, group=2), lambda x: F.length(x["value"]) >= MIN_VALUE)
    base = F.array_sort(F.concat(_bare(assign), _bare(matches(text, ACCESS, 1)), _bare(matches(text, HEX, 2))))
    more = F.concat(*[entropy_spans(text, c) for c in CLASSES])
    found = docs.select("doc_id", F.array(F.struct(base.alias("base"), more.alias("more"))).alias("found"))
    return found.select("doc_id", F.col("found")[0]["base"].alias("base"), F.transform("found", lambda f: clear_of(f["base"], f["more"]))[0].alias("added"))


def report(docs: DataFrame) -> DataFrame:
    spans = scan(docs)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return spans.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(_spelled(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        _spelled(F.array_sort(F.concat("base", "added"))).alias("spans"))
