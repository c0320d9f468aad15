"""Scores, distances and thresholds as expressions. Arithmetic is in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def similarity(distance: Column) -> Column:
    return 1.0 / (1.0 + distance.cast("double"))


def distance_of(sim: Column) -> Column:
    """The inverse; similarities of zero or less are as far as a 32-bit float goes."""
    s = sim.cast("double")
    return F.when(s <= 0, F.lit(3.4028234663852886e38)).otherwise(1.0 / F.when(s <= 0, F.lit(None)).otherwise(s) - 1.0)


def symbol_score(name: Column, term: Column, kind: Column) -> Column:
    low, want = F.lower(name), F.lower(term)
    base = F.when(low == want, 1.0).when(low.startswith(want), 0.85).when(low.contains(want), 0.7).otherwise(0.5)
    boost = F.lit(1.0)
    for value in sorted(set(C.KIND_BOOST.values()) - {1.0}):
        boost = F.when(kind.isin([k for k, b in C.KIND_BOOST.items() if b == value]), value).otherwise(boost)
    return F.least(F.lit(1.0), base * boost * (1.0 + 1.0 / (F.octet_length(name) + 5.0)))


def line_score(line: Column, term: Column) -> Column:
    """Score of a trimmed line that contains ``term`` in any case.

    The place is a byte offset in the lower-cased line, but the character before it is looked up by
    that number of characters; both differ once a line holds other than ASCII.
    """
    low, want = F.lower(line), F.lower(term)
    at = F.octet_length(F.substring(low, F.lit(1), F.greatest(F.lit(0), F.instr(low, want) - 1)))
    before = F.substring(line, at, F.lit(1))
    edge = (at == 0) | ~before.rlike(r"[\p{L}\p{N}]")
    base = F.when(low == want, 0.9).when(edge, 0.7).otherwise(0.5)
    return F.least(F.lit(1.0), base * (1.0 - at / (F.octet_length(line) + 10.0) * 0.2))


def searchable(line: Column) -> Column:
    """Trimmed lines that searches look at: not empty, no ``//`` or ``#`` at the start."""
    return (line != "") & ~line.startswith("//") & ~line.startswith("#")


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v))


def cosine(a: Column, b: Column) -> Column:
    """0 for lengths that differ, empty vectors and zero vectors."""
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (norm == 0), 0.0).otherwise(dot(a, b) / F.when(norm != 0, norm))


def confidence(n: Column) -> Column:
    return F.when(n < 100, "none").when(n < 500, "low").when(n < 2000, "medium").otherwise("high")


def sufficient(level: Column) -> Column:
    return level.isin("medium", "high")


def percentile_value(p: Column, p10: Column, p25: Column, p50: Column, p75: Column, p90: Column, p95: Column, cuts=(10, 25, 50, 75, 90)) -> Column:
    """The stored percentile that stands for ``p``; the calibrator cuts at 15, 30, 60, 80 and 92."""
    out = F.when(p <= cuts[0], p10)
    for cut, value in zip(cuts[1:], (p25, p50, p75, p90), strict=True):
        out = out.when(p <= cut, value)
    return out.otherwise(p95)


def newer(latest: Column, current: Column) -> Column:
    """Whether version ``latest`` comes after ``current``: three numbers, what is missing or no number is 0."""
    parts = lambda v: [F.coalesce(F.try_element_at(F.split(F.ltrim(v, F.lit("v")), r"\."), F.lit(k)).try_cast("int"), F.lit(0)) for k in (1, 2, 3)]
    return F.struct(*parts(latest)) > F.struct(*parts(current))


def _word(blob: Column, k: Column) -> Column:
    """The k-th 32 bits as a number."""
    digits = F.hex(blob)
    byte = lambda j: F.substring(digits, k * 8 + 2 * j + 1, F.lit(2))
    return F.conv(F.concat(byte(3), byte(2), byte(1), byte(0)), 16, 10).cast("long")


def _float_of_bits(bits: Column) -> Column:
    """IEEE 754 single precision by its fields."""
    sign = F.when(bits.bitwiseAND(F.lit(1 << 31)) != 0, -1.0).otherwise(1.0)
    exponent = F.shiftright(bits, 23).bitwiseAND(F.lit(255))
    fraction = bits.bitwiseAND(F.lit((1 << 23) - 1))
    normal = (F.lit(float(1 << 23)) + fraction) * F.pow(F.lit(2.0), exponent - 150)
    small = fraction.cast("double") * F.pow(F.lit(2.0), F.lit(-149))
    special = F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return (sign * F.when(exponent == 255, special).when(exponent == 0, small).otherwise(normal)).cast("float")


def vector_of_bytes(blob: Column) -> Column:
    """The floats of little-endian 32-bit numbers; none if the length is no multiple of four."""
    size = F.octet_length(blob)
    bits = F.transform(F.sequence(F.lit(0), F.floor(size / 4).cast("int") - 1), lambda k: _word(blob, k))
    return F.when((size % 4 != 0) | (size == 0), F.array().cast("array<float>")).otherwise(F.transform(bits, _float_of_bits))
