"""Lines, extensions, paths and validation as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

#: White space at line ends, Unicode's included.
EDGE = r"^[\s\x0B\x{85}\p{Z}]+|[\s\x0B\x{85}\p{Z}]+$"


def lines(text: Column) -> Column:
    """Lines as readers count them: no empty last line, no carriage return before a line end."""
    parts = F.split(F.coalesce(text, F.lit("")), "\r?\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def trim(text: Column) -> Column:
    return F.regexp_replace(text, EDGE, "")


def line_slice(text: Column, start: int, end: int) -> Column:
    """Lines start to end (1-based, inclusive, clamped); empty if the range is."""
    count = max(0, end - max(start, 1) + 1)
    return F.array_join(F.slice(lines(text), max(start, 1), count), "\n") if count else F.lit("")


def extension(path: Column) -> Column:
    """Lower-cased last extension of the file name; '' if none (a leading dot is part of the name)."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))


def language(path: Column) -> Column:
    ext = extension(path)
    return F.element_at(F.create_map(*[F.lit(x) for pair in C.LANGUAGE_OF.items() for x in pair]), F.when(ext != "", ext))


def accepts_extension(ext: Column, file_types: list[str] | None = None) -> Column:
    """Membership in the given types, which override exclusions; else not excluded. Case does not count."""
    if file_types:
        return F.lower(ext).isin([t.lower() for t in file_types])
    return ~F.lower(ext).isin(C.EXCLUDED_EXTENSIONS)


def accepts_kind(kind: Column, kinds: list[str] | None = None) -> Column:
    return F.lower(kind).isin([k.lower() for k in kinds]) if kinds else F.lit(True)


def excluded_path(path: Column) -> Column:
    """A component is hidden or an excluded name; '.' and '..' are not names."""
    names = F.filter(F.split(path, "/"), lambda c: (c != "") & (c != ".") & (c != ".."))
    return F.exists(names, lambda c: c.startswith(".") | c.isin(C.EXCLUDED_DIRS))


def excluded_entry(name: str) -> bool:
    return name.startswith(".") or name in C.EXCLUDED_DIRS


def too_large(size: Column) -> Column:
    return size > C.MAX_FILE_BYTES


def location(path: Column, start: Column, end: Column) -> Column:
    one = F.concat(path, F.lit(":"), start.cast("string"))
    return F.when(start == end, one).otherwise(F.concat(one, F.lit("-"), end.cast("string")))


def snippet(text: Column, chars: int) -> Column:
    return trim(F.substring(text, 1, chars))


def signature(text: Column) -> Column:
    first = F.element_at(F.split(text, "\r?\n", 2), 1)
    return trim(F.when(F.length(first) > 200, F.concat(F.substring(first, 1, 200), F.lit("..."))).otherwise(first))


def parse_csv(value: str | None) -> list[str] | None:
    """Comma-separated names, trimmed and lower-cased; None if none is left."""
    return [p.strip().lower() for p in (value or "").split(",") if p.strip()] or None


class RequestError(ValueError):
    """A refused request, with the code that the service reports."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def validate(value: str, what: str = "QUERY") -> str:
    """The trimmed value of a query, symbol or path; limits are in bytes."""
    value = value.strip()
    if not value:
        raise RequestError(f"INVALID_{what}", f"{what.lower()} is empty")
    if len(value.encode()) > C.MAX_QUERY_BYTES:
        raise RequestError(f"{what}_TOO_LONG", f"{what.lower()} is longer than {C.MAX_QUERY_BYTES} bytes")
    if what == "PATH" and ".." in value:
        raise RequestError("PATH_TRAVERSAL", "path leaves the project")
    return value


def capped(limit: int | None, default: int, cap: int) -> int:
    return min(default if limit is None else max(0, limit), cap)
