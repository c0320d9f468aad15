"""Source trees: listing, reading and change detection."""

from __future__ import annotations

import fnmatch
import os
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .. import constants as C
from ..functions.text import RequestError, excluded_entry

FILES = "path string, content string, size long, last_modified long"


def _ignored(rules: list[tuple[str, str]], path: str, is_dir: bool) -> bool:
    """Whether the last matching ignore rule (folder of its file, pattern) drops ``path``; the common subset of ignore files."""
    out = False
    for base, rule in rules:
        negated, rule = rule.startswith("!"), rule.lstrip("!")
        if rule.endswith("/"):
            if not is_dir:
                continue
            rule = rule[:-1]
        inside = path[len(base) :].lstrip("/") if not base or path.startswith(base + "/") else None
        if inside is None:
            continue
        hit = fnmatch.fnmatch(inside, rule.lstrip("/")) if "/" in rule else fnmatch.fnmatch(inside.rsplit("/", 1)[-1], rule)
        if hit:
            out = not negated
    return out


def walk(root: str, exclude_files: bool = True) -> Iterator[str]:
    """Paths below ``root``, relative and in order; hidden, excluded and git-ignored entries are left out.

    ``exclude_files=False`` applies the excluded names to folders only.
    """
    rules: list[tuple[str, str]] = []

    def load(folder: str, name: str) -> None:
        try:
            with open(os.path.join(root, folder, name), encoding="utf-8") as file:
                rules.extend((folder, x) for x in map(str.strip, file) if x and not x.startswith("#"))
        except (OSError, UnicodeDecodeError):
            pass

    def visit(folder: str) -> Iterator[str]:
        load(folder, ".gitignore")
        entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            is_dir = e.is_dir(follow_symlinks=False)
            drop = e.name.startswith(".") or (excluded_entry(e.name) and (is_dir or exclude_files)) or _ignored(rules, path, is_dir)
            if drop or e.is_symlink():
                continue
            if is_dir:
                yield from visit(path)
            else:
                yield path

    load("", ".git/info/exclude")
    yield from visit("")


def read_tree(spark: SparkSession, root: str, files_per_task: int = 500) -> DataFrame:
    """(path, content, size, last_modified) of the UTF-8 files of at most 1 MiB; reading is done by tasks.

    The folder must be seen by all executors.  Spark's own listing would skip names with a leading ``_``.
    """
    paths = list(walk(root))
    return read_paths(spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, -(-len(paths) // files_per_task))), root)


def read_paths(listed: DataFrame, root: str) -> DataFrame:
    """The same for the files named in the column ``path``; those that are gone or cannot be read have no row."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                full = os.path.join(root, path)
                try:
                    with open(full, "rb") as file:
                        stat = os.fstat(file.fileno())  # of the file that is read, whatever replaces it
                        if stat.st_size <= C.MAX_FILE_BYTES:
                            rows.append((path, file.read().decode("utf-8"), stat.st_size, int(stat.st_mtime)))
                except (OSError, UnicodeDecodeError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "content", "size", "last_modified"])

    return listed.select("path").mapInPandas(read, FILES)


def read_slice(root: str, path: str, start: int, end: int) -> str:
    """Lines start to end (1-based, clamped) of a file that lies below ``root``, links resolved."""
    base, full = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    if os.path.commonpath([base, full]) != base:
        raise RequestError("PATH_TRAVERSAL", "path leaves the project")
    with open(full, encoding="utf-8") as file:
        lines = file.read().splitlines()
    first = max(0, start - 1)
    return "\n".join(lines[first : min(end, len(lines))]) if first < end else ""


def snapshot(root: str) -> dict[str, tuple[int, int]]:
    """(mtime in ns, size) by path; files that go while they are listed are left out."""
    out = {}
    for p in walk(root):
        try:
            stat = os.stat(os.path.join(root, p))
        except OSError:
            continue
        out[p] = (stat.st_mtime_ns, stat.st_size)
    return out


class FileList:
    """The paths below a root, listed again once they are ``seconds`` old or after ``clear``."""

    def __init__(self, root: str, seconds: float = C.FILE_LIST_SECONDS, clock=time.monotonic):
        self.root, self.seconds, self.clock = root, seconds, clock
        self.clear()

    def clear(self) -> None:
        self._paths: list[str] | None = None
        self._at = 0.0

    def paths(self) -> list[str]:
        if self._paths is None or self.clock() - self._at >= self.seconds:
            self._paths, self._at = list(walk(self.root)), self.clock()
        return self._paths
