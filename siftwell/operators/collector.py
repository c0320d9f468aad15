"""The collector of distance observations: sampling, a buffer, and the signal to calibrate."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterable

from .. import constants as C
from . import calibration


def query_hash(query: str) -> int:
    """64 bits of a digest of the query, as a signed number."""
    return int.from_bytes(hashlib.blake2b(query.encode(), digest_size=8).digest(), "big", signed=True)


class Collector:
    """Decides which queries are observed and holds what they show until it is flushed.

    While fewer than ``threshold`` rows have been recorded (bootstrap) every query is observed, then every
    ``1 / rate``-th.  The record that reaches the threshold raises a flag that ``should_calibrate`` gives once.
    """

    def __init__(self, existing: int = 0, rate: float = C.SAMPLE_RATE, threshold: int = C.BOOTSTRAP_ROWS, buffer_rows: int = C.BUFFER_ROWS):
        self.total, self.rate, self.threshold, self.buffer_rows = existing, rate, threshold, buffer_rows
        self.queries = 0
        self.buffer: list[tuple[str, float, int, int]] = []
        self._flag = False

    @property
    def bootstrap(self) -> bool:
        return calibration.bootstrap(self.total, self.threshold)[0]

    @property
    def progress(self) -> int:
        return calibration.bootstrap(self.total, self.threshold)[1]

    def should_sample(self) -> bool:
        """Whether the next query is observed; in production each call counts one query."""
        if self.bootstrap:
            return True
        every = calibration.sample_every(self.rate)
        self.queries += 1
        return bool(every) and (self.queries - 1) % every == 0

    def record(self, query: str, near: Iterable[tuple[str | None, float]], ts: int | None = None) -> bool:
        """Observe (language, distance) of a query's candidates, if it is sampled; those without a language do not count."""
        if not self.should_sample():
            return False
        ts, key, before = int(time.time()) if ts is None else ts, query_hash(query), self.bootstrap
        rows = [(language, float(distance), key, ts) for language, distance in near if language is not None]
        self.buffer += rows
        self.total += len(rows)
        if before and not self.bootstrap:
            self._flag = True
        return True

    def should_calibrate(self) -> bool:
        """True once after bootstrap has ended."""
        flag, self._flag = self._flag, False
        return flag

    def needs_flush(self) -> bool:
        return len(self.buffer) >= self.buffer_rows

    def take(self) -> list[tuple[str, float, int, int]]:
        rows, self.buffer = self.buffer, []
        return rows
