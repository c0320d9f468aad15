"""Quality rules: a linear-chain conditional random field marks each line as content or boilerplate.

The field is trained here, on a bounded sample of labelled documents, as no line labels exist.  Lines of good
documents are content and lines of bad ones boilerplate; chains that change within a text are made by setting runs of
lines of bad documents into good ones.  After a first fit, lines of bad documents that it calls content become
content where most of the document's words stay boilerplate, and the field is fitted again.  Viterbi decoding of a
text's lines then gives the share of its words that stand in content lines; that share decides retention, after two
base rules (too few words, too much repetition).

Null and empty text: no words, so the base rules reject it.  Empty and blank lines carry no words and no vote.
Long texts are decoded whole, line by line.  Repeated rows are judged alike, each by its own text.  An empty table
gives no rows.  A table without usable labels of both kinds gives a field of zeros, which calls every line content.
Extra columns pass through unchanged; where they have a metric's name, the metric gets ``_``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import freeing, fresh

SYMBOLS = "#*$%&|<>"
FEATURES = ("bias", "short", "long", "symbols", "upper", "digits", "bang", "adjacent", "few", "seen", "shared", "short_words", "long_words", "stop")


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    min_content_share: float = 0.5
    #: Bound of the training sample, in documents of each label.
    sample_docs: int = 600
    #: Longer documents are left out of the sample (not of the decoding), which bounds its size in bytes.
    sample_chars: int = 20_000
    steps: int = 200
    l2: float = 1e-3


@dataclass(frozen=True)
class LineField:
    """Weights (2 x features) and transitions (2 x 2); label 1 is content."""

    unary: tuple
    pair: tuple


#: str.split() would also cut at other Unicode spaces.
words_of = re.compile(r"[^\x20\x09-\x0D]+").findall


def symbols_in(text: str) -> int:
    return sum(map(text.count, SYMBOLS))


def line_features(lines: list[str], tokens: list[list[str]]) -> np.ndarray:
    """One row for each line with a word."""
    out, seen, earlier = [], set(), set()
    for line, words in zip(lines, tokens, strict=True):
        if not words:
            continue
        n, chars = len(words), sum(map(len, words))
        distinct = set(words)
        repeats = sum(map(str.__eq__, words, words[1:]))
        letters = max(1, chars)
        out.append((
            1.0, float(n <= 3), min(n, 60) / 60, min(1.0, 4 * symbols_in(line) / letters),
            sum(map(str.isupper, words)) / n, min(1.0, 4 * sum(map(str.isdigit, line)) / letters) if not line.isalpha() else 0.0,
            min(1.0, line.count("!") / n), min(1.0, repeats / max(1, n - 1)), 1 - len(distinct) / n, float(line in seen),
            len(distinct & earlier) / len(distinct), float(chars < 3 * n), float(chars > 12 * n), float(line.rstrip()[-1:] in ".?:;,!"),
        ))
        seen.add(line)
        earlier |= distinct
    return np.array(out, float).reshape(-1, len(FEATURES))


def viterbi(unary: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """The best labels of a chain of two labels; ties go to content (1)."""
    n = len(unary)
    back, (s0, s1) = np.zeros((n, 2), np.int8), (unary[0, 0], unary[0, 1])
    (p00, p01), (p10, p11) = pair.tolist()
    rows = unary.tolist()
    for t in range(1, n):
        u0, u1 = rows[t]
        a, b = s0 + p00, s1 + p10
        c, d = s0 + p01, s1 + p11
        back[t] = (b >= a, d >= c)
        s0, s1 = max(a, b) + u0, max(c, d) + u1
    labels = np.empty(n, np.int8)
    labels[-1] = s1 >= s0
    for t in range(n - 1, 0, -1):
        labels[t - 1] = back[t, labels[t]]
    return labels


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(samples: list[tuple[np.ndarray, np.ndarray]], rules: QualityRules) -> LineField:
    """Maximum likelihood by Adam over chains (features, labels of the lines); the gradient is observed minus
    expected counts (forward-backward)."""
    k = len(FEATURES)
    samples = sorted(((x, y) for x, y in samples if len(x)), key=lambda s: -len(s[0]))
    if not samples or len(np.unique(np.concatenate([y for _, y in samples]))) < 2:
        return LineField(tuple([(0.0,) * k] * 2), ((0.0, 0.0), (0.0, 0.0)))
    m = len(samples)
    lengths = np.array([len(x) for x, _ in samples])
    longest = int(lengths[0])
    # chains of content, of boilerplate and of both weigh the same in all; a long text weighs as its root
    kind = np.array([2 if y.any() and not y.all() else int(y[0]) for _, y in samples])
    weight = 1 / np.bincount(kind, minlength=3)[kind] / len(np.unique(kind)) / np.sqrt(lengths)
    alive = np.array([(lengths > t).sum() for t in range(longest)])
    xs = [np.stack([x[t] for x, _ in samples[: alive[t]]]) for t in range(longest)]
    w, p = np.zeros((2, k)), np.zeros((2, 2))
    first, second = [np.zeros_like(w), np.zeros_like(p)], [np.zeros_like(w), np.zeros_like(p)]
    seen_w, seen_p = np.zeros_like(w), np.zeros_like(p)
    for (x, y), own in zip(samples, weight, strict=True):
        for c in (0, 1):
            seen_w[c] += own * x[y == c].sum(0)
        np.add.at(seen_p, (y[:-1], y[1:]), own)
    for step in range(1, rules.steps + 1):
        us = [x @ w.T for x in xs]
        ahead, behind = np.zeros((longest, m, 2)), np.zeros((longest, m, 2))
        ahead[0] = us[0]
        for t in range(1, longest):
            a = alive[t]
            ahead[t, :a] = _log_sum(ahead[t - 1, :a, :, None] + p, 1) + us[t]
        for t in range(longest - 2, -1, -1):
            a = alive[t + 1]
            behind[t, :a] = _log_sum(p + (behind[t + 1, :a] + us[t + 1])[:, None, :], 2)
        z = _log_sum(ahead[lengths - 1, np.arange(m)], 1)
        want_w, want_p = np.zeros_like(w), np.zeros_like(p)
        for t in range(longest):
            a = alive[t]
            node = np.exp(ahead[t, :a] + behind[t, :a] - z[:a, None]) * weight[:a, None]
            want_w += node.T @ xs[t]
            if t + 1 < longest and (a := alive[t + 1]):
                edge = ahead[t, :a, :, None] + p + (behind[t + 1, :a] + us[t + 1])[:, None, :] - z[:a, None, None]
                want_p += (np.exp(edge) * weight[:a, None, None]).sum(0)
        for i, (v, g) in enumerate(((w, seen_w - want_w - rules.l2 * w), (p, seen_p - want_p - rules.l2 * p))):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            v += 0.1 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return LineField(tuple(map(tuple, w.tolist())), tuple(map(tuple, p.tolist())))


def _chain(lines: list[str], labels: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, words) of the lines with a word."""
    tokens = [words_of(x) for x in lines]
    some = [k for k, t in enumerate(tokens) if t]
    return line_features(lines, tokens), np.array([labels[k] for k in some], np.int64), np.array([len(tokens[k]) for k in some], np.int64)


def fit_documents(texts: list[tuple[str, int]], rules: QualityRules) -> LineField:
    """The field of (text, label of the document) samples: two fits, the second with lines of bad documents relabelled."""
    good, bad = ([t.split("\n") for t, y in texts if y == c] for c in (1, 0))
    whole = [_chain(lines, [y] * len(lines)) for part, y in ((good, 1), (bad, 0)) for lines in part]
    if not good or not bad:
        return fit([], rules)
    rng = np.random.default_rng(11)

    def mixed(labels_of_bad: list[list[int]]) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for k in range(min(rules.sample_docs, 2 * len(bad))):
            host, (guest, own) = good[k % len(good)], (bad[k % len(bad)], labels_of_bad[k % len(bad)])
            at, lo = int(rng.integers(len(host) + 1)), int(rng.integers(len(guest)))
            hi = lo + 1 + int(rng.integers(len(guest) - lo))
            out.append(_chain(host[:at] + guest[lo:hi] + host[at:], [1] * at + own[lo:hi] + [1] * (len(host) - at))[:2])
        return out

    labels = [[0] * len(lines) for lines in bad]
    field = fit([c[:2] for c in whole] + mixed(labels), rules)
    unary, pair = np.array(field.unary), np.array(field.pair)
    for k, lines in enumerate(bad):
        x, y, n = whole[len(good) + k]
        if len(x):
            found = viterbi(x @ unary.T, pair).astype(np.int64)
            if 2 * n[found == 1].sum() < n.sum():
                whole[len(good) + k] = (x, found, n)
                each = iter(found.tolist())
                labels[k] = [next(each) if words_of(line) else 0 for line in lines]
    return fit([c[:2] for c in whole] + mixed(labels), rules)


def train(docs: DataFrame, labels: DataFrame, rules: QualityRules = QualityRules()) -> LineField:
    """Fit the field on at most ``sample_docs`` labelled documents of each quality, chosen by hash.

    The sample is bounded by its parameters, so it fits the driver at any input size.
    """
    ids = None
    for c in (0, 1):
        one = (labels.filter((F.col("quality") == c) & F.col("doc_id").isNotNull())
               .select("doc_id", F.lit(c).alias("label"), F.xxhash64("doc_id").alias("h"))
               .orderBy("h", "doc_id").limit(2 * rules.sample_docs))
        ids = one if ids is None else ids.unionByName(one)
    # the id sample has a fixed size, so it may be broadcast whatever the tables' sizes
    rows = (docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.length("text") <= rules.sample_chars))
            .join(F.broadcast(ids), "doc_id").groupBy("label", "h", "doc_id").agg(F.max("text").alias("text")))
    got = {c: rows.filter(F.col("label") == c).orderBy("h", "doc_id").limit(rules.sample_docs) for c in (0, 1)}
    return fit_documents([(row["text"], row["label"]) for row in got[0].unionByName(got[1]).toLocalIterator()], rules)


def repeat_words(words: list[str]) -> int:
    """Words that stand in a 3-word window found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[str, int] = {}
    at = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    # ids of pairs of words are dense again, so products stay below n * n
    _, pairs = np.unique(at[:-1] * len(ids) + at[1:], return_inverse=True)
    _, which, count = np.unique(pairs[:-1] * len(ids) + at[2:], return_inverse=True, return_counts=True)
    often = count[which] > 1
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : k + n - 2] |= often
    return int(hit.sum())


def judge(text: str | None, unary: np.ndarray, pair: np.ndarray, rules: QualityRules) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_words, kept)."""
    lines = (text or "").split("\n")
    tokens = [words_of(x) for x in lines]
    words = [w for t in tokens for w in t]
    n = len(words)
    seen, n_dup = set(), 0
    for line, t in zip(lines, tokens, strict=True):
        if t:
            n_dup += line in seen
            seen.add(line)
    repeats = repeat_words(words)
    n_symbols = symbols_in(text or "")
    failed = n < rules.min_words or 100 * repeats > rules.max_repeat_percent * n
    content = 0
    if n:
        sizes = np.array([len(t) for t in tokens if t])
        labels = viterbi(line_features(lines, tokens) @ unary.T, pair)
        content = int(sizes[labels == 1].sum())
    return n, sum(map(len, words)), n_symbols, n_dup, repeats, failed, content, not failed and content >= rules.min_content_share * n


METRICS = (("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"),
           ("base_failed", "boolean"), ("content_words", "long"), ("kept", "boolean"))


def assess(docs: DataFrame, field: LineField, rules: QualityRules = QualityRules(), only_kept: bool = False) -> DataFrame:
    """``docs`` with the metrics of ``text`` behind its columns (metric names get ``_`` where taken).

    One pass without a shuffle.  ``only_kept`` drops rejected rows before they leave Python, and
    returns the columns of ``docs`` alone.
    """
    at = docs.columns.index("text")
    names = fresh(docs, *[n for n, _ in METRICS])
    kinds = {"long": (T.LongType(), pa.int64()), "boolean": (T.BooleanType(), pa.bool_())}
    schema = docs.schema if only_kept else T.StructType(docs.schema.fields + [T.StructField(n, kinds[k][0]) for n, (_, k) in zip(names, METRICS, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unary, pair = np.array(field.unary), np.array(field.pair)
        for batch in batches:
            rows = [judge(x.as_py(), unary, pair, rules) for x in batch.column(at)]
            if only_kept:
                yield batch.filter(pa.array([r[-1] for r in rows], pa.bool_()))
            else:
                cols = [pa.array([r[i] for r in rows], kinds[k][1]) for i, (_, k) in enumerate(METRICS)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *names])

    return docs.mapInArrow(freeing(run), schema)
