"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NO_ID = 2**63 - 1


def sha(x: bytes | str) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def components(n: int, links) -> list[int]:
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def secrets(text: str | None) -> tuple:
    text = text or ""
    spans = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m[2]) >= 6:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    spans.sort()
    return *(sum(s[1] == k for s in spans) for k in range(3)), sha(",".join(f"{['assign', 'access', 'hex'][k]}:{a}:{b}" for a, k, b in spans))


def suffixes(texts: list[str | None], span: int = 200) -> list[tuple]:
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[p : p + span] for t in raw for p in range(len(t) - span + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for p in range(len(t) - span + 1):
            if seen[t[p : p + span]] > 1:
                gone[p : p + span] = b"\1" * span
        runs = sum(1 for i in range(len(t)) if gone[i] and (not i or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, sha(bytes(b for b, x in zip(t, gone, strict=True) if not x))))
    return out


def fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def simhash(rows: list[tuple]) -> list[tuple]:
    """(id, fingerprint, component) of (id, text)."""
    fps = [fingerprint(t) for _, t in rows]
    part = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    least: dict = defaultdict(lambda: None)
    for (i, _), c in zip(rows, part, strict=True):
        if i is not None:
            least[c] = i if least[c] is None else min(least[c], i)
    return [(i, f"{f:016x}", least[c]) for (i, _), f, c in zip(rows, fps, part, strict=True)]


def line_dedup(rows: list[tuple]) -> list[tuple]:
    """(n_lines, n_dropped, kept text) of (id, text)."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(NO_ID if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == (NO_ID if i is None else i)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def decontaminate(texts: list[str | None], items: list[tuple]) -> list[tuple]:
    """(n_words, n_hit, item ids) of each text."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(8, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[s : s + n])].add("" if i is None else str(i))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[s : s + n]))) is not None:
                    hit |= set(range(s, s + n))
                    found |= ids
        out.append((len(w), len(hit), sorted(found)))
    return out


def quality_base(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    pattern = r"[^\x20\x09-\x0D]+"
    words = re.findall(pattern, text)
    lines = [x for x in text.split("\n") if re.search(pattern, x)]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words)


def shingles(text: str, n: int = 5) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOW))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b)


def chain_best(unary: np.ndarray, pair: np.ndarray) -> float:
    """The best score of any labelling, by trying all."""
    import itertools

    return max(sum(unary[t, y] for t, y in enumerate(ys)) + sum(pair[a, b] for a, b in itertools.pairwise(ys)) for ys in itertools.product((0, 1), repeat=len(unary)))


def paragraphs(rows: list[tuple], min_words: int, min_sentence: int = 8, similarity: float = 0.8) -> list[tuple]:
    """(doc_id, start, end, first doc_id, start, end, removed) of (id, text); bytes."""
    units = []  # id, start, end, words, is line
    for i, t in rows:
        raw, at = (t or "").encode(), 0
        for line in raw.split(b"\n"):
            words = [(at + m.start(), at + m.end(), m[0].decode().translate(LOW)) for m in re.finditer(rb"[^\x20\x09-\x0D]+", line)]
            at += len(line) + 1
            if len(words) < min_words:
                continue
            units.append((NO_ID if i is None else i, words[0][0], words[-1][1], tuple(w for *_, w in words), True))
            sentence = []
            for k, w in enumerate(words):
                sentence.append(w)
                if w[2][-1] in ".!?" or k + 1 == len(words):
                    if min_sentence <= len(sentence) < len(words):
                        units.append((NO_ID if i is None else i, sentence[0][0], sentence[-1][1], tuple(x for *_, x in sentence), False))
                    sentence = []
    by, links = {}, []
    for k, u in enumerate(units):
        links.append((by.setdefault(u[3], k), k))
    grams = {k: {u[3][j : j + 5] for j in range(len(u[3]) - 4)} for k, u in enumerate(units) if u[4]}
    held = defaultdict(set)
    for k, g in grams.items():
        for x in g:
            held[x].add(k)
    links += [(k, j) for k, g in grams.items() for j in {j for x in g for j in held[x]} if j < k and jaccard(g, grams[j]) >= similarity]
    part = components(len(units), links)
    groups = defaultdict(list)
    for u, c in zip(units, part, strict=True):
        groups[c].append(u[:3])
    none = lambda u: (None if u[0] == NO_ID else u[0], *u[1:])
    out = []
    for us in groups.values():
        if len(us) > 1:
            us.sort()
            out += [(*none(u), *none(us[0]), k > 0) for k, u in enumerate(us)]
    return out


def licenses(rows: list[tuple], templates: list[tuple], min_shared: int, min_score: float = 0.5) -> dict:
    """row -> (license, score) of (row, units), every unit compared with every template."""
    terms = lambda text: Counter((ws := re.findall("[a-z0-9]+", text.lower())) + [f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)])
    known = [(name, terms(body)) for name, body in templates]
    shared = {t for _, c in known for t in c if " " in t}
    counted = [(r, terms(u)) for r, units in rows for u in units]
    sure = [(r, c) for r, c in counted if len(shared & c.keys()) >= min_shared]
    df = Counter(t for _, t in {(r, t) for r, c in sure for t in c})
    total = len({r for r, _ in sure})
    weigh = lambda c: {t: n * (np.log((1 + total) / (1 + df[t])) + 1) for t, n in c.items()}
    norm = lambda v: sum(x * x for x in v.values()) ** 0.5
    vectors = [(name, v, norm(v)) for name, v in ((name, weigh(c)) for name, c in known)]
    best = {}
    for r, c in counted:
        own = weigh(c)
        for name, v, size in vectors:
            score = sum(x * v[t] for t, x in own.items() if t in v) / (size * norm(own) or 1)
            if score >= min_score:
                best[r] = min(best.get(r, (0, "")), (-round(score, 6), name))
    return {r: (name, -score) for r, (score, name) in best.items()}
