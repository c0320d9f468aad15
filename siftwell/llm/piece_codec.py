"""SentencePiece encoding and decoding by suffix-array matching.

Texts are taken in blocks and cut into chunks (a run of word marks and what follows up to the next mark; no
piece reaches over such a cut, which is checked when the model is loaded).  Equal chunks have equal ids, so of the
batch text only distinct chunks that the task has not met before are joined and indexed by a suffix array.  Every
piece of the model is then searched for by bisection, which gives the range of its occurrences; these are edges from
position to position.  The edges are put in order of position (one slot for each position and length).  The
vocabulary is a BPE one, so relaxation follows its merge order: in each round every chunk joins the adjacent pair of
symbols whose edge has the best score, leftmost first.  What no piece covers falls back to bytes.

The ids equal the library's for the same model.  Null text: null ids, no pieces.  Empty text: no ids.
A word mark in a text decodes to a space, as in the library.  A long text is taken whole, slice by slice (cut where a
chunk begins).  Repeated rows and ties are encoded each by itself; ties of scores merge leftmost first.  An empty table
gives no rows.  Extra columns pass through; names of new columns get ``_`` where they are taken.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import freeing, fresh, text_blocks

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Bytes of texts, code points of a slice and code points of new chunks that are taken at once.
BLOCK_BYTES, SLICE_CHARS, INDEX_CHARS = 1 << 20, 1 << 19, 1 << 18
#: Code points of a suffix that are compared as one number.
PACKED = 4
#: Chunks with more code points are merged with a heap of their own.
LONG = 64
#: Code points of chunks remembered within a task; at this many it starts anew.
REMEMBER_CHARS = 1 << 20


class PieceModel:
    def __init__(self, path: str = DEFAULT_MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.is_byte = [sp.is_byte(i) for i in range(size)]
        self.is_silent = [sp.is_control(i) or sp.is_unknown(i) for i in range(size)]
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(size) if self.is_byte[i]}
        self.unknown = sp.unk_id()
        normal = [i for i in range(size) if not (self.is_byte[i] or self.is_silent[i] or sp.is_unused(i))]
        if any(re.search(f"[^{MARK}]{MARK}", self.pieces[i]) for i in normal):
            raise ValueError("a piece of this model reaches over a word mark")
        self.ids = np.array(normal, np.int32)
        scores = np.array([sp.get_score(i) for i in normal])
        self.order = np.unique(-scores, return_inverse=True)[1].astype(np.int64)  # 0 is merged first
        self.lengths = np.array([len(self.pieces[i]) for i in normal], np.int64)
        self.longest = int(self.lengths.max())
        points = [np.frombuffer(self.pieces[i].encode("utf-32-le"), np.uint32) for i in normal]
        self.alphabet = np.unique(np.concatenate(points))
        self.codes = np.zeros((len(normal), self.longest), np.int32)
        for r, p in enumerate(points):
            self.codes[r, : len(p)] = np.searchsorted(self.alphabet, p) + 1
        # a number for the first PACKED code points of each piece; shorter ones are filled with zeros
        self.bits = int(len(self.alphabet) + 1).bit_length()
        if self.bits * PACKED > 62:
            raise ValueError("the alphabet of this model is too large")
        self.heads = np.zeros(len(normal), np.int64)
        for i in range(PACKED):
            self.heads = (self.heads << self.bits) | self.codes[:, i]
        spelled = [bytes([int(p[3:5], 16)]) if self.is_byte[i] else b"" if self.is_silent[i] else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_ends = np.append(0, np.cumsum([len(x) for x in spelled]))
        self.known: dict[str, int]
        self.reset()

    def reset(self) -> None:
        self.known, self.known_chars = {}, 0
        self.flat, self.used, self.ends = np.zeros(1 << 16, np.int32), 0, [np.zeros(1, np.int64)]

    def ends_array(self) -> np.ndarray:
        """Where the ids of each known chunk end, after a zero."""
        if len(self.ends) > 1:
            self.ends = [np.concatenate(self.ends)]
        return self.ends[0]

    # -- index ---------------------------------------------------------------------------------

    def suffix_order(self, codes: np.ndarray) -> np.ndarray:
        """Positions in the order of the text from there on, as far as the longest piece (prefix doubling)."""
        rank, width, n = codes.astype(np.int64), 1, len(codes)
        while width < self.longest:
            behind = np.zeros(n, np.int64)
            behind[: n - width] = rank[width:] + 1 if n > width else 0
            rank = np.unique(rank * (int(rank.max()) + 2) + behind, return_inverse=True)[1]
            width *= 2
        return np.argsort(rank, kind="stable").astype(np.int32)

    def occurrences(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, piece number) of every occurrence of every piece."""
        order = self.suffix_order(codes)
        padded = np.concatenate([codes, np.zeros(self.longest, codes.dtype)])
        here = np.zeros(len(self.alphabet) + 1, bool)
        here[codes] = True
        here[0] = True
        which = np.flatnonzero(here[self.codes].all(axis=1)).astype(np.int32)
        # the first PACKED code points of a suffix are one number, in the same order
        heads = np.zeros(len(order), np.int64)
        for i in range(PACKED):
            heads = (heads << self.bits) | padded[order + i]
        least = self.heads[which]
        most = least + (np.int64(1) << (self.bits * np.maximum(PACKED - self.lengths[which], 0))) - 1
        low, high = np.searchsorted(heads, least, "left"), np.searchsorted(heads, most, "right")
        found = low < high
        which, low, high = which[found], low[found], high[found]
        long = np.flatnonzero(self.lengths[which] > PACKED)
        want, size = self.codes[which[long]], self.lengths[which[long]]
        inside = np.arange(self.longest) < size[:, None]
        rows = np.arange(len(long))

        def bisect(past_equal: bool) -> np.ndarray:
            lo, hi = low[long], high[long]
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                at = order[np.minimum(mid, len(order) - 1)]
                text = padded[at[:, None] + np.arange(self.longest)]
                differs = (text != want) & inside
                first = differs.argmax(axis=1)
                less = np.where(differs[rows, first], text[rows, first] < want[rows, first], past_equal)
                lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
            return lo

        if len(long):
            ends = bisect(False), bisect(True)
            low[long], high[long] = ends
        count = high - low
        at = np.arange(count.sum()) + np.repeat(low - (np.cumsum(count) - count), count)
        return order[at], np.repeat(which, count)

    # -- encode --------------------------------------------------------------------------------

    def learn(self, chunks: list[str]) -> None:
        """Encode distinct chunks and remember them."""
        text = "".join(chunks)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        begins = np.cumsum(sizes) - sizes
        near = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        codes = np.where(self.alphabet[near] == points, near + 1, 0).astype(np.int32)
        n = len(codes)
        chunk_of = np.repeat(np.arange(len(chunks)), sizes)
        limit = (begins + sizes)[chunk_of]
        at, piece = self.occurrences(codes)
        ok = at + self.lengths[piece] <= limit[at]
        edge = np.full((n, self.longest), -1, np.int32)  # by position, then by length
        edge[at[ok], self.lengths[piece[ok]] - 1] = piece[ok]

        starts = np.arange(n)
        done: list[np.ndarray] = []
        slow = sizes > LONG
        for c in np.flatnonzero(slow):
            done.append(self.merge_long(edge, int(begins[c]), int(begins[c] + sizes[c])))
        live = starts[~slow[chunk_of]]
        never = np.int64(1) << 62
        while len(live):
            chunk = chunk_of[live]
            nxt = np.append(live[1:], n)
            same = np.append(chunk[1:] == chunk[:-1], False)
            end = np.where(np.append(same[1:], False), np.append(live[2:], [n, n])[: len(live)], limit[live])
            span = end - live
            fits = same & (span <= self.longest)
            found = np.full(len(live), -1, np.int64)
            found[fits] = edge[live[fits], span[fits] - 1]
            key = np.where(found >= 0, self.order[found] * (n + 1) + np.arange(len(live)), never)
            heads = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
            best = np.minimum.reduceat(key, heads)
            active = best < never
            go = np.repeat(active, np.diff(np.append(heads, len(live))))
            done.append(live[~go])
            gone = best[active] % (n + 1) + 1
            stay = go.copy()
            stay[gone] = False
            live = live[stay]
        cuts = np.sort(np.concatenate(done))
        sizes_ = np.append(cuts[1:], n) - cuts
        found = edge[cuts, np.minimum(sizes_, self.longest) - 1]
        ids = np.where(found >= 0, self.ids[found], -1)
        lost = np.flatnonzero(ids < 0)  # single code points without a piece
        owner = chunk_of[cuts]
        if len(lost):
            spelled = [[self.byte_id.get(b, self.unknown) for b in text[cuts[i]].encode("utf-8", "surrogatepass")] for i in lost]
            many = np.ones(len(cuts), np.int64)
            many[lost] = [len(x) for x in spelled]
            ids, owner = np.repeat(ids, many), np.repeat(owner, many)
            ids[ids < 0] = [b for x in spelled for b in x]
        counts = np.bincount(owner, minlength=len(chunks))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.int32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.known_chars += n
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks)), strict=True))
        self.ends.append(self.used + np.cumsum(counts))
        self.used += len(ids)

    def merge_long(self, edge: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """The same merges for one long chunk: symbols in a linked list, candidates in a heap."""
        end = {i: i + 1 for i in range(lo, hi)}
        before = {i + 1: i for i in range(lo, hi - 1)}
        heap: list[tuple[int, int, int, int]] = []

        def offer(a: int) -> None:
            b = end[a]
            if b < hi and end[b] - a <= self.longest and (p := edge[a, end[b] - a - 1]) >= 0:
                heapq.heappush(heap, (int(self.order[p]), a, b, end[b]))

        for i in range(lo, hi - 1):
            offer(i)
        while heap:
            _, a, b, e = heapq.heappop(heap)
            if end.get(a) != b or end.get(b) != e:
                continue
            end[a] = e
            del end[b]
            before.pop(b, None)
            if e < hi:
                before[e] = a
            offer(a)
            if a in before:
                offer(before[a])
        return np.array(sorted(end), np.int64)

    def encode_slice(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) of texts that begin with a word mark, with marks for spaces."""
        find = _CHUNK.findall
        cut = [find(t) for t in texts]
        if self.known_chars > REMEMBER_CHARS:
            self.reset()
        new, size = [], 0
        for chunk in set().union(*cut).difference(self.known):
            new.append(chunk)
            size += len(chunk)
            if size > INDEX_CHARS:
                self.learn(new)
                new, size = [], 0
        if new:
            self.learn(new)
        many = np.fromiter(map(len, cut), np.int64, len(cut))
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, int(many.sum()))
        ends = self.ends_array()
        first = ends[at]
        count = ends[at + 1] - first
        total = np.append(0, np.cumsum(count))
        ids = self.flat[np.arange(total[-1]) + np.repeat(first - total[:-1], count)]
        return ids, np.diff(total[np.append(0, np.cumsum(many))])

    def encode_block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, end of each text's ids)."""
        parts, owners, counts = [], [], []
        held, of, size = [], [], 0

        def flush() -> None:
            ids, many = self.encode_slice(held)
            parts.append(ids), counts.append(many), owners.append(np.array(of, np.int64))
            held.clear(), of.clear()

        for k, text in enumerate(texts):
            if not text:
                continue
            for part in _slices(MARK + text.replace(" ", MARK)):
                held.append(part), of.append(k)
                size += len(part)
                if size > SLICE_CHARS:
                    flush()
                    size = 0
        if held:
            flush()
        sizes = np.zeros(len(texts), np.int64)
        for own, many in zip(owners, counts, strict=True):
            np.add.at(sizes, own, many)
        return np.concatenate([np.zeros(0, np.int32), *parts]), np.cumsum(sizes)

    # -- decode --------------------------------------------------------------------------------

    def decode_block(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The text of each run of ids; invalid bytes become U+FFFD, one leading space goes."""
        raw, upto = [], [np.zeros(1, np.int64)]
        for lo in range(0, len(ids), SLICE_CHARS):
            own = ids[lo : lo + SLICE_CHARS]
            begin = self.spelled_ends[own]
            count = self.spelled_ends[own + 1] - begin
            total = np.cumsum(count)
            raw.append(self.spelled[np.arange(total[-1]) + np.repeat(begin - (total - count), count)].tobytes())
            upto.append(upto[-1][-1] + total)
        joined, cuts = b"".join(raw), np.concatenate(upto)
        out, lo = [], 0
        for hi in cuts[ends].tolist():
            text = joined[lo:hi].decode("utf-8", "replace")
            out.append(text[1:] if text.startswith(" ") else text)
            lo = hi
        return out


def _slices(text: str) -> Iterator[str]:
    """``text`` in parts of about ``SLICE_CHARS``, cut where a chunk begins."""
    lo, n = 0, len(text)
    while n - lo > SLICE_CHARS:
        at = text.find(MARK, lo + SLICE_CHARS)
        while at >= 0 and text[at - 1] == MARK:
            at = text.find(MARK, at + 1)
        if at < 0:
            break
        yield text[lo:at]
        lo = at
    yield text[lo:]


_MODELS: dict[str, PieceModel] = {}


def model_of(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode(docs: DataFrame, model_path: str = DEFAULT_MODEL, with_ids: bool = True) -> DataFrame:
    """``docs`` followed by piece_ids (unless off), n_pieces, ids_sha256 and round_trip.

    ids_sha256 digests the ids as little-endian 32-bit numbers.  round_trip tells that decoding gives the
    text again (with word marks as spaces).
    """
    at = docs.columns.index("text")
    names = fresh(docs, "piece_ids", "n_pieces", "ids_sha256", "round_trip")
    kinds = [(T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), (T.LongType(), pa.int64()), (T.StringType(), pa.string()), (T.BooleanType(), pa.bool_())]
    skip = 0 if with_ids else 1
    schema = T.StructType(docs.schema.fields + [T.StructField(n, k) for n, (k, _) in zip(names[skip:], kinds[skip:], strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        model = model_of(model_path)
        for batch in batches:
            for lo, hi, _, _ in text_blocks(batch.column(at), BLOCK_BYTES):
                part = batch.column(at).slice(lo, hi - lo).to_pylist()
                ids, ends = model.encode_block([t or "" for t in part])
                begins = np.append(0, ends[:-1]).astype(np.int64)
                digests = [hashlib.sha256(ids[a:b].astype("<i4").tobytes()).hexdigest() for a, b in zip(begins, ends, strict=True)]
                same = [x == (t or "").replace(MARK, " ") for t, x in zip(part, model.decode_block(ids, ends), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(ids)), pa.int32()), pa.array(ids, pa.int32()), mask=pa.array([t is None for t in part]))
                cols = [lists, pa.array(ends - begins, pa.int64()), pa.array(digests), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), *cols[skip:]], names=schema.names)
        model.reset()

    return docs.mapInArrow(freeing(run), schema)


def decode(docs: DataFrame, ids: str = "piece_ids", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """``docs`` followed by the text that the column ``ids`` spells (null for null)."""
    at = docs.columns.index(ids)
    (name,) = fresh(docs, "decoded")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_path)
        for batch in batches:
            column = batch.column(at)
            flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
            texts = [x if ok else None for x, ok in zip(model.decode_block(flat, ends), column.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return docs.mapInArrow(freeing(run), schema)
