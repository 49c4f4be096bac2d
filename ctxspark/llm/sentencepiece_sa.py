"""SentencePiece (BPE with byte fallback) encoding by suffix-array matching, and decoding.

A batch's distinct space-delimited units that the worker doesn't remember are concatenated and indexed by a suffix array (prefix
doubling). Every piece of the vocabulary is binary-searched for its range of occurrences; the resulting
edges (position, piece) are sorted by position and relaxed: in each unit the adjacent pair of symbols
whose joint edge has the best score is merged, leftmost first, until no edge joins two symbols, which is
the model's own result. No piece of such a model has a blank after another character, so units are
independent; a vocabulary that breaks this makes whole texts the units. Tokenizers are read, not trained.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle, ship, slices

BLANK = "▁"
#: Units of more symbols than this are relaxed with a heap of their own instead of in step with others.
LONG_UNIT = 192
MEMO_UNITS = 150_000
#: Bytes of new units that are indexed at once, and bytes of texts encoded at once: bound a worker's memory.
INDEX_BYTES = 150_000
SLICE_BYTES = 1_000_000


class Pieces:
    """The vocabulary: normal pieces with scores, and the ids of bytes. Kinds that text can't produce are left out."""

    def __init__(self, pieces: list[tuple[int, str, float]], byte_ids: list[int], n: int, unknown: int):
        known = [(i, p.encode(), s) for i, p, s in pieces]
        self.ids = np.array([i for i, _, _ in known], np.int32)
        self.bytes = [b for _, b, _ in known]
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.rank = np.array([s for _, _, s in known], np.float64)
        self.byte_ids = np.array(byte_ids, np.int32)
        self.unknown = unknown
        self.span = int(self.sizes.max()) + 1  # an edge is numbered place * span + size
        self.chunks = -(-int(self.sizes.max()) // 8)
        low = np.zeros((len(known), self.chunks * 8), np.uint8)
        high = np.full_like(low, 255)
        for row, b in enumerate(self.bytes):
            low[row, : len(b)] = high[row, : len(b)] = np.frombuffer(b, np.uint8)
        self.low, self.high = (x.view(">u8").astype(np.uint64) for x in (low, high))
        self.splits = not any(BLANK in p.lstrip(BLANK) for _, p, _ in pieces)
        self.decoded: list[bytes] = [b""] * n
        for i, b, _ in known:
            self.decoded[i] = b
        for b, i in enumerate(byte_ids):
            if i >= 0:
                self.decoded[i] = bytes([b])


def load(model_file: str) -> Pieces:
    """Read a SentencePiece BPE model on the driver; models of another kind are refused."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = sp.get_piece_size()
    probe = "ﬁ  Ａ①"  # normalisers would rewrite it
    if sp.decode(sp.encode(probe)) != probe:
        raise ValueError("a model that normalises texts can't be encoded with")
    byte_ids = [-1] * 256
    normal = []
    for i in range(n):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            normal.append((i, piece, sp.get_score(i)))
    return Pieces(normal, byte_ids, n, sp.unk_id())


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by the text from there on (at least `depth` bytes of it), and 8-byte keys of all positions."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key |= padded[j : j + n] << np.uint64(56 - 8 * j)
    order = np.argsort(key)
    rank_by = key
    width = 8
    while width < depth:
        got = rank_by[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate(([1], got[1:] != got[:-1]))).astype(np.uint64)
        after = np.concatenate((rank[width:], np.zeros(min(width, n), np.uint64)))[:n]
        rank_by = (rank << np.uint64(32)) | after
        order = np.argsort(rank_by)
        width *= 2
    return order, key


def occurrences(order: np.ndarray, key: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """For every piece the range [lo, hi) of the suffix array whose texts begin with it."""
    first = key[order]
    lo = np.searchsorted(first, pieces.low[:, 0], "left")
    hi = np.searchsorted(first, pieces.high[:, 0], "right")
    n = len(order)
    for c in range(1, pieces.chunks):
        at = np.flatnonzero((pieces.sizes > 8 * c) & (lo < hi))
        if not len(at):
            break

        def bound(want, strict, a, b, c=c):
            a, b = a.copy(), b.copy()
            while (open_ := a < b).any():
                mid = (a + b) // 2
                place = order[np.minimum(mid, n - 1)] + 8 * c
                there = np.where(place < n, key[np.minimum(place, n - 1)], np.uint64(0))
                less = (there <= want) if strict else (there < want)
                a, b = np.where(open_ & less, mid + 1, a), np.where(open_ & ~less, mid, b)
            return a

        new_lo = bound(pieces.low[at, c], False, lo[at], hi[at])
        new_hi = bound(pieces.high[at, c], True, new_lo, hi[at])
        lo[at], hi[at] = new_lo, new_hi
    return lo, hi


def encode_units(units: list[bytes], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all units one after the other, number of ids of each unit)."""
    data = np.frombuffer(b"".join(units), np.uint8)
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    ends = np.cumsum(sizes)
    order, key = suffix_array(data, int(pieces.sizes.max()))
    lo, hi = occurrences(order, key, pieces)
    count = np.maximum(hi - lo, 0)
    piece = np.repeat(np.arange(len(count), dtype=np.int32), count)
    order = order.astype(np.int32)
    place = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
    unit = np.repeat(np.arange(len(units)), sizes)
    inside = place + pieces.sizes[piece] <= ends[unit[place]] if len(place) else np.zeros(0, bool)
    piece, place = piece[inside], place[inside]
    edges = place.astype(np.int64) * pieces.span + pieces.sizes[piece]
    del place, inside
    by_place = np.argsort(edges)
    edges, piece = edges[by_place], piece[by_place]

    def edge(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The piece of an edge from start to end, -1 without one."""
        if not len(edges):
            return np.full(len(start), -1, np.int64)
        want = start * pieces.span + (end - start)
        at = np.minimum(np.searchsorted(edges, want), len(edges) - 1)
        return np.where((edges[at] == want) & (end - start < pieces.span), piece[at], -1)

    def scores(found: np.ndarray) -> np.ndarray:
        return np.where(found >= 0, pieces.rank[found], -np.inf)

    start = np.flatnonzero((data & 0xC0) != 0x80)
    start = start if sizes.min(initial=1) > 0 else start
    own = unit[start]
    n_symbols = np.bincount(own, minlength=len(units))
    done_start, done_unit = [], []
    long = n_symbols > LONG_UNIT
    if long.any():
        for u in np.flatnonzero(long):
            mine = start[own == u]
            kept = _relax_alone(mine, int(ends[u]), edge, scores)
            done_start.append(kept)
            done_unit.append(np.full(len(kept), u))
        keep = ~long[own]
        start, own = start[keep], own[keep]

    def stop(start, own):
        last = np.concatenate((own[1:] != own[:-1], [True])) if len(own) else np.zeros(0, bool)
        return np.where(last, ends[own], np.concatenate((start[1:], [0]))) if len(own) else start, last

    end, last = stop(start, own)
    after = np.concatenate((end[1:], [0])) if len(end) else end
    score = np.where(last, -np.inf, scores(edge(start, np.where(last, end, after)))) if len(start) else np.zeros(0)
    while len(start):
        heads = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        per = np.diff(np.concatenate((heads, [len(own)])))
        best = np.maximum.reduceat(score, heads)
        active = best > -np.inf
        if not active.all():
            quiet = np.repeat(~active, per)
            done_start.append(start[quiet])
            done_unit.append(own[quiet])
            start, own, end, score = (x[~quiet] for x in (start, own, end, score))
            if not len(start):
                break
            best, per = best[active], per[active]
            heads = np.cumsum(per) - per
        top = np.flatnonzero(score == np.repeat(best, per))
        unit_of_top = own[top]
        pick = top[np.concatenate(([True], unit_of_top[1:] != unit_of_top[:-1]))]  # leftmost of each unit
        end[pick] = end[pick + 1]
        keep = np.ones(len(start), bool)
        keep[pick + 1] = False
        moved = np.cumsum(keep) - 1
        start, own, end, score = (x[keep] for x in (start, own, end, score))
        pick = moved[pick]
        for at in (pick, pick[pick > 0] - 1):
            at = at[own[at] == own[np.minimum(at + 1, len(own) - 1)]]
            at = at[at + 1 < len(own)]
            score[at] = scores(edge(start[at], end[at + 1]))
        tail = pick[(pick + 1 >= len(own))]
        score[tail] = -np.inf
        inner = pick[pick + 1 < len(own)]
        score[inner[own[inner] != own[inner + 1]]] = -np.inf
    if not done_start:
        return np.zeros(0, np.int32), np.zeros(len(units), np.int64)
    start, own = np.concatenate(done_start), np.concatenate(done_unit)
    by_start = np.argsort(start)
    start, own = start[by_start], own[by_start]
    end, _ = stop(start, own)
    found = edge(start, end)
    ids = np.where(found >= 0, pieces.ids[found], -1).astype(np.int32)
    if (found < 0).any():  # bytes instead of an unknown character
        size = np.where(found >= 0, 1, end - start)
        rows = np.repeat(np.arange(len(start)), size)
        nth = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
        raw = pieces.byte_ids[data[start[rows] + nth]]
        ids = np.where(found[rows] >= 0, ids[rows], np.where(raw >= 0, raw, pieces.unknown)).astype(np.int32)
        own = own[rows]
    return ids, np.bincount(own, minlength=len(units))


def _relax_alone(start: np.ndarray, end: int, edge, scores) -> np.ndarray:
    """Symbol starts that remain of one long unit: the same merges with a heap."""
    n = len(start)
    ends = np.concatenate((start[1:], [end]))
    ahead, back = list(range(1, n)) + [-1], list(range(-1, n - 1))
    s, e = start.tolist(), ends.tolist()
    alive = [True] * n
    first = scores(edge(start[:-1], ends[1:])) if n > 1 else np.zeros(0)
    heap = [(-v, i, s[i], e[i + 1]) for i, v in enumerate(first.tolist()) if v > -np.inf]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = ahead[i] if alive[i] else -1
        if j < 0 or s[i] != a or e[j] != b:
            continue
        alive[j] = False
        e[i], ahead[i] = e[j], ahead[j]
        if ahead[j] >= 0:
            back[ahead[j]] = i
        for x in (back[i], i):
            y = ahead[x] if x >= 0 else -1
            if y >= 0:
                v = float(scores(edge(np.array([s[x]]), np.array([e[y]])))[0])
                if v > -np.inf:
                    heapq.heappush(heap, (-v, x, s[x], e[y]))
    return start[np.array(alive)]


def units_of(text: str, splits: bool) -> list[str]:
    """Units of a text, blanks as spaces; a unit that one space precedes is written without it."""
    if not text:
        return []
    text = text.replace(BLANK, " ")
    if not splits:
        return ["  " + text] if not text.startswith(" ") else ["  " + text]
    parts = text.split(" ")
    if "" not in parts:
        return parts
    out, spaces = [], 0
    for p in parts:
        spaces += 1
        if p:
            out.append(p if spaces == 1 else " " * spaces + p)
            spaces = 0
    if spaces:
        out.append(" " * spaces)
    return out


def _unit_bytes(unit: str, splits: bool) -> bytes:
    if not splits:
        unit = unit[1:]
    elif not unit.startswith(" "):
        unit = " " + unit
    return unit.replace(" ", BLANK).encode()


class _Units(dict):
    """Number of each unit; units asked for the first time wait in `new`. start: the first free number."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        n = self[unit] = len(self)
        self.new.append(unit)
        return n


class Encoder:
    """Encodes batches of texts; units already met are remembered (up to a bound)."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self._reset()

    def _reset(self) -> None:
        self.memo = _Units()
        self.ids, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        if len(self.memo) > MEMO_UNITS:
            self._reset()
        splits, memo = self.pieces.splits, self.memo
        per, flat = np.zeros(len(texts), np.int64), []
        for i, t in enumerate(texts):
            if t:
                units = units_of(t, splits)
                per[i] = len(units)
                flat += units
        at = np.fromiter(map(memo.__getitem__, flat), np.int64, len(flat))
        if memo.new:
            new = [_unit_bytes(u, splits) for u in memo.new]
            memo.new = []
            ends = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))
            at_ = 0
            while at_ < len(new):
                stop = max(at_ + 1, int(np.searchsorted(ends, (ends[at_ - 1] if at_ else 0) + INDEX_BYTES, "right")))
                ids, sizes = encode_units(new[at_:stop], self.pieces)
                self.offsets = np.concatenate((self.offsets, self.offsets[-1] + np.cumsum(sizes)))
                self.ids = np.concatenate((self.ids, ids))
                at_ = stop
        begin, size = self.offsets[at], self.offsets[at + 1] - self.offsets[at]
        ends = np.concatenate(([0], np.cumsum(size)))
        shift = np.repeat(begin - ends[:-1], size)
        shift += np.arange(len(shift))
        last = np.cumsum(per)
        return self.ids[shift], ends[last] - ends[last - per]


def decode(ids, pieces: Pieces) -> str:
    """Text of ids: bytes joined, invalid UTF-8 replaced, blanks as spaces, the first space dropped."""
    table = pieces.decoded
    text = b"".join([table[i] for i in ids]).decode("utf-8", "replace").replace(BLANK, " ")
    return text[1:] if text.startswith(" ") else text


def _encoded(pieces: Pieces, column: int):
    """A function from batches to (part of a batch, its texts, ids as a list array, number of ids of each text)."""

    def run(batches):
        encoder = Encoder(pieces)
        for batch in batches:
            for part in slices(batch, column, size=SLICE_BYTES):
                texts = part.column(column).to_pylist()
                ids, counts = encoder.encode(texts)
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                yield part, texts, ids, offsets

    return run


def _listed(ids: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))


def _encode_rows(pieces: Pieces):
    def run(batches):
        for part, texts, ids, offsets in _encoded(pieces, 1)(batches):
            same = [decode(ids[a:b].tolist(), pieces) == (t or "") for a, b, t in zip(offsets[:-1], offsets[1:], texts, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), _listed(ids, offsets), pa.array(same, pa.bool_())], names=["doc_id", "token_ids", "round_trip"])

    return run


def _rows_with_ids(pieces: Pieces):
    def run(batches):
        for part, _, ids, offsets in _encoded(pieces, 1)(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), _listed(ids, offsets)], names=["row", "token_ids"])

    return run


def encode(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """doc_id, token_ids array<int>, round_trip (decoding gives the text) for every row's whole text.

    Null and empty texts have no ids. U+2581 in a text is read as a space, as the model does, so it does
    not round-trip. Repeated rows stay repeated.
    """
    ship(__name__)
    ship(f"{__package__}.common")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encode_rows(pieces), "doc_id long, token_ids array<int>, round_trip boolean")


def with_ids(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """All columns of docs and token_ids (in place of a column of that name). Null and empty texts have no ids."""
    ship(__name__)
    ship(f"{__package__}.common")
    settle(docs.sparkSession)
    kept = [docs[c] for c in docs.columns if c != "token_ids"]
    rows = docs.select(F.struct(*kept).alias("row"), docs["text"].cast("string").alias("text"))
    out = T.StructType([rows.schema["row"], T.StructField("token_ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(_rows_with_ids(pieces), out).select("row.*", "token_ids")


def decode_rows(rows: DataFrame, pieces: Pieces) -> DataFrame:
    """doc_id and text of rows with doc_id and token_ids; null ids give an empty text."""
    ship(__name__)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(x or [], pieces) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("token_ids").cast("array<int>").alias("token_ids")).mapInArrow(run, "doc_id long, text string")
