"""SentencePiece BPE with seeded merge-dropout, and its decoder.

Encoding starts from the characters of a text and keeps merging the adjacent
pair whose union is the best piece (leftmost first among equals), as the
library does.  Under dropout a candidate merge - two adjacent spans of one
text - is skipped when a hash keyed by seed, text id and the spans' places
falls below the rate.  The hash makes a skip a property of the candidate, so
segmentations vary between texts, places and seeds, yet are the same wherever
and however often a text is encoded.  With rate 0 the result is the library's.

No piece of a vocabulary with whole-word pieces spans a space after another
character, so texts fall into units that merge independently.  The agenda of
many short units runs in NumPy passes, one merge per unit and pass; units of
more than ``LONG_UNIT`` characters use a heap.

Characters without a piece become byte pieces, as does a literal U+2581 (which
would otherwise decode to a space), so every text decodes to itself.

Very long texts are encoded whole, some units at a time: a text is cut behind
about ``SPLIT_CHARS`` characters, at the next place where a unit begins, however
far that lies (never, if the vocabulary has pieces that span a space).  Units of
any length use the heap, so a NumPy pass holds short units only, some
``SPLIT_CHARS`` + ``CHUNK_CHARS`` characters of them at most.

Defined results: null and empty texts have no pieces; repeated rows get equal
pieces; a null id is one key like any other; an empty table gives an empty
result; other columns may have any name.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import list_column, map_batches, mix

RATE, SEED = 0.1, 1
SPACE = 0x2581
LONG_UNIT = 192
CHUNK_CHARS = 1 << 17
SPLIT_CHARS = 1 << 20
NONE = np.int64(1) << 40
_U = np.uint64
_SLOTS = 1 << 20

_models: dict[str, "Model"] = {}


class Model:
    """Pieces, merge table and byte pieces of a SentencePiece BPE model file."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        text = [sp.id_to_piece(i) for i in range(n)]
        byte = [sp.is_byte(i) for i in range(n)]
        self.byte_ids = np.zeros(256, np.int32)
        self.bytes: list[bytes] = []
        known: dict[str, int] = {}
        for i in range(n):
            if byte[i]:
                value = int(text[i][3:5], 16)
                self.byte_ids[value] = i
                self.bytes.append(bytes([value]))
            elif special[i]:
                self.bytes.append(b"")
            else:
                known[text[i]] = i
                self.bytes.append(text[i].replace("▁", " ").encode())
        self.n = n
        # characters that occur only inside longer pieces can merge, though they are no pieces themselves
        symbols = dict(known)
        for p in known:
            for c in p:
                symbols.setdefault(c, len(symbols) + n)
        self.width = max(symbols.values(), default=0) + 1
        self.chars = np.full(0x110000, -1, np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.chars[ord(s)] = i
        self.joins = any("▁" in p.lstrip("▁") for p in known)
        # rank: best score first; equal scores share a rank
        scores = np.array([sp.get_score(known[p]) for p in known])
        rank = dict(zip(known, (np.unique(-scores, return_inverse=True)[1]).tolist()))
        left, right, into, order = [], [], [], []
        for p, i in known.items():
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    into.append(i)
                    order.append(rank[p])
        key = np.array(left, np.int64) * self.width + np.array(right, np.int64)
        self.pairs = dict(zip(key.tolist(), zip(order, into)))
        self.keys, self.slot_rank, self.slot_into = (np.full(_SLOTS, -1, np.int64), np.zeros(_SLOTS, np.int64),
                                                     np.zeros(_SLOTS, np.int32))
        rest = np.arange(len(key))
        at = self._slot(key)
        while len(rest):
            free = self.keys[at[rest]] < 0
            take = rest[free][np.unique(at[rest[free]], return_index=True)[1]]
            self.keys[at[take]], self.slot_rank[at[take]] = key[take], np.array(order)[take]
            self.slot_into[at[take]] = np.array(into)[take]
            rest = rest[self.keys[at[rest]] != key[rest]]
            at[rest] = (at[rest] + 1) % _SLOTS

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(_U) * _U(0x9E3779B97F4A7C15)) >> _U(44)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of the merge of each pair, or -1."""
        key = a.astype(np.int64) * self.width + b
        at = self._slot(key)
        got = self.keys[at]
        out = np.where(got == key, at, -1)
        open_ = np.flatnonzero((got != key) & (got >= 0) & (a >= 0) & (b >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % _SLOTS
            got = self.keys[at[open_]]
            hit = got == key[open_]
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit & (got >= 0)]
        out[(a < 0) | (b < 0)] = -1
        return out

    def decode(self, ids) -> str:
        """The text whose pieces these are."""
        return b"".join(map(self.bytes.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def _key(seed: int, key: np.ndarray) -> np.ndarray:
    return mix(np.asarray(key, np.int64).view(_U) ^ mix(np.array([seed], np.int64).view(_U)))


def _dropped(key: np.ndarray, begin: np.ndarray, middle: np.ndarray, end: np.ndarray, rate: float) -> np.ndarray:
    """Whether the merge of [begin, middle) and [middle, end) of a text is skipped."""
    if rate <= 0:
        return np.zeros(len(begin), bool)
    h = mix(key + begin.astype(_U) * _U(0xD1342543DE82EF95) + middle.astype(_U) * _U(0xA0761D6478BD642F)
            + end.astype(_U) * _U(0xE7037ED1A0B428DB))
    return (h >> _U(11)).astype(np.float64) * 2.0 ** -53 < rate


_WORD = (1 << 64) - 1


def _mixed(x: int) -> int:
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & _WORD
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & _WORD
    return x ^ x >> 31


def _skipped(key: int, begin: int, middle: int, end: int, rate: float) -> bool:
    """``_dropped`` of one candidate."""
    if rate <= 0:
        return False
    h = _mixed(key + begin * 0xD1342543DE82EF95 + middle * 0xA0761D6478BD642F + end * 0xE7037ED1A0B428DB & _WORD)
    return (h >> 11) * 2.0 ** -53 < rate


def _agenda(m: Model, sym: list[int], begin: int, key: int, rate: float) -> list[tuple[int, int]]:
    """(place, symbol) of one unit's pieces by a heap of candidate merges."""
    n = len(sym)
    size, prev, nxt = [1] * n, list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = nxt[i]
        if i < 0 or j >= n or sym[i] < 0 or sym[j] < 0:
            return
        got = m.pairs.get(sym[i] * m.width + sym[j])
        if got is not None and not _skipped(key, begin + i, begin + j, begin + j + size[j], rate):
            heapq.heappush(heap, (got[0], i, size[i], size[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i] if size[i] else n
        if size[i] != a or j >= n or size[j] != b:
            continue
        sym[i] = m.pairs[sym[i] * m.width + sym[j]][1]
        size[i], size[j] = a + b, 0
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
        if prev[i] >= 0:
            offer(prev[i])
        offer(i)
    return [(i, sym[i]) for i in range(n) if size[i]]


def _segment(m: Model, codes: np.ndarray, place: np.ndarray, unit: np.ndarray, key: np.ndarray, rate: float) -> np.ndarray:
    """Symbol at the first character of each piece, -2 elsewhere.  ``place`` is the position in
    the text, ``unit`` a non-decreasing unit number and ``key`` the text's key, per character."""
    sym = m.chars[codes]
    out = np.full(len(codes), -2, np.int32)
    length = np.bincount(unit)
    if (length > LONG_UNIT).any():
        begin = np.concatenate([[0], np.cumsum(length)])
        for u in np.flatnonzero(length > LONG_UNIT):
            lo, hi = begin[u], begin[u + 1]
            for i, s in _agenda(m, sym[lo:hi].tolist(), int(place[lo]), int(key[lo]), rate):
                out[lo + i] = s
        at = np.flatnonzero(length[unit] <= LONG_UNIT)
    else:
        at = np.arange(len(codes))
    # per symbol: where it begins, its end, symbol, unit, rank and slot of its merge with the next one
    sym, unit, end = sym[at], unit[at], at + 1

    def candidates(i: np.ndarray, sym, at, end, rank, slot) -> None:
        got = m.find(sym[i], sym[i + 1])
        ok = np.flatnonzero(got >= 0)
        j = i[ok]
        ok = ok[~_dropped(key[at[j]], place[at[j]], place[at[j + 1]], place[end[j + 1] - 1] + 1, rate)]
        rank[i], slot[i] = NONE, -1
        rank[i[ok]], slot[i[ok]] = m.slot_rank[got[ok]], got[ok]

    rank, slot = np.full(len(at), NONE), np.full(len(at), -1)
    inner = np.flatnonzero(unit[1:] == unit[:-1])
    candidates(inner, sym, at, end, rank, slot)
    while len(at):
        first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        best = np.minimum.reduceat((rank << 22) | np.arange(len(at)), first)
        busy = best < (NONE << 22)
        if not busy.all():
            live = np.repeat(busy, np.diff(np.r_[first, len(at)]))
            out[at[~live]] = sym[~live]
            # positions shift as finished units leave
            shift = np.cumsum(~live)
            best = best[busy]
            i = (best & ((1 << 22) - 1)) - shift[best & ((1 << 22) - 1)]
            at, sym, unit, end, rank, slot = (x[live] for x in (at, sym, unit, end, rank, slot))
            if not len(at):
                break
        else:
            i = best & ((1 << 22) - 1)
        sym[i] = m.slot_into[slot[i]]
        end[i] = end[i + 1]
        keep = np.ones(len(at), bool)
        keep[i + 1] = False
        i = i - np.arange(len(i))
        at, sym, unit, end, rank, slot = (x[keep] for x in (at, sym, unit, end, rank, slot))
        rank[i], slot[i] = NONE, -1
        left, right = i[i > 0] - 1, i[i + 1 < len(at)]
        todo = np.concatenate([left[unit[left] == unit[left + 1]], right[unit[right] == unit[right + 1]]])
        candidates(todo, sym, at, end, rank, slot)
    return out


def _chunks(texts: list[str], joins: bool) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Groups of (text, position, characters with spaces as U+2581); long texts are cut between units."""
    group, size = [], 0
    for t, text in enumerate(texts):
        if not text:
            continue
        codes = np.frombuffer((" " + text).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        # a literal U+2581 has no piece of its own
        codes = np.where(codes == SPACE, 0x10FFFF, np.where(codes == 32, SPACE, codes))
        at = 0
        while at < len(codes):
            end = len(codes)
            if not joins and end - at > SPLIT_CHARS:
                # the first place behind the limit where a unit begins, looked for block by block
                for lo in range(at + SPLIT_CHARS, end, SPLIT_CHARS):
                    hi = min(lo + SPLIT_CHARS, end)
                    cut = np.flatnonzero((codes[lo:hi] == SPACE) & (codes[lo - 1:hi - 1] != SPACE))
                    if len(cut):
                        end = lo + int(cut[0])
                        break
            group.append((t, at, codes[at:end]))
            size += end - at
            at = end
            if size >= CHUNK_CHARS:
                yield group
                group, size = [], 0
    if group:
        yield group


def encode(m: Model, texts: list[str], keys: np.ndarray, rate: float = RATE, seed: int = SEED) -> list[np.ndarray]:
    """The piece ids of each text."""
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    hashed = _key(seed, keys)
    for group in _chunks(texts, m.joins):
        codes = np.concatenate([c for _, _, c in group])
        n = np.array([len(c) for _, _, c in group])
        member = np.repeat(np.arange(len(group)), n)
        begin = np.concatenate([[0], np.cumsum(n)])
        place = np.arange(len(codes)) - begin[member] + np.array([p for _, p, _ in group])[member]
        starts = np.zeros(len(codes), bool)
        starts[begin[:-1]] = True
        if not m.joins:
            starts[1:] |= (codes[1:] == SPACE) & (codes[:-1] != SPACE)
        text = np.array([t for t, _, _ in group])[member]
        out = _segment(m, codes, place, np.cumsum(starts) - 1, hashed[text], rate)
        at = np.flatnonzero(out != -2)
        ids, owner = out[at], member[at]
        odd = (ids < 0) | (ids >= m.n)
        if odd.any():
            raw = [chr(SPACE if c == 0x10FFFF else c).encode("utf-8", "surrogatepass") for c in codes[at[odd]].tolist()]
            count = np.ones(len(ids), np.int64)
            count[odd] = [len(r) for r in raw]
            owner = np.repeat(owner, count)
            wide = np.repeat(odd, count)
            ids = np.repeat(ids, count)
            ids[wide] = m.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        cut = np.searchsorted(owner, np.arange(len(group) + 1))
        for k, (t, _, _) in enumerate(group):
            parts[t].append(ids[cut[k]:cut[k + 1]])
    return [np.concatenate(p).astype(np.int32) if p else np.zeros(0, np.int32) for p in parts]


def add_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE,
               seed: int = SEED) -> DataFrame:
    """(row: all columns of docs, pieces: ids of the text under dropout keyed by its id)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"),
                       F.xxhash64(F.col(f"`{id_col}`")).alias("key"))
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            for i in range(0, len(b), 500):
                part = b.slice(i, 500)
                got = encode(m, part.column(1).to_pylist(), part.column(2).to_numpy(), rate, seed)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), list_column(np.concatenate(got), np.array([len(x) for x in got]), pa.int32())],
                    names=["row", "pieces"])

    return map_batches(rows, run, f"row {kind}, pieces array<int>")


def decode_column(rows: DataFrame, path: str, pieces_col: str = "pieces", out: str = "decoded") -> DataFrame:
    """All columns of rows and the text that the pieces decode to."""
    kept = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(f"`{pieces_col}`").alias("pieces"))
    kind = kept.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            texts = [m.decode(ids) if ids else "" for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["row", out])

    done = map_batches(kept, run, f"row {kind}, `{out}` string")
    return done.select(*[F.col("row")[c].alias(c) for c in rows.columns], out)


def round_trip_report(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE,
                      seed: int = SEED) -> DataFrame:
    """id, n_bytes, n_pieces, pieces_sha256 (of the ids as 32-bit little-endian), lossless."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("key"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            for i in range(0, len(b), 500):
                part = b.slice(i, 500)
                texts = [t or "" for t in part.column(1).to_pylist()]
                got = encode(m, texts, part.column(2).to_numpy(), rate, seed)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                     pa.array([len(x) for x in got], pa.int64()),
                     pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in got]),
                     pa.array([m.decode(x.tolist()) == t if len(x) else not t for x, t in zip(got, texts)])],
                    names=[id_col, "n_bytes", "n_pieces", "pieces_sha256", "lossless"])

    return map_batches(rows, run, f"`{id_col}` {kind}, n_bytes long, n_pieces long, pieces_sha256 string, lossless boolean")
