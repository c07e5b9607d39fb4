"""Removal of long repeated byte strings with a logarithmic family of suffix arrays.

A window is a string of ``length`` bytes.  Its key is the smallest hash among
its ``GRAM``-byte substrings, a function of its bytes alone, so equal windows
meet under one key.  Neighbouring windows whose smallest (leftmost) substring
is the same one form a run, so no run holds a window twice; runs are what is
shuffled: about one row per 85 bytes of text, without the bytes.

* A key that occurs once has no repeated window.  Runs whose bytes occur twice
  (compared by hash) are repeated throughout.  Neither needs its text again.
* What is left, one run for each different content under a shared key, is
  fetched and indexed per key partition by ``SuffixLevels``: each arriving
  batch gets a suffix array of its window starts, is merge-scanned against the
  existing levels for matches of ``length`` bytes, and then becomes a level;
  levels of about equal size merge, so each suffix is merged a logarithmic
  number of times.
* A key with more than ``HOT_RUNS`` different runs is dealt out by window hash
  instead of by key, with partial counts before the shuffle.

Texts are named by their MD5, so copies of a text share their marks and
repeated ids do no harm.  Matches never cross texts.

Defined results: null and empty texts count as empty and keep nothing; texts
shorter than ``length`` are left as they are; a repeated row repeats its whole
text; an empty table gives an empty result; ``remove_repeats`` keeps every
column of its input, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadlens.llm.common import (byte_buffer, map_batches, mix, powers, prefix_sums, slices, span_hashes,
                                 written)
from leadlens.operators.joins import broadcast_if

LENGTH = 200
GRAM = 32
# window starts processed at once, windows of an index partition, and windows spelled out at once
PIECE = 1 << 18
PLACES = np.uint64((1 << 20) - 1)
INDEX_WINDOWS = 200_000
BATCH_WINDOWS = 1 << 13
HOT_RUNS = 4_096
# parts that the runs of one content are dealt into
SALTS = 1_024
# text names (16 bytes each) that may be shipped to every task
BROADCAST_TEXTS = 1_000_000


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1:width - 1 + n])


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(text, start in the text, windows, key, content hash) of the runs of all texts."""
    out = []

    def piece(flat, bounds, text, shift):
        """bounds: text offsets within flat; text: index of each; shift: where flat starts in its text."""
        if len(flat) < length:
            return
        sums = prefix_sums(flat)
        _, inv = powers(len(sums))
        grams = mix((sums[gram:] - sums[:-gram]) * inv[:len(flat) - gram + 1])
        # the smallest gram of each window, leftmost first: its place is in the low bits
        place = _sliding_min((grams & ~PLACES) | np.arange(len(grams), dtype=np.uint64), length - gram + 1) & PLACES
        at = np.arange(len(place))
        doc = np.searchsorted(bounds, at, side="right") - 1
        valid = at + length <= bounds[doc + 1]
        begins = valid.copy()
        begins[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
        s = np.flatnonzero(begins)
        if not len(s):
            return
        ends = valid.copy()
        ends[:-1] &= ~valid[1:] | begins[1:]
        e = np.flatnonzero(ends) + 1
        out.append((text[doc[s]], s - bounds[doc[s]] + shift, e - s, grams[place[s]], span_hashes(sums, s, e - 1 + length)))

    for i, j in slices(offsets, PIECE):
        if j - i == 1 and offsets[j] - offsets[i] > 2 * PIECE:
            for at in range(offsets[i], offsets[j] - length + 1, PIECE):
                flat = data[at:min(at + PIECE + length - 1, offsets[j])]
                piece(flat, np.array([0, len(flat)]), np.array([i]), at - offsets[i])
        else:
            piece(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], np.arange(i, j), 0)
    return out


class SuffixLevels:
    """Suffix arrays of geometrically growing sizes over windows of fixed length.

    A level is a list of window starts in the order of their bytes, with the first eight
    bytes of each as a number; the bytes themselves lie once in ``data``.  That is some
    20 bytes a window.  Windows are only spelled out (``length`` bytes each) for the few
    thousand that one step compares.
    """

    def __init__(self, data: np.ndarray, length: int = LENGTH, block: int = BATCH_WINDOWS):
        self.data, self.length, self.block = data, length, block
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []      # (first eight bytes, start), in order
        self.repeated = np.zeros(len(data) + 1, bool)              # by start

    def _strings(self, starts: np.ndarray, n: int) -> np.ndarray:
        if not len(starts):
            return np.zeros((0, n), np.uint8)
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.data, n)[starts])

    def _spelled(self, starts: np.ndarray) -> np.ndarray:
        return self._strings(starts, self.length).view(f"S{self.length}").ravel()

    def _heads(self, starts: np.ndarray) -> np.ndarray:
        return self._strings(starts, 8).view(">u8").ravel().astype(np.uint64)

    def _place(self, heads: np.ndarray, starts: np.ndarray, level: tuple) -> np.ndarray:
        """For windows in order: the place of each in the level (where its first equal one is or would be)."""
        place, last = np.searchsorted(level[0], heads, "left"), np.searchsorted(level[0], heads, "right")
        open_ = np.flatnonzero(last > place)
        for lo in range(0, len(open_), self.block):
            mine = open_[lo:lo + self.block]
            a, b, own = place[mine], last[mine], self._spelled(starts[mine])
            while (a < b).any():
                live = np.flatnonzero(a < b)
                mid = (a[live] + b[live]) // 2
                less = self._spelled(level[1][mid]) < own[live]
                a[live] = np.where(less, mid + 1, a[live])
                b[live] = np.where(less, b[live], mid)
            place[mine] = a
        return place

    def _equal(self, heads: np.ndarray, starts: np.ndarray, level: tuple, place: np.ndarray) -> np.ndarray:
        out = (place < len(level[0])) & (level[0][np.minimum(place, len(level[0]) - 1)] == heads)
        open_ = np.flatnonzero(out)
        for lo in range(0, len(open_), self.block):
            mine = open_[lo:lo + self.block]
            out[mine] = self._spelled(starts[mine]) == self._spelled(level[1][place[mine]])
        return out

    def add(self, starts: np.ndarray) -> None:
        """Index the windows that begin at ``starts``: a batch of at most some ``block``."""
        order = np.argsort(self._spelled(starts), kind="stable")
        starts = starts[order]
        keys = self._spelled(starts)
        new = np.ones(len(starts), bool)
        new[1:] = keys[1:] != keys[:-1]
        same = np.flatnonzero(~new)
        self.repeated[starts[same]] = True
        self.repeated[starts[same - 1]] = True
        del keys
        starts = starts[new]
        heads = self._heads(starts)
        for level in self.levels:
            place = self._place(heads, starts, level)
            hit = self._equal(heads, starts, level, place)
            self.repeated[starts[hit]] = True
            self.repeated[level[1][place[hit]]] = True
            heads, starts = heads[~hit], starts[~hit]
        if len(starts):
            self.levels.append((heads, starts))
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) >= len(self.levels[-2][0]):
            big, small = self.levels[-2:]
            place = self._place(*small, big)
            self.levels[-2:] = [tuple(np.insert(x, place, y) for x, y in zip(big, small))]


def _name_of(text):
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = byte_buffer(b.column(0))
        names = None
        for text, start, windows, key, content in runs_of(data, offsets):
            if names is None:
                names = pa.array([hashlib.md5(data[offsets[i]:offsets[i + 1]]).digest() for i in range(len(b))], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(text)), pa.array(start, pa.int64()), pa.array(windows, pa.int32()),
                 pa.array(key.view(np.int64)), pa.array(content.view(np.int64))], names=["t", "start", "windows", "key", "content"])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, text, wanted runs) -> the bytes of each wanted run."""
    kind = pa.schema([("key", pa.int64()), ("full", pa.bool_()), ("hot", pa.bool_()), ("t", pa.binary()),
                      ("start", pa.int64()), ("bytes", pa.binary())])
    for b in batches:
        rows = []
        for t, text, wanted in zip(*(c.to_pylist() for c in b.columns)):
            raw = (text or "").encode("utf-8", "surrogatepass")
            for w in wanted:
                rows.append({"key": w["key"], "full": w["full"], "hot": w["hot"], "t": t, "start": w["start"],
                             "bytes": raw[w["start"]:w["start"] + w["windows"] - 1 + LENGTH]})
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_pylist(rows, kind)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, kind)


def _spans(flags: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte spans that the flagged windows of one run cover."""
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return [(int(a), int(b) - 1 + length) for a, b in zip(edge[::2], edge[1::2])]


MARK = "t binary, a long, b long"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, full, hot, t, start, bytes) of whole keys -> spans of repeated windows."""
    parts, runs, size = [], [], 0
    for b in batches:
        data, offsets = byte_buffer(b.column(5))
        parts.append(data.copy())
        for full, name, start, lo, hi in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(),
                                             offsets[:-1].tolist(), offsets[1:].tolist()):
            runs.append((full, name, start, size + lo, hi - lo - LENGTH + 1))
        size += len(data)
    index, held, waiting = SuffixLevels(np.concatenate(parts) if parts else np.zeros(0, np.uint8)), [], 0
    del parts
    for k, (_, _, _, at, n) in enumerate(runs):
        held.append(np.arange(at, at + n))
        waiting += n
        if waiting >= BATCH_WINDOWS or k == len(runs) - 1:
            for lo in range(0, waiting, BATCH_WINDOWS):
                index.add(np.concatenate(held)[lo:lo + BATCH_WINDOWS])
            held, waiting = [], 0
    out = []
    for full, name, start, at, n in runs:
        if not full:
            out += [{"t": name, "a": start + a, "b": start + b} for a, b in _spans(index.repeated[at:at + n], LENGTH)]
    yield pa.RecordBatch.from_pylist(out, pa.schema([("t", pa.binary()), ("a", pa.int64()), ("b", pa.int64())]))


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        _, full, _, names, starts, blobs = (c.to_pylist() for c in b.columns)
        for f, t, s, blob in zip(full, names, starts, blobs):
            raw = np.frombuffer(blob, np.uint8)
            at = np.arange(len(raw) - LENGTH + 1)
            h1 = span_hashes(prefix_sums(raw), at, at + LENGTH)
            h2 = span_hashes(prefix_sums(raw[::-1]), len(raw) - at - LENGTH, len(raw) - at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array([t] * len(at), pa.binary()),
                 pa.array(s + at), pa.array(np.full(len(at), 2 if f else 1))], names=["h1", "h2", "t", "a", "times"])


def repeated_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(t, spans): for each text (by name) that holds repeated windows, the byte spans they cover."""
    texts = docs.select(F.col(text_col).alias("text"))
    runs = written(map_batches(texts, _runs, "t binary, start long, windows int, key long, content long"), "sa-runs")
    keys = written(runs.groupBy("key").agg(F.count("*").alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi"))
                   .filter("n > 1").select("key", (F.col("lo") != F.col("hi")).alias("mixed")), "sa-keys")
    live = written(runs.join(keys, "key"), "sa-live")
    end = F.col("start") + F.col("windows") - 1 + LENGTH
    whole = live.filter("not mixed").select("t", F.col("start").alias("a"), end.alias("b"))
    mixed = live.filter("mixed")
    contents = written(mixed.groupBy("key", "content").agg(
        F.count("*").alias("n"), F.min(F.struct("t", "start", "windows")).alias("one")), "sa-contents")
    # runs of equal bytes that meet within a salt need no look at the whole content: what is left to
    # join are SALTS runs of a content at most, however many documents share it
    salt = F.pmod(F.xxhash64("t", "start"), F.lit(SALTS))
    met = F.count("*").over(Window.partitionBy("key", "content", "salt"))
    salted = written(mixed.withColumn("salt", salt).withColumn("met", met), "sa-salted")
    whole = whole.unionByName(salted.filter("met > 1").select("t", F.col("start").alias("a"), end.alias("b")))
    whole = whole.unionByName(salted.filter("met = 1").join(contents.filter("n > 1").select("key", "content"), ["key", "content"])
                              .select("t", F.col("start").alias("a"), end.alias("b")))
    hot = contents.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > HOT_RUNS).select("key", F.lit(True).alias("hot"))
    wanted = (contents.join(written(hot, "sa-hot"), "key", "left")
              .select("key", (F.col("n") > 1).alias("full"), F.coalesce("hot", F.lit(False)).alias("hot"),
                      F.col("one.t").alias("t"), F.col("one.start").alias("start"), F.col("one.windows").alias("windows")))
    lists = written(wanted.groupBy("t").agg(F.collect_list(F.struct("key", "full", "hot", "start", "windows")).alias("wanted"),
                                            F.sum("windows").alias("total")), "sa-wanted")
    n_texts, n_windows = lists.agg(F.count("*"), F.coalesce(F.sum("total"), F.lit(0))).first()
    named = texts.withColumn("t", _name_of(F.col("text")))
    some = named.join(broadcast_if(lists.select("t"), n_texts, BROADCAST_TEXTS), "t", "left_semi").dropDuplicates(["t"])
    fetched = written(map_batches(some.join(lists, "t").select("t", "text", "wanted"), _fetch,
                                  "key long, full boolean, hot boolean, t binary, start long, bytes binary"), "sa-bytes")
    parts = max(1, -(-n_windows // INDEX_WINDOWS))
    found = map_batches(fetched.filter("not hot").repartition(parts, "key"), _index, MARK)
    hashes = written(map_batches(fetched.filter("hot"), _window_hashes, "h1 long, h2 long, t binary, a long, times long"),
                     "sa-hot-windows")
    twice = hashes.groupBy("h1", "h2").agg(F.sum("times").alias("n")).filter("n > 1").select("h1", "h2")
    hot_found = (hashes.filter("times = 1").join(written(twice, "sa-hot-repeated"), ["h1", "h2"])
                 .select("t", "a", (F.col("a") + LENGTH).alias("b")))
    return (whole.unionByName(found).unionByName(hot_found).groupBy("t")
            .agg(F.collect_set(F.struct("a", "b")).alias("spans")))


def _merged(spans) -> list[tuple[int, int]]:
    """Sorted, disjoint spans; touching ones are one."""
    out: list[list[int]] = []
    for s in sorted((x["a"], x["b"]) for x in spans or []):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [(a, b) for a, b in out]


def _kept(raw: bytes, cuts: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in cuts:
        out.append(raw[at:a])
        at = b
    out.append(raw[at:])
    return b"".join(out)


def with_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row: all columns of docs, spans) with the repeated spans of each row's text."""
    marks = written(repeated_spans(docs, text_col), "sa-marks")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _name_of(F.col(f"`{text_col}`")).alias("t"))
    return rows.join(marks, "t", "left").select("row", "spans")


def repeat_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    rows = with_spans(docs.select(id_col, text_col), text_col).select(
        F.col(f"row.{id_col}").alias(id_col), F.col(f"row.{text_col}").alias("text"), "spans")
    id_type = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, removed, spans, digest = [], [], [], []
            for text, marks in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw, cuts = (text or "").encode("utf-8", "surrogatepass"), _merged(marks)
                size.append(len(raw))
                removed.append(sum(y - x for x, y in cuts))
                spans.append(len(cuts))
                digest.append(hashlib.sha256(_kept(raw, cuts)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                 pa.array(digest, pa.string())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return map_batches(rows, run, f"`{id_col}` {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """The rows of docs without the repeated bytes of their texts; a character that is only
    partly covered stays.  ``size_col``, where it exists, is set to the new length."""
    rows = with_spans(docs, text_col)
    cut = rows.select("row", F.col("row")[text_col].alias("text"), "spans")
    row_type = cut.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = []
            for text, marks in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if not marks:
                    new.append(text)
                    continue
                raw = (text or "").encode("utf-8", "surrogatepass")
                cuts = []
                for x, y in _merged(marks):
                    while x < y and raw[x] & 0xC0 == 0x80:
                        x += 1
                    while y > x and y < len(raw) and raw[y] & 0xC0 == 0x80:
                        y -= 1
                    cuts.append((x, y))
                new.append(_kept(raw, cuts).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.string())], names=["row", "new"])

    done = map_batches(cut, run, f"row {row_type}, new string")
    changed = {text_col: F.col("new")}
    if size_col and size_col in docs.columns:
        same = F.col("new").eqNullSafe(F.col("row")[text_col])
        changed[size_col] = F.when(same, F.col("row")[size_col]).otherwise(
            F.length("new").cast(docs.schema[size_col].dataType))
    return done.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
