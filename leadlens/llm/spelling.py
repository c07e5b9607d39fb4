"""Spelling variants: words one edit apart, found through reduced alphabets.

Every letter is hashed to one of a few symbols, which turns the vocabulary into
a much smaller set of reduced words.  Two words that are one edit apart have
reduced words that are equal or one edit apart, so the full one-edit
neighbourhood of every reduced word is generated (a pair of reduced words from
one side only: the shorter as a deletion, an equally long one by replacing a
symbol with a larger one; insertions and smaller symbols are the same pairs
seen from the other side) and joined with the reduced vocabulary on a 64-bit
hash.  The words behind the reduced pairs are then compared themselves, so
neither the hash nor the few symbols can add or lose a pair.

A few symbols may throw many words together.  Pairs of reduced words that stand
for more than ``PAIR_LIMIT`` pairs of words are not compared: their words go
through the same steps again with the next, larger alphabet.  The last alphabet
of ``ALPHABETS`` is larger than most scripts' letters, and compares whatever is
left.  Nothing is grouped into lists; all of it is joins of flat rows.

Defined results: a null text has no words, a null id stands for an empty text
before the colon of the hashed string; repeated rows count each; runs and words
of any length are handled whole; an empty table gives an empty result; only the
id and text columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import LOWER, byte_buffer, map_batches, mix, powers, written
from leadlens.operators.partitioning import spread

ALPHABETS = (8, 64, 512)
PAIR_LIMIT = 1 << 16
PIECE_CHARS = 1 << 20
HELD_WORDS = 200_000
HELD_CHARS = 8 << 20
BLOCK_CELLS = 1 << 20
_U = np.uint64
_LOWER = LOWER.tobytes()
_OUTSIDE = re.compile("[^A-Za-zÀ-ÿ]")


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, never cut inside a run of letters."""
    lo = 0
    while lo < len(text):
        end = _OUTSIDE.search(text, lo + size)
        hi = end.start() if end else len(text)
        yield text[lo:hi]
        lo = hi


def count_words(docs: DataFrame, id_col: str, text_col: str, least_length: int, least_count: int, one_in: int) -> DataFrame:
    """(word, n): the distinct words after the seeded deletions, with their occurrences."""
    # a deletion only shortens a run
    run = re.compile(f"[a-zÀ-ÿ]{{{least_length},}}")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        chars = 0

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1)):
                seed = zlib.crc32(f"{'' if name is None else name}:".encode())
                for piece in pieces(text.as_py() or ""):
                    for w, n in Counter(run.findall(piece.encode().translate(_LOWER).decode())).items():
                        h = zlib.crc32(w.encode(), seed)
                        if not h % one_in:
                            at = h % len(w)
                            w = w[:at] + w[at + 1:]
                        if len(w) >= least_length:
                            chars += 0 if w in held else len(w)
                            held[w] += n
                    if len(held) > HELD_WORDS or chars > HELD_CHARS:
                        yield flushed()
                        chars = 0
        yield flushed()

    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("name"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return (map_batches(rows, words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= least_count))


def symbols_of(data: np.ndarray, symbols: int) -> np.ndarray:
    """The symbol of every code point, from 0."""
    return (mix(data.astype(_U) * _U(symbols)) % _U(symbols)).astype(np.uint16)


def _finished(sums: np.ndarray, length: int) -> np.ndarray:
    return mix(sums + _U(length * 0xD6E8FEB86659FD93 % (1 << 64))).view(np.int64)


def _sums(block: np.ndarray) -> np.ndarray:
    """Prefix sums (rows x length + 1) of the polynomial hash of rows of symbols."""
    p, _ = powers(block.shape[1] + 1)
    out = np.zeros((block.shape[0], block.shape[1] + 1), _U)
    np.cumsum((block.astype(_U) + _U(1)) * p[None, :-1], axis=1, out=out[:, 1:])
    return out


def _by_length(lengths: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Indices of equally long words, at most about BLOCK_CELLS / width symbols at a time."""
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for same in np.split(order, cuts):
        if len(same) and lengths[same[0]]:
            step = max(1, BLOCK_CELLS // (int(lengths[same[0]]) * width))
            for i in range(0, len(same), step):
                yield same[i:i + step]


def neighbour_keys(block: np.ndarray, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) of the neighbours of rows of symbols: all deletions, and all replacements by a
    larger symbol, some positions at a time."""
    m, length = block.shape
    sums = _sums(block)
    p, inverse = powers(length + 1)
    step = max(1, BLOCK_CELLS // (m * symbols))
    for lo in range(0, length, step):
        hi = min(lo + step, length)
        own = block[:, lo:hi]
        if length > 1:
            # a symbol equal to the one before it gives the same deletion again
            new = np.ones(own.shape, bool)
            new[:, 1 if lo == 0 else 0:] = own[:, 1 if lo == 0 else 0:] != block[:, max(lo, 1) - 1:hi - 1]
            row, at = np.nonzero(new)
            gone = sums[row, at + lo] + (sums[row, -1] - sums[row, at + lo + 1]) * inverse[1]
            yield row, _finished(gone, length - 1)
        for s in range(1, symbols):
            row, at = np.nonzero(own < s)
            yield row, _finished(sums[row, -1] + (_U(s) - own[row, at].astype(_U)) * p[at + lo], length)


def reduced(words: DataFrame, symbols: int) -> DataFrame:
    """(word, n, red, key): the reduced word, two bytes a symbol, and its hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            lengths = np.array([len(t) for t in texts], np.int64)
            s = symbols_of(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), symbols)
            starts = np.cumsum(lengths) - lengths
            keys = np.zeros(len(texts), np.int64)
            for at in _by_length(lengths, 1):
                length = int(lengths[at[0]])
                keys[at] = _finished(_sums(s[starts[at][:, None] + np.arange(length)])[:, -1], length)
            red = pa.array([s[i:i + n].tobytes() for i, n in zip(starts.tolist(), lengths.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), red, pa.array(keys)], names=["word", "n", "red", "key"])

    return map_batches(words, run, "word string, n long, red binary, key long")


def neighbourhoods(reds: DataFrame, symbols: int) -> DataFrame:
    """(a, b): the key of every reduced word with the keys of its neighbours."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_buffer(batch.column(0))
            s, starts = data.view(np.uint16) if len(data) else np.zeros(0, np.uint16), offsets[:-1] // 2
            lengths = np.diff(offsets) // 2
            own = batch.column(1).to_numpy()
            for at in _by_length(lengths, symbols):
                block = s[starts[at][:, None] + np.arange(int(lengths[at[0]]))]
                for row, key in neighbour_keys(block, symbols):
                    if len(row):
                        yield pa.RecordBatch.from_arrays([pa.array(own[at[row]]), pa.array(key)], names=["a", "b"])

    return map_batches(reds, run, "a long, b long")


def near_words(words: DataFrame, alphabets: tuple = ALPHABETS, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(x, nx, y, ny): every unordered pair of the distinct words (word, n) that are one edit apart, once."""
    symbols, rest = alphabets[0], alphabets[1:]
    table = written(reduced(words, symbols), "spelling-reduced")
    reds = table.groupBy("red", "key").agg(F.count("*").alias("size"))
    reds = written(reds, "spelling-vocabulary")
    sizes = reds.groupBy("key").agg(F.sum("size").alias("size"))
    found = neighbourhoods(spread(reds.select("red", "key")), symbols).join(sizes.select(F.col("key").alias("b"), "size").hint("shuffle_hash"), "b")
    pairs = (found.distinct().join(sizes.select(F.col("key").alias("a"), F.col("size").alias("size_a")), "a")
             .select("a", "b", (F.col("size") * F.col("size_a")).alias("stands_for"))
             .unionByName(sizes.filter("size > 1").select(F.col("key").alias("a"), F.col("key").alias("b"),
                                                          (F.col("size") * F.col("size")).alias("stands_for"))))
    pairs = written(pairs, "spelling-pairs")
    few = pairs.filter(F.col("stands_for") <= pair_limit) if rest else pairs
    side = lambda key, word, n: table.select(F.col("key").alias(key), F.col("word").alias(word), F.col("n").alias(n))
    near = (few.join(side("a", "x", "nx"), "a").join(side("b", "y", "ny"), "b")
            .filter(F.expr("(a <> b or x < y) and levenshtein(x, y, 1) = 1")).select("x", "nx", "y", "ny"))
    near = written(near, "spelling-near")
    many = pairs.filter(F.col("stands_for") > pair_limit)
    if not rest or not many.limit(1).count():
        return near
    again = many.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    finer = near_words(table.join(again, "key", "left_semi").select("word", "n"), rest, pair_limit)
    # two words may meet in both alphabets
    both = [d.select(F.least("x", "y").alias("x"), F.when(F.col("x") < F.col("y"), F.col("nx")).otherwise(F.col("ny")).alias("nx"),
                     F.greatest("x", "y").alias("y"), F.when(F.col("x") < F.col("y"), F.col("ny")).otherwise(F.col("nx")).alias("ny"))
            for d in (near, finer)]
    return written(both[0].unionByName(both[1]).dropDuplicates(["x", "y"]), "spelling-near-all")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of forms of every word that has one.  A form occurs at
    least twice as often as its word, so chains end; every step doubles what a row has followed."""
    table = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = table.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        nxt = written(table.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"),
                                                               F.col("ahead").isNotNull().alias("went")), "spelling-roots")
        table = nxt.select("word", "root")
        if not nxt.filter("went").limit(1).count():
            return table


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_count: int = 2,
             one_in: int = 31, ratio: int = 10, alphabets: tuple = ALPHABETS, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the corpus.

    The words are the runs of letters, A-Z lower-cased, of at least ``least_length`` code points and
    ``least_count`` occurrences, where one in ``one_in`` runs of a document loses a letter.  A word's
    form is the most frequent word one edit away (ties: the smallest) if that occurs ``ratio`` (at
    least 2) times as often or more."""
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    words = written(count_words(docs, id_col, text_col, least_length, least_count, one_in), "spelling-words")
    near = near_words(words, alphabets, pair_limit)
    ends = near.select(F.col("x").alias("word"), F.struct((-F.col("ny")).alias("least"), F.col("y").alias("near")).alias("other")).unionByName(
        near.select(F.col("y").alias("word"), F.struct((-F.col("nx")).alias("least"), F.col("x").alias("near")).alias("other")))
    best = ends.groupBy("word").agg(F.count("*").alias("n_near"), F.min("other").alias("best"))
    strong = -F.col("best.least") >= F.col("n") * ratio
    table = written(words.join(best, "word", "left").select(
        "word", F.when(strong, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, -F.col("best.least")).alias("form_n")), "spelling-forms")
    ends_at = roots(table.filter("form is not null"))
    return table.join(ends_at, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
