"""Toxicity by class-conditional Kneser-Ney models over words.

Two interpolated models, one of toxic and one of ordinary texts, give every word
a probability.  Each takes a discount off its own class's count and hands the
mass to one model that both share, the continuation counts of Kneser-Ney: a word
weighs there by the number of different words that precede it (a text's beginning
counts as one), not by its occurrences, and all texts of the corpus are counted,
labelled or not.  So

    P(w | c) = max(n_c(w) - D, 0) / N_c + D * V_c / N_c * before(w) / sum of before,

and a rare expression differs between the classes only as far as the classes'
own counts say so.  The log ratio of a word that no toxic text had says more
about the size of the classes than about a text, so a text's evidence comes from
the distinct words that toxic texts had and whose ratio exceeds that of an
unseen word: the sum of the excess and of its squares, over the root of the
length, and the plain sum.  A logistic function of these and the length gives the
score; it is calibrated on at most ``CALIBRATION`` labelled rows of one fold, by
counts that leave them out.  The scores come from the counts of all learning rows.

Words are the runs of letters and digits of the lower-cased text, named by a
64-bit hash; the words before one word are told apart by 32 bits, so that of k of
them about k^2 / 2^33 are missed.  The words of toxic texts are shipped to every task while their
number is below a checked bound and joined to the texts' words beyond it.  Labels,
language, source and id are never inputs of a score.

Defined results: a text that is null or has no word has no evidence; repeated
rows get equal scores; label rows without a text, and texts without a label, only
add to the shared counts; an id with two labels is toxic if one of them says so;
without rows of both classes every score is 0.5; an empty table gives an empty
result; texts of any length are taken whole, with 24 bytes for each of their
words; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import byte_buffer, list_column, map_batches, owner, slices, words, written
from leadlens.llm.quality import fold
from leadlens.operators.joins import broadcast_if

DISCOUNT = 0.75
# words of toxic texts (16 bytes each) and labels that may be shipped to every task
BROADCAST_WORDS = 1_000_000
BROADCAST_LABELS = 2_000_000
CALIBRATION = 20_000
SLICE_BYTES = 1 << 19
COUNTS = ["a", "b", "texts", "spare_a", "spare_b"]
HELD_WORDS = 2_000_000
HELD_PAIRS = 3_000_000
BUCKETS = 1024       # of words whose pairs travel in one row
SALTS = 2            # parts that the words before a word are dealt into, by their names
BEGINNING = 0        # stands before the first word of a text
# letters and digits; a byte above 127 is part of a letter
_PART = np.full(256, 0x20, np.uint8)
_PART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = [
    *range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]


def text_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per slice of texts: (first, behind the last, text, hash) of every word, in order."""
    data, offsets = byte_buffer(pc.utf8_lower(column.cast(pa.large_string())))
    for i, j in slices(offsets, SLICE_BYTES):
        own = offsets[i:j + 1] - offsets[i]
        s, _, h = words(_PART[data[offsets[i]:offsets[j]]], own, lower=False)
        yield i, j, owner(own, s), h.view(np.int64)


def _distinct(doc: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, occurrences), sorted."""
    order = np.lexsort((word, doc))
    d, w = doc[order], word[order]
    first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (w[1:] != w[:-1])]) if len(d) else np.zeros(0, np.int64)
    return d[first], w[first], np.diff(np.r_[first, len(d)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, class: 1, 0 or null; 3, 2 for spare rows) -> partial counts (w, a, b, texts, spare_a, spare_b)."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        nonlocal held, size
        w = np.concatenate([x[0] for x in held]) if held else np.zeros(0, np.int64)
        names, at = np.unique(w, return_inverse=True)
        sums = [np.bincount(at, weights=np.concatenate([x[k] for x in held]), minlength=len(names)).astype(np.int64)
                if held else np.zeros(0, np.int64) for k in range(1, 6)]
        held, size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(names), *map(pa.array, sums)], names=["w", *COUNTS])

    for batch in batches:
        kinds = np.array([-1 if x is None else int(x) for x in batch.column(1).to_pylist()], np.int64)
        for i, j, doc, word in text_words(batch.column(0)):
            d, w, n = _distinct(doc, word)
            of = kinds[i:j][d]
            names, at = np.unique(w, return_inverse=True)
            sums = [np.bincount(at, weights=x, minlength=len(names)) for x in (
                np.where(of == 1, n, 0), np.where(of == 0, n, 0), np.ones(len(w)), np.where(of == 3, n, 0), np.where(of == 2, n, 0))]
            held.append((names, *sums))
            size += len(names)
            if size > HELD_WORDS:
                yield flush()
    yield flush()


def count_words(docs: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(w, a, b, texts, spare_a, spare_b): occurrences in toxic (a) and ordinary (b) texts, the texts of the
    whole corpus that hold the word, and the occurrences in texts that are kept apart; ``known`` has
    (id, class), where the class of a text kept apart is 2 more."""
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .join(broadcast_if(known, known.count(), BROADCAST_LABELS), "id", "left").select("text", "class"))
    return written(map_batches(rows, _count, "w long, " + ", ".join(f"{c} long" for c in COUNTS)).groupBy("w")
                   .agg(*[F.sum(c).alias(c) for c in COUNTS]), "tox-counts")


def _distinct_pairs(word: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different (word, word before), sorted."""
    order = np.lexsort((before, word))
    w, u = word[order], before[order]
    new = np.ones(len(w), dtype=bool)
    new[1:] = (w[1:] != w[:-1]) | (u[1:] != u[:-1])
    return w[new], u[new]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (bucket, w, before): lists of the different pairs of a word and the word before it."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        nonlocal held, size
        w, u = _distinct_pairs(*(np.concatenate([x[k] for x in held]) if held else np.zeros(0, t) for k, t in ((0, np.int64), (1, np.int32))))
        held, size = [], 0
        bucket = (w + u % SALTS) % BUCKETS
        order = np.argsort(bucket, kind="stable")
        names, sizes = np.unique(bucket, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), list_column(w[order], sizes, pa.int64()),
                                           list_column(u[order], sizes, pa.int32())], names=["bucket", "w", "before"])

    for batch in batches:
        for _, _, doc, word in text_words(batch.column(0)):
            before = np.full(len(word), BEGINNING, np.int32)
            before[1:] = np.where(doc[1:] == doc[:-1], word[:-1].astype(np.int32), BEGINNING)
            held.append(_distinct_pairs(word, before))
            size += len(held[-1][0])
            if size > HELD_PAIRS:
                yield flush()
    yield flush()


def count_before(docs: DataFrame, text_col: str) -> DataFrame:
    """(w, before): the number of different words before the word, over the texts of the whole corpus.

    A task ships its pairs as sorted lists, which pack well; they are told apart where the lists of
    a bucket meet."""
    lists = map_batches(docs.select(F.col(f"`{text_col}`").cast("string").alias("text")), _pairs, "bucket int, w array<long>, before array<int>")
    pairs = lists.repartition("bucket").select("bucket", F.inline(F.arrays_zip("w", "before"))).distinct()
    return written(pairs.groupBy("w").agg(F.count(F.lit(1)).alias("before")), "tox-before")


def log_ratios(counts: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(w, value): by how much the log ratio of a word of toxic texts exceeds that of an unseen word.
    The shared model weighs words by ``before`` (``count_before``); without it, by their texts."""
    t = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("a", "b", "texts")],
                   F.count_if(F.col("a") > 0).alias("va"), F.count_if(F.col("b") > 0).alias("vb")).first()
    if not t["a"] or not t["b"]:
        return written(counts.filter("false").select("w", F.lit(0.0).alias("value")), "tox-ratios")
    held, shared = counts.filter("a > 0"), F.col("texts") / t["texts"]
    if before is not None:
        held = held.join(before, "w")
        shared = F.col("before") / before.agg(F.sum("before")).first()[0]
    p = lambda n, total, kinds: F.greatest(F.col(n) - DISCOUNT, F.lit(0.0)) / total + shared * (DISCOUNT * kinds / total)
    unseen = float(np.log((t["va"] / t["a"]) / (t["vb"] / t["b"])))
    value = F.log(p("a", t["a"], t["va"])) - F.log(p("b", t["b"], t["vb"])) - unseen
    return written(held.select("w", value.alias("value")).filter("value > 0"), "tox-ratios")


@dataclass
class Ratios:
    words: np.ndarray
    values: np.ndarray

    def of(self, word: np.ndarray) -> np.ndarray:
        if not len(self.words) or not len(word):
            return np.zeros(len(word))
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        return np.where(self.words[at] == word, self.values[at], 0.0)


EVIDENCE = "excess double, squares double, size long"


def _by_lookup(rows: DataFrame, ratios: DataFrame) -> DataFrame:
    """(id, text) -> (id, evidence), with the table shipped to every task."""
    got = ratios.toArrow()
    w, value = (got.column(c).to_numpy() for c in ("w", "value"))
    order = np.argsort(w)
    sent = rows.sparkSession.sparkContext.broadcast(Ratios(w[order].astype(np.int64), value[order].astype(float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            excess, squares, size = np.zeros(len(b)), np.zeros(len(b)), np.zeros(len(b), np.int64)
            for i, j, doc, word in text_words(b.column(1)):
                size[i:j] = np.bincount(doc, minlength=j - i)
                d, w, _ = _distinct(doc, word)
                v = sent.value.of(w)
                excess[i:j] = np.bincount(d, weights=v, minlength=j - i)
                squares[i:j] = np.bincount(d, weights=v * v, minlength=j - i)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(excess), pa.array(squares), pa.array(size)],
                                             names=["id", "excess", "squares", "size"])

    return map_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, {EVIDENCE}")


def _by_join(rows: DataFrame, ratios: DataFrame) -> DataFrame:
    """The same by joining the distinct words of every text with the table; texts go by their MD5."""
    named = rows.withColumn("t", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, doc, word in text_words(b.column(1)):
                d, w, n = _distinct(doc, word)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d + i)), pa.array(w), pa.array(n.astype(np.int64))], names=["t", "w", "n"])

    held = map_batches(named.select("t", "text").dropDuplicates(["t"]), run, "t binary, w long, n long")
    sums = written(held.join(ratios, "w", "left").groupBy("t").agg(
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("excess"), F.coalesce(F.sum(F.col("value") * F.col("value")), F.lit(0.0)).alias("squares"),
        F.sum("n").alias("size")), "tox-sums")
    return named.join(sums, "t", "left").select("id", F.coalesce("excess", F.lit(0.0)).alias("excess"),
                                                F.coalesce("squares", F.lit(0.0)).alias("squares"), F.coalesce("size", F.lit(0)).cast("long").alias("size"))


def evidence(docs: DataFrame, ratios: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = BROADCAST_WORDS) -> DataFrame:
    """id, excess, squares, size of every row: sums over the distinct words of its text, and its words."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return _by_lookup(rows, ratios) if ratios.count() <= bound else _by_join(rows, ratios)


def _inputs(excess: np.ndarray, squares: np.ndarray, size: np.ndarray) -> np.ndarray:
    n = np.maximum(size, 1)
    return np.stack([excess / np.sqrt(n), squares / np.sqrt(n), excess, np.log(n) / 10, np.ones(len(n))], axis=1)


def calibrate(x: np.ndarray, toxic: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Weights of a logistic function of the evidence, by Newton steps."""
    w = np.zeros(x.shape[1])
    if not len(toxic) or toxic.min() == toxic.max():
        return w
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - toxic) + penalty * w)
    return w


def score_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "toxic", parts: int = 5, held: int = 0, bound: int = BROADCAST_WORDS) -> DataFrame:
    """id, held_out, score, predicted of every row.  Labels of fold ``held`` are never read; at most
    ``CALIBRATION`` rows of fold ``parts`` - 1, the least hashes of ids first, calibrate."""
    docs, place = docs.select(id_col, text_col), fold(id_col, parts)
    learn = (labels.filter((place != held) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("class")))
    learn = written(learn.withColumn("spare", fold("id", parts) == parts - 1), "tox-labels")
    spare = written(learn.filter("spare").orderBy(F.xxhash64("id"), "id").limit(CALIBRATION).select("id", "class"), "tox-spare")
    known = learn.select("id", "class").join(F.broadcast(spare.select("id", F.lit(2).alias("apart"))), "id", "left")
    counts = count_words(docs, known.select("id", (F.col("class") + F.coalesce("apart", F.lit(0))).alias("class")), id_col, text_col)
    before = count_before(docs, text_col)
    apart = docs.join(F.broadcast(spare.select(F.col("id").alias(id_col))), id_col, "left_semi")
    drawn = (evidence(apart, log_ratios(counts, before), id_col, text_col, bound)
             .join(F.broadcast(spare), "id").orderBy("id").limit(CALIBRATION).toPandas())
    everything = counts.select("w", (F.col("a") + F.col("spare_a")).alias("a"), (F.col("b") + F.col("spare_b")).alias("b"), "texts")
    seen = written(evidence(docs, log_ratios(everything, before), id_col, text_col, bound), "tox-evidence")
    w = [float(x) for x in calibrate(_inputs(*(drawn[c].to_numpy(float) for c in ("excess", "squares", "size"))),
                                     drawn["class"].to_numpy(float))]
    n = F.greatest(F.col("size"), F.lit(1)).cast("double")
    z = (w[0] * F.col("excess") / F.sqrt(n) + w[1] * F.col("squares") / F.sqrt(n) + w[2] * F.col("excess") + w[3] * F.log(n) / 10 + w[4])
    return (seen.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(50.0)), F.lit(-50.0)))))
            .select(F.col("id").alias(id_col), "score").select(id_col, (place == held).alias("held_out"), "score",
                                                               (F.col("score") >= 0.5).cast("int").alias("predicted")))
