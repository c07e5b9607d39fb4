"""Language identification by multilingual mixture inference.

Every document is taken as a mixture of languages.  Its letter trigrams are
drawn from sum(share[l] * P(trigram | l)), and expectation-maximisation finds
the shares of most likelihood.  Which languages take part is decided by
penalised likelihood: starting from the best single language, one more joins if
it raises the maximised log-likelihood by more than the penalty

    OVERLAP * log(1 + letters) / 2,

a BIC term per share, times three because a letter is seen by three trigrams.
Most languages need no run of EM to be left out: with g[l] the mean of
P(trigram | l) over the present mixture, no share of l can gain more than
letters * log(max(g)), by Jensen's inequality.  Languages that later ones make
needless (the loss is below the penalty) leave the set again.

The class models are relative trigram frequencies of all learning texts, drawn
towards the mean of the languages by ``PRIOR`` pseudo-trigrams.  Trigrams are
hashed to buckets; their number follows from the number of languages, so that
the model never exceeds ``CELLS`` cells of four bytes, whatever the corpus.

The predicted language has the largest share; the score is that share times the
posterior of the language against those left out (likelihoods to the power
1 / OVERLAP).  Ties go to the smaller name.

Defined results: a text that is null or has no letter is ``und`` with score 0
and no languages, and so is every text if nothing could be learnt; letters that
no learning text held say nothing, so all languages tie; a learning text without
letters teaches nothing; rows without a language are not learnt from; repeated
rows count each; texts of any length are taken whole, some characters at a time;
a null id is hashed as an empty text; an empty table gives an empty result; a
learning table with more than ``MOST_LANGUAGES`` languages is an error; only the
id, text and language columns are read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import map_batches, ship
from leadlens.llm.quality import fold

CELLS = 1 << 24
MOST_BITS, LEAST_BITS = 16, 8
MOST_LANGUAGES = CELLS >> LEAST_BITS
SLICE_CHARS = 1 << 19
BATCH_CELLS = 1 << 21
PRIOR, FLOOR = 1000.0, 0.01
OVERLAP = 3.0
EM_STEPS, EM_GAP = 100, 0.01
BLANK = 32
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]

_tables: dict[str, np.ndarray] = {}


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: its small letter (marks: itself, others: a blank), and whether it is a letter."""
    if not _tables:
        small, is_letter = np.full(0x110000, BLANK, np.uint32), np.zeros(0x110000, bool)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))[0]
            if kind == "L":
                small[c], is_letter[c] = ord(chr(c).lower()[0]), True
            elif kind == "M":
                small[c] = c
        _tables.update(small=small, letter=is_letter)
    return _tables["small"], _tables["letter"]


def trigrams(text: str, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, bucket, is a letter) of the trigram around every letter or mark but the first and last
    character of ``text``; places count from the second character."""
    small, is_letter = _letters()
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    codes = small[points].astype(np.uint64)
    at = np.flatnonzero(codes[1:-1] != BLANK)
    h = codes[at] * _MULTIPLIERS[0] + codes[at + 1] * _MULTIPLIERS[1] + codes[at + 2] * _MULTIPLIERS[2]
    h = (h ^ (h >> np.uint64(29))) * _MULTIPLIERS[0]
    return at, (h >> np.uint64(64 - bits)).astype(np.int64), is_letter[points[at + 1]]


def bags(texts: list, bits: int, chars: int = SLICE_CHARS) -> Iterator[tuple]:
    """(first text, behind the last, text, bucket, count, has a letter) of slices of about ``chars``
    characters; a longer text is a slice of its own and counted piece by piece.  Texts count from the
    first of the slice; texts and buckets ascend."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= chars):
            size += len(texts[j] or "")
            j += 1
        if size > chars:
            text, total, has = f" {texts[i]} ", np.zeros(1 << bits, np.int64), False
            for lo in range(0, size, chars):
                _, bucket, letter = trigrams(text[lo:min(lo + chars, size) + 2], bits)
                total += np.bincount(bucket, minlength=1 << bits)
                has |= bool(letter.any())
            bucket = np.flatnonzero(total)
            yield i, j, np.zeros(len(bucket), np.int64), bucket, total[bucket], np.array([has])
        else:
            part = [t or "" for t in texts[i:j]]
            at, bucket, letter = trigrams(" " + " ".join(part) + " ", bits)
            owner = np.repeat(np.arange(j - i), [len(t) + 1 for t in part])[at]
            has = np.zeros(j - i, bool)
            has[owner[letter]] = True
            key, count = np.unique((owner << bits) | bucket, return_counts=True)
            yield i, j, key >> bits, key & ((1 << bits) - 1), count, has
        i = j


@dataclass
class LanguageModel:
    names: list[str]         # ascending
    likelihood: np.ndarray   # buckets x languages, P(trigram | language)

    @property
    def bits(self) -> int:
        return max(len(self.likelihood), 1).bit_length() - 1


def bucket_bits(languages: int) -> int:
    """Buckets of the model, as a power of two: at most CELLS cells for all languages."""
    return max(LEAST_BITS, min(MOST_BITS, (CELLS // max(languages, 1)).bit_length() - 1))


def likelihoods(counts: np.ndarray) -> np.ndarray:
    """buckets x languages from counts, languages x buckets, each drawn to the mean of all."""
    counts = counts.astype(np.float64)
    total = counts.sum(axis=1, keepdims=True)
    common = (1 - FLOOR) * (counts / total).mean(axis=0) + FLOOR / counts.shape[1]
    return np.ascontiguousarray(((counts + PRIOR * common) / (total + PRIOR)).T.astype(np.float32))


def count_trigrams(rows: DataFrame, names: list[str], bits: int) -> DataFrame:
    """(lang, bucket, n) over all rows (lang, text): partial counts of every task are summed."""
    place = {n: i for i, n in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(names) << bits, np.int64)
        for b in batches:
            lang = np.array([place[x] for x in b.column(0).to_pylist()], np.int64)
            for i, _, text, bucket, n, _ in bags(b.column(1).to_pylist(), bits):
                np.add.at(counts, (lang[i:][text] << bits) | bucket, n)
        at = np.flatnonzero(counts)
        for lo in range(0, len(at), 1 << 16):
            k = at[lo:lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array((k >> bits).astype(np.int32)), pa.array((k & ((1 << bits) - 1)).astype(np.int32)),
                                              pa.array(counts[k])], names=["lang", "bucket", "n"])

    return map_batches(rows, run, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, learn_from: Column, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """The trigram models of all rows that ``learn_from`` admits and that have a text and a language."""
    rows = docs.filter(learn_from).select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.filter("lang is not null")
    # this scan does not read the texts
    names = sorted(r.lang for r in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not names:
        return LanguageModel([], np.zeros((0, 0), np.float32))
    bits = bucket_bits(len(names))
    ship(docs.sparkSession)

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        line = np.zeros(1 << bits, np.int64)
        line[frame["bucket"].to_numpy()] = frame["n"].to_numpy()
        return pd.DataFrame([{"lang": int(frame["lang"].iloc[0]), "line": line.tobytes()}])

    # one row a language, of 2 ** bits counts: CELLS counts at most
    lines = {r.lang: np.frombuffer(r.line, np.int64)
             for r in count_trigrams(rows, names, bits).groupBy("lang").applyInPandas(pack, "lang int, line binary").collect()}
    if not lines:
        return LanguageModel([], np.zeros((0, 0), np.float32))
    return LanguageModel([names[i] for i in sorted(lines)], likelihoods(np.array([lines[i] for i in sorted(lines)])))


def _sum(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0)


def maximise(p: np.ndarray, count: np.ndarray, owner: np.ndarray, shares: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shares, log-likelihood) of the best mixture of each document's ``members`` by EM; the rows of
    ``p`` and ``count`` are grouped by ``owner``, which names every document from 0."""
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    total = _sum(count.astype(np.float64), starts)
    for _ in range(EM_STEPS):
        mixed = np.einsum("ij,ij->i", p, shares[owner])
        g = _sum(p * (count / mixed)[:, None], starts) / total[:, None]
        shares = shares * g
        shares /= shares.sum(axis=1, keepdims=True)
        if (total * np.log(np.where(members, g, 0).max(axis=1)) < EM_GAP).all():
            break
    mixed = np.einsum("ij,ij->i", p, shares[owner])
    return shares, _sum(count * np.log(mixed), starts)


def infer(likelihood: np.ndarray, bucket: np.ndarray, count: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(shares n x languages, score factor n) of ``n`` documents that each own at least one row."""
    p = likelihood[bucket].astype(np.float64)
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    total = _sum(count.astype(np.float64), starts)
    penalty = OVERLAP * np.log1p(total) / 2
    single = _sum(count[:, None] * np.log(p), starts)
    members = np.zeros((n, likelihood.shape[1]), bool)
    members[np.arange(n), single.argmax(axis=1)] = True
    shares, value = members.astype(np.float64), single.max(axis=1)
    tried = members.copy()
    open_ = np.arange(n)
    def rows_of(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place = np.full(n, -1)
        place[docs] = np.arange(len(docs))
        rows = np.flatnonzero(place[owner] >= 0)
        return place[owner[rows]], p[rows], count[rows]

    while len(open_):
        own, q, c = rows_of(open_)
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        mixed = np.einsum("ij,ij->i", q, shares[open_][own])
        gain = np.where(tried[open_], 0, _sum(q * (c / mixed)[:, None], first) / total[open_][:, None])
        new = gain.argmax(axis=1)
        # the bound on what any share of a language can gain
        worth = total[open_] * np.log(np.maximum(gain.max(axis=1), 1e-300)) > penalty[open_]
        open_, new = open_[worth], new[worth]
        if not len(open_):
            break
        keep = worth[own]
        own = np.cumsum(worth)[own[keep]] - 1
        wider = members[open_].copy()
        wider[np.arange(len(open_)), new] = True
        begin = np.where(wider, np.maximum(shares[open_], 0.1), 0)
        better, reached = maximise(q[keep], c[keep], own, begin / begin.sum(axis=1, keepdims=True), wider)
        joins = reached - value[open_] > penalty[open_]
        tried[open_, new] = True
        won = open_[joins]
        members[won], shares[won], value[won] = wider[joins], better[joins], reached[joins]
        # a wider mixture gives the languages turned down before another chance
        tried[won] = members[won]

    # languages that later ones made needless leave again, the smallest share first
    turn = np.zeros(n, np.int64)
    while len(open_ := np.flatnonzero((members.sum(axis=1) > 1) & (turn < members.sum(axis=1)))):
        order = np.argsort(np.where(members[open_], shares[open_], np.inf), axis=1, kind="stable")
        fewer = members[open_].copy()
        fewer[np.arange(len(open_)), order[np.arange(len(open_)), turn[open_]]] = False
        own, q, c = rows_of(open_)
        begin = np.where(fewer, np.maximum(shares[open_], 0.01), 0)
        less, reached = maximise(q, c, own, begin / begin.sum(axis=1, keepdims=True), fewer)
        leaves = value[open_] - reached < penalty[open_]
        gone = open_[leaves]
        members[gone], shares[gone], value[gone] = fewer[leaves], less[leaves], reached[leaves]
        turn[open_] += 1
        turn[gone] = 0
    best = shares.argmax(axis=1)
    against = np.exp(np.minimum((single - single[np.arange(n), best][:, None]) / OVERLAP, 50))
    return shares, 1 / (1 + np.where(members, 0, against).sum(axis=1))


RESULT = "lang_pred string, score double, languages array<struct<lang: string, share: double>>"
_KIND = pa.struct([("lang", pa.string()), ("share", pa.float64())])


def identify_texts(texts: list, model: LanguageModel) -> tuple[list, list, list]:
    """(language, score, languages with their shares) of every text."""
    names, scores, sets = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    if not model.names:
        return names, scores, sets
    chars = max(1, min(SLICE_CHARS, BATCH_CELLS // len(model.names)))
    for i, _, owner, bucket, count, has in bags(texts, model.bits, chars):
        known = has[owner]
        if not known.any():
            continue
        docs, own = np.unique(owner[known], return_inverse=True)
        shares, factor = infer(model.likelihood, bucket[known], count[known], own, len(docs))
        for d, s, f in zip(docs.tolist(), shares, factor.tolist()):
            best = int(s.argmax())
            names[i + d], scores[i + d] = model.names[best], min(1.0, float(s[best]) * f)
            sets[i + d] = [{"lang": model.names[k], "share": float(s[k])} for k in np.argsort(-s, kind="stable") if s[k] > 0]
    return names, scores, sets


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, languages of every row of ``docs``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores, sets = identify_texts(b.column(1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                                              pa.array(sets, pa.list_(_KIND))], names=["id", "lang_pred", "score", "languages"])

    return (map_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, {RESULT}")
            .withColumnRenamed("id", id_col))


def language_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    parts: int = 4, held: int = 2) -> DataFrame:
    """id, held_out, lang_pred, score, languages; rows of fold ``held`` of ``parts`` are never learnt from."""
    model = learn(docs, fold(id_col, parts) != held, text_col, lang_col)
    return identify(docs, model, id_col, text_col).select(
        id_col, (fold(id_col, parts) == held).alias("held_out"), "lang_pred", "score", "languages")
