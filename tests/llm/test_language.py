"""Language identification: trigram counts, EM and set selection by brute force, held-out accuracy."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import awkward_docs, empty_docs

from leadlens.llm import language
from leadlens.llm.queries import QUERIES

BIG = "/root/testdata/sf0.1"


def plain_trigrams(text):
    codes = [" "] + [c.lower()[0] if c.isalpha() else " " for c in text] + [" "]
    return [tuple(codes[i - 1:i + 2]) for i in range(1, len(codes) - 1) if codes[i] != " "]


def test_bags_count_every_letter_once_in_any_slicing():
    texts = ["Der Bär, 42 Äpfel", None, "", "x", "  ", "日本語テキスト", "Ünïcödé " * 40, "no", "7 + 8"]
    want = None
    for chars in (1, 3, 50, 1 << 19):
        got, has = {}, []
        for i, j, owner, bucket, count, letters in language.bags(texts, 16, chars):
            assert len(letters) == j - i
            has += letters.tolist()
            for o, b, n in zip(owner.tolist(), bucket.tolist(), count.tolist()):
                got[i + o, b] = got.get((i + o, b), 0) + n
        assert want is None or (got, has) == want
        want = got, has
    for k, t in enumerate(texts):
        plain = Counter(plain_trigrams(t or ""))
        assert sum(n for (o, _), n in want[0].items() if o == k) == sum(plain.values())
        assert sorted(n for (o, _), n in want[0].items() if o == k) == sorted(plain.values())
        assert want[1][k] == any(c.isalpha() for c in t or "")


def slow_em(p, c, members, steps=20_000):
    s = np.array([1.0 if m in members else 0.0 for m in range(p.shape[1])]) / len(members)
    for _ in range(steps):
        r = p * s
        s = (r / r.sum(axis=1, keepdims=True) * c[:, None]).sum(axis=0) / c.sum()
    return s, float((c * np.log(p @ s)).sum())


def test_inference_finds_the_best_penalised_set():
    """Against EM on every subset: the chosen set is within the tolerance of the best penalised value."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet(np.full(60, 0.3), 4).T + 1e-6
    p /= p.sum(axis=0)
    truths = [[1, 0, 0, 0], [0, 0, 0, 1], [.5, .5, 0, 0], [0, .8, .2, 0], [.3, .3, .4, 0], [.98, .02, 0, 0], [.25, .25, .25, .25]]
    docs = []
    for d, t in enumerate(truths):
        n = rng.multinomial(400 if d != 1 else 3, p @ np.array(t))
        docs += [(d, b, int(k)) for b, k in enumerate(n) if k]
    owner, bucket, count = (np.array(x, np.int64) for x in zip(*docs))
    shares, factor = language.infer(p, bucket, count, owner, len(truths))
    for d in range(len(truths)):
        mine = owner == d
        q, c = p[bucket[mine]], count[mine].astype(float)
        penalty = language.OVERLAP * math.log1p(c.sum()) / 2
        best = max((slow_em(q, c, set(m), 3000)[1] - penalty * len(m), m) for r in range(1, 5) for m in itertools.combinations(range(4), r))
        found = set(np.flatnonzero(shares[d] > 0).tolist())
        s, value = slow_em(q, c, found, 3000)
        assert value - penalty * len(found) > best[0] - 0.5
        assert np.abs(s - shares[d]).max() < 0.02
        assert 0 < factor[d] <= 1 and abs(shares[d].sum() - 1) < 1e-9


@pytest.fixture(scope="module")
def big(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    return docs, language.learn(docs, language.fold("doc_id", 4) != 2)


def test_model_counts_all_learning_texts(spark, big):
    docs, model = big
    rows = [r for r in docs.select("doc_id", "text", "lang").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    assert model.names == sorted({r.lang for r in rows})
    counts = np.zeros((len(model.names), 1 << model.bits), np.int64)
    for r in rows[:]:
        for _, _, _, bucket, n, _ in language.bags([r.text], model.bits):
            counts[model.names.index(r.lang), bucket] += n
    assert np.array_equal(language.likelihoods(counts), model.likelihood)
    assert np.abs(model.likelihood.sum(axis=0) - 1).max() < 1e-3


def test_held_out_accuracy(spark):
    got = QUERIES["op11_language_id"](spark, BIG).toPandas()
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang").toPandas()
    m = got.merge(docs, on="doc_id")
    assert len(m) == len(docs) and got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(m.doc_id, m.held_out))
    held = m[m.held_out]
    for lang, rows in held.groupby("lang"):
        assert (rows.lang_pred == lang).mean() > 0.98, lang


def test_mixed_documents_get_their_shares(big):
    docs, model = big
    long = {x: " ".join(r.text for r in docs.filter(f"lang = '{x}' and n_chars between 2000 and 6000").limit(30).collect()) for x in model.names}
    for a, b, part in (("en", "fr", 0.5), ("de", "es", 0.7), ("fr", "es", 0.9)):
        text = long[a][:int(20_000 * part)] + " " + long[b][:int(20_000 * (1 - part))]
        names, score, sets = language.identify_texts([text], model)
        got = {x["lang"]: x["share"] for x in sets[0]}
        assert {a, b} <= set(got) and abs(got[a] - part) < 0.08, got
        assert names == [a if part > 0.5 else max(got, key=got.get)] and score[0] <= max(got.values()) + 1e-9


def test_awkward_rows(spark):
    docs = awkward_docs(spark)
    rows = docs.withColumn("lang", language.F.expr("case when doc_id in (1, 3) then 'xx' when doc_id = 10 then 'yy' when doc_id = 6 then 'zz' end"))
    out = language.language_report(rows).collect()
    assert len(out) == rows.count()
    assert out[0].asDict().keys() == {"doc_id", "held_out", "lang_pred", "score", "languages"}
    text = {r.doc_id: r.text for r in rows.collect()}
    for r in out:
        if r.doc_id is None:
            continue
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        letters = any(c.isalpha() for c in text[r.doc_id] or "")
        assert (r.lang_pred == "und" and r.score == 0 and r.languages == []) if not letters else (r.lang_pred in ("xx", "yy") and 0 < r.score <= 1)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, set()).add((r.lang_pred, r.score))
    assert len(by[9]) == 1 and by[1] == by[2]
    unlearnt = language.language_report(docs.withColumn("lang", language.F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unlearnt} == {("und", 0.0)}
    assert language.language_report(empty_docs(spark).withColumn("lang", language.F.lit("en"))).collect() == []


def test_model_stays_bounded():
    for n in (1, 4, 256, 300, 5000, language.MOST_LANGUAGES):
        bits = language.bucket_bits(n)
        assert n << bits <= language.CELLS and language.LEAST_BITS <= bits <= language.MOST_BITS
