"""Every stage of the corpus pipeline against brute force over the rows it was given; components."""

import numpy as np
import pytest
from helpers import awkward_docs, brute_components, brute_repeats, empty_docs

import corpus_pipeline
from leadlens.llm import pieces, quality, templates
from leadlens.llm.components import components
from leadlens.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """(rows in, rows out) of every stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = corpus_pipeline.written(stage(spark, docs, SF), f"steps-{k}")
        out.append((docs, after))
        docs = after
    return out


def test_stages_are_named_in_order():
    assert [n.split()[0] for n, _ in corpus_pipeline.STAGES] == ["quality", "MinHash", "suffix-array", "benchmark", "SentencePiece"]


def test_quality_stage_keeps_what_scores_well(spark, steps):
    """Accuracy itself is held out on the larger table (test_quality_held_out)."""
    before, after = steps[0]
    score = {r.doc_id: r.predicted for r in quality.score_report(before, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, p in score.items() if p)


def test_near_dedup_stage_keeps_one_of_each_component(steps):
    before, after = steps[1]
    want = brute_components([(r.doc_id, r.text) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_suffix_stage_cuts_what_repeats(steps):
    before, after = steps[2]
    rows = before.collect()
    left = {r.doc_id: r for r in after.collect()}
    assert len(left) == len(rows)
    for r, (n, removed, _, _) in zip(rows, brute_repeats([r.text for r in rows])):
        now = len((left[r.doc_id].text or "").encode())
        # a character cut in half stays: three bytes on either side of each of its spans at most
        assert n - removed <= now <= n - removed + (6 * (n // 200 + 1) if removed else 0)
        assert left[r.doc_id].n_chars == (r.n_chars if not removed else len(left[r.doc_id].text))


def test_decontamination_stage_drops_the_leaks(spark, steps):
    before, after = steps[3]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    leaking = {r.doc_id for r in templates.leak_report(before, bench).collect()}
    ids = sorted(r.doc_id for r in before.collect())
    assert sorted(r.doc_id for r in after.collect()) == [i for i in ids if i not in leaking]
    # every whole item in a text is a leak, and nothing without eight of an item's words in a row is one
    words = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    grams = lambda w, n: {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}
    items = [words(r.text) for r in bench.collect()]
    parts = set().union(*(grams(w, 8) for w in items))
    for r in before.collect():
        w = words(r.text)
        if any(tuple(i) in grams(w, len(i)) for i in items):
            assert r.doc_id in leaking
        if not grams(w, 8) & parts:
            assert r.doc_id not in leaking


def test_encoding_stage_decodes_to_the_text(steps):
    before, after = steps[4]
    text = {r.doc_id: r.text for r in before.collect()}
    m = pieces.model(tokenizer_file("piece_bpe_32k.model"))
    rows = after.collect()
    assert len(rows) == len(text)
    for r in rows:
        assert r.text == text[r.doc_id] and r.n_pieces == len(r.pieces)
        assert (m.decode(r.pieces) if r.pieces else "") == (r.text or "")


def test_run_is_the_stages_one_after_the_other(spark, steps):
    again = corpus_pipeline.run(spark, SF).select("doc_id", "text", "n_pieces")
    want = steps[-1][1].select("doc_id", "text", "n_pieces")
    assert again.exceptAll(want).count() == 0 and again.count() == want.count()


def test_awkward_rows_pass_every_stage(spark):
    docs = awkward_docs(spark)
    for docs in (docs, empty_docs(spark)):
        rows = docs
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            after = corpus_pipeline.written(stage(spark, rows, SF), f"awkward-{k}")
            assert after.columns == docs.columns + (["pieces", "n_pieces"] if k == 4 else [])
            assert after.count() <= rows.count()
            rows = after


# ---------------------------------------------------------------- components
def brute_labels(edges):
    up = {}

    def top(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return {(n, top(n)) for n in up}


@pytest.mark.parametrize("edges", [
    [(k, k + 1) for k in range(70)], [(k + 1, k) for k in range(40, 0, -1)], [(0, k) for k in range(1, 60)], [(99, k) for k in range(60)],
    [(1, 2), (2, 1), (1, 2), (5, 5), (7, 8), (8, 9), (3, 9)], [(k, (k * 37 + 11) % 200) for k in range(0, 200, 3)]])
def test_components_of_chains_stars_and_pairs(spark, edges):
    table = spark.createDataFrame([(a, b, "clash", "clash") for a, b in edges] + [(None, 4, "", ""), (4, None, "", "")], "a long, b long, u string, v string")
    got = components(table).collect()
    want = brute_labels([(a, b) for a, b in edges if a != b])
    assert sorted((r.node, r.label) for r in got) == sorted(want)


def test_components_without_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# ---------------------------------------------------------------- non-negative risk of the quality classifier
def test_risk_and_gradient_match_their_definition():
    """fit_risk's stationary point, and its gradient by differences, from the risk written out."""
    rng = np.random.default_rng(0)
    positive, unlabelled = (quality._design(rng.normal(m, 1, (n, quality.N_FEATURES)).astype(np.float32),
                                            np.sort(rng.normal(0, 1, (quality.N_FEATURES, quality.BINS)), axis=1)) for m, n in ((0.6, 60), (0, 90)))

    def risk(w, prior):
        z = lambda d: np.array([sum(w[k] for k in row) for row in d])
        yes = lambda d: np.log1p(np.exp(-z(d))).mean()  # noqa: E731  loss of calling a positive row negative
        no = lambda d: np.log1p(np.exp(z(d))).mean()
        return prior * yes(positive) + max(0.0, no(unlabelled) - prior * no(positive))

    for prior in (0.2, 0.5):
        w = quality.fit_risk(positive, unlabelled, prior)
        full = lambda w: risk(w, prior) + quality.PENALTY * (w ** 2).sum() / 2  # noqa: E731,B023
        base = full(w)
        assert base < full(np.zeros_like(w))
        # no small step in any of many directions does much better
        for _ in range(40):
            d = rng.normal(0, 1, len(w))
            d *= 0.05 / np.sqrt((d ** 2).sum())
            assert full(w + d) > base - 2e-3


def test_prior_is_recovered():
    rng = np.random.default_rng(1)
    cuts = np.sort(rng.normal(0, 1, (quality.N_FEATURES, quality.BINS)), axis=1)
    draw = lambda m, n: rng.normal(m, 1, (n, quality.N_FEATURES)).astype(np.float32)
    for share in (0.3, 0.7):
        n = 3000
        mixed = np.concatenate([draw(1.2, int(n * share)), draw(-1.2, n - int(n * share))])
        got = quality.estimate_prior(quality._design(draw(1.2, 1500), cuts), quality._design(rng.permutation(mixed), cuts))
        assert abs(got - share) < 0.08
