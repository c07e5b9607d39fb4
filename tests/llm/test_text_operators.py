"""Near-duplicates, suffix dedup, tokens, pieces, decontamination against brute force."""

import numpy as np
import pytest
from helpers import shingle_set, awkward_docs, brute_components, brute_repeats, empty_docs, prose

from leadlens.llm import neardup, pieces, suffixes, templates, tokencount
from leadlens.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---------------------------------------------------------------- near-duplicates
def near(docs):
    return neardup.near_duplicates(docs).collect()


def test_near_duplicates_match_brute_force(spark):
    rng = np.random.default_rng(5)
    extra = []
    for k in range(60):   # a cloud of variants around one text: some linked, some just short of it
        w = prose(50, 150).split()
        for at in rng.integers(0, 150, rng.integers(0, 9)):
            w[at] = f"edit{rng.integers(0, 1 << 30)}"
        extra.append((100 + k, " ".join(w)))
    for k in range(40):   # a passage many otherwise different texts share
        extra.append((300 + k, prose(50, 40) + " " + prose(1000 + k, 100)))
    docs = awkward_docs(spark, extra)
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    got = near(docs)
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)


def test_near_duplicates_of_a_table(spark):
    docs = documents(spark)
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near(docs)} == want


def test_an_id_with_several_texts_names_one_component(spark):
    a, b = prose(21, 60), prose(22, 60)
    rows = [(1, a), (1, b), (2, a + " end"), (3, "start " + b), (4, a), (5, prose(23, 60)), (6, prose(24, 60)), (6, prose(25, 60)), (0, prose(24, 60)),
            (7, None), (7, prose(26, 9)), (8, prose(26, 9)), (9, ""), (9, prose(27, 4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: c for i, (_, c) in brute_components([r for r in rows if r[1]]).items()}
    got = near(docs)
    assert {1, 2, 3, 4} == {r.doc_id for r in got if r.component_id == 1}
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.n_shingles else r.doc_id), r
    assert sorted((r.doc_id, r.n_shingles) for r in got) == sorted((i, len(shingle_set(t))) for i, t in rows)


def family(n, seed):
    """Variants of one page that are just short of 0.75 to it, most of which share a phrase."""
    rng = np.random.default_rng(seed)
    page = prose(60, 200).split()
    out = []
    for k in range(n):
        w = page.copy()
        w[100:103] = ["shared", "new", "phrase"]
        for at in rng.choice(np.r_[0:95, 110:200], 5 + k % 3, replace=False):
            w[at] = f"edit{rng.integers(0, 1 << 40)}"
        out.append((k + 1, " ".join(w)))
    return [(0, " ".join(page)), *out]


def test_hub_families_match_brute_force(spark):
    rows = family(250, 1)
    rows += [(1000 + i, t.replace("edit", "edot", 1)) for i, t in rows[:60]]
    want = brute_components(rows)
    assert 10 < len({c for _, c in want.values()}) < 300
    got = near(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_near_duplicates_empty(spark):
    assert near(empty_docs(spark)) == []


def test_keep_one(spark):
    docs = awkward_docs(spark)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [1, 4, 5, 6, 7, 9, 10, 11, 12, 13, 15]


# ---------------------------------------------------------------- suffix dedup
def test_repeats_match_brute_force(spark):
    docs = awkward_docs(spark, [(20, prose(9, 60)), (21, "q" + prose(9, 60)[100:400]), (22, prose(9, 60)[50:] + "tail")])
    docs = docs.filter("doc_id is null or doc_id not in (11, 12)").unionByName(
        awkward_docs(spark).filter("doc_id = 11").selectExpr(*[c if c != "text" else "substr(text, 1, 3000) as text" for c in docs.columns]))
    rows = docs.select("doc_id", "text").collect()
    want = sorted(zip([str(r.doc_id) for r in rows], brute_repeats([r.text for r in rows])))
    got = sorted((str(r[0]), tuple(r)[1:]) for r in suffixes.repeat_report(docs).collect())
    assert got == want


@pytest.mark.parametrize("hot", [1, 4096])
def test_repeats_of_a_table(spark, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT_RUNS", hot)
    rows = documents(spark).limit(120).select("doc_id", "text").collect()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = dict(zip([r.doc_id for r in rows], brute_repeats([r.text for r in rows])))
    assert {r[0]: tuple(r)[1:] for r in suffixes.repeat_report(docs).collect()} == want


def test_repeats_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 1024)
    text = prose(4, 900).encode()
    data = np.frombuffer(text + text[500:900] + text[:300], np.uint8)
    runs = suffixes.runs_of(data, np.array([0, len(data)]))
    covered = sorted((int(s), int(n)) for _, starts, windows, _, _ in runs for s, n in zip(starts, windows))
    assert covered[0][0] == 0 and sum(n for _, n in covered) == len(data) - 199
    assert all(a + n == b for (a, n), (b, _) in zip(covered, covered[1:]))


@pytest.mark.parametrize("letters", [[97, 98], [0, 255], list(range(256))])
@pytest.mark.parametrize("block", [5, 8192])
def test_suffix_levels_find_all_repeats(letters, block):
    rng = np.random.default_rng(3)
    data = rng.choice(np.array(letters, np.uint8), 900)
    data[500:560] = data[100:160]
    index = suffixes.SuffixLevels(data, 12, block)
    starts = np.arange(len(data) - 11)
    for k in range(0, len(starts), 37):
        index.add(starts[k:k + 37])
    w = np.lib.stride_tricks.sliding_window_view(data, 12)
    _, at, n = np.unique(w, axis=0, return_inverse=True, return_counts=True)
    assert (index.repeated[starts] == (n[at.ravel()] > 1)).all()
    sizes = [len(k) for k, _ in index.levels]
    assert all(2 * b < a for a, b in zip(sizes, sizes[1:])) and sum(sizes) == len(n)
    for heads, places in index.levels:
        spelled = [bytes(data[p:p + 12]) for p in places]
        assert spelled == sorted(spelled) and [int.from_bytes(x[:8], "big") for x in spelled] == heads.tolist()


def test_remove_repeats_keeps_columns_and_characters(spark):
    docs = awkward_docs(spark)
    got = suffixes.remove_repeats(docs)
    assert got.columns == docs.columns
    by = {r.doc_id: r for r in got.collect()}
    assert by[1].text == "" and by[1].n_chars == 0
    assert by[4].text is None and by[13].text == "x" * 199
    assert set(by[10].text) <= {"é"}


def test_repeats_empty(spark):
    assert suffixes.repeat_report(empty_docs(spark)).collect() == []
    assert suffixes.remove_repeats(empty_docs(spark)).collect() == []


# ---------------------------------------------------------------- token counts
def library_counts(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    return [len(e) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


ODD = ["a\nb c", "  two  spaces ", "tab\t x", "x<|endoftext|>y <|endoftext|> z", "don't we'll", "end ", " a", " \n ", "日本 語", "a\x1cb c\u00a0d \u2003e"]


def test_token_counts_match_the_library(spark):
    docs = awkward_docs(spark, [(100 + i, t) for i, t in enumerate(ODD)])
    rows = docs.collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), n) for r, n in zip(rows, library_counts([r.text for r in rows])))
    got = sorted((str(r[0]), r[1], r[2]) for r in tokencount.count_tokens(docs, tokenizer_file("byte_bpe_50k.json")).collect())
    assert got == want
    assert tokencount.count_tokens(empty_docs(spark), tokenizer_file("byte_bpe_50k.json")).collect() == []


@pytest.mark.parametrize("chunk,overlap", [(64, 8), (200, 16), (33, 3)])
def test_overlaps_resynchronise(chunk, overlap):
    c = tokencount.Counter(tokenizer_file("byte_bpe_50k.json"), chunk, overlap)
    texts = ODD + [prose(5, 300), "ab" * 500 + " tail end", " " * 300 + "x", "a <|endoftext|> b " * 40, prose(6, 50) + "y" * 400 + prose(7, 50),
                   "\n".join(prose(k, 9) for k in range(30))]
    assert [c.count(t) for t in texts] == library_counts(texts)


# ---------------------------------------------------------------- pieces
@pytest.fixture(scope="module")
def spm():
    return pieces.model(tokenizer_file("piece_bpe_32k.model"))


TEXTS = ["", "a", " ", "  a  b ", "\n\t x", "x▁y▁", "a\x00b", "日本語テスト 😀 ok", "aaaa" * 300, " " * 700 + "b", "<s> <unk> <0x41>", "é́", prose(1, 200)]


def test_pieces_without_dropout_are_the_library_s(spm):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    texts = [t for t in TEXTS if "▁" not in t]
    got = pieces.encode(spm, texts, np.arange(len(texts)), 0.0)
    assert [g.tolist() for g in got] == [sp.encode(t) for t in texts]


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 1.0])
def test_pieces_round_trip(spm, rate):
    got = pieces.encode(spm, TEXTS, np.arange(len(TEXTS)), rate)
    assert [spm.decode(g.tolist()) if len(g) else "" for g in got] == TEXTS
    again = [pieces.encode(spm, [t], np.array([k]), rate)[0] for k, t in enumerate(TEXTS)]
    assert [g.tolist() for g in got] == [g.tolist() for g in again]


def test_pieces_of_a_very_long_text(spm):
    """A million characters without a space before five million of prose: whole, and as the library has it."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    text = "abcd" * 265_000 + " " + prose(8, 700_000)
    assert len(text) > 5_000_000
    (got,) = pieces.encode(spm, [text], np.array([5]), 0.0)
    assert np.array_equal(got, np.array(sp.encode(text)))
    (got,) = pieces.encode(spm, [text], np.array([5]), 0.1)
    assert spm.decode(got.tolist()) == text


def test_cuts_of_long_texts_do_not_show(spm, monkeypatch):
    texts = [" ".join(("x" * (k % 300) if k % 7 == 0 else "word") + " " * (k % 3) for k in range(400)), "y" * 900 + " z", "  " * 500 + "q"]
    want = [pieces.encode(spm, texts, np.arange(3), rate) for rate in (0.0, 0.3)]
    monkeypatch.setattr(pieces, "SPLIT_CHARS", 50)
    monkeypatch.setattr(pieces, "CHUNK_CHARS", 120)
    for rate, w in zip((0.0, 0.3), want):
        assert [g.tolist() for g in pieces.encode(spm, texts, np.arange(3), rate)] == [g.tolist() for g in w]


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(tokencount, "MEMO_BYTES", 3000)
    c = tokencount.Counter(tokenizer_file("byte_bpe_50k.json"))
    texts = [prose(k, 40) + " " + "長い文字列" * 60 for k in range(12)] + [prose(3, 40)]
    assert [c.count(t) for t in texts] == library_counts(texts)
    assert sum(200 + 4 * len(u) for u in c.memo) <= 3000 and all(len(u) <= tokencount.MEMO_CHARS for u in c.memo)


def brute_dropout(m, text, key, rate, seed):
    """One merge at a time over the whole text: best rank first, leftmost first."""
    codes = [pieces.SPACE if c == " " else (0x10FFFF if c == "▁" else ord(c)) for c in " " + text]
    sym, at = [int(m.chars[c]) for c in codes], list(range(len(codes) + 1))
    key = pieces._key(seed, np.array([key]))
    while True:
        best = None
        for i in range(len(sym) - 1):
            hit = m.pairs.get(sym[i] * m.width + sym[i + 1]) if sym[i] >= 0 and sym[i + 1] >= 0 else None
            if hit and (best is None or hit[0] < best[0]) and not pieces._dropped(
                    key, np.array([at[i]]), np.array([at[i + 1]]), np.array([at[i + 2]]), rate)[0]:
                best = (hit[0], i, hit[1])
        if best is None:
            return sym
        sym[best[1]:best[1] + 2] = [best[2]]
        del at[best[1] + 1]


def test_pieces_follow_the_agenda(spm, monkeypatch):
    text = "The quick brown foxes jumped overwhelmingly  again"
    for rate in (0.1, 0.4):
        want = brute_dropout(spm, text, 77, rate, 3)
        for limit in (0, 192):
            monkeypatch.setattr(pieces, "LONG_UNIT", limit)
            assert pieces.encode(spm, [text], np.array([77]), rate, 3)[0].tolist() == want
    kinds = {tuple(pieces.encode(spm, [text], np.array([k]))[0].tolist()) for k in range(40)}
    assert len(kinds) > 10


def test_pieces_report(spark):
    docs = awkward_docs(spark)
    path = tokenizer_file("piece_bpe_32k.model")
    rows = pieces.round_trip_report(docs, path).collect()
    assert len(rows) == docs.count() and all(r.lossless for r in rows)
    encoded = pieces.add_pieces(docs, path).select("row.doc_id", "row.text", "pieces")
    back = pieces.decode_column(encoded, path).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert pieces.round_trip_report(empty_docs(spark), path).collect() == []


# ---------------------------------------------------------------- decontamination
BENCH = [(1, "Anna bought 12 apples for 3 euros and gave 5 of them to her brother before lunch on that sunny day."),
         (2, "a train of 8 cars"), (3, None), (4, ""), (5, "The river that runs through the old valley turns north behind the last mill.")]


def test_leaks(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    swap = BENCH[0][1].replace("Anna", "Peter").replace("12", "40").replace("3 euros", "7 euros").replace("5 of", "9 of")
    torn = BENCH[0][1].replace("12", "40").replace("3 euros", "40 euros")
    docs = awkward_docs(spark, [(100, prose(8, 30) + " " + BENCH[0][1] + " " + prose(9, 10)), (101, prose(3, 9) + ". " + swap), (102, torn),
                                (103, "and " + BENCH[1][1] + " passed"), (104, BENCH[4][1].upper()),
                                (105, "the river that runs through a green field turns south"), (100, BENCH[4][1])])
    got = {(r.doc_id, r.item_id, r.kind) for r in templates.leak_report(docs, bench).collect()}
    assert got == {(100, 1, "verbatim"), (101, 1, "reparameterised"), (103, 2, "verbatim"), (104, 5, "verbatim"), (100, 5, "verbatim"),
                   (102, 1, "edited")}
    kept = templates.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == docs.count() - 6
    assert templates.leak_report(empty_docs(spark), bench).collect() == []
    assert templates.leak_report(docs, bench.limit(0)).collect() == []
    assert templates.decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_leaks_of_a_table_match_word_windows(spark):
    import re
    docs, bench = documents(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {}
    for r in bench.collect():
        w = re.findall(r"\w+", r.text.lower())
        for k in range(len(w) - 7):
            items.setdefault(tuple(w[k:k + 8]), set()).add(r.item_id)
    want = set()
    for r in docs.collect():
        w = re.findall(r"\w+", (r.text or "").lower())
        want |= {(r.doc_id, i) for k in range(len(w) - 7) for i in items.get(tuple(w[k:k + 8]), ())}
    assert {(r.doc_id, r.item_id) for r in templates.leak_report(docs, bench).collect()} == want


def test_leaks_of_parts_and_of_copies_with_insertions(spark):
    rng = np.random.default_rng(7)
    items = [(r.item_id, r.text.lower()) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect() if r.text]
    docs, want = [], set()
    for item, text in items:
        w = text.split()
        if len(w) >= 30:   # two fifths of the item, at least 14 words in a row, among other text
            n = max(14, -(-len(w) * 2 // 5))
            at = int(rng.integers(0, len(w) - n + 1))
            want.add((len(docs), item))
            docs.append((len(docs), " ".join([prose(len(docs), 40), "and", *w[at:at + n], prose(len(docs) + 1, 40)])))
        if len(w) >= 24:   # the whole item, with a word put in after each third of it
            third = len(w) // 3
            want.add((len(docs), item))
            docs.append((len(docs), " ".join(w[:third] + ["zzyzx"] + w[third:2 * third] + ["qwrt"] + w[2 * third:])))
    got = templates.leak_report(spark.createDataFrame(docs, "doc_id long, text string"),
                                spark.createDataFrame(items, "item_id long, text string"))
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    assert len(want) > 50 and want <= found


def test_leaks_in_other_letters(spark):
    bench = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").filter("text is not null")
    items = [(r.item_id, r.text) for r in bench.collect()] + [(-1, "Die Straße misst 12 Meter und der Fluß ist im Sommer trocken wie ein Weg.")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs, want = [], set()
    for item, text in items:
        for copy in (text.upper(), text.lower(), text.title()):
            want.add((len(docs), item))
            docs.append((len(docs), copy))
    got = templates.leak_report(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert want <= {(r.doc_id, r.item_id) for r in got}
    assert {r.kind for r in got if (r.doc_id, r.item_id) in want} == {"verbatim"}
