"""Near-duplicate classes by a signature-coordinate inverted join.

Texts are sets of five-word shingles; texts of equal sets are one class, and
classes are joined as follows.

* Each class posts its min-hash signature: one posting per (coordinate, value)
  pair.  A pair of similarity 0.75 agrees on 96 of 128 coordinates on average,
  and on fewer than ``MATCHES`` = 72 with a probability of 1.2 in a million.
* Skip merging: a class most of whose probed coordinates occur nowhere else
  hardly reaches the match threshold and is skipped before any list is merged
  (at similarity 0.75, at most 3.1 in a million for each end of a pair).
* Prefix: coordinates are ordered rare first; two signatures that agree on
  ``MATCHES`` of n coordinates share one of their n - MATCHES + 1 rarest, so
  only those are posted, and frequent passages never form long lists.
* Each list is merged through its hub (the member with the most postings in
  common), so a list of m members gives m pairs, not m * m.  Hub pairs are
  compared on their full sets.
* A pair of members x, y of one hub family that is still unlinked needs
  min(a_x, a_y) + min(e_x, e_y) common shingles, a being shingles shared with the hub
  and e those shared with other members only.  Nearly all members fail this bound
  against every size their family holds; the pairs that pass are counted on all
  coordinates, kept above the match threshold, and confirmed on full sets.

A class has a number of its own, so an id may stand for several texts; texts of one
id are linked.  Links go through ``components``; a component is named by its smallest id.

Defined results: null, empty and blank texts have the empty set and are linked
with nothing; a text of fewer than five words has its whole word sequence as
one shingle; rows that repeat an id or a text share a component; rows with a
null id have a null component and are kept; an empty table gives an empty
result; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadlens.llm.common import byte_buffer, list_column, map_batches, mix, owner, shingles, slices, words, written
from leadlens.llm.components import components
from leadlens.operators.joins import broadcast_if

WIDTH = 5
NUMERATOR, DENOMINATOR = 75, 100
COORDINATES, MATCHES = 128, 72
PROBED, PROBED_SHARED = 24, 8
# ids (8 bytes each) that may be shipped to every task
BROADCAST_IDS = 2_000_000
# names of texts (three longs each) that may be shipped to every task
BROADCAST_NAMES = 500_000
SLICE_BYTES = 1 << 19
# shingles of hubs that a worker keeps from one batch to the next
SEEN_SHINGLES = 4_000_000

_U32 = np.uint32
_rng = np.random.default_rng(20240229)
_MULTIPLY = (_rng.integers(0, 1 << 31, COORDINATES, dtype=np.int64) * 2 + 1).astype(_U32)
_FLIP = _rng.integers(0, 1 << 32, COORDINATES, dtype=np.int64).astype(_U32)


def signatures(doc: np.ndarray, values: np.ndarray, n_docs: int) -> np.ndarray:
    """Min-hash signatures (n_docs x COORDINATES); rows without shingles are all zero."""
    out = np.zeros((n_docs, COORDINATES), _U32)
    if len(doc):
        low = (values >> np.uint64(32)).astype(_U32)
        begins = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        for k in range(COORDINATES):
            out[doc[begins], k] = np.minimum.reduceat((low ^ _FLIP[k]) * _MULTIPLY[k], begins)
    return out


def shingle_sets(column: pa.Array, width: int = WIDTH):
    """Per slice of texts: (first, last, doc, value) of the distinct shingles."""
    data, offsets = byte_buffer(column)
    for i, j in slices(offsets, SLICE_BYTES):
        part, own = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        s, _, h = words(part, own)
        yield i, j, *shingles(owner(own, s), h, width, j - i)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, doc, value in shingle_sets(b.column(1)):
            n = np.bincount(doc, minlength=j - i)
            prints = np.zeros((2, j - i), np.uint64)
            if len(doc):
                begins = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                prints[0, doc[begins]] = np.add.reduceat(mix(value), begins)
                prints[1, doc[begins]] = np.add.reduceat(mix(value ^ np.uint64(0x5851F42D4C957F2D)), begins)
            sig = signatures(doc, value, j - i)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(n, pa.int64()),
                 pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)),
                 list_column(sig.view(np.int32).ravel(), np.full(j - i, COORDINATES), pa.int32())],
                names=["id", "h", "n", "p1", "p2", "sig"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) -> sizes, intersection and the shingles of a that b lacks."""
    seen: dict[int, np.ndarray] = {}
    for b in batches:
        a_ids, b_ids = b.column(0).to_pylist(), b.column(1).to_pylist()
        need = {x: k for k, x in enumerate(b_ids) if x not in seen}
        if need and sum(map(len, seen.values())) > SEEN_SHINGLES:
            seen.clear()
            need = {x: k for k, x in enumerate(b_ids)}
        if need:
            at = list(need.items())
            for i, j, doc, value in shingle_sets(b.column(3).take(pa.array([k for _, k in at]))):
                cut = np.searchsorted(doc, np.arange(j - i + 1))
                for k in range(j - i):
                    seen[at[i + k][0]] = value[cut[k]:cut[k + 1]].copy()
        for i, j, doc, value in shingle_sets(b.column(2)):
            cut = np.searchsorted(doc, np.arange(j - i + 1))
            own, other, common, extras, counts = [], [], [], [], []
            for k in range(j - i):
                x, y = value[cut[k]:cut[k + 1]], seen[b_ids[i + k]]
                at = np.searchsorted(y, x)
                hit = (y[np.minimum(at, len(y) - 1)] == x) if len(y) else np.zeros(len(x), bool)
                own.append(len(x))
                other.append(len(y))
                common.append(int(hit.sum()))
                extras.append(x[~hit])
                counts.append(len(x) - common[-1])
            rest = np.concatenate(extras) if extras else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a_ids[i:j], pa.int64()), pa.array(b_ids[i:j], pa.int64()), pa.array(own, pa.int64()),
                 pa.array(other, pa.int64()), pa.array(common, pa.int64()),
                 list_column(rest.view(np.int64), np.array(counts), pa.int64())],
                names=["a", "b", "n_a", "n_b", "common", "extras"])


def compare_sets(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Exact comparison of the shingle sets of pairs (a, b); ``texts`` has (id, text).
    Sort order within a task keeps the pairs of one b together, so its set is built once."""
    rows = (pairs.select("a", "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
            .select("a", "b", "text_a", "text_b"))
    return map_batches(rows, _compare, "a long, b long, n_a long, n_b long, common long, extras array<long>")


def _linked(common: str = "common", n_a: str = "n_a", n_b: str = "n_b"):
    return F.col(common) * DENOMINATOR >= (F.col(n_a) + F.col(n_b) - F.col(common)) * NUMERATOR


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h"))
    about = written(map_batches(rows, _describe, "id long, h long, n long, p1 long, p2 long, sig array<int>"), "nd-about")
    # a class is numbered once, as it is written; (id, h) names one of its texts
    reps = written(about.filter("n > 0 and id is not null").groupBy("p1", "p2")
                   .agg(F.min(F.struct("id", "h", "sig")).alias("one"))
                   .select(F.monotonically_increasing_id().alias("rep"), "p1", "p2", "one.*"), "nd-reps")

    def postings(frame: DataFrame, count: int) -> DataFrame:
        return (frame.select("rep", F.posexplode(F.slice("sig", 1, count)).alias("c", "v"))
                .select("rep", F.xxhash64("c", "v").alias("key")))

    # skip merging: classes whose probed coordinates mostly occur nowhere else are out
    probes = postings(reps, PROBED)
    shared = probes.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1").select("key")
    alive = written(probes.join(shared, "key").groupBy("rep").agg(F.count("*").alias("hits"))
                    .filter(F.col("hits") >= PROBED_SHARED).select("rep"), "nd-alive")
    few = broadcast_if(alive, alive.count(), BROADCAST_IDS)
    active = written(reps.select("rep", "sig").join(few, "rep"), "nd-active")
    names = written(reps.join(few, "rep").select("rep", "id", "h"), "nd-names")
    texts = written(rows.join(broadcast_if(names, names.count(), BROADCAST_NAMES), ["id", "h"]).dropDuplicates(["rep"])
                    .select(F.col("rep").alias("id"), "text"), "nd-texts")

    # rare-first prefix of every active signature
    posted = postings(active, COORDINATES)
    lists = posted.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    own = Window.partitionBy("rep")
    prefix = written(posted.join(lists, "key")
                     .select("rep", "key", F.row_number().over(own.orderBy("df", "key")).alias("r"),
                             F.sum(F.col("df") - 1).over(own).alias("score"), F.count("*").over(own).alias("shared"))
                     .filter(F.col("r") <= F.col("shared") - (MATCHES - 1)).select("key", "rep", "score"), "nd-prefix")
    hubs = (prefix.groupBy("key").agg(F.max(F.struct("score", "rep")).alias("top"), F.count("*").alias("n"))
            .filter("n > 1").select("key", F.col("top.rep").alias("hub")))
    stars = prefix.join(hubs, "key").filter("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    tested = written(compare_sets(stars, texts).withColumn("linked", _linked()), "nd-tested")

    # classes that share an id
    held = written(about.filter("n > 0 and id is not null").select("id", F.struct("p1", "p2").alias("class")).distinct(), "nd-held")
    several = held.groupBy("id").agg(F.min("class").alias("first"), F.count("*").alias("m")).filter("m > 1").select("id", "first")
    number = reps.select(F.struct("p1", "p2").alias("class"), "rep")
    same_id = (held.join(several, "id").filter("class <> first").select("class", "first").distinct()
               .join(number.select("class", F.col("rep").alias("a")), "class")
               .join(number.select(F.col("class").alias("first"), F.col("rep").alias("b")), "first").select("a", "b"))
    links = written(tested.filter("linked").select("a", "b").unionByName(same_id), "nd-links")

    # hub families with open members; a member linked to its hub bears the hub's label
    label = F.when(F.col("linked"), F.col("b")).otherwise(F.col("a"))
    family = (tested.select("b", F.col("a").alias("x"), label.alias("label"), F.col("n_a").alias("n"), "common", "extras")
              .unionByName(tested.select("b", F.col("b").alias("x"), F.col("b").alias("label"), F.col("n_b").alias("n"),
                                         F.col("n_b").alias("common"), F.array().cast("array<long>").alias("extras")).dropDuplicates(["b"])))
    torn = tested.groupBy("b").agg(F.count("*").alias("m"), F.count_if(~F.col("linked")).alias("loose"))
    family = written(family.join(torn.filter("m > 1 and loose > 0").select("b"), "b"), "nd-family")
    spare = family.select("b", "x", F.explode("extras").alias("s"))
    again = spare.groupBy("b", "s").agg(F.count("*").alias("m")).filter("m > 1").select("b", "s")
    extra = spare.join(again, ["b", "s"]).groupBy("b", "x").agg(F.count("*").alias("e"))
    # the largest partner a member can reach: common >= 3/7 of both sizes
    reach = F.floor((F.col("common") + F.col("e")) * (DENOMINATOR + NUMERATOR) / NUMERATOR) - F.col("n")
    bounded = written(family.join(extra, ["b", "x"], "left")
                      .select("b", "x", "label", "n", "common", F.coalesce("e", F.lit(0)).alias("e"))
                      .withColumn("reach", reach), "nd-bounded")
    sizes = bounded.groupBy("b", F.col("n").alias("n2")).agg(
        F.max("reach").alias("far"), F.min("label").alias("l1"), F.max("label").alias("l2"))
    opened = written(bounded.join(sizes, "b")
                     .filter("n2 <= reach and n <= far and not (l1 = l2 and l1 = label)")
                     .select("b", "x", "label", "n", "common", "e", "reach").distinct(), "nd-open")
    y = opened.select("b", F.col("x").alias("y"), F.col("label").alias("label2"), F.col("n").alias("n2"),
                      F.col("common").alias("common2"), F.col("e").alias("e2"), F.col("reach").alias("reach2"))
    open_pairs = (opened.join(y, "b").filter("label < label2 and n2 <= reach and n <= reach2")
                  .filter((F.least("common", "common2") + F.least("e", "e2")) * (DENOMINATOR + NUMERATOR)
                          >= (F.col("n") + F.col("n2")) * NUMERATOR)
                  .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    sig_a = active.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a"))
    sig_b = active.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"))
    collisions = F.aggregate(F.zip_with("sig_a", "sig_b", lambda p, q: (p == q).cast("int")), F.lit(0), lambda t, v: t + v)
    matched = open_pairs.join(sig_a, "a").join(sig_b, "b").filter(collisions >= MATCHES).select("a", "b")
    more = compare_sets(matched, texts).filter(_linked()).select("a", "b")
    named = written(components(links.unionByName(more)), "nd-components")

    # a component is named by its smallest id
    members = reps.join(named.withColumnRenamed("node", "rep"), "rep").select("rep", "label", "id")
    least_id = members.groupBy("label").agg(F.min("id").alias("least"))
    by_class = written(reps.select("p1", "p2", "rep", "id").join(members.select("rep", "label").join(least_id, "label"), "rep", "left")
                       .select("p1", "p2", F.coalesce("least", "id").alias("label")), "nd-class-labels")
    out = about.select("id", "n", "p1", "p2")
    placed = (out.filter("n > 0").join(by_class, ["p1", "p2"], "left")
              .select("id", "n", F.when(F.col("id").isNotNull(), F.col("label")).alias("component_id")))
    alone = out.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return (placed.unionByName(alone)
            .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id",
                    F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that name their component; of rows that
    repeat an id and a text one stays, and rows with a null id stay."""
    report = written(near_duplicates(docs, id_col, text_col), "nd-report")
    ids = F.col(f"`{id_col}`").cast("long")
    gone = written(report.filter("not kept").select(F.col("doc_id").alias("gone")).distinct(), "nd-gone")
    twice = written(report.filter("kept and doc_id is not null").groupBy(F.col("doc_id").alias("again")).count()
                    .filter("count > 1").select("again"), "nd-again")
    gone, twice = (broadcast_if(x, x.count(), BROADCAST_IDS) for x in (gone, twice))
    kept = docs.join(gone, ids == F.col("gone"), "left_anti")
    once = kept.join(twice, ids == F.col("again"), "left_anti")
    again = kept.join(twice, ids == F.col("again"), "left_semi")
    return once.unionByName(again.dropDuplicates([id_col, text_col]))
