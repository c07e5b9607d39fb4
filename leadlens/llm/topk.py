"""Exact top-k inner-product search by a three-phase uniform threshold.

The vectors are cut into ``nodes`` groups of components; the score of a pair
is the sum of its nodes' partial products.

1. Every node gives each query's k best local partials; the scores of the pairs
   gathered that way are summed, and the k-th best of them over all cells is a
   safe cutoff: the true k-th score is no smaller.
2. The cutoff goes back to all cells, and each node collects the entries of at
   least cutoff / nodes: a pair that reaches the cutoff has one somewhere.
3. Pairs whose upper bound (cutoff / nodes for each node without an entry) falls
   short of the cutoff go; pairs with an entry at every node are exact, and the
   rest are resolved exactly from their components.

Work is laid out in cells of (query group x candidate group).  Every vector is packed
once and its row dealt to the cells of its group: a cell's task holds the queries and
streams the candidates past them, a tile at a time, so the rows shipped, not the pairs,
are what is shuffled.  The rows a group is dealt to are many times its table, which the
statistics of a plan don't show, so they are never the side of a join (Spark would
broadcast them through the driver).  Nothing is collected, and only pairs that reach
the cutoff leave a cell, at most k + 1 of each query.

Equal vectors are one class, so a vector that a third of all rows share is
scored once; a class keeps its k + 1 smallest ids, which is all that a top-k
with ties to the smaller id can use.

Defined results: rows with a null id, or whose vector is null or holds a null,
take no part; an empty vector scores 0; vectors of different length are
compared as if padded with zeros; a repeated (id, vector) row counts once; an
empty table gives an empty result; only the id and vector columns are read.
Scores are exact while they fit a 64-bit integer.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlens.llm.common import byte_buffer, list_column, map_batches, written

# queries that a task holds (fewer if their components are many) and candidates that it streams, on average
QUERY_BLOCK, CANDIDATE_BLOCK = 1 << 16, 1 << 17
QUERY_BYTES = PACKED_BYTES = 16 << 20
# cells for each of the cluster's cores at least; tasks that they are dealt to at most
CELLS_PER_CORE, MAX_TASKS = 4, 8192
# queries and candidates that are multiplied at once
TILE_QUERIES, TILE_CANDIDATES, FIRST_TILE = 512, 2048, 64
# pairs that a cell holds before each query keeps only its best
HELD_PAIRS = 1 << 19
# queries and pairs of one batch of results
LISTED_QUERIES, LISTED_PAIRS = 1 << 12, 1 << 16
EXACT_FLOAT, EXACT_SINGLE = float(1 << 53), float(1 << 24)
LOWEST = -(1 << 62)
RESULT = "query_id long, rank int, vec_id long, score long"


def quantised(vec: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component; null if any is null or not finite."""
    x = vec.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(x.isNotNull() & ~F.coalesce(bad, F.lit(False)),
                  F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def _kind(top: int) -> str:
    """The smallest integer type that holds components up to ``top``: vectors are shipped to many cells."""
    return next(k for k, most in (("i1", 1 << 7), ("i2", 1 << 15), ("i4", 1 << 31), ("i8", 1 << 64)) if top < most)


def _grid(asking: int, n: int, query_block: int, candidate_block: int, least: int) -> tuple[int, int]:
    """Groups of queries and of candidates: no larger than the blocks, ``least`` cells or more, and with
    as few rows shipped (groups of one side times rows of the other) as that allows."""
    queries = max(-(-asking // query_block), round((least * asking / n) ** 0.5), 1)
    return queries, max(-(-n // candidate_block), -(-least // queries))


def _packed(width: int, kind: str) -> Callable:
    """(rep, asks, qb, cb, vec): vec as the bytes of ``width`` components, padded with zeros."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.dtype(kind).itemsize * width
        for whole in batches:
            for i in range(0, len(whole), step := max(1, PACKED_BYTES // size)):
                b = whole.slice(i, step)
                n = b.column(4).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                m = np.zeros((len(b), width), kind)
                row = np.repeat(np.arange(len(b)), n)
                m[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = b.column(4).flatten().to_numpy(zero_copy_only=False)
                offsets = np.arange(len(b) + 1, dtype=np.int64) * size
                data = pa.Array.from_buffers(pa.large_binary(), len(b), [None, pa.py_buffer(offsets), pa.py_buffer(m)])
                yield pa.RecordBatch.from_arrays([*b.columns[:4], data.cast(pa.binary())], names=["rep", "asks", "qb", "cb", "vec"])
    return pack


def _cells(batches: Iterator[pa.RecordBatch], nodes: int, kind: str, number: str) -> Iterator[tuple]:
    """Per cell: ids, components by node and cutoffs of its queries, and an iterator over (ids, components) of tiles
    of candidates. ``batches`` have (place, id, vec, cutoff), by place: twice the cell, plus 1 for a candidate."""
    def pieces():
        for b in batches:
            if not len(b):
                continue
            place, ids, cutoff = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
            m = byte_buffer(b.column(2))[0].view(kind).reshape(len(b), -1)
            for i, j in itertools.pairwise(np.flatnonzero(np.r_[True, place[1:] != place[:-1], True])):
                step = m.shape[1] // nodes
                parts = [np.ascontiguousarray(m[i:j, x * step:(x + 1) * step], number) for x in range(nodes)]
                yield int(place[i]), ids[i:j], parts, cutoff[i:j]

    def tiles(first: tuple, rest: Iterator[tuple]):
        size = FIRST_TILE       # small at first: few pairs pass once a cell's best so far are known
        for _, ids, parts, _ in itertools.chain([first], rest):
            i = 0
            while i < len(ids):
                yield ids[i:i + size], [p[i:i + size] for p in parts]
                i, size = i + size, min(2 * size, TILE_CANDIDATES)

    for _, own in itertools.groupby(pieces(), key=lambda x: x[0] // 2):
        held = []
        for x in own:
            if x[0] % 2:
                if held:
                    ids, cutoff = (np.concatenate([h[k] for h in held]) for k in (1, 3))
                    yield ids, [np.concatenate(p) for p in zip(*(h[2] for h in held))], cutoff, tiles(x, own)
                break
            held.append(x)


def _best(q: np.ndarray, c: np.ndarray, score: np.ndarray, keep: int) -> tuple[np.ndarray, ...]:
    """Of each q the pairs of the ``keep`` highest scores, ties by the smaller c."""
    order = np.lexsort((c, -score, q))
    q, c, score = q[order], c[order], score[order]
    begins = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    good = np.arange(len(q)) - np.repeat(begins, np.diff(np.r_[begins, len(q)])) < keep
    return q[good], c[good], score[good]


def _local_lists(batches: Iterator[pa.RecordBatch], nodes: int, kind: str, number: str, keep: int) -> Iterator[pa.RecordBatch]:
    """Phase 1 of a cell: (q, scores), the ``keep`` best scores of the pairs that are among the ``keep`` best of some node."""
    lowest = np.iinfo(np.int64).min if number == "i8" else -np.inf       # an empty place
    for ids, parts, _, tiles in _cells(batches, nodes, kind, number):
        n = len(ids)
        partial = [np.full((n, keep), lowest, number) for _ in range(nodes)]
        score, cand = (np.full((nodes, n, keep), x, np.int64) for x in (LOWEST, -1))
        filled = 0
        for c_ids, c_parts in tiles:
            for i in range(0, n, TILE_QUERIES):
                at = slice(i, min(i + TILE_QUERIES, n))
                products = [a[at] @ b.T for a, b in zip(parts, c_parts)]
                for k, p in enumerate(products):
                    # until its list is full any pair is among a query's best
                    better = np.ones(p.shape, bool) if filled < keep else p > partial[k][at].min(axis=1)[:, None]
                    r, c = np.divmod(np.flatnonzero(better), p.shape[1])
                    if not len(r):
                        continue
                    rows, begins, count = np.unique(r, return_index=True, return_counts=True)
                    slot = keep + np.arange(len(r)) - np.repeat(begins, count)
                    row = np.repeat(np.arange(len(rows)), count)
                    wide = [np.full((len(rows), keep + int(count.max())), x, kind_) for x, kind_ in ((lowest, number), (LOWEST, np.int64), (-1, np.int64))]
                    for w, had in zip(wide, (partial[k], score[k], cand[k])):
                        w[:, :keep] = had[i + rows]
                    wide[0][row, slot] = p[r, c]
                    wide[1][row, slot] = sum(x[r, c].astype(np.int64) for x in products)
                    wide[2][row, slot] = c_ids[c]
                    first = np.argpartition(wide[0], -keep, axis=1)[:, -keep:]
                    for w, had in zip(wide, (partial[k], score[k], cand[k])):
                        had[i + rows] = np.take_along_axis(w, first, 1)
            filled += len(c_ids)
        m = min(keep, filled)
        for i in range(0, n, LISTED_QUERIES):
            listed, total = (x[:, i:i + LISTED_QUERIES].transpose(1, 0, 2).reshape(-1, nodes * keep) for x in (cand, score))
            order = np.argsort(listed, axis=1)
            listed, total = np.take_along_axis(listed, order, 1), np.take_along_axis(total, order, 1)
            # a pair listed by several nodes counts once
            total[:, 1:][listed[:, 1:] == listed[:, :-1]] = LOWEST
            total[listed < 0] = LOWEST
            best = np.partition(total, -m, axis=1)[:, -m:]
            yield pa.RecordBatch.from_arrays([pa.array(ids[i:i + LISTED_QUERIES]), list_column(best.ravel(), np.full(len(best), m), pa.int64())],
                                             names=["q", "scores"])


def _sufficient(batches: Iterator[pa.RecordBatch], nodes: int, kind: str, number: str, keep: int) -> Iterator[pa.RecordBatch]:
    """Phases 2 and 3 of a cell: (q, c, score) of the pairs that reach the cutoff, the ``keep`` best of each query."""
    for ids, parts, cutoff, tiles in _cells(batches, nodes, kind, number):
        cutoff = cutoff.astype(np.int64)
        share = -(-cutoff // nodes)
        least = share.astype(number)[:, None]
        held, size = [], 0
        for c_ids, c_parts in tiles:
            for i in range(0, len(ids), TILE_QUERIES):
                at = slice(i, min(i + TILE_QUERIES, len(ids)))
                products = [a[at] @ b.T for a, b in zip(parts, c_parts)]
                entered = products[0] >= least[at]
                for p in products[1:]:
                    entered |= p >= least[at]
                r, c = np.divmod(np.flatnonzero(entered), entered.shape[1])
                q = i + r
                listed = [p[r, c].astype(np.int64) for p in products]
                seen = [x >= share[q] for x in listed]
                bound = sum(np.where(e, x, share[q]) for e, x in zip(seen, listed))
                near = bound >= cutoff[q]
                q, c = q[near], c[near]
                score = np.zeros(len(q), np.int64)
                for e, x, a, b in zip(seen, listed, parts, c_parts):
                    e = e[near]
                    score[e] += x[near][e]
                    score[~e] += np.einsum("ij,ij->i", a[q[~e]], b[c[~e]]).astype(np.int64)
                reached = score >= cutoff[q]
                held.append((q[reached], c_ids[c[reached]], score[reached]))
                size += len(held[-1][0])
                if size > HELD_PAIRS:
                    held = [_best(*map(np.concatenate, zip(*held)), keep)]
                    size = min(len(held[0][0]), HELD_PAIRS // 2)
        q, c, score = _best(*map(np.concatenate, zip(*held)), keep)
        for i in range(0, len(q), LISTED_PAIRS):
            x = slice(i, i + LISTED_PAIRS)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q[x]]), pa.array(c[x]), pa.array(score[x])], names=["q", "c", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "vec",
          nodes: int = 2, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every row that ``is_query``
    marks.  ``vec_col`` is an array of integers; ``is_query`` is an expression over ``id_col``."""
    spark = vectors.sparkSession
    rows = (vectors.select(F.col(id_col).cast("long").alias("id"), is_query.alias("asks"),
                           F.col(vec_col).cast("array<long>").alias("vec"))
            .filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda v: v.isNull()))
            .withColumn("key", F.sha2(F.array_join(F.col("vec").cast("array<string>"), ","), 256))
            .dropDuplicates(["id", "key"]))
    rows = written(rows, "topk-rows")
    members = written(rows.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id")))
                      .filter(F.col("n") <= k + 1).select("key", "id"), "topk-members")
    reps = written(rows.groupBy("key").agg(F.min("id").alias("rep"), F.first("vec").alias("vec"),
                                           F.max("asks").alias("asks")), "topk-classes")
    n, asking, width, top = reps.agg(F.count("*"), F.count_if("asks"), F.max(F.size("vec")),
                                     F.max(F.array_max(F.transform("vec", F.abs)))).first()
    if not n or not asking:
        return spark.createDataFrame([], RESULT)
    width, top = max(1, width or 0), int(top or 0)
    step = -(-width // nodes)
    number = "f4" if float(top) ** 2 * step < EXACT_SINGLE else "f8" if float(top) ** 2 * width < EXACT_FLOAT else "i8"
    kind = _kind(top)
    nqb, ncb = _grid(asking, n, min(query_block, max(1, QUERY_BYTES // (step * nodes * 4))), candidate_block,
                     CELLS_PER_CORE * spark.sparkContext.defaultParallelism)
    place = lambda m: F.pmod(F.xxhash64("key"), F.lit(m)).cast("int")
    packed = written(map_batches(reps.select("rep", "asks", place(nqb).alias("qb"), place(ncb).alias("cb"), "vec"),
                                 _packed(step * nodes, kind), "rep long, asks boolean, qb int, cb int, vec binary"), "topk-packed")
    keep = k + 1
    tasks = min(nqb * ncb, MAX_TASKS)

    def cells(queries: DataFrame) -> DataFrame:
        """Rows of ``queries`` and of all candidates by cell, the queries first."""
        def dealt(rows: DataFrame, qb: Column, cb: Column, side: int, cutoff: Column) -> DataFrame:
            return (rows.select(qb.alias("qb"), cb.alias("cb"), "rep", "vec", cutoff.alias("cutoff"))
                    .select(((F.col("qb").cast("long") * ncb + F.col("cb")) * 2 + side).alias("place"), "rep", "vec", "cutoff"))

        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        both = (dealt(queries, F.col("qb"), every(ncb), 0, F.col("cutoff"))
                .unionByName(dealt(packed, every(nqb), F.col("cb"), 1, F.lit(LOWEST))))
        return (both.repartitionById(tasks, (F.shiftright("place", 1) % tasks).cast("int"))
                .sortWithinPartitions("place"))

    asked = packed.filter("asks").select("rep", "vec", "qb")
    lists = written(map_batches(cells(asked.withColumn("cutoff", F.lit(LOWEST))),
                                lambda b: _local_lists(b, nodes, kind, number, keep), "q long, scores array<long>"), "topk-lists")
    # with fewer than k + 1 candidates nothing may go
    ranked_scores = F.sort_array(F.flatten(F.collect_list("scores")), asc=False)
    cut = lists.groupBy("q").agg(F.coalesce(F.get(ranked_scores, F.lit(keep - 1)), F.lit(LOWEST)).alias("cutoff"))
    limited = written(asked.join(cut.hint("merge"), F.col("rep") == F.col("q")).select("rep", "vec", "qb", "cutoff"), "topk-cutoffs")

    ranked = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    classes = written(map_batches(cells(limited), lambda b: _sufficient(b, nodes, kind, number, keep), "q long, c long, score long")
                      .withColumn("n", F.row_number().over(ranked)).filter(F.col("n") <= keep)
                      .select("q", "c", "score"), "topk-classes-ranked")
    by_rep = members.join(reps.select("key", "rep"), "key").select(F.col("rep").alias("c"), F.col("id").alias("vec_id"))
    # rows of the winning classes, then the k + 1 best rows per query class
    listed = (classes.hint("merge").join(by_rep, "c")
              .withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")))
              .filter(F.col("n") <= keep).select("q", "vec_id", "score"))
    asks = (rows.filter("asks").select("key", F.col("id").alias("query_id"))
            .join(reps.select("key", F.col("rep").alias("q")), "key").select("q", "query_id"))
    own = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (asks.join(listed, "q").filter("query_id <> vec_id")
            .withColumn("rank", own).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
