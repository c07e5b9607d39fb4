"""Centroid clustering by an incremental distance matrix.

Vectors have integer components, and every vector row carries its exact dot
products with all centroids.  Squared distances are |x|^2 - 2 x.c + |c|^2, so a
round needs no new distance matrix: when centroid j moves by d, the dot product
x.c_j grows by the sum of x_i d_i over the components i with d_i <> 0, and the
nearest centroid is read off the updated row.  The rows are persisted once a
round in the shared folder, in two tables that take turns, so a lost executor
re-reads one round and the disk holds two at most.

The sums behind the centroids are kept up in the same way: a round adds the
vectors that changed their cluster and takes them off the one they left.  Only
k x dims sums, k counts and the centroids themselves pass through the driver.
A round in which no centroid moved is the last: those after it change nothing.

Defined results: a vector that is null, of another length, or holds a null or a
non-finite component takes no part; a row with a null id takes part but starts
no centroid; repeated rows are vectors of their own; equal seeds leave the later
centroid empty, and an empty centroid stays where it is; with fewer than k
vectors that have an id every one of them is a seed; without any, and for an
empty table, the result is empty.  Sums and distances are exact in 64 bits; a
vector with a component beyond ``LARGEST`` would break that and stops the job
with an error.  Only the id and vector columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import list_column, map_batches, table_path

LARGEST = 1 << 26
STATE = "id long, x array<int>, norm long, dots array<long>, cluster int, before int, distance long, moved boolean"


def integer_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, x): floor(scale * component) of the vectors with ``dims`` finite components."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    # the size is tested first, so that forall never meets a null array
    return (vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"), F.when(v.isNotNull() & (F.size(v) == dims), whole).alias("ok"))
            .filter(F.coalesce("ok", F.lit(False)))
            .select("id", F.transform("v", lambda c: F.floor(c * scale).cast("long")).alias("x")))


def seeds(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The vectors of the k smallest sha256 of ``<salt>:<id>`` (ties: smaller id, smaller vector)."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    got = rows.filter("id is not null").select("id", "x", digest.alias("h")).orderBy("h", "id", "x").limit(k).collect()
    return np.array([r.x for r in got], np.int64)


def _table(x: pa.Array, dims: int) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(x), dims)


def _state(ids: pa.Array, x: pa.Array, norm: np.ndarray, dots: np.ndarray, before: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    distance = norm[:, None] - 2 * dots + sizes[None, :]
    cluster = distance.argmin(axis=1)  # the first of equals, so ties go to the smaller number
    return pa.RecordBatch.from_arrays(
        [ids, x, pa.array(norm), list_column(dots.ravel(), np.full(len(dots), dots.shape[1]), pa.int64()),
         pa.array(cluster.astype(np.int32)), pa.array(before.astype(np.int32)),
         pa.array(distance[np.arange(len(dots)), cluster]), pa.array(cluster != before)],
        names=["id", "x", "norm", "dots", "cluster", "before", "distance", "moved"])


def first_products(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The rows with their products with all centroids: the only full multiplication."""
    dims, sizes = centroids.shape[1], (centroids * centroids).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _table(b.column(1), dims)
            if ((x > LARGEST) | (x < -LARGEST)).any():
                raise OverflowError(f"a component exceeds {LARGEST}: 64 bits do not hold exact distances")
            yield _state(b.column(0), b.column(1).cast(pa.list_(pa.int32())), (x * x).sum(axis=1), x @ centroids.T,
                         np.full(len(x), -1), sizes)

    return map_batches(rows, run, STATE)


def updated_products(state: DataFrame, step: np.ndarray, centroids: np.ndarray) -> DataFrame:
    """The state after the centroids moved by ``step`` to ``centroids``: products change by the
    components of each step that are not 0."""
    dims, sizes = centroids.shape[1], (centroids * centroids).sum(axis=1)
    changes = [(j, np.flatnonzero(d), d[d != 0]) for j, d in enumerate(step) if d.any()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, dots = _table(b.column(1), dims), _table(b.column(3), len(sizes)).copy()
            for j, at, by in changes:
                dots[:, j] += x[:, at] @ by
            yield _state(b.column(0), b.column(1), b.column(2).to_numpy(), dots, b.column(4).to_numpy(), sizes)

    return map_batches(state, run, STATE)


def moved_sums(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """What the last round's moves add to the sums (k x dims) and counts (k) of the clusters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for b in batches:
            x, to, left = _table(b.column(0), dims), b.column(1).to_numpy(), b.column(2).to_numpy()
            for j in range(k):
                come, gone = to == j, left == j
                total[j] += x[come].sum(axis=0) - x[gone].sum(axis=0)
                n[j] += come.sum() - gone.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(n),
                                          list_column(total.ravel(), np.full(k, dims), pa.int64())], names=["cluster", "n", "total"])

    parts = map_batches(state.filter("moved").select("x", "cluster", "before"), run, "cluster int, n long, total array<long>")
    got = (parts.select("cluster", F.posexplode(F.concat(F.array("n"), "total")).alias("at", "v"))
           .groupBy("cluster", "at").agg(F.sum("v").alias("v")).collect())
    total, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
    for r in got:
        if r["at"]:
            total[r["cluster"], r["at"] - 1] = r["v"]
        else:
            n[r["cluster"]] = r["v"]
    return total, n


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3",
            id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance), centroids) after ``rounds`` rounds and a last assignment."""
    spark = vectors.sparkSession
    turns = [table_path(spark, f"clusters-{side}") for side in "ab"]

    def keep(df: DataFrame, side: int) -> DataFrame:
        df.write.mode("overwrite").parquet(turns[side])
        return spark.read.schema(STATE).parquet(turns[side])

    rows = integer_vectors(vectors, dims, scale, id_col, vec_col)
    centroids = seeds(rows, k, salt)
    k = len(centroids)
    if not k:
        return spark.createDataFrame([], "id long, cluster int, distance long"), centroids
    state = keep(first_products(rows, centroids), 0)
    total, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
    for turn in range(1, rounds + 1):
        more, many = moved_sums(state, k, dims)
        total, n = total + more, n + many
        # integer division of NumPy is the exact floor
        new = np.where(n[:, None] > 0, total // np.maximum(n, 1)[:, None], centroids)
        step, centroids = new - centroids, new
        if not step.any():
            break
        state = keep(updated_products(state, step, centroids), turn % 2)
    return state.select("id", "cluster", "distance"), centroids


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster_report(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", **options) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    assigned, centroids = cluster(vectors, id_col=id_col, vec_col=vec_col, **options)
    spark = vectors.sparkSession
    spread = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    # one row for each of the k centroids
    facts = spark.createDataFrame([(j, spread.get(j, 0), sum(spread.values()), centroid_digest(c)) for j, c in enumerate(centroids)],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.withColumnRenamed("id", id_col).join(F.broadcast(facts), "cluster").select(
        id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
