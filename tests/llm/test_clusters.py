"""Centroid clustering against plain rounds over Python integers."""

import hashlib
import math

import numpy as np
import pytest

from leadlens.llm import clusters

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance string, x string, id string, inertia string"


def plain_rounds(rows, k, rounds, dims, scale, salt):
    kept = [(i, [math.floor(float(np.float32(c)) * scale) for c in v]) for i, v in rows
            if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted((hashlib.sha256(f"{salt}:{i}".encode()).hexdigest(), i, v) for i, v in kept if i is not None)[:k]
    centers = [list(v) for _, _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for j in range(len(centers)):
            mine = [v for (_, v), a in zip(kept, at) if a == j]
            if mine:
                centers[j] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [(i, *nearest(v)) for i, v in kept] if centers else []
    inertia = [sum(d for _, d, a in last if a == j) for j in range(len(centers))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted((str(i), a, d, inertia[a], sum(inertia), names[a]) for i, d, a in last)


def report(spark, rows, **options):
    table = spark.createDataFrame([(i, v, *["clash"] * 5) for i, v in rows], SCHEMA)
    got = clusters.cluster_report(table, **options)
    assert got.columns[:6] == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got.collect())


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_rounds_match_plain_ones(spark, rounds):
    rng = np.random.default_rng(5)
    middle = rng.normal(0, 1, (5, 6))
    rows = [(i, (middle[i % 5] + rng.normal(0, 0.6, 6)).tolist()) for i in range(240)]
    rows += [(500 + i, rows[3][1]) for i in range(150)]                       # one very common vector
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1])]            # repeated rows and ids, no id
    rows += [(900, None), (901, []), (902, [1.0] * 5), (903, [1.0] * 7), (904, [1.0, None, 0.0, 0.0, 0.0, 0.0]),
             (905, [float("nan")] * 6), (906, [float("-inf")] + [0.0] * 5)]
    options = {"k": 4, "rounds": rounds, "dims": 6, "scale": 64, "salt": "s"}
    assert report(spark, rows, **options) == plain_rounds(rows, **options)


def test_ties_equal_seeds_and_few_vectors(spark):
    options = {"k": 4, "rounds": 3, "dims": 2, "scale": 1, "salt": "3"}
    for rows in ([(i, [float(i % 2), 0.0]) for i in range(12)], [(i, [5.0, 5.0]) for i in range(9)], [(1, [1.0, 2.0]), (2, [3.0, 4.0])],
                 [(i, [float(-i), float(i)]) for i in range(7)]):
        assert report(spark, rows, **options) == plain_rounds(rows, **options)


def test_without_vectors_and_with_huge_ones(spark):
    assert report(spark, [], dims=2) == []
    assert report(spark, [(1, None), (2, [1.0])], dims=2) == []
    assert report(spark, [(None, [1.0, 2.0])], dims=2) == []
    for huge in (1e30, -1e30, 1e9):
        with pytest.raises(Exception, match="64 bits"):
            report(spark, [(1, [huge, 0.0])], dims=2)


def test_products_follow_the_steps(spark):
    """The products kept up by steps equal fresh ones, and a step of zeros keeps every row."""
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, rng.integers(-90, 90, 8).tolist()) for i in range(50)], "id long, x array<long>")
    a = rng.integers(-50, 50, (3, 8))
    step = np.where(rng.random((3, 8)) < 0.3, rng.integers(-9, 9, (3, 8)), 0)
    b = a + step
    state = clusters.first_products(rows, a)
    stepped = {r.id: r for r in clusters.updated_products(state, step, b).collect()}
    for r in clusters.first_products(rows, b).collect():
        assert (r.dots, r.cluster, r.distance) == (stepped[r.id].dots, stepped[r.id].cluster, stepped[r.id].distance)
    assert not any(r.moved for r in clusters.updated_products(state, step * 0, a).collect())
