"""Shards by median splits: queries meet only shards that may hold better vectors."""

import numpy as np

from folioflow.llm import topk
from folioflow.llm._work import temporary


def brute(rows, k=5, step=50):
    q = {(i, tuple(np.floor(256 * np.asarray(v, "f4").astype(float)).astype(int))) for i, v in rows if i % step == 0}
    every = [(i, np.floor(256 * np.asarray(v, "f4").astype(float)).astype(np.int64)) for i, v in rows]
    out = []
    for own, query in q:
        scores = sorted((-int(np.dot(v, query)), i) for i, v in every if i != own and len(v) == len(query))[:k]
        out += [(own, rank + 1, i, -s) for rank, (s, i) in enumerate(scores)]
    return sorted(out)


def test_clustered_vectors_meet_few_shards(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(20, 6)) * 20
    rows = [(i, (centres[i % 20] + rng.normal(size=6)).tolist()) for i in range(4000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    met = []
    with temporary(spark):
        got = sorted(map(tuple, topk.top_k(table, shard_rows=100, rounds=(2, 8), meetings=met).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == brute(rows)
    assert met[1] == 80 * 39 or met[1] > 80 * 30
    assert sum(met[0]) < met[1] / 4


def test_equal_and_mixed_vectors_over_many_shards(spark):
    rng = np.random.default_rng(10)
    rows = [(i, [1.0, -1.0, 0.5]) for i in range(900)] + [(1000 + i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(600)]
    rows += [(2000 + i, rng.normal(size=2).tolist()) for i in range(150)] + [(3000 + i, []) for i in range(120)] + [(4000, [9.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    for options in ({}, {"box_bytes": 100, "rounds": (1,), "block": 3, "sample": 200}):
        with temporary(spark):
            got = sorted(map(tuple, topk.top_k(table, shard_rows=60, **options).select("query_id", "rank", "vec_id", "score").collect()))
        assert got == brute(rows)


def test_top_tree_deals_every_vector_to_one_leaf():
    rng = np.random.default_rng(11)
    points = np.concatenate([rng.integers(-9, 9, (500, 4)), np.zeros((400, 4), np.int64)])
    top = topk.Top.build(points, 16)
    leaf = top.leaves(points)
    assert len(np.unique(leaf)) == 16 and leaf.max() == 15
    assert np.bincount(leaf).max() <= 500
    assert topk.Top.build(np.zeros((50, 3), np.int64), 8).leaves(points[:, :3]).max() == 0
