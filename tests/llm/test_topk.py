import math

import duckdb
import numpy as np

from motiflake.llm import topk


def brute(vectors, queries, k=5):
    """vectors: (id, components) by row; queries: row numbers."""
    out, last = [], 2**63 - 1
    for q in queries:
        own, u = vectors[q]
        scores = sorted(((sum(a * b for a, b in zip(u, v, strict=False)), -(last if i is None else i)) for n, (i, v) in enumerate(vectors) if n != q), reverse=True)[:k]
        out += [(own, r + 1, None if i == -last else -i, s) for r, (s, i) in enumerate(scores)]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()), key=str)


def test_sql_gives_the_same(spark):
    sf = "/root/testdata/sf0.01"
    with duckdb.connect() as c:
        c.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
        want = sorted(c.execute(f"select query_id, rank, vec_id, score from ({topk.SQL})").fetchall(), key=str)
    assert rows(topk.query(spark, sf)) == want and len(want) == 50


def test_ties_copies_lengths_and_many_shards(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = [(int(i), rng.integers(-3, 4, 6).tolist()) for i in rng.permutation(3000)]
    vectors += [(i, [1, 1, 1, 1, 1, 1]) for i in range(3000, 4500)] + [(4500, []), (4501, [5]), (4502, [1] * 9), (4500, [2] * 6), (None, [3] * 6), (4502, [1] * 9)]
    df = spark.createDataFrame(vectors, "vec_id long, v array<long>")
    want = brute(vectors, [n for n, (i, _) in enumerate(vectors) if i is not None and (i % 100 == 0 or i > 4499)])
    for cell, shard in ((512, 16_384), (100, 50)):
        monkeypatch.setattr(topk, "CELL_ROWS", cell)
        monkeypatch.setattr(topk, "SHARD_ROWS", shard)
        got = rows(topk.top_k(spark, df, topk.F.expr("vec_id % 100 = 0 or vec_id > 4499"), 5))
        assert got == want


def test_large_numbers_are_exact(spark):
    rng = np.random.default_rng(6)
    vectors = [(int(i), rng.integers(-(2**28), 2**28, 4).tolist()) for i in range(700)]
    got = rows(topk.top_k(spark, spark.createDataFrame(vectors, "vec_id long, v array<long>"), topk.F.expr("vec_id % 50 = 0"), 3))
    assert got == brute(vectors, range(0, 700, 50), 3)


def test_many_empty_vectors(spark):
    vectors = [(i, []) for i in range(400)] + [(1000, [1]), (1001, [-1])]
    got = rows(topk.top_k(spark, spark.createDataFrame(vectors, "vec_id long, v array<long>"), topk.F.expr("vec_id = 0 or vec_id = 1000"), 4))
    assert got == brute(vectors, [0, 400], 4)


def test_far_cells_get_no_query(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(64, 8))
    centre = 1000 * centre / np.linalg.norm(centre, axis=1, keepdims=True)
    points = np.floor(np.repeat(centre, 200, axis=0) + rng.normal(size=(12_800, 8)) * 5).astype(int)
    vectors = [(i, p.tolist()) for i, p in enumerate(points)]
    df = spark.createDataFrame(vectors, "vec_id long, v array<long>")
    index = topk.Index(spark, df)
    seeded = index.seeded(topk.F.expr("vec_id % 50 = 0"), 5)
    sent = index.routed(seeded).count()
    assert index.shards >= 16 and seeded.count() == 256 and sent < 0.25 * 256 * index.shards
    got = rows(topk.top_k(spark, df, topk.F.expr("vec_id % 1600 = 0"), 5))
    assert got == brute(vectors, range(0, 12_800, 1600))


def test_odd_vectors(spark, tmp_path):
    v = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [0.0, 1.0]), (50, [0.5, -0.001]), (1, None), (2, [1.0, None]), (3, [math.nan, 1.0]), (4, [math.inf, 1.0]), (None, [1.0, 1.0]), (5, [1.0, 2.0]), (6, [1e-3, 0.0])]
    df = spark.createDataFrame([(i, x, "a") for i, x in v], "vec_id long, embedding array<double>, shard string")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = rows(topk.query(spark, str(tmp_path)))
    ints = [(0, [256, 512]), (0, [256, 512]), (0, [0, 256]), (50, [128, -1]), (None, [256, 256]), (5, [256, 512]), (6, [0, 0])]
    assert got == brute(ints, [0, 1, 2, 3])
    with duckdb.connect() as c:
        c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
        assert sorted(c.execute(f"select query_id, rank, vec_id, score from ({topk.SQL})").fetchall(), key=str) == got
    df.limit(0).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert topk.query(spark, f"{tmp_path}/none").collect() == []


def test_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(40, 3)) * 500
    points = np.floor(np.repeat(centre, 200, axis=0) + rng.normal(size=(8000, 3)) * 5)
    tree = topk.Tree(np.arange(8000), points, 32)
    seen = 0

    class Counted(np.ndarray):
        def __matmul__(self, other):
            nonlocal seen
            seen += len(self)
            return np.asarray(self) @ other

    tree.points = tree.points.view(Counted)
    for q in points[::400]:
        bounds = np.maximum(q, 0) @ tree.hi.T + np.minimum(q, 0) @ tree.lo.T
        got = tree.search(-1, q, bounds, 5, None)
        want = sorted(((int(s), -i) for i, s in enumerate(points @ q)), reverse=True)[:5]
        assert got == [(s, -i) for s, i in want]
        assert tree.search(-1, q, bounds, 5, got[-1]) == got
    assert seen < 0.5 * 8000 * 40
