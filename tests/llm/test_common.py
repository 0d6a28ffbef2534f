from pyspark.sql import functions as F

from motiflake.llm import common


def test_ranks_and_pieces(spark):
    rows = [(i * 7919 % 500 // 3, f"é{i % 5}", i) for i in range(2000)]
    df = spark.createDataFrame(rows, "a long, b string, c long")
    ranks = common.ranked(spark, df, ["a", "b", "c"])
    got = {(r.a, r.b, r.c): r["rank"] for r in ranks.collect()}
    assert got == {r: i for i, r in enumerate(sorted(rows))}
    for pieces in (1, 2, 7, 64, 5000):
        cuts = common.splitters(ranks, ["a", "b", "c"], len(rows), pieces)
        assert len(cuts) < max(2, pieces)
        placed = df.withColumn("piece", common.piece_of([F.col(c) for c in "abc"], ["long", "string", "long"], cuts)).collect()
        assert all(r.piece == sum(c <= (r.a, r.b, r.c) for c in cuts) for r in placed)


def test_no_rows(spark):
    df = spark.createDataFrame([], "a long")
    ranks = common.ranked(spark, df, ["a"])
    assert ranks.collect() == [] and common.splitters(ranks, ["a"], 0, 4) == []
