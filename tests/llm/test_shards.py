import zlib
from collections import defaultdict

from motiflake.llm import shards

from .data import ODD, documents, odd, store, texts


def check(rows, found, shard_count=16):
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in found) == sorted((i is None, i or 0, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    by = defaultdict(list)
    for r in found:
        by[r.shard].append(r)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(0 <= s < shard_count for s in by)
    assert all(sorted(x.slot for x in rs) == list(range(len(rs))) for rs in by.values())
    total, most = sum(r.size for r in found), max((r.size for r in found), default=0)
    for s in range(shard_count):
        assert abs(sum(r.size for r in by[s]) - total / shard_count) <= 2 * shards.WHOLE * total / shard_count + 2 * most


def test_shards_of_documents(spark):
    sf = "/root/testdata/sf0.01"
    found = shards.query(spark, sf).collect()
    check(texts(spark, sf), found)
    assert sorted(found) == sorted(shards.query(spark, sf).collect())


def test_odd_rows_and_empty_table(spark, tmp_path):
    check(ODD, shards.query(spark, documents(spark, tmp_path / "odd")).collect())
    assert shards.query(spark, documents(spark, tmp_path / "none", [])).collect() == []


def test_copies_of_one_text_are_cut_apart(spark, tmp_path):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(3000)]
    store(spark, tmp_path, "documents", spark.createDataFrame(rows, "doc_id long, text string"))
    found = shards.query(spark, str(tmp_path)).collect()
    check(rows, found)
    lie = {r.shard for r in found if r.text_crc32 == zlib.crc32(b"same text")}
    assert len(lie) <= 13 and max(lie) - min(lie) == len(lie) - 1


def test_rows_that_repeat_whole_are_cut_apart(spark, tmp_path):
    store(spark, tmp_path, "documents", spark.createDataFrame([(None, "the same row")] * 3200, "doc_id long, text string").repartition(3))
    found = shards.query(spark, str(tmp_path)).collect()
    check([(None, "the same row")] * 3200, found)
    n = defaultdict(int)
    for r in found:
        n[r.shard] += 1
    assert all(abs(n[s] - 200) <= 2 for s in range(16))
    assert sorted(found, key=str) == sorted(shards.query(spark, str(tmp_path)).collect(), key=str)


def test_rows_that_come_from_no_file(spark):
    docs = spark.createDataFrame([(1, "same", 5)] * 300 + [(i, f"text {i}", i) for i in range(100)], "doc_id long, text string, slot int")
    found = shards.shard(spark, docs.repartition(3).distinct().union(docs), 4).collect()
    assert len(found) == 501 and all(sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found))) for s in range(4))


def test_groups_of_equal_texts_stay_whole_where_the_tolerance_allows(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "concat('some words of text ', id % 8000) as text")
    found = shards.shard(spark, docs, 8).collect()
    where = defaultdict(set)
    for r in found:
        where[r.text].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_plan_is_native_and_exchanges_once(spark):
    plan = shards.shard(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan and "Arrow" not in plan


def test_boundaries_are_refined_until_exact(spark):
    rows = spark.range(2000).selectExpr("id as key", "id % 7 + 1 as size")
    counts = shards.Histogram(rows)
    targets = [1000.0, 4000.0, 4001.0]
    for t, (key, below, n) in zip(targets, counts.solve(targets, 0), strict=True):
        assert below == sum(i % 7 + 1 for i in range(key)) and n == key and abs(below - t) <= 4


def test_written_shards_hold_whole_rows_in_order(spark, tmp_path):
    docs = odd(spark)
    shards.write_shards(spark, docs, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    rest = [c for c in docs.columns if c not in shards.ADDED]
    key = lambda r: str([r[c] for c in rest])
    assert sorted(map(key, back.collect())) == sorted(map(key, docs.collect()))
    for f in back.inputFiles():
        slots = [r.slot for r in spark.read.parquet(f).collect()]
        assert slots == sorted(slots)


def test_many_pieces_number_rows_as_few_do(spark, monkeypatch):
    docs = spark.range(4000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same text', repeat(cast(id as string), cast(id % 50 as int))) as text")
    few = sorted(shards.shard(spark, docs, 4).collect())
    monkeypatch.setattr(shards, "PIECE_BYTES", 500)
    assert sorted(shards.shard(spark, docs, 4).collect()) == few
