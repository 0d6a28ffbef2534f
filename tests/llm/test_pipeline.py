import corpus_pipeline
from motiflake.llm import langid, packing

from . import test_packing, test_pii
from .data import SF, odd
from .test_packing import reference  # noqa: F401
from .test_simhash import brute_kept


def test_stages(spark, reference, tmp_path):  # noqa: F811
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows, out = docs.columns, {}, docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        rows[name] = out.collect()
        assert name == "packing" or out.columns == columns
    before = docs.collect()
    model = langid.fit(spark, docs)
    fine = {r.doc_id for r in langid.identify(spark, docs, model).collect() if r.lang_pred != "und" and r.score >= langid.LEAST}
    assert sorted(rows["language"]) == sorted(r for r in before if r.doc_id in fine)
    kept = rows["language"]
    stay = set(brute_kept([(r.doc_id, r.text) for r in kept]))
    assert sorted(rows["near_duplicates"]) == sorted(r for r in kept if r.doc_id in stay)
    masked = {r.doc_id: r for r in rows["personal_data"]}
    assert set(masked) == {r.doc_id for r in rows["near_duplicates"]}
    for r in rows["near_duplicates"]:
        m = masked[r.doc_id]
        assert sum(test_pii.brute(m.text)[0]) == 0 and m.n_chars == len(m.text) and (m.text == r.text or "[" in m.text)
    assert {r.doc_id for r in rows["mixture"]} <= set(masked) and all(masked[r.doc_id] == r for r in rows["mixture"])
    test_packing.check([(r.doc_id, r.text) for r in rows["mixture"]], packing.digest(out).collect(), reference)
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(rows["packing"])


def test_extra_columns_with_clashing_names(spark, tmp_path):
    wide = odd(spark).drop("n_chars").selectExpr("*", "cast(length(text) as bigint) as n_chars")
    wide.write.parquet(f"{tmp_path}/documents.parquet")
    out = wide
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert sorted(out.columns) == sorted(wide.columns)
    assert {r.doc_id for r in out.collect()} >= {8, 12} and corpus_pipeline.run(spark, str(tmp_path)).count() >= 4


def test_odd_documents_and_an_empty_table(spark, tmp_path):
    names = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "some words in a row", "en", "a", 19), (3, "some words in a row", "en", "a", 19), (None, "others without an id", None, None, 20), (4, "x" * 50_000, "en", "b", 1)]
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/odd/documents.parquet")
    assert len(corpus_pipeline.run(spark, f"{tmp_path}/odd").collect())
    spark.createDataFrame([], names).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_similar_texts_leave_one(spark, tmp_path):
    words = [f"w{i}" for i in range(400)]
    near = " ".join("new" if i % 80 == 40 else w for i, w in enumerate(words))
    rows = [(1, " ".join(words), "en", "a", 1), (2, near, "en", "a", 1), (3, "another text of other words altogether", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:3]:
        docs = stage(spark, docs, str(tmp_path))
    assert sorted({r.doc_id for r in docs.collect()}) == [1, 3]


def test_stages_are_the_five_that_were_asked_for():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "mixture", "packing"]
