import pytest

from motiflake.plans import catalog

from .compare import TABLES, same

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_gives_what_its_sql_gives(spark, name):
    n = same(catalog.queries()[name](spark, SF), catalog.oracle_sql()[name], SF)
    assert n > 0


def test_every_query_has_sql():
    assert catalog.queries().keys() == catalog.oracle_sql().keys()


def test_places_count_symbols_whose_upper_case_is_longer(spark, tmp_path):
    texts = ["CHßE", "aßa", "acﬁx", "gŉx", "tᾳx", "ᾈx", "cᾲ", "ẞ a", "ſ acgt Q", "a cß\x85e", "", None, "acgt", "ßßß", "🙂ß"]
    for t in TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet") if t != "documents" else None
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "rows"))
    next((tmp_path / "rows").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    assert same(catalog.queries()["validate_first_bad"](spark, str(tmp_path)), catalog.oracle_sql()["validate_first_bad"], str(tmp_path)) == len(texts)
