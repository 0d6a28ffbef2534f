"""Semantics on small records, and against a window scan in plain Python."""

import random

import pytest
from pyspark.errors import PySparkException

from motiflake.functions import alphabets as a
from motiflake.operators.search import count_hits, ordered, search, search_many
from motiflake.plans.pattern import SearchQuery


def hits(spark, sequence, pattern, jobs=1, chunk_size=1_000_000, block=1_024, **options):
    df = spark.createDataFrame([("r", sequence)], "name string, sequence string")
    rows = ordered(search(df, SearchQuery(pattern, **options), jobs=jobs, chunk_size=chunk_size, block=block)).collect()
    return [(r.strand, r.start, r.end, r.matched, r.circular) for r in rows]


GOLDEN = [
    ("ATGNATGA", "ATGN", {}, [("+", 1, 4, "ATGN", False)]),
    ("ATGNATGA", "ATGN", {"ambig_mode": "query"}, [("+", 5, 8, "ATGA", False)]),
    ("AAAA", "AA", {}, [("+", 1, 2, "AA", False), ("+", 2, 3, "AA", False), ("+", 3, 4, "AA", False)]),
    ("AUGATG", "ATG", {}, [("+", 1, 3, "AUG", False), ("+", 4, 6, "ATG", False)]),
    ("A-C.A.C", "A-C", {}, [("+", 1, 3, "A-C", False)]),
    ("A-C.A.C", "A.C", {}, [("+", 5, 7, "A.C", False)]),
    ("A-C A.C", "A-C", {"ambig_mode": "query"}, [("+", 1, 3, "A-C", False), ("+", 4, 6, "A.C", False)]),
    ("NNANN", "AAAAA", {"ambig_mode": "query"}, []),
    ("NNANN", "AAAAA", {"ambig_mode": "both"}, [("+", 1, 5, "NNANN", False)]),
    ("N" * 256, "NNNN", {"ambig_mode": "query"}, []),
    ("CCCATGAAGTCCC", "ACTTCAT", {"revcomp": True}, [("-", 4, 10, "ATGAAGT", False)]),
    ("CCCAAATTT", "TTTCCC", {"circular": True}, [("+", 7, 3, "TTTCCC", True)]),
    ("ATG", "ATGAT", {"circular": True}, [("+", 1, 2, "ATGAT", True)]),
    ("CDEMA", "MAC", {"circular": True, "sequence_type": "amino-acid"}, [("+", 4, 1, "MAC", True)]),
    ("CCCAAATTT", "GGGAAA", {"ambig_mode": "query", "revcomp": True, "circular": True}, [("-", 7, 3, "TTTCCC", True)]),
    ("ACGT", "ACGT", {"revcomp": True}, [("+", 1, 4, "ACGT", False), ("-", 1, 4, "ACGT", False)]),
    ("GGAUCC", "GGATCC", {"revcomp": True}, [("+", 1, 6, "GGAUCC", False), ("-", 1, 6, "GGAUCC", False)]),
    ("AT", "ATATA", {"circular": True, "revcomp": True}, [("+", 1, 1, "ATATA", True), ("-", 2, 2, "TATAT", True)]),
    ("a c\ng t\x1c", "acgt", {}, [("+", 1, 4, "ACGT", False)]),
    ("AC", "ACGT", {}, []),
    ("", "A", {"circular": True}, []),
    ("MTEYK*", "K*", {"sequence_type": "amino-acid"}, [("+", 5, 6, "K*", False)]),
    ("ACXGT", "XGT", {"sequence_type": "amino-acid"}, [("+", 3, 5, "XGT", False)]),
]


@pytest.mark.parametrize(("sequence", "pattern", "options", "want"), GOLDEN)
def test_worked_semantics(spark, sequence, pattern, options, want):
    assert hits(spark, sequence, pattern, **options) == want


def brute(sequence, query):
    """Every window of every strand, symbol by symbol."""
    n, m, out = len(sequence), len(query.pattern), []
    sets = {s: {b for b in "ACGT" if a.IUPAC_MASKS[s] & a.IUPAC_MASKS[b]} or {"gap"} for s in a.IUPAC_MASKS}

    def match(q, t):
        if query.sequence_type == "amino-acid":
            return q == t
        if query.ambig_mode == "none":
            return q.replace("U", "T") == t.replace("U", "T")
        if query.ambig_mode == "query" and t not in "ACGTU-.":
            return False
        return bool(sets[q] & sets[t])

    patterns = [("+", query.pattern)]
    if query.revcomp:
        patterns.append(("-", "".join(a.COMPLEMENT[c] for c in reversed(query.pattern))))
    for strand, p in patterns:
        for z in range(n if query.circular else n - m + 1):
            window = "".join(sequence[(z + k) % n] for k in range(m))
            if all(map(match, p, window)):
                wraps = z + m > n
                out.append((strand, z + 1, (z + m - 1) % n + 1, window, wraps))
    return out


MODES = [{"ambig_mode": m, "circular": c, "revcomp": r} for m in ("none", "query", "both") for c in (False, True) for r in (False, True)] + [{"sequence_type": "amino-acid", "circular": c} for c in (False, True)]


@pytest.mark.parametrize("options", MODES)
def test_random_records_blocks_and_chunks(spark, options):
    rng = random.Random(str(options))
    symbols = "ACDE*-.X" if "sequence_type" in options else "ACGTACGTUNRY-."
    data = {f"r{i}": "".join(rng.choices(symbols, k=rng.randint(0, 40))) for i in range(60)}
    df = spark.createDataFrame(list(data.items()), "name string, sequence string")
    for m, splits in ((1, [(1, 10**6, 1024), (3, 7, 2)]), (3, [(1, 10**6, 1), (2, 1, 5)]), (5, [(1, 10**6, 1024), (3, 7, 2)])):
        query = SearchQuery("".join(rng.choices(symbols, k=m)), **options)
        want = sorted((n, *h) for n, s in data.items() for h in brute(s, query))
        for jobs, chunk, block in splits:
            found = search(df, query, jobs=jobs, chunk_size=chunk, block=block)
            assert sorted((r.record, r.strand, r.start, r.end, r.matched, r.circular) for r in found.collect()) == want
        counts = {(r.record, r.strand): r.n_hits for r in count_hits(df, query).collect()}
        assert all(counts[n, s] == sum(h[:2] == (n, s) for h in want) for n, s in counts)


def test_columns_names_and_extra_columns(spark):
    df = spark.createDataFrame([("same", "ACGT", 1, "x", 5), ("same", "ACGT", 2, "y", 6), ("none", None, 3, "z", 7)], "name string, sequence string, record_ord long, text string, n long")
    out = search(df, SearchQuery("CG"), keep=["record_ord", "n"])
    assert out.columns == ["record", "strand", "start", "end", "matched", "circular", "record_ord", "n"]
    assert [(r.record, r.record_ord, r.n) for r in ordered(out, "record_ord").collect()] == [("same", 1, 5), ("same", 2, 6)]
    assert search(df, SearchQuery("CG")).dtypes == [("record", "string"), ("strand", "string"), ("start", "bigint"), ("end", "bigint"), ("matched", "string"), ("circular", "boolean")]
    assert search(df.limit(0), SearchQuery("CG")).collect() == []


def test_plan_has_no_shuffle_and_reads_two_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("cast(doc_id as string) as name", "regexp_replace(text, '[^ACGT]', '') as sequence", "source")
    plan = search(docs, SearchQuery("ACG", revcomp=True))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Python" not in plan


@pytest.mark.parametrize(
    ("sequence", "options", "message"),
    [
        ("ATX", {}, "Unsupported nucleotide symbol 'X' at position 3"),
        ("ATX", {"ambig_mode": "query"}, "Unsupported IUPAC nucleotide target symbol 'X' at position 3"),
        ("A!", {"ambig_mode": "both"}, "Unsupported IUPAC nucleotide symbol '!' at position 2"),
        ("MT1", {"sequence_type": "amino-acid"}, "Unsupported amino-acid symbol '1' at position 3"),
    ],
)
def test_invalid_records_fail_even_if_too_short(spark, sequence, options, message):
    with pytest.raises(PySparkException, match=message):
        hits(spark, sequence, "ACGTACGT", **options)


@pytest.mark.parametrize(
    ("options", "message"),
    [
        ({"pattern": " "}, "Pattern must not be empty"),
        ({"pattern": "ATX"}, "Unsupported nucleotide symbol 'X' at position 3"),
        ({"pattern": "ATX", "ambig": True}, "Unsupported IUPAC nucleotide query symbol 'X' at position 3"),
        ({"pattern": "A", "ambig": True, "ambig_mode": "both"}, "cannot be combined"),
        ({"pattern": "M", "sequence_type": "amino-acid", "ambig": True}, "only valid for nucleotide"),
        ({"pattern": "M", "sequence_type": "amino-acid", "revcomp": True}, "only valid for nucleotide"),
        ({"pattern": "A", "sequence_type": "rna"}, "Unsupported sequence type"),
        ({"pattern": "A", "ambig_mode": "target"}, "Unsupported ambiguity mode"),
    ],
)
def test_bad_queries(options, message):
    with pytest.raises(ValueError, match=message):
        SearchQuery(**options)


def test_bad_job_options(spark):
    df = spark.createDataFrame([("r", "A")], "name string, sequence string")
    for bad in ({"jobs": 0}, {"chunk_size": 0}):
        with pytest.raises(ValueError, match="at least 1"):
            search(df, SearchQuery("A"), **bad)


def test_query_is_normalised_and_alias_resolves():
    q = SearchQuery("a t\ng", ambig=True)
    assert (q.pattern, q.ambig_mode, q.ambig) == ("ATG", "query", True) and SearchQuery("A", ambig_mode="both").ambig


def test_reverse_complement_names_the_last_bad_symbol():
    assert a.reverse_complemented("ARYN-.") == ".-NRYT"
    with pytest.raises(ValueError, match="symbol 'Z' in reverse-complement pattern"):
        a.reverse_complemented("XAZ")


def test_many_patterns(spark):
    df = spark.createDataFrame([("r", "ACGTN")], "name string, sequence string")
    found = search_many(df, [SearchQuery("CG"), SearchQuery("TA", ambig_mode="both")]).collect()
    assert sorted((r.pattern, r.start) for r in found) == [("CG", 2), ("TA", 4)]


def test_table_function(spark):
    from motiflake.functions.udtf import register

    register(spark)
    spark.createDataFrame([("r", "ACGTACG")], "name string, s string").createOrReplaceTempView("seqs")
    got = spark.sql("SELECT name, h.* FROM seqs, LATERAL search_hits(s, 'ACG', 'none') h").collect()
    assert sorted((r.name, r.start, r.matched) for r in got) == [("r", 1, "ACG"), ("r", 5, "ACG")]


def test_stream(spark, tmp_path):
    from motiflake.streaming.search import search_stream, stream_records

    spark.createDataFrame([("a", "ACGT"), ("b", "CGCG")], "name string, s string").write.parquet(f"{tmp_path}/in")
    stream = search_stream(stream_records(spark, f"{tmp_path}/in", "name", "s", "name string, s string"), SearchQuery("CG"))
    q = stream.writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.record, r.start) for r in spark.table("found").collect()) == [("a", 2), ("b", 1), ("b", 3)]
