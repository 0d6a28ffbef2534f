"""Rows shared by the tests: odd texts, and a way to run an operator on them."""

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000
ODD = [
    (1, None, "en", "a"),
    (2, "", None, None),
    (3, " \t\n ", "fr", ""),
    (4, "one", "en", "a"),
    (5, "one two", "en", "a"),
    (6, "the same words in this text again and again", "en", "b"),
    (7, "the same words in this text again and again", "en", "b"),
    (7, "the same words in this text again and again", "en", "b"),
    (None, "no id here but words all the same", "en", "c"),
    (8, LONG, "en", "a"),
    (9, "x" * 15_000 + "1" * 15_000, None, "b"),
    (10, "1 " * 20_000 + "a@b" + ".c" * 20_000, "de", "b"),
    (11, "Œuvre ﬁn 𝔘𝔫𝔦 \u0000 émoji 🙂   ſtop a.b@c.example.org x", "fr", "é"),
    (12, "-5 +1 (415) 555-2671 4111 1111 1111 1111, GB82 WEST 1234 5698 7654 32; ssn: 123-45-6789 10.0.0.256 10.0.0.1.2.3", "en", "z"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that operators use inside, in another type.
CLASH = ["size", "key", "code", "fp", "sig", "root", "node", "rank", "row", "src", "shard", "slot", "target", "taken", "words", "n_chars", "piece", "length", "spans", "pii", "label", "host", "path", "block", "id", "ids", "text_crc32", "media", "part", "before", "a", "b"]


def odd(spark, rows=ODD):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", *[f"array('{c}') as `{c}`" for c in CLASH])


def store(spark, tmp_path, name, df):
    df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def documents(spark, tmp_path, rows=ODD):
    return store(spark, tmp_path, "documents", odd(spark, rows))


def texts(spark, sf=SF):
    return [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
