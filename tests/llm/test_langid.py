import itertools
import zlib

import numpy as np

from motiflake.llm import langid

from .data import ODD, documents


def test_held_out_accuracy_and_no_leak(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    found = langid.query(spark, sf).collect()
    assert sorted(r.doc_id for r in found) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in found)
    out = [r for r in found if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) / len(out) > 0.97
    # Labels of held-out documents change nothing.
    other = docs.selectExpr("doc_id", "text", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 'xx', lang) as lang")
    model = langid.fit(spark, other)
    assert "xx" not in model.langs
    again = langid.identify(spark, docs, model).select("doc_id", "lang_pred", "score").collect()
    assert sorted(map(tuple, again)) == sorted((r.doc_id, r.lang_pred, r.score) for r in found)


def test_odd_rows_and_empty_tables(spark, tmp_path):
    found = {(r.doc_id, r.lang_pred, r.score) for r in langid.query(spark, documents(spark, tmp_path / "odd")).collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)} <= found and {x for _, x, _ in found} <= {"und", "en", "de", "fr"}
    assert langid.query(spark, documents(spark, tmp_path / "none", [])).collect() == []
    unlabelled = [(i, t, None, s) for i, t, _, s in ODD]
    assert {r.lang_pred for r in langid.query(spark, documents(spark, tmp_path / "bare", unlabelled)).collect()} == {"und"}


def best_path(scores, switch):
    n = scores.shape[1]
    paths = itertools.product(range(n), repeat=len(scores))
    return max(sum(scores[t, a] for t, a in enumerate(p)) - switch * sum(a != b for a, b in itertools.pairwise(p)) for p in paths)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    lengths = np.array([0, 5, 1, 6, 0, 3])
    scores = rng.normal(size=(lengths.sum(), 3)) * 3
    labels = langid.viterbi(scores, lengths, 1.5)
    at = 0
    for n in lengths:
        s, p = scores[at : at + n], labels[at : at + n]
        if n:
            value = sum(s[t, a] for t, a in enumerate(p)) - 1.5 * sum(a != b for a, b in itertools.pairwise(p))
            assert abs(value - best_path(s, 1.5)) < 1e-9
        at += n


def test_long_texts_are_labelled_in_blocks_as_in_one(spark):
    model = langid.fit(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    text = "\n".join(texts) + " привет ःः \n" + " ".join(texts[:5])
    (whole,) = langid._label(model, [text])
    assert len(set(whole[0].tolist())) > 1
    for block in (40, 5_000, 100_000):
        cut = langid._label_long(model, langid.features(text), block)
        assert all((a == b).all() for a, b in zip(whole, cut, strict=True))


def test_a_text_of_millions_of_characters(spark, tmp_path):
    rows = [(i, f"the words of text {i} are english", "en", "a") for i in range(9)] + [(i, f"die wörter im text {i} sind deutsch", "de", "a") for i in range(9, 18)]
    rows.append((100, "die wörter sind deutsch " * 150_000, None, "a"))
    found = {r.doc_id: r for r in langid.query(spark, documents(spark, tmp_path, rows)).collect()}
    assert found[100].lang_pred == "de" and found[100].score > 0.99


def test_marks_alone_are_no_letters(spark):
    for text in ("ःः ा", "\u0301", "١٢ ৎ৷"[:2], "़"):
        assert not len(langid.features(text)[0])
    bucket, starts, begin, _ = langid.features("ा कि ः x")
    assert begin.tolist() == [2, 7] and len(bucket) == 3
    model = langid.fit(spark, spark.createDataFrame([(i, "हिन्दी में शब्द", "hi") for i in range(30)], "doc_id long, text string, lang string"))
    by = {r.doc_id: r for r in langid.identify(spark, spark.createDataFrame([(1, "ःः ा"), (2, "शब्द")], "doc_id long, text string"), model).collect()}
    assert (by[1].lang_pred, by[1].score) == ("und", 0) and (by[2].lang_pred, by[2].score) == ("hi", 1)


def test_junk_labels_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "LABELS", 3)
    rows = [(i, "some words", f"l{i % 50:02}") for i in range(300)] + [(1000 + i, "more words", f"l{i % 2 + 7:02}") for i in range(30)]
    model = langid.fit(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 3 and {"l07", "l08"} <= set(model.langs)


def test_predictions_are_the_best_path_of_the_counts(spark):
    """A model of two languages, recounted from the sample with plain Python: the spans of short texts by all paths."""
    from collections import Counter

    rows = [(i, t, lang) for i, (t, lang) in enumerate([("aba baab ab", "x"), ("cdc dccd cd ab", "y")] * 30)]
    model = langid.fit(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"))

    def grams(word):
        w = f" {word} "
        out = []
        for i in range(len(word)):
            h = (ord(w[i]) * 0x9E3779B1 ^ ord(w[i + 1]) * 0x85EBCA6B ^ ord(w[i + 2]) * 0xC2B2AE35) % 2**32
            out.append(((h ^ h >> 15) * 0x2C1B3C6D) % 2**32 >> 16)
        return out

    counts = {lang: Counter(g for i, t, x in rows if x == lang and zlib.crc32(str(i).encode()) % 3 != 1 for w in t.split() for g in grams(w)) for lang in "xy"}
    score = {lang: lambda w, n=n: sum(np.log((n[g] + 0.5) / (n.total() + 0.5 * langid.BUCKETS)) for g in grams(w)) for lang, n in counts.items()}
    texts = ["ab ab cd", "cd", "ab baab dccd cdc cd ab", "aba " * 4 + "cdc " * 4, "ba dc ba dc"]
    got = langid.identify(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in got:
        words = texts[r.doc_id].split()
        value = lambda p: sum(score[a](w) for a, w in zip(p, words, strict=True)) - langid.SWITCH * sum(a != b for a, b in itertools.pairwise(p))  # noqa: E731, B023
        best = max(itertools.product("xy", repeat=len(words)), key=value)
        share = Counter()
        for lang, w in zip(best, words, strict=True):
            share[lang] += len(w)
        assert (r.lang_pred, round(r.score, 9)) == (share.most_common(1)[0][0], round(share.most_common(1)[0][1] / share.total(), 9))
        assert [s.lang for s in r.lang_spans] == [a for a, _ in itertools.groupby(best)]


def test_spans_of_mixed_text_and_scripts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(spark, docs)
    text = {r.lang: r.text[:600] for r in docs.filter("length(text) > 700").dropDuplicates(["lang"]).collect()}
    rows = [(1, text["en"] + "\n" + text["de"]), (2, "Привет мир"), (3, "123 ... 456")]
    by = {r.doc_id: r for r in langid.identify(spark, spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [s.lang for s in by[1].lang_spans] == ["en", "de"] and abs(by[1].lang_spans[1].start - len(text["en"])) < 40 and 0.4 < by[1].score < 0.7
    assert by[2].lang_pred in model.langs and by[2].score == 0 and (by[3].lang_pred, by[3].score) == ("und", 0)


def test_script_narrows_candidates(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("привет мир это слова", "ru"), ("hello world these are words", "en")] * 40)]
    model = langid.fit(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    latin, cyrillic = langid.NAMES.index("Latin"), langid.NAMES.index("Cyrillic")
    assert model.langs == ["en", "ru"] and model.scripts[latin].tolist() == [True, False] and model.scripts[cyrillic].tolist() == [False, True]


def test_accepted_keeps_clean_rows_and_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(spark, docs)
    extra = docs.unionByName(spark.createDataFrame([(10**6, None, None, None, 0), (10**6 + 1, "12 34", "en", "a", 5)], docs.schema))
    kept = langid.accepted(spark, extra, model)
    assert kept.columns == docs.columns and sorted(kept.collect()) == sorted(docs.collect())
