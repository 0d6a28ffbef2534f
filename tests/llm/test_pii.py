import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from motiflake.llm import pii

from .data import ODD, SF, documents, texts


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


RULES = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
)


def brute(text):
    spans = [[(k, m.start(), m.end()) for m in re.finditer(p, text or "") if ok(m[0])] for k, p, ok in RULES]
    return [len(x) for x in spans], ",".join(f"{k}:{a}:{b}" for x in spans for k, a, b in x)


def check(rows, found):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in found)
    want = []
    for i, t, *_ in rows:
        n, s = brute(t)
        want.append((i if i is not None else -1, *n, hashlib.sha256(s.encode()).hexdigest()))
    assert got == sorted(want)


def test_all_documents_match_plain_regular_expressions(spark):
    rows = texts(spark, "/root/testdata/sf0.01")
    found = pii.query(spark, "/root/testdata/sf0.01").collect()
    check(rows, found)
    assert sum(r.n_card for r in found) and sum(r.n_phone for r in found)


def test_odd_rows(spark, tmp_path):
    found = pii.query(spark, documents(spark, tmp_path)).collect()
    check(ODD, found)
    spans = {r.doc_id: r.spans for r in found}
    assert "iban:" in spans[12] and "ssn:" in spans[12] and spans[2] == ""


def test_empty_table(spark, tmp_path):
    assert pii.query(spark, documents(spark, tmp_path, [])).collect() == []


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="a@.1 -+()9_é\n2", max_size=60), min_size=40, max_size=40))
def test_random_texts(spark, lines):
    extra = [re.sub("9", "4111 1111 1111 1111", x) + re.sub("a", "1.2.3.4", x) for x in lines]
    rows = [(i, t) for i, t in enumerate(lines + extra)]
    check(rows, pii.digest(pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string"))).collect())


def test_mask_leaves_no_base_span_and_the_rest_as_it_is(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    was = {r.doc_id: r.text for r in docs.collect()}
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    spans = {r.doc_id: r.pii for r in pii.find_spans(docs).collect()}
    for i, t in was.items():
        want, at = "", 0
        for s in sorted(spans[i], key=lambda s: (s.start, -s.end)):
            if s.start >= at:
                want += t[at : s.start] + f"[{s.kind.upper()}]"
            at = max(at, s.end)
        assert masked[i] == want + t[at:]
        assert sum(brute(masked[i])[0]) == 0


@pytest.mark.parametrize(("text", "kinds"), [("DE89 3704 0044 0532 0130 00", ["iban"]), ("DE89 3704 0044 0532 0130 01", []), ("123-45-6789", []), ("SSN 123-45-6789", ["ssn"]), ("ssn 000-45-6789", []), ("bank DE89 3704 0044 0532 0130 00", ["iban"]), ("born 2001-02-28", ["born"]), ("on 2001-02-28", []), ("date of birth: 31.12.1999", ["born"]), ("date of birth: 31.13.1999", []), ("born 2001-31-02", []), ("commit build of birth 2001-02-28", [])])
def test_added_kinds(spark, text, kinds):
    r = pii.find_spans(spark.createDataFrame([(text,)], "text string")).first()
    assert [s.kind for s in r.pii] == kinds


def test_context_raises_the_score(spark):
    near, far = (pii.find_spans(spark.createDataFrame([(t,)], "text string")).first().pii[0].score for t in ("visa 4111111111111111", "zzz 4111111111111111"))
    assert near > far >= pii.ACCEPT


def test_context_decides_both_ways(spark):
    """The same numbers: words near them accept or reject an added kind, and never take a base span away."""
    cases = [("DE89370400440532013000", 1), ("order DE89370400440532013000", 0), ("iban DE89370400440532013000 serial", 1), ("ssn 123-45-6789", 1), ("123-45-6789", 0), ("born 1.2.1990", 1), ("born 1.2.1990, version", 0), ("1.2.1990", 0), ("build 10.0.0.1", 1), ("order +49 30 1234567", 1), ("invoice 4111111111111111", 1)]
    rows = [(i, t) for i, (t, _) in enumerate(cases)]
    found = {r.doc_id: r for r in pii.digest(pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for i, (t, n) in enumerate(cases):
        assert len([x for x in found[i].spans.split(",") if x]) == n == len([x for x in found[i].scores.split(",") if x]), t
    assert float(found[8].scores) < 0.5 <= float(found[0].scores) and float(found[2].scores) < 1


def test_a_score_for_every_span(spark):
    for r in pii.query(spark, SF).collect():
        assert r.spans.count(",") == r.scores.count(",") and bool(r.spans) == bool(r.scores)
