import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from motiflake.llm import packing

from .data import ODD, documents, texts


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(packing.default_vocabulary())
    return lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 2]


def check(rows, found, reference):
    by = defaultdict(list)
    for r in found:
        by[r.doc_id].append(r)
    want = defaultdict(list)
    for i, t, *_ in rows:
        want[i].append(reference(t))
    assert set(by) == set(want)
    for i, docs in want.items():
        got = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by[i])
        pieces = []
        for ids in docs:
            first = len(ids) % 1024 or 1024
            cuts = [0, *range(first, len(ids), 1024), len(ids)]
            pieces += [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        assert got == sorted(pieces)
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 1024
    return len(bins)


def test_documents(spark, reference):
    sf = "/root/testdata/sf0.01"
    found = packing.query(spark, sf).collect()
    bins = check(texts(spark, sf), found, reference)
    assert bins <= 1.02 * sum(r.length for r in found) / 1024 + 1
    assert sorted(found) == sorted(packing.query(spark, sf).collect())


def test_odd_rows_and_empty_table(spark, tmp_path, reference):
    rows = [*ODD, (50, "a <|endoftext|> b", None, None)]
    check(rows, packing.query(spark, documents(spark, tmp_path / "odd", rows)).collect(), reference)
    assert packing.query(spark, documents(spark, tmp_path / "none", [])).collect() == []


def test_long_runs_have_the_ids_of_the_library(spark, reference):
    rows = [(i, t) for i, t in enumerate(x * n for x in (" ", "\n", "=", "x", "\u3000") for n in (9_999, 10_000, 1_000_000))]
    rows += [(100 + i, f"a{w}{z}") for i, (w, z) in enumerate((w, z) for w in (" " * 1_000_000, "\n " * 5_500 + "\t", " " * 10_000 + "\x1c" + " " * 20_000) for z in ("", "b", "1", "=", "'s"))]
    found = packing.pack(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    check(rows, packing.digest(found).collect(), reference)


@pytest.mark.parametrize("millions", [5, 20])
def test_runs_of_many_millions(millions):
    encode = packing.tokenizer(packing.default_vocabulary())
    n = millions * 1_000_000
    (space,) = encode(" ")
    a, b = encode("a"), encode(" b")
    ids = encode("a" + " " * n + "b")
    assert len(ids) == n + 1 and ids[0] == a[0] and ids[-1] == b[0] and (ids[1:-1] == space).all()  # no token is two blanks
    unit = encode("=" * 64)
    assert len(unit) == 1 and set(encode("=" * n).tolist()) <= {unit[0], *encode("=" * (n % 64)).tolist()}


def test_a_model_that_ranks_do_not_express_goes_through_the_library(tmp_path):
    import json

    with open(packing.default_vocabulary(), encoding="utf-8") as f:
        model = json.load(f)
    assert packing._same_as_ranks(model)
    assert not packing._same_as_ranks(model | {"normalizer": {"type": "Lowercase"}})
    assert not packing._same_as_ranks(model | {"model": model["model"] | {"merges": model["model"]["merges"][::-1]}})
    path = tmp_path / "lower.json"
    path.write_text(json.dumps(model | {"normalizer": {"type": "Lowercase"}}))
    t = Tokenizer.from_file(str(path))
    assert packing.tokenizer(str(path))("Some TEXT").tolist() == t.encode("Some TEXT", add_special_tokens=False).ids


def test_bins_close_in_the_registered_query(spark):
    """The query's packers, replayed: bins close, few sequences are lost to that."""
    sf = "/root/testdata/sf0.1"
    found = packing.query(spark, sf).collect()
    total = sum(r.length for r in found)
    bins = len({r.sequence_id for r in found})
    assert len({r.sequence_id >> 40 for r in found}) == 1 and bins <= 1.003 * total / 1024
    lengths = np.array([r.length for r in found])
    packer = packing.Packer()
    for at in range(0, len(lengths), packing.AHEAD):
        for n in sorted(lengths[at : at + packing.AHEAD].tolist(), reverse=True):
            packer.add(n)
    assert packer.made == bins and packer.closed > 100 and packer.open <= packing.OPEN


def test_rows_that_repeat_whole_spread_over_packers(spark, reference):
    rows = [(None, "the same row")] * 400 + [(i, f"row {i}") for i in range(50)]
    parts = packing.digest(packing.pieces(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    found = packing.packed(spark, parts, 4, 64, 2, 8).collect()
    assert len(found) == 450 and len({r.sequence_id >> 40 for r in found if r.doc_id is None}) > 1


def test_sequences_hold_every_token_in_its_place(spark, reference):
    rows = [(i, " ".join(f"w{j}" for j in range(i * 7 % 900))) for i in range(120)]
    placed = packing.pack(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    tokens = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packing.sequences(placed).collect()}
    assert max(map(len, tokens.values())) <= 1024
    found = placed.collect()
    assert sum(map(len, tokens.values())) == sum(r.length for r in found)
    want = {i: reference(t) for i, t in rows}
    for r in found:
        assert tokens[r.sequence_id][r.offset : r.offset + r.length].tolist() == want[r.doc_id][r.start : r.start + r.length]


def test_packer_matches_a_plain_best_fit():
    rng = np.random.default_rng(3)
    for limit in (1, 4, 50):
        packer, bins, made = packing.Packer(100, limit), [], 0
        for n in rng.integers(1, 101, 2000).tolist():
            fits = [b for b in bins if b[1] >= n]
            if fits:
                best = min(b[1] for b in fits)
                b = [b for b in bins if b[1] == best][-1]
            else:
                if len(bins) >= limit:
                    least = min(b[1] for b in bins)
                    bins.remove([b for b in bins if b[1] == least][-1])
                b = [made, 100]
                made += 1
                bins.append(b)
            got = packer.add(n)
            assert got[1] == 100 - b[1] and (got[0] == b[0])
            bins.remove(b)
            b[1] -= n
            if b[1]:
                bins.append(b)
