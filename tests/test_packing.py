import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from motiflake.functions import alphabets as a
from motiflake.functions import packing as p

CASES = [
    (p.pack_nucleotide_2bit, "ACGTU", a.EXACT_CODES, lambda n, s: (n + 3) // 4),
    (p.pack_nucleotide_exact_5bit, "".join(a.EXACT_CODES), a.EXACT_CODES, lambda n, s: (5 * n + 7) // 8),
    (p.pack_nucleotide_iupac_masks_5bit, "".join(a.IUPAC_MASKS), a.IUPAC_MASKS, lambda n, s: (5 * n + 7) // 8),
    (p.pack_nucleotide_iupac_target, "".join(a.IUPAC_MASKS), a.TARGET_MASKS, lambda n, s: (n + 3) // 4 + (2 if set(s) & set("-.") else 1) * ((n + 7) // 8)),
    (p.pack_nucleotide_iupac_target, "ACGTUNRY", a.TARGET_MASKS, lambda n, s: (n + 3) // 4 + (n + 7) // 8),
    (p.pack_protein_5bit, a.PROTEIN_SYMBOLS, a.PROTEIN_CODES, lambda n, s: (5 * n + 7) // 8),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_round_trip_and_size(spark, case):
    pack, symbols, codes, size = CASES[case]
    rng = random.Random(case)
    texts = [symbols, *("".join(rng.choices(symbols, k=n)) for n in range(0, 130))]
    df = spark.createDataFrame([(t,) for t in texts], "s string").select("s", pack(F.col("s")).alias("t"))
    for r in df.select("s", "t", p.codes(F.col("t")).alias("c")).collect():
        assert r.c == [codes[x] for x in r.s] and r.t.length == len(r.s) and len(r.t.data) == size(len(r.s), r.s)


def bits(values, width):
    text = "".join(f"{v:0{width}b}" for v in values)
    text += "0" * (-len(text) % 8)
    return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))


def test_bytes_are_big_endian_bit_streams(spark):
    s = "ACGTTGCAACGTNRY-.ACGTACGTAAAACCCCGGGGTTTT"
    row = spark.createDataFrame([(s, "ACGTTGCAACGTAC")], "s string, d string").select(p.pack_nucleotide_2bit(F.col("d")).alias("two"), p.pack_nucleotide_exact_5bit(F.col("s")).alias("five"), p.pack_nucleotide_iupac_target(F.col("s")).alias("target")).first()
    assert bytes(row.two.data) == bits([a.EXACT_CODES[x] for x in "ACGTTGCAACGTAC"], 2)
    assert bytes(row.five.data) == bits([a.EXACT_CODES[x] for x in s], 5)
    assert bytes(row.target.data) == bits([a.TWO_BIT_CODES.get(x, 0) for x in s], 2) + bits([x in "ACGTU" for x in s], 1) + bits([x in "-." for x in s], 1)


@pytest.mark.parametrize(
    ("sequence", "mode", "encoding"),
    [
        ("ACGTU", "none", p.TWO_BIT), ("ANRY-.", "none", p.EXACT_5BIT), ("ACGTU", "query", p.TWO_BIT_MASK), ("ANRY-.", "query", p.IUPAC_VALID_GAP), ("ACGT" + "N" * 12, "query", p.IUPAC_VALID),
        ("ACGTU", "both", p.TWO_BIT_MASK), ("ANRY-.", "both", p.IUPAC_5BIT), ("MTEYK", "protein", p.PROTEIN_5BIT), ("", "none", p.TWO_BIT),
    ],
)
def test_choice_of_representation(spark, sequence, mode, encoding):
    kind = {"sequence_type": a.AMINO_ACID} if mode == "protein" else {"ambig_mode": mode}
    df = spark.createDataFrame([(sequence,)], "s string").select("s", p.encode_target(F.col("s"), **kind).alias("t"))
    r = df.select("t", p.encoding_name(F.col("s"), **kind).alias("name"), p.packed_size(F.col("t.length"), F.col("t.encoding")).alias("size"), p.codes(F.col("t")).alias("c")).first()
    table = a.PROTEIN_CODES if mode == "protein" else {"none": a.EXACT_CODES, "query": a.TARGET_MASKS, "both": a.IUPAC_MASKS}[mode]
    assert r.t.encoding == r.name == encoding and r.size == len(r.t.data) and r.c == [table[x] for x in sequence]


def test_symbol_at_and_its_bounds(spark):
    df = spark.createDataFrame([("ACG",)], "s string").select(p.pack_nucleotide_2bit(F.col("s")).alias("t"))
    assert [df.select(p.symbol_at(F.col("t"), F.lit(i))).first()[0] for i in range(3)] == [0, 1, 2]
    for i in (-1, 3):
        with pytest.raises(PySparkException, match="out of range"):
            df.select(p.symbol_at(F.col("t"), F.lit(i))).collect()


def test_byte_targets(spark):
    df = spark.createDataFrame([(bytearray([0, 16, 255]),)], "d binary").select(F.struct(F.col("d").alias("data"), F.lit(3).cast("long").alias("length"), F.lit(p.BYTES).alias("encoding")).alias("t"))
    assert df.select(p.codes(F.col("t"))).first()[0] == [0, 16, 255]


@pytest.mark.parametrize(("encode", "table"), [(a.encode_nucleotide_exact, a.EXACT_CODES), (a.encode_nucleotide_iupac_query, a.IUPAC_MASKS), (a.encode_nucleotide_iupac, a.IUPAC_MASKS), (a.encode_nucleotide_iupac_target, a.TARGET_MASKS), (a.encode_protein_exact, a.PROTEIN_CODES)])
def test_encoders(spark, encode, table):
    text = "".join(table)
    df = spark.createDataFrame([(text,), (" a c\ng\t",), ("",), (None,)], "s string")
    got = [None if r.e is None else bytes(r.e) for r in df.select(encode(F.col("s")).alias("e")).collect()]
    assert got == [bytes(table.values()), bytes(table[x] for x in "ACG"), b"", None]


def test_errors(spark):
    df = spark.createDataFrame([("ATX",)], "s string")
    for f, message in ((a.encode_nucleotide_exact, "Unsupported nucleotide symbol 'X' at position 3"), (a.encode_nucleotide_iupac_query, "IUPAC nucleotide query symbol 'X'"), (a.encode_nucleotide_iupac_target, "IUPAC nucleotide target symbol 'X'"), (p.pack_nucleotide_2bit, "only supports A, C, G, T, or U; found 'X' at position 3")):
        with pytest.raises(PySparkException, match=message):
            df.select(f(F.col("s"))).collect()


def test_normalize_drops_all_unicode_white_space(spark):
    texts = ["A\xa0C\x1cG T\x85a", " ß　", None, "", "ſı"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "s string").select(a.normalize(F.col("s"))).collect()]
    assert got == [None if t is None else a.normalized(t) for t in texts]


def test_first_invalid(spark):
    df = spark.createDataFrame([("ACGX1",), ("ACG",), ("",)], "s string").select(a.first_invalid(F.col("s"), a.EXACT).alias("bad"))
    assert [r.bad and tuple(r.bad) for r in df.collect()] == [("X", 4), None, None]


def test_codec_objects(spark):
    from motiflake.functions import codecs as c

    df = spark.createDataFrame([(" acg\nn-",)], "s string")
    for codec, codes, name in ((c.NucleotideCodec(), a.EXACT_CODES, p.EXACT_5BIT), (c.IupacNucleotideCodec(), a.TARGET_MASKS, p.IUPAC_VALID_GAP), (c.IupacNucleotideCodec(allow_target_ambiguity=True), a.IUPAC_MASKS, p.IUPAC_5BIT), (c.ProteinCodec(), a.PROTEIN_CODES, p.PROTEIN_5BIT)):
        target = codec.encode_target(F.col("s"))
        r = df.select(codec.normalize(F.col("s")).alias("n"), codec.encode_query(F.col("s")).alias("q"), target.data.alias("d"), target.length.alias("l"), target.encoding.alias("e"), *[target.symbol_at(F.lit(i)).alias(f"s{i}") for i in range(5)]).first()
        assert r.n == "ACGN-" and r.l == 5 and r.e == name and [r[f"s{i}"] for i in range(5)] == [codes[x] for x in "ACGN-"] and len(bytes(r.q)) == 5
    assert c.NucleotideCodec().reverse_complement("ACN") == "NGT"
    with pytest.raises(ValueError, match="only valid for nucleotide"):
        c.ProteinCodec().reverse_complement("MA")
    same, both = c.NucleotideCodec(), c.IupacNucleotideCodec()
    assert df.select(same.compatible(F.lit(1), F.lit(3)), both.compatible(F.lit(1), F.lit(3))).first()[:] == (False, True)
