"""Bit-packed sequences as columns.

A sequence is normalised and validated by column expressions; Arrow kernels pack whole sequences. symbol_at() reads the bytes
that hold one symbol, with built-in functions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..plans.session import share_code
from . import alphabets as a
from . import kernels as k

#: Target encodings, as results name them. Fixed values.
BYTES = "byte"
TWO_BIT = "nucleotide-2bit-code"
EXACT_5BIT = "nucleotide-exact-5bit"
TWO_BIT_MASK = "nucleotide-2bit-mask"
IUPAC_VALID = "nucleotide-2bit-valid-mask"
IUPAC_VALID_GAP = "nucleotide-2bit-valid-gap-mask"
IUPAC_5BIT = "nucleotide-iupac-5bit-mask"
PROTEIN_5BIT = "protein-5bit"

_TARGET = "struct<data:binary,length:bigint,encoding:string>"
_TARGET_ARROW = pa.struct([("data", pa.binary()), ("length", pa.int64()), ("encoding", pa.string())])
_FIVE = {EXACT_5BIT: a.EXACT, IUPAC_5BIT: a.IUPAC, PROTEIN_5BIT: a.PROTEIN}


@cache
def _codes_of(encoding: str) -> np.ndarray:
    return k.table(_FIVE[encoding].codes)


@cache
def _two_bit_codes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By symbol: 2-bit code, whether it is canonical, whether it is a gap."""
    symbols = a.IUPAC_MASKS
    return k.table({s: a.TWO_BIT_CODES.get(s, 0) for s in symbols}), k.table({s: s in a.CANONICAL for s in symbols}), k.table({s: s in a.GAPS for s in symbols})


def _packed(plain: str, encoding: str) -> dict:
    """The target of a valid sequence; IUPAC_VALID becomes IUPAC_VALID_GAP if there are gaps."""
    if encoding in _FIVE:
        data = k.pack(k.ascii_codes(plain, _codes_of(encoding)), 5)
    else:
        two, valid, gap = (k.ascii_codes(plain, t) for t in _two_bit_codes())
        data = k.pack(two, 2)
        if encoding == IUPAC_VALID:
            data += k.pack(valid, 1)
            if gap.any():
                data, encoding = data + k.pack(gap, 1), IUPAC_VALID_GAP
    return {"data": data, "length": len(plain), "encoding": encoding}


def _kernel(run: Callable, kind: pa.DataType, sql: str) -> Callable[..., Column]:
    def call(*columns: Column) -> Column:
        if spark := SparkSession.getActiveSession():
            share_code(spark)
        return F.arrow_udf(k.each(run, kind), sql)(*columns)

    return call


_pack = _kernel(_packed, _TARGET_ARROW, _TARGET)


def _up(n: Column, by: int) -> Column:
    return F.floor((n + (by - 1)) / by).cast("long")


def pack_nucleotide_2bit(sequence: Column) -> Column:
    """struct(data, length, encoding): 4 bases a byte, the first in the top bits. Only A, C, G, T and U."""
    plain = a.normalize(sequence)
    bad = F.regexp_extract(plain, "([^ACGTU])", 1)
    where = F.regexp_instr(plain, F.lit("[^ACGTU]")).cast("string")
    message = F.concat(F.lit("2-bit nucleotide encoding only supports A, C, G, T, or U; found '"), bad, F.lit("' at position "), where)
    return _pack(F.when(plain.rlike("[^ACGTU]"), F.raise_error(message).cast("string")).otherwise(plain), F.lit(TWO_BIT))


def pack_nucleotide_exact_5bit(sequence: Column) -> Column:
    return _pack(a.validate(a.normalize(sequence), a.EXACT), F.lit(EXACT_5BIT))


def pack_nucleotide_iupac_masks_5bit(sequence: Column) -> Column:
    return _pack(a.validate(a.normalize(sequence), a.IUPAC), F.lit(IUPAC_5BIT))


def pack_protein_5bit(sequence: Column) -> Column:
    return _pack(a.validate(a.normalize(sequence), a.PROTEIN), F.lit(PROTEIN_5BIT))


def pack_nucleotide_iupac_target(sequence: Column) -> Column:
    """2-bit codes, then a bitmap of canonical bases, then one of gaps if there are any."""
    return _pack(a.validate(a.normalize(sequence), a.IUPAC_TARGET), F.lit(IUPAC_VALID))


#: By mode: the alphabet of targets, the encoding of canonical ones, that of others.
_CHOICES = {"none": (a.EXACT, TWO_BIT, EXACT_5BIT), "query": (a.IUPAC_TARGET, TWO_BIT_MASK, IUPAC_VALID), "both": (a.IUPAC, TWO_BIT_MASK, IUPAC_5BIT)}


@cache
def _chooser(small: str, other: str) -> Callable[[str], dict]:
    canonical = set(a.CANONICAL)
    return lambda plain: _packed(plain, small if canonical.issuperset(plain) else other)


def encode_target(sequence: Column, sequence_type: str = a.NUCLEOTIDE, ambig_mode: str = "none") -> Column:
    """struct(data, length, encoding): the smallest representation that the search mode allows for this sequence."""
    if sequence_type == a.AMINO_ACID:
        return pack_protein_5bit(sequence)
    alphabet, small, other = _CHOICES[ambig_mode]
    return _kernel(_chooser(small, other), _TARGET_ARROW, _TARGET)(a.validate(a.normalize(sequence), alphabet))


def encoding_name(sequence: Column, sequence_type: str = a.NUCLEOTIDE, ambig_mode: str = "none") -> Column:
    """The encoding that encode_target() chooses, without packing. Input: normalised."""
    if sequence_type == a.AMINO_ACID:
        return F.lit(PROTEIN_5BIT)
    _, small, other = _CHOICES[ambig_mode]
    rest = F.when(sequence.rlike("[-.]"), IUPAC_VALID_GAP).otherwise(other) if other == IUPAC_VALID else F.lit(other)
    return F.when(sequence.rlike("^[ACGTU]*$"), small).otherwise(rest)


def packed_size(length: Column, encoding: Column) -> Column:
    """Bytes that a target of `length` symbols takes."""
    two, bitmap, five = _up(length, 4), _up(length, 8), _up(5 * length, 8)
    return (
        F.when(encoding.isin(TWO_BIT, TWO_BIT_MASK), two)
        .when(encoding == IUPAC_VALID, two + bitmap)
        .when(encoding == IUPAC_VALID_GAP, two + 2 * bitmap)
        .when(encoding == BYTES, length)
        .otherwise(five)
        .cast("long")
    )


def _unpacked(target: dict) -> bytes:
    """Codes or masks of a target, a byte each."""
    data, n, encoding = target["data"], target["length"], target["encoding"]
    if encoding == BYTES:
        return data[:n]
    if encoding not in (TWO_BIT, TWO_BIT_MASK, IUPAC_VALID, IUPAC_VALID_GAP):
        return k.unpack(data, 5, n).tobytes()
    two, at, size = k.unpack(data, 2, n), -(-n // 4), -(-n // 8)
    if encoding == TWO_BIT:
        return two.tobytes()
    mask = np.left_shift(1, two).astype(np.uint8)
    if encoding != TWO_BIT_MASK:
        mask *= k.unpack(data[at:], 1, n)
    if encoding == IUPAC_VALID_GAP:
        mask[k.unpack(data[at + size :], 1, n) == 1] = a.IUPAC_MASKS["-"]
    return mask.tobytes()


#: binary: a packed target's codes or masks, a byte each, in order.
code_bytes = _kernel(_unpacked, pa.binary(), "binary")
#: array<int>: the same as numbers.
codes = _kernel(lambda target: list(_unpacked(target)), pa.list_(pa.int32()), "array<int>")


def _bits(data: Column, first: Column, width: int) -> Column:
    """The number in the `width` (8 at most) bits of `data` from bit `first` on: two bytes are read, whatever the length."""
    two = F.rpad(F.hex(F.substring(data, (F.floor(first / 8) + 1).cast("int"), F.lit(2))), 4, "0")
    shift = (F.lit(16 - width) - first % 8).cast("int")
    return F.call_function("shiftright", F.conv(two, 16, 10).cast("int"), shift).bitwiseAND(F.lit((1 << width) - 1))


def symbol_at(target: Column, index: Column) -> Column:
    """The code or mask at `index` (from 0) of a packed target, read from the bytes that hold it; an index outside it is an
    error."""
    data, n, encoding, i = target["data"], target["length"], target["encoding"], index.cast("long")
    two = _bits(data, 2 * i, 2)
    mask = F.call_function("shiftleft", F.lit(1), two)
    bitmap = lambda k: _bits(data, 8 * (_up(n, 4) + k * _up(n, 8)) + i, 1)
    valid = F.when(bitmap(0) == 1, mask).otherwise(0)
    return (
        F.when((i < 0) | (i >= n), F.raise_error(F.lit("target index out of range")).cast("int"))
        .when(encoding == TWO_BIT, two)
        .when(encoding == TWO_BIT_MASK, mask)
        .when(encoding == IUPAC_VALID, valid)
        .when(encoding == IUPAC_VALID_GAP, F.when(bitmap(1) == 1, a.IUPAC_MASKS["-"]).otherwise(valid))
        .when(encoding == BYTES, _bits(data, 8 * i, 8))
        .otherwise(_bits(data, 5 * i, 5))
    )


unpack_nucleotide_2bit = unpack_nucleotide_exact_5bit = unpack_nucleotide_iupac_masks_5bit = unpack_nucleotide_iupac_target = unpack_protein_5bit = symbol_at
