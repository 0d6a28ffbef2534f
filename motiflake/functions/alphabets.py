"""Alphabets and the column functions that normalise, validate, complement and encode sequences.

A sequence is normalised when it has no white space and is in upper case; positions count normalised symbols from 1.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..plans.session import share_code
from . import kernels as k

NUCLEOTIDE, AMINO_ACID = "nucleotide", "amino-acid"

# Codes, masks, complements and symbol order as results carry them.
EXACT_CODES = {"A": 0, "C": 1, "G": 2, "T": 3, "U": 3, "R": 4, "Y": 5, "S": 6, "W": 7, "K": 8, "M": 9, "B": 10, "D": 11, "H": 12, "V": 13, "N": 14, "-": 15, ".": 16}
IUPAC_MASKS = {"A": 1, "C": 2, "G": 4, "T": 8, "U": 8, "R": 5, "Y": 10, "S": 6, "W": 9, "K": 12, "M": 3, "B": 14, "D": 13, "H": 11, "V": 7, "N": 15, "-": 16, ".": 16}
CANONICAL = "ACGTU"
GAPS = "-."
COMPLEMENT = {"A": "T", "C": "G", "G": "C", "T": "A", "U": "A", "R": "Y", "Y": "R", "S": "S", "W": "W", "K": "M", "M": "K", "B": "V", "D": "H", "H": "D", "V": "B", "N": "N", "-": "-", ".": "."}
PROTEIN_SYMBOLS = "ACDEFGHIKLMNPQRSTVWYBJZXUO*-."

#: As a target in query mode, an ambiguous letter matches nothing.
TARGET_MASKS = {s: (m if s in CANONICAL + GAPS else 0) for s, m in IUPAC_MASKS.items()}
PROTEIN_CODES = {s: i for i, s in enumerate(PROTEIN_SYMBOLS)}
TWO_BIT_CODES = {s: EXACT_CODES[s] for s in CANONICAL}

#: White space as Python's str.split() knows it; Java's \s alone misses the information separators, x85 and \p{Z}.
_BLANK = r"[\s\x1c-\x1f\x85\p{Z}]+"


@dataclass(frozen=True)
class Alphabet:
    """Symbols with their codes; `label` is how error messages call it."""

    label: str
    codes: Mapping[str, int]

    @cached_property
    def outside(self) -> str:
        """A regular expression for one symbol that isn't in the alphabet."""
        return "[^" + "".join("\\" + s if s in "-.*" else s for s in self.codes) + "]"

    def check(self, text: str) -> str:
        """Normalised `text`; ValueError names the first symbol outside the alphabet."""
        plain = normalized(text)
        for at, symbol in enumerate(plain, 1):
            if symbol not in self.codes:
                raise ValueError(f"Unsupported {self.label} symbol {symbol!r} at position {at}")
        return plain


EXACT = Alphabet("nucleotide", EXACT_CODES)
IUPAC_QUERY = Alphabet("IUPAC nucleotide query", IUPAC_MASKS)
IUPAC_TARGET = Alphabet("IUPAC nucleotide target", TARGET_MASKS)
IUPAC = Alphabet("IUPAC nucleotide", IUPAC_MASKS)
PROTEIN = Alphabet("amino-acid", PROTEIN_CODES)


def normalized(text: str) -> str:
    return "".join(text.split()).upper()


def normalize(sequence: Column) -> Column:
    """The sequence without white space, in upper case. Null stays null."""
    return F.upper(F.regexp_replace(sequence, _BLANK, ""))


#: Symbols whose upper-case form has several, and what stands for them where a symbol must stay one: a single upper- or
#: title-case symbol where there is one, else the symbol itself.
_LONGER = {c: {"ß": "ẞ"}.get(c, c.title() if len(c.title()) == 1 else c) for c in map(chr, range(0x110000)) if len(c.upper()) > 1}


def normalize_by_symbol(sequence: Column) -> Column:
    """As normalize(), but every symbol stays one, also those whose upper-case form has several (ß gives ẞ, not SS): places count
    the symbols of the text."""
    longer = "".join(_LONGER)
    plain = F.translate(F.regexp_replace(sequence, _BLANK, ""), "ß", "ẞ")  # ẞ has no other upper case
    parts = F.split(plain, f"(?<=[{longer}])|(?=[{longer}])")
    one = lambda x: F.when(x.rlike(f"[{longer}]"), F.translate(x, longer, "".join(_LONGER.values()))).otherwise(F.upper(x))
    # All but ß are rare and lie in these few ranges: other texts are not split.
    return F.when(plain.rlike("[ŉǰΐΰև\u1e96-\u1e9a\u1f50-\u1fff\ufb00-\ufb17]"), F.array_join(F.transform(parts, one), "")).otherwise(F.upper(plain))


def first_invalid(sequence: Column, alphabet: Alphabet) -> Column:
    """struct(symbol, position) of the first symbol outside the alphabet, null if there is none. Input: normalised."""
    symbol = F.regexp_extract(sequence, f"({alphabet.outside})", 1)
    position = F.regexp_instr(sequence, F.lit(alphabet.outside)).cast("long")
    return F.when(sequence.rlike(alphabet.outside), F.struct(symbol.alias("symbol"), position.alias("position")))


def validate(sequence: Column, alphabet: Alphabet) -> Column:
    """The sequence itself; a query that reads it fails at a symbol outside the alphabet. Input: normalised.

    The check is part of the value, so column pruning can't drop it."""
    bad = F.regexp_extract(sequence, f"({alphabet.outside})", 1)
    where = F.regexp_instr(sequence, F.lit(alphabet.outside))
    message = F.concat(F.lit(f"Unsupported {alphabet.label} symbol '"), bad, F.lit("' at position "), where.cast("string"))
    return F.when(sequence.rlike(alphabet.outside), F.raise_error(message).cast("string")).otherwise(sequence)


def nucleotide_exact_text(sequence: Column) -> Column:
    """Comparison key of exact nucleotide search: normalised, validated, U written as T."""
    return F.translate(validate(normalize(sequence), EXACT), "U", "T")


def protein_exact_text(sequence: Column) -> Column:
    return validate(normalize(sequence), PROTEIN)


def reverse_complement(sequence: Column) -> Column:
    """The opposite strand, read in its own direction; never contains U. Input: normalised and valid."""
    pairs = {a: b for a, b in COMPLEMENT.items() if a != b}
    return F.translate(F.reverse(sequence), "".join(pairs), "".join(pairs.values()))


def reverse_complemented(pattern: str) -> str:
    """The same for a pattern on the driver; names the last symbol that has no complement."""
    out = []
    for symbol in reversed(normalized(pattern)):
        if symbol not in COMPLEMENT:
            raise ValueError(f"Unsupported nucleotide symbol {symbol!r} in reverse-complement pattern")
        out.append(COMPLEMENT[symbol])
    return "".join(out)


def encode(sequence: Column, alphabet: Alphabet) -> Column:
    """One byte for each symbol: its code. Normalises and validates."""
    table = k.table(alphabet.codes)
    if spark := SparkSession.getActiveSession():
        share_code(spark)
    coded = F.arrow_udf(k.each(lambda plain: k.ascii_codes(plain, table).tobytes(), pa.binary()), "binary")
    return coded(validate(normalize(sequence), alphabet))


def _encoder(alphabet: Alphabet) -> Callable[[Column], Column]:
    def run(sequence: Column) -> Column:
        return encode(sequence, alphabet)

    return run


encode_nucleotide_exact = _encoder(EXACT)
encode_nucleotide_iupac_query = encode_nucleotide_iupac = _encoder(IUPAC_QUERY)
encode_nucleotide_iupac_target = _encoder(IUPAC_TARGET)
encode_protein_exact = _encoder(PROTEIN)
