"""Search queries, and the regular expression that a pattern becomes.

Each pattern symbol becomes the class of target symbols that it accepts, so one operator serves all modes.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import groupby

from ..functions import alphabets as a

SEQUENCE_TYPES = (a.NUCLEOTIDE, a.AMINO_ACID)
AMBIG_MODES = ("none", "query", "both")


@dataclass(frozen=True)
class SearchQuery:
    """What to look for. The pattern is normalised; `ambig=True` is another way to ask for ambig_mode "query".

    Raises ValueError for an empty pattern, a symbol outside the alphabet, and options that exclude one another."""

    pattern: str
    revcomp: bool = False
    circular: bool = False
    ambig: bool = False
    sequence_type: str = a.NUCLEOTIDE
    ambig_mode: str = "none"
    strands: tuple[tuple[str, str], ...] = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        put = lambda name, value: object.__setattr__(self, name, value)
        if self.sequence_type not in SEQUENCE_TYPES:
            raise ValueError(f"Unsupported sequence type: {self.sequence_type}")
        if self.ambig_mode not in AMBIG_MODES:
            raise ValueError(f"Unsupported ambiguity mode: {self.ambig_mode}")
        if self.ambig and self.ambig_mode == "both":
            raise ValueError("ambig=True cannot be combined with ambig_mode 'both'")
        put("ambig_mode", "query" if self.ambig else self.ambig_mode)
        put("ambig", self.ambig_mode != "none")
        put("pattern", a.normalized(self.pattern))
        if self.sequence_type == a.AMINO_ACID and self.ambig:
            raise ValueError("Ambiguity modes are only valid for nucleotide sequences")
        if self.sequence_type == a.AMINO_ACID and self.revcomp:
            raise ValueError("Reverse complement is only valid for nucleotide sequences")
        if not self.pattern:
            raise ValueError("Pattern must not be empty")
        self.query_alphabet.check(self.pattern)
        found = [("+", self._regex(self.pattern))]
        if self.revcomp:
            found.append(("-", self._regex(a.reverse_complemented(self.pattern))))
        put("strands", tuple(found))

    @property
    def query_alphabet(self) -> a.Alphabet:
        return a.PROTEIN if self.sequence_type == a.AMINO_ACID else a.IUPAC_QUERY if self.ambig else a.EXACT

    @property
    def target_alphabet(self) -> a.Alphabet:
        if self.sequence_type == a.AMINO_ACID:
            return a.PROTEIN
        return {"none": a.EXACT, "query": a.IUPAC_TARGET, "both": a.IUPAC}[self.ambig_mode]

    def accepts(self, symbol: str) -> str:
        """The target symbols that this pattern symbol matches."""
        q, t = self.query_alphabet.codes, self.target_alphabet.codes
        if self.ambig:
            return "".join(s for s in t if q[symbol] & t[s])
        return "".join(s for s in t if q[symbol] == t[s])

    def _regex(self, pattern: str) -> str:
        def one(symbol: str) -> str:
            found = self.accepts(symbol)
            plain = "".join("\\" + s if s in "-.*" else s for s in found)
            return plain if len(found) == 1 else f"[{plain}]"

        runs = ((one(s), len(list(g))) for s, g in groupby(pattern))
        return "".join(x if n == 1 else f"{x}{{{n}}}" for x, n in runs)
