"""Bit packing over Arrow batches: codes are bytes, packed big-endian, the first in the top bits, filled up with zero bits."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pyarrow as pa


def table(codes: Mapping[str, int]) -> np.ndarray:
    """Code by ASCII byte."""
    out = np.zeros(256, np.uint8)
    for symbol, code in codes.items():
        out[ord(symbol)] = code
    return out


def pack(codes: np.ndarray, bits: int) -> bytes:
    return np.packbits(np.unpackbits(codes[:, None], axis=1)[:, 8 - bits :]).tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first `n` codes that pack() packed."""
    wide = np.zeros((n, 8), np.uint8)
    wide[:, 8 - bits :] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    return np.packbits(wide, axis=1)[:, 0]


def each(run: Callable, kind: pa.DataType) -> Callable[..., pa.Array]:
    """An Arrow function that gives run(value, ...) of every row, null where a value is null."""

    def over(*columns: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in columns), strict=True)
        return pa.array([None if any(v is None for v in row) else run(*row) for row in rows], kind)

    return over


def ascii_codes(text: str, codes: np.ndarray) -> np.ndarray:
    return codes[np.frombuffer(text.encode("ascii"), np.uint8)]
