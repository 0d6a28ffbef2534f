"""Histogram sort into shards of equal bytes.

Rows are ordered by a 62-bit key: 31 bits of the text's hash, then 31 bits of a hash of the row and its place in its file, so
equal texts lie together and any of them can still be cut apart, rows that repeat whole too. Exact bytes and rows below
candidate boundaries are counted over all rows; each round splits the intervals that still miss their target into finer
candidates, until every splitter meets the tolerance. A boundary between texts that is near enough is preferred to one
inside a group of equal texts. Then whole rows are exchanged once. DataFrame functions only; the driver sees counts alone.
"""

from __future__ import annotations

import itertools
import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import piece_of, placed, read, written

#: Bits of a key after each round of counting; a whole number of texts lies below a boundary of TEXT bits.
LEVELS, TEXT = (10, 20, 31, 41, 51, 62), 31
BITS = LEVELS[-1]
#: How far from the mean, in shares of it, a shard's bytes may be; and so that a group of equal texts stays whole.
TOLERANCE, WHOLE = 0.0005, 0.005
#: Bytes of a piece of a shard, about: one task sorts and numbers it, with spills if need be. Pieces of a shard at least and
#: at most (the driver holds a few numbers for each); beyond the most, pieces grow.
PIECE_BYTES, PIECES = 256 << 20, (4, 4_096)
#: Columns that shard() adds.
ADDED = ("size", "shard", "slot")


def size_and_key(text: Column, doc_id: Column, place: Column) -> list[Column]:
    """size (UTF-8 bytes plus 1; a null text has none) and key of a row; place: what tells rows that repeat apart."""
    whole = F.coalesce(text, F.lit(""))
    half = lambda h: F.shiftrightunsigned(h, 33)
    key = F.shiftleft(half(F.xxhash64(whole)), BITS - TEXT) + half(F.xxhash64(doc_id, whole, place))
    return [(F.octet_length(whole) + 1).cast("long").alias("size"), key.alias("key")]


class Histogram:
    """Exact counts below boundaries, refined where asked."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        #: By level and prefix: bins in order, and bytes and rows below each and below their end.
        self.bins: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.load(0, [0])
        self.total = [int(x[-1]) for x in self.bins[0, 0][1:]]

    def load(self, level: int, prefixes: list[int]) -> None:
        """Counts of the next bits below these prefixes, which are keys cut to the bits of the level before."""
        above, bits = LEVELS[level - 1] if level else 0, LEVELS[level]
        bin_ = F.shiftright("key", BITS - bits) if bits < BITS else F.col("key")
        rows = self.rows.filter(F.shiftright("key", BITS - above).isin(prefixes)) if level else self.rows
        found = rows.groupBy(bin_.alias("bin")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).toArrow()
        bins, size, n = (found.column(c).to_numpy().astype(np.int64) for c in ("bin", "bytes", "rows"))
        order = np.argsort(bins)
        bins, size, n = bins[order], size[order], n[order]
        for p in prefixes:
            at = slice(*np.searchsorted(bins >> (bits - above), [p, p + 1])) if level else slice(None)
            self.bins[level, p] = (bins[at], np.concatenate([[0], np.cumsum(size[at])]), np.concatenate([[0], np.cumsum(n[at])]))

    def solve(self, targets: list[float], tolerance: float, whole: float = 0) -> list[tuple[int, int, int]]:
        """For each target the boundary (key, bytes below, rows below) whose bytes are nearest or near enough: within
        `tolerance`, or within `whole` if it cuts no group of equal texts."""
        found: list = [None] * len(targets)
        open_ = {j: (0, 0, 0, 0) for j in range(len(targets))}  # level, prefix, bytes and rows below the prefix
        while open_:
            for level, group in itertools.groupby(sorted({x[:2] for x in open_.values()} - self.bins.keys()), key=lambda x: x[0]):
                self.load(level, [p for _, p in group])
            for j, (level, prefix, under, rows) in list(open_.items()):
                bins, size, n = self.bins[level, prefix]
                rest = BITS - LEVELS[level]
                if not len(bins):  # an empty table
                    found[j] = (0, under, rows)
                    del open_[j]
                    continue
                i = min(max(int(np.searchsorted(size, targets[j] - under, side="left")) - 1, 0), len(bins) - 1)
                low, high = ((int(bins[i] + k) << rest, under + int(size[i + k]), rows + int(n[i + k])) for k in (0, 1))
                near = min(low, high, key=lambda x: abs(x[1] - targets[j]))
                miss = abs(near[1] - targets[j])
                if miss <= tolerance or not rest or (rest == BITS - TEXT and miss <= whole):
                    found[j] = near
                    del open_[j]
                else:
                    open_[j] = (level + 1, int(bins[i]), low[1], low[2])
        return found


def shard(spark: SparkSession, docs: DataFrame, shards: int = 16, tolerance: float = TOLERANCE, whole: float = WHOLE) -> DataFrame:
    """Every row of `docs` (doc_id, text and any others), whole, with its size, its shard and its slot there.

    Shard sizes differ from the mean by at most `tolerance` of it and one row, or by `whole` of it where that keeps a group
    of equal texts in one shard; larger groups are cut, rows that repeat whole like any others. Slots number a shard's rows
    from 0 without a gap in the order of the key; rows come out in that order within a partition. A null text counts as empty;
    null ids are ids like others; an empty table gives no rows; a text of any length is one row. Columns of `docs` named size, shard or slot are replaced.
    `docs` is read twice, for the counts and for the exchange; the same files give the same result."""
    rows = placed(spark, docs)
    rows = rows.select("row", *size_and_key(F.col("row.text"), F.col("row.doc_id"), F.col("place")))
    counts = Histogram(written(spark, rows.select("size", "key"), "keys"))
    total, mean = counts.total[0], counts.total[0] / shards
    pieces = max(PIECES[0], min(PIECES[1], -(-total // (shards * PIECE_BYTES))))
    outer = counts.solve([mean * j for j in range(1, shards)], tolerance * mean, whole * mean)
    ends = [(0, 0, 0), *outer, (1 << BITS, *counts.total)]
    inner = [a[1] + (b[1] - a[1]) * i / pieces for a, b in itertools.pairwise(ends) for i in range(1, pieces)]
    solved = iter(counts.solve(inner, 0.25 * mean / pieces))
    cuts = [c for a, b in itertools.pairwise(ends) for c in (a, *(min(max(next(solved), a), b) for _ in range(1, pieces)))]
    rows = rows.withColumn("piece", piece_of([F.col("key")], ["long"], [(c[0],) for c in cuts[1:]])).repartitionById(len(cuts), F.col("piece"))
    before = F.from_json(F.lit(json.dumps([c[2] - cuts[i - i % pieces][2] for i, c in enumerate(cuts)])), "array<long>")
    place = F.row_number().over(Window.partitionBy("piece").orderBy("key", "row.doc_id", "size", F.crc32(F.col("row.text").cast("binary"))))
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in ADDED]
    return rows.select(*kept, "size", F.floor(F.col("piece") / pieces).cast("int").alias("shard"), (F.get(before, F.col("piece")) + place - 1).alias("slot"))


def write_shards(spark: SparkSession, docs: DataFrame, path: str, shards: int = 16) -> None:
    """`docs` as Parquet below `path`, a folder shard=N for each shard that has rows; files hold rows in the order of slot."""
    shard(spark, docs, shards).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every document in one of 16 shards, under the law `bytes`."""
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    found = shard(spark, read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
