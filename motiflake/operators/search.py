"""Pattern search over a DataFrame of sequences: all overlapping hits, by built-in functions, without a shuffle.

A record's candidate starts are cut into blocks, each with the text that its last start needs. A block in which the pattern
occurs is split at the lookahead for it; the lengths of the parts give the starts. Both strands are scanned in one pass. Nothing
is keyed or sorted, so the plan is one stage however many records there are, and works on streams. Few long records are
spread over tasks by `jobs`: chunks of `chunk_size` starts are dealt out before they are cut into blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alphabets as a
from ..functions.arrays import running_sums
from ..plans.pattern import SearchQuery

COLUMNS = ("record", "strand", "start", "end", "matched", "circular")
#: Starts of a block at least, and how many times as many starts as the text that blocks share with the next.
BLOCK, PER_HALO = 1_024, 4
CHUNK = 1_000_000
_HIT = "array<struct<strand:string,at:int,matched:string>>"


def _hits(text: Column, strand: str, regex: str, m: int) -> Column:
    """Starts (from 1) and texts of all hits in a block, those that overlap too."""
    # Java drops an empty first part, so '#', in no alphabet, comes first; it makes the sum of lengths count from 1.
    parts = F.transform(F.split(F.concat(F.lit("#"), text), f"(?={regex})", -1), F.length)
    # What follows the last hit is a part too, without a hit of its own.
    starts = running_sums(F.slice(parts, F.lit(1), F.size(parts) - 1))
    raw = text.cast("binary")  # valid text is ASCII: bytes are cut without walking the text
    hits = F.transform(starts, lambda at: F.struct(F.lit(strand).alias("strand"), at.alias("at"), F.substring(raw, at, F.lit(m)).cast("string").alias("matched")))
    return F.when(text.rlike(regex), hits).otherwise(F.array().cast(_HIT))


def _cut(text: Column, first: Column, total: Column, size: int, m: int) -> Column:
    """Blocks (off, text) that hold `size` starts each; no blocks if there are no starts. Valid text is ASCII, so
    cutting bytes cuts symbols, without walking the text from its beginning each time."""
    raw = text.cast("binary")
    block = lambda s: F.struct((first + s).alias("off"), F.substring(raw, s.cast("int") + 1, (F.least(F.lit(size), total - s) + (m - 1)).cast("int")).cast("string").alias("text"))
    cut = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(total - 1, F.lit(0)), F.lit(size).cast("long")), block)
    return F.when(total > 0, cut).otherwise(F.array().cast("array<struct<off:bigint,text:string>>"))


def search(records: DataFrame, query: SearchQuery, *, jobs: int = 1, chunk_size: int = CHUNK, keep: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """record, strand, start, end, matched, circular of every hit; coordinates count from 1 and include both ends.

    records: name, sequence, and the columns to `keep` (they follow the six). Sequences are normalised and validated whole;
    a symbol outside the alphabet fails the query, also in a record that is too short to match. A null sequence has no
    hits. matched is the record's own text on the forward strand. In circular search `end` wraps, circular tells whether this
    hit crosses the origin, and a pattern may be longer than the record. Rows have no order; see ordered()."""
    if jobs < 1:
        raise ValueError("jobs must be at least 1")
    if chunk_size < 1:
        raise ValueError("chunk_size must be at least 1")
    m = len(query.pattern)
    kept = [F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)]
    keys = [f"__k{i}" for i in range(len(keep))]
    rows = records.select(F.col("name").alias("record"), a.validate(a.normalize(F.col("sequence")), query.target_alphabet).alias("seq"), *kept)
    n = F.length("seq").cast("long")
    if query.circular:
        times = F.ceil((n + (m - 1)) / F.greatest(n, F.lit(1))).cast("int")
        text, total = F.substring(F.repeat("seq", times), F.lit(1), (n + (m - 1)).cast("int")), n
    else:
        text, total = F.col("seq"), n - (m - 1)
    rows = rows.select("record", *keys, n.alias("n"), total.alias("total"), text.alias("text"))
    block = max(block, PER_HALO * m)
    if jobs > 1:
        rows = rows.select("record", *keys, "n", F.explode(_cut(F.col("text"), F.lit(0).cast("long"), F.col("total"), chunk_size, m)).alias("c")).repartition(jobs)
        rows = rows.select("record", *keys, "n", F.explode(_cut(F.col("c.text"), F.col("c.off"), F.length("c.text") - F.lit(m - 1), block, m)).alias("b"))
    else:
        rows = rows.select("record", *keys, "n", F.explode(_cut(F.col("text"), F.lit(0).cast("long"), F.col("total"), block, m)).alias("b"))
    rows = rows.select("record", *keys, "n", "b.off", F.inline(F.concat(*[_hits(F.col("b.text"), s, rx, m) for s, rx in query.strands])))
    last = F.col("off") + F.col("at") + (m - 2)  # of the hit, from 0, before it wraps
    out = {
        "start": F.col("off") + F.col("at"),
        "end": (last % F.col("n") + 1) if query.circular else last + 1,
        "circular": (last >= F.col("n")) if query.circular else F.lit(False),
    }
    return rows.select("record", "strand", out["start"].alias("start"), out["end"].alias("end"), "matched", out["circular"].alias("circular"), *[F.col(k).alias(c) for k, c in zip(keys, keep, strict=True)])


def ordered(hits: DataFrame, *by: str) -> DataFrame:
    """Hits by record (`by`: record_ord, or name), strand + before -, ascending start."""
    return hits.orderBy(*(by or ("record",)), F.col("strand") == "-", "start")


def search_many(records: DataFrame, queries: Iterable[SearchQuery], **options) -> DataFrame:
    """Extension: the hits of several queries, with the pattern of each."""
    parts = [search(records, q, **options).withColumn("pattern", F.lit(q.pattern)) for q in queries]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def count_hits(records: DataFrame, query: SearchQuery) -> DataFrame:
    """Extension: record, strand and n_hits without listing them; records without hits count 0."""
    m = len(query.pattern)
    rows = records.select(F.col("name").alias("record"), a.validate(a.normalize(F.col("sequence")), query.target_alphabet).alias("seq"))
    n = F.length("seq")
    if query.circular:
        times = F.ceil((n + (m - 1)) / F.greatest(n, F.lit(1))).cast("int")
        text = F.when(n > 0, F.substring(F.repeat("seq", times), F.lit(1), n + (m - 1))).otherwise(F.lit(""))
    else:
        text = F.coalesce("seq", F.lit(""))
    counted = [F.struct(F.lit(s).alias("strand"), F.regexp_count(text, F.lit(f"(?={rx})")).cast("long").alias("n_hits")) for s, rx in query.strands]
    return rows.select("record", F.inline(F.array(*counted)))
