"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is -ln(u) / w, with u drawn from its id and text and w its quality weight; the smaller the key, the sooner
it is taken. Within a source, documents are taken in the order of their keys until the words reach the source's target; a
target over the source's size first takes every document whole as often as it fits, then selects the rest.

No source is sorted whole: keys map to codes in the same order, rows of one code are in the order of a hash that tells
them all apart. Words per (source, next bits) are summed over all rows, again and again within the bin where a source's
target falls, until that bin holds a few rows; these alone are sorted, to find the document that the target cuts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import placed, ranked, read, running, written

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Bits of a code, and of the hash that tells rows of one code apart; bits that a round of counting adds.
BITS, STEP = 48, 12
#: Rows that are sorted in one task at most, if their codes and hashes differ.
EDGE = 10_000
#: Sources up to this many (rows of some 100 bytes) are broadcast and shared out by the driver; more are joined by key.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality(text: Column, size: Column) -> Column:
    """A weight from 0.25 to 1 that falls as the mean word length leaves the usual 6 characters: lists of codes, runs of
    symbols and broken lines go later."""
    mean = (F.length(text) + 1) / F.greatest(size, F.lit(1))
    return F.greatest(F.lit(0.25), F.coalesce(F.least(mean / 6, 6 / mean), F.lit(0.25)))


def sized(spark: SparkSession, docs: DataFrame, seed: int = 7) -> DataFrame:
    """row (all columns of `docs`), nosrc, src (its source, null apart), size, key, code and place of every row."""
    rows = placed(spark, docs)
    text, source, id_ = F.col("row.text"), F.col("row.source"), F.col("row.doc_id")
    rows = rows.withColumns({"nosrc": source.isNull(), "src": F.coalesce(source.cast("string"), F.lit("")), "size": word_count(text)})
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_, text), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    rows = rows.withColumn("key", -F.log(u) / quality(text, F.col("size")))
    # key / (1 + key) keeps the order, and bits for large keys too.
    code = F.floor(F.col("key") / (1 + F.col("key")) * F.lit(float(1 << BITS)))
    return rows.withColumns({"code": F.least(code, F.lit((1 << BITS) - 1)), "place": F.shiftrightunsigned(F.xxhash64("place", id_, text), 64 - BITS)})


@dataclass(frozen=True)
class Mix:
    plan: DataFrame  # a row per source: nosrc, src, source_size, target, epochs, and the cut: end_code, end_place, end_part
    sources: int


def _level(spark: SparkSession, sources: DataFrame, n: int, words: float) -> tuple[float, bool]:
    """The words that a weight of 1 gets, so that all sources share `words` and none exceeds its cap."""
    if n <= BROADCAST_SOURCES:
        cap, w = (c.to_numpy().astype(np.float64) for c in sources.select("cap", "w").toArrow().columns)
        order = np.argsort(cap / w, kind="stable")
        cap, w = cap[order], w[order]
        fixed, open_ = np.concatenate([[0], np.cumsum(cap)[:-1]]), np.cumsum(w[::-1])[::-1]
        level = (words - fixed) / open_  # if the sources before are full
        first = np.flatnonzero(level < cap / w)
        return (float(level[first[0]]), True) if len(first) else (0.0, False)
    level, full = 0.0, -1
    while True:  # each round fills at least one more source; the driver holds three sums
        over = F.col("cap") <= F.lit(level) * F.col("w")
        done, fixed, open_ = sources.agg(F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0))).first()
        if done == full or not open_:
            return level, bool(open_)
        full, level = done, (words - fixed) / open_


def _bits(level: int) -> Column:
    """The bits of code, then place, that round `level` adds."""
    per = BITS // STEP
    name, shift = ("code", BITS - STEP * (level + 1)) if level < per else ("place", BITS - STEP * (level + 1 - per))
    return F.shiftright(name, shift).bitwiseAND((1 << STEP) - 1).cast("int")


def _within(level: int) -> Column:
    """Whether code and place of a row begin with high and low, the bits of the rounds before `level`."""
    known = STEP * level
    if known <= BITS:
        return F.shiftright("code", BITS - known) == F.col("high")
    return (F.col("code") == F.col("high")) & (F.shiftright("place", 2 * BITS - known) == F.col("low"))


def fit(spark: SparkSession, rows: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> Mix:
    """Targets of all sources, and the document at which each source's selection ends. `rows`: from sized(); it is read
    once and then once for each round of counting, so it should be a written table."""
    by = ["nosrc", "src"]
    words, n_rows = F.sum("size").alias("words"), F.count("*").alias("n")
    first = written(spark, rows.groupBy(*by, _bits(0).alias("b")).agg(words, n_rows), "codes")
    sources = ranked(spark, first.groupBy(*by).agg(F.sum("words").alias("source_size")), by)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = written(spark, sources.select(*by, "source_size", w.alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap")), "sources")
    n, total = sources.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    level, some_open = _level(spark, sources, n, share * total)
    target = F.when(F.col("cap") <= F.lit(level) * F.col("w"), F.col("cap")).otherwise(F.lit(level) * F.col("w")) if some_open else F.col("cap")
    sources = sources.withColumn("target", target)
    sources = sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    sources = sources.withColumn("rest", F.greatest(F.lit(0), F.round("target").cast("long") - F.col("epochs") * F.col("source_size")))
    small = F.broadcast if n <= BROADCAST_SOURCES else (lambda x: x)

    # Of each source: the bits of the bin where `left` words are reached (high of the code, low of the place).
    edge, bins, at = sources.select(*by, F.lit(0).cast("long").alias("high"), F.lit(0).cast("long").alias("low"), F.col("rest").alias("left")), first, 0
    while True:
        cum = bins.withColumn("before", running(by, ["b"], "words")).join(small(edge), by)
        cum = cum.filter((F.col("before") < F.col("left")) & (F.col("left") <= F.col("before") + F.col("words")))
        add = lambda c: F.shiftleft(c, STEP) + F.col("b")
        code = at < BITS // STEP
        edge = written(spark, cum.select(*by, (add("high") if code else F.col("high")).alias("high"), (F.col("low") if code else add("low")).alias("low"), (F.col("left") - F.col("before")).alias("left"), "n"), "edge")
        at += 1
        if (edge.agg(F.max("n")).first()[0] or 0) <= EDGE or at == 2 * BITS // STEP:
            break
        edge = edge.drop("n")
        bins = rows.join(small(edge), by).filter(_within(at)).groupBy(*by, _bits(at).alias("b")).agg(words, n_rows)
    last = rows.join(small(edge), by).filter(_within(at))
    last = last.withColumn("before", running(by, ["code", "place"], "size"))
    last = last.filter((F.col("before") < F.col("left")) & (F.col("left") <= F.col("before") + F.col("size")))
    cut = last.select(*by, F.col("code").alias("end_code"), F.col("place").alias("end_place"), (F.col("left") - F.col("before")).alias("end_part"))
    plan = sources.join(cut, by, "left").select(*by, "source_size", "target", "epochs", *[F.coalesce(c, F.lit(-1 if c != "end_part" else 0)).cast("long").alias(c) for c in ("end_code", "end_place", "end_part")])
    return Mix(written(spark, plan, "mix"), n)


def taken(rows: DataFrame, mix: Mix) -> DataFrame:
    """`rows` (from sized()) with source_size, target, part and taken: the words of the document in the mix, repeats counted.

    Complete epochs count the whole document; of the rest, documents before the one that the target cuts are taken whole,
    and of that one the words up to the target."""
    plan = F.broadcast(mix.plan) if mix.sources <= BROADCAST_SOURCES else mix.plan
    same = F.col("code") == F.col("end_code")
    before = (F.col("code") < F.col("end_code")) | (same & (F.col("place") < F.col("end_place")))
    part = F.when(before, F.col("size")).when(same & (F.col("place") == F.col("end_place")), F.col("end_part")).otherwise(0)
    return rows.join(plan, ["nosrc", "src"]).withColumn("part", part).withColumn("taken", (F.col("epochs") * F.col("size") + F.col("part")).cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, seed: int = 7) -> DataFrame:
    """The rows of `docs` (doc_id, text, source and any others) as often as the mix has them, in the columns of `docs`; of a
    document whose words the target cuts, whole copies as the cut rounds.

    Documents without words (null, empty, blanks) go. A null source is one source, the last. Rows that share an id or repeat
    whole are so many documents, taken in an order of their own; a text of any length is one. An empty table gives none."""
    rows = sized(spark, docs, seed)
    out = taken(rows, fit(spark, written(spark, rows.drop("row", "key"), "sized"))).withColumn("copies", F.round(F.col("taken") / F.greatest("size", F.lit(1))).cast("int"))
    out = out.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the words that the mix takes of every document; a document without words has size 0 and takes none. Nulls,
    repeats and empty tables as in mixed()."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = written(spark, sized(spark, docs).withColumn("row", F.struct("row.doc_id")).drop("key"), "sized")
    return taken(rows, fit(spark, rows)).select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")
