"""What several operators share: the shared folder, written tables, ranks and ordered pieces."""

from __future__ import annotations

import ctypes
import itertools
import json
import math
import os
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.session import spread

_numbers = itertools.count()


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The table; with `columns` these alone, and of a small table of few files the rows dealt to all cores."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(df.select(*columns)) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one of our own in local mode (as
    in tests), an error on a cluster, whose executors don't see one another's folders."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="motiflake-")
        sc.setCheckpointDir(found)
    return found


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back: later steps neither compute it again nor depend on any
    executor that made it. The tables stay until the shared folder is cleared, or discard() takes them."""
    path = f"{shared_dir(spark)}/motiflake-{spark.sparkContext.applicationId}/{next(_numbers)}-{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes tables from written() that nothing reads any more."""
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def placed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """row (all columns of `docs`) and place: a hash of the row's file and number there, which tells rows that repeat whole
    apart. What is read from no Parquet file is written to one first, so that later passes see the same places. Of files that
    Spark names, the number of the part counts: the rest differs from run to run."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")

    def of(df: DataFrame, row: Column) -> DataFrame:
        at = df.metadataColumn("_metadata")
        return df.select(row, F.xxhash64(F.regexp_extract(at["file_name"], "^part-[0-9]+|^.*", 0), at["row_index"]).alias("place"))

    try:
        return of(docs, row)
    except AnalysisException:
        return of(written(spark, docs.select(row), "rows"), F.col("row"))


def share_code(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it (a no-op where PYTHONPATH has it)."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """`run`, which gives memory back to the system: Arrow's after every batch, the rest when the task ends. Python workers
    outlive their tasks and share an executor's memory with the JVM."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield out
            del out
            pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return wrapped


def ranked(spark: SparkSession, df: DataFrame, keys: list[str], rank: str = "rank") -> DataFrame:
    """`df` with each row's place (from 0) in the order of `keys`, without gathering rows in one task.

    Rows are range-partitioned and sorted; the place within a partition is added to the number of rows in the
    partitions before it, a table of one row per partition."""
    names = [f"k{i}" for i in range(len(df.columns))]
    plain = df.toDF(*names)
    order = [names[df.columns.index(k)] for k in keys]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = plain.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ordered = written(spark, ordered.withColumn("mid", F.monotonically_increasing_id()), "ordered")
    parts = ordered.groupBy(F.shiftright("mid", 33).alias("part")).agg(F.count("*").alias("n")).collect()
    before = dict(zip(sorted(r.part for r in parts), itertools.accumulate((r.n for r in sorted(parts, key=lambda r: r.part)), initial=0), strict=False))
    table = F.array(*[F.lit(before.get(i, 0)).cast("long") for i in range(max(before, default=0) + 1)])
    place = F.get(table, F.shiftright("mid", 33).cast("int")) + F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.select(*[F.col(a).alias(b) for a, b in zip(names, df.columns, strict=True)], place.cast("long").alias(rank))


def splitters(ranks: DataFrame, keys: list[str], n: int, pieces: int, rank: str = "rank", shift: int = 0) -> list[tuple]:
    """The keys at which pieces of equal row counts begin (but the first), or those `shift` rows behind (before, if
    negative), as far as there are rows: at most `pieces` - 1 rows reach the driver.

    They depend on the rows alone, not on how Spark partitioned them."""
    step = max(1, -(-n // max(1, pieces)))
    first = F.col(rank) - shift
    rows = ranks.filter((first > 0) & (first < n) & (first % step == 0)).select(*keys, rank).collect()
    return [tuple(r[k] for k in keys) for r in sorted(rows, key=lambda r: r[rank])]


def piece_of(keys: list[Column], types: list[str], cuts: list[tuple]) -> Column:
    """The number of `cuts` (in order) at or below the row's key: the piece that holds the row.

    Two steps of about the root of their number: the block of cuts that the key falls in, then the cuts of that block."""
    if not cuts:
        return F.lit(0)
    names = [f"c{i}" for i in range(len(keys))]
    kind = "struct<" + ", ".join(f"{n}: {t}" for n, t in zip(names, types, strict=True)) + ">"
    row = F.struct(*[k.cast(t).alias(n) for k, t, n in zip(keys, types, names, strict=True)])
    rows = [dict(zip(names, c, strict=True)) for c in cuts]
    step = math.isqrt(len(rows) - 1) + 1
    blocks = [rows[i : i + step] for i in range(0, len(rows), step)]
    block = F.size(F.filter(F.from_json(F.lit(json.dumps([x[0] for x in blocks])), f"array<{kind}>"), lambda c: c <= row))
    inside = F.get(F.from_json(F.lit(json.dumps(blocks)), f"array<array<{kind}>>"), block - 1)
    return F.when(block == 0, 0).otherwise((block - 1) * step + F.size(F.filter(inside, lambda c: c <= row)))


def running(by: list[str], order: list[str], value: str) -> Column:
    """The sum of `value` over the rows before this one."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))
