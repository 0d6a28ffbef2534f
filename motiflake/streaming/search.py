"""Search over streams of records: the same plan as in batch, which keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import search
from ..plans.pattern import SearchQuery


def stream_records(spark: SparkSession, path: str, name: str, sequence: str, schema: str, file_format: str = "parquet") -> DataFrame:
    """Records from files as they arrive in a folder; `name` and `sequence` are SQL expressions over `schema`."""
    rows = spark.readStream.format(file_format).schema(schema).load(path)
    return rows.select(F.expr(name).cast("string").alias("name"), F.expr(sequence).alias("sequence"))


def search_stream(records: DataFrame, query: SearchQuery, **options) -> DataFrame:
    """The hits of every record of a stream, each once its record has come."""
    return search(records, query, **options)
