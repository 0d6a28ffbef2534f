"""Hits as tab-separated text."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.search import COLUMNS

HEADER = "\t".join(COLUMNS)


def line() -> Column:
    """One line of a hit; circular as true or false."""
    return F.concat_ws("\t", *[F.col(c).cast("string") for c in COLUMNS])


def write(hits: DataFrame, path: str, header: bool = False) -> None:
    """The hits as text files under `path`, in the order of the rows; with a header, as one file."""
    if header:
        hits.select(*COLUMNS).coalesce(1).write.mode("overwrite").option("sep", "\t").option("quote", "").option("header", True).csv(path)
    else:
        hits.select(line().alias("value")).write.mode("overwrite").text(path)


def lines(hits: DataFrame) -> Iterator[str]:
    """The lines of ordered hits, one partition after another."""
    for row in hits.select(line().alias("value")).toLocalIterator():
        yield row.value
