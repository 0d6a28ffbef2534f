"""A query and how to run it, as one object; and the shapes that other readers and matchers may take."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from ..operators.search import CHUNK, search
from .pattern import SearchQuery


class SequenceReader(Protocol):
    """Reads records: name, sequence, and what else it knows of them."""

    def read(self, spark: SparkSession) -> DataFrame: ...


class SequenceMatcher(Protocol):
    """Finds the hits of its query in records."""

    def search(self, records: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class SearchPlan:
    """One logical plan serves all modes; Spark chooses the physical one. jobs spreads long records over tasks."""

    query: SearchQuery
    jobs: int = 1
    chunk_size: int = CHUNK

    def __post_init__(self) -> None:
        if self.jobs < 1:
            raise ValueError("jobs must be at least 1")
        if self.chunk_size < 1:
            raise ValueError("chunk_size must be at least 1")

    def search(self, records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        return search(records, self.query, jobs=self.jobs, chunk_size=self.chunk_size, keep=keep)


def plan(query: SearchQuery, jobs: int = 1, chunk_size: int = CHUNK) -> SearchPlan:
    return SearchPlan(query, jobs, chunk_size)
