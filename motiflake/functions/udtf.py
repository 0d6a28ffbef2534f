"""Extension: the search as a SQL table function, for LATERAL joins. search() is the fast way."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..plans.pattern import SearchQuery
from ..plans.session import share_code


class SearchHits:
    """search_hits(sequence, pattern, ambig_mode): strand, start, end, matched."""

    def eval(self, sequence: str, pattern: str, ambig_mode: str):
        query = SearchQuery(pattern, ambig_mode=ambig_mode or "none")
        text = query.target_alphabet.check(sequence or "")
        for strand, regex in query.strands:
            for hit in re.finditer(f"(?=({regex}))", text):
                yield strand, hit.start() + 1, hit.start() + len(hit[1]), hit[1]


def register(spark: SparkSession, name: str = "search_hits") -> None:
    share_code(spark)
    spark.udtf.register(name, F.udtf(SearchHits, returnType="strand string, start long, end long, matched string"))
