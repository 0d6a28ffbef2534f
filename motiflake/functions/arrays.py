"""Array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sums are gathered in arrays of this size and those in one, so that appending costs no square of the array's length.
PART = 32


def running_sums(numbers: Column) -> Column:
    """array<int>: the sum of each element of an array<int> and all before it.

    Only integers are gathered: an array of structs would be cast anew at every step."""
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("at"), none.alias("part"), none.alias("full"))

    def step(acc: Column, n: Column) -> Column:
        at = acc["at"] + n
        grown, last = F.concat(acc["part"], F.array(at)), F.size(acc["part"]) == PART - 1
        return F.struct(at.alias("at"), F.when(last, none).otherwise(grown).alias("part"), F.when(last, F.concat(acc["full"], grown)).otherwise(acc["full"]).alias("full"))

    return F.aggregate(numbers, start, step, lambda acc: F.concat(acc["full"], acc["part"]))
