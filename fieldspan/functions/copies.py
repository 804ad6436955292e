"""Rows written out as often as a number says, in parallel however large it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Copies that one task writes of a row.
COPIES = 10_000
_BLOCK = "__block"


def spread_out(df: DataFrame, times: str, copy: str, block: int = COPIES) -> DataFrame:
    """Every row ``times`` times, numbered from 1 in ``copy``; none for less than 1 or null.

    First only the numbers of blocks of copies are written, which spread over the
    session's shuffle partitions, and each of them its own copies. For few rows with any number of copies.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number, first = F.col(times).cast("long"), F.col(_BLOCK) * block
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(cast({times} as long) - 1) div {block}")))
    dealt = df.where(number >= 1).withColumn(_BLOCK, blocks).repartition(parts, F.xxhash64(*df.columns), _BLOCK)
    return dealt.withColumn(copy, F.explode(F.sequence(first + 1, F.least(first + block, number)))).drop(_BLOCK)


def written_out(df: DataFrame, times: str, copy: str, block: int = COPIES) -> DataFrame:
    """The same for many rows: those with at most ``block`` copies are written where they are.

    ``df`` is read for either kind, so it should be narrow or staged.
    """
    number = F.col(times).cast("long")
    few = df.where((number >= 1) & (number <= block)).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), number)))
    return few.unionByName(spread_out(df.where(number > block), times, copy, block))
