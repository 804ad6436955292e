"""Distribution summaries: count, mean, std, min, quartiles, max."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspan.session import map_arrow, materialise

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def _moments(value: Column) -> list[Column]:
    return [
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ]


def _clean(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    number = F.col(value).cast("double")
    rows = df.select(*by, F.when(~F.isnan(number), number).alias("__v"))
    return rows.filter(F.col("__v").isNotNull())


def describe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Summary per group, nulls and NaN left out, quartiles with linear interpolation.

    For values that are few by nature (one per run, pair or model): the exact
    percentile keeps every distinct value of a group in one place. Use
    :func:`describe_large` for one value per item.
    """
    v = F.col("__v")
    quartiles = [F.percentile(v, q).alias(name) for name, q in QUARTILES.items()]
    return _clean(df, value, by).groupBy(*by).agg(*_moments(v), *quartiles)


def _ordered(values: np.ndarray) -> np.ndarray:
    """Longs in the order of the doubles (zeros equal), one for each different double."""
    bits = (values + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def _with_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = pa.array(_ordered(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)))
        yield pa.RecordBatch.from_arrays([*batch.columns, bits], [*batch.schema.names, "__bits"])


def _with_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
        values = (bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values)], [*batch.schema.names[:-1], "value"])


def exact_ranks(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """(__g, rank, value): the values (__g, __bits) that stand at the given ranks (__g, rank) of their group, from 0.

    Values are counted by their leading 16 bits, then those that share a wanted rank's leading bits by
    the next 16, until all 64 are known: four counts over numbers, each combined before it moves. What is
    ordered is a histogram of at most 65,536 buckets for a group and prefix, never a part of the data.
    """
    known = materialise(ranks.distinct().select("__g", "rank", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below")))
    for shift in (48, 32, 16, 0):
        prefix = F.shiftright("__bits", shift + 16) if shift < 48 else F.lit(0).cast("long")
        wanted = known.select("__g", "prefix").distinct()
        near = rows.select("__g", prefix.alias("prefix"), F.shiftright("__bits", shift).alias("bucket")).join(wanted, ["__g", "prefix"])
        counted = near.groupBy("__g", "prefix", "bucket").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("__g", "prefix").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        placed = counted.withColumn("upto", upto).join(known, ["__g", "prefix"])
        here = (F.col("rank") < F.col("below") + F.col("upto")) & (F.col("rank") >= F.col("below") + F.col("upto") - F.col("n"))
        known = materialise(placed.where(here).select("__g", "rank", F.col("bucket").alias("prefix"), (F.col("below") + F.col("upto") - F.col("n")).alias("below")))
    return map_arrow(known.select("__g", "rank", "prefix"), _with_values, "__g string, rank long, value double")


def describe_large(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """The same summary, exact, for any number of values and groups. Runs when called; values are staged once, as numbers.

    Quartiles are found by ``exact_ranks``: the two neighbours of each, then the line between them.
    """
    rows = _clean(df, value, by)
    # A null is a group too, so groups are told apart by a text.
    group = F.to_json(F.struct(*by)) if by else F.lit("")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    coded = map_arrow(rows.select(group.alias("__g"), *by, "__v"), _with_bits, f"__g string, {types + ', ' if types else ''}__v double, __bits long")
    coded = materialise(coded)
    moments = materialise(coded.groupBy("__g", *by).agg(*_moments(F.col("__v"))))
    spots = [F.struct(F.lit(name).alias("q"), (F.lit(q) * (F.col("count") - 1)).alias("spot")) for name, q in QUARTILES.items()]
    spots = moments.select("__g", "count", F.inline(F.array(*spots)))
    spots = spots.select("__g", "q", F.floor("spot").alias("low"), F.least(F.floor("spot") + 1, F.col("count") - 1).alias("high"), (F.col("spot") - F.floor("spot")).alias("part"))
    found = exact_ranks(coded.select("__g", "__bits"), spots.select("__g", F.explode(F.array("low", "high")).alias("rank")))
    low, high = (found.select("__g", F.col("rank").alias(end), F.col("value").alias(f"at_{end}")) for end in ("low", "high"))
    ends = spots.join(low, ["__g", "low"]).join(high, ["__g", "high"])
    ends = ends.withColumn("v", F.col("at_low") + (F.col("at_high") - F.col("at_low")) * F.col("part"))
    wide = ends.groupBy("__g").agg(*[F.max(F.when(F.col("q") == name, F.col("v"))).alias(name) for name in QUARTILES])
    return moments.join(wide, "__g").select(*by, "count", "mean", "std", "min", "max", *QUARTILES)
