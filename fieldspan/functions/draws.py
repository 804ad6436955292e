"""Random draws as hashes of the row key.

``rand()`` gives other rows when a lost task is run again on differently ordered
input; a hash of (seed, key) does not, needs no sort, and can be repeated in SQL.
"""

from __future__ import annotations

import secrets
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspan.functions.copies import spread_out

_HASH, _ROW, _BUCKET, _STRATUM = "__hash", "__row", "__bucket", "__stratum"
_N, _QUOTA, _BEFORE, _NEED = "__n", "__quota", "__before", "__need"
_CUT_HASH, _CUT_ROW, _CUT_N, _COPY = "__cut_hash", "__cut_row", "__cut_n", "__copy"

#: Hex digits of a hash bucket: a million buckets, so the one that holds a cut has a millionth of the rows.
BUCKET_DIGITS = 5


def fresh_seed(seed: int | str | None) -> int | str:
    """The given seed, or a new one: the draw itself stays a hash of the key."""
    return secrets.randbits(31) if seed is None else seed


def _hash_of(seed: Column, *cols: str | Column) -> Column:
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols]
    return F.md5(F.concat_ws(":", seed, *parts))


def draw_hash(seed: int | str, *cols: str | Column) -> Column:
    """md5 of ``seed:key`` as 32 hex digits; its order is the random order."""
    return _hash_of(F.lit(str(seed)), *cols)


def unit_draw_of(seed: Column, *cols: str | Column) -> Column:
    """Uniform number in [0, 1) from the first 32 bits of the hash, with a seed per row."""
    return F.conv(F.substring(_hash_of(seed, *cols), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def unit_draw(seed: int | str, *cols: str | Column) -> Column:
    """Uniform number in [0, 1) from the first 32 bits of the hash."""
    return unit_draw_of(F.lit(str(seed)), *cols)


def mark_exact(
    df: DataFrame,
    on: Sequence[str],
    quota: int | DataFrame,
    seed: int | str,
    flag: str,
    strata: Sequence[str] = (),
) -> DataFrame:
    """Flag exactly ``quota`` rows per stratum: those smallest by hash of ``on``.

    ``quota`` is a number, or a table (strata..., quota) with one row per stratum
    (one row without strata). Strata are a label vocabulary, never a data key: the
    cuts joined by broadcast hold one row for each. A stratum with fewer rows
    than its quota is kept whole; one without a quota gets none.

    No sort of the input and no window over it: rows are counted per hash bucket,
    then per hash in the one bucket that holds the cut, so copies of one key are
    summed before they move. Rows equal in every column fall on the cut together
    and are told apart by number only.
    """
    if not strata:
        return _mark_plain(df, on, quota, seed, flag)
    cols, by = df.columns, list(strata)
    rows = df.withColumn(_HASH, draw_hash(seed, *on)).withColumn(_ROW, F.xxhash64(*cols))
    rows = rows.withColumn(_BUCKET, F.substring(_HASH, 1, BUCKET_DIGITS))

    buckets = rows.groupBy(*by, _BUCKET).agg(F.count(F.lit(1)).alias(_N))
    if isinstance(quota, DataFrame):
        quotas = quota.select(*by, F.col("quota").alias(_QUOTA))
        buckets = buckets.join(quotas, by, "left").fillna(0, subset=[_QUOTA])
    else:
        buckets = buckets.withColumn(_QUOTA, F.lit(quota))

    bucket_cut = _holding_cut(buckets, by, [_BUCKET]).select(*by, _BUCKET, _NEED)
    in_bucket = rows.join(F.broadcast(bucket_cut), [*by, _BUCKET])
    hashes = in_bucket.groupBy(*by, _HASH, _ROW, _NEED).agg(F.count(F.lit(1)).alias(_N))
    hashes = hashes.withColumnRenamed(_NEED, _QUOTA)
    cut = _holding_cut(hashes, by, [_HASH, _ROW]).select(
        *by, F.col(_HASH).alias(_CUT_HASH), F.col(_ROW).alias(_CUT_ROW), _NEED, F.col(_N).alias(_CUT_N)
    )
    return _marked(rows.join(F.broadcast(cut), by, "left"), cols, by, flag)


def _holding_cut(counts: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The entry of each stratum in which the quota is reached, and how many of its rows are needed."""
    running = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(_BEFORE, F.coalesce(F.sum(_N).over(running), F.lit(0)))
    place = F.greatest(F.col(_QUOTA), F.lit(1))
    held = counts.filter((F.col(_BEFORE) < place) & (F.col(_BEFORE) + F.col(_N) >= place))
    return held.withColumn(_NEED, F.col(_QUOTA) - F.col(_BEFORE))


def _marked(placed: DataFrame, cols: list[str], by: list[str], flag: str) -> DataFrame:
    """Rows below the cut are in; the one distinct row on it is written out by number."""
    on_cut = F.coalesce((F.col(_HASH) == F.col(_CUT_HASH)) & (F.col(_ROW) == F.col(_CUT_ROW)), F.lit(False))
    inside = F.col(_CUT_HASH).isNull() | (
        F.struct(_HASH, _ROW) < F.struct(F.col(_CUT_HASH).alias(_HASH), F.col(_CUT_ROW).alias(_ROW))
    )
    tied = spread_out(placed.filter(on_cut).dropDuplicates(by or [_HASH, _ROW]), _CUT_N, _COPY)
    tied = tied.withColumn(flag, F.col(_COPY) <= F.col(_NEED))
    return placed.filter(~on_cut).select(*cols, inside.alias(flag)).unionByName(tied.select(*cols, flag))


def _mark_plain(df: DataFrame, on: Sequence[str], quota: int | DataFrame, seed: int | str, flag: str) -> DataFrame:
    """Without strata the cut is one hash: two counting jobs find it, and marking needs no join."""
    cols = df.columns
    rows = df.withColumn(_HASH, draw_hash(seed, *on)).withColumn(_ROW, F.xxhash64(*cols))
    rows = rows.withColumn(_BUCKET, F.substring(_HASH, 1, BUCKET_DIGITS))
    wanted = quota if isinstance(quota, int) else quota.select("quota").first()[0] or 0
    buckets = rows.groupBy(_BUCKET).agg(F.count(F.lit(1)).alias(_N)).withColumn(_QUOTA, F.lit(wanted))
    bucket = _holding_cut(buckets, [], [_BUCKET]).select(_BUCKET, _NEED).first()
    if bucket is None:  # no more rows than the quota
        return df.withColumn(flag, F.lit(True))
    hashes = rows.filter(F.col(_BUCKET) == bucket[0]).groupBy(_HASH, _ROW).agg(F.count(F.lit(1)).alias(_N))
    cut = _holding_cut(hashes.withColumn(_QUOTA, F.lit(bucket[1])), [], [_HASH, _ROW]).select(_HASH, _ROW, _NEED, _N).first()
    placed = rows.withColumns({name: F.lit(value) for name, value in zip((_CUT_HASH, _CUT_ROW, _NEED, _CUT_N), cut)})
    return _marked(placed, cols, [], flag)


def draw_exact(
    df: DataFrame,
    on: Sequence[str],
    quota: int | DataFrame,
    seed: int | str | None,
    strata: Sequence[str] = (),
) -> DataFrame:
    """Exactly ``quota`` random rows (per stratum), whatever the size: rows are counted, never gathered."""
    return mark_exact(df, on, quota, fresh_seed(seed), "__drawn", strata).filter("__drawn").drop("__drawn")
