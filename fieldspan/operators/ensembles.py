"""Analytics over the scores of many models, kept long: (architecture, model_id, key, score)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspan.operators.summary import QUARTILES, describe, describe_large
from fieldspan.session import map_arrow

_STATS = ("count", "mean", "std", "min", *QUARTILES, "max")


def score_dispersion(scores: DataFrame, key: str, by: Sequence[str] = ("architecture",)) -> DataFrame:
    """Standard deviation over models per item, summarised over items (exactly, for any number)."""
    per_item = scores.groupBy(*by, key).agg(F.stddev_samp("score").alias("std_score"))
    return describe_large(per_item, "std_score", by)


def consensus(scores: DataFrame, key: str, by: Sequence[str] = ("architecture",)) -> DataFrame:
    """Positive votes by the number of models that agree, and their share from the top down.

    Rows carry the real number of models, also where some number has no item. The
    window runs over that many rows.
    """
    votes = scores.groupBy(*by, key).agg(F.count_if(F.col("score") > 0.5).alias("nb_models"))
    counted = votes.groupBy(*by, "nb_models").agg((F.col("nb_models") * F.count(F.lit(1))).alias("nb_positives"))
    whole = Window.partitionBy(*by)
    downward = whole.orderBy(F.col("nb_models").desc()).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("nb_positives").over(whole)
    return counted.select(
        *by,
        "nb_models",
        "nb_positives",
        F.try_divide(F.col("nb_positives"), total).alias("share_positives"),
        F.try_divide(F.sum("nb_positives").over(downward), total).alias("cumshare_positives"),
    )


def dispersion_by_architecture(scores: DataFrame, key: str, architectures: list[str] | None = None) -> DataFrame:
    """(stat, one column per architecture)."""
    stats = score_dispersion(scores, key)
    values = ", ".join(f"'{s}', cast(`{s}` as double)" for s in _STATS)
    long = stats.select("architecture", F.expr(f"stack({len(_STATS)}, {values}) AS (stat, value)"))
    return long.groupBy("stat").pivot("architecture", architectures).agg(F.first("value"))


def consensus_by_architecture(scores: DataFrame, key: str, architectures: list[str] | None = None) -> DataFrame:
    """(nb_models, cumulative share per architecture); null where an architecture has no such vote."""
    table = consensus(scores, key)
    return table.groupBy("nb_models").pivot("architecture", architectures).agg(F.first("cumshare_positives"))


def model_performance(metas: DataFrame) -> DataFrame:
    """Summary of each metric per architecture from (architecture, model_id, metric, value).

    Metrics some model lacks vanish; f1-score is added. Models are few.
    """
    models = metas.select("architecture", "model_id").distinct().agg(F.count(F.lit(1))).scalar()
    shared = metas.groupBy("metric").agg(F.count_distinct("architecture", "model_id").alias("n"))
    shared = shared.filter(F.col("n") == models).select("metric")
    kept = metas.join(F.broadcast(shared), "metric").select("architecture", "model_id", "metric", "value")

    def value(name: str) -> Column:
        return F.max(F.when(F.col("metric") == name, F.col("value")))

    f1 = kept.groupBy("architecture", "model_id").agg(value("precision").alias("p"), value("recall").alias("r"))
    f1 = f1.select(
        "architecture",
        "model_id",
        F.lit("f1-score").alias("metric"),
        F.try_divide(F.lit(2.0) * F.col("p") * F.col("r"), F.col("p") + F.col("r")).alias("value"),
    )
    return describe(kept.unionByName(f1.filter(F.col("value").isNotNull())), "value", ["architecture", "metric"])


def _scored_models(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., model_id, middle): who has scores in which group, with a score from the middle of them."""
    return scores.groupBy(*by, "model_id").agg(F.percentile_approx("score", 0.5, 100).alias("middle"))


def _gram(batches: Iterator[pa.RecordBatch], middles, n_by: int) -> Iterator[pa.RecordBatch]:
    """Sums over items of products of two models' scores, for a block of models against another.

    Scores are taken from a middle score of their model, so that sums of squares keep their digits.
    """
    shifts = middles.value
    sums: dict[tuple, np.ndarray] = {}

    def sent(group: tuple) -> Iterator[pa.RecordBatch]:
        own, other = shifts[group]
        total = sums.pop(group)
        for i, a in enumerate(own):
            if a <= max(other):
                columns = [pa.array([x], t) for x, t in zip(group, kinds)] + [pa.array([a], pa.int32()), pa.array([list(other)], pa.list_(pa.int32()))]
                columns += [pa.array([x[i].tolist()], pa.list_(pa.float64())) for x in total]
                yield pa.RecordBatch.from_arrays(columns, names)

    names, kinds = None, None
    for batch in batches:
        names, kinds = [*batch.schema.names[:n_by], "a", "b", *GRAM], [f.type for f in batch.schema][:n_by]
        keys = list(zip(*(c.to_pylist() for c in batch.columns[: n_by + 2])))
        models, values = batch.column("models"), batch.column("scores")
        for group in dict.fromkeys(keys):
            if group not in shifts:  # a block of which the group has no models
                continue
            own, other = (np.array(list(x)) for x in shifts[group])
            rows = pa.array([i for i, k in enumerate(keys) if k == group])
            flat, sizes = models.take(rows).flatten().to_numpy(), models.take(rows).value_lengths().to_numpy()
            score, item = values.take(rows).flatten().to_numpy(), np.repeat(np.arange(len(rows)), sizes)
            sides = []
            for side, shift in zip((own, other), shifts[group]):
                place = np.searchsorted(side, flat)
                place[place == len(side)] = 0
                found = side[place] == flat
                x = np.full((len(rows), len(side)), -np.inf)
                # Repeats of an item and model: the largest score counts.
                np.maximum.at(x, (item[found], place[found]), score[found])
                has = x > -np.inf
                sides.append((np.where(has, x - np.array(list(shift.values())), 0.0), has.astype(float)))
            (x, in_x), (y, in_y) = sides
            part = np.stack([in_x.T @ in_y, x.T @ in_y, in_x.T @ y, (x * x).T @ in_y, in_x.T @ (y * y), x.T @ y])
            if group in sums:
                sums[group] += part
            else:
                if len(sums) >= HELD_SUMS:
                    yield from sent(next(iter(sums)))
                sums[group] = part
    for group in list(sums):
        yield from sent(group)


#: Models of a block; six sums of all pairs of two blocks are 12 MB.
BLOCK_MODELS = 512
#: Pairs of blocks, each of a group, that a task sums up at once.
HELD_SUMS = 16
#: Items with both scores, sums, sums of squares and of products.
GRAM = ("n", "sx", "sy", "sxx", "syy", "sxy")


def model_correlations(
    scores: DataFrame, key: str, models: list[str] | None = None, by: Sequence[str] = ("architecture",), block: int = BLOCK_MODELS
) -> DataFrame:
    """(by..., model_a, model_b, corr) of every ordered pair of a group's models, itself included.

    An item's scores become one vector; tasks sum the outer products of their items' vectors, with the
    number of items that have both scores, and only those sums move. The plan does not depend on
    the number of models. Beyond ``block`` models the vectors are dealt once for each pair of blocks.
    Null and NaN scores are missing; items scored by only one of a pair do not count for it. Null where a
    score never varies, or where no two items have both. Without a list of names all models are taken. Models and groups are looked up when called.
    """
    spark = scores.sparkSession
    rows = scores.where(F.col("score").isNotNull() & ~F.isnan("score") & F.col("model_id").isNotNull())
    if models is not None:
        rows = rows.where(F.col("model_id").isin(models))
    found = _scored_models(rows, by).collect()
    names = sorted({r.model_id for r in found})
    number = {name: n for n, name in enumerate(names)}
    blocks = -(-len(names) // block) or 1
    # For each group and pair of blocks the models of either, with a middle score.
    own: dict[tuple, dict[int, float]] = {}
    for r in found:
        n = number[r.model_id]
        own.setdefault((*r[: len(by)], n // block), {})[n] = r.middle
    own = {k: dict(sorted(v.items())) for k, v in own.items()}
    middles = {(*a[:-1], a[-1], b[-1]): (own[a], own[b]) for a in own for b in own if a[:-1] == b[:-1] and a[-1] <= b[-1]}
    numbers = spark.createDataFrame(list(number.items()), "model_id string, no int")
    items = rows.join(F.broadcast(numbers), "model_id").groupBy(*by, key).agg(F.collect_list(F.struct("no", F.col("score").cast("double").alias("score"))).alias("x"))
    if blocks == 1:
        dealt = items.withColumns({"bi": F.lit(0), "bj": F.lit(0)})
    else:
        pairs = F.array(*[F.struct(F.lit(i).alias("bi"), F.lit(j).alias("bj")) for i in range(blocks) for j in range(i, blocks)])
        dealt = items.select(*by, key, "x", F.inline(pairs))
        dealt = dealt.withColumn("x", F.filter("x", lambda x: (F.floor(x["no"] / block) == F.col("bi")) | (F.floor(x["no"] / block) == F.col("bj"))))
        dealt = dealt.where(F.size("x") > 0).repartition(*by, "bi", "bj", F.pmod(F.xxhash64(key), F.lit(64)))
    vectors = dealt.select(*by, "bi", "bj", F.col("x.no").alias("models"), F.col("x.score").alias("scores"))
    kinds = "".join(f"`{c}` {scores.schema[c].dataType.simpleString()}, " for c in by)
    schema = f"{kinds}a int, b array<int>, {', '.join(f'{c} array<double>' for c in GRAM)}"
    parts = map_arrow(vectors, partial(_gram, middles=spark.sparkContext.broadcast(middles), n_by=len(by)), schema)
    single = parts.select(*by, "a", F.inline(F.arrays_zip("b", *GRAM))).where("a <= b")
    total = single.groupBy(*by, "a", "b").agg(*[F.sum(c).alias(c) for c in GRAM])
    n, sx, sy, sxx, syy, sxy = (F.col(c) for c in GRAM)
    spread = [F.when(q - F.try_divide(s * s, n) > 1e-13 * q, q - F.try_divide(s * s, n)) for q, s in ((sxx, sx), (syy, sy))]
    corr = F.try_divide(sxy - F.try_divide(sx * sy, n), F.sqrt(spread[0]) * F.sqrt(spread[1]))
    corr = F.when(F.col("a") == F.col("b"), F.when(spread[0].isNotNull(), 1.0)).otherwise(corr)
    ways = F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))
    both = total.select(*by, corr.alias("corr"), F.explode(F.when(F.col("a") == F.col("b"), F.slice(ways, 1, 1)).otherwise(ways)).alias("w"))
    of_a, of_b = (F.broadcast(numbers.select(F.col("no").alias(f"no_{x}"), F.col("model_id").alias(f"model_{x}"))) for x in "ab")
    named = both.join(of_a, F.col("w.x") == F.col("no_a")).join(of_b, F.col("w.y") == F.col("no_b"))
    return named.select(*by, "model_a", "model_b", "corr")


def representativeness(
    scores: DataFrame, key: str, models: list[str] | None = None, by: Sequence[str] = ("architecture",)
) -> DataFrame:
    """(by..., model_id, mean_corr): mean correlation with all models, itself included."""
    pairs = model_correlations(scores, key, models, by)
    return pairs.groupBy(*by, F.col("model_a").alias("model_id")).agg(F.avg("corr").alias("mean_corr"))


def most_representative(
    scores: DataFrame, key: str, models: list[str] | None = None, by: Sequence[str] = ("architecture",), digits: int = 10
) -> DataFrame:
    """The model of highest mean correlation per group (ties after rounding go by name)."""
    means = representativeness(scores, key, models, by).filter(F.col("mean_corr").isNotNull())
    best = F.min(F.struct((-F.round("mean_corr", digits)).alias("o"), F.col("model_id"), F.col("mean_corr"))).alias("b")
    return means.groupBy(*by).agg(best).select(*by, "b.model_id", "b.mean_corr")

