"""Training tables, extraction, joins and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspan.functions.copies import written_out
from fieldspan.functions.draws import draw_exact, fresh_seed, mark_exact
from fieldspan.functions.predicates import is_labelled
from fieldspan.operators.expansion import MANUAL, RANDOM_NEGATIVE, SEED
from fieldspan.session import materialise

# The sizes between which shares move, and the shares.
MIN_SEED, ENOUGH_SEED = 100, 250
SEED_SHARE_LOW, SEED_SHARE_HIGH = 0.1, 0.2
TEST_SHARE_HIGH, TEST_SHARE_LOW = 0.5, 0.2
EMPTY_TEXTS = ["", "\n", "\n\n"]

_MEMBER, _TEXT, _TIMES, _COPY = "__member", "__text", "__times", "__copy"


def training_table(
    labelled: DataFrame,
    corpus: DataFrame,
    expansion: DataFrame,
    size: int | DataFrame,
    key: str,
    draw_seed: int | str | None = None,
    exclude_expansion: bool = True,
) -> DataFrame:
    """Labelled rows and ``size`` random corpus rows with a text, as ANTISEED-AF.

    ``size`` is a number, or a one-row table (quota) when it follows from the data. The
    random rows come from outside the expansion unless told otherwise.
    """
    is_seed = (F.col("expansion_level") == SEED).cast("int")
    negative = F.col("expansion_level").like("ANTISEED%").cast("int")
    manual = labelled.filter(is_labelled()).select(
        key,
        "expansion_level",
        is_seed.alias("is_seed"),
        F.struct(is_seed.alias("SEED"), negative.alias("NOT_SEED")).alias("cats"),
        "text",
    )
    pool = corpus.filter(F.col("abstract").isNotNull() & (F.col("abstract") != "")).select(key, "abstract")
    if exclude_expansion:
        pool = pool.join(expansion.select(key), key, "left_anti")
    # Rows are drawn by key and a hash of their text, and texts fetched for those drawn: equal
    # rows of a repeated key are written out as often as they were drawn.
    pool = pool.withColumn(_TEXT, F.xxhash64("abstract"))
    drawn = draw_exact(pool.select(key, _TEXT), [key], size, draw_seed).groupBy(key, _TEXT).agg(F.count("*").alias(_TIMES))
    fetched = pool.join(drawn, [key, _TEXT]).dropDuplicates([key, _TEXT])
    random = _repeated(fetched).select(
        key,
        F.lit(RANDOM_NEGATIVE).alias("expansion_level"),
        F.lit(0).alias("is_seed"),
        F.struct(F.lit(0).alias("SEED"), F.lit(1).alias("NOT_SEED")).alias("cats"),
        F.col("abstract").alias("text"),
    )
    return manual.unionByName(random)


def expansion_texts(
    expansion: DataFrame,
    corpus: DataFrame,
    key: str,
    sample_size: int | None = None,
    draw_seed: int | str | None = None,
) -> DataFrame:
    """Unlabelled members of the expansion with their text, or an exact sample of them."""
    members = expansion.filter(~is_labelled())
    texts = corpus.filter(F.col("abstract").isNotNull() & ~F.col("abstract").isin(EMPTY_TEXTS)).select(
        key, F.col("abstract").alias("text")
    )
    if sample_size is None:
        return members.join(texts, key)
    # The sample is one of the joined rows, so the pair of rows is what is drawn.
    members, texts = members.withColumn(_MEMBER, F.xxhash64(*members.columns)), texts.withColumn(_TEXT, F.xxhash64("text"))
    pairs = members.select(key, _MEMBER).join(texts.select(key, _TEXT), key)
    drawn = draw_exact(pairs, [key], sample_size, draw_seed).groupBy(key, _MEMBER, _TEXT).agg(F.count("*").alias(_TIMES))
    drawn = drawn.join(members.join(drawn.select(key).distinct(), key, "left_semi").dropDuplicates([key, _MEMBER]), [key, _MEMBER])
    fetched = texts.join(drawn.select(key, _TEXT).distinct(), [key, _TEXT], "left_semi").dropDuplicates([key, _TEXT])
    return _repeated(drawn.join(fetched, [key, _TEXT])).drop(_MEMBER, _TEXT, _TIMES)


def _repeated(drawn: DataFrame) -> DataFrame:
    """Every row as often as it was drawn."""
    return written_out(drawn, _TIMES, _COPY).drop(_COPY)


def join_tables(
    left: DataFrame,
    right: DataFrame,
    on: str,
    how: str = "inner",
    right_vars: Sequence[str] | None = None,
    abstract2text: bool = False,
) -> DataFrame:
    """All left columns and the chosen right ones (all but the key by default).

    The key is the left one: null where only the right side has it. ``abstract2text``
    renames the right abstract, unless columns are chosen.
    """
    how = {"inner": "inner", "outer": "full", "full": "full", "left": "left", "right": "right"}[how.lower()]
    wanted = list(right_vars) if right_vars else [c for c in right.columns if c != on]
    renamed = {"abstract": "text"} if abstract2text and not right_vars else {}
    taken = [F.col(f"r.{c}").alias(renamed.get(c, c)) for c in wanted]
    joined = left.alias("l").join(right.alias("r"), F.col(f"l.{on}") == F.col(f"r.{on}"), how)
    return joined.select("l.*", *taken)


def split_train_test(
    training: DataFrame,
    key: str,
    test_ratio: float = 0.2,
    seed_share: float = 1.0,
    balanced: bool = True,
    draw_seed: int | str | None = None,
) -> DataFrame:
    """Add ``split``: test for exactly ceil(rows x ratio) random rows, train for the rest.

    Balanced: ceil(seeds x seed_share) rows of each of the three strata; manual antiseeds
    are kept whole when too few, random ones too few fail. Other levels are dropped, see
    :func:`unused_levels`. A draw reads its input more than once, so the rows are staged
    in the shared folder.
    """
    seed = fresh_seed(draw_seed)
    level = F.col("expansion_level")
    rows = materialise(training.filter(level.isin(SEED, MANUAL, RANDOM_NEGATIVE)))
    if balanced:
        sizes = rows.agg(
            F.ceil(F.count_if(level == SEED) * F.lit(float(seed_share))).cast("bigint").alias("k"),
            F.count_if(level == RANDOM_NEGATIVE).alias("n_random"),
        )
        short = F.raise_error(F.lit("fewer random antiseeds than seeds to balance")).cast("bigint")
        strata = F.array(*[F.lit(s) for s in (SEED, MANUAL, RANDOM_NEGATIVE)])
        quotas = sizes.select(
            F.when(F.col("n_random") < F.col("k"), short).otherwise(F.col("k")).alias("quota"),
            F.explode(strata).alias("expansion_level"),
        )
        rows = materialise(draw_exact(rows, [key], quotas, f"{seed}-balance", strata=["expansion_level"]))
    n_test = rows.agg(F.ceil(F.count(F.lit(1)) * F.lit(float(test_ratio))).cast("bigint").alias("quota"))
    marked = mark_exact(rows, [key], n_test, f"{seed}-test", "__test")
    return marked.withColumn("split", F.when(F.col("__test"), F.lit("test")).otherwise(F.lit("train"))).drop("__test")


def unused_levels(training: DataFrame) -> DataFrame:
    """Rows that a split leaves out, counted by level."""
    known = F.col("expansion_level").isin(SEED, MANUAL, RANDOM_NEGATIVE)
    return training.filter(~F.coalesce(known, F.lit(False))).groupBy("expansion_level").agg(F.count(F.lit(1)).alias("n"))


def _slope(n: Column, start: float, end: float, low: int = MIN_SEED, high: int = ENOUGH_SEED) -> Column:
    """From ``start`` at ``low`` to ``end`` at ``high`` and above; null below."""
    line = F.lit(start) + (n - F.lit(low)) / F.lit(float(high - low)) * F.lit(end - start)
    return F.when((n >= low) & (n < high), line).when(n >= high, F.lit(end))


def sample_size(n_seed: Column, low: int = MIN_SEED, high: int = ENOUGH_SEED) -> Column:
    """Sample in which the seed is 10% (small seeds) to 20%; null when the seed is too small."""
    return F.floor(n_seed / _slope(n_seed, SEED_SHARE_LOW, SEED_SHARE_HIGH, low, high)).cast("bigint")


def test_share(n_seed: Column, low: int = MIN_SEED, high: int = ENOUGH_SEED) -> Column:
    """Share of test rows, from 50% (small seeds) to 20%; null when the seed is too small."""
    return _slope(n_seed, TEST_SHARE_HIGH, TEST_SHARE_LOW, low, high)


test_share.__test__ = False


def sampling_plan(labelled: DataFrame, by: str = "technology", strict: bool = False) -> DataFrame:
    """(technology, n_seed, antiseed_size, share_test, too_small); ``strict`` fails on small seeds."""
    counted = labelled.groupBy(by).agg(F.count_if(F.col("expansion_level") == SEED).alias("n_seed"))
    n = F.col("n_seed")
    plan = counted.select(
        by,
        "n_seed",
        sample_size(n).alias("antiseed_size"),
        test_share(n).alias("share_test"),
        (n < MIN_SEED).alias("too_small"),
    )
    if strict:
        failure = F.raise_error(F.concat(F.lit("seed too small: "), F.col(by).cast("string")))
        plan = plan.withColumn("too_small", F.when(F.col("too_small"), failure.cast("boolean")).otherwise(F.lit(False)))
    return plan


def split_by_share(labelled: DataFrame, key: str, draw_seed: int | str | None = None) -> DataFrame:
    """Add ``label`` (0 = seed, 1 = other) and ``split``, with the test share of the seed's size.

    A seed below the minimum fails.
    """
    is_seed = F.col("expansion_level") == SEED
    rows = labelled.withColumn("label", F.when(is_seed, F.lit(0)).otherwise(F.lit(1)))
    counts = rows.agg(F.count_if(is_seed).alias("n_seed"), F.count(F.lit(1)).alias("n"))
    share = test_share(F.col("n_seed"))
    failure = F.raise_error(F.lit("seed too small")).cast("double")
    n_test = counts.select(F.ceil(F.col("n") * F.coalesce(share, failure)).cast("bigint").alias("quota"))
    marked = mark_exact(rows, [key], n_test, f"{fresh_seed(draw_seed)}-share", "__test")
    return marked.withColumn("split", F.when(F.col("__test"), F.lit("test")).otherwise(F.lit("train"))).drop("__test")
