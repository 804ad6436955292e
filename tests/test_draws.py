import hashlib
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldspan.functions.draws import draw_exact, mark_exact, unit_draw
from fieldspan.operators import training
from fieldspan.operators.candidates import sample_candidates


def md5(seed, *parts):
    return hashlib.md5(":".join([str(seed), *map(str, parts)]).encode()).hexdigest()


def test_unit_draw_is_a_hash_of_the_key(spark):
    got = dict(spark.range(50).select("id", unit_draw(42, "id")).collect())
    assert got == {i: int(md5(42, i)[:8], 16) / 2**32 for i in range(50)}


@pytest.mark.parametrize("k", [0, 1, 17, 100, 250])
def test_exact_draw_is_the_k_smallest(spark, k):
    drawn = draw_exact(spark.range(100), ["id"], k, 7)
    expected = sorted(range(100), key=lambda i: md5(7, i))[:k]
    assert sorted(r.id for r in drawn.collect()) == sorted(expected)


def test_quota_per_stratum(spark):
    df = spark.range(300).withColumn("s", (F.col("id") % 3).cast("string"))
    quotas = spark.createDataFrame([("0", 10), ("1", 1000)], "s string, quota bigint")
    drawn = draw_exact(df, ["id"], quotas, 3, strata=["s"])
    got = {s: sorted(r.id for r in drawn.filter(F.col("s") == s).collect()) for s in "012"}
    assert got["0"] == sorted(sorted(range(0, 300, 3), key=lambda i: md5(3, i))[:10])
    assert got["1"] == list(range(1, 300, 3))
    assert got["2"] == []


def test_hot_key_is_split_by_number(spark):
    """A key with a third of all rows: copies are counted, and the draw stays exact."""
    hot = spark.range(4000).select(F.lit(-1).cast("bigint").alias("id"), F.lit("same").alias("text"))
    cold = spark.range(8000).select("id", F.lit("other").alias("text"))
    df = hot.unionByName(cold)
    for k in (100, 5000, 6000, 9000, 11999):
        marked = mark_exact(df, ["id"], k, 5, "drawn")
        total, drawn = marked.agg(F.count(F.lit(1)), F.count_if("drawn")).first()
        assert (total, drawn) == (12000, k)
    # Rows of one key with different content are kept apart.
    mixed = spark.range(1000).select(F.lit(1).alias("key"), "id")
    kept = draw_exact(mixed, ["key"], 400, 5)
    assert kept.count() == 400 and kept.distinct().count() == 400


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 8), min_size=1, max_size=60), st.integers(0, 70))
def test_draw_of_repeated_keys_has_the_wanted_size(spark, keys, k):
    df = spark.createDataFrame([(x,) for x in keys], "key int")
    assert draw_exact(df, ["key"], k, 1).count() == min(k, len(keys))


def _training(spark, n_seed, n_manual, n_random):
    levels = ["SEED"] * n_seed + ["ANTISEED-manual"] * n_manual + ["ANTISEED-AF"] * n_random + ["PC", None]
    return spark.createDataFrame([(i, x) for i, x in enumerate(levels)], "key int, expansion_level string")


def test_balanced_split(spark):
    parts = training.split_train_test(_training(spark, 21, 4, 40), "key", 0.2, seed_share=0.5, draw_seed=1)
    counts = dict(parts.groupBy("expansion_level").count().collect())
    assert counts == {"SEED": 11, "ANTISEED-manual": 4, "ANTISEED-AF": 11}
    sides = dict(parts.groupBy("split").count().collect())
    assert sides == {"test": math.ceil(26 * 0.2), "train": 26 - math.ceil(26 * 0.2)}
    assert parts.select("key").distinct().count() == 26


def test_unbalanced_split_keeps_all_known_levels(spark):
    df = _training(spark, 5, 5, 2)
    parts = training.split_train_test(df, "key", 0.5, balanced=False, draw_seed=1)
    assert parts.count() == 12
    assert dict(training.unused_levels(df).collect()) == {"PC": 1, None: 1}


def test_too_few_random_antiseeds_fail(spark):
    with pytest.raises(Exception, match="fewer random antiseeds"):
        training.split_train_test(_training(spark, 5, 5, 2), "key", draw_seed=1).collect()


def test_sampling_plan_edges(spark):
    sizes = {"a": 99, "b": 100, "c": 175, "d": 250, "e": 1000}
    rows = [(t, "SEED") for t, n in sizes.items() for _ in range(n)] + [("a", "ANTISEED-manual")]
    labelled = spark.createDataFrame(rows, "technology string, expansion_level string")
    plan = {r.technology: r for r in training.sampling_plan(labelled).collect()}
    assert plan["a"].too_small and plan["a"].antiseed_size is None and plan["a"].share_test is None
    assert [plan[t].antiseed_size for t in "bcde"] == [1000, int(175 / (0.1 + 75 / 150 * 0.1)), 1250, 5000]
    assert [round(plan[t].share_test, 9) for t in "bcde"] == [0.5, 0.35, 0.2, 0.2]
    with pytest.raises(Exception, match="seed too small: a"):
        training.sampling_plan(labelled, strict=True).collect()


def test_share_split_polarity_and_small_seed(spark):
    df = spark.createDataFrame([(i, "SEED" if i < 250 else "ANTISEED-AF") for i in range(400)], "key int, expansion_level string")
    parts = training.split_by_share(df, "key", draw_seed=1)
    assert parts.filter("split = 'test'").count() == 80
    assert {(r.expansion_level, r.label) for r in parts.collect()} == {("SEED", 0), ("ANTISEED-AF", 1)}
    with pytest.raises(Exception, match="seed too small"):
        training.split_by_share(df.filter("key >= 200"), "key", draw_seed=1).collect()


def test_small_bins_are_kept_whole(spark):
    rows = [(i, str(i), "cpc" if i < 40 else "cpc,keyword" if i < 1000 else None) for i in range(1100)]
    df = spark.createDataFrame(rows, "family_id int, publication_number string, match string")
    got = sample_candidates(df, size_bin=100, draw_seed=2)
    counts = {r["match"]: (r["n"], r["b"], r["t"]) for r in got.groupBy("match").agg(F.count(F.lit(1)).alias("n"), F.max("nb_bin").alias("b"), F.max("nb_total").alias("t")).collect()}
    assert counts["cpc"] == (40, 40, 1000)
    assert 60 < counts["cpc,keyword"][0] < 150 and counts["cpc,keyword"][1:] == (960, 1000)
    assert None not in counts
