"""Descriptive statistics by country, year, entity and place."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspan.session import materialise

OTHERS = "others"


def publication_year(date: str | Column = "publication_date") -> Column:
    """Year of a yyyymmdd number."""
    number = F.col(date) if isinstance(date, str) else date
    return F.floor(number / F.lit(10000)).cast("bigint")


def densify(df: DataFrame, group: str, measure: Column, n_keep: int) -> DataFrame:
    """Keep the ``n_keep`` categories of largest ``measure`` (an aggregate), pool the rest as others.

    Null and empty categories are pooled and take no place; ties go by name. The kept
    names are broadcast: there are ``n_keep`` of them.
    """
    named = df.filter(F.col(group).isNotNull() & (F.col(group) != ""))
    top = named.groupBy(group).agg(measure.alias("__m")).orderBy(F.col("__m").desc_nulls_last(), group).limit(n_keep)
    kept = F.broadcast(top.select(F.col(group).alias("__kept")))
    joined = df.join(kept, F.col(group) == F.col("__kept"), "left")
    return joined.withColumn(group, F.coalesce("__kept", F.lit(OTHERS))).drop("__kept")


def normalised_counts(
    df: DataFrame, groups: Sequence[str], measure: Column | None = None, norm_axis: int = 0
) -> DataFrame:
    """(groups..., count, normalized_count): share of the total within the first group
    (axis 0) or ratio to the largest within the second (axis 1).

    The totals are joined rather than taken over a window, which would sort all
    categories of one group in one task.
    """
    counts = df.dropna(subset=list(groups)).groupBy(*groups).agg(
        (F.count(F.lit(1)) if measure is None else measure).alias("count")
    )
    axis = groups[norm_axis]
    base = F.sum("count") if norm_axis == 0 else F.max("count")
    bases = counts.groupBy(axis).agg(base.alias("__base"))
    return counts.join(bases, axis).select(
        *groups, "count", F.try_divide(F.col("count"), F.col("__base")).alias("normalized_count")
    )


def entity_weights(
    entities: DataFrame, publications: DataFrame, flavor: str, publication: str = "publication_number"
) -> DataFrame:
    """Entities with their publication's facts and ``nb_<flavor>``, the weight of one entity:
    one over the largest number of filled values of any column within the publication.
    """
    joined = entities.join(publications, publication, "left")
    columns = [c for c in joined.columns if c != publication]
    filled = [F.count(c) for c in columns]
    most = F.greatest(*filled) if len(filled) > 1 else filled[0]
    weights = joined.groupBy(publication).agg((F.lit(1.0) / F.when(most > 0, most)).alias(f"nb_{flavor}"))
    return joined.join(weights, publication, "left")


def harmonised(df: DataFrame, flavor: str) -> DataFrame:
    """Column names without the flavor as prefix or suffix."""
    return df.toDF(*[c.removeprefix(f"{flavor}_").removesuffix(f"_{flavor}") for c in df.columns])


def geo_union(
    inventor_places: DataFrame,
    applicant_places: DataFrame,
    inventors: DataFrame,
    assignees: DataFrame,
    publication: str = "publication_number",
) -> DataFrame:
    """Places of inventors and applicants with their entities' facts, under the same names."""
    inventor = inventor_places.withColumn("type", F.lit("inventor")).join(inventors, publication, "left")
    applicant = applicant_places.withColumn("type", F.lit("applicant")).join(assignees, publication, "left")
    return harmonised(inventor, "inventor").unionByName(harmonised(applicant, "assignee"), allowMissingColumns=True)


def country_date_counts(publications: DataFrame) -> DataFrame:
    """(kind, publication_year, expansion_level, country_code, count, normalized_count): all counts as one table.

    Kinds: country, year, year_level, year_country, and year_country_normalised with the ratio to the
    country's best year. Columns that a kind does not group by are null. Rows without a positive
    year count for their country only; groups with a missing value are left out. The
    publications are counted once, by all three columns; the rest adds up those counts.
    """
    year = F.when(F.col("publication_year") > 0, F.col("publication_year")).alias("publication_year")
    columns = ["publication_year", "expansion_level", "country_code"]
    finest = publications.select(year, *columns[1:]).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    sets = {"country": columns[2:], "year": columns[:1], "year_level": columns[:2], "year_country": [columns[0], columns[2]]}
    counted = _by_sets(finest, columns, sets, F.sum("n"))
    best = F.max("count").over(Window.partitionBy("kind", "country_code"))
    ratio = counted.withColumn("best", best).where("kind = 'year_country'")
    ratio = ratio.select(F.lit("year_country_normalised").alias("kind"), *columns, "count", F.try_divide(F.col("count"), F.col("best")).alias("normalized_count"))
    return counted.withColumn("normalized_count", F.lit(None).cast("double")).unionByName(ratio)


def _by_sets(df: DataFrame, columns: Sequence[str], sets: dict[str, list[str]], measure: Column) -> DataFrame:
    """(kind, columns..., count) of several groupings in one aggregation; groups with a null among their columns are left out."""
    bit = {name: 1 << (len(columns) - 1 - i) for i, name in enumerate(columns)}
    grouped = df.groupingSets([[F.col(c) for c in own] for own in sets.values()], *columns)
    counted = grouped.agg(F.grouping_id().alias("__absent"), measure.alias("count"))
    kind, whole = F.lit(None).cast("string"), F.lit(False)
    for name, own in sets.items():
        here = F.col("__absent") == sum(b for c, b in bit.items() if c not in own)
        kind = F.when(here, F.lit(name)).otherwise(kind)
        whole = F.when(here, reduce(Column.__and__, [F.col(c).isNotNull() for c in own])).otherwise(whole)
    return counted.where(whole).select(kind.alias("kind"), *columns, "count")


def entity_counts(entities: DataFrame, flavor: str, n_keep: int = 10) -> DataFrame:
    """(kind, publication_year, country, name, count): weighted counts by the entity's country and name, in all and by year.

    Countries and names beyond the ``n_keep`` of largest weight are others. The entities are
    summed once, by year, country and name, into a staged table; what to keep and all
    counts come from it. Rows without a year have no part in counts by year. Runs when called.
    """
    columns = ["publication_year", "country", "name"]
    weighed = entities.select("publication_year", F.col(f"{flavor}_country").alias("country"), F.col(f"{flavor}_name").alias("name"), F.col(f"nb_{flavor}").alias("w"))
    finest = materialise(weighed.groupBy(*columns).agg(F.sum("w").alias("w")))
    dense = densify(densify(finest, "country", F.sum("w"), n_keep), "name", F.sum("w"), n_keep)
    sets = {"country": ["country"], "year_country": ["publication_year", "country"], "name": ["name"], "year_name": ["publication_year", "name"]}
    return _by_sets(dense, columns, sets, F.sum("w"))


def place_counts(places: DataFrame, ordered: bool = False) -> DataFrame:
    """Rows per place, kind of party and year."""
    groups = ["name", "type", "lat", "lng", "publication_year"]
    counted = places.dropna(subset=groups).groupBy(*groups).agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy("publication_year") if ordered else counted
