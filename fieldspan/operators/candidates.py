"""Candidates for the seed: similar items, class codes, keywords; their sample and options."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspan.functions.copies import written_out
from fieldspan.functions.draws import fresh_seed, unit_draw
from fieldspan.functions.predicates import has_prefix, holds_keyword
from fieldspan.operators.corpus import alone_without_family, listed_ids, smallest_texts
from fieldspan.session import materialise

_CANDIDATE = ["publication_number", "title", "abstract"]


def similar_candidates(research: DataFrame, listed: DataFrame) -> DataFrame:
    """Items similar to the listed ones, as often as they are named; unknown ones drop.

    ``listed`` is a table of publication numbers of any length, so a long list is a
    join and not an expression.
    """
    named = research.join(listed.select("publication_number").distinct(), "publication_number", "left_semi")
    similar = named.select(F.explode("similar").alias("s")).select(F.col("s.publication_number"))
    # Repeats of a hot item are summed before they meet the texts, and written out in blocks of copies.
    counted = similar.filter(F.col("publication_number").isNotNull()).groupBy("publication_number").agg(F.count(F.lit(1)).alias("n"))
    copies = written_out(materialise(counted), "n", "__copy")
    found = research.select(*_CANDIDATE).join(copies.select("publication_number"), "publication_number")
    return found.select(*_CANDIDATE, F.lit("patent").alias("match"))


def keyword_candidates(research: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Items whose abstract holds a keyword."""
    return research.filter(holds_keyword("abstract", keywords)).select(*_CANDIDATE, F.lit("keyword").alias("match"))


def class_candidates(research: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Items with a code under a prefix, one row per such code."""
    hits = F.filter(F.col("cpc"), lambda c: has_prefix(c["code"], prefixes))
    return research.select(*_CANDIDATE, F.explode(hits).alias("hit")).select(*_CANDIDATE, F.lit("cpc").alias("match"))


def all_candidates(
    research: DataFrame, listed: DataFrame, keywords: Sequence[str], prefixes: Sequence[str]
) -> DataFrame:
    """The three kinds of candidates, repeats kept."""
    return (
        similar_candidates(research, listed)
        .unionByName(class_candidates(research, prefixes))
        .unionByName(keyword_candidates(research, keywords))
    )


def family_candidates(candidates: DataFrame, publications: DataFrame) -> DataFrame:
    """Candidates by family: ids (with repeats), one text, the distinct sources, number of rows.

    Rows of the same item and source are summed first, so an item matched many times
    moves once. The text is that of the family's first publication. Candidates without
    a family stay one row per item, with a null family.
    """
    # One text per item: copies of an item carry the same one.
    rows = candidates.groupBy("publication_number", "match").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("title", "abstract")).alias("t"),
    )
    families = publications.select("publication_number", "family_id")
    joined = rows.join(families, "publication_number", "left")
    grouped = joined.groupBy("family_id", alone_without_family(joined)).agg(
        listed_ids(F.col("publication_number").cast("string"), F.col("n")).alias("ids"),
        F.min_by("t", F.struct("publication_number", "match")).alias("t"),
        F.array_join(F.array_sort(F.collect_set("match")), ",").alias("match"),
        F.sum("n").alias("match_number"),
    )
    return grouped.select(
        "family_id",
        F.col("ids").alias("publication_number"),
        F.concat("t.title", F.lit("\n\n"), "t.abstract").alias("text"),
        "match",
        "match_number",
    )


def counted_candidates(research: DataFrame, listed: DataFrame, keywords: Sequence[str], prefixes: Sequence[str]) -> DataFrame:
    """(publication_number, match, n): all candidates, repeats as numbers, no texts.

    Keyword and class hits come from one scan; an item named many times is one row.
    """
    asked = listed.select("publication_number").distinct().withColumn("__asked", F.lit(True))
    classes = F.coalesce(F.size(F.filter(F.col("cpc"), lambda c: has_prefix(c["code"], prefixes))), F.lit(0)).cast("bigint")
    words = F.coalesce(holds_keyword("abstract", keywords), F.lit(False)).cast("bigint")
    named = F.when(F.col("__asked"), F.transform("similar", lambda x: x["publication_number"]))
    # The only look at the texts; all else reads these narrow rows.
    facts = research.join(asked, "publication_number", "left").select("publication_number", named.alias("named"), classes.alias("cpc"), words.alias("keyword"))
    facts = materialise(facts)
    similar = facts.select(F.explode("named").alias("publication_number")).where("publication_number is not null")
    similar = similar.groupBy("publication_number").agg(F.count(F.lit(1)).alias("n"))
    # An item is found as often as it is named and has rows.
    rows = facts.groupBy("publication_number").agg(F.count(F.lit(1)).alias("rows"), F.sum("cpc").alias("cpc"), F.sum("keyword").alias("keyword"))
    found = rows.join(similar, "publication_number", "left").withColumn("patent", F.col("n") * F.col("rows"))
    kinds = F.array(*[F.struct(F.lit(kind).alias("match"), F.col(kind).alias("n")) for kind in ("patent", "cpc", "keyword")])
    return found.select("publication_number", F.inline(F.filter(kinds, lambda k: k["n"] > 0)))


def candidate_families(counted: DataFrame, publications: DataFrame, research: DataFrame) -> DataFrame:
    """:func:`family_candidates` of counted candidates: ids and numbers are rolled up first, the texts joined last."""
    families = publications.select("publication_number", "family_id")
    joined = counted.join(families, "publication_number", "left")
    grouped = joined.groupBy("family_id", alone_without_family(joined)).agg(
        listed_ids(F.col("publication_number").cast("string"), F.col("n")).alias("ids"),
        F.min("publication_number").alias("publication_number"),
        F.array_join(F.array_sort(F.collect_set("match")), ",").alias("match"),
        F.sum("n").alias("match_number"),
    )
    grouped = materialise(grouped.withColumn("__family", F.monotonically_increasing_id()))
    texts = smallest_texts(grouped.select("__family", "publication_number"), "__family", research, F.struct("title", "abstract"))
    return grouped.join(texts, "__family").select(
        "family_id",
        F.col("ids").alias("publication_number"),
        F.concat("value.title", F.lit("\n\n"), "value.abstract").alias("text"),
        "match",
        "match_number",
    )


def sample_candidates(
    candidates: DataFrame,
    size_bin: int = 500,
    draw_seed: int | str | None = None,
    on: Sequence[str] = ("family_id", "publication_number"),
    shuffled: bool = False,
) -> DataFrame:
    """About ``size_bin`` candidates per kind of match; smaller kinds are kept whole.

    The bins are the sets of sources. The random order is a global sort and therefore only made on request. The
    candidates are staged, since they are counted before they are drawn.
    """
    seed = fresh_seed(draw_seed)
    candidates = materialise(candidates)
    bins = candidates.filter(F.col("match").isNotNull()).groupBy("match").agg(F.count("match").alias("nb_bin"))
    total = bins.agg(F.sum("nb_bin")).scalar()
    bins = bins.select("match", "nb_bin", total.alias("nb_total"))
    draw = unit_draw(seed, *on)
    drawn = candidates.join(bins, "match").filter(draw < F.lit(float(size_bin)) / F.col("nb_bin"))
    return drawn.orderBy(unit_draw(f"{seed}-order", *on)) if shuffled else drawn


def with_options(records: DataFrame, options: Sequence[str]) -> DataFrame:
    """Add the annotation options as ``[{id, text}]``; no options, no column."""
    if not options:
        return records
    numbered = [F.struct(F.lit(i).alias("id"), F.lit(text).alias("text")) for i, text in enumerate(options)]
    return records.withColumn("options", F.array(*numbered))
