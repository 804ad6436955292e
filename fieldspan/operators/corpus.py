"""From publications to families."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspan.session import materialise


def listed_ids(ids: Column, copies: Column | None = None) -> Column:
    """Sorted ids as one comma-separated string, repeats included when ``copies`` is given."""
    if copies is None:
        return F.array_join(F.array_sort(F.collect_list(ids)), ",")
    repeated = F.array_repeat(ids, copies.cast("int"))
    return F.array_join(F.array_sort(F.flatten(F.collect_list(repeated))), ",")


def smallest_texts(wanted: DataFrame, group: str, texts: DataFrame, value: Column, key: str = "publication_number", rows: str | None = None) -> DataFrame:
    """(group, value): for each group of (group, key) the smallest value of its keys' rows in ``texts``.

    Rows are counted first, without their texts (or ``rows`` of a key are given). A group with
    one row gets its value by a join alone; values are compared only where some group has several. Runs when called.
    """
    if rows is None:
        wanted = wanted.join(texts.groupBy(key).agg(F.count(F.lit(1)).alias("__n")), key)
    sized = wanted.select(group, key, F.col(rows or "__n").alias("__n"))
    sized = materialise(sized.join(sized.groupBy(group).agg(F.sum("__n").alias("__rows")), group).select(group, key, "__rows"))
    valued = texts.select(key, value.alias("value"))

    def fetched(rows: DataFrame) -> DataFrame:
        return valued.join(rows.select(group, key), key).select(group, "value")

    several = sized.where("__rows > 1")
    if several.isEmpty():
        return fetched(sized)
    return fetched(sized.where("__rows = 1")).unionByName(fetched(several).groupBy(group).agg(F.min("value").alias("value")))


def _families(publications: DataFrame) -> DataFrame:
    """(publication_number, family_id): who belongs where, one row per publication."""
    known = publications.filter(F.col("family_id").isNotNull() & F.col("publication_number").isNotNull())
    return known.select("publication_number", "family_id").distinct()


def _cited_families(links: DataFrame, crossover: DataFrame) -> DataFrame:
    """Resolve (family_id, publication_number) to (family_id, other family).

    Links to publications outside the table are dropped: they have no family.
    """
    other = crossover.select("publication_number", F.col("family_id").alias("other"))
    return links.distinct().join(other, "publication_number").select("family_id", "other")


def publications_family(
    publications: DataFrame, research: DataFrame | None = None, strict_cross: bool = False
) -> DataFrame:
    """Family-level twin of a publication table.

    Earliest date; distinct publication numbers, countries, class codes, cited and
    citing families as sorted arrays (empty, never null); text of the families with
    forward citations as ``title \\n abstract``, taken from the first publication that
    has any (null when its title or abstract is). With ``strict_cross`` a publication
    lacking cpc or ipc codes contributes neither.

    All five roll-ups are one aggregation over (family, kind, value) facts, so the
    family key is shuffled once; sets shrink before they move.
    """
    known = publications.filter(F.col("family_id").isNotNull())
    cpc, ipc = (F.coalesce(F.col(c), F.array()) for c in ("cpc", "ipc"))
    keep = (F.size(cpc) > 0) & (F.size(ipc) > 0) if strict_cross else F.lit(True)

    def facts(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.cast("string").alias("value")))

    def codes(kind: str, column: Column) -> Column:
        return facts(kind, F.transform(F.when(keep, column).otherwise(F.array()), lambda c: c["code"]))

    own = F.concat(
        facts("publication", F.array("publication_number")),
        facts("country", F.array("country_code")),
        codes("cpc", cpc),
        codes("ipc", ipc),
    )
    rolled = known.select("family_id", "publication_date", F.inline(own))

    crossover = _families(publications)
    cites = known.select("family_id", F.explode("citation").alias("c")).select("family_id", "c.publication_number")
    cited = _cited_families(cites, crossover)

    def as_facts(links: DataFrame, kind: str) -> DataFrame:
        date = F.lit(None).cast("bigint").alias("publication_date")
        return links.select("family_id", date, F.lit(kind).alias("kind"), F.col("other").cast("string").alias("value"))

    rolled = rolled.unionByName(as_facts(cited, "citation"))
    text = F.lit(None).cast("string")
    if research is not None:
        cited_research = research.filter(F.size("cited_by") > 0).join(crossover, "publication_number")
        forward = cited_research.select("family_id", F.explode("cited_by").alias("c")).select(
            "family_id", "c.publication_number"
        )
        rolled = rolled.unionByName(as_facts(_cited_families(forward, crossover), "cited_by"))
        texts = cited_research.select(
            "family_id",
            F.lit(None).cast("bigint").alias("publication_date"),
            F.lit("text").alias("kind"),
            F.concat("title", F.lit("\n"), "abstract").alias("value"),
            F.col("publication_number").alias("first"),
        )
        rolled = rolled.unionByName(texts, allowMissingColumns=True)
        text = F.min_by(F.when(F.col("kind") == "text", F.col("value")), F.when(F.col("kind") == "text", F.col("first")))

    def members(kind: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("value"))))

    def structs(kind: str, field: str) -> Column:
        return F.transform(members(kind), lambda v: F.struct(v.alias(field)))

    return rolled.groupBy("family_id").agg(
        F.min("publication_date").alias("publication_date"),
        members("publication").alias("publication_number"),
        members("country").alias("country_code"),
        structs("cpc", "code").alias("cpc"),
        structs("ipc", "code").alias("ipc"),
        structs("citation", "family_id").alias("citation"),
        structs("cited_by", "family_id").alias("cited_by"),
        text.alias("abstract"),
    )


def alone_without_family(df: DataFrame, item: str = "publication_number") -> Column:
    """Group number that keeps rows without a family apart from each other.

    Grouped on a null family they would all land in one task and one cell; each of
    them stays a row of its own instead, still without a family.
    """
    return F.when(F.col("family_id").isNull(), F.col(item)).alias("__alone")


def family_abstract(publications: DataFrame, research: DataFrame) -> DataFrame:
    """One abstract per family that has any, with all its publication numbers.

    Null and empty abstracts are dropped first; of several the smallest is taken, so
    the answer is stable. ``has_abstract`` is never null.
    """
    usable = research.filter(F.col("abstract").isNotNull() & (F.col("abstract") != ""))
    members = publications.select("publication_number", "family_id")
    alone = alone_without_family(members)
    grouped = members.groupBy("family_id", alone).agg(listed_ids(F.col("publication_number").cast("string")).alias("publication_number"))
    # Only texts with their family's smallest beginning can be its smallest; the beginning is a number, so it is found without them.
    begins = F.conv(F.rpad(F.hex(F.substring(F.encode("abstract", "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    starts = usable.groupBy("publication_number").agg(F.min(begins).alias("begins"))
    placed = members.where("family_id is not null").join(starts, "publication_number")
    least = placed.groupBy("family_id").agg(F.min("begins").alias("begins"))
    wanted = placed.join(least, ["family_id", "begins"]).select("family_id", "publication_number").distinct()
    texts = smallest_texts(wanted, "family_id", usable, F.col("abstract")).withColumnRenamed("value", "abstract")
    return grouped.drop("__alone").join(texts, "family_id", "left").withColumn("has_abstract", F.col("abstract").isNotNull())


def crosswalk_number(places: DataFrame, applications: DataFrame) -> DataFrame:
    """Add the publication number of each application: ``authority-number-kind`` without blanks."""
    numbered = applications.filter(F.col("publn_nr").isNotNull() & (F.col("publn_nr") != ""))
    # A missing part makes the whole number null, as concatenation does.
    parts = F.concat(F.col("publn_auth"), F.lit("-"), F.col("publn_nr"), F.lit("-"), F.col("publn_kind"))
    numbers = numbered.select("appln_id", F.replace(parts, F.lit(" "), F.lit("")).alias("publication_number"))
    return places.join(numbers, "appln_id")


def flatten_nested(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """``[{code: [a, b]}]`` -> ``[{code: a}, {code: b}]`` for each variable; more than one element fails."""

    def flat(name: str) -> Column:
        struct = df.schema[name].dataType.elementType
        field = struct.fieldNames()[0]
        single = F.transform(F.get(F.col(name), F.lit(0))[field], lambda v: F.struct(v.alias(field)))
        too_many = F.raise_error(F.concat(F.lit(f"{name}: more than one element: "), F.to_json(name)))
        empty = F.array().cast(f"array<struct<{field}:{struct[field].dataType.elementType.simpleString()}>>")
        return (
            F.when(F.size(name) > 1, too_many.cast(empty_type(field, struct)))
            .when(F.size(name) == 1, F.coalesce(single, empty))
            .otherwise(empty)
        )

    def empty_type(field: str, struct) -> str:
        return f"array<struct<{field}:{struct[field].dataType.elementType.simpleString()}>>"

    return df.withColumns({name: flat(name) for name in variables})
