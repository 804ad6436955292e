"""Expansion of a labelled seed along class codes and citations.

The operators work on narrow tables: ``codes`` (key, publication_date, code) and
``links`` (key, target, kind). :func:`class_pairs` and :func:`citation_links` cut
them out of a nested publication table; both are one projection without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspan.functions.draws import draw_exact, fresh_seed, unit_draw
from fieldspan.functions.predicates import holds_code, in_countries, is_labelled
from fieldspan.session import bucketed, materialise, small_shuffles

# The level vocabulary.
SEED, MANUAL, RANDOM_NEGATIVE, CLOSE_NEGATIVE = "SEED", "ANTISEED-manual", "ANTISEED-AF", "ANTISEED-AUG"
PC = "PC"
BACK, FOR = "BACK", "FOR"

#: Links from which on a key is a hub, and hubs that may be looked up by a broadcast.
HUB_LINKS, MOST_HUBS = 100_000, 1_000_000


def citation_levels(depth: int) -> list[str]:
    return [f"L{i}-{kind}" for i in range(1, depth + 1) for kind in (BACK, FOR)]


def class_pairs(publications: DataFrame, key: str, cls: str) -> DataFrame:
    """(key, publication_date, code), one row per listed code."""
    return publications.select(key, "publication_date", F.explode(cls).alias("entry")).select(
        key, "publication_date", F.col("entry.code").alias("code")
    )


def citation_links(backward: DataFrame, key: str, forward: DataFrame | None = None) -> DataFrame:
    """(key, target, kind) from the ``citation`` and ``cited_by`` arrays.

    At publication level the forward arrays sit in another table, given as ``forward``.
    """

    def side(table: DataFrame, column: str, kind: str) -> DataFrame:
        return table.select(F.col(key).alias("key"), F.explode(column).alias("other")).select(
            "key", F.col(f"other.{key}").alias("target"), F.lit(kind).alias("kind")
        )

    if forward is None:
        forward = backward
    links = side(backward, "citation", BACK).unionByName(side(forward, "cited_by", FOR))
    return links.filter(F.col("target").isNotNull())


def both_directions(pairs: DataFrame, citing: str, cited: str) -> DataFrame:
    """(key, target, kind) from plain citation pairs: each is read once and used both ways."""
    ways = F.array(
        F.struct(F.col(citing).alias("key"), F.col(cited).alias("target"), F.lit(BACK).alias("kind")),
        F.struct(F.col(cited).alias("key"), F.col(citing).alias("target"), F.lit(FOR).alias("kind")),
    )
    return pairs.filter(F.col(citing).isNotNull() & F.col(cited).isNotNull()).select(F.inline(ways))


def seed_block(
    labelled: DataFrame, key: str, share: float | None = None, draw_seed: int | str | None = None
) -> DataFrame:
    """(key, expansion_level) of seed and antiseed rows, or a random share of them.

    A share of 0 means no sampling, like no share at all.
    """
    block = labelled.filter(is_labelled()).select(key, "expansion_level")
    if share:
        block = block.filter(unit_draw(fresh_seed(draw_seed), key) < F.lit(float(share)))
    return block


def _seed_members(block: DataFrame, key: str) -> DataFrame:
    """Seed keys with the number of their rows: repeats are summed before any join."""
    seeds = block.filter((F.col("expansion_level") == SEED) & F.col(key).isNotNull())
    return seeds.groupBy(key).agg(F.count(F.lit(1)).alias("copies"))


def seed_class_freq(block: DataFrame, codes: DataFrame, key: str) -> DataFrame:
    """Frequency of each code among the SEED rows.

    ``n_patents`` counts all SEED rows, those without a corpus entry included; a code
    listed twice by one member counts twice.
    """
    members = _seed_members(block, key)
    total = members.agg(F.coalesce(F.sum("copies"), F.lit(0))).scalar()
    found = codes.select(key, "code").join(members, key)
    counted = found.groupBy("code").agg(F.sum(F.when(F.col("code").isNotNull(), F.col("copies")).otherwise(0)).alias("n"))
    return counted.select("code", "n", total.alias("n_patents")).withColumn("freq", F.col("n") / F.col("n_patents"))


def seed_year_window(block: DataFrame, publications: DataFrame, key: str) -> DataFrame:
    """One row (p25, p75): quartiles of the publication year of SEED rows found in the corpus.

    The exact quantile keeps one counter per distinct year, which is a few hundred at most.
    """
    seeds = block.filter(F.col("expansion_level") == SEED).select(key)
    dated = publications.select(key, F.expr("publication_date div 10000").alias("year")).join(seeds, key)
    return dated.agg(
        F.expr("percentile_disc(0.25) WITHIN GROUP (ORDER BY year)").cast("bigint").alias("p25"),
        F.expr("percentile_disc(0.75) WITHIN GROUP (ORDER BY year)").cast("bigint").alias("p75"),
    )


def universe_class_freq(codes: DataFrame, publications: DataFrame, window: DataFrame) -> DataFrame:
    """Frequency of each code among publications dated within the seed's year window.

    The bounds are whole years times 10000, so the year p75 itself is left out but for
    a date of exactly that number. Codes carry their date, so no join is needed, and
    the bounds are scalar subqueries that reach the scan as pushed filters.
    """
    low = window.select(F.col("p25") * 10000).scalar()
    high = window.select(F.col("p75") * 10000).scalar()
    inside = F.col("publication_date").between(low, high)
    total = publications.filter(inside).agg(F.count(F.lit(1))).scalar()
    counted = codes.filter(inside).groupBy("code").agg(F.count("code").alias("n"))
    return counted.select("code", "n", total.alias("n_patents")).withColumn("freq", F.col("n") / F.col("n_patents"))


def class_odds(seed_freq: DataFrame, universe_freq: DataFrame) -> DataFrame:
    """Ratio of a code's frequency in the seed to that in the universe; unseen codes drop."""
    seeds = seed_freq.filter(F.col("code").isNotNull()).select("code", F.col("freq").alias("seed_freq"))
    universe = universe_freq.select("code", F.col("freq").alias("universe_freq"))
    return seeds.join(universe, "code").withColumn("odds", F.col("seed_freq") / F.col("universe_freq"))


def top_classes(odds: DataFrame, n_pc: int) -> DataFrame:
    """The ``n_pc`` codes of highest odds; ties go by code."""
    return odds.orderBy(F.col("odds").desc(), "code").limit(n_pc)


def class_expansion(odds: DataFrame, codes: DataFrame, key: str, n_pc: int, keep_unmatched: bool = False) -> DataFrame:
    """Distinct keys with one of the ``n_pc`` codes of highest odds, level PC.

    With ``keep_unmatched`` a code nobody has yields one row without a key. The listed
    codes are broadcast: there are ``n_pc`` of them, whatever the corpus size.
    """
    top = top_classes(odds, n_pc).select("code")
    pairs = codes.select(key, "code")
    found = pairs.join(F.broadcast(top), "code").select(key)
    if keep_unmatched:
        lost = top.join(pairs, "code", "left_anti").select(F.lit(None).cast(codes.schema[key].dataType).alias(key))
        found = found.unionByName(lost)
    return found.distinct().withColumn("expansion_level", F.lit(PC))


def full_class_expansion(
    block: DataFrame,
    publications: DataFrame,
    codes: DataFrame,
    key: str,
    n_pc: int = 50,
    odds: DataFrame | None = None,
    keep_unmatched: bool = False,
) -> DataFrame:
    """Odds from seed and universe frequencies, unless given, then the class expansion."""
    if odds is None:
        window = seed_year_window(block, publications, key)
        odds = class_odds(seed_class_freq(block, codes, key), universe_class_freq(codes, publications, window))
    return class_expansion(odds, codes, key, n_pc, keep_unmatched)


class StoredLinks(NamedTuple):
    """Links written for several rounds or runs: a table bucketed by key, and apart from it the links of hubs.

    A bucket is read by one task, so a key with a large part of all links must not lie in one:
    hubs are plain rows, joined with the few hubs that a frontier holds.
    """

    stored: DataFrame
    hubs: DataFrame
    hub_keys: DataFrame

    def reached(self, start: DataFrame, how: str) -> DataFrame:
        """Links of the keys in ``start``. Only ``start`` moves."""
        known = start.join(self.hub_keys, "key", "left_semi" if how == "left_semi" else "inner")
        return self.stored.join(start, "key", how).unionByName(self.hubs.join(F.broadcast(known), "key", how))


def store_links(links: DataFrame, buckets: int, hub: int = HUB_LINKS) -> StoredLinks:
    """Write links (key, target, ...) by key, for expansions that follow them more than once.

    A key with more than ``hub`` links is a hub; there are at most as many as ``hub`` goes into the links, and
    no more than ``MOST_HUBS`` of them, since a frontier's hubs are broadcast: with more, ``hub`` is doubled. Runs when called.
    """
    rows = links.where(F.col("key").isNotNull() & F.col("target").isNotNull())
    counted = materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hub))
    while counted.where(F.col("__n") > hub).limit(MOST_HUBS + 1).count() > MOST_HUBS:
        hub *= 2
    hubs = F.broadcast(counted.where(F.col("__n") > hub).select("key"))
    stored = bucketed(rows.join(hubs, "key", "left_anti"), "key", buckets)
    return StoredLinks(stored, materialise(rows.join(hubs, "key", "left_semi")), counted.where(F.col("__n") > hub).select("key"))


def follow(links: DataFrame | StoredLinks, start: DataFrame, how: str = "left_semi") -> DataFrame:
    """Links of the keys in ``start``, with its columns if ``how`` is inner."""
    if isinstance(links, StoredLinks):
        return links.reached(start, how)
    return links.join(start, "key", how).filter(F.col("target").isNotNull())


def _neighbours(frontier: DataFrame, links: DataFrame | StoredLinks, key: str) -> DataFrame:
    """(key, back, for): who is reached from the frontier, and in which directions.

    The frontier is only looked up (semi join), so it needs no distinct; the links are
    the streamed side, which adaptive execution splits when a hub is hot, or lie
    stored by key and do not move. Grouping by the reached key alone leaves the result ready for the next round's join.
    """
    reached = follow(links, frontier.select(F.col(key).alias("key")))
    return reached.groupBy(F.col("target").alias(key)).agg(
        F.max(F.col("kind") == BACK).alias("back"), F.max(F.col("kind") == FOR).alias("for")
    )


def _as_levels(neighbours: DataFrame, key: str, level: str) -> DataFrame:
    """One row per key and direction."""
    hits = F.array(
        F.when(F.col("back"), F.lit(f"{level}-{BACK}")),
        F.when(F.col("for"), F.lit(f"{level}-{FOR}")),
    )
    rows = neighbours.select(key, F.explode(hits).alias("expansion_level"))
    return rows.filter(F.col("expansion_level").isNotNull())


def citation_frontier(raw: DataFrame, level: int = 1) -> DataFrame:
    """Rows a round starts from: SEED and PC for round 1, the previous round after that."""
    if level == 1:
        return raw.filter(F.col("expansion_level").isin(SEED, PC))
    return raw.filter(F.col("expansion_level").like(f"L{level - 1}%"))


def citation_expansion(raw: DataFrame, links: DataFrame, key: str, kind: str, level: int = 1) -> DataFrame:
    """Distinct keys one citation away from the round's frontier, in one direction. Runs when called."""
    start = citation_frontier(raw, level)
    reached = _neighbours(start, links.filter(F.col("kind") == kind), key)
    with small_shuffles(raw.sparkSession):
        return materialise(reached.select(key, F.lit(f"L{level}-{kind}").alias("expansion_level")))


def full_citation_expansion(raw: DataFrame, links: DataFrame | StoredLinks, key: str, level: int = 1) -> DataFrame:
    """Both directions of one round, in one pass over the links. Runs when called."""
    with small_shuffles(raw.sparkSession):
        return materialise(_as_levels(_neighbours(citation_frontier(raw, level), links, key), key, f"L{level}"))


def reduce_expansion(raw: DataFrame, key: str, depth: int = 2) -> DataFrame:
    """One row per key: its strongest level, all its levels (sorted) and their number.

    Levels rank by what they contain: ``ANTISEED``, ``SEED``, ``PC``, then the citation rounds
    up to ``depth``; a key with none of these has no strongest level. Rows are summed per
    (key, level) before they move, so a key's list is as long as it has distinct levels;
    a level is written out as often as it occurs.
    """
    level = F.col("expansion_level")
    summed = raw.groupBy(key, "expansion_level").agg(F.count(level).alias("n"))
    ranked = ["ANTISEED", SEED, PC, *citation_levels(depth)]
    contained = [F.max(level.contains(name)) for name in ranked]
    strongest = F.when(contained[0], F.lit(ranked[0]))
    for name, seen in zip(ranked[1:], contained[1:]):
        strongest = strongest.when(seen, F.lit(name))
    # A null level is counted zero times and collected by nobody.
    entries = F.collect_list(F.when(level.isNotNull(), F.struct("expansion_level", "n")))
    grouped = summed.groupBy(key).agg(strongest.alias("expansion_level"), F.array_sort(entries).alias("entries"), F.sum("n").alias("nb_match"))
    listed = F.flatten(F.transform("entries", lambda e: F.array_repeat(e["expansion_level"], e["n"].cast("int"))))
    return grouped.select(
        key,
        "expansion_level",
        F.when(F.col("nb_match") > 0, F.array_join(listed, ",")).alias("expansion_level_"),
        "nb_match",
    )


def expand_raw(
    labelled: DataFrame,
    publications: DataFrame,
    codes: DataFrame,
    links: DataFrame | StoredLinks,
    key: str,
    share: float | None = None,
    draw_seed: int | str | None = None,
    n_pc: int = 50,
    odds: DataFrame | None = None,
    depth: int = 2,
) -> DataFrame:
    """(key, expansion_level), one row per way a key entered the expansion.

    A later round starts from every row of the round before, keys already found
    included; antiseed members are never expanded.
    """
    # Every step reads the few labelled rows, and every round starts from the n_pc chosen
    # codes at the end of the longest part of the plan: both are written once.
    block = materialise(seed_block(labelled, key, share, draw_seed))
    if odds is None:
        window = seed_year_window(block, publications, key)
        odds = class_odds(seed_class_freq(block, codes, key), universe_class_freq(codes, publications, window))
        with small_shuffles(labelled.sparkSession):
            odds = materialise(top_classes(odds, n_pc))
    classes = class_expansion(odds, codes, key, n_pc)
    raw = block.unionByName(classes)
    frontier = citation_frontier(raw)
    for level in range(1, depth + 1):
        # The next round starts from the very rows this one adds: the same plan in both
        # places, so the shuffles below it are done once.
        frontier = _as_levels(_neighbours(frontier, links, key), key, f"L{level}")
        raw = raw.unionByName(frontier)
    return raw


def expand(
    labelled: DataFrame,
    publications: DataFrame,
    codes: DataFrame,
    links: DataFrame | StoredLinks,
    key: str,
    share: float | None = None,
    draw_seed: int | str | None = None,
    n_pc: int = 50,
    odds: DataFrame | None = None,
    depth: int = 2,
) -> DataFrame:
    """The full expansion, reduced to one row per key. Runs when called: a plan keeps to partitions of a bounded size only while it runs here."""
    raw = expand_raw(labelled, publications, codes, links, key, share, draw_seed, n_pc, odds, depth)
    with small_shuffles(labelled.sparkSession):
        return materialise(reduce_expansion(raw, key, depth))


def close_antiseed(
    codes: DataFrame,
    parts: Sequence[str],
    size: int,
    expansion: DataFrame,
    key: str,
    draw_seed: int | str | None = None,
    exclude_expansion: bool = True,
    located: DataFrame | None = None,
    countries: Sequence[str] = (),
) -> DataFrame:
    """``size`` random keys with a code containing one of the parts (cut at ``/``).

    Members of the expansion are excluded unless told otherwise. ``located``
    (key, country_code[]) restricts the draw to families with a country, or with one
    of ``countries``.
    """
    found = codes.filter(holds_code("code", parts, main_group=True)).select(key).distinct()
    if located is not None:
        placed = located.select(key, F.explode("country_code").alias("country"))
        found = found.join(placed.filter(in_countries("country", countries)), key, "left_semi")
    if exclude_expansion:
        found = found.join(expansion.select(key), key, "left_anti")
    return draw_exact(found, [key], size, draw_seed).withColumn("expansion_level", F.lit(CLOSE_NEGATIVE))
