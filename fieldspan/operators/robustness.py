"""Robustness of the expansion to the seed draw.

All runs go through one job. The runs a row belongs to are bits of a few longs
(62 runs each), so ten, thirty or two hundred runs read the corpus once and move one
row per key, not one per key and run.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldspan.functions.draws import unit_draw_of
from fieldspan.functions.predicates import is_labelled
from fieldspan.operators.expansion import SEED, StoredLinks, follow
from fieldspan.operators.summary import describe
from fieldspan.session import materialise, small_shuffles

_WORD = 62


@dataclass(frozen=True)
class Run:
    """One random draw of a technology's seed."""

    run_id: str
    technology: str
    share: float
    seed: str


def plan_runs(technologies: Sequence[str], shares: Sequence[float], draws: int) -> list[Run]:
    """Every technology x share x draw."""
    return [
        Run(f"{t}-{s}-{i}", t, s, f"{t}-{s}-{i}") for t in technologies for s in shares for i in range(draws)
    ]


def run_table(spark: SparkSession, runs: Sequence[Run]) -> DataFrame:
    """(run_id, technology, seed_share): a parameter list as a table."""
    rows = [(r.run_id, r.technology, float(r.share)) for r in runs]
    return spark.createDataFrame(rows, "run_id string, technology string, seed_share double")


class _Bits:
    """Sets of runs as long columns m0, m1, ..."""

    def __init__(self, runs: Sequence[Run]):
        self.runs = sorted(runs, key=lambda r: r.run_id)
        self.words = [f"m{i}" for i in range(-(-len(self.runs) // _WORD))]

    def literal(self) -> Column:
        """The runs as a constant array of structs, ordered by id."""

        def text(value: str) -> str:
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

        rows = [
            f"named_struct('run_id', {text(r.run_id)}, 'run_technology', {text(r.technology)}, "
            f"'seed_share', {float(r.share)!r}D, 'run_seed', {text(r.seed)}, "
            f"'word', {i // _WORD}, 'bit', {1 << (i % _WORD)}L)"
            for i, r in enumerate(self.runs)
        ]
        return F.expr(f"array({', '.join(rows)})")

    def collected(self) -> list[Column]:
        """Aggregates that turn rows with (word, bit) into sets."""
        zero = F.lit(0).cast("bigint")
        return [F.bit_or(F.when(F.col("word") == i, F.col("bit")).otherwise(zero)).alias(w) for i, w in enumerate(self.words)]

    def merged(self) -> list[Column]:
        return [F.bit_or(w).alias(w) for w in self.words]

    def members(self) -> Column:
        """The runs in the set, as an array of structs ordered by id."""
        words = F.array(*self.words)
        return F.filter(self.literal(), lambda r: F.get(words, r["word"]).bitwiseAND(r["bit"]) != 0)

    def by_set_up(self) -> Column:
        """The part of the set that each technology and share has, as an array of (technology, seed_share, m0, ...)."""
        masks: dict[tuple[str, float], list[int]] = {}
        for i, r in enumerate(self.runs):
            masks.setdefault((r.technology, float(r.share)), [0] * len(self.words))[i // _WORD] |= 1 << (i % _WORD)
        parts = [
            F.struct(F.lit(t).alias("technology"), F.lit(s).alias("seed_share"), *[F.col(w).bitwiseAND(F.lit(m).cast("bigint")).alias(w) for w, m in zip(self.words, mask)])
            for (t, s), mask in masks.items()
        ]
        return F.array(*parts)

    def listed(self) -> Column:
        """Their ids."""
        return F.transform(self.members(), lambda r: r["run_id"])


def expand_runs(
    labelled: DataFrame,
    publications: DataFrame,
    codes: DataFrame,
    links: DataFrame | StoredLinks,
    key: str,
    runs: Sequence[Run],
    n_pc: int = 50,
    depth: int = 2,
) -> DataFrame:
    """Members of all runs: (key, m0, ...), one row per key in at least one run.

    ``labelled`` carries a ``technology`` column. The universe is counted once per
    (code, year) for the codes the seeds have, and each run sums its own years.
    Runs when called, in partitions of a bounded size; the members are staged.
    """
    with small_shuffles(labelled.sparkSession):
        return materialise(_members_of_runs(labelled, publications, codes, links, key, runs, n_pc, depth))


def _members_of_runs(
    labelled: DataFrame, publications: DataFrame, codes: DataFrame, links: DataFrame | StoredLinks, key: str, runs: Sequence[Run], n_pc: int, depth: int
) -> DataFrame:
    bits = _Bits(runs)
    labels = [key, "expansion_level", "technology", "copies"]
    block = labelled.filter(is_labelled() & F.col(key).isNotNull())
    block = block.groupBy(*labels[:3]).agg(F.count(F.lit(1)).alias("copies"))
    drawn = block.select(*labels, F.inline(bits.literal())).filter(
        (F.col("technology") == F.col("run_technology")) & (unit_draw_of(F.col("run_seed"), key) < F.col("seed_share"))
    )
    # The drawn seeds are few, and read by every step below.
    block = materialise(drawn.groupBy(*labels).agg(*bits.collected()))
    seeds = block.filter(F.col("expansion_level") == SEED)

    # Codes are read by three steps below, and joined where they come from: they are written once, beside the draws of their key
    # (one per technology), so none of the steps moves them again.
    members = seeds.select(key, "copies", *bits.words)
    draws = members.groupBy(key).agg(F.collect_list(F.struct("copies", *bits.words)).alias("__draws"))
    codes = codes.select(key, "publication_date", "code").filter(F.col("code").isNotNull())
    codes = materialise(codes.join(draws, key, "left"))

    # Seed side. Rows sharing a code and a set of runs are summed before runs are told apart.
    n_patents = (
        members.groupBy(*bits.words).agg(F.sum("copies").alias("copies"))
        .select("copies", F.explode(bits.listed()).alias("run_id"))
        .groupBy("run_id").agg(F.sum("copies").alias("n_seed"))
    )
    seed_counts = (
        codes.filter(F.col("__draws").isNotNull()).select("code", F.inline("__draws"))
        .groupBy("code", *bits.words).agg(F.sum("copies").alias("n"))
        .select("code", "n", F.explode(bits.listed()).alias("run_id"))
        .groupBy("run_id", "code").agg(F.sum("n").alias("n"))
    )

    # Universe side: years of each run's window, then one histogram for all of them.
    per_year = (
        publications.select(key, F.expr("publication_date div 10000").alias("year")).join(members, key)
        .groupBy("year", *bits.words).agg(F.sum("copies").alias("n"))
        .select("year", "n", F.explode(bits.listed()).alias("run_id"))
        .filter(F.col("year").isNotNull()).groupBy("run_id", "year").agg(F.sum("n").alias("n"))
    )
    # Quartiles from the counts of a run's years; the windows see one row per year.
    of_run = Window.partitionBy("run_id")
    upto = F.sum("n").over(of_run.orderBy("year").rowsBetween(Window.unboundedPreceding, 0))
    ranked = per_year.select("run_id", "year", upto.alias("upto"), F.sum("n").over(of_run).alias("all"))
    windows = ranked.groupBy("run_id").agg(
        *[F.min(F.when(F.col("upto") >= F.col("all") * share, F.col("year"))).alias(name) for name, share in (("p25", 0.25), ("p75", 0.75))]
    )
    run_years = windows.select("run_id", "p75", F.explode(F.sequence("p25", "p75")).alias("year"))
    year = F.expr("publication_date div 10000").alias("year")
    opens_year = (F.col("publication_date") % 10000 == 0).alias("opens_year")
    inside = (F.col("year") < F.col("p75")) | F.col("opens_year")
    universe_size = (
        publications.groupBy(year, opens_year).agg(F.count(F.lit(1)).alias("n"))
        .join(run_years, "year").filter(inside).groupBy("run_id").agg(F.sum("n").alias("n_universe"))
    )
    universe_counts = (
        codes.join(seed_counts.select("code"), "code", "left_semi")
        .groupBy("code", year, opens_year).agg(F.count("code").alias("n"))
        .join(run_years, "year").filter(inside).groupBy("run_id", "code").agg(F.sum("n").alias("n_all"))
    )
    odds = (
        seed_counts.join(universe_counts, ["run_id", "code"]).join(n_patents, "run_id").join(universe_size, "run_id")
        .withColumn("odds", (F.col("n") / F.col("n_seed")) / (F.col("n_all") / F.col("n_universe")))
    )
    best = Window.partitionBy("run_id").orderBy(F.col("odds").desc(), "code")
    top = odds.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= n_pc)
    places = top.sparkSession.range(1).select(F.inline(bits.literal())).select("run_id", "word", "bit")
    top = top.join(F.broadcast(places), "run_id").groupBy("code").agg(*bits.collected())

    # At most n_pc codes per run, whatever the corpus size; written once, as every round starts from them.
    top = materialise(top)
    classes = codes.select(key, "code").join(F.broadcast(top), "code").groupBy(key).agg(*bits.merged())
    classes = classes.filter(F.col(key).isNotNull())

    rows = block.select(key, *bits.words).unionByName(classes)
    frontier = seeds.select(key, *bits.words).unionByName(classes).groupBy(key).agg(*bits.merged())
    for level in range(1, depth + 1):
        start = frontier.withColumnRenamed(key, "key")
        reached = follow(links, start, "inner").select(F.col("target").alias(key), *bits.words)
        # No round starts from the last one, so its rows are merged with all others, in one shuffle.
        frontier = reached.groupBy(key).agg(*bits.merged()) if level < depth else reached
        rows = rows.unionByName(frontier)
    return rows.groupBy(key).agg(*bits.merged())


def members_by_run(members: DataFrame, key: str, runs: Sequence[Run]) -> DataFrame:
    """(run_id, technology, seed_share, key): the members written out run by run."""
    table = run_table(members.sparkSession, runs)
    rows = members.select(key, F.explode(_Bits(runs).listed()).alias("run_id"))
    return rows.join(F.broadcast(table), "run_id")


def patterns_from_members(members: DataFrame, runs: Sequence[Run]) -> DataFrame:
    """(technology, seed_share, runs[], n): how many keys have exactly this set of runs."""
    bits = _Bits(runs)
    # Sizes, pairs and batches each read the patterns; written once, the expansions run once. Each technology and share counts
    # its own part of a key's set, so what moves are the few sets of runs within those.
    parts = members.select(F.inline(bits.by_set_up())).where(F.greatest(*[F.col(w) != 0 for w in bits.words], F.lit(False)))
    counted = materialise(parts.groupBy("technology", "seed_share", *bits.words).agg(F.count(F.lit(1)).alias("n")))
    return counted.select("technology", "seed_share", F.array_sort(bits.listed()).alias("runs"), "n")


def run_patterns(table: DataFrame, key: str, by: Sequence[str] = ("technology", "seed_share")) -> DataFrame:
    """(by..., runs[], n) from rows (by..., run_id, key): one shuffle for all overlaps.

    A key's set of runs is as long as the list of runs, never as the data.
    """
    per_key = table.filter(F.col(key).isNotNull()).groupBy(*by, key).agg(F.array_sort(F.collect_set("run_id")).alias("runs"))
    return per_key.groupBy(*by, "runs").agg(F.count(F.lit(1)).alias("n"))


def run_sizes(patterns: DataFrame, by: Sequence[str] = ("technology", "seed_share")) -> DataFrame:
    """Number of keys of each run."""
    return patterns.select(*by, "n", F.explode("runs").alias("run_id")).groupBy(*by, "run_id").agg(F.sum("n").alias("nb"))


def pair_overlap(patterns: DataFrame, by: Sequence[str] = ("technology", "seed_share")) -> DataFrame:
    """Shared keys of every pair of runs and their share of either; empty overlaps included.

    Pairs are formed per distinct set of runs, not per key.
    """
    sizes = run_sizes(patterns, by)
    everyone = sizes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("run_id", "nb"))).alias("all"))
    pairs = everyone.select(*by, F.explode("all").alias("l"), "all").select(*by, "l", F.explode("all").alias("r"))
    pairs = pairs.filter(F.col("l.run_id") < F.col("r.run_id")).select(
        *by,
        F.col("l.run_id").alias("left_name"),
        F.col("r.run_id").alias("right_name"),
        F.col("l.nb").alias("nb_left"),
        F.col("r.nb").alias("nb_right"),
    )
    shared = patterns.filter(F.size("runs") > 1).select(*by, "n", "runs", F.explode("runs").alias("left_name"))
    shared = shared.select(*by, "n", "left_name", F.explode("runs").alias("right_name"))
    shared = shared.filter(F.col("left_name") < F.col("right_name"))
    shared = shared.groupBy(*by, "left_name", "right_name").agg(F.sum("n").alias("nb_overlap"))
    joined = pairs.join(shared, [*by, "left_name", "right_name"], "left").fillna(0, subset=["nb_overlap"])
    return joined.withColumn("share_left", F.col("nb_overlap") / F.col("nb_left")).withColumn(
        "share_right", F.col("nb_overlap") / F.col("nb_right")
    )


def pair_ratios(pairs: DataFrame, by: Sequence[str] = ("technology", "seed_share")) -> DataFrame:
    """Both shares of every pair in one column."""
    return pairs.select(*by, F.explode(F.array("share_left", "share_right")).alias("share"))


def batch_overlap(patterns: DataFrame, by: Sequence[str] = ("technology", "seed_share")) -> DataFrame:
    """Keys found by all runs, as a share of each run."""
    sizes = run_sizes(patterns, by)
    n_runs = sizes.groupBy(*by).agg(F.count(F.lit(1)).alias("n_runs"))
    common = patterns.join(n_runs, list(by)).groupBy(*by).agg(
        F.sum(F.when(F.size("runs") == F.col("n_runs"), F.col("n")).otherwise(0)).alias("nb_all")
    )
    return sizes.join(common, list(by)).withColumn("share", F.col("nb_all") / F.col("nb"))


def overlap_analysis(
    patterns: DataFrame,
    kind: str = "pairwise",
    summary: bool = False,
    by: Sequence[str] = ("technology", "seed_share"),
) -> DataFrame:
    """Pairwise or batch overlap, in full or summarised."""
    if kind not in ("pairwise", "batch"):
        raise ValueError(f"unknown kind of overlap: {kind}")
    full = pair_overlap(patterns, by) if kind == "pairwise" else batch_overlap(patterns, by)
    if not summary:
        return full
    ratios = pair_ratios(full, by) if kind == "pairwise" else full
    return describe(ratios, "share", by)


def collate_overlap(summaries: DataFrame, axis: str = "technology", config: str = "config") -> DataFrame:
    """Summaries side by side, rounded to two digits and ordered along the axis.

    One table with both columns takes the place of one file per technology or set-up:
    write it with ``partitionBy(axis)`` for that.
    """
    other = config if axis == "technology" else "technology"
    values = [c for c in summaries.columns if c not in ("technology", config)]
    rounded = [F.round(F.col(c).cast("double"), 2).alias(c) for c in values]
    return summaries.select(axis, other, *rounded).orderBy(axis, other)
