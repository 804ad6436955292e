"""Corpus building, expansion and robustness over the graph corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspan.operators import corpus, expansion, robustness, training
from fieldspan.operators.expansion import MANUAL, SEED
from fieldspan.plans import corpora as c
from fieldspan.plans.corpora import GRAPH_SQL, N_PC, PUB, RUNS, table, with_ctes

QUERIES, ORACLES = {}, {}
BY = ["technology", "seed_share"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _graph(last: str, *names: str) -> str:
    return with_ctes(GRAPH_SQL, last, *names)


_SEEDF = ("pub", "cpc", "seed", "seedf")
_UNIV = ("pub", "cpc", "seed", "win", "inwin", "unif")
_ODDS = ("pub", "cpc", "seed", "seedf", "win", "inwin", "unif", "odds")
_PC = (*_ODDS, "top", "pc")
_L1 = (*_PC, "cit", "start", "l1b", "l1f")


# --- corpus -----------------------------------------------------------------

def _joined(column: str, field: str | None = None):
    values = F.col(column) if field is None else F.transform(column, lambda v: v[field])
    return F.array_join(values, ",").alias(column)


def _family_view(families: DataFrame) -> DataFrame:
    return families.select(
        F.col("family_id").cast("string").alias("family_id"),
        "publication_date",
        _joined("publication_number"),
        _joined("country_code"),
        _joined("cpc", "code"),
        _joined("ipc", "code"),
        _joined("citation", "family_id"),
        _joined("cited_by", "family_id"),
        "abstract",
    )


def _list(column: str) -> str:
    return f"coalesce(string_agg(DISTINCT {column}::VARCHAR, ',' ORDER BY {column}::VARCHAR), '')"


@query(
    _graph(
        f"""SELECT f.family_id::VARCHAR AS family_id, f.publication_date, f.publication_number, f.country_code,
        coalesce(c.cpc, '') AS cpc, coalesce(i.ipc, '') AS ipc, coalesce(b.citation, '') AS citation,
        coalesce(w.cited_by, '') AS cited_by, t.abstract
        FROM (SELECT family_id, min(d) AS publication_date, {_list('k')} AS publication_number,
              {_list('country_code')} AS country_code FROM pub GROUP BY family_id) f
        LEFT JOIN (SELECT family_id, {_list('code')} AS cpc FROM pub JOIN cpc USING (k) GROUP BY family_id) c
          ON f.family_id = c.family_id
        LEFT JOIN (SELECT family_id, {_list('code')} AS ipc FROM pub JOIN ipc USING (k) GROUP BY family_id) i
          ON f.family_id = i.family_id
        LEFT JOIN (SELECT p.family_id, {_list('q.family_id')} AS citation FROM pub p JOIN cit ON p.k = citing
              JOIN pub q ON q.k = cited GROUP BY p.family_id) b ON f.family_id = b.family_id
        LEFT JOIN (SELECT p.family_id, {_list('q.family_id')} AS cited_by FROM pub p JOIN cit ON p.k = cited
              JOIN pub q ON q.k = citing GROUP BY p.family_id) w ON f.family_id = w.family_id
        LEFT JOIN (SELECT family_id, arg_min(title || chr(10) || abstract, k) AS abstract FROM pub
              WHERE k IN (SELECT cited FROM cit) GROUP BY family_id) t ON f.family_id = t.family_id""",
        "pub", "cpc", "ipc", "cit",
    )
)
def family_publications(spark: SparkSession, d: str) -> DataFrame:
    return _family_view(corpus.publications_family(c.nested_publications(spark, d), c.graph_research(spark, d)))


_STRICT = _graph(
    f"""SELECT f.family_id, coalesce(c.cpc, '') AS cpc, coalesce(c.ipc, '') AS ipc
    FROM (SELECT DISTINCT family_id FROM pub) f
    LEFT JOIN (SELECT family_id, {_list('cpc.code')} AS cpc, {_list('ipc.code')} AS ipc
          FROM pub JOIN cpc USING (k) JOIN ipc USING (k) GROUP BY family_id) c ON f.family_id = c.family_id""",
    "pub", "cpc", "ipc",
)


@query(_STRICT)
def family_classes_strict(spark: SparkSession, d: str) -> DataFrame:
    families = corpus.publications_family(c.nested_publications(spark, d), strict_cross=True)
    return families.select("family_id", _joined("cpc", "code"), _joined("ipc", "code"))


@query(
    """SELECT c_custkey AS appln_id, c_mktsegment AS patent_office, c_name AS city, c_acctbal AS lat,
    replace(o_orderpriority || '-' || nr || '-' || o_orderstatus, ' ', '') AS publication_number
    FROM customer JOIN (SELECT *, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderkey::VARCHAR END AS nr FROM orders)
    ON c_custkey = o_orderkey WHERE nr <> ''"""
)
def crosswalk_number(spark: SparkSession, d: str) -> DataFrame:
    applications = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("appln_id"),
        F.col("o_orderpriority").alias("publn_auth"),
        F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(F.col("o_orderkey").cast("string")).alias("publn_nr"),
        F.col("o_orderstatus").alias("publn_kind"),
    )
    places = table(spark, d, "customer").select(
        F.col("c_custkey").alias("appln_id"),
        F.col("c_mktsegment").alias("patent_office"),
        F.col("c_name").alias("city"),
        F.col("c_acctbal").alias("lat"),
    )
    return corpus.crosswalk_number(places, applications)


@query(
    _graph("SELECT DISTINCT k AS publication_number, code FROM cpc", "cpc")
)
def flatten_nested(spark: SparkSession, d: str) -> DataFrame:
    nested = c.class_lines(spark, d).groupBy(PUB).agg(
        F.array(F.struct(F.array_sort(F.collect_set("cpc")).alias("code"))).alias("cpc")
    )
    return corpus.flatten_nested(nested, ["cpc"]).select(PUB, F.inline("cpc"))


# --- expansion --------------------------------------------------------------

def _block(spark: SparkSession, d: str) -> DataFrame:
    return expansion.seed_block(c.labelled(spark, d), PUB)


@query(
    _graph(
        f"""SELECT k AS publication_number, level AS expansion_level FROM seed
        WHERE level LIKE '%SEED%' AND {c.u_sql(9, 'k')} < 0.5""",
        "seed",
    )
)
def seed_draw(spark: SparkSession, d: str) -> DataFrame:
    return expansion.seed_block(c.labelled(spark, d), PUB, share=0.5, draw_seed=9)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in columns})


@query(_graph("SELECT code, n, n_patents, round(freq, 6) AS freq FROM seedf", *_SEEDF))
def seed_class_freq(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(expansion.seed_class_freq(_block(spark, d), c.undated_codes(spark, d), PUB), "freq")


@query(_graph("SELECT code, n, n_patents, round(freq, 6) AS freq FROM unif", *_UNIV))
def universe_class_freq(spark: SparkSession, d: str) -> DataFrame:
    publications = c.publications(spark, d)
    window = expansion.seed_year_window(_block(spark, d), publications, PUB)
    return _rounded(expansion.universe_class_freq(c.codes(spark, d), publications, window), "freq")


def _odds(spark: SparkSession, d: str) -> DataFrame:
    block, publications, codes = _block(spark, d), c.publications(spark, d), c.codes(spark, d)
    window = expansion.seed_year_window(block, publications, PUB)
    return expansion.class_odds(
        expansion.seed_class_freq(block, c.undated_codes(spark, d), PUB),
        expansion.universe_class_freq(codes, publications, window),
    )


@query(
    _graph(
        """SELECT code, round(seed_freq, 6) AS seed_freq, round(universe_freq, 6) AS universe_freq,
        round(odds, 6) AS odds FROM odds""",
        *_ODDS,
    )
)
def class_odds(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_odds(spark, d), "seed_freq", "universe_freq", "odds")


@query(_graph("SELECT k AS publication_number, 'PC' AS expansion_level FROM pc", *_PC))
def class_expansion(spark: SparkSession, d: str) -> DataFrame:
    return expansion.class_expansion(_odds(spark, d), c.undated_codes(spark, d), PUB, N_PC)


_IPC_SQL = {**GRAPH_SQL, "cpc": GRAPH_SQL["ipc"], "top": "SELECT code FROM odds ORDER BY odds DESC, code LIMIT 2"}


@query(with_ctes(_IPC_SQL, "SELECT k AS publication_number, 'PC' AS expansion_level FROM pc", *_PC))
def class_expansion_full(spark: SparkSession, d: str) -> DataFrame:
    """Along the other class column, from the seed to the members."""
    return expansion.full_class_expansion(
        _block(spark, d), c.publications(spark, d), c.codes(spark, d, "ipc"), PUB, n_pc=2
    )


def _raw(spark: SparkSession, d: str, depth: int) -> DataFrame:
    return expansion.expand_raw(
        c.labelled(spark, d), c.publications(spark, d), c.codes(spark, d), c.links(spark, d), PUB, n_pc=N_PC, depth=depth
    )


@query(_graph("SELECT k AS publication_number, 'L1-BACK' AS expansion_level FROM l1b", *_L1))
def citation_l1_back(spark: SparkSession, d: str) -> DataFrame:
    return expansion.citation_expansion(_raw(spark, d, 0), c.links(spark, d), PUB, "BACK", 1)


@query(_graph("SELECT k AS publication_number, 'L1-FOR' AS expansion_level FROM l1f", *_L1))
def citation_l1_for(spark: SparkSession, d: str) -> DataFrame:
    return expansion.citation_expansion(_raw(spark, d, 0), c.links(spark, d), PUB, "FOR", 1)


@query(
    _graph(
        """SELECT k AS publication_number, 'L2-BACK' AS expansion_level FROM l2b
        UNION ALL SELECT k, 'L2-FOR' FROM l2f""",
        *[n for n in GRAPH_SQL if n not in ("ipc", "raw", "expansion")],
    )
)
def citation_l2(spark: SparkSession, d: str) -> DataFrame:
    return expansion.full_citation_expansion(_raw(spark, d, 1), c.links(spark, d), PUB, 2)


@query(
    _graph(
        """SELECT k AS publication_number, 'L2-BACK' AS expansion_level FROM l2b
        UNION ALL SELECT k, 'L2-FOR' FROM l2f""",
        *[n for n in GRAPH_SQL if n not in ("ipc", "raw", "expansion")],
    )
)
def citation_l2_stored(spark: SparkSession, d: str) -> DataFrame:
    """The same over links stored by key, which neither round moves."""
    links = expansion.store_links(c.links(spark, d), c.LINK_BUCKETS)
    raw = expansion.expand_raw(c.labelled(spark, d), c.publications(spark, d), c.codes(spark, d), links, PUB, n_pc=N_PC, depth=1)
    return expansion.full_citation_expansion(raw, links, PUB, 2)


@query(
    _graph(
        """SELECT k AS publication_number, CASE WHEN s LIKE '%ANTISEED%' THEN 'ANTISEED' WHEN s LIKE '%SEED%' THEN 'SEED'
        ELSE 'PC' END AS expansion_level, s AS expansion_level_, nb_match FROM (
        SELECT k, string_agg(level, ',' ORDER BY level) AS s, count(*) AS nb_match FROM
        (SELECT k, level FROM seed WHERE level LIKE '%SEED%' UNION ALL SELECT k, 'PC' FROM pc) GROUP BY k)""",
        *_PC,
    )
)
def expansion_reduced(spark: SparkSession, d: str) -> DataFrame:
    return expansion.reduce_expansion(_raw(spark, d, 0), PUB)


_FULL = tuple(n for n in GRAPH_SQL if n != "ipc")


@query(_graph("SELECT * FROM expansion", *_FULL))
def expansion_full(spark: SparkSession, d: str) -> DataFrame:
    return expansion.expand(
        c.labelled(spark, d), c.publications(spark, d), c.codes(spark, d), c.links(spark, d), PUB, n_pc=N_PC
    )


@query(_graph("SELECT expansion_level, count(*) AS n FROM expansion GROUP BY expansion_level", *_FULL))
def expansion_levels(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: expand a seed of half a percent with 5 codes and two citation rounds, count by level."""
    return expansion_full(spark, d).groupBy("expansion_level").agg(F.count(F.lit(1)).alias("n"))


_NEAR = ["Brand#1/10", "Brand#22/3"]


@query(
    _graph(
        f"""SELECT k AS publication_number, 'ANTISEED-AUG' AS expansion_level FROM (
        SELECT DISTINCT k FROM cpc WHERE (code LIKE '%Brand#1%' OR code LIKE '%Brand#22%')
        AND k NOT IN (SELECT publication_number FROM expansion)) ORDER BY {c.h_sql(11, 'k')} LIMIT 200""",
        *_FULL,
    )
)
def antiseed_augmented(spark: SparkSession, d: str) -> DataFrame:
    return expansion.close_antiseed(c.undated_codes(spark, d), _NEAR, 200, expansion_full(spark, d), PUB, draw_seed=11)


# --- robustness -------------------------------------------------------------

_RUN_ROWS = ", ".join(f"('{r.run_id}', '{r.technology}', {r.share}::DOUBLE)" for r in RUNS)
_TECH_ROWS = "\nUNION ALL ".join(
    f"SELECT '{name}' AS technology, k, CASE WHEN u < {c.SEED_SHARE} THEN '{SEED}' WHEN u < {2 * c.SEED_SHARE} "
    f"THEN '{MANUAL}' END AS level FROM (SELECT o_orderkey AS k, {c.u_sql(seed, 'o_orderkey')} AS u FROM orders)"
    for name, seed in c.TECHNOLOGIES.items()
)
RUN_SQL = {
    "pub": GRAPH_SQL["pub"],
    "cpc": GRAPH_SQL["cpc"],
    "cit": GRAPH_SQL["cit"],
    "runs": f"SELECT * FROM (VALUES {_RUN_ROWS}) AS t(run_id, technology, seed_share)",
    "techs": _TECH_ROWS,
    "block": """SELECT run_id, k, level FROM techs JOIN runs USING (technology) WHERE level LIKE '%SEED%' AND
        ('0x' || substr(md5(run_id || ':' || k), 1, 8))::BIGINT / 4294967296.0::DOUBLE < seed_share""",
    "nseed": f"SELECT run_id, count(*) AS n_seed FROM block WHERE level = '{SEED}' GROUP BY run_id",
    "sfreq": f"SELECT run_id, code, count(*) AS n FROM block JOIN cpc USING (k) WHERE level = '{SEED}' GROUP BY run_id, code",
    "win": f"""SELECT run_id, quantile_disc(d // 10000, 0.25) AS p25, quantile_disc(d // 10000, 0.75) AS p75
        FROM block JOIN pub USING (k) WHERE level = '{SEED}' GROUP BY run_id""",
    "spans": "SELECT DISTINCT p25, p75 FROM win",
    "inwin": "SELECT p25, p75, k FROM spans JOIN pub ON d BETWEEN p25 * 10000 AND p75 * 10000",
    "usize": "SELECT p25, p75, count(*) AS n_universe FROM inwin GROUP BY p25, p75",
    "ufreq": "SELECT p25, p75, code, count(*) AS n_all FROM inwin JOIN cpc USING (k) GROUP BY p25, p75, code",
    "odds": """SELECT run_id, code, (n::DOUBLE / n_seed) / (n_all::DOUBLE / n_universe) AS odds
        FROM sfreq JOIN nseed USING (run_id) JOIN win USING (run_id) JOIN usize USING (p25, p75)
        JOIN ufreq USING (p25, p75, code)""",
    "top": f"""SELECT run_id, code FROM odds
        QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY odds DESC, code) <= {N_PC}""",
    "pc": "SELECT DISTINCT run_id, k FROM top JOIN cpc USING (code)",
    "start": f"SELECT run_id, k FROM block WHERE level = '{SEED}' UNION SELECT run_id, k FROM pc",
    "ways": "SELECT citing AS k, cited AS t FROM cit UNION SELECT cited, citing FROM cit",
    "l1": "SELECT DISTINCT run_id, t AS k FROM start JOIN ways USING (k)",
    "l2": "SELECT DISTINCT run_id, t AS k FROM l1 JOIN ways USING (k)",
    "member": """SELECT technology, seed_share, run_id, k FROM (SELECT run_id, k FROM block UNION SELECT run_id, k FROM pc
        UNION SELECT run_id, k FROM l1 UNION SELECT run_id, k FROM l2) JOIN runs USING (run_id)""",
    "sizes": "SELECT technology, seed_share, run_id, count(*) AS nb FROM member GROUP BY ALL",
    "pairs": """SELECT l.technology, l.seed_share, l.run_id AS left_name, r.run_id AS right_name, l.nb AS nb_left,
        r.nb AS nb_right, coalesce(o.nb, 0) AS nb_overlap, coalesce(o.nb, 0)::DOUBLE / l.nb AS share_left,
        coalesce(o.nb, 0)::DOUBLE / r.nb AS share_right
        FROM sizes l JOIN sizes r ON l.technology = r.technology AND l.seed_share = r.seed_share AND l.run_id < r.run_id
        LEFT JOIN (SELECT a.run_id AS lr, b.run_id AS rr, count(*) AS nb FROM member a JOIN member b
          ON a.k = b.k AND a.technology = b.technology AND a.seed_share = b.seed_share AND a.run_id < b.run_id
          GROUP BY 1, 2) o ON o.lr = l.run_id AND o.rr = r.run_id""",
    "ratios": """SELECT technology, seed_share, share_left AS share FROM pairs
        UNION ALL SELECT technology, seed_share, share_right FROM pairs""",
    "batch": """SELECT s.technology, s.seed_share, s.run_id, s.nb, coalesce(nb_all, 0) AS nb_all,
        coalesce(nb_all, 0)::DOUBLE / s.nb AS share FROM sizes s LEFT JOIN (
        SELECT technology, seed_share, count(*) AS nb_all FROM (
          SELECT technology, seed_share, k, count(*) AS n FROM member GROUP BY ALL) m
          JOIN (SELECT technology, seed_share, count(*) AS runs FROM sizes GROUP BY ALL) USING (technology, seed_share)
          WHERE n = runs GROUP BY technology, seed_share) a
        ON s.technology = a.technology AND s.seed_share = a.seed_share""",
}


def describe_sql(source: str, by: str, value: str) -> str:
    """Summary of a value, rounded to six digits."""
    stats = {
        "mean": f"avg({value})",
        "std": f"stddev_samp({value})",
        "min": f"min({value})",
        "p25": f"quantile_cont({value}, 0.25::DOUBLE)",
        "p50": f"quantile_cont({value}, 0.5::DOUBLE)",
        "p75": f"quantile_cont({value}, 0.75::DOUBLE)",
        "max": f"max({value})",
    }
    columns = ", ".join(f"round({sql}, 6) AS {name}" for name, sql in stats.items())
    return f"SELECT {by}, count({value}) AS count, {columns} FROM {source} GROUP BY {by}"


def rounded_summary(df: DataFrame) -> DataFrame:
    return _rounded(df, "mean", "std", "min", "p25", "p50", "p75", "max")


def _runs(last: str, *without: str) -> str:
    return with_ctes(RUN_SQL, last, *[n for n in RUN_SQL if n not in without])


def _members(spark: SparkSession, d: str) -> DataFrame:
    return robustness.expand_runs(
        c.labelled_technologies(spark, d), c.publications(spark, d), c.codes(spark, d), c.links(spark, d), PUB, RUNS, N_PC
    )


def _patterns(spark: SparkSession, d: str) -> DataFrame:
    return robustness.patterns_from_members(_members(spark, d), RUNS)


@query(_runs("SELECT run_id, technology, seed_share, k AS publication_number FROM member", "sizes", "pairs", "ratios", "batch"))
def run_members(spark: SparkSession, d: str) -> DataFrame:
    """The members of thirty expansions (two seeds, three shares, five draws), in one job."""
    return robustness.members_by_run(_members(spark, d), PUB, RUNS)


@query(_runs("SELECT * FROM sizes", "pairs", "ratios", "batch"))
def run_sizes(spark: SparkSession, d: str) -> DataFrame:
    return robustness.run_sizes(_patterns(spark, d))


@query(
    _runs(
        """SELECT technology, seed_share, left_name, right_name, nb_left, nb_right, nb_overlap,
        round(share_left, 6) AS share_left, round(share_right, 6) AS share_right FROM pairs""",
        "ratios", "batch",
    )
)
def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(robustness.pair_overlap(_patterns(spark, d)), "share_left", "share_right")


@query(_runs("SELECT technology, seed_share, round(share, 6) AS share FROM ratios", "batch"))
def overlap_ratios(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(robustness.pair_ratios(robustness.pair_overlap(_patterns(spark, d))), "share")


@query(
    _runs("SELECT technology, seed_share, run_id, nb, nb_all, round(share, 6) AS share FROM batch", "pairs", "ratios")
)
def overlap_batch(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(robustness.batch_overlap(_patterns(spark, d)), "share")


@query(_runs(describe_sql("ratios", "technology, seed_share", "share"), "batch"))
def overlap_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded_summary(robustness.overlap_analysis(_patterns(spark, d), "pairwise", summary=True))


@query(_runs(describe_sql("batch", "technology, seed_share", "share"), "pairs", "ratios"))
def overlap_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded_summary(robustness.overlap_analysis(_patterns(spark, d), "batch", summary=True))


_COLLATED = ", ".join(f"round({s}::DOUBLE, 2) AS {s}" for s in ("count", "mean", "std", "min", "p25", "p50", "p75", "max"))


@query(
    _runs(
        f"""SELECT technology, kind || '-' || seed_share::VARCHAR AS config, {_COLLATED} FROM (
        SELECT 'batch' AS kind, * FROM ({describe_sql('batch', 'technology, seed_share', 'share')})
        UNION ALL SELECT 'pairwise', * FROM ({describe_sql('ratios', 'technology, seed_share', 'share')}))"""
    )
)
def overlap_collated(spark: SparkSession, d: str) -> DataFrame:
    patterns = _patterns(spark, d)
    parts = [
        rounded_summary(robustness.overlap_analysis(patterns, kind, summary=True)).withColumn(
            "config", F.concat(F.lit(f"{kind}-"), F.col("seed_share").cast("string"))
        )
        for kind in ("batch", "pairwise")
    ]
    return robustness.collate_overlap(parts[0].unionByName(parts[1]).drop("seed_share"))


# --- generic join -----------------------------------------------------------

_JOIN_SQL = """SELECT l.k AS custkey, l.nation, r.n_orders, r.total FROM
    (SELECT c_custkey AS k, c_nationkey AS nation FROM customer WHERE c_acctbal > 0) l {how} JOIN
    (SELECT o_custkey AS k, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders
     WHERE o_orderstatus = 'F' GROUP BY 1) r ON l.k = r.k"""


def _join_query(how: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        left = table(spark, d, "customer").filter("c_acctbal > 0")
        left = left.select(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("nation"))
        right = table(spark, d, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("custkey"))
        right = right.agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
        return training.join_tables(left, right, "custkey", how)

    return run


for _how in ("inner", "left", "right", "full"):
    QUERIES[f"join_{_how}"] = _join_query(_how)
    ORACLES[f"join_{_how}"] = _JOIN_SQL.format(how=_how)
