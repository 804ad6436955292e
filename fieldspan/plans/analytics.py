"""Ensemble analytics over model scores; descriptive statistics over the graph corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspan.functions import countries
from fieldspan.functions.predicates import any_code_holds, holds_code, in_countries
from fieldspan.operators import classify, ensembles, stats
from fieldspan.plans import corpora as c
from fieldspan.plans.corpora import ARCHITECTURES, GRAPH_SQL, MODELS, PUB, SCORE_SQL, table, with_ctes
from fieldspan.plans.graph import describe_sql, expansion_full, rounded_summary

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _scores(last: str, **more: str) -> str:
    return with_ctes({**SCORE_SQL, **more}, last)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in columns})


# --- ensembles --------------------------------------------------------------

_WIDE = ", ".join(f"round(max(score) FILTER (model_id = '{m}'), 6) AS {m}" for m in MODELS)


@query(_scores(f"SELECT architecture, doc_id, {_WIDE} FROM score GROUP BY architecture, doc_id"))
def ensemble_scores(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(classify.wide_scores(c.scores(spark, d), ["architecture", "doc_id"], MODELS), *MODELS)


_METRICS = """SELECT {by}, round(avg(((score >= 0.5)::INT = label)::INT), 6) AS binary_accuracy,
    round(coalesce(count(*) FILTER (score >= 0.5 AND label = 1) / nullif(count(*) FILTER (score >= 0.5), 0)::DOUBLE, 0), 6) AS precision,
    round(coalesce(count(*) FILTER (score >= 0.5 AND label = 1) / nullif(count(*) FILTER (label = 1), 0)::DOUBLE, 0), 6) AS recall,
    round(avg(-ln(CASE WHEN label = 1 THEN p ELSE 1.0::DOUBLE - p END)), 6) AS loss
    FROM (SELECT *, least(greatest(score, 1e-7::DOUBLE), 1.0::DOUBLE - 1e-7::DOUBLE) AS p FROM labelled) GROUP BY {by}"""


@query(_scores(_METRICS.format(by="architecture, model_id")))
def fit_metrics(spark: SparkSession, d: str) -> DataFrame:
    found = classify.class_metrics(c.labelled_scores(spark, d), ["architecture", "model_id"])
    return _rounded(found, "binary_accuracy", "precision", "recall", "loss")


@query(_scores(_METRICS.format(by="architecture")))
def class_metrics(spark: SparkSession, d: str) -> DataFrame:
    found = classify.class_metrics(c.labelled_scores(spark, d), ["architecture"])
    return _rounded(found, "binary_accuracy", "precision", "recall", "loss")


@query(
    _scores(
        """SELECT architecture, model_id, CASE WHEN label = 0 THEN 'false_positive' ELSE 'false_negative' END AS error,
        round(score, 6) AS score, text FROM labelled JOIN documents USING (doc_id)
        WHERE (score > 0.5 AND label = 0) OR (score <= 0.5 AND label = 1)"""
    )
)
def error_report(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "documents").select("doc_id", "text")
    scored = c.labelled_scores(spark, d).join(texts, "doc_id")
    return _rounded(classify.error_report(scored, by=["architecture", "model_id"]), "score")


_STD = "SELECT architecture, doc_id, stddev_samp(score) AS std_score FROM score GROUP BY architecture, doc_id"


@query(_scores(describe_sql("std", "architecture", "std_score"), std=_STD))
def score_dispersion(spark: SparkSession, d: str) -> DataFrame:
    return rounded_summary(ensembles.score_dispersion(c.scores(spark, d), "doc_id"))


_CONSENSUS = """SELECT architecture, nb_models, nb_positives, nb_positives / total AS share_positives,
    sum(nb_positives) OVER (PARTITION BY architecture ORDER BY nb_models DESC) / total AS cumshare_positives
    FROM (SELECT *, (sum(nb_positives) OVER (PARTITION BY architecture))::DOUBLE AS total FROM (
      SELECT architecture, nb_models, nb_models * count(*) AS nb_positives FROM (
        SELECT architecture, doc_id, count(*) FILTER (score > 0.5) AS nb_models FROM score GROUP BY architecture, doc_id)
      GROUP BY architecture, nb_models))"""


@query(
    _scores(
        """SELECT architecture, nb_models, nb_positives, round(share_positives, 6) AS share_positives,
        round(cumshare_positives, 6) AS cumshare_positives FROM con""",
        con=_CONSENSUS,
    )
)
def consensus(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ensembles.consensus(c.scores(spark, d), "doc_id"), "share_positives", "cumshare_positives")


_PER_ARCH = ", ".join(f"round(max(cumshare_positives) FILTER (architecture = '{a}'), 6) AS {a}" for a in ARCHITECTURES)


@query(_scores(f"SELECT nb_models, {_PER_ARCH} FROM con GROUP BY nb_models", con=_CONSENSUS))
def consensus_by_architecture(spark: SparkSession, d: str) -> DataFrame:
    table_ = ensembles.consensus_by_architecture(c.scores(spark, d), "doc_id", ARCHITECTURES)
    return _rounded(table_, *ARCHITECTURES)


_UNPIVOTED = "UNION ALL ".join(
    f"SELECT architecture, '{s}' AS stat, {s}::DOUBLE AS value FROM summary "
    for s in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")
)
_STAT_ARCH = ", ".join(f"max(value) FILTER (architecture = '{a}') AS {a}" for a in ARCHITECTURES)


@query(
    _scores(
        f"SELECT stat, {_STAT_ARCH} FROM ({_UNPIVOTED}) GROUP BY stat",
        std=_STD,
        summary=describe_sql("std", "architecture", "std_score"),
    )
)
def dispersion_by_architecture(spark: SparkSession, d: str) -> DataFrame:
    table_ = ensembles.dispersion_by_architecture(c.scores(spark, d), "doc_id", ARCHITECTURES)
    return _rounded(table_, *ARCHITECTURES)


@query(
    _scores(
        describe_sql("long", "architecture, metric", "value"),
        metrics=_METRICS.format(by="architecture, model_id").replace("round(", "(").replace(", 6)", ")"),
        long="""SELECT architecture, 'binary_accuracy' AS metric, binary_accuracy AS value FROM metrics
        UNION ALL SELECT architecture, 'precision', precision FROM metrics
        UNION ALL SELECT architecture, 'recall', recall FROM metrics
        UNION ALL SELECT architecture, 'f1-score', 2.0::DOUBLE * precision * recall / (precision + recall) FROM metrics
          WHERE precision + recall > 0""",
    )
)
def model_performance(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of every model on the labelled documents; the loss is known for one architecture only and vanishes."""
    found = classify.class_metrics(c.labelled_scores(spark, d), ["architecture", "model_id"])
    metas = found.selectExpr(
        "architecture",
        "model_id",
        "stack(4, 'binary_accuracy', binary_accuracy, 'precision', precision, 'recall', recall, 'loss', loss) AS (metric, value)",
    ).filter("metric <> 'loss' OR architecture = 'cnn'")
    return rounded_summary(ensembles.model_performance(metas))


@query(
    _scores(
        """SELECT architecture, a AS model_id, round(avg(r), 6) AS mean_corr FROM (
        SELECT l.architecture, l.model_id AS a, r.model_id AS b, corr(l.score, r.score) AS r
        FROM score l JOIN score r ON l.architecture = r.architecture AND l.doc_id = r.doc_id GROUP BY ALL)
        GROUP BY architecture, a"""
    )
)
def model_representativeness(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ensembles.representativeness(c.scores(spark, d), "doc_id", MODELS), "mean_corr")


@query(
    _scores(
        """SELECT architecture, a AS model_id, round(mean_corr, 6) AS mean_corr FROM (
        SELECT architecture, a, avg(r) AS mean_corr FROM (
          SELECT l.architecture, l.model_id AS a, r.model_id AS b, corr(l.score, r.score) AS r
          FROM score l JOIN score r ON l.architecture = r.architecture AND l.doc_id = r.doc_id GROUP BY ALL)
        GROUP BY architecture, a)
        QUALIFY row_number() OVER (PARTITION BY architecture ORDER BY round(mean_corr, 10) DESC, a) = 1"""
    )
)
def representative_model(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ensembles.most_representative(c.scores(spark, d), "doc_id", MODELS), "mean_corr")


# --- statistics -------------------------------------------------------------

def _graph(last: str, *names: str) -> str:
    return with_ctes(GRAPH_SQL, last, *names)


_FULL = tuple(n for n in GRAPH_SQL if n != "ipc")


@query(
    """WITH p AS (SELECT l_orderkey AS k, CASE WHEN p_brand = 'Brand#1' THEN '' WHEN p_brand <> 'Brand#2' THEN p_brand END AS brand,
      l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey),
    t AS (SELECT brand FROM p WHERE brand <> '' GROUP BY brand ORDER BY sum(l_quantity) DESC, brand LIMIT 8)
    SELECT coalesce(t.brand, 'others') AS brand, count(*) AS n, round(sum(l_quantity), 2) AS quantity
    FROM p LEFT JOIN t ON p.brand = t.brand GROUP BY 1"""
)
def densify(spark: SparkSession, d: str) -> DataFrame:
    brand = F.when(F.col("p_brand") == "Brand#1", F.lit("")).when(F.col("p_brand") != "Brand#2", F.col("p_brand"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), brand.alias("brand"))
    lines = table(spark, d, "lineitem").select("l_partkey", "l_quantity").join(part, "l_partkey")
    dense = stats.densify(lines, "brand", F.sum("l_quantity"), 8)
    return dense.groupBy("brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def _dated(spark: SparkSession, d: str) -> DataFrame:
    """Members of the expansion with year, country and level."""
    members = expansion_full(spark, d).select(PUB, "expansion_level")
    return members.join(c.located(spark, d), PUB).withColumn("publication_year", stats.publication_year())


_DATED = """SELECT e.expansion_level, p.country_code, d // 10000 AS publication_year FROM expansion e JOIN pub p
    ON e.publication_number = p.k"""


@query(
    with_ctes(
        {**{n: GRAPH_SQL[n] for n in _FULL}, "x": _DATED},
        """SELECT 'country' AS kind, country_code AS first, NULL::VARCHAR AS second, count(*) AS count, NULL::DOUBLE AS normalized_count FROM x GROUP BY country_code
        UNION ALL SELECT 'year', publication_year::VARCHAR, NULL, count(*), NULL FROM x GROUP BY publication_year
        UNION ALL SELECT 'year_level', publication_year::VARCHAR, expansion_level, count(*), NULL FROM x GROUP BY publication_year, expansion_level
        UNION ALL SELECT 'year_country', publication_year::VARCHAR, country_code, count(*), NULL FROM x GROUP BY publication_year, country_code
        UNION ALL SELECT 'year_country_normalised', publication_year::VARCHAR, country_code, count(*),
          round(count(*) / (max(count(*)) OVER (PARTITION BY country_code))::DOUBLE, 6) FROM x GROUP BY publication_year, country_code""",
    )
)
def counts_country_year(spark: SparkSession, d: str) -> DataFrame:
    counted = stats.country_date_counts(_dated(spark, d))
    first = F.when(F.col("kind") == "country", F.col("country_code")).otherwise(F.col("publication_year").cast("string"))
    second = F.when(F.col("kind") != "country", F.coalesce("expansion_level", "country_code"))
    return counted.select("kind", first.alias("first"), second.alias("second"), "count", F.round("normalized_count", 6).alias("normalized_count"))


@query(
    _graph(
        """SELECT publication_year, country_code, count(*) AS count,
        round(count(*) / (sum(count(*)) OVER (PARTITION BY publication_year))::DOUBLE, 6) AS normalized_count
        FROM (SELECT d // 10000 AS publication_year, country_code FROM pub) GROUP BY publication_year, country_code""",
        "pub",
    )
)
def normalised_counts(spark: SparkSession, d: str) -> DataFrame:
    dated = c.located(spark, d).withColumn("publication_year", stats.publication_year())
    return _rounded(stats.normalised_counts(dated, ["publication_year", "country_code"]), "normalized_count")


@query("SELECT o_orderkey AS publication_number, year(o_orderdate)::BIGINT AS publication_year FROM orders")
def publication_years(spark: SparkSession, d: str) -> DataFrame:
    return c.publications(spark, d).select(PUB, stats.publication_year().alias("publication_year"))


def _inventors(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of an order's lines as inventors; part of them without a country."""
    country = F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit("C"), F.col("s_nationkey").cast("string")))
    supplier = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("inventor_name"), country.alias("inventor_country")
    )
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias(PUB), "l_suppkey")
    return lines.join(supplier, "l_suppkey").drop("l_suppkey")


def _assignees(spark: SparkSession, d: str) -> DataFrame:
    """The customer of an order as its assignee."""
    customer = table(spark, d, "customer").select(
        F.col("c_custkey").alias("o_custkey"),
        F.col("c_name").alias("assignee_name"),
        F.concat(F.lit("C"), F.col("c_nationkey").cast("string")).alias("assignee_country"),
    )
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias(PUB), "o_custkey")
    return orders.join(customer, "o_custkey").drop("o_custkey")


def _years(spark: SparkSession, d: str) -> DataFrame:
    return c.publications(spark, d).select(PUB, stats.publication_year().alias("publication_year"))


ENTITY_SQL = {
    "inv": """SELECT l_orderkey AS k, s_name AS name, CASE WHEN s_suppkey % 5 <> 0 THEN 'C' || s_nationkey END AS country
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "ent": """SELECT k, name, country, year(o_orderdate)::BIGINT AS publication_year,
        1.0::DOUBLE / count(*) OVER (PARTITION BY k) AS nb FROM inv LEFT JOIN orders ON o_orderkey = k""",
    "topc": "SELECT country FROM ent WHERE country <> '' GROUP BY country ORDER BY round(sum(nb), 9) DESC, country LIMIT 10",
    "topn": "SELECT name FROM ent WHERE name <> '' GROUP BY name ORDER BY round(sum(nb), 9) DESC, name LIMIT 10",
    "dense": """SELECT publication_year, nb, coalesce(c.country, 'others') AS country, coalesce(n.name, 'others') AS name
        FROM ent LEFT JOIN topc c ON ent.country = c.country LEFT JOIN topn n ON ent.name = n.name""",
}


@query(
    with_ctes(
        ENTITY_SQL,
        """SELECT k AS publication_number, name AS inventor_name, country AS inventor_country, publication_year,
        round(nb, 6) AS nb_inventor FROM ent""",
        "inv", "ent",
    )
)
def entity_weights(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.entity_weights(_inventors(spark, d), _years(spark, d), "inventor"), "nb_inventor")


@query(
    with_ctes(
        ENTITY_SQL,
        """SELECT 'country' AS kind, NULL::BIGINT AS publication_year, country AS entity, round(sum(nb), 4) AS count FROM dense GROUP BY country
        UNION ALL SELECT 'year_country', publication_year, country, round(sum(nb), 4) FROM dense GROUP BY publication_year, country
        UNION ALL SELECT 'name', NULL, name, round(sum(nb), 4) FROM dense GROUP BY name
        UNION ALL SELECT 'year_name', publication_year, name, round(sum(nb), 4) FROM dense GROUP BY publication_year, name""",
    )
)
def entity_counts(spark: SparkSession, d: str) -> DataFrame:
    entities = stats.entity_weights(_inventors(spark, d), _years(spark, d), "inventor")
    counted = stats.entity_counts(entities, "inventor")
    return counted.select("kind", "publication_year", F.coalesce("country", "name").alias("entity"), F.round("count", 4).alias("count"))


def _geo(spark: SparkSession, d: str) -> DataFrame:
    """Orders' places: the inventor's is the line's supplier balance, the applicant's the customer's."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("place"))
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    placed = table(spark, d, "orders").select(F.col("o_orderkey").alias(PUB), "o_custkey").join(customer, "o_custkey")
    placed = placed.join(nation, "c_nationkey").select(
        PUB, "place", F.col("c_nationkey").cast("double").alias("lat"), (F.col("c_nationkey") * -2).cast("double").alias("lng")
    )
    years = _years(spark, d)
    inventors = stats.entity_weights(_inventors(spark, d), years, "inventor")
    assignees = stats.entity_weights(_assignees(spark, d), years, "assignee")
    return stats.geo_union(placed, placed, inventors, assignees)


_GEO_SQL = {
    **{n: ENTITY_SQL[n] for n in ("inv", "ent")},
    "place": """SELECT o_orderkey AS k, n_name AS place, c_nationkey::DOUBLE AS lat, (c_nationkey * -2)::DOUBLE AS lng,
        year(o_orderdate)::BIGINT AS publication_year, c_name, 'C' || c_nationkey AS c_country
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "geo": """SELECT place.k AS publication_number, place, lat, lng, 'inventor' AS type, ent.name, ent.country,
        ent.publication_year, ent.nb FROM place LEFT JOIN ent ON place.k = ent.k
        UNION ALL SELECT k, place, lat, lng, 'applicant', c_name, c_country, publication_year, 1.0::DOUBLE FROM place""",
}


@query(with_ctes(_GEO_SQL, "SELECT * EXCLUDE nb, round(nb, 6) AS nb FROM geo"))
def geo_union(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_geo(spark, d), "nb")


@query(
    with_ctes(
        _GEO_SQL,
        """SELECT name, type, lat, lng, publication_year, count(*) AS count FROM geo
        WHERE name IS NOT NULL AND publication_year IS NOT NULL GROUP BY name, type, lat, lng, publication_year""",
    )
)
def geo_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.place_counts(_geo(spark, d))


# --- countries and class codes ----------------------------------------------

_CODES = list(countries.COUNTRY_NAMES)
_COUNTRY_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in countries.COUNTRY_NAMES.items())
_OFFICE_SQL = f"CASE WHEN c_nationkey = 24 THEN 'XX' ELSE ({_CODES})[c_nationkey * 4 + 1] END"


def _offices(spark: SparkSession, d: str) -> DataFrame:
    """Customers with an office code derived from their nation; one nation has an unknown code."""
    codes = F.array(*[F.lit(code) for code in _CODES])
    office = F.when(F.col("c_nationkey") == 24, F.lit("XX")).otherwise(F.get(codes, F.col("c_nationkey") * 4))
    return table(spark, d, "customer").select("c_custkey", office.alias("country_code"))


@query(
    f"""SELECT c_custkey, o.country_code, v.country_name, v.country_code AS back FROM (SELECT c_custkey, {_OFFICE_SQL} AS country_code
    FROM customer) o LEFT JOIN (VALUES {_COUNTRY_VALUES}) AS v(country_code, country_name) ON o.country_code = v.country_code"""
)
def country_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Code to name and back."""
    named = countries.with_country_name(_offices(spark, d))
    return countries.with_country_code(named, code="back")


@query(f"SELECT 'XX' AS country_code, count(*) AS n FROM customer WHERE c_nationkey = 24 HAVING count(*) > 0")
def country_unknown(spark: SparkSession, d: str) -> DataFrame:
    return countries.unknown_countries(_offices(spark, d))


@query(
    f"""SELECT * FROM (SELECT c_custkey, {_OFFICE_SQL} AS country_code FROM customer)
    WHERE country_code IN ({', '.join(repr(x) for x in countries.COUNTRY_GROUPS['english_speaking'] + countries.COUNTRY_GROUPS['g7'])})"""
)
def country_filter(spark: SparkSession, d: str) -> DataFrame:
    names = countries.country_names(countries.COUNTRY_GROUPS["english_speaking"] + countries.COUNTRY_GROUPS["g7"])
    named = countries.with_country_name(_offices(spark, d))
    return named.filter(in_countries("country_name", names)).select("c_custkey", "country_code")


@query(_graph("SELECT DISTINCT k AS publication_number FROM cpc WHERE code LIKE '%Brand#1%' OR code LIKE '%Brand#22%'", "cpc"))
def class_contains(spark: SparkSession, d: str) -> DataFrame:
    test = holds_code("code", ["Brand#1/10", "Brand#22/3", "Brand#1/4"], main_group=True)
    return c.undated_codes(spark, d).filter(test).select(PUB).distinct()


@query("SELECT doc_id AS publication_number FROM documents WHERE source LIKE '%src1%' OR source || '/' || lang LIKE '%/de%'")
def class_contains_nested(spark: SparkSession, d: str) -> DataFrame:
    return c.documents(spark, d).filter(any_code_holds("cpc", ["src1", "/de"])).select(PUB)
