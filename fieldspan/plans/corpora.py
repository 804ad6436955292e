"""Corpora over the given tables, as DataFrames and as the SQL of their twins.

Graph corpus: orders are publications, customers families, parts class codes. Text
corpus: documents with their labels. Score corpus: thirty models per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldspan.functions.draws import unit_draw
from fieldspan.operators.expansion import MANUAL, SEED, both_directions
from fieldspan.operators.robustness import plan_runs

PUB = "publication_number"
#: Buckets of the stored links; a multiple of the cores that follow them.
LINK_BUCKETS = 16
N_PC = 5
SEED_SHARE = 0.005
TECHNOLOGIES = {"alpha": 42, "beta": 43}
RUNS = plan_runs(list(TECHNOLOGIES), (0.5, 0.7, 0.9), 5)
ARCHITECTURES = ["cnn", "mlp", "transformers"]
MODELS = [f"s{i}" for i in range(10)]
KEYWORDS = ["erthe", "ment ", "onth"]
PREFIXES = ["src1", "src7"]
OPTIONS = ["Clean prose", "Mixed content", "Noise"]


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str, partitions: int = 0) -> DataFrame:
    """A given table; its schema is looked up once, since every look-up is a job.

    With ``partitions`` its rows are dealt into that many, unless it is stored in as many files.
    """
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    rows = spark.read.schema(_SCHEMAS[path]).parquet(path)
    return rows.repartition(partitions) if partitions and len(rows.inputFiles()) < partitions else rows


def text_partitions(spark: SparkSession) -> int:
    """Partitions of the text queries: the given documents are one row group, which one task would read and cut into terms.

    A parameter of the session; 0 takes the texts as they are stored, as for a corpus of many files.
    """
    return int(spark.conf.get("spark.fieldspan.textPartitions", "16"))


def u_sql(seed: int | str, key: str) -> str:
    """SQL twin of ``unit_draw``."""
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def h_sql(seed: int | str, key: str) -> str:
    """SQL twin of ``draw_hash``."""
    return f"md5('{seed}:' || {key})"


# --- graph corpus -----------------------------------------------------------

def _date(column: str) -> Column:
    c = F.col(column)
    return (F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)).cast("bigint")


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(publication_number, family_id, publication_date)."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias(PUB), F.col("o_custkey").alias("family_id"), _date("o_orderdate").alias("publication_date")
    )


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publications with the country of their family."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("family_id"), "c_nationkey")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country_code"))
    return publications(spark, sf_dir).join(customer, "family_id").join(nation, "c_nationkey").drop("c_nationkey")


def class_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(publication_number, cpc, ipc), one row per line; repeats possible."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("cpc"),
        F.col("p_type").alias("ipc"),
    )
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias(PUB), "l_partkey")
    return lines.join(part, "l_partkey").drop("l_partkey")


def codes(spark: SparkSession, sf_dir: str, cls: str = "cpc") -> DataFrame:
    """(publication_number, publication_date, code), a code as often as it is listed."""
    pairs = class_lines(spark, sf_dir).select(PUB, F.col(cls).alias("code"))
    return pairs.join(publications(spark, sf_dir).select(PUB, "publication_date"), PUB)


def undated_codes(spark: SparkSession, sf_dir: str, cls: str = "cpc") -> DataFrame:
    """The same pairs without the date, for operators that do not ask for it."""
    pairs = class_lines(spark, sf_dir).select(PUB, F.col(cls).alias("code"))
    return pairs.withColumn("publication_date", F.lit(None).cast("bigint"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(citing, cited): every line cites the order its part and supplier point to; repeats are repeated citations."""
    cited = F.col("l_partkey") * 7 + F.col("l_suppkey") % 7
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("citing"), cited.alias("cited")).filter(F.col("citing") != F.col("cited"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both_directions(citations(spark, sf_dir), "citing", "cited")


def labelled(spark: SparkSession, sf_dir: str, seed: int = 42) -> DataFrame:
    """(publication_number, expansion_level): half a percent seed, as many antiseeds, the rest without a level."""
    u = unit_draw(seed, "o_orderkey")
    level = F.when(u < SEED_SHARE, F.lit(SEED)).when(u < 2 * SEED_SHARE, F.lit(MANUAL))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(PUB), level.alias("expansion_level"))


def labelled_technologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of both technologies, read in one scan."""
    rows = []
    for name, seed in TECHNOLOGIES.items():
        u = unit_draw(seed, "o_orderkey")
        level = F.when(u < SEED_SHARE, F.lit(SEED)).when(u < 2 * SEED_SHARE, F.lit(MANUAL))
        rows.append(F.struct(F.lit(name).alias("technology"), level.alias("expansion_level")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(PUB), F.inline(F.array(*rows)))


def nested_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publications with class codes and citations as arrays of structs, the layout of the real tables."""
    classes = class_lines(spark, sf_dir).groupBy(PUB).agg(
        F.transform(F.array_sort(F.collect_set("cpc")), lambda c: F.struct(c.alias("code"))).alias("cpc"),
        F.transform(F.array_sort(F.collect_set("ipc")), lambda c: F.struct(c.alias("code"))).alias("ipc"),
    )
    cited = citations(spark, sf_dir).groupBy(F.col("citing").alias(PUB)).agg(
        F.transform(F.array_sort(F.collect_set("cited")), lambda c: F.struct(c.alias(PUB))).alias("citation")
    )
    return located(spark, sf_dir).join(classes, PUB, "left").join(cited, PUB, "left")


def graph_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, abstract and forward citations of the graph corpus."""
    citing = citations(spark, sf_dir).groupBy(F.col("cited").alias(PUB)).agg(
        F.transform(F.array_sort(F.collect_set("citing")), lambda c: F.struct(c.alias(PUB))).alias("cited_by")
    )
    texts = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias(PUB), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("abstract")
    )
    return texts.join(citing, PUB)


_LEVEL_SQL = f"CASE WHEN u < {SEED_SHARE} THEN '{SEED}' WHEN u < {2 * SEED_SHARE} THEN '{MANUAL}' END"

GRAPH_SQL = {
    "pub": """SELECT o_orderkey AS k, o_custkey AS family_id,
        (year(o_orderdate)*10000 + month(o_orderdate)*100 + day(o_orderdate))::BIGINT AS d,
        n_name AS country_code, o_orderpriority AS title, o_orderstatus AS abstract
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "cpc": """SELECT l_orderkey AS k, p_brand || '/' || p_size AS code
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "ipc": "SELECT l_orderkey AS k, p_type AS code FROM lineitem JOIN part ON l_partkey = p_partkey",
    "cit": """SELECT DISTINCT l_orderkey AS citing, l_partkey * 7 + l_suppkey % 7 AS cited
        FROM lineitem WHERE l_orderkey <> l_partkey * 7 + l_suppkey % 7""",
    "seed": f"SELECT k, {_LEVEL_SQL} AS level FROM (SELECT o_orderkey AS k, {u_sql(42, 'o_orderkey')} AS u FROM orders)",
    "seedf": f"""SELECT code, n, n_patents, n::DOUBLE / n_patents AS freq FROM (
        SELECT code, count(*) AS n, (SELECT count(*) FROM seed WHERE level = '{SEED}') AS n_patents
        FROM cpc JOIN seed USING (k) WHERE level = '{SEED}' GROUP BY code)""",
    "win": f"""SELECT quantile_disc(d // 10000, 0.25) AS p25, quantile_disc(d // 10000, 0.75) AS p75
        FROM pub JOIN seed USING (k) WHERE level = '{SEED}'""",
    "inwin": "SELECT k FROM pub, win WHERE d BETWEEN p25 * 10000 AND p75 * 10000",
    "unif": """SELECT code, n, n_patents, n::DOUBLE / n_patents AS freq FROM (
        SELECT code, count(*) AS n, (SELECT count(*) FROM inwin) AS n_patents
        FROM cpc JOIN inwin USING (k) GROUP BY code)""",
    "odds": """SELECT code, s.freq AS seed_freq, u.freq AS universe_freq, s.freq / u.freq AS odds
        FROM seedf s JOIN unif u USING (code)""",
    "top": f"SELECT code FROM odds ORDER BY odds DESC, code LIMIT {N_PC}",
    "pc": "SELECT DISTINCT k FROM cpc JOIN top USING (code)",
    "start": f"SELECT k FROM seed WHERE level = '{SEED}' UNION SELECT k FROM pc",
    "l1b": "SELECT DISTINCT cited AS k FROM cit WHERE citing IN (SELECT k FROM start)",
    "l1f": "SELECT DISTINCT citing AS k FROM cit WHERE cited IN (SELECT k FROM start)",
    "l1": "SELECT k FROM l1b UNION SELECT k FROM l1f",
    "l2b": "SELECT DISTINCT cited AS k FROM cit WHERE citing IN (SELECT k FROM l1)",
    "l2f": "SELECT DISTINCT citing AS k FROM cit WHERE cited IN (SELECT k FROM l1)",
    "raw": f"""SELECT k, level FROM seed WHERE level LIKE '%SEED%' UNION ALL SELECT k, 'PC' FROM pc
        UNION ALL SELECT k, 'L1-BACK' FROM l1b UNION ALL SELECT k, 'L1-FOR' FROM l1f
        UNION ALL SELECT k, 'L2-BACK' FROM l2b UNION ALL SELECT k, 'L2-FOR' FROM l2f""",
    "expansion": """SELECT k AS publication_number,
        CASE WHEN s LIKE '%ANTISEED%' THEN 'ANTISEED' WHEN s LIKE '%SEED%' THEN 'SEED' WHEN s LIKE '%PC%' THEN 'PC'
             WHEN s LIKE '%L1-BACK%' THEN 'L1-BACK' WHEN s LIKE '%L1-FOR%' THEN 'L1-FOR'
             WHEN s LIKE '%L2-BACK%' THEN 'L2-BACK' WHEN s LIKE '%L2-FOR%' THEN 'L2-FOR' END AS expansion_level,
        s AS expansion_level_, nb_match
        FROM (SELECT k, string_agg(level, ',' ORDER BY level) AS s, count(level) AS nb_match FROM raw GROUP BY k)""",
}


def with_ctes(ctes: dict[str, str], last: str, *names: str) -> str:
    """SQL with the named tables, in the order they depend on each other."""
    chosen = names or tuple(ctes)
    return "WITH " + ",\n".join(f"{n} AS ({ctes[n]})" for n in ctes if n in chosen) + "\n" + last


# --- text corpus ------------------------------------------------------------

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(publication_number, family_id, title, abstract, cpc[], similar[]): title is the first line."""
    similar = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"),
        F.array(F.col("vec_id") + F.col("label") + 1, F.col("vec_id") * 2, F.lit(None).cast("bigint")).alias("ids"),
    )
    docs = table(spark, sf_dir, "documents").join(similar, "doc_id", "left")
    return docs.select(
        F.col("doc_id").alias(PUB),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("abstract"),
        F.array(F.struct(F.col("source").alias("code")), F.struct(F.concat("source", F.lit("/"), "lang").alias("code"))).alias("cpc"),
        F.transform("ids", lambda i: F.struct(i.alias(PUB))).alias("similar"),
    )


def document_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(publication_number, family_id): three documents a family."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias(PUB), F.expr("doc_id div 3").alias("family_id"))


def listed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items whose similar ones are wanted."""
    return table(spark, sf_dir, "labels").filter(F.col("toxic") == 1).select(F.col("doc_id").alias(PUB))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(family_id, expansion_level, text): one family per document; quality 1 is seed, 0 antiseed."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    level = F.when(F.col("quality") == 1, F.lit(SEED)).when(F.col("quality") == 0, F.lit(MANUAL))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("family_id"), level.alias("expansion_level"), "text")


def document_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(family_id, abstract) of all documents."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("family_id"), F.col("text").alias("abstract"))


TEXT_SQL = {
    "doc": """SELECT doc_id AS k, doc_id // 3 AS family_id, string_split(text, chr(10))[1] AS title, text AS abstract,
        source, lang FROM documents""",
    "near": f"""SELECT unnest([vec_id + label + 1, vec_id * 2]) AS k FROM embeddings
        WHERE vec_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AND vec_id IN (SELECT doc_id FROM documents)""",
    "c_similar": "SELECT k, title, abstract, 'patent' AS match FROM near JOIN doc USING (k)",
    "c_class": f"""SELECT k, title, abstract, 'cpc' AS match FROM (
        SELECT k, title, abstract, unnest([source, source || '/' || lang]) AS code FROM doc)
        WHERE {' OR '.join(f"code LIKE '{p}%'" for p in PREFIXES)}""",
    "c_keyword": f"""SELECT k, title, abstract, 'keyword' AS match FROM doc
        WHERE {' OR '.join(f"lower(abstract) LIKE '%{w}%'" for w in KEYWORDS)}""",
    "cand": """SELECT * FROM c_similar UNION ALL SELECT * FROM c_class UNION ALL SELECT * FROM c_keyword""",
    "fam": """SELECT doc.family_id, string_agg(c.k::VARCHAR, ',' ORDER BY c.k::VARCHAR) AS publication_number,
        arg_min(c.title || chr(10) || chr(10) || c.abstract, c.k) AS text,
        array_to_string(list_sort(list_distinct(list(c.match))), ',') AS match, count(*) AS match_number
        FROM cand c JOIN doc USING (k) GROUP BY doc.family_id""",
    "lab": f"""SELECT d.doc_id AS family_id, CASE quality WHEN 1 THEN '{SEED}' WHEN 0 THEN '{MANUAL}' END AS expansion_level,
        d.text FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
}


# --- score corpus -----------------------------------------------------------

def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(architecture, model_id, doc_id, score): a part all models share and one of their own."""
    names = [
        F.struct(F.lit(a).alias("architecture"), F.lit(m).alias("model_id")) for a in ARCHITECTURES for m in MODELS
    ]
    rows = table(spark, sf_dir, "documents").select("doc_id", F.inline(F.array(*names)))
    own = unit_draw(7, "architecture", "model_id", "doc_id")
    return rows.select("architecture", "model_id", "doc_id", (unit_draw(7, "doc_id") * 0.7 + own * 0.3).alias("score"))


def labelled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the labelled documents, with quality as the label."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return scores(spark, sf_dir).join(labels, "doc_id")


SCORE_SQL = {
    "score": f"""SELECT architecture, model_id, doc_id,
        {u_sql(7, 'doc_id')} * 0.7::DOUBLE + {u_sql(7, "architecture || ':' || model_id || ':' || doc_id")} * 0.3::DOUBLE AS score
        FROM documents, (SELECT unnest({ARCHITECTURES}) AS architecture), (SELECT unnest({MODELS}) AS model_id)""",
    "labelled": "SELECT s.*, l.quality AS label FROM score s JOIN labels l ON s.doc_id = l.doc_id",
}
