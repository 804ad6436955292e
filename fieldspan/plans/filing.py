"""Files and tables written from the given tables and read back: the readers and sinks as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspan.operators import classify
from fieldspan.plans import corpora as c
from fieldspan.plans.corpora import ARCHITECTURES, MODELS, SCORE_SQL, table, with_ctes
from fieldspan.session import shared_dir
from fieldspan.sources import files

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def _folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


@query("SELECT doc_id, CASE WHEN lang <> 'fr' THEN text END AS text, lang FROM documents")
def files_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Documents as gzipped JSON lines with null fields, loaded by a fixed schema; an unknown field is dropped."""
    docs = table(spark, d, "documents")
    folder = _folder(spark, "jsonl")
    files.write_jsonl(docs.select("doc_id", F.when(F.col("lang") != "fr", F.col("text")).alias("text"), "lang", F.col("source").alias("unknown")), folder, gzip=True)
    return files.load_annotated(spark, f"{folder}/*.gz", "doc_id long, text string, lang string", max_bad_records=0)


@query("""SELECT d.doc_id, left(to_json({'doc_id': d.doc_id, 'lang': lang, 'source': source}), 20) AS value FROM documents d JOIN labels l USING (doc_id) WHERE toxic = 1""")
def files_inspected(spark: SparkSession, d: str) -> DataFrame:
    """Documents as JSON lines, the toxic ones cut after 20 characters, and what the inspection of the files finds."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    line = F.to_json(F.struct("doc_id", "lang", "source"))
    folder = _folder(spark, "lines")
    docs.select(F.when(F.col("toxic") == 1, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(folder)
    found = files.inspect_jsonl(spark, folder, numbered=True)
    return found.select(F.regexp_extract("value", r'"doc_id":(\d+)', 1).cast("long").alias("doc_id"), "value")


_SCORES_OF_ONE = f"architecture = '{ARCHITECTURES[0]}'"


@query(with_ctes(SCORE_SQL, f"SELECT doc_id::VARCHAR AS position, model_id, round(score, 9) AS score FROM score WHERE {_SCORES_OF_ONE}", "score"))
def files_wide_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores written as CSV files, a column for each model, and read back as one long table."""
    scores = c.scores(spark, d).where(_SCORES_OF_ONE).withColumn("score", F.round("score", 9))
    folder = _folder(spark, "scores")
    files.write_csv(classify.wide_scores(scores, "doc_id", MODELS).withColumnRenamed("doc_id", "position").coalesce(4), folder)
    return files.read_wide_scores(spark, f"{folder}/*.csv").select("position", "model_id", F.col("score"))


@query(
    with_ctes(
        SCORE_SQL,
        """SELECT 'fieldspan' AS technology, '7' AS uid, architecture, 'fieldspan_7_' || architecture AS model_id, metric, round(value, 6) AS value FROM (
        UNPIVOT (SELECT architecture, avg(((score >= 0.5)::INT = label)::INT) AS binary_accuracy,
            coalesce(count(*) FILTER (score >= 0.5 AND label = 1) / nullif(count(*) FILTER (score >= 0.5), 0)::DOUBLE, 0) AS precision,
            coalesce(count(*) FILTER (score >= 0.5 AND label = 1) / nullif(count(*) FILTER (label = 1), 0)::DOUBLE, 0) AS recall,
            avg(-ln(CASE WHEN label = 1 THEN greatest(least(score, 1 - 1e-7), 1e-7) ELSE 1 - greatest(least(score, 1 - 1e-7), 1e-7) END)) AS loss
            FROM labelled WHERE label IS NOT NULL GROUP BY architecture)
        ON binary_accuracy, precision, recall, loss INTO NAME metric VALUE value)""",
    )
)
def files_metas(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of each architecture as a model's meta file, read back as rows."""
    folder = _folder(spark, "metas")
    scored = c.labelled_scores(spark, d)
    for name in ARCHITECTURES:
        metrics = classify.class_metrics(scored.where(F.col("architecture") == name))
        classify.write_meta(metrics, folder, "fieldspan", "7", name)
    return files.read_metas(spark, f"{folder}/*/model-best").withColumn("value", F.round("value", 6))


@query("SELECT doc_id, quality, 'first' AS part FROM labels UNION ALL SELECT doc_id, toxic, 'second' FROM labels")
def table_sink(spark: SparkSession, d: str) -> DataFrame:
    """Labels saved as a bucketed table, then appended to."""
    labels, name = table(spark, d, "labels"), f"labels_{uuid.uuid4().hex}"
    files.save_table(labels.select("doc_id", "quality", F.lit("first").alias("part")), name, buckets=4, key="doc_id")
    files.save_table(labels.select("doc_id", F.col("toxic").alias("quality"), F.lit("second").alias("part")), name, append=True, buckets=4, key="doc_id")
    return spark.table(name)
