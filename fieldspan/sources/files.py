"""Files in and out. Globs and gzip are Spark's own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fieldspan.operators.annotations import json_defects
from fieldspan.sources.schemas import SEED

_CORRUPT = "_corrupt_record"
#: What orders lines of one or several files.
ORDER = ("file", "block", "position")


class TooManyBadRecords(ValueError):
    """More undecodable rows than a load tolerates."""


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, file, block, position): lines with their file and their order in it.

    ``ORDER`` sorts lines by the files' paths, then as they stand in the file: ``block`` is where
    the part of the file begins that a task reads, ``position`` rises within such a
    part. Spark packs parts of several files into a task by size, so the position alone is no order.
    """
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("position"),
    )


def inspect_jsonl(spark: SparkSession, path: str | list[str], numbered: bool = False) -> DataFrame:
    """Undecodable lines with their file; ``numbered`` adds the line number, from 0.

    Lines are numbered within the part of a file that a task reads, and counts of the parts
    before it are added, so no file is read in one piece.
    """
    lines = read_lines(spark, path)
    if not numbered:
        return json_defects(lines).select("file", "value")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    parts = parts.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("file", "block").orderBy("position")
    numbers = lines.withColumn("line", F.row_number().over(within) - 1).join(parts, ["file", "block"])
    return json_defects(numbers).select("file", (F.col("first") + F.col("line")).alias("line"), "value")


def load_annotated(
    spark: SparkSession, path: str | list[str], schema: str = SEED, max_bad_records: int = 1000
) -> DataFrame:
    """JSON lines as a table of fixed schema: unknown fields are ignored, a few bad rows tolerated.

    Bad rows are dropped, and counted first (up to the limit) so that a load with more
    of them fails before anything is built on it.
    """
    wanted = StructType.fromDDL(schema)
    checked = StructType([*wanted.fields, StructField(_CORRUPT, StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    parsed = spark.read.text(path).filter(F.trim("value") != "").select(F.from_json("value", checked, options).alias("r"))
    bad = parsed.filter(F.col(f"r.{_CORRUPT}").isNotNull())
    if bad.limit(max_bad_records + 1).count() > max_bad_records:
        raise TooManyBadRecords(f"more than {max_bad_records} bad records in {path}")
    return parsed.filter(F.col(f"r.{_CORRUPT}").isNull()).select("r.*").select(*[f.name for f in wanted.fields])


def read_metas(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(technology, uid, architecture, model_id, metric, value) from model meta files.

    A meta holds ``{"performance": {metric: value}}`` in a model folder named
    ``<technology>_<uid>_<architecture>``.
    """
    whole = spark.read.text(path, wholetext=True)
    folder = F.element_at(F.split(F.regexp_replace("_metadata.file_path", "/model-[a-z]+/[^/]+$", ""), "/"), -1)
    parts = F.split(folder, "_")
    performance = F.from_json("value", "performance map<string,double>")["performance"]
    return whole.select(
        parts[0].alias("technology"),
        parts[1].alias("uid"),
        parts[2].alias("architecture"),
        folder.alias("model_id"),
        F.explode(performance).alias("metric", "value"),
    )


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists", gzip: bool = False) -> None:
    """JSON lines, one file per partition; null fields are written, not dropped."""
    writer = df.write.mode(mode).option("ignoreNullFields", "false")
    writer.json(path, compression="gzip" if gzip else "none")


def read_wide_scores(spark: SparkSession, path: str | list[str], key: str = "position") -> DataFrame:
    """(technology, architecture, key, model_id, score) from CSV files with a row number and a score column per model.

    Every file is read with a header of its own. A name ``<kind>_<technology>_..._<architecture>.csv``
    tells technology and architecture; other names leave them null. Files are few: their
    paths are looked up, and each becomes a part of the plan.
    """
    files = spark.read.format("binaryFile").load(path).select("path").orderBy("path").collect()
    parts = []
    for name in (r.path for r in files):
        wide = spark.read.csv(name, header=True)
        index, *models = wide.columns
        words = name.rsplit("/", 1)[-1].split(".")[0].split("_")
        technology, architecture = (words[1], words[-1]) if len(words) > 2 else (None, None)
        score = [F.struct(F.lit(m).alias("model_id"), F.col("`" + m.replace("`", "``") + "`").cast("double").alias("score")) for m in models]
        cells = F.array(*score).cast("array<struct<model_id:string,score:double>>")
        tags = (F.lit(technology).cast("string").alias("technology"), F.lit(architecture).cast("string").alias("architecture"))
        parts.append(wide.select(*tags, F.col("`" + index.replace("`", "``") + "`").alias(key), F.inline(cells)))
    return reduce(DataFrame.unionByName, parts)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, header=True)


def save_table(df: DataFrame, name: str, append: bool = False, buckets: int | None = None, key: str | None = None) -> None:
    """Table sink: overwrite or append, optionally bucketed by the key later joins use."""
    writer = df.write.mode("append" if append else "overwrite").format("parquet")
    if buckets and key:
        writer = writer.bucketBy(buckets, key).sortBy(key)
    writer.saveAsTable(name)
