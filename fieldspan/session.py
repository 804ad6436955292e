"""Session for local use and the shared folder for cut lineages."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Most rows and bytes of an Arrow batch: by default ten thousand whole texts are held several times over.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1_000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}
#: Least partitions of a large shuffle (from 201 on a task would sort what it sends), and bytes up to which adaptive execution joins small ones again.
SHUFFLE_PARTITIONS, SHUFFLE_BYTES = 200, 16 << 20


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine. On a cluster use the given one."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fieldspan")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config(CHECKPOINT_DIR, tempfile.mkdtemp(prefix="fieldspan-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def let_workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it; on a cluster install it or use py-files."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` by a function of this package, over batches small enough for whole texts; lowers the session's limits if they are larger."""
    spark = df.sparkSession
    let_workers_import(spark)
    for name, most in ARROW_BATCH.items():
        if not 0 < int(spark.conf.get(name).rstrip("b")) <= most:
            spark.conf.set(name, str(most))
    return df.mapInArrow(function, schema)


@contextmanager
def small_shuffles(spark: SparkSession) -> Iterator[None]:
    """What runs inside shuffles into partitions of a bounded size, so that a task's sorts and sets do not grow with the input.

    Only where adaptive execution joins the small partitions of a small input again. Plans are made
    when they run: write inside what is to keep to this. The session's own numbers come back afterwards.
    """
    partitions, size = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    given = {name: spark.conf.get(name) for name in (partitions, size)}
    adapts = all(spark.conf.get(f"spark.sql.adaptive.{name}") == "true" for name in ("enabled", "coalescePartitions.enabled"))
    if adapts:
        spark.conf.set(partitions, str(max(SHUFFLE_PARTITIONS, int(given[partitions]))))
        spark.conf.set(size, str(min(SHUFFLE_BYTES, _bytes(given[size]))))
    try:
        yield
    finally:
        for name, value in given.items() if adapts else ():
            spark.conf.set(name, value)


def _bytes(size: str) -> int:
    """Bytes of a size as sessions write it: 67108864, 67108864b, 64m or 64MB."""
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)i?b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see, as the session names it.

    On one machine a temporary folder serves where none is named; on a cluster that
    is an error, since each executor would write to a disk of its own.
    """
    configured = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError(f"{CHECKPOINT_DIR} must name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="fieldspan-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def materialise(df: DataFrame) -> DataFrame:
    """Write a stage to the shared folder and read it back.

    For a result used several times or behind a long lineage: it outlives executors, and
    its file sizes let Spark choose joins by size.
    """
    return stage(df)[0]


def stage(df: DataFrame) -> tuple[DataFrame, str]:
    """The same, with the path of the written table for ``discard``."""
    path = f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """The same, as a table bucketed and sorted by a key: joins and groupings by it do not move its rows."""
    name = f"stage_{uuid.uuid4().hex}"
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a staged table that no later plan reads."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)

