"""A folder of JSON line files scored file by file, each exactly once.

The batch scorer reads a folder once. Where files keep coming, the same narrow plan
runs over the new ones only; progress lies in the shared checkpoint folder, so a
restarted job goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from fieldspan.operators.classify import TextModel, score


def score_new_files(
    spark: SparkSession,
    model: TextModel,
    source: str,
    destination: str,
    checkpoint: str,
    key: str,
    text: str = "text",
    max_files: int = 1000,
) -> StreamingQuery:
    """Start scoring all files not yet scored; the query ends when there are none left."""
    reader = spark.readStream.schema(f"{key} string, {text} string").option("maxFilesPerTrigger", max_files)
    scored = score(model, reader.json(source), key, text)
    writer = scored.writeStream.format("json").option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(availableNow=True).start(destination)
