"""What several operators of this subpackage share: Arrow maps, word hashes, bounded broadcasts, stages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspan import session

#: Rows of a list of ids that may be broadcast: 2 million longs are 16 MB, about 64 MB as a hash table.
BROADCAST_IDS = 2_000_000
#: Distinct words whose hashes a task remembers before it starts anew.
REMEMBERED_WORDS = 100_000
#: Settings of Arrow batches, and the most that they may be here.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1_000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}
#: Rows of an Arrow batch that become Python values at once.
ROWS = 128


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` by a function of this package, over batches small enough for whole texts.

    Lowers the session's rows and bytes of an Arrow batch if they are larger: by default
    ten thousand texts would be held several times over, in the executor and in its worker.
    """
    spark = df.sparkSession
    session.let_workers_import(spark)
    for name, most in BATCH.items():
        now = int(spark.conf.get(name).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(name, str(most))
    return df.mapInArrow(function, schema)


def utf8(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding and a few rows at a time."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for start in range(0, len(column), ROWS):
        yield from column.slice(start, ROWS).cast(kind).to_pylist()


class WordHashes(dict):
    """64-bit hash of a word, remembered for as many words as memory is set aside for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of every run of ``length`` words; of the whole sequence, if it is shorter; none of no words."""
    if not len(words):
        return words
    length = min(length, len(words))
    n = len(words) - length + 1
    value = words[:n].copy()
    for j in range(1, length):
        value = value * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    return scramble(value + np.uint64(length))


def distinct_sorted(values: np.ndarray) -> np.ndarray:
    if not len(values):
        return values
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))]


def restrict(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` that have (or with ``left_anti`` lack) their key in the staged table ``ids``.

    The ids are broadcast only where a count has shown that they are few; beyond that
    both sides are shuffled. The rows are the same either way.
    """
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, key, how)


class Stages:
    """Tables written to the shared folder for the length of a computation."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table under a name; an earlier one of that name is removed afterwards."""
        staged, path = session.stage(df)
        old, self.paths[name] = self.paths.get(name), path
        if old:
            session.discard(self.spark, old)
        return staged

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                session.discard(self.spark, self.paths.pop(name))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
