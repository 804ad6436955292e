"""Texts as sequences of word numbers, front-padded to one length."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspan.operators.ngrams import TOP_K
from fieldspan.session import map_arrow, materialise

# Defaults of the published feature set-ups.
MAX_LENGTH = 250
PUNCTUATION = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'

#: Distinct words that a task remembers and counts before it sends the counts on.
HELD_WORDS = 200_000

_BLANKED = bytes.maketrans(PUNCTUATION.encode(), b" " * len(PUNCTUATION))


def sequence_words(text: str | None) -> list[bytes]:
    """Lower-cased words between blanks, punctuation read as a blank."""
    return [w for w in text.lower().encode().translate(_BLANKED).split(b" ") if w] if text else []


class NumberedWords(NamedTuple):
    """One staged pass over texts: (keep..., ids) per text, and (word, n) as tasks counted them."""

    texts: DataFrame
    words: DataFrame


def _number(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    numbers: dict[bytes, int] = {}
    counts: Counter = Counter()
    names, kept = None, []

    def sent() -> pa.RecordBatch:
        words, n = pa.array([[w.decode() for w in counts]], pa.list_(pa.string())), pa.array([list(counts.values())], pa.list_(pa.int64()))
        nothing = [pa.nulls(1, t) for t in kept]
        return pa.RecordBatch.from_arrays([*nothing, pa.nulls(1, pa.list_(pa.int64())), words, n], names)

    for batch in batches:
        names, kept = [*batch.schema.names[:-1], "ids", "words", "counts"], [f.type for f in list(batch.schema)[:-1]]
        ids, ends = [], [0]
        for text in batch.column(batch.num_columns - 1):
            own = sequence_words(text.as_py())
            counts.update(own)
            for word in own:
                number = numbers.get(word)
                if number is None:
                    number = numbers[word] = xxhash.xxh64_intdigest(word, 42)
                ids.append(number)
            ends.append(len(ids))
            if len(numbers) >= held:
                yield sent()
                numbers, counts = {}, Counter()
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(ids, np.uint64).view(np.int64)))
        nothing = [pa.nulls(len(batch), pa.list_(t)) for t in (pa.string(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists, *nothing], names)
    if counts:
        yield sent()


def number_words(df: DataFrame, keep: Sequence[str], text: str = "text", held: int = HELD_WORDS) -> NumberedWords:
    """Read texts once: every word as the 64-bit hash that Spark's ``xxhash64`` gives, and its count per task.

    Both go to one staged table; vocabulary, lengths and sequences then read numbers. Runs when called.
    """
    rows = df.select(*keep, F.col(text).alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    staged = materialise(map_arrow(rows, partial(_number, held=held), f"{kept}, ids array<long>, words array<string>, counts array<long>"))
    counted = staged.where("words is not null").select(F.inline(F.arrays_zip("words", "counts")).alias("word", "n"))
    return NumberedWords(staged.where("ids is not null").select(*keep, "ids"), counted)


def fit_vocabulary(train: NumberedWords, top_k: int = TOP_K) -> DataFrame:
    """(word, index) of the ``top_k - 1`` most frequent words, from 1 (0 is padding); ties by word.

    The ranking window sees the ``top_k`` rows the top-k has left over, no more.
    """
    top = train.words.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "word").limit(top_k - 1)
    rank = F.row_number().over(Window.orderBy(F.col("n").desc(), "word"))
    return top.select("word", rank.alias("index"))


def word_sequences(numbered: NumberedWords, vocabulary: DataFrame) -> DataFrame:
    """(keep..., sequence): indices of the known words in order, one row per row. No shuffle.

    The vocabulary, bounded by its ``top_k``, is read when called and travels to the tasks. A word
    outside it shares a known word's hash with a chance of ``top_k`` / 2 ** 64.
    """
    rows = vocabulary.select(F.xxhash64("word").alias("id"), F.col("index").cast("int").alias("index")).toArrow()
    order = np.argsort(ids := rows.column("id").to_numpy())
    known = vocabulary.sparkSession.sparkContext.broadcast((ids[order], rows.column("index").to_numpy()[order].astype(np.int32)))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.texts.schema.fields[:-1])
    return map_arrow(numbered.texts, partial(_look_up, vocabulary=known), f"{kept}, sequence array<int>")


def _look_up(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    known, numbers = vocabulary.value
    for batch in batches:
        ids = batch.column(batch.num_columns - 1)
        flat = ids.flatten().to_numpy()
        found = np.zeros(len(flat), bool)
        if len(known):
            place = np.searchsorted(known, flat)
            place[place == len(known)] = 0
            found = known[place] == flat
        before = np.concatenate(([0], np.cumsum(found)))
        bounds = before[np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy())))]
        values = numbers[place[found]] if len(known) else np.empty(0, np.int32)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()))], [*batch.schema.names[:-1], "sequence"])


def sequence_length(train_sequences: DataFrame, max_length: int = MAX_LENGTH) -> Column:
    """Longest training sequence, at most ``max_length``, as a scalar subquery."""
    return train_sequences.agg(F.least(F.max(F.size("sequence")), F.lit(max_length)).alias("n")).scalar()


def pad_sequences(sequences: DataFrame, length: Column) -> DataFrame:
    """Cut and padded at the front to one length."""
    sized = sequences.withColumn("__n", length)
    kept = F.slice("sequence", -F.least(F.size("sequence"), F.col("__n")), F.least(F.size("sequence"), F.col("__n")))
    kept = F.when(F.least(F.size("sequence"), F.col("__n")) == 0, F.array().cast("array<int>")).otherwise(kept)
    padded = F.concat(F.array_repeat(F.lit(0), F.greatest(F.col("__n") - F.size("sequence"), F.lit(0))), kept)
    return sized.withColumn("sequence", padded).drop("__n")
