"""Benchmark decontamination: windows of items are looked up by their rarest shingle and verified word by word."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspan.llm.common import Stages, map_arrow, utf8

#: Words of benchmark items that one pass over the documents carries along; more are taken in blocks.
BLOCK_WORDS = 1_000_000
#: Words of a shingle. Pairs are much rarer than words, so few positions need a closer look.
SHINGLE = 2

_KEPT = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(128, 256))
_TABLE = bytes(c if c in _KEPT else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def letter_words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return text.translate(_TABLE).split()


class Windows(NamedTuple):
    """Distinct windows of one length, sorted by the code of their rarest shingle."""

    length: int
    shingle: np.ndarray  # code of the rarest shingle
    offset: np.ndarray  # its place in the window
    words: np.ndarray  # numbers of the words, a row for each window
    starts: np.ndarray  # where the items that hold a window begin in ``items``
    items: np.ndarray  # places of item names


def _numbers(words: list[bytes], vocabulary: dict[bytes, int]) -> np.ndarray:
    """Numbers of the words in a block's vocabulary, from 1; 0 for words of no item."""
    return np.fromiter(map(vocabulary.get, words, repeat(0)), np.int64, len(words))


def _shingles(numbers: np.ndarray, length: int, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places and codes of the shingles of one or two words, all of them in the vocabulary."""
    if length == 1:
        places = np.flatnonzero(numbers)
        return places, numbers[places]
    places = np.flatnonzero((numbers[:-1] > 0) & (numbers[1:] > 0))
    return places, numbers[places] * (len(vocabulary) + 1) + numbers[places + 1]


def _item_shingles(items: list[list[bytes]], vocabulary: dict[bytes, int], window: int) -> dict[int, np.ndarray]:
    """Sorted codes of the shingles of all windows, by the number of words of a shingle."""
    found: dict[int, list[np.ndarray]] = {}
    for words in items:
        if words:
            length = min(SHINGLE, window, len(words))
            found.setdefault(length, []).append(_shingles(_numbers(words, vocabulary), length, vocabulary)[1])
    return {length: np.unique(np.concatenate(own)) for length, own in found.items()}


def _count_shingles(batches: Iterator[pa.RecordBatch], block) -> Iterator[pa.RecordBatch]:
    """How often each of the block's shingles occurs in the texts of a task."""
    vocabulary, sought = block.value
    counts = {length: np.zeros(len(own), np.int64) for length, own in sought.items()}
    for batch in batches:
        for text in utf8(batch.column(0)):
            numbers = _numbers(letter_words(text), vocabulary) if text else ()
            for length, own in sought.items():
                if len(numbers) >= length:
                    _, codes = _shingles(numbers, length, vocabulary)
                    at = np.searchsorted(own, codes)
                    at[at == len(own)] = 0
                    np.add.at(counts[length], at[own[at] == codes], 1)
    for length, own in sought.items():
        full = counts[length] > 0
        yield pa.RecordBatch.from_arrays([pa.array(np.full(full.sum(), length)), pa.array(own[full]), pa.array(counts[length][full])], ["length", "code", "n"])


def _index(items: list[list[bytes]], vocabulary: dict[bytes, int], counts: dict[int, tuple[np.ndarray, np.ndarray]], window: int) -> list[Windows]:
    """The windows of a block of items, each under its rarest shingle; ties go to the earlier one.

    Windows are rows of arrays from the start, ten numbers and two more for each, so a block takes a
    fixed number of bytes a word on the driver and in a task.
    """
    parts: dict[int, list[tuple[np.ndarray, ...]]] = {}
    for place, words in enumerate(items):
        if not words:
            continue
        length, numbers = min(window, len(words)), _numbers(words, vocabulary).astype(np.int32)
        part = min(SHINGLE, length)
        _, codes = _shingles(numbers.astype(np.int64), part, vocabulary)
        known, n = counts[part]
        rarity = n[np.searchsorted(known, codes)]
        offset = sliding_window_view(rarity, length - part + 1).argmin(axis=1)
        rows = sliding_window_view(numbers, length)
        parts.setdefault(length, []).append((rows, offset.astype(np.int16), codes[np.arange(len(rows)) + offset], np.full(len(rows), place, np.int32)))
    index = []
    for length in sorted(parts):
        rows, offset, code, place = (np.concatenate(x) for x in zip(*parts.pop(length)))
        # Equal windows side by side, under one code: the same words have the same rarest shingle.
        order = np.lexsort((place, *rows.T[::-1], code))
        rows, offset, code, place = rows[order], offset[order], code[order], place[order]
        first = np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))
        window_of = np.cumsum(first) - 1
        fresh = first | np.concatenate(([True], place[1:] != place[:-1]))
        starts = np.searchsorted(window_of[fresh], np.arange(first.sum() + 1))
        index.append(Windows(length, code[first], offset[first].astype(np.int64), rows[first], starts, place[fresh]))
    return index


def _hits(numbers: np.ndarray, index: list[Windows], vocabulary: dict[bytes, int], names: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
    """Spans of words under occurrences of windows, and the items that have one."""
    spans, items = [], set()
    for w in index:
        if len(numbers) < w.length:  # length bound
            continue
        places, codes = _shingles(numbers, min(SHINGLE, w.length), vocabulary)
        first, last = np.searchsorted(w.shingle, codes, "left"), np.searchsorted(w.shingle, codes, "right")
        n = last - first
        if not n.any():
            continue
        entry = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = np.repeat(places, n) - w.offset[entry]
        fits = (start >= 0) & (start + w.length <= len(numbers))  # positional bound
        entry, start = entry[fits], start[fits]
        same = (numbers[start[:, None] + np.arange(w.length)] == w.words[entry]).all(1)
        spans += [(s, s + w.length) for s in start[same].tolist()]
        for e in np.unique(entry[same]).tolist():
            items.update(names[i] for i in w.items[w.starts[e] : w.starts[e + 1]])
    return spans, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND = ("n_words", "hit_spans", "items")


def _match(batches: Iterator[pa.RecordBatch], at: int, block) -> Iterator[pa.RecordBatch]:
    """The number of words, the hit spans and the items of every row, added to those of earlier blocks."""
    vocabulary, index, names = block.value
    for batch in batches:
        row, n, spans, items = batch.column(0), [], [], []
        before = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
        for text, (old_spans, old_items) in zip(utf8(row.field(at)), before):
            words = letter_words(text) if text else []
            new_spans, new_items = _hits(_numbers(words, vocabulary), index, vocabulary, names) if words else ([], set())
            n.append(len(words))
            spans.append([{"start": s, "end": e} for s, e in _merged(new_spans + [(x["start"], x["end"]) for x in old_spans or ()])])
            items.append(sorted(new_items | set(old_items or ())))
        yield pa.RecordBatch.from_arrays([row, pa.array(n, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], ["row", *_FOUND])


def mark_contaminated(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = 10, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(row, n_words, hit_spans, items): the given columns together in ``row``, merged spans of words (end exclusive), sorted item names.

    A window is ``window`` consecutive words of an item, all its words if it has fewer.
    An occurrence is exact and as long as the window, so all of a window's shingles are
    necessary and its prefix is a single one: the rarest by its count over all documents.
    Documents look up only that shingle; what it finds must lie inside the document at
    the shingle's offset (length and positional bounds), and is compared word by word.

    The index of a block of items, about ``block_words`` words or one item, travels to
    the tasks as arrays of some 80 bytes a word; a larger benchmark is taken in several blocks, whose findings are added
    to the rows one after the other, so documents are never shuffled. Results do not
    depend on the blocks. Documents with null or empty text have no words, items without
    words have no windows, items without a key take no part; repeated items count once,
    repeated documents each keep a row. Runs jobs when called: counting the benchmark's shingles in all documents.
    """
    spark = docs.sparkSession
    stages = Stages(spark)
    items = benchmark.select(F.col(item_key).cast("string").alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null")
    # Blocks: items dealt by a hash, by the most words that their characters can hold; a block is all that ever reaches the driver.
    total = items.select(F.sum(F.length("text")).alias("n")).first().n or 0
    blocks = 1 + total // (2 * block_words)
    dealt = stages.keep(items.distinct().withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))), "items")

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    marked = docs.select(
        row.alias("row"),
        F.lit(None).cast("long").alias("n_words"),
        F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("hit_spans"),
        F.lit(None).cast("array<string>").alias("items"),
    )
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in marked.schema])
    for k in range(blocks):
        names, own = [], []
        for r in dealt.where(F.col("block") == k).toLocalIterator():
            names.append(r.item)
            own.append(letter_words(r.text.encode()))
        vocabulary = {w: n for n, w in enumerate(sorted({w for words in own for w in words}), 1)}
        sought = _item_shingles(own, vocabulary, window)
        counts = {length: (codes, np.zeros(len(codes), np.int64)) for length, codes in sought.items()}
        if sought:
            counted = map_arrow(docs.select(text), partial(_count_shingles, block=spark.sparkContext.broadcast((vocabulary, sought))), "length long, code long, n long")
            found = counted.groupBy("length", "code").agg(F.sum("n").alias("n")).toArrow()
            length, code, n = (found.column(c).to_numpy() for c in ("length", "code", "n"))
            for kind, (codes, numbers) in counts.items():
                numbers[np.searchsorted(codes, code[length == kind])] = n[length == kind]
        index = _index(own, vocabulary, counts, window)
        marked = map_arrow(marked, partial(_match, at=docs.columns.index(text), block=spark.sparkContext.broadcast((vocabulary, index, names))), schema)
    return marked


def contamination(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) for every row."""
    marked = mark_contaminated(docs.select(key, text), benchmark, text=text, **options)
    length = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return marked.select(
        F.col("row").getField(key).alias(key),
        "n_words",
        length.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without any occurrence of a window, all columns kept."""
    return mark_contaminated(docs, benchmark, **options).where(F.size("hit_spans") == 0).select("row.*")
