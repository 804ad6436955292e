"""Ranked lexical search, term at a time: rarest terms first, no new accumulators once what is left cannot reach the kth score."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspan.llm.common import Stages, map_arrow, utf8

#: Bits of the filter that the searched terms set. It travels to every task and is 4 MB, however many terms there are.
FILTER_BITS = 1 << 25
#: Documents of a block, and terms of the items that meet a block in one task.
BLOCK_DOCS, BLOCK_TERMS = 16_384, 200_000
#: Postings that a block may hold on average; more make more blocks.
BLOCK_POSTINGS = 2_000_000
#: Documents holding an item's rarest terms that are scored first, to give a kth score before the search.
FIRST_DOCS = 4_096

_KEPT = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(128, 256))
_TABLE = bytes(c if c in _KEPT else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return text.translate(_TABLE).split()


class TermNumbers(dict):
    """64-bit number of a term if the filter may hold it, else 0; remembered for the terms that memory is set aside for."""

    def __init__(self, held: np.ndarray | None, remembered: int = 200_000):
        super().__init__()
        self.held, self.remembered = held, remembered

    def __missing__(self, term: bytes) -> int:
        if len(self) >= self.remembered:
            self.clear()
        value = xxhash.xxh3_64_intdigest(term) or 1
        if self.held is not None:
            at = value % FILTER_BITS
            value *= int(self.held[at >> 3] >> (at & 7)) & 1
        self[term] = value
        return value


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            own = np.array(sorted({xxhash.xxh3_64_intdigest(t) or 1 for t in terms(text or b"")}), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), row)), pa.array(own.view(np.int64))], ["item", "term"])


def _postings(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    """Every row with its number of terms and the searched ones among them, each with its occurrences."""
    known = TermNumbers(held.value)
    for batch in batches:
        lengths, numbers, times, ends = [], [], [], [0]
        for text in utf8(batch.column(1)):
            own = terms(text) if text else []
            lengths.append(len(own))
            counted = Counter(map(known.__getitem__, own))
            counted.pop(0, None)
            numbers.append(np.fromiter(counted, np.uint64, len(counted)))
            times.append(np.fromiter(counted.values(), np.int64, len(counted)))
            ends.append(ends[-1] + len(counted))
        offsets = pa.array(ends, pa.int32())
        found = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64))) for x in (numbers, times)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *found], ["doc", "n", "terms", "tfs"])


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What an occurrence count is worth in a document of relative length m, before the term's weight."""
    return (1_000_000_000 * tf) // (1_000 * tf + 20 * m)


def search(order: list[tuple[int, int, int]], postings: dict[int, tuple[np.ndarray, np.ndarray]], docs: int, k: int, known: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, number of accumulators) of all that can be among the k best, at least ``known``.

    ``order`` lists the item's (term, weight, bound) rarest first, ``postings`` the places and
    impacts of a term. Before each term the bounds of all that is left are compared with the kth
    partial score, or with ``known``, a score that k documents anywhere are sure to reach: once
    they are less, a document without an accumulator cannot enter, and only the others are
    updated, to their exact scores. Equal is not less, since ties go by document.
    """
    scores, has = np.zeros(docs, np.int64), np.zeros(docs, bool)
    left, making = sum(b for _, _, b in order), True
    for term, weight, bound in order:
        if making:
            own = scores[has]
            kth = int(np.partition(own, len(own) - k)[len(own) - k]) if len(own) >= k else 0
            making = left >= max(kth, known)
            if not making:
                # Of the accumulators too only those stay that can still get there.
                has &= scores + left >= max(kth, known)
        left -= bound
        found = postings.get(term)
        if found is None or not weight:
            continue
        at, worth = found
        if making:
            has[at] = True
        else:
            stays = has[at]
            at, worth = at[stays], worth[stays]
        scores[at] += weight * worth
    places = np.flatnonzero(has & (scores > 0) & (scores >= known))
    if len(places) > k:
        kth = np.partition(scores[places], len(places) - k)[len(places) - k]
        places = places[scores[places] >= kth]
    return places, scores[places], int(has.sum())


_BEST = ["item", "doc_id", "score"]


def _search_block(docs: pa.Table, items: pa.Table, k: int) -> pa.Table:
    """All items of a block against all documents of a block."""
    ids = docs.column("doc_id").combine_chunks()
    empty = pa.table([pa.array([], pa.int64()), ids.slice(0, 0), pa.array([], pa.int64())], _BEST)
    if not len(ids) or not len(items):
        return empty
    listed = docs.column("terms").combine_chunks()
    sizes = listed.value_lengths().to_numpy()
    number, tf = listed.flatten().to_numpy(), docs.column("tfs").combine_chunks().flatten().to_numpy()
    worth = impact(tf, np.repeat(docs.column("m").to_numpy(), sizes))
    by_term = np.argsort(number, kind="stable")
    number, worth = number[by_term], worth[by_term]
    at = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)[by_term]
    starts = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1]))) if len(number) else np.empty(0, np.int64)
    postings = {int(number[s]): (at[s:e], worth[s:e]) for s, e in zip(starts, [*starts[1:], len(number)])}
    # Places of the documents by key, null last, so that equal scores need no look at the keys.
    by_key = np.empty(len(ids), np.int64)
    by_key[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
    parts = [empty]
    for batch in items.to_batches(max_chunksize=64):
        for item, searched, known in zip(*(batch.column(c).to_pylist() for c in ("item", "searched", "known"))):
            order = sorted(((x["term"], x["w"], x["bound"]) for x in searched), key=lambda x: (-x[1], x[0]))
            places, scores, _ = search(order, postings, len(ids), k, known or 0)
            best = np.lexsort((by_key[places], -scores))[:k]
            if len(best):
                parts.append(pa.table([pa.array(np.full(len(best), item)), ids.take(pa.array(places[best])), pa.array(scores[best])], _BEST))
    return pa.concat_tables(parts)


def _filter_of(vocabulary: DataFrame) -> np.ndarray:
    """The bits that the terms set, gathered in whole words: at most as many rows as the filter has."""
    place = F.expr(f"CAST(pmod(term, {FILTER_BITS}) AS INT)")
    words = vocabulary.select((place / 32).cast("int").alias("word"), F.expr("shiftleft(1L, CAST(pmod(term, 32) AS INT))").alias("bit"))
    held = np.zeros(FILTER_BITS // 32, np.uint32)
    for r in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        held[r.word] = r.bits
    return held.view(np.uint8)


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    k: int = 50,
    block_docs: int = BLOCK_DOCS,
    block_postings: int = BLOCK_POSTINGS,
    block_terms: int = BLOCK_TERMS,
    first_docs: int = FIRST_DOCS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item; ties to the smaller key.

    A term's weight is floor(1000 ln((2N+2)/(2df+1))), N documents having a term at all. A document's
    m is 50 + 50 n N div L for its n of all L terms; an item's score sums, over its terms once each,
    weight * (10^9 tf div (1000 tf + 20 m)).

    Texts are read once: a filter of fixed size, set by the items' terms, leaves the postings that
    can matter, which are written to the shared folder; counts and the largest impact of a term come from
    them. Documents are dealt into blocks and items into blocks of terms, and each pair of blocks
    is one group: there an item's terms are taken rarest first, and no accumulator is made once the
    bounds of the terms left are below the kth score (``search``). So that this stops early in a small
    block too, the documents of each item's rarest terms are scored beforehand over all blocks; their kth
    partial score is a floor for every block. What is left of the blocks is merged.

    Terms are told apart by 64-bit hashes: of a billion other terms one equals one of 10,000 searched
    ones with a chance of 1e-6. Null or empty texts have no terms; such a document counts in nothing,
    such an item has no rows. Each row is a document, so repeated keys rank apart; a null key ranks last among
    equal scores. Rows repeating an item's key are one item with the terms of all; a null key is an item
    too. Runs jobs when called.
    """
    spark = docs.sparkSession
    stages = Stages(spark)
    # Items by number, so that any kind of key will do.
    named = items.select(F.col(item_key).alias("name"), F.col(item_text).alias("text"))
    numbered = stages.keep(named.select("name").distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    texts = named.join(numbered, named["name"].eqNullSafe(numbered["name"])).select("item", "text")
    searched = stages.keep(map_arrow(texts, _item_terms, "item long, term long").distinct(), "searched")
    vocabulary = stages.keep(searched.select("term").distinct(), "vocabulary")
    held = spark.sparkContext.broadcast(_filter_of(vocabulary))

    ids = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(key).alias("doc_id"), F.col(text).alias("text"))
    counted = ids.select(F.struct("doc", "doc_id").alias("doc"), "text")
    key_type = docs.schema[key].dataType.simpleString()
    found = map_arrow(counted, partial(_postings, held=held), f"doc struct<doc:bigint,doc_id:{key_type}>, n long, terms array<long>, tfs array<long>")
    found = stages.keep(found.where("n > 0").select("doc.doc", "doc.doc_id", "n", "terms", "tfs"), "found")
    total = found.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms"), F.sum(F.size("terms").cast("long")).alias("postings")).first()
    if not total.docs:
        return spark.createDataFrame([], f"{item_key} {items.schema[item_key].dataType.simpleString()}, rank int, {key} {key_type}, score long")
    m = F.expr(f"50 + (50 * n * {total.docs}L) div {total.terms}L")

    # Frequency and largest impact of every searched term; the filter's false finds go with the join.
    singles = found.select("doc", m.alias("m"), F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("doc", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"), "m")
    worth = F.expr("(1000000000 * tf) div (1000 * tf + 20 * m)")
    known = singles.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max(worth).alias("most"))
    weight = F.floor(1000 * F.log((2 * F.lit(total.docs) + 2).cast("double") / (2 * F.col("df") + 1)))
    weighed = known.join(vocabulary, "term").select("term", "df", weight.cast("long").alias("w"), "most")
    weighed = searched.join(stages.keep(weighed, "weighed"), "term").select("item", "term", "df", "w", (F.col("w") * F.col("most")).alias("bound"))
    weighed = stages.keep(weighed.where("w > 0"), "item_terms")

    # The kth partial score over the documents of the rarest terms, few of them by their frequencies.
    before = Window.partitionBy("item").orderBy("df", "term")
    rare = weighed.withColumn("upto", F.sum("df").over(before)).where(F.col("upto") <= first_docs).select("item", "term", "w")
    partly = singles.join(rare, "term").groupBy("item", "doc").agg(F.sum(F.col("w") * worth).alias("score"))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc()))
    floor = partly.withColumn("place", place).where(F.col("place") <= k).where(F.col("place") == k).select("item", F.col("score").alias("known"))

    # Blocks of items hold a bounded number of terms; an item's own terms are one row.
    n_terms = weighed.count()
    item_blocks = 1 + n_terms // block_terms
    asked = weighed.groupBy("item").agg(F.collect_list(F.struct("term", "w", "bound")).alias("searched")).join(floor, "item", "left")
    asked = stages.keep(asked.withColumn("items", F.pmod(F.xxhash64("item"), F.lit(item_blocks))), "asked")
    blocks = 1 + max(total.docs // block_docs, total.postings // block_postings)
    dealt = found.select("doc_id", m.alias("m"), "terms", "tfs", F.pmod(F.xxhash64("doc"), F.lit(blocks)).alias("docs"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(item_blocks - 1).cast("long"))).alias("items"))
    every = asked.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("docs"))
    tasks = blocks * item_blocks
    sides = (side.repartition(tasks, "docs", "items").groupBy("docs", "items") for side in (dealt, every))
    best = next(sides).cogroup(next(sides)).applyInArrow(lambda left, right: _search_block(left, right, k), f"item long, doc_id {key_type}, score long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    best = best.withColumn("rank", place).where(F.col("rank") <= k)
    return best.join(numbered, "item").select(F.col("name").alias(item_key), "rank", F.col("doc_id").alias(key), "score")
