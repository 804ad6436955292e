"""Near-duplicates by min-max hashing: smallest and largest value under each permutation, banded, then verified."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspan.llm.common import Stages, WordHashes, distinct_sorted, map_arrow, restrict, run_hashes, scramble, utf8
from fieldspan.llm.components import components

#: Shingles that are hashed at once, so that a permutation stays in cache.
CHUNK = 1 << 17


def space_words(text: bytes) -> list[bytes]:
    """Words between white space of ASCII, A-Z lower-cased."""
    return text.lower().split()


def _value_arrays(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes, one row of ``bands`` values for each non-empty set.

    A permutation is hashed once and gives two signature values, its minimum and its
    maximum. The first half of the bands is filled with minima, the second with
    maxima, so the values of one band come from different permutations.
    """
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    low, high = (np.empty((len(a), len(sets)), np.uint32) for _ in range(2))
    value = np.empty_like(flat)
    for k in range(len(a)):
        np.multiply(flat, a[k], out=value)
        np.add(value, b[k], out=value)
        np.minimum.reduceat(value, starts, out=low[k])
        np.maximum.reduceat(value, starts, out=high[k])
    signature = np.concatenate((low, high)).astype(np.uint64).reshape(bands, rows, len(sets))
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64)[:, None], (bands, len(sets)))
    for j in range(rows):
        key = scramble(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, j])
    return key.T.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], words, shingle: int, bands: int, rows: int, seed: int) -> Iterator[pa.RecordBatch]:
    random = np.random.default_rng(seed)
    a = random.integers(0, 1 << 31, bands * rows // 2, np.uint32) * np.uint32(2) + np.uint32(1)
    b = random.integers(0, 1 << 32, bands * rows // 2, np.uint32)
    known = WordHashes()

    def emitted(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        full = [s for s in sets if len(s)]
        keys = _value_arrays(full, a, b, bands, rows).ravel() if full else np.empty(0, np.int64)
        offsets = np.concatenate(([0], np.cumsum([bands * bool(len(s)) for s in sets])))
        digests = [xxhash.xxh3_128_digest(s) if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys))],
            ["id", "n", "set_key", "bands"],
        )

    for batch in batches:
        sets, held, done = [], 0, 0
        for i, text in enumerate(utf8(batch.column(1))):
            sets.append(distinct_sorted(run_hashes(known.of(words(text)), shingle)) if text else np.empty(0, np.uint64))
            held += len(sets[-1])
            if held >= CHUNK:
                yield emitted(batch.column(0).slice(done, len(sets)), sets)
                sets, held, done = [], 0, i + 1
        if sets:
            yield emitted(batch.column(0).slice(done, len(sets)), sets)


def _sets(batches: Iterator[pa.RecordBatch], words, shingle: int) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        sets = [distinct_sorted(run_hashes(known.of(words(t)), shingle)).view(np.int64) for t in map(lambda t: t or b"", utf8(batch.column(1)))]
        offsets = pa.array(np.concatenate(([0], np.cumsum([len(s) for s in sets]))), pa.int32())
        values = pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, values)], ["id", "members"])


def signatures(
    docs: DataFrame, *, key: str, text: str, words: Callable[[bytes], list[bytes]], shingle: int, bands: int, rows: int, seed: int
) -> DataFrame:
    """(id, n, set_key, bands): size of the shingle set, 128-bit digest of the set, band hashes. No shuffle."""
    schema = T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("n", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    return map_arrow(docs.select(key, text), partial(_sign, words=words, shingle=shingle, bands=bands, rows=rows, seed=seed), schema)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets meet the limit."""
    of_a = sets.select(F.col("id").alias("a"), F.col("members").alias("in_a"))
    of_b = sets.select(F.col("id").alias("b"), F.col("members").alias("in_b"))
    both = pairs.join(of_a, "a").join(of_b, "b")
    n, m = F.size("in_a"), F.size("in_b")
    both = both.where(100 * F.least(n, m) >= percent * F.greatest(n, m))
    common = F.size(F.array_intersect("in_a", "in_b"))
    return both.where((100 + percent) * common >= percent * (n + m)).select("a", "b")


def near_duplicates(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    words: Callable[[bytes], list[bytes]] = space_words,
    shingle: int = 5,
    percent: int = 80,
    bands: int = 64,
    rows: int = 8,
    seed: int = 20,
) -> DataFrame:
    """One row per input row: key, n_shingles, component_id, kept.

    A document's set holds the distinct runs of ``shingle`` words of its whole text
    (the whole sequence, if it has fewer words). Documents are linked if the common
    part is at least ``percent`` per cent of the union. ``component_id`` is the smallest
    key that links reach, ``kept`` says that it is the document's own.

    Candidates share a band of ``rows`` values out of ``bands * rows / 2`` permutations,
    each of which gives its minimum and its maximum. At the limit of 0.8 a pair is
    missed with probability (1 - 0.8 ** 8) ** 64 < 1e-5. Equal sets are one candidate,
    found by a digest. In a bucket everyone is compared with the smallest member, on
    the full sets (64-bit shingle hashes); what is then still apart in a bucket is
    searched for further links by an exact prefix join, so that no link of a bucket is
    left out, and the pairs of a group of copies are not listed.

    Null text, empty text, only white space: empty set, linked with nothing, its own
    component. Rows repeating a key are versions of one document: linked if any of
    them is. A null key has null as component unless its set equals a keyed one's.
    Runs jobs when called; intermediate tables go to the shared folder.
    """
    if bands % 2:
        raise ValueError("bands must be even: half are minima, half maxima")
    stages = Stages(docs.sparkSession)
    signed = stages.keep(signatures(docs, key=key, text=text, words=words, shingle=shingle, bands=bands, rows=rows, seed=seed), "signed")
    alike = stages.keep(signed.where("n > 0").groupBy("set_key").agg(F.min("id").alias("rep")), "alike")

    # Buckets with more than one distinct set; singles never leave the aggregation.
    first = signed.join(alike.select("set_key", F.col("rep").alias("id")), ["set_key", "id"])
    entries = first.select("id", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot <> last")
    buckets = stages.keep(entries.join(shared.select("bucket", "pivot"), "bucket"), "buckets")
    wanted = stages.keep(buckets.select("id").distinct(), "wanted")

    labels = None
    if not wanted.isEmpty():
        texts = restrict(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), wanted, "id")
        set_schema = T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("members", T.ArrayType(T.LongType()))])
        sets = stages.keep(map_arrow(texts, partial(_sets, words=words, shingle=shingle), set_schema), "sets")
        others = buckets.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
        others = stages.keep(others, "others")

        links = stages.keep(_linked(others.groupBy("a").agg(F.min("b").alias("b")), sets, percent), "links")
        labels = components(links, stages)
        for pairs in (lambda: _apart(others, labels), lambda: _crossing(buckets, sets, labels, percent, stages)):
            more = stages.keep(_linked(pairs(), sets, percent), "more")
            if not more.isEmpty():
                links = stages.keep(links.union(more), "links")
                labels = components(links, stages)
        stages.drop("sets", "others", "more", "links", "open", "ranked")
    stages.drop("buckets", "wanted")

    placed = signed.select("id", "n", "set_key").join(alike, "set_key", "left")
    component = F.coalesce("rep", "id")
    if labels is not None:
        placed = placed.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        component = F.coalesce("component", "rep", "id")
    placed = placed.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return placed.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def _labelled(df: DataFrame, labels: DataFrame | None, node: str, name: str) -> DataFrame:
    if labels is None:
        return df.withColumn(name, F.col(node))
    found = labels.select(F.col("node").alias(node), F.col("component").alias("found"))
    return df.join(found, node, "left").withColumn(name, F.coalesce("found", node)).drop("found")


def _apart(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Distinct pairs of (member, pivot) that are in different components so far."""
    pairs = _labelled(_labelled(pairs, labels, "a", "at_a"), labels, "b", "at_b")
    return pairs.where("at_a <> at_b").select("a", "b")


def _crossing(buckets: DataFrame, sets: DataFrame, labels: DataFrame | None, percent: int, stages: Stages) -> DataFrame:
    """Distinct pairs that may be links, for all pairs of a bucket without its pivot that are in different components.

    Listing them would pair every stray of a group of copies with all of the group. They are found by
    an exact prefix join instead: shingles are ranked by how many documents have them,
    rare ones first, in one order for all. What two sets have in common begins with their first
    common shingle and is no longer than what either has from there on, so a link has a
    common shingle so early in both that enough is left. An edited copy begins with the shingles
    that its edits made, and meets only those who share one of them.

    Only documents of buckets with several components are joined; each such pair has a
    member outside the bucket's largest component, and only those look for partners.
    """
    placed = _labelled(buckets.where("id <> pivot"), labels, "id", "at").select("bucket", "id", "at")
    several = placed.groupBy("bucket").agg(F.min("at").alias("least"), F.max("at").alias("most")).where("least <> most").select("bucket")
    placed = placed.join(several, "bucket")
    if labels is not None:
        size_of = labels.groupBy(F.col("component").alias("at")).agg(F.count("*").alias("size"))
        placed = placed.join(size_of, "at", "left").withColumn("size", F.coalesce("size", F.lit(1)))
    else:
        placed = placed.withColumn("size", F.lit(1))
    largest = placed.groupBy("bucket").agg(F.max("size").alias("size"))
    home = placed.join(largest, ["bucket", "size"]).groupBy("bucket").agg(F.min("at").alias("home"))
    placed = placed.join(home, "bucket").groupBy("id", "at").agg(F.max(F.col("at") != F.col("home")).alias("stray"))
    opened = stages.keep(placed, "open")

    held = sets.join(opened, "id").withColumns({"version": F.xxhash64("members"), "n": F.size("members")})
    held = held.select("id", "at", "stray", "version", "n", F.explode("members").alias("shingle"))
    counted = held.groupBy("shingle").agg(F.count("*").alias("held_by"))
    order = Window.partitionBy("id", "version").orderBy("held_by", "shingle")
    ranked = held.join(counted, "shingle").withColumn("left", F.col("n") - F.row_number().over(order) + 1)
    ranked = ranked.where("held_by > 1").where(100 * F.col("left") >= percent * F.col("n"))
    ranked = stages.keep(ranked.select("shingle", "id", "at", "stray", "n", "left"), "ranked")

    def side(x: str) -> list[Column]:
        return ["shingle", *[F.col(c).alias(f"{to}_{x}" if to else x) for c, to in (("id", ""), ("at", "at"), ("stray", "stray"), ("n", "n"), ("left", "left"))]]

    a = ranked.where("stray").select(*side("a"))
    b = ranked.select(*side("b")).withColumnRenamed("shingle", "same")
    enough = (100 + percent) * F.least("left_a", "left_b") >= percent * (F.col("n_a") + F.col("n_b"))
    apart = (F.col("at_a") != F.col("at_b")) & (~F.col("stray_b") | (F.col("a") < F.col("b")))
    return a.join(b, (F.col("shingle") == F.col("same")) & apart & enough).select("a", "b").distinct()


def drop_near_duplicates(docs: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that stand for their group, all columns kept; rows without a key stay."""
    stages = Stages(docs.sparkSession)
    gone = near_duplicates(docs, key=key, **options).where("not kept").where(F.col(key).isNotNull())
    gone = stages.keep(gone.select(key).distinct(), "gone")
    return restrict(docs, gone, key, "left_anti")
