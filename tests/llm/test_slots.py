"""Sharding by slots: gapless places, even bytes, few moves."""

import random
import zlib
from collections import Counter

import pytest

from fieldspan.llm.slots import SLOTS, build_map, load_map, rebalance, save_map, shard_by_stored_map, shard_rows

DOCS = "doc_id long, text string, size int, shard int, slot string"


def test_places(spark):
    rnd = random.Random(1)
    texts = ["same text of a large group"] * 700 + ["x" * rnd.randrange(1, 400) + "é" for _ in range(1300)] + [None, "", "y" * 3000]
    docs = spark.createDataFrame([(i, t, 1, 1, "s") for i, t in enumerate(texts)] + [(5, texts[5], 1, 1, "s")] * 3 + [(None, "t", 1, 1, "s")], DOCS)
    placed, slot_map = shard_rows(docs, shards=16)
    rows = placed.collect()
    assert len(rows) == docs.count()
    places = Counter((r.shard, r.slot) for r in rows)
    counts = Counter(r.shard for r in rows)
    assert set(places.values()) == {1} and set(places) == {(s, n) for s, c in counts.items() for n in range(c)}
    for r in rows:
        data = (texts[r.doc_id] if r.doc_id is not None else "t") or ""
        assert (r["size"], r.text_crc32) == (len(data.encode()) + 1, zlib.crc32(data.encode()))
        assert slot_map.shard_of[r.virtual_slot] == r.shard
    load = Counter()
    for r in rows:
        load[r.shard] += r["size"]
    assert len(load) == 16 and max(load.values()) - min(load.values()) < 0.02 * sum(load.values()) / 16
    assert max(Counter(r.shard for r in rows if r.doc_id is not None and r.doc_id < 700).values()) < 120  # a group of equal texts spreads


def test_same_rows_whatever_the_partitions(spark):
    docs = spark.createDataFrame([(i, f"text {i % 50}", 1, 1, "s") for i in range(500)], DOCS)
    one, other = (sorted(map(tuple, shard_rows(d)[0].collect())) for d in (docs.repartition(1), docs.repartition(7)))
    assert one == other


def test_empty(spark):
    placed, slot_map = shard_rows(spark.createDataFrame([], DOCS))
    assert placed.count() == 0 and len(slot_map.shard_of) == SLOTS


def test_rebalancing_moves_little():
    rnd = random.Random(2)
    sizes = [rnd.randrange(1, 1000) for _ in range(2000)]
    first = build_map(sizes, 8)
    grown = rebalance(first, sizes, 9)
    moved = [s for s in range(2000) if first.shard_of[s] != grown.shard_of[s]]
    assert grown.version == 1 and {grown.shard_of[s] for s in moved} == {8}
    assert sum(sizes[s] for s in moved) < 1.05 * sum(sizes) / 9
    for m, n in ((first, 8), (grown, 9), (rebalance(grown, sizes, 5), 5)):
        load = [sum(sizes[s] for s in range(2000) if m.shard_of[s] == x) for x in range(n)]
        assert sum(load) == sum(sizes) and max(load) < 1.03 * sum(sizes) / n
    assert rebalance(first, sizes, 8).shard_of == first.shard_of
    shrunk = rebalance(grown, sizes, 8)
    assert all(grown.shard_of[s] == 8 for s in range(2000) if shrunk.shard_of[s] != grown.shard_of[s])


def test_maps_are_versioned(spark, tmp_path):
    first = build_map([5, 4, 3, 2], 2)
    save_map(spark, first, str(tmp_path / "maps"))
    second = rebalance(first, [5, 4, 3, 2], 3)
    save_map(spark, second, str(tmp_path / "maps"))
    assert load_map(spark, str(tmp_path / "maps")) == second
    assert load_map(spark, str(tmp_path / "maps"), 0) == first


def test_an_edited_map_moves_only_its_slots(spark, tmp_path):
    docs = spark.createDataFrame([(i % 900, f"text {i % 900} " * (i % 7)) for i in range(1000)], "doc_id long, text string")
    path = str(tmp_path / "maps")
    first = shard_by_stored_map(docs, path, shards=4, slots=64)
    stored = load_map(spark, path)
    assert stored.version == 0
    sizes = [0] * 64
    for r in first.collect():
        sizes[r.virtual_slot] += r.size
    grown = rebalance(stored, sizes, 5)
    save_map(spark, grown, path)
    second = shard_by_stored_map(docs, path, slots=64)
    edited = {x for x in range(64) if grown.shard_of[x] != stored.shard_of[x]}
    before, after = ({(r.doc_id, r.text_crc32): (r.virtual_slot, r.shard) for r in d.collect()} for d in (first, second))
    moved = {k for k in before if before[k] != after[k]}
    assert moved and moved == {k for k, (slot, _) in before.items() if slot in edited} and 4 in {after[k][1] for k in moved}
    for shard in range(5):
        places = sorted(r.slot for r in second.where(f"shard = {shard}").collect())
        assert places == list(range(len(places)))
    given, same = shard_rows(docs, slots=64, slot_map=grown)
    assert same is grown and sorted(map(tuple, given.collect())) == sorted(map(tuple, second.collect()))
    with pytest.raises(ValueError):
        shard_rows(docs, slots=32, slot_map=grown)
