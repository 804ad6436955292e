"""Benchmark windows against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspan.llm.decontaminate import contamination, drop_contaminated, letter_words

DOCS, ITEMS = "doc_id long, text string, n_words int, item_id int", "item_id long, text string, doc_id int"


def brute_force(docs, items, window=10):
    found = []
    windows = {}
    for item, text in items:
        words = letter_words((text or "").encode())
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n and item is not None else 0):
            windows.setdefault(tuple(words[i : i + n]), set()).add(str(item))
    for doc, text in docs:
        words, hit, own = letter_words((text or "").encode()), set(), set()
        for w, names in windows.items():
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    own |= names
        found.append((doc, len(words), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return sorted(found, key=repr)


def test_words():
    assert letter_words("Don't STOP_é2 Ärger\x00y".encode()) == [b"don", b"t", b"stop", "é2".encode(), "Ärger".encode(), b"y"]
    assert letter_words("A-b_C 9é".encode()) == [b"a", b"b", b"c", "9é".encode()]


@pytest.mark.parametrize("block_words", [2_000_000, 40])
def test_equals_brute_force(spark, block_words):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["the"] * 20
    phrase = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(phrase(rnd.choice((3, 9, 10, 11, 25, 40))))) for i in range(25)]
    items += [(100, items[3][1]), (100, items[3][1]), (101, ""), (102, None), (103, "unique"), (None, "the the"), (104, "Ünïcode wörds hére")]
    docs = []
    for i in range(120):
        words = phrase(rnd.randrange(0, 60))
        if i % 3 == 0:
            part = (rnd.choice(items)[1] or "").split()
            cut = rnd.randrange(0, 4)
            words[5:5] = part[cut:]
        docs.append((i, " ".join(words).upper() if i % 7 == 0 else ", ".join(words)))
    docs += [(200, None), (201, ""), (202, "the"), (203, "unique UNIQUE"), (204, "Ünïcode wörds hére"), (205, docs[0][1]), (205, docs[0][1]), (None, docs[3][1]), (206, docs[3][1] + " the" * 20_000)]
    result = contamination(spark.createDataFrame([(*d, 1, 1) for d in docs], DOCS), spark.createDataFrame([(*x, 1) for x in items], ITEMS), block_words=block_words)
    assert sorted((tuple(r) for r in result.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr) == brute_force(docs, items)


def test_empty_tables_and_stage(spark):
    docs = spark.createDataFrame([(1, "a b c", 1, 1), (2, None, 1, 1), (3, "x y", 1, 1)], DOCS)
    items = spark.createDataFrame([(1, "a b", 1)], ITEMS)
    assert contamination(docs.limit(0), items).count() == 0
    assert not any(r.contaminated for r in contamination(docs, items.limit(0)).collect())
    kept = drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]


def test_own_names_as_columns(spark):
    names = "row n_words hit_spans items _n_words _hit_spans _items item block".split()
    docs = spark.createDataFrame([(1, "one two three"), (2, "four five")], "doc_id long, text string")
    extra = docs.select("*", *[(F.col("doc_id") + i).alias(name) for i, name in enumerate(names)])
    benchmark = spark.createDataFrame([(7, "four five")], "item_id long, text string")
    kept = drop_contaminated(extra, benchmark)
    assert kept.columns == extra.columns
    (row,) = kept.collect()
    assert row.doc_id == 1 and all(row[name] == 1 + i for i, name in enumerate(names))


def test_index_is_small_and_right_for_many_words():
    """Windows that several items share, and the bytes that a word takes."""
    from fieldspan.llm.decontaminate import _index, _item_shingles, letter_words

    rnd = np.random.default_rng(1)
    items = [[b"w%d" % x for x in rnd.integers(0, 50_000, 2_000)] for _ in range(100)]
    items.append(items[3][100:150])
    vocabulary = {w: n for n, w in enumerate(sorted({w for i in items for w in i}), 1)}
    sought = _item_shingles(items, vocabulary, 10)
    counts = {length: (codes, rnd.integers(0, 9, len(codes))) for length, codes in sought.items()}
    (index,) = _index(items, vocabulary, counts, 10)
    held = sum(a.nbytes for a in (index.shingle, index.offset, index.words, index.starts, index.items))
    assert held < 80 * 200_000
    shared = [set(index.items[a:b].tolist()) for a, b in zip(index.starts[:-1], index.starts[1:])]
    assert sum(x == {3, 100} for x in shared) == 41 and (np.diff(index.shingle) >= 0).all()
    assert letter_words(b"A b") == [b"a", b"b"]
