"""Ranked lexical search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from fieldspan.llm.ranked_terms import rank_documents, search, terms

DOCS, ITEMS = "doc_id long, text string, item int, score string, rank int, n int", "item_id long, text string, doc_id int, w int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(docs, items, k):
    own = [(i, Counter(words(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n_docs, n_terms = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    found = []
    for item, searched in asked.items():
        scored = []
        for i, c in own:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            scored.append((-sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in searched if t in c), i is None, i))
        found += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(x for x in scored if x[0] < 0)[:k], 1)]
    return sorted(found, key=repr)


def corpus(seed, n):
    rnd = random.Random(seed)
    vocabulary = [f"w{x}" for x in range(300)] + ["Été", "日本", "x_y", "the"]
    draw = lambda size: " ".join(vocabulary[min(int(rnd.paretovariate(0.6)) - 1, len(vocabulary) - 1)] for _ in range(size))
    docs = [(i, draw(rnd.randint(1, 60))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " .,;\n\t"), (n + 3, draw(20_000)), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (3, "w1 w2 w3"), (4, "W1  w2-w3")]
    docs += [(n + 10 + i, "same words the w7 w8") for i in range(120)]
    items = [(i, draw(rnd.randint(1, 40))) for i in range(25)] + [(50, None), (51, ""), (52, "unheard"), (53, "w1 w1 W1"), (54, "same"), (54, "w9"), (None, "w2 w8"), (55, draw(3_000))]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"k": 3, "block_docs": 40, "block_terms": 30, "first_docs": 60}, {"k": 5, "block_docs": 100, "first_docs": 0}])
def test_equals_brute_force(spark, options):
    docs, items = corpus(1, 250)
    given = spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in docs], DOCS), spark.createDataFrame([(i, t, 1, 2) for i, t in items], ITEMS)
    found = sorted((tuple(r) for r in rank_documents(*given, **options).select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    assert found == brute_force(docs, items, options.get("k", 50))


def test_empty(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a", 1, 1)], ITEMS)
    assert rank_documents(docs, items).collect() == []
    some = spark.createDataFrame([(1, "a", 1, "", 1, 1)], DOCS)
    assert rank_documents(some, items.limit(0)).collect() == []
    assert [tuple(r) for r in rank_documents(some, items).collect()] == [(1, 1, 1, 287 * (10**9 // 3000))]


def test_stops_making_accumulators_but_not_on_equal_bounds():
    many = np.arange(1000)
    postings = {1: (np.arange(5), np.full(5, 900)), 2: (many, np.full(1000, 10))}
    order = [(1, 10, 9_000), (2, 1, 10)]
    places, scores, made = search(order, postings, 1000, 5, 0)
    assert places.tolist() == [0, 1, 2, 3, 4] and set(scores) == {9_010} and made == 5
    assert search(order, postings, 1000, 6, 0)[2] == 1000  # five accumulators are no sixth score
    assert search(order, postings, 1000, 6, 11)[2] == 5  # nothing unseen can reach a floor known from elsewhere
    assert search([(2, 1, 10)], postings, 1000, 5, 10)[2] == 1000  # a bound equal to the floor can still tie


def test_terms():
    for text in ("A-b_c'd 1,2 é\u00a0x ÀB\x7fz\x00q [k]`l{m}", "", "日本 Été"):
        assert [t.decode() for t in terms(text.encode())] == words(text)
