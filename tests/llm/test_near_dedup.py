"""Min-max near-duplicates and components against brute force."""

import random

import pytest

from fieldspan.llm.common import Stages
from fieldspan.llm.components import components
from fieldspan.llm.minmax import drop_near_duplicates, near_duplicates, signatures, space_words

DOCS = "doc_id long, text string, n long, bands string"


def roots(nodes, links):
    """Smallest node reachable, by brute force."""
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def shingles(text, k):
    words = space_words((text or "").encode())
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_force(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    component = roots(ids, links)
    return {i: (len(sets[i]), component[i], component[i] == i) for i in ids}


def edited(words, n, rnd):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"new{rnd.randrange(10**9)}"
    return " ".join(words)


@pytest.mark.parametrize("k", [2, 5])
def test_components_equal_brute_force(spark, k):
    rnd, rows = random.Random(k), []
    for base in range(6):
        words = [f"w{rnd.randrange(4000)}" for _ in range(rnd.choice((12, 60, 300)))]
        for _ in range(rnd.choice((1, 5, 25))):
            rows.append(edited(words, rnd.randrange(1 + len(words) // 12), rnd))
    rows += ["", None, "  \t\n", "alone", "ALONE", "alone again", "Alone  again", "é É", "é é", "x " * 5000, "x " * 4000]
    rnd.shuffle(rows)
    rows = list(enumerate(rows))
    result = near_duplicates(spark.createDataFrame([(i, t, 1, "b") for i, t in rows], DOCS), shingle=k)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in result.collect()} == brute_force(rows, k)


def test_links_past_a_pivot_that_has_none(spark):
    """The smallest member is too far from all others, which are linked with each other."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    rows = [edited(words, 18, rnd)] + [edited(words, 4, rnd) for _ in range(30)] + [edited(words, 16, rnd) for _ in range(30)]
    rows = list(enumerate(rows))
    result = near_duplicates(spark.createDataFrame([(i, t, 1, "b") for i, t in rows], DOCS), shingle=2)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in result.collect()} == brute_force(rows, 2)


def test_repeated_rows_and_null_keys(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "a b c"), (None, "of its own"), (3, None), (3, None)]
    result = near_duplicates(spark.createDataFrame([(i, t, 1, "b") for i, t in rows], DOCS))
    found = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in result.collect()), key=repr)
    assert found == sorted([(1, 1, 1, True), (1, 1, 1, True), (None, 1, 1, False), (2, 1, 1, False), (None, 1, None, True), (3, 0, 3, True), (3, 0, 3, True)], key=repr)


def test_empty_table_and_stage(spark):
    empty = spark.createDataFrame([], DOCS)
    assert near_duplicates(empty).count() == 0
    assert drop_near_duplicates(empty).columns == empty.columns
    docs = spark.createDataFrame([(1, "one two three", 5, "x"), (2, "one two three", 6, "y"), (None, "one two three", 7, "z"), (4, None, 8, "w")], DOCS)
    assert sorted(r.n for r in drop_near_duplicates(docs).collect()) == [5, 7, 8]


def test_minima_and_maxima_estimate_similarity(spark):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(words), 1, ""), (1, edited(words, 20, rnd), 1, "")]
    signed = signatures(spark.createDataFrame(rows, DOCS), key="doc_id", text="text", words=space_words, shingle=1, bands=1024, rows=1, seed=1).orderBy("id").collect()
    a, b = (shingles(t, 1) for _, t, _, _ in rows)
    same = [x == y for x, y in zip(signed[0].bands, signed[1].bands)]
    for half in (same[:512], same[512:]):
        assert abs(sum(half) / 512 - len(a & b) / len(a | b)) < 0.06


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rnd = random.Random(seed)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(500, n) for n in range(501, 560)]
    rnd.shuffle(links)
    nodes = {n for a, b in links if a != b for n in (a, b)}
    found = components(spark.createDataFrame(links + [(7, None)], "a long, b long"), Stages(spark))
    assert {r.node: r.component for r in found.collect()} == roots(nodes, links_of(nodes, links))
    assert components(spark.createDataFrame([(1, 1)], "a long, b long"), Stages(spark)) is None


def links_of(nodes, links):
    return [(a, b) for a, b in links if a in nodes and b in nodes]
