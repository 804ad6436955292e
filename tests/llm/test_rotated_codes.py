"""Embedding near-dedup by rotated codes against brute force."""

import numpy as np
import pytest

from fieldspan.llm.rotated_codes import encode, estimate, near_duplicates, drop_near_duplicates, tables_of, units

VECTORS = "vec_id long, embedding array<float>, row int, digest int, v int"


def brute_force(rows, limit=0.95):
    usable = {}
    for n, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[n] = np.array(v, np.float32).astype(float)
    linked = {n: set() for n in range(len(rows))}
    for a in usable:
        for b in usable:
            x, y = usable[a], usable[b]
            if a != b and len(x) == len(y) and (np.array_equal(x, y) or x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= limit):
                linked[a].add(b)
    found = []
    for n, (i, _) in enumerate(rows):
        reached, todo = {n}, [n]
        while todo:
            for m in linked[todo.pop()] - reached:
                reached.add(m)
                todo.append(m)
        least = min((rows[m][0] for m in reached), default=None) if i is not None else None
        found.append((i, len(linked[n]), least, i is not None and i == least))
    return sorted(found, key=repr)


def result(df, **options):
    return sorted((tuple(r) for r in near_duplicates(df, **options).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def near(rnd, center, cosine, n):
    """Unit vectors at an exact cosine of a centre."""
    across = rnd.normal(size=(n, len(center)))
    across -= (across @ center)[:, None] * center
    return cosine * center + np.sqrt(1 - cosine**2) * across / np.linalg.norm(across, axis=1, keepdims=True)


@pytest.mark.parametrize("options", [{}, {"block_rows": 7}, {"bits": 10, "block_rows": 20}])
def test_equals_brute_force(spark, options):
    rnd = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rnd.normal(size=(150, 16)))]
    for c in range(6):
        center = units(rnd.normal(size=(1, 16)))[0]
        group = np.concatenate([near(rnd, center, x, 12) for x in (0.999, 0.99, 0.975, 0.95, 0.9)])
        rows += [(1000 + 100 * c + k, (v * rnd.uniform(0.1, 9)).tolist()) for k, v in enumerate(group)]
    rows += [(5000 + k, rows[3][1]) for k in range(40)] + [(5000, rows[4][1]), (2, rows[3][1])]
    rows += [(6000, None), (6001, [None] * 16), (6002, [0.0] * 16), (6003, [float("nan")] * 16), (6004, [float("inf")] + [1.0] * 15), (6005, []), (None, rows[3][1]), (None, None)]
    rows += [(7000, [1.0, 0.0]), (7001, [1.0, 0.1]), (7002, [-1.0, 0.0]), (7003, [3.0]), (7004, [2.0]), (7005, [-2.0]), (7006, [1e30, 1e30]), (7007, [1e-30, 1e-30]), (7008, [-0.0, 1.0]), (7009, [0.0, 1.0])]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], VECTORS)
    assert result(df, **options) == brute_force(rows)


def test_doubles_and_empty(spark):
    rows = [(1, [0.1, 0.2]), (2, [0.1, 0.2]), (3, [0.1, 0.2000001])]
    assert result(spark.createDataFrame(rows, "vec_id int, embedding array<double>")) == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False)]
    assert result(spark.createDataFrame([], VECTORS)) == []
    assert result(spark.createDataFrame([(4, None, 1, 2, 3)], VECTORS)) == [(4, 0, 4, True)]


def test_drop_keeps_columns_and_rows_without_key(spark):
    rows = [(1, [1.0, 0.0], 1, 2, 3), (2, [1.0, 0.01], 4, 5, 6), (3, [0.0, 1.0], 7, 8, 9), (None, [1.0, 0.0], 7, 8, 9)]
    kept = drop_near_duplicates(spark.createDataFrame(rows, VECTORS))
    assert sorted((r.vec_id or 0, r.row, r.digest, r.v) for r in kept.collect()) == [(0, 7, 8, 9), (1, 1, 2, 3), (3, 7, 8, 9)]


@pytest.mark.parametrize("dims", [3, 64, 100])
def test_estimates_are_unbiased_and_bounds_hold(dims):
    rnd = np.random.default_rng(dims)
    center = units(rnd.normal(size=(1, dims)))[0]
    others, bias = near(rnd, center, 0.95, 400), []
    for seed in range(30):
        numbers = np.arange(401)
        words, factors = encode(np.concatenate([center[None], others]), numbers, seed)
        for a, b in ((slice(0, 1), slice(1, None)), (slice(1, None), slice(0, 1))):
            cosines, errors = estimate(words[a], factors[a], words[b], factors[b], 0.95)
            assert (cosines >= 0.95 - errors).all()
            bias.append((cosines - 0.95).mean())
    assert abs(np.mean(bias)) < 0.01
    words, factors = encode(units(rnd.normal(size=(500, 64))), np.arange(500), 1)
    cosines, errors = estimate(words, factors, words, factors, 0.95)
    assert (cosines >= 0.95 - errors).sum() - 500 < 100  # few of 249,500 unlike pairs are recomputed


def test_recall_of_the_tables():
    for bits in (2, 8, 24):
        same = (1 - np.arccos(0.95) / np.pi) ** bits
        assert (1 - same) ** tables_of(bits, 0.95) <= 1e-4


def test_links_of_a_crowd_are_exact(spark):
    """A few thousand vectors in one place and thousands of copies: blocks, copies and trees together."""
    rnd = np.random.default_rng(8)
    center = units(rnd.normal(size=(1, 64)))[0]
    crowd = np.concatenate([near(rnd, center, x, 400) for x in (0.99, 0.98, 0.97)]).astype(np.float32)
    vectors = np.concatenate([crowd, np.repeat(crowd[:3], 500, axis=0), units(rnd.normal(size=(500, 64))).astype(np.float32)])
    df = spark.createDataFrame([(i, v.tolist(), 1, 2, 3) for i, v in enumerate(vectors)], VECTORS)
    unit = units(vectors.astype(float))
    linked = (unit @ unit.T >= 0.95) | (vectors[:, None, 0] == vectors[None, :, 0])
    np.fill_diagonal(linked, False)
    found = sorted((r.vec_id, r.n_links) for r in near_duplicates(df, block_rows=300).collect())
    assert found == list(enumerate(linked.sum(1).tolist()))
