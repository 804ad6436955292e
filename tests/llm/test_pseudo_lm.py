"""Pseudo-likelihood: counts against brute force, the network on held-out texts."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from fieldspan.llm.pseudo_lm import Kinds, fit, score, train, words_of

DOCS = "doc_id long, text string, n int, word string"


def corpus(n, seed):
    """Words that depend on their neighbours: pairs that go together, and a cycle."""
    rnd = random.Random(seed)
    texts = []
    for _ in range(n):
        at, words = rnd.randrange(12), []
        for _ in range(rnd.randrange(5, 60)):
            words += [f"w{at}", f"v{at}"] if rnd.random() < 0.8 else [f"x{rnd.randrange(40)}"]
            at = (at + rnd.choice((1, 1, 1, 5))) % 12
        texts.append(" ".join(words))
    return texts


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "w") for i, t in enumerate(texts)], DOCS)


def test_model_from_both_sides_beats_frequencies_on_held_out_texts(spark):
    known, held_out = corpus(300, 1), corpus(60, 2)
    model = fit(frame(spark, known), kinds=64, classes=16)
    expected = Counter(w for t in known for w in words_of(t.encode()))
    assert model.frequent == [w for w, _ in sorted(expected.items(), key=lambda x: (-x[1], x[0]))[:47]]
    table = model.table.reshape(64, 64, 64)
    assert np.allclose(np.exp(table.astype(float)).sum(-1), 1, atol=1e-4)

    rows = score(frame(spark, held_out), model).collect()
    kinds = Kinds(model.frequent, 64, 16)
    for r in rows:
        k = kinds.of(words_of(held_out[r.doc_id].encode()))
        assert r.n_tokens == len(k) - 2
        assert math.isclose(r.log_likelihood, sum(float(table[a, b, c]) for a, c, b in zip(k, k[1:], k[2:])), abs_tol=1e-3)
    single = Counter(k for t in known for k in kinds.of(words_of(t.encode()))[1:-1])
    total = sum(single.values())
    plain = sum(math.log((single[k] + 1) / (total + 64)) for t in held_out for k in kinds.of(words_of(t.encode()))[1:-1])
    assert sum(r.log_likelihood for r in rows) > 0.6 * plain  # both are negative
    shuffled = [" ".join(random.Random(3).sample(t.split(), len(t.split()))) for t in held_out]
    assert sum(r.log_likelihood for r in score(frame(spark, shuffled), model).collect()) < sum(r.log_likelihood for r in rows)


def test_partitions_make_no_difference(spark):
    docs = frame(spark, corpus(80, 5) + [None, "", " \n", "one", "one", "long " * 30_000])
    one, other = fit(docs.repartition(1), kinds=32, classes=8), fit(docs.repartition(6), kinds=32, classes=8)
    assert one.frequent == other.frequent and np.array_equal(one.table, other.table)
    rows = {r.doc_id: r for r in score(docs, one).collect()}
    assert [(rows[i].n_tokens, rows[i].log_likelihood, rows[i].per_token) for i in (80, 81, 82)] == [(0, 0.0, None)] * 3
    assert rows[83].n_tokens == 1 and rows[83].log_likelihood == rows[84].log_likelihood < 0 and rows[85].n_tokens == 30_000


def test_nothing_to_learn_from(spark):
    model = fit(frame(spark, [None, ""]), kinds=16, classes=4)
    assert score(frame(spark, ["a b"]), model).first().n_tokens == 2
    assert score(frame(spark, []), model).count() == 0
    with pytest.raises(ValueError):
        fit(frame(spark, []), kinds=16, classes=6)


def test_training_finds_the_conditional_shares():
    rnd = np.random.default_rng(1)
    true = rnd.dirichlet(np.ones(6) * 0.3, size=(6, 6))
    table = train(true * 1000, width=24, passes=600).log_probabilities()
    loss, best = -(true * table).sum() / 36, -(true * np.log(np.maximum(true, 1e-12))).sum() / 36
    assert loss < best + 0.15


def test_every_word_has_its_own_probability(spark, monkeypatch):
    known = corpus(200, 1) + ["zebra zebra zebra quilt"] * 30 + ["quilt"]
    counts = Counter(w for t in known for w in words_of(t.encode()))
    asked = [*known[:40], "zebra quilt w1 never-seen", "x1 x1 x2", None, ""]
    results = []
    for part in (100_000, 20):  # all words travel; most are joined
        monkeypatch.setattr("fieldspan.llm.pseudo_lm.HELD_PART", part)
        fitted = fit(frame(spark, known), kinds=32, classes=16)
        table, kinds = fitted.table.reshape(32, 32, 32), Kinds(fitted.frequent, 32, 16)
        sizes = Counter()
        for w, n in counts.items():
            sizes[kinds[w]] += n

        def share(w):
            return 0.0 if w in fitted.frequent else math.log(max(counts[w], 1) / (sizes[kinds[w]] + 1))

        for r in score(frame(spark, asked), fitted, words=True).collect():
            split = words_of((asked[r.doc_id] or "").encode())
            k = kinds.of(split)
            expected = sum(float(table[a, b, c]) for a, c, b in zip(k, k[1:], k[2:])) + sum(map(share, split))
            assert r.n_tokens == len(split) and math.isclose(r.log_likelihood, expected, abs_tol=1e-3)
        results.append(sorted((r.doc_id, r.log_likelihood) for r in score(frame(spark, asked), fitted, words=True).collect()))
        assert len(fitted.words.collect()) == len(counts)
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-3 for a, b in zip(*results))


def test_gibberish_scores_below_words(spark):
    classed = [f"word{i:02d}" for i in range(60)]
    texts = [" ".join(classed[(i * 7 + j) % 60] for j in range(20)) for i in range(100)]
    fitted = fit(frame(spark, texts), kinds=32, classes=16)
    kinds = Kinds(fitted.frequent, 32, 16)
    word = next(w for w in classed if w.encode() not in fitted.frequent)
    gibberish = next(g for g in (f"qzx{i:03d}" for i in range(1000)) if kinds[g.encode()] == kinds[word.encode()])
    rows = {r.doc_id: r.log_likelihood for r in score(frame(spark, [word, gibberish]), fitted, words=True).collect()}
    assert rows[1] < rows[0] - 1
