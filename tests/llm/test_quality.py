"""Quality classifier: held-out accuracy, and posteriors against brute force."""

import math
import os
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from fieldspan.llm.quality import FEATURES, UNIT, drop_poor, features, fit_documents, fit_model, judge, quality_scores

DOCS, LABELS = "doc_id long, text string, lang string, source string, quality string, host int", "doc_id long, quality int, text string"
SF_DIR = "/root/testdata/sf0.01"


def texts(n, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randrange(2, 9)))
    found = []
    for i in range(n):
        words = [word() for _ in range(rnd.randrange(30, 200))]
        good = rnd.random() < 0.7
        found.append((" ".join(words) + "." if good else rnd.choice((" | ".join(words), "### ".join(words), "!! ".join(words).upper(), " ".join([words[0]] * 100))), good))
    return found


def frames(spark, rows, labelled):
    rnd = random.Random(9)
    docs = [(i, t, rnd.choice(["en", "fr", None]), rnd.choice(["a", "a", "a", "b", "c", None]), "q", 1) for i, (t, _) in enumerate(rows)]
    docs += [(9000, None, "en", "a", "q", 1), (9001, "", "en", "b", "q", 1), (9002, "x " * 50_000, "en", "b", "q", 1), (None, rows[0][0], "en", "b", "q", 1), (0, rows[0][0], "en", "a", "q", 1)]
    labels = [(i, int(rows[i][1]), "t") for i in labelled] + [(labelled[0], int(rows[labelled[0]][1]), "t"), (labelled[1], None, "t"), (None, 1, "t"), (77_777, 1, "t")]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)


def test_held_out_accuracy_and_posteriors(spark):
    rows = texts(400, 1)
    docs, labels = frames(spark, rows, list(range(150)))
    judged = judge(docs, labels).select("row.*", F.col("accepted").alias("_accepted"), F.col("evidence").alias("_evidence"), F.col("host_posterior").alias("_host_posterior"), F.col("path_posterior").alias("_path_posterior"), F.col("quality").alias("_quality")).collect()
    assert len(judged) == docs.count()
    held_out = [r for r in judged if r.doc_id is not None and 150 <= r.doc_id < 400]
    assert sum(r._accepted == rows[r.doc_id][1] for r in held_out) >= 0.97 * len(held_out)

    sites, hosts, n, good = {}, {}, len(judged), sum(r._evidence for r in judged)
    for r in judged:
        for key, into in ((r.source, hosts), ((r.source, r.lang), sites)):
            a, b = into.get(key, (0, 0))
            into[key] = (a + 1, b + r._evidence)
    overall = (good + UNIT) / (n + 2) / UNIT

    def strength(groups):  # of (n, good, prior)
        within = sum(c * p * (1 - p) for c, _, p in groups) / n
        spread = sum(c * (g / c / UNIT - p) ** 2 for c, g, p in groups)
        between = (spread - len(groups) * within) / (n - sum(c * c for c, _, _ in groups) / n)
        return min(max(within / between - 1, 2.0), 1e6) if between > 1e-9 else 1e6

    of_hosts = strength([(c, g, overall) for c, g in hosts.values()])
    share = {h: (g / UNIT + of_hosts * overall) / (c + of_hosts) for h, (c, g) in hosts.items()}
    of_sites = strength([(c, g, share[h]) for (h, _), (c, g) in sites.items()])
    logit = lambda p: math.log(p / (1 - p))
    for r in judged:
        (c, g), (d, k) = hosts[r.source], sites[r.source, r.lang]
        host = ((g - r._evidence) / UNIT + of_hosts * overall) / (c - 1 + of_hosts)
        path = ((k - r._evidence) / UNIT + of_sites * host) / (d - 1 + of_sites)
        quality = 1 / (1 + math.exp(-(logit(r._evidence / UNIT) + logit(path) - logit(overall))))
        assert r._host_posterior == pytest.approx(host) and r._path_posterior == pytest.approx(path) and r._quality == pytest.approx(quality, abs=2e-6)


def test_a_bad_site_weighs_on_documents_in_doubt(spark):
    """Two documents with the same text: the one among rejected neighbours gets the lower quality."""
    rows = texts(300, 2)
    docs = [(i, t, "en", "clean" if g else "dirty", "q", 1) for i, (t, g) in enumerate(rows)]
    docs += [(1000, "some words | here", "en", "clean", "q", 1), (1001, "some words | here", "en", "dirty", "q", 1)]
    labels = spark.createDataFrame([(i, int(g), "t") for i, (_, g) in enumerate(rows)], LABELS)
    found = {r.doc_id: r for r in quality_scores(spark.createDataFrame(docs, DOCS), labels).collect()}
    assert found[1000].evidence == found[1001].evidence and found[1000].quality > found[1001].quality


def test_empty_tables_and_stage(spark):
    docs, labels = frames(spark, texts(20, 3), list(range(10)))
    assert quality_scores(docs.limit(0), labels).count() == 0
    unlabelled = quality_scores(docs, labels.limit(0)).collect()
    assert len(unlabelled) == docs.count() and all(r.accepted and r.evidence == 0.5 for r in unlabelled)
    kept = drop_poor(docs, labels)
    assert kept.columns == docs.columns
    assert fit_model(np.zeros((5, len(FEATURES))), np.ones(5)).probability(np.zeros((1, len(FEATURES))))[0] > 0.9
    assert features(None) == features(b"") == features(b" \n") == [0.0] * len(FEATURES)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no given tables here")
def test_given_labels_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    held_out = labels.where("doc_id % 2 = 1").select("doc_id", (labels.quality == 1).alias("good"))
    rows = quality_scores(docs, labels.where("doc_id % 2 = 0")).join(held_out, "doc_id").collect()
    assert len(rows) > 100 and sum(r.accepted == r.good for r in rows) >= 0.99 * len(rows)


def test_own_names_as_columns(spark):
    """Every name that the operator uses inside may be a column of the documents, and comes back unchanged."""
    names = "row evidence host path n good host_n host_good path_n path_good host_strength path_strength site_host site_path host_posterior path_posterior quality accepted x id _good _evidence _quality share".split()
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("Plain words in a sentence. "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"), F.lit("l").alias("lang"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    extra = docs.select("*", *[(F.col("doc_id") + i).alias(name) for i, name in enumerate(names)])
    kept = drop_poor(extra, labels)
    assert kept.columns == extra.columns
    rows = kept.collect()
    assert len(rows) == 40 and all(r[name] == r.doc_id + i for r in rows for i, name in enumerate(names))


def test_repeats_of_a_labelled_document_do_not_push_others_out(spark):
    docs = spark.createDataFrame([(1, "good words here.")] * 50 + [(2, "x|x|x!!!")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    model = fit_documents(docs, labels, key="doc_id", text="text", label="quality", fit_rows=2)
    good, bad = model.probability(np.array([features(b"good words here."), features(b"x|x|x!!!")]))
    assert good > 0.5 > bad
