"""Quality classifier: document evidence combined with host and path posteriors by empirical Bayes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspan.llm.common import Stages, map_arrow, restrict, utf8

#: Labelled rows that the document model is fitted on at most; a hash of the key chooses them.
FIT_ROWS = 20_000
#: Probabilities travel as whole millionths, whose sums do not depend on the order.
UNIT = 1_000_000
#: Sites up to this number are broadcast; more are joined by a shuffle.
BROADCAST_SITES = 200_000

FEATURES = (
    "log_words", "distinct_words", "repeated_neighbours", "word_length", "longest_word", "letters", "capitals", "digits", "marks",
    "pipes", "exclamations", "words_with_marks", "one_mark_words", "distinct_lines", "line_words",
)

_LETTERS = bytes(c for c in range(256) if chr(c).isascii() and chr(c).isalpha() or c >= 128)
_CAPITALS = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_PLAIN_MARKS = b".,;:'\"()-"
_ODD_MARKS = bytes(c for c in _MARKS if c not in _PLAIN_MARKS)


def features(text: bytes | None) -> list[float]:
    """Shares and lengths that tell prose from listings, shouting, repetition and noise. Empty text: all zero."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(FEATURES)
    size, n = len(text), len(words)
    without = lambda drop: size - len(text.translate(None, drop))
    letters, odd = without(_LETTERS), without(_ODD_MARKS)
    lines = [line for line in text.split(b"\n") if line.strip()]
    neighbours = sum(map(bytes.__eq__, words, words[1:]))
    return [
        float(np.log(n)),
        len(set(words)) / n**0.8,
        neighbours / n,
        min(sum(map(len, words)) / n, 40.0),
        min(max(map(len, words)), 200) / 20,
        letters / size,
        without(_CAPITALS) / max(letters, 1),
        without(_DIGITS) / size,
        without(_MARKS) / size,
        min(text.count(b"|") / n, 2.0),
        min(text.count(b"!") / n, 3.0),
        min(odd / n, 5.0),
        min((len(text.split(b"|")) - 1 + odd) / size, 1.0),
        len(set(lines)) / len(lines),
        min(n / len(lines), 200.0) / 50,
    ]


class DocumentModel(NamedTuple):
    """Logistic regression on standardised features and their squares."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @staticmethod
    def expand(x: np.ndarray) -> np.ndarray:
        return np.concatenate((x, np.square(x)), axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = (self.expand(x) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit_model(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> DocumentModel:
    """Ridge logistic regression by Newton's method. Labels of one kind give a constant near their share."""
    if not len(y):
        return DocumentModel(np.zeros(2 * len(FEATURES)), np.ones(2 * len(FEATURES)), np.zeros(2 * len(FEATURES) + 1))
    z = DocumentModel.expand(x)
    mean, scale = z.mean(0), z.std(0)
    scale[scale < 1e-9] = 1.0
    design = np.concatenate(((z - mean) / scale, np.ones((len(z), 1))), axis=1)
    weights, penalty = np.zeros(design.shape[1]), np.full(design.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        gradient = design.T @ (p - y) + penalty * weights
        curve = (design * (p * (1 - p) + 1e-6)[:, None]).T @ design + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        weights = weights - step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-6:
            break
    return DocumentModel(mean, scale, weights)


def _features(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(t) for t in utf8(batch.column(at))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["id", "x"])


def _evidence(batches: Iterator[pa.RecordBatch], at: int, model: DocumentModel) -> Iterator[pa.RecordBatch]:
    """Every row with its probability in whole millionths, between 1 and UNIT - 1."""
    for batch in batches:
        row = batch.column(0)
        x = np.array([features(t) for t in utf8(row.field(at))]).reshape(-1, len(FEATURES))
        units = np.clip(np.rint(model.probability(x) * UNIT), 1, UNIT - 1).astype(np.int64)
        yield pa.RecordBatch.from_arrays([row, pa.array(units)], ["row", "evidence"])


def with_evidence(docs: DataFrame, model: DocumentModel, text: str) -> DataFrame:
    """(row, evidence): the given columns stay together in ``row``, so no name of theirs meets one made here."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = T.StructType([*rows.schema.fields, T.StructField("evidence", T.LongType())])
    return map_arrow(rows, partial(_evidence, at=docs.columns.index(text), model=model), schema)


def fit_documents(docs: DataFrame, labels: DataFrame, *, key: str, text: str, label: str, fit_rows: int = FIT_ROWS) -> DocumentModel:
    """The document model from at most ``fit_rows`` labelled documents.

    Several labels of a key are averaged and count as good from one half on. Of a key's
    repeated documents one counts, that of the least features. Labels or keys that are null, and labels
    without a document, take no part.
    """
    stages = Stages(docs.sparkSession)
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg((F.avg(label) >= 0.5).cast("int").alias("_good"))
    known = stages.keep(known.orderBy(F.xxhash64(key), key).limit(fit_rows), "known")
    own = restrict(docs.select(key, text), known.select(key), key)
    kind = docs.schema[key].dataType.simpleString()
    rows = map_arrow(own, partial(_features, at=1), f"id {kind}, x array<double>").withColumnRenamed("id", key)
    rows = rows.groupBy(key).agg(F.min("x").alias("x")).join(F.broadcast(known), key).orderBy(key).toPandas()
    stages.drop("known")
    return fit_model(np.array(rows["x"].tolist()).reshape(-1, len(FEATURES)), rows["_good"].to_numpy(float))


def _strength(groups: DataFrame, prior) -> float:
    """Prior strength from the spread of group means beyond what sampling explains (method of moments)."""
    row = groups.select(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") / UNIT - prior, 2)).alias("spread"),
        F.count("*").alias("groups"),
        F.sum(F.col("n") * prior * (1 - prior)).alias("noise"),
        F.sum(F.col("n") * F.col("n")).alias("squares"),
    ).first()
    if not row.n or row.groups < 2:
        return 1e6
    within = row.noise / row.n
    between = (row.spread - row.groups * within) / max(row.n - row.squares / row.n, 1e-9)
    return float(min(max(within / between - 1, 2.0), 1e6)) if between > 1e-9 else 1e6


def site_posteriors(evidence: DataFrame, *, host: str, path: str) -> tuple[DataFrame, float]:
    """Good shares of sites by grouped sums, and the global share.

    (host, path, host_n, host_good, path_n, path_good, host_strength, path_strength), one
    row per site; a null host or path is a site of its own. ``good`` sums probabilities in millionths.
    """
    stages = Stages(evidence.sparkSession)
    paths = evidence.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(F.count("*").alias("n"), F.sum("evidence").alias("good"))
    paths = stages.keep(paths, "paths")
    hosts = stages.keep(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "hosts")
    whole = hosts.select(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    overall = (whole.good + UNIT) / (whole.n + 2) / UNIT if whole.n else 0.5
    host_strength = _strength(hosts, F.lit(overall))
    per_host = hosts.select("host", F.col("n").alias("host_n"), F.col("good").alias("host_good"))
    sites = paths.join(per_host, paths.host.eqNullSafe(per_host.host)).drop(per_host.host)
    host_share = (F.col("host_good") / UNIT + host_strength * overall) / (F.col("host_n") + host_strength)
    path_strength = _strength(sites.withColumn("share", host_share), F.col("share"))
    return sites.withColumnsRenamed({"n": "path_n", "good": "path_good"}).withColumns({"host_strength": F.lit(host_strength), "path_strength": F.lit(path_strength)}), overall


def _logit(p):
    return F.log(p / (1 - p))


def judge(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", label: str = "quality", threshold: float = 0.5, fit_rows: int = FIT_ROWS
) -> DataFrame:
    """(row, evidence, host_posterior, path_posterior, quality, accepted): the given columns together in ``row``.

    1. A logistic model gives every document's probability of being good from its whole text.
    2. Hosts: the mean probability of the host's other documents, shrunk towards the global
       share. Paths: that of the path's other documents, shrunk towards its host's posterior.
       The strengths come from the spread between groups, so a site with few documents
       says little. A document's own evidence is left out of its site.
    3. The document's log odds are moved by the site's log odds against the global ones.

    Documents under ``threshold`` are rejected. Null or empty text: all features zero, judged
    like any other. Null hosts or paths form a site. Without labels every document has
    even evidence and is accepted. Sums are of whole millionths, so results do not depend on
    partitions. Sites are aggregated before they move and broadcast only when counted to be few.
    """
    model = fit_documents(docs, labels, key=key, text=text, label=label, fit_rows=fit_rows)
    slim = with_evidence(docs.select(F.col(host).alias("host"), F.col(path).alias("path"), F.col(text).alias("text")), model, "text")
    stages = Stages(docs.sparkSession)
    sites, overall = site_posteriors(slim, host="row.host", path="row.path")
    sites = stages.keep(sites.withColumnsRenamed({"host": "site_host", "path": "site_path"}), "sites")
    few = sites.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES

    scored = with_evidence(docs, model, text)
    own_host, own_path = (F.col("row").getField(c) for c in (host, path))
    at = own_host.eqNullSafe(F.col("site_host")) & own_path.eqNullSafe(F.col("site_path"))
    joined = scored.join(F.broadcast(sites) if few else sites, at, "left")
    own = F.col("evidence") / UNIT
    host_posterior = ((F.col("host_good") - F.col("evidence")) / UNIT + F.col("host_strength") * overall) / (F.col("host_n") - 1 + F.col("host_strength"))
    path_posterior = ((F.col("path_good") - F.col("evidence")) / UNIT + F.col("path_strength") * F.col("host_posterior")) / (F.col("path_n") - 1 + F.col("path_strength"))
    joined = joined.withColumn("host_posterior", host_posterior).withColumn("path_posterior", path_posterior)
    odds = _logit(own) + _logit(F.col("path_posterior")) - _logit(F.lit(overall))
    joined = joined.withColumn("quality", F.round(1 / (1 + F.exp(-odds)), 6))
    return joined.select("row", "evidence", "host_posterior", "path_posterior", "quality", (F.col("quality") >= threshold).alias("accepted"))


def quality_scores(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", **options) -> DataFrame:
    """(key, evidence, host_posterior, path_posterior, quality, accepted) for every row."""
    judged = judge(docs.select(key, text, host, path), labels, key=key, text=text, host=host, path=path, **options)
    return judged.select(
        F.col("row").getField(key).alias(key),
        (F.col("evidence") / UNIT).alias("evidence"),
        F.round("host_posterior", 6).alias("host_posterior"),
        F.round("path_posterior", 6).alias("path_posterior"),
        "quality",
        "accepted",
    )


def drop_poor(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The accepted rows of ``docs``, all columns kept."""
    return judge(docs, labels, **options).where("accepted").select("row.*")
