"""Text classifiers over TF-IDF terms, scoring of many models in one pass, and their metrics."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import partial, reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fieldspan.operators.ngrams import (
    BROADCAST_TERMS,
    MIN_DF,
    MOST_DF,
    TOP_K,
    Known,
    TermTable,
    _place,
    anova_f,
    count_batch,
    fit_terms,
    known_terms,
    look_up,
    tfidf_terms,
    top_terms,
    weighed_chunks,
)
from fieldspan.session import let_workers_import, map_arrow, materialise, stage

#: Weights of all models that may travel to the tasks at once (numbers of 8 bytes); more models are scored in several passes.
BROADCAST_WEIGHTS = 1 << 22
#: Weighed terms, and sums of texts by model, that a task holds where texts are sent to the weights.
SENT_TERMS, SENT_SUMS = 1 << 22, 1 << 24


@dataclass(frozen=True)
class TextModel:
    """A classifier over the chosen terms of a term table.

    ``ids`` are the chosen terms, at most ``top_k``, in rising order; ``layers`` are pairs of a
    matrix (inputs x outputs) and a bias. Between layers stands a sigmoid; the last one gives the
    log-odds of class 1, or the logits of both classes.
    """

    terms: TermTable
    ids: np.ndarray
    layers: tuple[tuple[np.ndarray, np.ndarray], ...]

    def save(self, path: str) -> None:
        """Term table and weights, as Parquet."""
        spark = self.terms.table.sparkSession
        self.terms.table.write.parquet(f"{path}/terms")
        layers = [(n, [*map(int, w.shape)], w.ravel().tolist(), b.tolist()) for n, (w, b) in enumerate(self.layers)]
        spark.createDataFrame(layers, "layer int, shape array<int>, weights array<double>, bias array<double>").write.parquet(f"{path}/layers")
        rest = (self.ids.tolist(), self.terms.n_docs, self.terms.exceptions, self.terms.id_bits)
        spark.createDataFrame([rest], "ids array<long>, n_docs long, exceptions map<string,long>, id_bits int").write.parquet(f"{path}/model")

    @staticmethod
    def load(path: str) -> TextModel:
        spark = SparkSession.active()
        rest = spark.read.parquet(f"{path}/model").first()
        terms = TermTable(spark.read.parquet(f"{path}/terms"), rest.n_docs, dict(rest.exceptions), rest.id_bits)
        layers = spark.read.parquet(f"{path}/layers").orderBy("layer").collect()
        return TextModel(terms, np.array(rest.ids, np.int64), tuple((np.array(r.weights).reshape(r["shape"]), np.array(r.bias)) for r in layers))


def _design(batches: Iterator[pa.RecordBatch], ids) -> Iterator[pa.RecordBatch]:
    """Label and sparse vector of the chosen terms, in the layout of the vector type."""
    chosen = ids.value
    for batch in batches:
        label, own, weights = batch.columns
        flat = own.flatten().to_numpy()
        place = np.searchsorted(chosen, flat)
        place[place == len(chosen)] = 0
        found = chosen[place] == flat
        row = np.repeat(np.arange(len(batch)), own.value_lengths().to_numpy())[found]
        order = np.lexsort((place[found], row))
        offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(batch))))), pa.int32())
        indices = pa.ListArray.from_arrays(offsets, pa.array(place[found][order], pa.int32()))
        values = pa.ListArray.from_arrays(offsets, pa.array(weights.flatten().to_numpy()[found][order]))
        parts = [pa.array(np.zeros(len(batch)), pa.int8()), pa.array(np.full(len(batch), len(chosen)), pa.int32()), indices, values]
        features = pa.StructArray.from_arrays(parts, ["type", "size", "indices", "values"])
        yield pa.RecordBatch.from_arrays([label, features], ["label", "features"])


def sparse_design(weighed: DataFrame, ids: np.ndarray) -> DataFrame:
    """(label, features): staged rows of sparse vectors, ready for Spark ML."""
    spark = weighed.sparkSession
    schema = "label double, features struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"
    rows = weighed.select(F.col("label").cast("double").alias("label"), "ids", "weights")
    # Written as the plain layout of a vector and read back as vectors: no row passes through a Python object.
    _, path = stage(map_arrow(rows, partial(_design, ids=spark.sparkContext.broadcast(ids)), schema))
    return spark.read.schema(StructType([StructField("label", DoubleType()), StructField("features", VectorUDT())])).parquet(path)


def fit_classifier(
    train: DataFrame,
    key: str,
    text: str = "text",
    label: str = "is_seed",
    layers: int = 1,
    units: int = 64,
    top_k: int = TOP_K,
    min_df: int = MIN_DF,
    max_iter: int = 50,
    seed: int = 42,
    terms: TermTable | None = None,
    most: int = BROADCAST_TERMS,
) -> TextModel:
    """TF-IDF, the ``top_k`` terms by F, then logistic regression (``layers=1``) or a perceptron.

    Terms, idf and F are tables, of any size. What reaches the driver is the model: the chosen terms and their weights.
    Gradients over the sparse vectors of the chosen terms are summed by Spark. Rows without a label
    (0 or 1) take no part. ``terms`` takes a table fitted elsewhere, so that several models share it.
    """
    spark = train.sparkSession
    rows = train.select(key, F.col(text).alias("text"), F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    rows = materialise(rows)
    terms = terms or fit_terms(rows, "text", min_df)
    weighed = materialise(tfidf_terms(rows, terms, ["label"], "text", most))
    best = top_terms(anova_f(weighed, terms), top_k)
    ids = np.sort(np.array([r.id for r in best.select("id").collect()], np.int64))
    design = sparse_design(weighed, ids)
    if layers == 1:
        fitted = LogisticRegression(maxIter=max_iter, regParam=1e-3).fit(design)
        return TextModel(terms, ids, ((fitted.coefficients.toArray()[:, None], np.array([fitted.intercept])),))
    shape = [len(ids), *[units] * (layers - 1), 2]
    flat = MultilayerPerceptronClassifier(layers=shape, maxIter=max_iter, seed=seed).fit(design).weights.toArray()
    parts, at = [], 0
    for inputs, outputs in zip(shape[:-1], shape[1:]):
        end = at + inputs * outputs
        parts.append((flat[at:end].reshape(inputs, outputs), flat[end : end + outputs]))
        at = end + outputs
    return TextModel(terms, ids, tuple(parts))


@dataclass(frozen=True, eq=False)
class LinearModels(Mapping):
    """Linear models over one term table whose weights stay a table: (id, df, columns, coefficients), one row per term.

    A column is a model's place in ``names``, with the intercepts in ``bias``. A model asked for by its name is gathered.
    """

    terms: TermTable
    table: DataFrame
    names: list[str]
    bias: np.ndarray

    def __getitem__(self, name: str) -> TextModel:
        if name not in self.names:
            raise KeyError(name)
        column = self.names.index(name)
        rows = self.table.select("id", F.inline(F.arrays_zip("columns", "coefficients"))).where(F.col("columns") == column).toArrow()
        order = np.argsort(ids := rows.column("id").to_numpy())
        return TextModel(self.terms, ids[order], ((rows.column("coefficients").to_numpy()[order][:, None], self.bias[column : column + 1]),))

    def __iter__(self) -> Iterator[str]:
        return iter(self.names)

    def __len__(self) -> int:
        return len(self.names)


def linear_models(weights: DataFrame, terms: TermTable) -> LinearModels:
    """Models by name from given (model_id, term, coefficient); a null term is the intercept. Terms that the table lacks drop.

    Names and intercepts reach the driver, the coefficients are staged, one row per term. Runs when called.
    """
    intercept = F.when(F.col("term").isNull() & F.col("model_id").isNotNull(), F.col("coefficient"))
    bias = {r.model_id: r.bias for r in weights.groupBy("model_id").agg(F.sum(intercept).alias("bias")).collect()}
    names = sorted(bias)
    columns = weights.sparkSession.createDataFrame(list(enumerate(names)), "column int, model_id string")
    coefficient = F.coalesce(F.col("coefficient").cast("double"), F.lit(float("nan"))).alias("coefficient")
    own = weights.where("term is not null").join(F.broadcast(columns), "model_id").select("term", "column", coefficient)
    own = own.groupBy("term").agg(F.collect_list(F.struct("column", "coefficient")).alias("own")).join(terms.table.select("term", "id", "df"), "term")
    table = own.select("id", "df", F.col("own.column").alias("columns"), F.col("own.coefficient").alias("coefficients"))
    return LinearModels(terms, materialise(table), names, np.array([bias[n] or 0.0 for n in names]))


class _Names(NamedTuple):
    """Names and intercepts of linear models, without their table."""

    names: list[str]
    bias: np.ndarray


class _Stack(NamedTuple):
    """First layers of several models over one term table, as a sparse table of term x output, and what follows them.

    Where most of that table is filled, ``dense`` has it instead of ``starts``, ``columns`` and ``weights``.
    """

    known: Known | None
    ids: np.ndarray
    starts: np.ndarray
    columns: np.ndarray
    weights: np.ndarray
    width: int
    models: list[tuple[str, slice, np.ndarray, tuple]]
    dense: np.ndarray | None = None


def _stacked(models: dict[str, TextModel], known: Known | None) -> _Stack:
    ids, columns, weights, placed, at = [], [], [], [], 0
    for name, model in models.items():
        (first, bias), *rest = model.layers
        width = first.shape[1]
        ids.append(np.repeat(model.ids, width))
        columns.append(np.tile(np.arange(at, at + width), len(model.ids)))
        weights.append(first.ravel())
        placed.append((name, slice(at, at + width), bias, tuple(rest)))
        at += width
    ids, columns, weights = (np.concatenate(x) for x in (ids, columns, weights))
    order = np.argsort(ids, kind="stable")
    own, starts = np.unique(ids[order], return_index=True)
    return _Stack(known, own, np.append(starts, len(ids)), columns[order], weights[order], at, placed)


def _first_sums(stack: _Stack, rows: int, row: np.ndarray, ids: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Text x output: the sums of the first layers, for texts given as (text, id, weight)."""
    if not len(stack.ids):
        return np.zeros((rows, stack.width))
    place, found = _place(stack.ids, ids)
    row, place, values = row[found], place[found], values[found]
    if stack.dense is not None:
        return _dense_sums(stack.dense, rows, row, place, values)
    n = stack.starts[place + 1] - stack.starts[place]
    entry = np.repeat(stack.starts[place] - np.cumsum(n) + n, n) + np.arange(n.sum())
    sums = np.bincount(np.repeat(row, n) * stack.width + stack.columns[entry], np.repeat(values, n) * stack.weights[entry], rows * stack.width)
    return sums.reshape(rows, stack.width)


def _dense_sums(dense: np.ndarray, rows: int, row: np.ndarray, place: np.ndarray, values: np.ndarray) -> np.ndarray:
    if (row[1:] < row[:-1]).any():
        order = np.argsort(row, kind="stable")
        row, place, values = row[order], place[order], values[order]
    sums = np.zeros((rows, dense.shape[1]))
    ends = np.searchsorted(row, np.arange(rows + 1)).tolist()
    for n, (a, b) in enumerate(zip(ends, ends[1:])):
        if a < b:
            np.dot(values[a:b], dense.take(place[a:b], 0), sums[n])
    return sums


def _forward(stack: _Stack, rows: int, row: np.ndarray, ids: np.ndarray, values: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """(model, probabilities of class 1) for texts given as (text, id, weight)."""
    return _outputs(stack, _first_sums(stack, rows, row, ids, values))


def _outputs(stack: _Stack, sums: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    for name, own, bias, rest in stack.models:
        out = sums[:, own] + bias
        for weights, offset in rest:
            out = (1 / (1 + np.exp(-out))) @ weights + offset
        odds = out[:, 0] if out.shape[1] == 1 else out[:, 1] - out[:, 0]
        yield name, 1 / (1 + np.exp(-odds))


def _scored(kept: list[pa.Array], names: list[str], found: Iterator[tuple[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for name, scores in found:
        model = pa.array([name]).take(pa.array(np.zeros(len(scores), np.int64)))
        yield pa.RecordBatch.from_arrays([model, *kept, pa.array(scores)], ["model_id", *names, "score"])


def _score_texts(batches: Iterator[pa.RecordBatch], stacks) -> Iterator[pa.RecordBatch]:
    """Texts are cut into terms once, whatever the number of models and term tables."""
    for batch in batches:
        counted, ends = count_batch(batch.column(batch.num_columns - 1))
        for stack in stacks.value:
            row, ids, _, weights = look_up(counted, ends, stack.known)
            yield from _scored(batch.columns[:-1], batch.schema.names[:-1], _forward(stack, len(batch), row, ids, weights))


def _score_weighed(batches: Iterator[pa.RecordBatch], stack) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, weights = batch.columns[-2:]
        row = np.repeat(np.arange(len(batch)), ids.value_lengths().to_numpy())
        found = _forward(stack.value, len(batch), row, ids.flatten().to_numpy(), weights.flatten().to_numpy())
        yield from _scored(batch.columns[:-2], batch.schema.names[:-2], found)


def _linear_stack(models: LinearModels | _Names, rows: pa.Table, known: Known | None) -> _Stack:
    """Rows of a table of linear models, as a stack."""
    order = np.argsort(ids := rows.column("id").to_numpy())
    rows = rows.take(pa.array(order)).combine_chunks()
    columns, coefficients = (pa.concat_arrays(rows.column(c).chunks) if rows.num_rows else pa.array([], pa.list_(kind)) for c, kind in (("columns", pa.int32()), ("coefficients", pa.float64())))
    starts = np.concatenate(([0], np.cumsum(columns.value_lengths().to_numpy()))).astype(np.int64)
    placed = [(name, slice(i, i + 1), models.bias[i : i + 1], ()) for i, name in enumerate(models.names)]
    width, columns, weights = len(models.names), columns.flatten().to_numpy(), coefficients.flatten().to_numpy()
    stack = _Stack(known, ids[order], starts, columns, weights, width, placed)
    if 2 * len(weights) < len(ids) * width or not len(ids):
        return stack
    at = np.repeat(np.arange(len(ids)) * width, np.diff(starts)) + columns
    none = np.empty(0, np.int64)
    return stack._replace(starts=none, columns=none, weights=none, dense=np.bincount(at, weights, len(ids) * width).reshape(-1, width))


def _among(sorted_ids: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return _place(sorted_ids, ids)[1]


def _lists_of(row: np.ndarray, rows: int, *values: np.ndarray) -> list[pa.Array]:
    """List columns of values in the order of their rows."""
    ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows)))), pa.int32())
    return [pa.ListArray.from_arrays(ends, pa.array(v)) for v in values]


def _begun(batches: Iterator[pa.RecordBatch], stack, asked) -> Iterator[pa.RecordBatch]:
    """(chunk, row, key, sums, ids, weights): the sums of the weights that travel, and the terms that have others.

    A chunk is an Arrow batch, so bounded. Without a list of terms that have other weights, all the rest may have some.
    """
    first = TaskContext.get().partitionId() << 33
    for number, batch in enumerate(batches):
        key, own, weights = batch.columns
        row = np.repeat(np.arange(len(batch)), own.value_lengths().to_numpy())
        rows = pa.table([pa.array(np.full(len(batch), first + number)), key], ["__chunk", batch.schema.names[0]])
        yield from _begun_chunk(rows, row, own.flatten().to_numpy(), None, weights.flatten().to_numpy(), stack, asked).to_batches()


def _begun_chunk(rows: pa.Table, row: np.ndarray, ids: np.ndarray, tfs: np.ndarray | None, weights: np.ndarray, stack, asked) -> pa.Table:
    """The same of one chunk, of which (text, id, weight) are given."""
    one, n = stack.value, rows.num_rows
    sums = _first_sums(one, n, row, ids, weights)
    rest = ~_among(one.ids, ids) if asked is None else _among(asked.value, ids)
    lists = _lists_of(row[rest], n, ids[rest], weights[rest])
    sums = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * one.width, pa.int32()), pa.array(sums.ravel()))
    chunk, key = rows.columns
    return pa.table([chunk, pa.array(np.arange(n), pa.int32()), key, sums, *lists], ["__chunk", "__row", rows.column_names[1], "__sums", "ids", "weights"])


def _sent(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """(block, chunk, rows, ids, weights): a chunk's weighed terms by the block that has their weights."""
    for batch in batches:
        chunks, numbers, own, weights = batch.columns
        at = np.repeat(np.arange(len(batch)), own.value_lengths().to_numpy())
        chunk, row, ids, values = chunks.to_numpy()[at], numbers.to_numpy()[at], own.flatten().to_numpy(), weights.flatten().to_numpy()
        block = np.mod(ids, blocks)
        order = np.lexsort((block, chunk))
        chunk, block = chunk[order], block[order]
        begin = np.flatnonzero(np.concatenate(([True], (np.diff(chunk) != 0) | (np.diff(block) != 0)))) if len(ids) else np.empty(0, np.int64)
        group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(ids))))
        lists = _lists_of(group, len(begin), row[order], ids[order], values[order])
        yield pa.RecordBatch.from_arrays([pa.array(block[begin], pa.int64()), pa.array(chunk[begin], pa.int64()), *lists], ["block", "__chunk", "rows", "ids", "weights"])


def _block_sums(sent: pa.Table, table: pa.Table, models) -> pa.Table:
    """(chunk, rows, sums): what a block's weights add to the texts of each chunk."""
    stack, found = _linear_stack(models.value, table, None), []
    for chunk, rows, ids, values in zip(*(sent.column(c) for c in ("__chunk", "rows", "ids", "weights"))):
        own, row = np.unique(rows.values.to_numpy(), return_inverse=True)
        sums = _first_sums(stack, len(own), row, ids.values.to_numpy(), values.values.to_numpy())
        found.append((chunk.as_py(), own, sums.ravel()))
    chunks, rows, sums = zip(*found) if found else ((), (), ())
    lists = [pa.array(rows, pa.list_(pa.int32())), pa.array(sums, pa.list_(pa.float64()))]
    return pa.table([pa.array(chunks, pa.int64()), *lists], ["__chunk", "rows", "sums"])


def _added(begun: pa.Table, parts: pa.Table, models) -> pa.Table:
    """(model_id, key, score) of a chunk: the sums of the weights that travel and of all blocks."""
    linear = models.value
    width, n = len(linear.names), begun.num_rows
    begun = begun.combine_chunks()
    place = np.empty(n, np.int64)
    place[begun.column("__row").to_numpy()] = np.arange(n)
    sums = np.concatenate([x.flatten().to_numpy() for x in begun.column("__sums").chunks]).reshape(n, width)
    for rows, own in zip(parts.column("rows"), parts.column("sums")):
        sums[place[rows.values.to_numpy()]] += own.values.to_numpy().reshape(-1, width)
    stack = _linear_stack(linear, pa.table({"id": pa.array([], pa.int64()), "columns": pa.array([], pa.list_(pa.int32())), "coefficients": pa.array([], pa.list_(pa.float64()))}), None)
    key = begun.column(2).combine_chunks()
    return pa.Table.from_batches(_scored([key], [begun.column_names[2]], _outputs(stack, sums)))


def _linear_scores(models: LinearModels, df: DataFrame, key: str, text: str, most: int, most_weights: int) -> DataFrame:
    """``ensemble_scores`` of models whose weights are a table, of any size.

    At most ``most_weights`` weights, those of the terms found in the most texts, travel to the tasks. For the others the
    texts' weighed terms are sent to blocks of weights, and the sums of each chunk of texts come back. Texts are weighed once.
    """
    spark, terms = df.sparkSession, models.terms
    kind = df.schema[key].dataType.simpleString()
    schema = f"model_id string, `{key}` {kind}, score double"
    if not len(models):
        return spark.createDataFrame([], schema)
    known = known_terms(spark, terms, most)
    level = F.least("df", F.lit(MOST_DF))
    by_df = models.table.groupBy(level.alias("df")).agg(F.sum(F.size("columns")).alias("n"), F.count(F.lit(1)).alias("terms")).collect()
    cut, held = MOST_DF + 1, 0
    for r in sorted(by_df, key=lambda r: -r.df):
        if held + r.n > most_weights:
            break
        cut, held = r.df, held + r.n
    columns = ["id", "columns", "coefficients"]
    travelling = _linear_stack(models, models.table.where(level >= cut).select(columns).toArrow(), known)
    rest, n_rest = models.table.where(level < cut).select(columns), sum(r.n for r in by_df) - held
    if not n_rest and known is not None:
        rows = df.select(F.col(key), F.col(text).alias("__text"))
        return map_arrow(rows, partial(_score_texts, stacks=spark.sparkContext.broadcast([travelling])), schema)
    stack = spark.sparkContext.broadcast(travelling._replace(known=None))
    if not n_rest:
        weighed = tfidf_terms(df, terms, [key], text, most).select(key, "ids", "weights")
        return map_arrow(weighed, partial(_score_weighed, stack=stack), schema)
    asked = None
    if sum(r.terms for r in by_df if r.df < cut) <= most:
        asked = spark.sparkContext.broadcast(np.sort(rest.select("id").toArrow().column("id").to_numpy()))
    begun_schema = f"__chunk long, __row int, `{key}` {kind}, __sums array<double>, ids array<long>, weights array<double>"
    if known is None:
        rows = df.select(F.col(key), F.col(text).alias("__text"))
        begun = weighed_chunks(rows, terms, most, partial(_begun_chunk, stack=stack, asked=asked), begun_schema)
    else:
        weighed = tfidf_terms(df, terms, [key], text, most).select(key, "ids", "weights")
        begun = map_arrow(weighed, partial(_begun, stack=stack, asked=asked), begun_schema)
    begun = materialise(begun)
    blocks = -(-n_rest // most_weights)
    n_texts, n_sent = begun.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    slices = max(1, -(-n_sent // (blocks * SENT_TERMS)), -(-n_texts * len(models) // SENT_SUMS))
    by = ["block", "slice"]
    sent = map_arrow(begun.select("__chunk", "__row", "ids", "weights"), partial(_sent, blocks=blocks), "block long, __chunk long, rows array<int>, ids array<long>, weights array<double>")
    sent = sent.withColumn("slice", F.pmod("__chunk", F.lit(slices).cast("long")))
    table = rest.withColumn("block", F.pmod("id", F.lit(blocks).cast("long"))).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    # What the tasks need of the models besides the weights.
    plain = spark.sparkContext.broadcast(_Names(models.names, models.bias))
    parts = sent.groupBy(*by).cogroup(table.groupBy(*by)).applyInArrow(partial(_block_sums, models=plain), "__chunk long, rows array<int>, sums array<double>")
    begun = begun.select("__chunk", "__row", key, "__sums")
    return begun.groupBy("__chunk").cogroup(parts.groupBy("__chunk")).applyInArrow(partial(_added, models=plain), schema)


def ensemble_scores(models: Mapping[str, TextModel], df: DataFrame, key: str, text: str = "text", most: int = BROADCAST_TERMS, most_weights: int = BROADCAST_WEIGHTS) -> DataFrame:
    """(model_id, key, score): probability of class 1 by every model, for every row of (key, text).

    One scan that cuts each text into terms once: models with the same term table are stacked into one table of
    term x output. Term tables and weights travel to the tasks as long as they are within ``most``
    terms and ``most_weights`` numbers together; what does not fit any more is scored in further passes, and a term
    table that is too large on its own is joined with the texts' terms. Counts the term tables when called.
    Of ``LinearModels`` as many weights travel as are within ``most_weights``, and the others stay where they are.
    """
    if isinstance(models, LinearModels):
        return _linear_scores(models, df, key, text, most, most_weights)
    spark = df.sparkSession
    rows = df.select(F.col(key), F.col(text).alias("__text"))
    schema = f"model_id string, `{key}` {rows.schema[key].dataType.simpleString()}, score double"
    passes: list[list[_Stack]] = [[]]
    parts: list[DataFrame] = []
    room = [most, most_weights]
    tables: dict[int, list[str]] = {}
    for name, model in models.items():
        tables.setdefault(id(model.terms), []).append(name)
    for names in tables.values():
        terms = models[names[0]].terms
        known = known_terms(spark, terms, most)
        size = 0 if known is None else len(known.ids)
        stacked: list[dict[str, TextModel]] = [{}]
        held = 0
        for name in names:
            weight = models[name].layers[0][0].size
            if stacked[-1] and held + weight > most_weights:
                stacked.append({})
                held = 0
            stacked[-1][name] = models[name]
            held += weight
        for group in stacked:
            stack = _stacked(group, known)
            if known is None:
                weighed = tfidf_terms(df, terms, [key], text, most).select(key, "ids", "weights")
                parts.append(map_arrow(weighed, partial(_score_weighed, stack=spark.sparkContext.broadcast(stack)), schema))
                continue
            if passes[-1] and (size > room[0] or len(stack.weights) > room[1]):
                passes.append([])
                room = [most, most_weights]
            passes[-1].append(stack)
            room = [room[0] - size, room[1] - len(stack.weights)]
    parts += [map_arrow(rows, partial(_score_texts, stacks=spark.sparkContext.broadcast(p)), schema) for p in passes if p]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def score(model: TextModel, df: DataFrame, key: str, text: str = "text", most: int = BROADCAST_TERMS) -> DataFrame:
    """(key, score): probability of the seed class, for every row of (key, text)."""
    return ensemble_scores({"": model}, df, key, text, most).drop("model_id")


def write_meta(metrics: DataFrame, path: str, technology: str, uid: str, architecture: str) -> str:
    """The meta file of a fitted model, one row of metrics, where ``read_metas`` finds it; returns the model's folder."""
    folder = f"{path}/{technology}_{uid}_{architecture}"
    row = metrics.first().asDict()
    text = json.dumps({"performance": {name: float(value) for name, value in row.items() if value is not None}})
    spark = metrics.sparkSession
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/model-best")
    return folder


#: What a worker has loaded, by the name of the loader.
_LOADED: dict[str, Callable] = {}


def score_with(
    df: DataFrame, key: str, load: Callable[[], Callable[[pd.Series], pd.Series]], text: str = "text", name: str | None = None
) -> DataFrame:
    """Scores of a model from elsewhere: ``load`` returns a function of a batch of texts.

    With a ``name`` a worker loads the model once and keeps it for all its tasks, also of later
    queries; another model needs another name. Without one it is loaded once per task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from fieldspan.operators.classify import _LOADED as kept

        predict = kept.get(name) if name else None
        if predict is None:
            predict = load()
            if name:
                kept[name] = predict
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "score": predict(batch[text])})

    let_workers_import(df.sparkSession)
    narrow = df.select(key, F.coalesce(F.col(text), F.lit("")).alias(text))
    return narrow.mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, score double")


def wide_scores(scores: DataFrame, key: str | list[str], models: list[str] | None = None) -> DataFrame:
    """One column per model. The models are a parameter list, or looked up."""
    return scores.groupBy(*([key] if isinstance(key, str) else key)).pivot("model_id", models).agg(F.first("score"))


def class_metrics(
    scored: DataFrame, by: list[str] | tuple[str, ...] = (), label: str = "label", threshold: float = 0.5
) -> DataFrame:
    """binary_accuracy, precision, recall (of class 1) and log loss, in one pass.

    A score of exactly the threshold is positive.
    """
    y, s = F.col(label), F.col("score")
    positive = s >= F.lit(threshold)
    hits = F.count_if(positive & (y == 1))
    p = F.least(F.greatest(s, F.lit(1e-7)), F.lit(1.0 - 1e-7))
    rows = scored.filter(y.isNotNull())
    return rows.groupBy(*by).agg(
        F.avg((positive.cast("int") == y).cast("double")).alias("binary_accuracy"),
        F.coalesce(F.try_divide(hits, F.count_if(positive)), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(hits, F.count_if(y == 1)), F.lit(0.0)).alias("recall"),
        F.avg(-F.when(y == 1, F.log(p)).otherwise(F.log(F.lit(1.0) - p))).alias("loss"),
    )


def error_report(
    scored: DataFrame, threshold: float = 0.5, label: str = "label", text: str = "text", by: list[str] | tuple[str, ...] = ()
) -> DataFrame:
    """False positives and negatives with score and text; positive means score above the threshold."""
    positive = F.col("score") > F.lit(threshold)
    kind = F.when(positive & (F.col(label) == 0), F.lit("false_positive")).when(
        ~positive & (F.col(label) == 1), F.lit("false_negative")
    )
    return scored.withColumn("error", kind).filter(F.col("error").isNotNull()).select(*by, "error", "score", text)
