"""Masked pseudo-likelihood: a bidirectional window network predicts every token from both of its sides."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspan.llm.common import REMEMBERED_WORDS, Stages, map_arrow, utf8

#: Kinds of tokens: the edge of a text, the most frequent words, and classes of all other words.
KINDS = 128
#: Classes of words by length and hash.
CLASSES = 48
#: Size of an embedding and of the hidden layer, passes of gradient descent over the counted windows, seed of the weights.
WIDTH, PASSES, SEED = 32, 100, 7
#: Distinct words that a task counts before it hands the counts on.
HELD_WORDS = 100_000
#: Words with more than this part of all tokens travel to the tasks with their counts, so there are fewer of them; all others are joined.
HELD_PART = 100_000
#: Log counts that are joined are whole numbers of this part, so sums do not depend on order.
UNIT = 1_000_000_000
#: Windows that a task gathers before it adds them to its counts.
HELD_WINDOWS = 200_000


def words_of(text: bytes) -> list[bytes]:
    """Words between white space, A-Z lower-cased."""
    return text.lower().split()


class Kinds(dict):
    """The kind of a word: 0 is the edge, then the frequent words in order, then classes."""

    def __init__(self, frequent: list[bytes], kinds: int = KINDS, classes: int = CLASSES):
        super().__init__((w, 1 + i) for i, w in enumerate(frequent))
        self.frequent, self.kinds, self.classes = frequent, kinds, classes

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED_WORDS:
            self.clear()
            self.update((w, 1 + i) for i, w in enumerate(self.frequent))
        long = min(len(word) // 4, 3)
        value = self[word] = self.kinds - self.classes + long * (self.classes // 4) + xxhash.xxh3_64_intdigest(word) % (self.classes // 4)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        """Kinds of the words with an edge on either side."""
        found = np.zeros(len(words) + 2, np.int64)
        found[1:-1] = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return found

    def windows(self, words: list[bytes]) -> np.ndarray:
        """One number for each word: its left neighbour, its right neighbour, itself."""
        k = self.of(words)
        return (k[:-2] * self.kinds + k[2:]) * self.kinds + k[1:-1]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def emitted() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in utf8(batch.column(0)):
            counts.update(words_of(text) if text else ())
            if len(counts) > HELD_WORDS:
                yield emitted()
                counts.clear()
    yield emitted()


def _count_windows(batches: Iterator[pa.RecordBatch], frequent: list[bytes], kinds: int, classes: int) -> Iterator[pa.RecordBatch]:
    known, counts, held, n = Kinds(frequent, kinds, classes), np.zeros(kinds**3, np.int64), [], 0
    for batch in batches:
        for text in utf8(batch.column(0)):
            if text:
                held.append(known.windows(words_of(text)))
                n += len(held[-1])
            if n >= HELD_WINDOWS:
                counts += np.bincount(np.concatenate(held), minlength=len(counts))
                held, n = [], 0
    if held:
        counts += np.bincount(np.concatenate(held), minlength=len(counts))
    found = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["window", "n"])


class WindowNetwork(NamedTuple):
    """Both neighbours are embedded, added, squashed, and turned into odds of every kind."""

    left: np.ndarray
    right: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def log_probabilities(self) -> np.ndarray:
        """log P(kind | left, right), as an array over left, right, kind."""
        hidden = np.tanh(self.left[:, None] + self.right[None] + self.bias)
        scores = hidden @ self.out + self.out_bias
        top = scores.max(-1, keepdims=True)
        return scores - top - np.log(np.exp(scores - top).sum(-1, keepdims=True))


def train(counts: np.ndarray, width: int = WIDTH, passes: int = PASSES, seed: int = SEED) -> WindowNetwork:
    """Adam on the mean negative log-likelihood of the counted windows (left, right, kind), all in every pass.

    A pass costs as much as there are pairs of neighbours that occur, whatever the size of
    the corpus. Without any window the network stays near even odds.
    """
    kinds, random = counts.shape[0], np.random.default_rng(seed)
    l, r = np.nonzero(counts.sum(-1))
    seen = counts[l, r].astype(np.float32)
    every = seen.sum(-1)
    total = np.float32(max(counts.sum(), 1.0))
    start = np.log((counts.sum((0, 1)) + 1.0) / (counts.sum() + kinds))
    shapes = ((kinds, width), (kinds, width), (width,), (width, kinds))
    weights = [x.astype(np.float32) for x in [random.normal(0, 0.3, s) for s in shapes] + [start]]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, passes + 1):
        if not len(l):
            break
        a, b, c, out, out_bias = weights
        hidden = np.tanh(a[l] + b[r] + c)
        scores = hidden @ out + out_bias
        p = np.exp(scores - scores.max(-1, keepdims=True))
        p /= p.sum(-1, keepdims=True)
        wrong = (p * every[:, None] - seen) / total
        back = (wrong @ out.T) * (1 - hidden**2)
        by_left, by_right = np.zeros_like(a), np.zeros_like(b)
        np.add.at(by_left, l, back)
        np.add.at(by_right, r, back)
        rate = np.float32(0.05 * (1 - 0.9 * step / passes))
        for i, g in enumerate((by_left, by_right, back.sum(0), hidden.T @ wrong, wrong.sum(0))):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            weights[i] = weights[i] - rate * (first[i] / np.float32(1 - 0.9**step)) / (np.sqrt(second[i] / np.float32(1 - 0.99**step)) + np.float32(1e-8))
    return WindowNetwork(*weights)


def _train(batches: Iterator[pa.RecordBatch], kinds: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(kinds**3)
    for batch in batches:
        counts[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    table = train(counts.reshape(kinds, kinds, kinds)).log_probabilities().astype(np.float32)
    yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], ["log_probabilities"])


class LanguageModel(NamedTuple):
    """What scoring needs: the frequent words and the network's table of log probabilities."""

    frequent: list[bytes]
    kinds: int
    classes: int
    table: np.ndarray  # float32, flat over left, right, kind
    sizes: np.ndarray  # tokens of each kind
    held: dict[bytes, float]  # log counts of the words that are common enough to travel


class Fitted(NamedTuple):
    """A model and the counts of all words it was fitted on."""

    model: LanguageModel
    words: DataFrame  # (word, n) of the whole vocabulary, in the shared folder

    @property
    def frequent(self) -> list[bytes]:
        return self.model.frequent

    @property
    def table(self) -> np.ndarray:
        return self.model.table


def fit(docs: DataFrame, *, text: str = "text", kinds: int = KINDS, classes: int = CLASSES) -> Fitted:
    """Count words and windows over all texts, then train the network on the counts.

    Counts are summed in tasks before they move. One task trains on at most ``kinds ** 3``
    counted windows, however large the corpus; the driver gets the ``kinds - classes - 1`` most
    frequent words (ties by their bytes), the table and the words above one in ``HELD_PART`` of all
    tokens. The counts of all words, which grow with the corpus, stay a table in the shared
    folder. Results do not depend on partitions.
    """
    if classes % 4 or classes + 1 >= kinds:
        raise ValueError("classes must be a multiple of 4 and leave room for frequent words")
    stages = Stages(docs.sparkSession)
    texts = docs.select(text)
    words = stages.keep(map_arrow(texts, _count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    frequent = [bytes(r.word) for r in words.orderBy(F.col("n").desc(), "word").limit(kinds - classes - 1).collect()]
    windows = map_arrow(texts, partial(_count_windows, frequent=frequent, kinds=kinds, classes=classes), "window long, n long")
    windows = stages.keep(windows.groupBy("window").agg(F.sum("n").alias("n")), "windows")
    # At most kinds ** 3 rows, so one task holds them; the driver gets the finished table of 4 * kinds ** 3 bytes.
    table = map_arrow(windows.repartition(1), partial(_train, kinds=kinds), "log_probabilities binary").first()
    sizes = np.zeros(kinds, np.int64)
    for r in windows.groupBy(F.pmod("window", F.lit(kinds)).cast("int").alias("kind")).agg(F.sum("n").alias("n")).collect():
        sizes[r.kind] = r.n
    stages.drop("windows")
    held = {bytes(r.word): math.log(r.n) for r in words.where(F.col("n") * HELD_PART > int(sizes.sum())).collect()}
    table = np.frombuffer(bytes(table[0]), np.float32) if table else train(np.zeros((kinds,) * 3)).log_probabilities().astype(np.float32).ravel()
    return Fitted(LanguageModel(frequent, kinds, classes, table, sizes, held), words)


def _score(batches: Iterator[pa.RecordBatch], model, words: bool) -> Iterator[pa.RecordBatch]:
    """Sums over the kinds; with ``words``, also over the shares of words in their kinds, but for the log counts of the words in ``rest``."""
    own = model.value
    known = Kinds(own.frequent, own.kinds, own.classes)
    first, log_sizes = own.kinds - own.classes, np.log(own.sizes + 1.0)
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        n, sums, rests = [], [], []
        for text in utf8(batch.column(1)):
            split = words_of(text) if text else []
            windows = known.windows(split) if split else np.zeros(0, np.int64)
            n.append(len(split))
            total, rest = float(own.table[windows].sum(dtype=np.float64)), Counter()
            if words and split:
                kinds = windows % own.kinds
                classed = np.flatnonzero(kinds >= first)
                total -= float(log_sizes[kinds[classed]].sum())
                rest.update(split[i] for i in classed.tolist())
                common = [w for w in rest if w in own.held]
                total += math.fsum(rest.pop(w) * own.held[w] for w in common)
            sums.append(total)
            rests.append(list(rest.items()))
        columns = [pa.array(np.arange(row, row + len(n))), batch.column(0), pa.array(n, pa.int64()), pa.array(sums, pa.float64()), pa.array(rests, pa.map_(pa.binary(), pa.int64()))]
        row += len(n)
        yield pa.RecordBatch.from_arrays(columns, ["row", "id", "n_tokens", "log_likelihood", "rest"])


def score(docs: DataFrame, fitted: Fitted, *, key: str = "doc_id", text: str = "text", words: bool = False) -> DataFrame:
    """(key, n_tokens, log_likelihood, per_token) for every row.

    ``log_likelihood`` sums log P(kind | kinds left and right) over all tokens of the whole text,
    edges standing in beyond its ends; there is no shuffle. With ``words`` it sums log P(token | kinds left and right):
    log P(word | kind) is added, where a frequent word is all of its kind and another word has n of
    N + 1 in its class of N tokens. Words that the corpus lacks share the last one. Log counts of
    words too rare to travel are joined from the table of all words. Runs a job then: rows
    are staged. Null text, empty text and white space: no tokens, 0 and null per token.
    """
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(fitted.model)  # kinds ** 3 floats, 8 MB by default, and fewer than HELD_PART words
    scored = map_arrow(docs.select(key, text), partial(_score, model=shared, words=words), f"row long, id {kind}, n_tokens long, log_likelihood double, rest map<binary, long>")
    total = F.col("log_likelihood")
    if words:
        scored = Stages(docs.sparkSession).keep(scored, "scored")
        # A word that occurs once has a log count of zero.
        log_counts = fitted.words.where("n > 1").select("word", F.round(F.log("n") * UNIT).cast("long").alias("log_count"))
        rest = scored.select("row", F.explode("rest").alias("word", "times")).join(log_counts, "word")
        rest = rest.groupBy("row").agg(F.sum(F.col("times") * F.col("log_count")).alias("added"))
        scored = scored.drop("rest").join(rest, "row", "left")
        total = total + F.coalesce(F.col("added"), F.lit(0)) / UNIT
    scored = scored.select("id", "n_tokens", total.alias("sum"))
    rounded = F.round("sum", 4)
    return scored.select(F.col("id").alias(key), "n_tokens", rounded.alias("log_likelihood"), F.when(F.col("n_tokens") > 0, F.round(F.col("sum") / F.col("n_tokens"), 6)).alias("per_token"))
