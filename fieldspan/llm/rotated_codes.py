"""Near-duplicate embeddings: binary codes of randomly rotated vectors estimate cosines, bounds decide which are recomputed."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspan.llm.common import BROADCAST_IDS, Stages, map_arrow, scramble
from fieldspan.llm.components import components

#: Chance that a pair exactly at the limit shares no bucket; above the limit it is smaller.
MISS = 1e-4
#: Standard errors between an estimate and the limit before a pair is left out: one link in two million is lost to them.
CONFIDENCE = 5.0
#: Bits of a quantised component of the vector that a code is compared with.
PLANES = 4
#: Rows of a block; a bucket with more is compared block by block, in as many tasks as pairs of blocks.
BLOCK_ROWS = 2_048
#: What moving a row into a bucket costs, in comparisons of two codes.
ROW_COST = 500
#: Signs that are kept to choose the buckets' number of bits, which is no larger.
MOST_BITS = 24
#: Rows and comparisons that a task is given.
TASK_ROWS, TASK_PAIRS = 50_000, 200_000_000
#: Rows of a block that are compared with the other block at once.
STRIPE = 256


def rotation(dims: int, seed: int) -> np.ndarray:
    """Orthonormal columns that turn a vector, padded to a multiple of 64, into a random direction."""
    width = 64 * max(1, -(-dims // 64))
    return np.linalg.qr(np.random.default_rng([seed, dims]).normal(size=(width, width)))[0][:, :dims]


def _hyperplanes(dims: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dims, 1]).normal(size=(count, dims))


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that squares neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _packed(bits: np.ndarray) -> np.ndarray:
    """Words of 64 bits, one row for each row of a boolean matrix whose width is a multiple of 64."""
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def encode(vectors: np.ndarray, numbers: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, factors) of vectors of length one.

    A code is the signs of the turned vector; its words come first, then those of the
    bit planes of the turned vector quantised to four bits. Rounding is random, so that it is right
    on average, and drawn from the row's number, so that a task that runs again draws the same.
    Factors: inner product of code and vector, least value, step, sum of the levels.
    """
    turned = vectors @ rotation(vectors.shape[1], seed).T
    width = turned.shape[1]
    agreement = np.abs(turned).sum(axis=1) / math.sqrt(width)
    least = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - least) / ((1 << PLANES) - 1), 1e-300)
    place = numbers.astype(np.uint64)[:, None] * np.uint64(width) + np.arange(width, dtype=np.uint64)
    draw = (scramble(place + np.uint64(seed)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    levels = np.clip(np.floor((turned - least[:, None]) / step[:, None] + draw), 0, (1 << PLANES) - 1).astype(np.uint8)
    words = np.concatenate([_packed(turned > 0)] + [_packed((levels >> p) & 1 == 1) for p in range(PLANES)], axis=1)
    return words, np.stack([agreement, least, step, levels.sum(axis=1, dtype=np.int64)], axis=1)


def estimate(words_a: np.ndarray, factors_a: np.ndarray, words_b: np.ndarray, factors_b: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """(cosines, errors) for all rows of a against all of b: unbiased estimates, and how far below the limit one of a pair at the limit may lie.

    The signs of a, divided by their agreement with a, estimate the product with any
    vector. What they add to it is the part of b across a in one direction, which for a random
    rotation is a 1/sqrt(width - 1) share; at the limit that part is sqrt(1 - limit ** 2) long. The
    error cannot be larger than the whole part. Quantising b adds half a step of deviation.
    """
    per = words_a.shape[1] // (1 + PLANES)
    width = 64 * per
    inner = np.zeros((len(words_a), len(words_b)), np.int32)
    for p in range(PLANES):
        for w in range(per):
            both = words_a[:, w, None] & words_b[None, :, (1 + p) * per + w]
            inner += np.bitwise_count(both).astype(np.int32) << p
    ones = np.bitwise_count(words_a[:, :per]).sum(axis=1, dtype=np.int64)
    agreement = factors_a[:, 0, None]
    least, step, levels = factors_b[:, 1], factors_b[:, 2], factors_b[:, 3]
    product = (2 * step * inner + 2 * least * ones[:, None] - step * levels - width * least) / math.sqrt(width)
    across = np.sqrt(np.maximum(1 - agreement**2, 0)) * math.sqrt(1 - limit**2)
    error = np.hypot(across * min(1.0, CONFIDENCE / math.sqrt(width - 1)), CONFIDENCE * step / 2)
    return product / agreement, error / agreement


def tables_of(bits: int, limit: float, miss: float = MISS) -> int:
    """Tables of buckets with which a pair at the limit shares a bucket but for a chance of ``miss``."""
    same = (1 - math.acos(limit) / math.pi) ** bits
    return math.ceil(math.log(miss) / math.log(1 - same))


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) of every length in an array column without nulls, in double precision."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for size in np.unique(sizes):
        places = np.flatnonzero(sizes == size)
        yield places, values[offsets[places][:, None] + np.arange(size)].astype(np.float64) + 0.0


def _sign(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """Digest of every vector that takes part, and its first signs."""
    for batch in batches:
        row, ident, vector = batch.columns
        digests, signs = [None] * len(row), np.zeros(len(row), np.int32)
        usable = np.flatnonzero(vector.is_valid().to_numpy(zero_copy_only=False))
        for places, vectors in _matrices(vector.drop_null()) if len(usable) else ():
            if not vectors.shape[1]:
                continue
            full = np.flatnonzero((vectors != 0).any(axis=1))
            for p, v in zip(usable[places[full]], vectors[full]):
                digests[p] = xxhash.xxh3_128_digest(v)
            if len(full):
                above = units(vectors[full]) @ _hyperplanes(vectors.shape[1], MOST_BITS, seed).T > 0
                signs[usable[places[full]]] = above @ (1 << np.arange(MOST_BITS)[::-1])
        yield pa.RecordBatch.from_arrays([row, ident, pa.array(digests, pa.binary()), pa.array(signs), vector], ["row", "id", "digest", "signs", "v"])


def _code(batches: Iterator[pa.RecordBatch], seed: int, tables: int, bits: int) -> Iterator[pa.RecordBatch]:
    kind = np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint32
    for batch in batches:
        row, copies, vector = batch.columns
        numbers = row.to_numpy()
        for places, vectors in _matrices(vector):
            unit = units(vectors)
            words, factors = encode(unit, numbers[places], seed)
            above = unit @ _hyperplanes(vectors.shape[1], tables * bits, seed + 1).T > 0
            keys = (above.reshape(len(unit), tables, bits) @ (1 << np.arange(bits))).astype(np.int32)
            at = pa.array(places)
            yield pa.RecordBatch.from_arrays(
                [
                    row.take(at),
                    copies.take(at),
                    pa.array(np.full(len(at), vectors.shape[1]), pa.int32()),
                    pa.array([w.tobytes() for w in words], pa.binary()),
                    pa.array([f.tobytes() for f in factors], pa.binary()),
                    pa.array([k.tobytes() for k in keys.astype(kind)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * tables, pa.int32()), pa.array(keys.ravel())),
                    vector.take(at),
                ],
                ["row", "copies", "dims", "words", "factors", "all_keys", "keys", "v"],
            )


def _merge(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of linked places; every place keeps pointing at its tree's smallest."""
    while True:
        at_a, at_b = roots[a], roots[b]
        apart = at_a != at_b
        if not apart.any():
            return
        np.minimum.at(roots, np.maximum(at_a[apart], at_b[apart]), np.minimum(at_a[apart], at_b[apart]))
        while not np.array_equal(roots[roots], roots):
            roots[:] = roots[roots]


class _Side:
    """A block of rows, in arrays."""

    def __init__(self, block: pa.Table, kind: type):
        column = {name: block.column(name).combine_chunks() for name in ("row", "copies", "words", "factors", "all_keys", "v")}
        self.rows, self.copies = column["row"].to_numpy(), column["copies"].to_numpy()
        self.words, self.factors, self.keys = (
            np.frombuffer(b"".join(column[name].to_pylist()), t).reshape(len(self.rows), -1)
            for name, t in (("words", np.uint64), ("factors", np.float64), ("all_keys", kind))
        )
        self.unit = units(next(_matrices(column["v"]))[1])


def _compare(a: _Side, b: _Side, same: bool, table: int, limit: float) -> pa.RecordBatch | None:
    """Links of a block with another, or with itself, that no earlier table found.

    For each row the rows it is linked with, counted with their copies, and for each row of a
    tree of links the tree's smallest, so no group of copies is listed pair by pair.
    """
    n = len(a.rows)
    roots = np.arange(n if same else n + len(b.rows))
    links_a, links_b = np.zeros(n, np.int64), np.zeros(len(b.rows), np.int64)
    for start in range(0, n, STRIPE):
        stripe = slice(start, min(n, start + STRIPE))
        cosines, errors = estimate(a.words[stripe], a.factors[stripe], b.words, b.factors, limit)
        open_ = cosines >= limit - errors
        if same:
            open_ &= np.arange(stripe.start, stripe.stop)[:, None] < np.arange(len(b.rows))
        if not open_.any():
            continue
        # Exactly, in double precision: all rows that have an open pair at all.
        of_a, of_b = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
        exact = a.unit[stripe][of_a] @ b.unit[of_b].T
        left, right = np.nonzero(open_[np.ix_(of_a, of_b)] & (exact >= limit))
        left, right = of_a[left] + start, of_b[right]
        known = np.zeros(len(left), bool)
        for t in range(table):
            known |= a.keys[left, t] == b.keys[right, t]
        left, right = left[~known], right[~known]
        np.add.at(links_a, left, b.copies[right])
        np.add.at(links_b, right, a.copies[left])
        _merge(roots, left, right if same else right + n)
    rows, links = (a.rows, links_a + links_b) if same else (np.concatenate((a.rows, b.rows)), np.concatenate((links_a, links_b)))
    found = np.flatnonzero(links)
    if not len(found):
        return None
    root = rows[roots[found]]
    columns = [pa.array(rows[found]), pa.array(root, mask=root == rows[found]), pa.array(links[found])]
    return pa.RecordBatch.from_arrays(columns, ["a", "b", "links"])


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Neighbouring rows with equal keys, whatever batches they came in."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for start, end in zip([0, *changes], [*changes, len(batch)]):
            key = tuple(c[start] for c in columns)
            if held and key != now:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            now = key
    if held:
        yield pa.Table.from_batches(held)


_PLACE = ["tab", "bucket", "dims", "i", "j"]


def _search(batches: Iterator[pa.RecordBatch], limit: float, bits: int) -> Iterator[pa.RecordBatch]:
    kind = np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint32
    for run in _runs(batches, _PLACE):
        i, j, table = (run.column(c)[0].as_py() for c in ("i", "j", "tab"))
        part = run.column("part").to_numpy()
        a = _Side(run.filter(pa.array(part == i)), kind) if (part == i).any() else None
        b = a if i == j else _Side(run.filter(pa.array(part == j)), kind) if (part == j).any() else None
        found = _compare(a, b, i == j, table, limit) if a and b else None
        if found is not None:
            yield found


def _best_bits(classes: DataFrame, n: int, limit: float) -> tuple[int, int, int]:
    """(bits, tables, comparisons) for which rows in buckets and comparisons inside them cost the least.

    Counted on the classes themselves, by the leading signs of every one, so vectors that crowd
    together get more bits than as many that are spread out.
    """
    prefixes = classes.select(F.explode(F.array([F.struct(F.lit(k).alias("k"), F.expr(f"signs >> {MOST_BITS - k}").alias("p")) for k in range(2, MOST_BITS + 1, 2)])).alias("x"))
    counted = prefixes.groupBy("x.k", "x.p").agg(F.count(F.lit(1)).alias("c"))
    squares = {r.k: int(r.s) for r in counted.groupBy("k").agg(F.sum(F.col("c").cast("decimal(38,0)") * F.col("c")).alias("s")).collect()}
    _, bits = min((tables_of(k, limit) * (ROW_COST * n + s / 2), k) for k, s in squares.items())
    tables = tables_of(bits, limit)
    return bits, tables, tables * squares[bits] // 2


def near_duplicates(
    vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", limit: float = 0.95, block_rows: int = BLOCK_ROWS, bits: int | None = None, seed: int = 13
) -> DataFrame:
    """(key, n_links, component_id, kept): one row for every row of ``vectors``.

    Two rows are linked if the cosine of their vectors, in double precision, is at least
    ``limit``. ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest key that
    links reach, ``kept`` says that it is the row's own.

    Equal vectors are one class, found by a digest, and count with their number. A class is
    turned by one random rotation; its signs are its code, stored with the code's agreement and with
    the turned vector in four bits. Classes meet in buckets of signs under further random hyperplanes: as
    many tables as leave a pair at the limit unmet with a chance of 1e-4, with the number of
    bits that costs least on these rows. In a bucket, popcounts of code and bit planes give an unbiased
    estimate of every cosine; only if its bound reaches the limit is the cosine computed. A pair
    counts in the first table that joins it, since every row carries its keys of all tables, and links
    leave a task as counts and trees, never as the pairs of a group. A bucket of more than
    ``block_rows`` is split, each pair of blocks a task of its own, so no bucket has to fit anywhere. All
    that crowd in one bucket are compared with each other: for n different vectors that are all alike
    that is n * n / 2 estimates, spread over tasks.

    No links for vectors that are null, empty, zero or hold null or non-finite components, and none between
    different lengths. Rows repeating a key each take part with their own vector and get its result; a
    row without a key takes no part, and has null as component. Runs jobs when called; intermediate tables go to the shared folder.
    """
    spark = vectors.sparkSession
    stages = Stages(spark)
    known = vectors.schema[vector].dataType
    single = isinstance(known, T.ArrayType) and isinstance(known.elementType, T.FloatType)
    v = F.col(vector) if single else F.col(vector).cast("array<double>")
    fine = F.col(key).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    numbered = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.when(fine, v).alias("v"))
    kind = "float" if single else "double"
    signed = stages.keep(map_arrow(numbered, partial(_sign, seed=seed), f"row long, id long, digest binary, signs int, v array<{kind}>"), "signed")

    alike = signed.where("digest is not null").groupBy("digest")
    classes = stages.keep(alike.agg(F.min("row").alias("class"), F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("signs").alias("signs")), "classes")
    n = classes.count()
    links, labels = None, None
    if n > 1:
        best, tables, pairs = _best_bits(classes, n, limit)
        if bits is not None:
            best, tables = bits, tables_of(bits, limit)
        of_class = signed.select("row", "v").join(classes.select(F.col("class").alias("row"), "copies"), "row").select("row", "copies", "v")
        schema = f"row long, copies long, dims int, words binary, factors binary, all_keys binary, keys array<int>, v array<{kind}>"
        coded = stages.keep(map_arrow(of_class, partial(_code, seed=seed, tables=tables, bits=best), schema), "coded")

        placed = coded.select("row", "dims", F.posexplode("keys").alias("tab", "bucket"))
        crowded = placed.groupBy("tab", "bucket", "dims").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block_rows)
        crowded = stages.keep(crowded.select("tab", "bucket", "dims", F.ceil(F.col("size") / block_rows).cast("int").alias("parts")), "crowded")
        few = crowded.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        entries = coded.select("*", F.posexplode("keys").alias("tab", "bucket")).drop("keys")
        entries = entries.join(F.broadcast(crowded) if few else crowded, ["tab", "bucket", "dims"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        entries = entries.withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
        entries = entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        entries = entries.select("*", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).drop("other", "parts")
        tasks = 1 + max(n * tables // TASK_ROWS, pairs // TASK_PAIRS)
        dealt = entries.repartition(tasks, *_PLACE).sortWithinPartitions(*_PLACE)
        found = stages.keep(map_arrow(dealt, partial(_search, limit=limit, bits=best), "a long, b long, links long"), "found")
        links = found.groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
        labels = components(found.where("b is not null").select("a", "b"), stages)
        stages.drop("coded", "crowded")

    own = classes.select("digest", "class", "rep", "copies")
    if links is not None:
        own = own.join(links, "class", "left")
    else:
        own = own.withColumn("links", F.lit(0).cast("long"))
    if labels is not None:
        reach = labels.join(classes.select(F.col("class").alias("node"), "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
        named = labels.join(reach, "component").select(F.col("node").alias("class"), "least")
        own = own.join(named, "class", "left")
    else:
        own = own.withColumn("least", F.lit(None).cast("long"))
    own = own.select("digest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("reached"))
    placed = signed.select("id", "digest").join(own, "digest", "left")
    component = F.coalesce("reached", "id")
    return placed.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept")
    )


def drop_near_duplicates(vectors: DataFrame, *, key: str = "vec_id", **options) -> DataFrame:
    """The rows of ``vectors`` that stand for their group, all columns kept; rows without a key stay."""
    found = near_duplicates(vectors, key=key, **options).where(~F.col("kept") & F.col(key).isNotNull()).select(key).distinct()
    gone = Stages(vectors.sparkSession).keep(found, "gone")
    return vectors.join(gone, key, "left_anti")
