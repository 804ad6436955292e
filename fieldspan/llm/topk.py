"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from fieldspan.llm.common import Stages
from fieldspan.session import let_workers_import

#: Vectors of a block that one task holds, with its sorted lists.
BLOCK_ROWS = 16_384
#: Queries of a block.
QUERY_ROWS = 4_096
#: Entries of each list that are read before the bound is tested again; doubles from step to step.
FIRST_STEP = 32
#: The bounds of a long.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class Query(NamedTuple):
    id: int
    vector: np.ndarray


def search(query: Query, ids: np.ndarray, vectors: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best rows but the query's own, best first, ties to the smaller id.

    ``order[d]`` lists the rows by their component d, ascending. Lists are read from the
    end that the query's sign makes the better one, all to the same depth. No row that is
    still unseen can score more than the query against the components at that depth; once
    the kth score is greater, and not merely equal, nothing unseen can enter.
    """
    n = len(ids)
    used = np.flatnonzero(query.vector)
    falls = query.vector[used] > 0
    seen = np.zeros(n, bool)
    if not len(used):
        seen[:] = True  # every score is zero
    scores = np.full(n, np.iinfo(np.int64).min)
    scores[seen] = 0
    depth, step = 0, FIRST_STEP
    own = ids == query.id
    while depth < n and len(used):
        end = min(n, depth + step)
        read = np.concatenate((order[used[falls], n - end : n - depth].ravel(), order[used[~falls], depth:end].ravel()))
        fresh = np.zeros(n, bool)
        fresh[read] = True
        fresh &= ~seen
        scores[fresh] = (vectors[fresh] @ query.vector).astype(np.int64)
        seen |= fresh
        depth, step = end, 2 * step
        at = np.where(falls, order[used, n - depth], order[used, depth - 1])
        bound = int(vectors[at, used] @ query.vector[used])
        entered = np.flatnonzero(seen & ~own)
        if len(entered) == np.count_nonzero(~own):
            break
        if len(entered) >= k and np.partition(scores[entered], len(entered) - k)[len(entered) - k] > bound:
            break
    entered = np.flatnonzero(seen & ~own)
    if len(entered) > 4 * k:
        cut = np.partition(scores[entered], len(entered) - k)[len(entered) - k]
        entered = entered[scores[entered] >= cut]
    best = entered[np.lexsort((ids[entered], -scores[entered]))][:k]
    return ids[best], scores[best]


def _matrix(column: pa.Array) -> list[np.ndarray]:
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[s:e] for s, e in zip(offsets[:-1], offsets[1:])]


def _exact(vectors: np.ndarray, queries: list[Query]) -> type:
    """float64 while every partial sum is an exact integer, else int64."""
    widest = max((float(np.abs(q.vector).max(initial=0)) for q in queries), default=0.0)
    return np.float64 if widest * float(np.abs(vectors).max(initial=0)) * vectors.shape[1] < 2**52 else np.int64


def _integers(vector: np.ndarray) -> np.ndarray:
    """Whole floats as Python integers, which have no bound."""
    return np.array([int(x) for x in vector], object)


def search_wide(query: np.ndarray, own: int, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The same as ``search`` by comparing with every row, in Python integers."""
    wanted, whole = np.flatnonzero(ids != own), _integers(query)
    scored = ((int(ids[i]), sum((a * b for a, b in zip(whole, _integers(vectors[i]))), 0)) for i in wanted)
    return sorted(scored, key=lambda x: (-x[1], x[0]))[:k]


def _found(query_id: int, ids: list | np.ndarray, scores: list | np.ndarray) -> pa.RecordBatch:
    """Scores beyond a long are held at its bound, with the side on which they lie."""
    beyond = [(int(s) > MOST) - (int(s) < LEAST) for s in scores]
    held = [min(max(int(s), LEAST), MOST) for s in scores]
    columns = [pa.array(np.full(len(ids), query_id), pa.int64()), pa.array(ids, pa.int64()), pa.array(held, pa.int64()), pa.array(beyond, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score", "beyond"])


_BEST = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.int32())])


def _search_block(rows: pa.Table, asking: pa.Table, k: int) -> pa.Table:
    """The k best of a block of vectors for each of a block of queries of the same length."""
    all_ids, vectors_of = rows.column("id").to_numpy(), _matrix(rows.column("v").combine_chunks())
    queries = [Query(i, v) for i, v in zip(asking.column("id").to_pylist(), _matrix(asking.column("v").combine_chunks()))]
    return pa.Table.from_batches(list(_searched(all_ids, vectors_of, queries, k)), _BEST)


def _searched(all_ids: np.ndarray, rows: list[np.ndarray], queries: list[Query], k: int) -> Iterator[pa.RecordBatch]:
    sizes = np.array([len(r) for r in rows], np.int64)
    for size in np.unique(sizes):
        same = [q for q in queries if len(q.vector) == size]
        if not same:
            continue
        of_size = np.flatnonzero(sizes == size)
        own_ids, vectors = all_ids[of_size], np.array([rows[i] for i in of_size], np.float64).reshape(len(of_size), size)
        # The product of two vectors without a larger component fits in a long, and so does every part of its sum.
        edge = math.isqrt((1 << 62) // max(int(size), 1))
        wide_rows = np.abs(vectors).max(axis=1, initial=0) > edge
        wide_ids, wide_vectors = own_ids[wide_rows], vectors[wide_rows]
        narrow_ids, narrow = own_ids[~wide_rows], vectors[~wide_rows]
        quick = [q for q in same if np.abs(q.vector).max(initial=0) <= edge]
        kind = _exact(narrow, quick)
        lists = narrow.astype(kind)
        order = np.argsort(lists, axis=0, kind="stable").T.copy()
        for query in same:
            if np.abs(query.vector).max(initial=0) > edge:
                best = search_wide(query.vector, query.id, own_ids, vectors, k)
            else:
                if len(narrow_ids):
                    yield _found(query.id, *search(Query(query.id, query.vector.astype(kind)), narrow_ids, lists, order, k))
                best = search_wide(query.vector, query.id, wide_ids, wide_vectors, k) if len(wide_ids) else []
            if best:
                yield _found(query.id, [i for i, _ in best], [x for _, x in best])


def whole_components(vector: str, scale: int = 1024) -> Column:
    """floor(scale * x) of every component as double, which holds it exactly; null for a null vector, null or non-finite components."""
    x = F.transform(vector, lambda v: v.cast("double") * scale)
    # From 2 ** 52 on every double is whole, and floor would stop at the largest long.
    x = F.transform(x, lambda v: F.when(F.abs(v) < float(1 << 52), F.floor(v).cast("double")).otherwise(v))
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return F.when(F.coalesce(fine, F.lit(False)), x)


def top_k(
    vectors: DataFrame, is_query: Column, *, k: int = 10, key: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that ``is_query`` marks its k best among all other rows.

    Vectors are dealt by a hash into blocks of about ``block_rows``, queries into blocks of about
    ``query_rows``, and each pair of blocks is one group of one plan, whatever the number of either. A group sorts its
    block's dimensions into lists and runs the threshold algorithm for each query; the k
    best of every block are merged. Nothing passes through the driver, and a task holds one block of each.

    Null ids, null vectors and those with null or non-finite components take no part. Products
    that may not fit in a long are compared in Python integers, row by row; a score beyond a long
    among the k best is an error, since the column cannot hold it. Vectors of another length than the query's are no candidates. Repeated ids:
    each row is a candidate, each distinct query row asks once and none of its id's rows
    answer. Empty vectors score zero. Runs jobs when called: writing and counting both sides.
    """
    spark = vectors.sparkSession
    stages = Stages(spark)
    usable = vectors.select(F.col(key).cast("long").alias("id"), whole_components(vector).alias("v"), is_query.alias("asks"))
    usable = stages.keep(usable.where("id is not null and v is not null"), "usable")
    asking = stages.keep(usable.where("asks").select("id", "v").distinct(), "asking")
    groups, blocks = 1 + asking.count() // query_rows, 1 + usable.count() // block_rows
    let_workers_import(spark)

    def dealt(rows: DataFrame, own: str, parts: int, other: str, others: int) -> GroupedData:
        """Rows with the number of their block, once for every block of the other side."""
        every = F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other)
        placed = rows.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int").alias(own), every)
        return placed.repartition(groups * blocks, "block", "asked").groupBy("block", "asked")

    pairs = dealt(usable, "block", blocks, "asked", groups).cogroup(dealt(asking, "asked", groups, "block", blocks))
    found = pairs.applyInArrow(lambda rows, asked: _search_block(rows, asked, k), "query_id long, vec_id long, score long, beyond int")
    place = Window.partitionBy("query_id").orderBy(F.col("beyond").desc(), F.col("score").desc(), "vec_id")
    score = F.when(F.col("beyond") == 0, F.col("score")).otherwise(F.raise_error(F.lit("a score among the k best does not fit in a long")).cast("long")).alias("score")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score)
