"""Words and pairs of words as features: term tables fitted on texts, weights, and the choice of terms by their F.

A term's id is a 63-bit hash, so a text becomes arrays of numbers in one pass and only
distinct terms move: a task sends each term it met once, with the number of its texts.
Terms of a table that share a hash are told apart by a short list of exceptions.
Texts are cut, hashed and counted a block at a time, in arrays: no term is a Python object.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldspan.functions import slices
from fieldspan.session import map_arrow, materialise

# Defaults of the published feature set-ups.
MIN_DF, TOP_K = 2, 5000
#: Terms whose ids and idf may travel to the tasks (64 MB); of a larger table the most frequent do, and the others are asked for.
BROADCAST_TERMS = 1 << 22
#: Terms of one group of those that are asked for, and the number of texts from which on terms are not told apart by it.
ASKED_TERMS, MOST_DF = 1 << 17, 1 << 16
#: Distinct terms that a task counts before it sends them on, and groups in which they are sent: at most 65536, a power of two.
HELD_TERMS, SENT_GROUPS = 250_000, 4096
#: Bytes of the texts that are cut into terms at once.
BLOCK_BYTES = 1 << 17
#: Bits of an id: all ids are positive, so that exceptions can be negative.
ID_BITS = 63

WORD = re.compile(r"\w\w+")
# Whether a byte is part of a word, in the bytes of a bare text.
_IN_WORD = np.array([c > 127 or WORD.fullmatch(2 * chr(c)) is not None for c in range(256)])
# Marks of the basic plane are one table for the engine; those above it would be tried range by range at every character.
_MARKS, _HIGH_MARKS = (
    re.compile("[" + "".join(c for c in map(chr, points) if unicodedata.combining(c)) + "]+") for points in (range(0x300, 0x10000), range(0x10000, 0x110000))
)


def bare_text(text: str) -> str:
    """Lower case, compatibility characters taken apart (ligatures and syllables too), accents left out."""
    text = text.lower()
    if text.isascii():
        return text
    text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return _HIGH_MARKS.sub("", text) if max(text) > "\uffff" else text


def terms_of(text: str | None) -> list[str]:
    """Words of two or more letters, digits or underscores, then pairs of neighbouring words."""
    words = WORD.findall(bare_text(text)) if text else []
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


class _Bare(dict):
    """What ``bare_text`` makes of a lower-case character, by its number: each is taken apart by itself, and the marks it
    leaves in another order drop. What is not part of a word is a blank."""

    def __missing__(self, point: int) -> str:
        parts = unicodedata.normalize("NFKD", chr(point))
        self[point] = "".join(c if WORD.fullmatch(2 * c) else " " for c in parts if not unicodedata.combining(c))
        return self[point]


_BARE = _Bare()
# The engine finds the runs of characters that are not ASCII; the others need nothing.
codecs.register_error("fieldspan-bare", lambda e: (e.object[e.start : e.end].translate(_BARE).encode(), e.end))


def bare_bytes(text: str | None) -> bytes:
    """``bare_text`` in UTF-8, where a byte above 127 is always part of a word."""
    return text.lower().encode("ascii", "fieldspan-bare") if text else b""


@dataclass(frozen=True)
class TermTable:
    """Terms of the texts it was fitted on: (term, id, df, idf), the number of texts, and ids that are not the hash."""

    table: DataFrame
    n_docs: int
    exceptions: dict[str, int] = field(default_factory=dict)
    id_bits: int = ID_BITS


class Known(NamedTuple):
    """What a task needs of a term table: sorted ids with their idf."""

    ids: np.ndarray
    idf: np.ndarray
    exceptions: dict[str, int]
    id_bits: int


class Counted(NamedTuple):
    """Distinct terms of each of a batch's texts, as they are met: words, then pairs.

    A term is a slice of ``data``, where a blank follows every word of two or more characters.
    """

    data: np.ndarray
    row: np.ndarray
    hashes: np.ndarray
    tfs: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    def terms(self, chosen: np.ndarray | slice = slice(None)) -> list[str]:
        return [self.data[a : a + n].tobytes().decode() for a, n in zip(self.starts[chosen].tolist(), self.lengths[chosen].tolist())]


def _joined(parts: list[Counted]) -> Counted:
    """Several blocks as one; their rows are already those of the whole."""
    if len(parts) == 1:
        return parts[0]
    shift = np.cumsum([0, *(len(p.data) for p in parts)])
    starts = [p.starts + at for p, at in zip(parts, shift.tolist())]
    data, row, hashes, tfs, _, lengths = (np.concatenate(x) for x in zip(*parts))
    return Counted(data, row, hashes, tfs, np.concatenate(starts), lengths)


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, lengths, words of each text): the words with a blank after each, one text after the other."""
    data = np.frombuffer(b" ".join([b"", *texts, bytes(slices.PAD)]), np.uint8)
    begin = np.cumsum([1, *(len(t) + 1 for t in texts)])
    inside = _IN_WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    sizes = ends - starts
    if not data.max() < 128:
        # All but the first byte of a character are between 128 and 191.
        characters = np.cumsum((data & 0xC0) != 0x80)
        sizes = characters[ends - 1] - characters[starts] + 1
    words = sizes > 1
    starts, ends = starts[words], ends[words]
    n = np.diff(np.searchsorted(starts, begin))
    marks = np.zeros(len(data) + 1, np.int8)
    marks[starts] += 1
    marks[ends + 1] -= 1
    kept = data[np.cumsum(marks[:-1], dtype=np.int8).view(bool)]
    lengths = ends - starts
    after = np.cumsum(lengths + 1)
    kept[after - 1] = 32
    return np.concatenate((kept, np.zeros(slices.PAD, np.uint8))), after - lengths - 1, lengths, n


def _same_terms(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, order: np.ndarray, repeats: np.ndarray) -> bool:
    """Whether all that are marked as repeats, in an order, are the same term as the one before them."""
    at = np.flatnonzero(repeats)
    one, other = order[at], order[at - 1]
    return bool((lengths[one] == lengths[other]).all()) and slices.equal(data, starts[one], starts[other], lengths[one])


def _counted_block(texts: list[bytes], first: int) -> Counted:
    data, word_starts, word_lengths, n = _words(texts)
    pairs = np.maximum(n - 1, 0)
    ends = np.cumsum(n + pairs)
    row, word_row = np.repeat(np.arange(len(texts)), n + pairs), np.repeat(np.arange(len(texts)), n)
    # Place of a text's first word among all terms, less its place among all words; pairs follow the words.
    word_at = np.arange(len(word_row)) + (ends - n - pairs - np.cumsum(n) + n)[word_row]
    left = np.flatnonzero(word_row[1:] == word_row[:-1])
    pair_at = word_at[left] + n[word_row[left]]
    starts, lengths = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
    starts[word_at], lengths[word_at] = word_starts, word_lengths
    starts[pair_at], lengths[pair_at] = word_starts[left], word_lengths[left] + 1 + word_lengths[left + 1]
    hashes = slices.xxh64(data, starts, lengths)
    order = np.empty(len(row), np.int64)
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
        order[a:b] = np.argsort(hashes[a:b])
        order[a:b] += a
    ordered = hashes[order]
    repeats = np.zeros(len(row), bool)
    repeats[1:] = (ordered[1:] == ordered[:-1]) & (row[1:] == row[:-1])
    if not _same_terms(data, starts, lengths, order, repeats):
        return _counted_one_by_one(data, starts, lengths, hashes, row + first)
    begin = np.flatnonzero(~repeats)
    met = np.minimum.reduceat(order, begin) if len(begin) else order
    tfs = np.zeros(len(row), np.int64)
    tfs[met] = np.diff(np.append(begin, len(row)))
    kept = tfs > 0
    return Counted(data, row[kept] + first, hashes[kept], tfs[kept], starts[kept], lengths[kept])


def _counted_one_by_one(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, row: np.ndarray) -> Counted:
    """The same where different terms of a text share all bits of their hash."""
    keys = [*zip(row.tolist(), Counted(data, row, hashes, row, starts, lengths).terms())]
    met: dict[tuple[int, str], int] = {}
    for n, key in enumerate(keys):
        met.setdefault(key, n)
    kept, tfs = np.array([*met.values()]), np.array([*Counter(keys).values()])
    return Counted(data, row[kept], hashes[kept], tfs, starts[kept], lengths[kept])


def count_batch(texts: pa.Array) -> tuple[Counted, np.ndarray]:
    """Counted terms of every text, and where each text's terms end among all. Texts that are bytes are bare already."""
    parts, block, size, first = [], [], 0, 0
    for text in map(bare_bytes, texts.to_pylist()) if pa.types.is_string(texts.type) else texts.to_pylist():
        block.append(text)
        size += len(text)
        if size >= BLOCK_BYTES:
            parts.append(_counted_block(block, first))
            block, size, first = [], 0, first + len(block)
    if block or not parts:
        parts.append(_counted_block(block, first))
    counted = _joined(parts)
    return counted, np.cumsum([0, *np.bincount(counted.row, minlength=len(texts))])


class _Sums(NamedTuple):
    """Distinct terms with the number of their texts."""

    data: np.ndarray
    hashes: np.ndarray
    dfs: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray


def _summed(parts: list[_Sums]) -> _Sums:
    """Every term once, by rising hash; terms that share a hash stay apart."""
    shift = np.cumsum([0, *(len(p.data) for p in parts)]).tolist()
    starts = np.concatenate([p.starts + at for p, at in zip(parts, shift)])
    data, hashes, dfs, lengths = (np.concatenate(x) for x in ([getattr(p, name) for p in parts] for name in ("data", "hashes", "dfs", "lengths")))
    order = np.argsort(hashes)
    ordered = hashes[order]
    repeats = np.zeros(len(order), bool)
    repeats[1:] = ordered[1:] == ordered[:-1]
    if not _same_terms(data, starts, lengths, order, repeats):
        terms = [data[a : a + n].tobytes() for a, n in zip(starts.tolist(), lengths.tolist())]
        order = np.array(sorted(range(len(terms)), key=lambda i: (hashes[i], terms[i])))
        ordered = hashes[order]
        repeats[1:] = [terms[i] == terms[j] for i, j in zip(order[1:], order)]
    begin = np.flatnonzero(~repeats)
    kept = order[begin]
    dfs = np.add.reduceat(dfs[order], begin) if len(begin) else dfs
    return _Sums(data, hashes[kept], dfs, starts[kept], lengths[kept])


def _compact(sums: _Sums) -> _Sums:
    """The same without the bytes between the terms."""
    ends = np.cumsum(sums.lengths)
    data = np.concatenate((slices.joined(sums.data, sums.starts, sums.lengths), np.zeros(slices.PAD, np.uint8)))
    return sums._replace(data=data, starts=ends - sums.lengths)


_SENT = "group int, texts long, dfs binary, lengths binary, data binary"


def _distinct_terms(batches: Iterator[pa.RecordBatch], held: int, id_bits: int) -> Iterator[pa.RecordBatch]:
    """Every term once for as many texts as can be held, in one row of arrays for each group of ids; the first row has the number of texts."""

    def sent(parts: list[_Sums], texts: int) -> pa.RecordBatch:
        sums = _summed(parts) if len(parts) > 1 else parts[0]
        group = (sums.hashes & np.uint64(min((1 << id_bits) - 1, SENT_GROUPS - 1))).astype(np.uint16)
        order = np.argsort(group, kind="stable")
        begin = np.flatnonzero(np.diff(group[order], prepend=-1)) if len(group) else np.zeros(1, np.int64)
        ends = np.append(begin, len(group))
        lengths = sums.lengths[order]
        data = slices.joined(sums.data, sums.starts[order], lengths)
        at = np.concatenate(([0], np.cumsum(lengths)))[ends]
        numbers = [np.ascontiguousarray(x[order], kind) for x, kind in ((sums.dfs, "<u4"), (sums.lengths, "<u4"))]
        lists = [pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(e.astype(np.int32)), pa.py_buffer(x)]) for e, x in (*((x.itemsize * ends, x) for x in numbers), (at, data))]
        groups = pa.array(group[order][begin].astype(np.int32) if len(group) else np.zeros(1, np.int32))
        count = pa.array([texts, *[0] * (len(begin) - 1)], pa.int64())
        return pa.RecordBatch.from_arrays([groups, count, *lists], ["group", "texts", "dfs", "lengths", "data"])

    nothing = _Sums(np.zeros(slices.PAD, np.uint8), np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)))
    parts, texts, waiting = [], 0, 0
    for batch in batches:
        counted, _ = count_batch(batch.column(0))
        parts.append(_summed([_Sums(counted.data, counted.hashes, np.ones(len(counted.row), np.int64), counted.starts, counted.lengths)]))
        texts += len(batch)
        waiting += len(parts[-1].hashes)
        if waiting >= held:
            parts = [_summed(parts)] if len(parts) > 1 else parts
            if 2 * len(parts[0].hashes) < held:
                parts = [_compact(parts[0])]
                waiting = len(parts[0].hashes)
                continue
            yield sent(parts, texts)
            parts, texts, waiting = [], 0, 0
    yield sent(parts or [nothing], texts)


def _added_up(batches: Iterator[pa.RecordBatch], min_df: int, held: int, id_bits: int) -> Iterator[pa.RecordBatch]:
    """(term, id, df, shared) of the sent rows of whole groups, by group; the null term counts all texts."""
    names = ["term", "id", "df", "shared"]

    def added(rows: pa.RecordBatch | pa.Table) -> pa.RecordBatch:
        dfs, lengths = (np.frombuffer(b"".join(rows.column(c).to_pylist()), "<u4").astype(np.int64) for c in ("dfs", "lengths"))
        data = np.frombuffer(b"".join([*rows.column("data").to_pylist(), bytes(slices.PAD)]), np.uint8)
        starts = np.cumsum(lengths) - lengths
        sums = _summed([_Sums(data, slices.xxh64(data, starts, lengths), dfs, starts, lengths)])
        often = sums.dfs >= min_df
        sums = _compact(_Sums(sums.data, *(x[often] for x in sums[1:])))
        ids = (sums.hashes & np.uint64((1 << id_bits) - 1)).astype(np.int64)
        _, place, n = np.unique(ids, return_inverse=True, return_counts=True)
        ends = np.append(sums.starts, len(sums.data) - slices.PAD)
        terms = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(ends), pa.py_buffer(sums.data)).cast(pa.string())
        return pa.RecordBatch.from_arrays([terms, pa.array(ids), pa.array(sums.dfs), pa.array(n[place] > 1)], names)

    waiting, size, texts = [], 0, 0
    for batch in chain(batches, [None]):
        if batch is not None:
            texts += int(np.sum(batch.column("texts").to_numpy()))
            waiting.append(batch)
            size += batch.column("dfs").nbytes // 4
            if size < held:
                continue
        if not waiting:
            continue
        rows = pa.Table.from_batches(waiting)
        group = rows.column("group").to_numpy()
        # The last group may go on in the next batch.
        whole = len(group) if batch is None else int(np.searchsorted(group, group[-1]))
        waiting, size = [], 0
        if whole < len(group):
            waiting = rows.slice(whole).to_batches()
            size = sum(b.column("dfs").nbytes for b in waiting) // 4
        if whole:
            yield added(rows.slice(0, whole))
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([None], pa.int64()), pa.array([texts]), pa.array([False])], names)


def fit_terms(train: DataFrame, text: str = "text", min_df: int = MIN_DF, id_bits: int = ID_BITS, held: int = HELD_TERMS) -> TermTable:
    """Terms found in at least ``min_df`` of the texts; idf = ln((1 + n) / (1 + df)) + 1.

    One pass over the texts and one shuffle, of distinct terms, in arrays. Null and empty texts have no terms and count as
    texts. Of terms that share an id all but the first become exceptions: with 63 bits
    a table of a million terms has one with a chance of 1e-7. Runs when called; the table is staged.
    """
    sent = map_arrow(train.select(text), partial(_distinct_terms, held=held, id_bits=id_bits), _SENT)
    by_group = sent.repartition("group").sortWithinPartitions("group")
    counted = materialise(map_arrow(by_group, partial(_added_up, min_df=min_df, held=held, id_bits=id_bits), "term string, id long, df long, shared boolean"))
    n_docs, clash = counted.agg(F.coalesce(F.sum(F.when(F.col("term").isNull(), F.col("df"))), F.lit(0)), F.max("shared")).first()
    idf = F.log(F.lit(1.0 + n_docs) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    table = counted.where("term is not null").select("term", "id", "df", idf.alias("idf"))
    exceptions: dict[str, int] = {}
    if clash:
        shared = counted.where("shared")
        others = shared.join(shared.groupBy("id").agg(F.min("term").alias("first")), "id").where("term <> first").select("term").orderBy("term")
        exceptions = {r.term: -n for n, r in enumerate(others.collect(), 1)}
        ids = train.sparkSession.createDataFrame(list(exceptions.items()), "term string, own long")
        table = table.join(ids, "term", "left").withColumn("id", F.coalesce("own", "id")).drop("own")
        table = materialise(table)
    return TermTable(table, n_docs, exceptions, id_bits)


def _known(rows: DataFrame, terms: TermTable) -> Known:
    table = rows.select("id", "idf").toArrow()
    order = np.argsort(ids := table.column("id").to_numpy())
    return Known(ids[order], table.column("idf").to_numpy()[order], terms.exceptions, terms.id_bits)


def known_terms(spark: SparkSession, terms: TermTable, most: int = BROADCAST_TERMS) -> Known | None:
    """Ids and idf for the tasks, where a count shows that they fit; else None."""
    if terms.table.select("id").limit(most + 1).count() > most:
        return None
    return _known(terms.table, terms)


def frequent_terms(terms: TermTable, most: int) -> tuple[Known, DataFrame, int]:
    """At most ``most`` terms found in the most texts, for the tasks; the table of all others, and their number."""
    by_df = terms.table.groupBy(F.least("df", F.lit(MOST_DF)).alias("df")).agg(F.count(F.lit(1)).alias("n")).collect()
    cut, held = MOST_DF + 1, 0
    for df, n in sorted(map(tuple, by_df), reverse=True):
        if held + n > most:
            break
        cut, held = df, held + n
    often = F.least("df", F.lit(MOST_DF)) >= cut
    return _known(terms.table.where(often), terms), terms.table.where(~often).select("id", "idf"), sum(r.n for r in by_df) - held


def _numbers(counted: Counted, ends: np.ndarray, known: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, id, tf) of all terms."""
    mask = np.uint64((1 << known.id_bits) - 1)
    ids = (counted.hashes & mask).astype(np.int64)
    if known.exceptions:
        # Only terms that have the hash of an exception are looked at themselves.
        clash = np.unique(np.array([xxhash.xxh64_intdigest(t, 42) & int(mask) for t in known.exceptions], np.int64))
        at = np.flatnonzero(_place(clash, ids)[1])
        ids[at] = [known.exceptions.get(t, i) for t, i in zip(counted.terms(at), ids[at].tolist())]
    return counted.row, ids, counted.tfs


def _place(sorted_ids: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ids in a sorted list, and whether they are in it. Looked up in rising order, which spares most reads of memory."""
    if not len(sorted_ids):
        return np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    order = np.argsort(ids)
    place = np.empty(len(ids), np.int64)
    place[order] = np.searchsorted(sorted_ids, ids[order])
    place[place == len(sorted_ids)] = 0
    return place, sorted_ids[place] == ids


def look_up(counted: Counted, ends: np.ndarray, known: Known, rare: Known | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, id, tf, weight) of all terms that are known, by one table or by either; weights of a text have length one."""
    row, ids, tfs = _numbers(counted, ends, known)
    order = np.argsort(ids)
    ordered, weight, seen = ids[order], np.zeros(len(ids)), np.zeros(len(ids), bool)
    for table in (known, rare):
        if table is not None and len(table.ids):
            place = np.searchsorted(table.ids, ordered)
            place[place == len(table.ids)] = 0
            found = table.ids[place] == ordered
            weight[found] = table.idf[place[found]]
            seen |= found
    idf = np.empty(len(ids))
    idf[order], seen[order] = weight, seen.copy()
    row, ids, tfs = row[seen], ids[seen], tfs[seen]
    weights = tfs * idf[seen]
    lengths = np.sqrt(np.bincount(row, weights * weights, len(ends) - 1))
    return row, ids, tfs, weights / lengths[row]


def _lists(row: np.ndarray, rows: int, *values: pa.Array) -> list[pa.Array]:
    """List columns of values that are sorted by row."""
    offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows)))), pa.int32())
    return [pa.ListArray.from_arrays(offsets, v) for v in values]


def _weigh(batches: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, ids, tfs, weights = look_up(*count_batch(batch.column(batch.num_columns - 1)), known.value)
        lists = _lists(row, len(batch), pa.array(ids), pa.array(tfs), pa.array(weights))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *lists], [*batch.schema.names[:-1], "ids", "tfs", "weights"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of their chunk and their bare text: a chunk is an Arrow batch, so bounded in rows and in bytes."""
    first = TaskContext.get().partitionId() << 33
    for n, batch in enumerate(batches):
        bare = pa.array([*map(bare_bytes, batch.column(batch.num_columns - 1).to_pylist())], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), first + n)), *batch.columns[:-1], bare], ["__chunk", *batch.schema.names])


def _asked(batches: Iterator[pa.RecordBatch], known, groups: int) -> Iterator[pa.RecordBatch]:
    """(group, chunk, ids): ids of a chunk's terms that are not among the known ones, each once."""
    for batch in batches:
        chunks, text = batch.column(0).to_numpy(), batch.column(1)
        # A chunk's rows lie together; the files of a task come in any order, so its chunks do too.
        begin = [0, *(np.flatnonzero(np.diff(chunks)) + 1)] if len(batch) else []
        for start, end in zip(begin, [*begin[1:], len(batch)]):
            chunk = chunks[start]
            ids = np.sort(_numbers(*count_batch(text[start:end]), known.value)[1])
            ids = ids[np.diff(ids, prepend=ids[:1] - 1) != 0]
            ids = ids[~_place(known.value.ids, ids)[1]]
            group = np.mod(ids, groups)
            order = np.argsort(group, kind="stable")
            groups_here, n = np.unique(group, return_counts=True)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(ids[order], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(groups_here, pa.int64()), pa.array(np.full(len(n), chunk), pa.int64()), lists], ["group", "__chunk", "ids"])


def _answered(asked: pa.Table, table: pa.Table) -> pa.Table:
    """(chunk, ids, idfs): of the ids that are asked for, those in the table."""
    order = np.argsort(known := table.column("id").to_numpy())
    lists = asked.column("ids").combine_chunks()
    ids = lists.flatten().to_numpy()
    place, found = _place(known[order], ids)
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())[found]
    values = [ids[found], table.column("idf").to_numpy()[order][place[found]] if len(known) else np.empty(0)]
    return pa.table([asked.column("__chunk"), *_lists(row, len(lists), *map(pa.array, values))], ["__chunk", "ids", "idfs"])


def _weigh_chunk(rows: pa.Table, answers: pa.Table, known, finish) -> pa.Table:
    """The texts of a chunk, with the known terms and those that were asked for, as ``finish`` gives them."""
    ids, idf = (answers.column(c).combine_chunks().flatten().to_numpy() for c in ("ids", "idfs"))
    order = np.argsort(ids)
    texts = rows.column(rows.num_columns - 1).combine_chunks()
    row, ids, tfs, weights = look_up(*count_batch(texts), known.value, known.value._replace(ids=ids[order], idf=idf[order]))
    return finish(rows.select(rows.column_names[:-1]), row, ids, tfs, weights)


def _listed(rows: pa.Table, row: np.ndarray, ids: np.ndarray, tfs: np.ndarray, weights: np.ndarray) -> pa.Table:
    lists = _lists(row, rows.num_rows, pa.array(ids), pa.array(tfs), pa.array(weights))
    return pa.table([*rows.columns[1:], *lists], [*rows.column_names[1:], "ids", "tfs", "weights"])


def tfidf_terms(df: DataFrame, terms: TermTable, keep: Sequence[str], text: str = "text", most: int = BROADCAST_TERMS) -> DataFrame:
    """(keep..., ids, tfs, weights): tf x idf of the known terms of each text, scaled to length one; unknown terms drop.

    No shuffle while the term table holds at most ``most`` terms. Of a larger one the most frequent terms travel, which
    make up most of the texts; each chunk of texts asks the rest of the table for its other terms, each once, in
    one array for each group of terms. The bare texts are staged and cut into terms twice; no row per text and term moves.
    A row without a known term has empty arrays. Counts the table when called.
    """
    spark = df.sparkSession
    rows = df.select(*keep, F.col(text).alias("__text"))
    schema = f"{_kept(rows)}, ids array<long>, tfs array<long>, weights array<double>"
    known = known_terms(spark, terms, most)
    if known is not None:
        return map_arrow(rows, partial(_weigh, known=spark.sparkContext.broadcast(known)), schema)
    return weighed_chunks(rows, terms, most, _listed, schema)


def _kept(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])


def weighed_chunks(rows: DataFrame, terms: TermTable, most: int, finish: Callable, schema: str) -> DataFrame:
    """The way of ``tfidf_terms`` for tables larger than ``most``, over rows with the text as last column.

    ``finish`` makes rows of the ``schema`` from a table of a chunk (its number, other columns) and (text, id, tf, weight) of all its terms.
    """
    spark = rows.sparkSession
    often, rare, n_rare = frequent_terms(terms, most)
    known, groups = spark.sparkContext.broadcast(often), -(-n_rare // ASKED_TERMS)
    chunks = materialise(map_arrow(rows, _cut, f"__chunk long, {_kept(rows)}, __text binary"))
    asked = map_arrow(chunks.select("__chunk", "__text"), partial(_asked, known=known, groups=groups), "group long, __chunk long, ids array<long>")
    table = rare.withColumn("group", F.pmod("id", F.lit(groups).cast("long")))
    answers = asked.groupBy("group").cogroup(table.groupBy("group")).applyInArrow(_answered, "__chunk long, ids array<long>, idfs array<double>")
    return chunks.groupBy("__chunk").cogroup(answers.groupBy("__chunk")).applyInArrow(partial(_weigh_chunk, known=known, finish=finish), schema)


def named_terms(weighed: DataFrame, terms: TermTable, key: str) -> DataFrame:
    """(key, term, tf, weight): the same with names, one row per text and term."""
    single = weighed.select(key, F.inline(F.arrays_zip("ids", "tfs", "weights")).alias("id", "tf", "weight"))
    return single.join(terms.table.select("id", "term"), "id").select(key, "term", "tf", "weight")


def _sums(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """(id, s0, s1, q) over the texts of a task, as far as they can be held; the null id counts the texts of either label."""
    parts: list[tuple[np.ndarray, ...]] = []
    sizes, waiting = np.zeros(2), 0

    def sent() -> pa.RecordBatch:
        ids, label, weights = (np.concatenate(x) if parts else np.empty(0) for x in (zip(*parts) if parts else ((), (), ())))
        own, place = np.unique(ids.astype(np.int64), return_inverse=True)
        sums = [np.bincount(place, x, len(own)) for x in (weights * (label == 0), weights * (label == 1), weights * weights)]
        numbers = pa.array([None, *own.tolist()], pa.int64())
        return pa.RecordBatch.from_arrays([numbers, *[pa.array(np.concatenate(([n], s))) for n, s in zip((*sizes, 0.0), sums)]], ["id", "s0", "s1", "q"])

    for batch in batches:
        label, ids, weights = batch.columns
        y = label.to_numpy(zero_copy_only=False)
        sizes += [(y == 0).sum(), (y == 1).sum()]
        parts.append((ids.flatten().to_numpy(), np.repeat(y, ids.value_lengths().to_numpy()), weights.flatten().to_numpy()))
        waiting += len(parts[-1][0])
        if waiting >= held:
            yield sent()
            parts, sizes, waiting = [], np.zeros(2), 0
    yield sent()


def anova_f(weighed: DataFrame, terms: TermTable, label: str = "label", held: int = 1 << 20) -> DataFrame:
    """(id, term, f_score): one-way F of each term's weight between label 0 and 1.

    Absent terms weigh zero, so sums over the present ones suffice; a task adds them up
    before anything moves. Rows with another label or none take no part. Runs when called.
    """
    rows = weighed.where(F.col(label).isin(0, 1)).select(F.col(label).cast("int"), "ids", "weights")
    sums = map_arrow(rows, partial(_sums, held=held), "id long, s0 double, s1 double, q double")
    sums = materialise(sums.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("s0", "s1", "q")]))
    sizes = sums.where("id is null").first() or [None, 0.0, 0.0]
    n0, n1 = F.lit(float(sizes[1])), F.lit(float(sizes[2]))
    s0, s1 = F.col("s0"), F.col("s1")
    total = F.try_divide((s0 + s1) * (s0 + s1), n0 + n1)
    between = F.try_divide(s0 * s0, n0) + F.try_divide(s1 * s1, n1) - total
    within = F.col("q") - total - between
    ratio = F.try_divide(between * (n0 + n1 - 2), within)
    # A term that tells the labels apart without any spread within them comes first.
    score = F.when((within == 0) & (between > 0), F.lit(float("inf"))).otherwise(ratio)
    scored = sums.where("id is not null").select("id", score.alias("f_score"))
    return scored.join(terms.table.select("id", "term"), "id").select("id", "term", "f_score")


def top_terms(scores: DataFrame, top_k: int = TOP_K, digits: int = 6) -> DataFrame:
    """The ``top_k`` terms of largest F (ties after rounding go by term)."""
    rounded = scores.withColumn("f_score", F.round("f_score", digits))
    return rounded.orderBy(F.col("f_score").desc_nulls_last(), "term").limit(top_k)
