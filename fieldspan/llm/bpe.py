"""Byte-level BPE by prefix dynamic programming: every byte prefix of a piece has one valid last token.

An encoding is valid if each neighbouring pair of its tokens is what the merges make of
the two together. A prefix has exactly one valid encoding, and all but its last token
are the encoding of a shorter prefix; so one token per prefix holds the encodings of
all of them, can be extended without touching what is there, and be cut anywhere.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fieldspan.llm.common import map_arrow, utf8

#: Pieces, prefixes and pairs of tokens that a worker remembers before it starts anew; about 150 bytes each.
REMEMBERED = 250_000
#: Bytes of a piece up to which its prefixes are worth remembering; a longer one gets a table of its own.
SHORT = 48
#: Characters that the split pattern may look ahead of a boundary, as in "'ll" or white space before a letter.
LOOKAHEAD = 3


class Vocabulary:
    """Ranks of a byte-level BPE vocabulary and, for each token, the two that its last merge joins."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.halves: dict[int, tuple[int, int]] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            parts = self._merged(token, rank) if len(token) > 1 else [rank]
            self.halves[rank] = (parts[0], parts[1]) if len(parts) == 2 else (rank, rank)
        self.joined = {halves: rank for rank, halves in self.halves.items() if halves[0] != rank}
        self.suffixes = {token[i:] for token in ranks for i in range(len(token))}
        self.pairs: dict[tuple[int, int], bool] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Lines of a base64 token and its rank."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())})

    def _merged(self, token: bytes, below: int) -> list[int]:
        """Tokens of a byte string after all merges of a rank under ``below``."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, left: int, right: int) -> bool:
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            found = self.pairs[left, right] = self._may_follow(left, right)
        return found

    def last_token(self, piece: bytes, last_of) -> int:
        """The last token of a byte string, given those of its shorter prefixes by their lengths."""
        ranks, end, start = self.ranks, len(piece), len(piece) - 1
        while start >= 0 and piece[start:] in self.suffixes:
            token = ranks.get(piece[start:])
            if token is not None and (not start or self.may_follow(last_of(start), token)):
                return token
            start -= 1
        raise ValueError(f"the vocabulary lacks byte {piece[end - 1]}")

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether ``left right`` is the encoding of their bytes.

        Both are taken apart, the later merge first, down to the bytes at the seam. If a
        merge across the seam would have come before the ones taken apart so far, the
        tokens could not have arisen side by side.
        """
        limit = 1 << 62
        while True:
            across = self.joined.get((left, right))
            if across is not None and across < limit:
                return False
            inner_left, inner_right = self.halves[left][1], self.halves[right][0]
            if inner_left == left and inner_right == right:
                return True
            # Of two equal ranks the left one was merged first, so the right one is undone first.
            if inner_right == right or (inner_left != left and left > right):
                limit, left = left, inner_left
            else:
                limit, right = right + 1, inner_right


class PrefixTable:
    """The last token of every byte prefix of a piece."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, bytearray(), array("i")
        self.append(piece)

    def append(self, more: bytes) -> None:
        """Exactly what a table of the longer piece holds; earlier entries stay."""
        begin, reach = len(self.piece), self.vocabulary.longest
        self.piece += more
        piece, last = bytes(self.piece), self.last
        for end in range(begin + 1, len(piece) + 1):
            low = max(0, end - reach - 1)  # a byte more than any token, so a cut never looks like the whole
            last.append(self.vocabulary.last_token(piece[low:end], lambda n: last[low + n - 1]))

    def cut(self, length: int) -> None:
        """Back to a shorter prefix."""
        del self.piece[length:], self.last[length:]

    def tokens(self, length: int | None = None) -> list[int]:
        """The encoding of the prefix of a length, of the whole piece by default."""
        end, found = len(self.piece) if length is None else length, []
        while end:
            found.append(self.last[end - 1])
            end -= len(self.vocabulary.bytes_of[found[-1]])
        return found[::-1]


class Encoder:
    """Encodes texts piece by piece; tokens of pieces met before are remembered up to a bound."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.known: dict[str, array] = {}
        self.last: dict[bytes, int] = {}

    def piece(self, piece: str) -> array:
        found = self.known.get(piece)
        if found is None:
            data = piece.encode()
            whole = self.vocabulary.ranks.get(data)
            found = array("I", [whole] if whole is not None else self._tokens(data))
            if len(data) <= SHORT:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[piece] = found
        return found

    def _tokens(self, data: bytes) -> list[int]:
        """Tokens of a piece; words share prefixes, so only the prefixes not met before are new."""
        if len(data) > SHORT:
            return PrefixTable(self.vocabulary, data).tokens()
        last, end = self.last, len(data)
        if len(last) >= REMEMBERED:
            last.clear()
        while end and data[:end] not in last:
            end -= 1
        for n in range(end + 1, len(data) + 1):
            prefix = data[:n]
            last[prefix] = self.vocabulary.last_token(prefix, lambda m: last[prefix[:m]])
        found, end = [], len(data)
        while end:
            found.append(last[data[:end]])
            end -= len(self.vocabulary.bytes_of[found[-1]])
        return found[::-1]

    def encode(self, text: str) -> array:
        ids = array("I")
        get, miss, extend = self.known.get, self.piece, ids.extend
        for piece in self.pattern.findall(text):
            extend(get(piece) or miss(piece))
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


class EditableText:
    """A text with its pieces and tokens, kept exact while it is appended to or edited."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text, self.pieces = encoder, text, encoder.pattern.findall(text)

    def ids(self) -> list[int]:
        return [i for p in self.pieces for i in self.encoder.piece(p)]

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace characters ``start`` to ``end``; returns how many pieces were split anew.

        Pieces that ``LOOKAHEAD`` characters followed before the edit stay. Splitting goes
        on behind the edit until it meets a boundary of the old pieces; the rest stays.
        """
        keep, at = 0, 0
        while keep < len(self.pieces) and at + len(self.pieces[keep]) + LOOKAHEAD <= start:
            at += len(self.pieces[keep])
            keep += 1
        bounds, here = {}, 0  # places where an old piece begins, to its number
        for i, piece in enumerate(self.pieces):
            if here >= end:
                bounds[here] = i
            here += len(piece)
        shift = len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        fresh, rest = [], len(self.pieces)
        for match in self.encoder.pattern.finditer(self.text, at):
            old = bounds.get(match.start() - shift)
            if old is not None and match.start() >= start + len(new):
                rest = old
                break
            fresh.append(match.group())
        self.pieces[keep:rest] = fresh
        return len(fresh)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One per worker process; reading a vocabulary takes seconds."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(Vocabulary.load(path), pattern)
    return _ENCODERS[path, pattern]


def _encode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    own = encoder(path, pattern)
    for batch in batches:
        ids = [own.encode(t.decode() if t else "") for t in utf8(batch.column(1))]
        offsets = array("i", [0])
        for x in ids:
            offsets.append(offsets[-1] + len(x))
        values = pa.array(memoryview(b"".join(x.tobytes() for x in ids)).cast("I") if offsets[-1] else [], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], ["id", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    own = encoder(path, pattern)
    for batch in batches:
        texts = [own.decode(ids) if ids is not None else None for ids in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["id", "decoded"])


def encode(docs: DataFrame, *, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) for every row; null and empty texts have no ids. No shuffle.

    ``path`` is a file of ranks that every worker can read. Special tokens are ordinary text.
    """
    kind = docs.schema[key].dataType.simpleString()
    ids = map_arrow(docs.select(key, text), partial(_encode, path=path, pattern=pattern), f"id {kind}, ids array<int>")
    return ids.withColumnRenamed("id", key)


def decode(tokens: DataFrame, *, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded binary) for every row; null ids decode to null, no ids to no bytes."""
    kind = tokens.schema[key].dataType.simpleString()
    texts = map_arrow(tokens.select(key, ids), partial(_decode, path=path, pattern=pattern), f"id {kind}, decoded binary")
    return texts.withColumnRenamed("id", key)


def _round_trip(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    own = encoder(path, pattern)
    little = array("I", [1]).tobytes()[0] == 1
    for batch in batches:
        counts, id_digests, digests = [], [], []
        for text in utf8(batch.column(1)):
            ids = own.encode(text.decode() if text else "")
            decoded = own.decode(ids)
            if not little:
                ids.byteswap()
            counts.append(len(ids))
            id_digests.append(hashlib.sha256(ids.tobytes()).hexdigest())
            digests.append(hashlib.sha256(decoded).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(digests, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip(docs: DataFrame, *, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): every text encoded and decoded again in one pass, digests only."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_arrow(docs.select(key, text), partial(_round_trip, path=path, pattern=pattern), schema).withColumnRenamed("id", key)
