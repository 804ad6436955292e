"""Prefix BPE against the tiktoken library."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldspan.llm.bpe import EditableText, Encoder, PrefixTable, Vocabulary, decode, encode, round_trip

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
VOCABULARY = Vocabulary.load(PATH)
OWN = Encoder(VOCABULARY, PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=VOCABULARY.ranks, special_tokens={})
PIECES = [" ", "  ", "\n", "\t", "a", "the", "ing", "'", "l", "'s", "'ll", "é", "漢", "🙂", " ", "\x1c", "​", "1", "２", "!!", "<|endoftext|>", "́"]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
def test_ids_and_round_trip(text):
    ids = OWN.encode(text)
    assert list(ids) == THEIRS.encode_ordinary(text)
    assert OWN.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="then ingé", max_size=40), st.text(alphabet="then ingé", max_size=10), st.integers(0, 40))
def test_table_of_a_piece_grows_and_shrinks(piece, more, cut):
    table = PrefixTable(VOCABULARY, piece.encode())
    for n in range(len(piece.encode()) + 1):
        assert table.tokens(n) == PrefixTable(VOCABULARY, piece.encode()[:n]).tokens()
    table.append(more.encode())
    assert table.tokens() == PrefixTable(VOCABULARY, (piece + more).encode()).tokens()
    cut = min(cut, len(table.piece))
    table.cut(cut)
    assert table.tokens() == PrefixTable(VOCABULARY, (piece + more).encode()[:cut]).tokens()


def test_edits_equal_encoding_anew():
    rnd, text = random.Random(1), EditableText(OWN)
    for _ in range(1500):
        new = "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 4)))
        if rnd.random() < 0.3:
            text.append(new)
        else:
            start = rnd.randint(0, len(text.text))
            text.edit(start, min(len(text.text), start + rnd.randint(0, 6)), new)
        assert text.pieces == OWN.pattern.findall(text.text)
        assert text.ids() == THEIRS.encode_ordinary(text.text)
        if len(text.text) > 300:
            text = EditableText(OWN, text.text[:40])


def test_an_edit_splits_few_pieces_anew():
    text = EditableText(OWN, "one word after the other " * 2000)
    assert text.edit(25_000, 25_004, "new") < 8
    assert text.ids() == THEIRS.encode_ordinary(text.text)


@pytest.mark.parametrize("alphabet", ["a", " ", "abcdefghij", "é漢", "\n "])
def test_long_pieces(alphabet):
    rnd = random.Random(2)
    text = "".join(rnd.choice(alphabet) for _ in range(20_000))
    assert list(OWN.encode(text)) == THEIRS.encode_ordinary(text)


def test_byte_missing_from_the_vocabulary():
    with pytest.raises(ValueError, match="lacks byte"):
        PrefixTable(Vocabulary({b"a": 0, b"b": 1, b"ab": 2}), b"abc")


def test_frames(spark):
    texts = [None, "", "plain", "plain", "  'll 漢 <|endoftext|>", "word " * 30_000]
    docs = spark.createDataFrame([(i if i != 4 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    tokens = encode(docs, path=PATH, pattern=PATTERN)
    back = {r.doc_id: bytes(r.decoded) for r in decode(tokens, path=PATH, pattern=PATTERN).collect()}
    assert back == {i if i != 4 else None: (t or "").encode() for i, t in enumerate(texts)}
    for r in round_trip(docs, path=PATH, pattern=PATTERN).collect():
        text = texts[4 if r.doc_id is None else r.doc_id] or ""
        ids = THEIRS.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert round_trip(docs.limit(0), path=PATH, pattern=PATTERN).count() == 0
    assert decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), path=PATH, pattern=PATTERN).first().decoded is None
