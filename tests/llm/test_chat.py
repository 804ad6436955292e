"""Chat windows read back, against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fieldspan.llm.chat import CLOSE, MIDDLE, OPEN, escaped, masked_texts, parsed_turns, read_back, unescaped, windows

ROWS = "conv_id long, turn long, role string, text string, window int, tokens string, number int"
NASTY = ["", "\\", "\\\\", "<|", "<\\|", OPEN, MIDDLE, CLOSE, "</s>[INST] ok [/INST]", "a<", "<", "|", "é🙂<|text|>\n", "\\<|end|>\\", "$1 \\1", "line\nline"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 1) for r in rows], ROWS)


def test_escapes_are_undone(spark):
    rnd = random.Random(1)
    texts = NASTY + ["".join(rnd.choice(NASTY) for _ in range(5)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escaped(F.col("t")).alias("e"))
    for r in df.select("t", "e", unescaped(F.col("e")).alias("u")).collect():
        assert r.u == r.t and "<|" not in r.e


def conversations():
    rnd = random.Random(3)
    rows = []
    for conv in range(25):
        roles = (["system"] if conv % 3 == 0 else []) + ["user", "assistant"] * rnd.randrange(1, 12)
        for turn, role in enumerate(roles):
            rows.append((conv, turn, role, rnd.choice(NASTY) + "word " * rnd.choice((1, 5, 30, 200))))
    rows += [(100, None, "user", "no turn"), (100, 0, None, "no role"), (100, 1, "assistant", None), (100, 1, "assistant", None), (100, 600, "assistant", "late"), (100, -3, "user", "early")]
    rows += [(None, 0, "user", "no conversation"), (None, 1, "assistant", "still answered"), (101, 0, "system", "only a system"), (102, 5, "assistant", "x" * 200_000)]
    rows += [(103, t, "assistant", f"turn {t}") for t in range(1500)]
    return rows


@pytest.mark.parametrize("span, history", [(1024, 256), (60, 60), (60, 0)])
def test_read_back_equals_brute_force(spark, span, history):
    rows = conversations()
    made = windows(frame(spark, rows), span_tokens=span, history_tokens=history).cache()
    found = {r.conv_id: r for r in read_back(made).collect()}
    expected = {}
    for conv, turn, role, text in rows:
        expected.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(found) == set(expected)
    for conv, turns in expected.items():
        turns = [t[2:] for t in sorted(turns)]
        loss = "".join(text for role, text in turns if role == "assistant")
        r = found[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert sum(r.formatted_chars for r in found.values()) == sum(len(r.formatted) for r in made.collect())

    tokens = lambda text: -(-len(text) // 4) + 1
    parsed = made.select("conv_id", "window", "n_context", "n_turns", parsed_turns(F.col("formatted")).alias("turns"), masked_texts(F.col("formatted"), F.col("loss")).alias("targets"))
    for r in parsed.collect():
        turns = [tuple(t) for t in r.turns]
        assert len(turns) == r.n_context + r.n_turns and r.n_turns > 0
        own, context = turns[r.n_context :], turns[: r.n_context]
        assert [t for role, t in own if role == "assistant"] == list(r.targets)
        assert sum(tokens(t) for _, t in own[:-1]) < span  # only the last turn may go beyond
        has_system = sorted(expected[r.conv_id])[0][2] == "system"
        if has_system and r.window > 0:
            assert context[0][0] == "system"
        assert sum(tokens(t) for _, t in context[has_system:]) <= history
        if r.window == 0:
            assert not context


def test_empty(spark):
    assert read_back(windows(frame(spark, []))).count() == 0


def test_history_longer_than_a_span(spark):
    with pytest.raises(ValueError):
        windows(frame(spark, []), span_tokens=10, history_tokens=11)
