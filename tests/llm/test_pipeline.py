"""The corpus pipeline on a small planted corpus, against brute force stage by stage."""

import hashlib
import random
import struct

import public_tokenizers
import tiktoken

import corpus_pipeline
from fieldspan.llm.bpe import Vocabulary
from fieldspan.llm.decontaminate import letter_words
from tests.llm.test_near_dedup import brute_force as near_brute_force
from tests.llm.test_near_dedup import edited

DOCS, LABELS, ITEMS = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int", "item_id long, text string"


def tables(spark, folder):
    """Clean texts, junk, exact and near copies, copies of benchmark passages, empty and null texts; what is what."""
    rnd, rows, kind = random.Random(8), [], []
    word = lambda: "".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randrange(2, 9)))
    items = [[word() for _ in range(30)] for _ in range(5)]
    for i in range(240):
        words = [word() for _ in range(rnd.randrange(60, 160))]
        rows.append(" ".join(words) + ".")
        kind.append("clean")
        if i % 6 == 0:
            rows.append((" ### ".join(words), " | ".join(words), "!! ".join(words).upper())[i // 6 % 3])
            kind.append("junk")
        if i % 8 == 0:
            rows += [" ".join(words) + ".", edited(words, 1, rnd) + "."]
            kind += ["copy", "near"]
        if i % 12 == 0:
            rows.append(" ".join(words[:40] + items[i // 12 % 5][5:25] + words[40:]))
            kind.append("leak")
    docs = [(i, t, "en", f"src{i % 4}", len(t)) for i, t in enumerate(rows)] + [(9000, None, None, None, None), (9001, "", "en", "src1", 0), (9002, rows[0] + " more" * 40_000, "en", "src1", 1)]
    labels = [(i, int(k != "junk"), 0) for i, k in enumerate(kind) if i % 2 == 0]
    for name, data, schema in (("documents", docs, DOCS), ("labels", labels, LABELS), ("benchmark", [(i, " ".join(w)) for i, w in enumerate(items)], ITEMS)):
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return {d[0]: d[1] for d in docs}, dict(enumerate(kind)), items


def test_stages_equal_brute_force(spark, tmp_path):
    texts, kind, items = tables(spark, tmp_path)
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before
        docs.write.parquet(f"{tmp_path}/{name}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})

    good, single, clean, encoded = kept
    assert {i for i in good if i in kind} == {i for i, k in kind.items() if k != "junk"} and len(good) == docs.select("doc_id").distinct().count() + (len(good) - len(encoded))
    assert single == {i for i, (_, _, stays) in near_brute_force([(i, texts[i]) for i in good], 5).items() if stays}
    windows = {tuple(w[i : i + 10]) for w in ([x.encode() for x in item] for item in items) for i in range(len(w) - 9)}
    held = lambda w: any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9))
    assert clean == {i for i in single if not held(letter_words((texts[i] or "").encode()))}
    assert not any(kind.get(i) in ("junk", "copy", "near", "leak") for i in clean)
    assert sum(kind.get(i) == "clean" for i in clean) == 240
    ranks = Vocabulary.load(public_tokenizers.path("byte_bpe_50k.tiktoken")).ranks
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in docs.collect():
        text = texts[r.doc_id] or ""
        ids = own.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, docs.collect()))


def test_stages_of_nothing(spark, tmp_path):
    for name, schema in (("labels", LABELS), ("benchmark", ITEMS), ("documents", DOCS)):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (1, "a", None, None, None), (1, "a", None, None, None)], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 4
