import gzip
import json
import math
import time
import uuid
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from fieldspan.functions import copies, countries, predicates, slices
from fieldspan.operators import annotations, candidates, classify, corpus, ensembles, features, ngrams, stats, summary, training
from fieldspan.sources import files, schemas
from fieldspan.streaming.scoring import score_new_files

PUBS = (
    "publication_number string, family_id string, country_code string, publication_date bigint, "
    "cpc array<struct<code:string>>, ipc array<struct<code:string>>, citation array<struct<publication_number:string>>"
)
RESEARCH = (
    "publication_number string, title string, abstract string, cpc array<struct<code:string>>, "
    "similar array<struct<publication_number:string>>, cited_by array<struct<publication_number:string>>"
)


def s(*values):
    return [(v,) for v in values]


@pytest.fixture
def pubs(spark):
    rows = [
        ("p1", "f1", "US", 20010101, s("A/1", "A/2"), s("I1"), s("p3", "gone", None)),
        ("p2", "f1", "FR", 20000101, s("B/1"), [], s("p3")),
        ("p3", "f2", "US", 19990101, [], s("I2"), []),
        ("p4", "f3", None, 0, None, None, None),
        ("p5", None, "DE", 20050101, s("A/1"), s("I1"), s("p1")),
    ]
    return spark.createDataFrame(rows, PUBS)


@pytest.fixture
def research(spark):
    rows = [
        ("p1", "T1", "Abs one", s("A/1", "A/2", "AB/3"), s("p3", "p3", None, "gone"), s("p3")),
        ("p2", None, "abs TWO", s("B/1"), s("p1"), s("p3", "p4")),
        ("p3", "T3", "", [], None, s("p1")),
        ("p4", "T4", None, None, [], []),
        ("p5", "T5", "five keyword", s("A/1"), s("p2"), []),
    ]
    return spark.createDataFrame(rows, RESEARCH)


def test_families(pubs, research):
    got = {r.family_id: r for r in corpus.publications_family(pubs, research).collect()}
    assert set(got) == {"f1", "f2", "f3"}
    f1 = got["f1"]
    assert f1.publication_date == 20000101 and f1.publication_number == ["p1", "p2"] and f1.country_code == ["FR", "US"]
    assert [c.code for c in f1.cpc] == ["A/1", "A/2", "B/1"] and [c.code for c in f1.ipc] == ["I1"]
    assert [c.family_id for c in f1.citation] == ["f2"] and [c.family_id for c in f1.cited_by] == ["f2", "f3"]
    assert f1.abstract == "T1\nAbs one"
    assert [c.family_id for c in got["f2"].cited_by] == ["f1"] and got["f2"].abstract == "T3\n"
    assert got["f3"].cpc == [] and got["f3"].citation == [] and got["f3"].abstract is None
    assert got["f3"].country_code == []
    strict = {r.family_id: r for r in corpus.publications_family(pubs, strict_cross=True).collect()}
    assert [c.code for c in strict["f1"].cpc] == ["A/1", "A/2"] and strict["f2"].ipc == []


def test_family_schema_matches_the_published_one(pubs, research, spark):
    published = spark.createDataFrame([], schemas.FAMILY_PUBLICATIONS)
    got = corpus.publications_family(pubs, research)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [
        (f.name, f.dataType.simpleString()) for f in published.schema
    ]


def test_family_abstract(pubs, research, rows):
    got = rows(corpus.family_abstract(pubs, research))
    assert got == sorted(
        [("f1", "p1,p2", "Abs one", True), ("f2", "p3", None, False), ("f3", "p4", None, False), (None, "p5", None, False)],
        key=repr,
    )


def test_flatten_nested(spark):
    df = spark.createDataFrame([(1, [(["a", "b"],)]), (2, []), (3, [([],)])], "id int, cpc array<struct<code:array<string>>>")
    got = {r.id: [c.code for c in r.cpc] for r in corpus.flatten_nested(df, ["cpc"]).collect()}
    assert got == {1: ["a", "b"], 2: [], 3: []}
    two = spark.createDataFrame([(1, [(["a"],), (["b"],)])], df.schema)
    with pytest.raises(Exception, match="more than one element"):
        corpus.flatten_nested(two, ["cpc"]).collect()


def test_candidates(spark, pubs, research, rows):
    listed = spark.createDataFrame([("p1",), ("p5",)], "publication_number string")
    similar = candidates.similar_candidates(research, listed)
    assert rows(similar, "publication_number", "match") == [("p2", "patent"), ("p3", "patent"), ("p3", "patent")]
    prefixed = candidates.class_candidates(research, ["A/", "A"])
    assert rows(prefixed, "publication_number") == [("p1",), ("p1",), ("p1",), ("p5",)]
    assert rows(candidates.keyword_candidates(research, ["two", "key_ord"]), "publication_number") == [("p2",), ("p5",)]
    assert candidates.keyword_candidates(research, ["TWO"]).count() == 0
    unknown = spark.createDataFrame([("u1", "T", "A"), ("u2", "T", "A")], "publication_number string, title string, abstract string")
    everything = candidates.all_candidates(research, listed, ["two"], ["A/"]).unionByName(
        unknown.withColumn("match", F.lit("cpc"))
    )
    got = rows(candidates.family_candidates(everything, pubs))
    assert got == sorted(
        [
            ("f1", "p1,p1,p2,p2", "T1\n\nAbs one", "cpc,keyword,patent", 4),
            ("f2", "p3,p3", "T3\n\n", "patent", 2),
            (None, "p5", "T5\n\nfive keyword", "cpc", 1),
            (None, "u1", "T\n\nA", "cpc", 1),
            (None, "u2", "T\n\nA", "cpc", 1),
        ],
        key=repr,
    )


def test_predicates(spark):
    assert predicates.split_lists({"a": "x, y,,", "b": "z"}) == ["x", " y", "z"]
    df = spark.createDataFrame([("G06Q20/32",), ("H04L",), (None,)], "code string")
    assert df.filter(predicates.holds_code("code", ["Q20/00", "Q20/10"], main_group=True)).count() == 1
    assert df.filter(predicates.holds_code("code", [])).count() == 0
    assert df.filter(predicates.in_countries("code", [])).count() == 3


def test_countries(spark, rows):
    df = spark.createDataFrame([("FR",), ("XX",), ("WO",), ("XX",), (None,)], "country_code string")
    assert ("WO", "WIPO (PCT)") in rows(countries.with_country_name(df))
    assert rows(countries.unknown_countries(df)) == [("XX", 2)]
    assert countries.country_names(["US", "??"]) == ["United States"]
    assert set(countries.COUNTRY_GROUPS["g7"]) <= set(countries.COUNTRY_NAMES)


def test_annotations(spark):
    records = candidates.with_options(
        spark.createDataFrame([(1, "accept", [0, 1]), (2, "reject", []), (3, "ignore", [1])], "family_id int, answer string, accept array<int>"),
        ["yes", "no"],
    )
    got = {r.family_id: (r.accept_text, r.expansion_level) for r in annotations.with_practical_fields(records).collect()}
    assert got == {1: (["yes", "no"], "SEED"), 2: ([], "ANTISEED-manual"), 3: (["no"], None)}
    assert candidates.with_options(records, []) is records


def _lines(spark, dicts):
    return spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(dicts)], "position int, value string")


def test_corrections(spark):
    base = _lines(spark, [{"family_id": "1", "a": "x", "b": 2}, {"family_id": "2", "a": "y"}, {"a": "nokey"}])
    fixes = _lines(
        spark,
        [{"family_id": "1", "a": "first"}, {"family_id": "1", "a": None, "c": [1, 2]}, {"family_id": "9", "a": "unknown"}],
    )
    corrected = annotations.correct_annotations(base, fixes)
    got = {r.position: r.fields for r in corrected.collect()}
    assert got == {0: {"family_id": "1", "a": None, "b": "2", "c": "[1,2]"}, 1: {"family_id": "2", "a": "y"}, 2: {"a": "nokey"}}
    again = corrected.select("position", F.to_json("fields", {"ignoreNullFields": "false"}).alias("value"))
    twice = {r.position: r.fields for r in annotations.correct_annotations(again, fixes).collect()}
    assert twice == got


def test_files(spark, tmp_path):
    good = [json.dumps({"family_id": str(i), "answer": "accept", "extra": 1, "accept_text": ["a"]}) for i in range(5)]
    (tmp_path / "a.jsonl").write_text("\n".join(good) + '\n{"family_id": \n')
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as out:
        out.write("\n".join(good) + "\n")
    loaded = files.load_annotated(spark, str(tmp_path / "*.jsonl*"))
    assert loaded.count() == 10 and loaded.columns == [f.split()[0] for f in schemas.SEED.split(", ")]
    with pytest.raises(files.TooManyBadRecords):
        files.load_annotated(spark, str(tmp_path / "a.jsonl"), max_bad_records=0)
    bad = files.inspect_jsonl(spark, str(tmp_path / "*.jsonl*"), numbered=True).collect()
    assert [(r.file.rsplit("/")[-1], r.line) for r in bad] == [("a.jsonl", 5)]
    assert files.inspect_jsonl(spark, str(tmp_path / "*.jsonl*")).count() == 1
    out = str(tmp_path / "out")
    files.write_jsonl(loaded, out, gzip=True)
    assert spark.read.json(out).count() == 10 and "nb_bin" in spark.read.json(out).columns
    files.write_csv(loaded.select("family_id"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 10


def test_metas_and_wide_scores(spark, tmp_path, rows):
    for uid, f in (("u1", 0.5), ("u2", 0.7)):
        folder = tmp_path / f"tech_{uid}_mlp" / "model-best"
        folder.mkdir(parents=True)
        performance = {"precision": f, "recall": f} | ({"loss": 1.0} if uid == "u1" else {})
        (folder / "meta.json").write_text(json.dumps({"performance": performance}))
    metas = files.read_metas(spark, str(tmp_path / "tech_*" / "model-best" / "meta.json"))
    got = {(r.architecture, r.metric): r for r in ensembles.model_performance(metas).collect()}
    assert set(got) == {("mlp", "precision"), ("mlp", "recall"), ("mlp", "f1-score")}
    assert got["mlp", "f1-score"]["mean"] == pytest.approx(0.6) and got["mlp", "f1-score"]["count"] == 2
    (tmp_path / "wide.csv").write_text(",m1,m2\n0,0.1,0.9\n1,0.2,0.8\n")
    long = files.read_wide_scores(spark, str(tmp_path / "wide.csv"))
    assert rows(long, "position", "model_id", "score") == [("0", "m1", 0.1), ("0", "m2", 0.9), ("1", "m1", 0.2), ("1", "m2", 0.8)]


def test_wide_scores_of_files_with_other_models(spark, tmp_path, rows):
    (tmp_path / "classification_steel_robustness_cnn.csv").write_text(",m1,m2\n0,0.1,0.2\n")
    (tmp_path / "classification_steel_robustness_mlp.csv").write_text(",m3,m4,m5\n0,0.3,0.4,0.5\n")
    long = files.read_wide_scores(spark, str(tmp_path / "*.csv"))
    expected = [("cnn", "m1", 0.1), ("cnn", "m2", 0.2), ("mlp", "m3", 0.3), ("mlp", "m4", 0.4), ("mlp", "m5", 0.5)]
    assert rows(long, "architecture", "model_id", "score") == expected and {r.technology for r in long.collect()} == {"steel"}


@pytest.mark.parametrize("larger", [0, 1])
def test_last_correction_follows_the_files_whatever_their_size(spark, tmp_path, larger):
    for i in range(2):
        padding = [json.dumps({"family_id": "other", "a": "x" * 200})] * (500 if i == larger else 1)
        (tmp_path / f"{i + 1}.jsonl").write_text("\n".join([json.dumps({"family_id": "1", "a": f"file {i + 1}"}), *padding]) + "\n")
    base = _lines(spark, [{"family_id": "1", "a": "base"}])
    fixed = annotations.correct_annotations(base, files.read_lines(spark, str(tmp_path / "*.jsonl")), order=files.ORDER)
    assert fixed.first().fields["a"] == "file 2"


def test_json_lines_of_any_size_and_kind(spark, rows):
    huge = json.dumps({"text": "x" * (20 << 20), "is_seed": 1})
    good = [huge, '{"text":"a"} ', "[1,2]", "5", "null", '"]"', '{"a":{"b":[1,"]"]}}', '[{"a":1}]']
    bad = ['{"text":', '{"a":1} x', '{"a":1}{"b":2}', '{"a":1},{"b":2}', '{"a":1}] [2', '1} {"x":2', "{'a':1}", "", "nothing"]
    lines = spark.createDataFrame([(x,) for x in good + bad], "value string")
    assert sorted(r.value for r in annotations.json_defects(lines).collect()) == sorted(bad)
    kept = annotations.classifier_input(lines).selectExpr("length(text) AS n", "is_seed")
    assert rows(kept) == sorted([(20 << 20, 1), (1, None), (0, None)], key=repr)


def test_lines_are_numbered_across_the_parts_of_a_file(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join("{bad\n" if i % 997 == 0 else '{"a":"%s"}\n' % ("y" * 90) for i in range(6000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        found = files.inspect_jsonl(spark, str(tmp_path / "a.jsonl"), numbered=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r.line for r in found) == list(range(0, 6000, 997))


def test_representativeness_of_models_of_their_own_group(spark, rows):
    scores = [("cnn", m, k, float(k * s)) for m, s in (("c1", 1), ("c2", -1)) for k in range(4)] + [("mlp", "x1", k, float(k)) for k in range(4)]
    df = spark.createDataFrame(scores, "architecture string, model_id string, k int, score double")
    expected = [("cnn", "c1", 0.0), ("cnn", "c2", 0.0), ("mlp", "x1", 1.0)]
    for models in (None, ["c1", "c2", "x1"]):
        assert rows(ensembles.representativeness(df, "k", models).selectExpr("architecture", "model_id", "round(mean_corr, 6) AS c")) == expected


@pytest.mark.parametrize("size", [1, 4, 10])
def test_drawn_tables_have_their_size_with_repeated_keys(spark, size):
    labelled = spark.createDataFrame([], "k int, expansion_level string, text string")
    pool = spark.createDataFrame([(k, f"text {k} {i // 2}") for k in range(20) for i in range(3)], "k int, abstract string")
    outside = spark.createDataFrame([(99, "PC")], "k int, expansion_level string")
    table = training.training_table(labelled, pool, outside, size, "k", draw_seed=3)
    assert table.count() == size
    expansion = spark.createDataFrame([(k, level) for k in range(20) for level in ("PC", "L1-FOR")], "k int, expansion_level string")
    sample = training.expansion_texts(expansion, pool, "k", sample_size=size, draw_seed=3)
    assert sample.count() == size and sample.columns == ["k", "expansion_level", "text"]


def test_classifier_input(spark, rows):
    lines = spark.createDataFrame([('{"text":"a","is_seed":0}',), ('{"is_seed":1}',), ('{"text":"b"}',), ('{"text":',)], "value string")
    assert rows(annotations.classifier_input(lines)) == [("", 1), ("a", 0), ("b", None)]


def test_training_table_and_extract(spark, rows):
    labelled = spark.createDataFrame([(1, "SEED", "s"), (2, "ANTISEED-manual", "m"), (3, None, "n")], "k int, expansion_level string, text string")
    pool = spark.createDataFrame([(1, "one"), (4, "four"), (5, ""), (6, None), (7, "\n")], "k int, abstract string")
    expansion = spark.createDataFrame([(1, "SEED"), (4, "PC"), (5, "PC"), (7, "L1-FOR"), (9, None)], "k int, expansion_level string")
    table = training.training_table(labelled, pool, expansion, 10, "k", draw_seed=1)
    assert rows(table, "k", "expansion_level", "is_seed", "text") == [(1, "SEED", 1, "s"), (2, "ANTISEED-manual", 0, "m")]
    open_table = training.training_table(labelled, pool, expansion, 10, "k", draw_seed=1, exclude_expansion=False)
    assert rows(open_table.filter("expansion_level = 'ANTISEED-AF'"), "k") == [(1,), (4,), (7,)]
    assert table.schema["cats"].dataType.simpleString() == "struct<SEED:int,NOT_SEED:int>"
    assert rows(training.expansion_texts(expansion, pool, "k")) == [(4, "PC", "four")]
    assert training.expansion_texts(expansion, pool, "k", sample_size=5).count() == 1


def test_join_keeps_the_left_key(spark, rows):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    right = spark.createDataFrame([(2, "abs", 5), (3, "only", 6)], "k int, abstract string, z int")
    assert rows(training.join_tables(left, right, "k", "outer")) == sorted(
        [(1, "a", None, None), (2, "b", "abs", 5), (None, None, "only", 6)], key=repr
    )
    assert rows(training.join_tables(left, right, "k", "RIGHT", ["z"])) == sorted([(2, "b", 5), (None, None, 6)], key=repr)
    assert training.join_tables(left, right, "k", abstract2text=True).columns == ["k", "x", "text", "z"]


TEXTS = ["alpha beta gamma alpha", "alpha beta", "gamma delta x", "delta delta beta", "Álpha only", "beta delta gamma"]
Y = [1, 1, 0, 0, 1, 0]


def _tfidf(texts, min_df=2):
    """Plain n-gram TF-IDF to check against."""
    import re
    import unicodedata

    docs = []
    for t in texts:
        t = "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))
        w = re.findall(r"\b\w\w+\b", t)
        docs.append(w + [" ".join(p) for p in zip(w, w[1:])])
    terms = sorted({t for d in docs for t in d})
    df = {t: sum(t in d for d in docs) for t in terms}
    terms = [t for t in terms if df[t] >= min_df]
    x = np.array([[d.count(t) * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t in terms] for d in docs])
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return terms, x / np.where(norms == 0, 1, norms)


def _texts_and_labels(spark):
    return spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(zip(TEXTS, Y))], "k int, text string, label int")


@pytest.mark.parametrize("options", [{}, {"held": 2}, {"id_bits": 3}])
@pytest.mark.parametrize("most", [1 << 22, 1])
def test_tfidf_and_f(spark, options, most):
    """Also with few terms held, with ids that clash, and with a table too large for the tasks."""
    docs = _texts_and_labels(spark)
    table = ngrams.fit_terms(docs, **options)
    assert table.n_docs == 6 and bool(table.exceptions) == ("id_bits" in options)
    assert table.table.select("id").distinct().count() == table.table.count()
    known = [t for t in docs.collect()] if "id_bits" in options else None
    weighed = ngrams.tfidf_terms(docs, table, ["k", "label"], most=most)
    terms, x = _tfidf(TEXTS)
    if known is None:  # with three bits most unknown terms share a known one's id
        got = {(r.k, r.term): r.weight for r in ngrams.named_terms(weighed, table, "k").collect()}
        assert got == pytest.approx({(i, t): x[i, j] for i in range(6) for j, t in enumerate(terms) if x[i, j] > 0})
        f = {r.term: r.f_score for r in ngrams.anova_f(weighed, table, held=3).collect()}
        y = np.array(Y)
        for j, t in enumerate(terms):
            a, b = x[y == 0, j], x[y == 1, j]
            between = len(a) * (a.mean() - x[:, j].mean()) ** 2 + len(b) * (b.mean() - x[:, j].mean()) ** 2
            within = ((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()
            assert f[t] == pytest.approx(between / (within / 4))


@pytest.mark.parametrize("most", [1 << 22, 1])
def test_clashing_ids_stay_apart(spark, most):
    """All terms are known here, so weights are right although all hashes clash."""
    docs = _texts_and_labels(spark)
    table = ngrams.fit_terms(docs, min_df=1, id_bits=2)
    terms, x = _tfidf(TEXTS, min_df=1)
    weighed = ngrams.tfidf_terms(docs, table, ["k"], most=most)
    got = {(r.k, r.term): r.weight for r in ngrams.named_terms(weighed, table, "k").collect()}
    assert got == pytest.approx({(i, t): x[i, j] for i in range(6) for j, t in enumerate(terms) if x[i, j] > 0})


def test_terms_of_training_texts_only(spark):
    docs = _texts_and_labels(spark)
    table = ngrams.fit_terms(docs.where("k < 3"), min_df=1)
    weighed = ngrams.tfidf_terms(docs, table, ["k"])
    known = {r.term for r in table.table.collect()}
    named = ngrams.named_terms(weighed, table, "k").collect()
    assert {r.term for r in named} == known and {r.k for r in named} > {0, 1, 2}
    empty = spark.createDataFrame([(1, None), (2, ""), (3, "unheard of")], "k int, text string")
    assert [(r.k, r.ids, r.tfs, r.weights) for r in ngrams.tfidf_terms(empty, table, ["k"]).orderBy("k").collect()] == [(k, [], [], []) for k in (1, 2, 3)]
    assert sorted((r.k, r.ids) for r in ngrams.tfidf_terms(empty, table, ["k"], most=0).collect()) == [(1, []), (2, []), (3, [])]
    nothing = ngrams.fit_terms(docs.limit(0))
    assert nothing.n_docs == 0 and nothing.table.count() == 0
    assert ngrams.tfidf_terms(empty, nothing, ["k"]).where("size(ids) > 0").count() == 0


@pytest.mark.parametrize("most", [0, 3])
def test_rare_terms_are_asked_for_once_a_chunk(spark, most, monkeypatch):
    """A large table: no row per text and term, several groups of terms, several rows of one key."""
    monkeypatch.setattr(ngrams, "ASKED_TERMS", 2)
    docs = spark.createDataFrame([(None if i % 2 else 1, t) for i, t in enumerate([*TEXTS, *TEXTS, None, ""])], "k int, text string")
    table = ngrams.fit_terms(docs)
    few = ngrams.tfidf_terms(docs, table, ["k"], most=most)
    assert "Generate" not in few._jdf.queryExecution().optimizedPlan().toString()

    def listed(df):
        return sorted(((r.k or 0, sorted(zip(r.ids, r.tfs, (round(w, 9) for w in r.weights)))) for r in df.collect()), key=repr)

    assert listed(few) == listed(ngrams.tfidf_terms(docs, table, ["k"]))
    often, rare, n = ngrams.frequent_terms(table, 3)
    assert len(often.ids) <= 3 and n == rare.count() == table.table.count() - len(often.ids)


def test_chunks_of_a_batch_come_in_any_order():
    """A task reads files in any order, so the chunks of a batch need not rise."""
    nothing = ngrams.Known(np.empty(0, np.int64), np.empty(0), {}, ngrams.ID_BITS)
    batch = pa.RecordBatch.from_arrays([pa.array([7, 7, 2, 5]), pa.array(["aa", "bb", "cc", "dd"])], ["__chunk", "__text"])
    asked = [pa.Table.from_batches([b]) for b in ngrams._asked(iter([batch]), SimpleNamespace(value=nothing), 1)]
    ids = {t: ngrams._numbers(*ngrams.count_batch(pa.array([t])), nothing)[1][0] for t in ("aa", "bb", "cc", "dd")}
    got = [(chunk, set(i)) for t in asked for chunk, i in zip(t.column("__chunk").to_pylist(), t.column("ids").to_pylist())]
    assert got == [(7, {ids["aa"], ids["bb"]}), (2, {ids["cc"]}), (5, {ids["dd"]})]


def test_accents_ligatures_and_syllables():
    assert ngrams.terms_of("\u00c4\u00e9 \ufb01n x yz_1") == ["ae", "fin", "yz_1", "ae fin", "fin yz_1"]
    assert ngrams.bare_text("\uac00") == "\u1100\u1161" and ngrams.bare_text("a\U0001d165b") == "ab"


def test_ids_are_those_of_the_jvm(spark):
    table = ngrams.fit_terms(spark.createDataFrame([("caf\u00e9 \u65e5\u672c " + "long" * 30,)], "text string"), min_df=1)
    assert all(r.id == xxhash.xxh64_intdigest(r.term, 42) & (1 << 63) - 1 for r in table.table.collect())


ODD_TEXTS = [None, "", "a", "Hello a World_1 x-y zz zz", "\u00c4\u00e9 \ufb01n x yz_1 \u65e5\u672c \u65e5 \u65e5\u672c", "\u00e9 \u1d2c\u1d2c ab ab ab ab", "x" * 40 + " " + "y" * 50 + " x", "\u0130stanbul \u212a\u212a", "ab\x00cd\tef", " lead", "trail ", "\u0663\u0664 ab", "\u00e9 \u65e5 \u00df \u201cab\u201d\u2013\u00bdcd \u00dfs", "a\u0301\u0323b\U0001d165 \u1e9b\u0323x \uac00 \ud55c\uae00"]


def test_many_slices_are_hashed_as_one_by_one():
    rnd = np.random.default_rng(5)
    data = np.concatenate((rnd.integers(0, 256, 500, dtype=np.uint8), np.zeros(slices.PAD, np.uint8)))
    starts, lengths = rnd.integers(0, 400, 900), np.arange(900) % 100
    expected = [xxhash.xxh64_intdigest(data[a : a + n].tobytes(), 42) for a, n in zip(starts, lengths)]
    assert slices.xxh64(data, starts, lengths).tolist() == expected
    assert slices.joined(data, starts, lengths).tobytes() == b"".join(data[a : a + n].tobytes() for a, n in zip(starts, lengths))
    copy = np.concatenate((data, data))
    assert slices.equal(copy, starts, starts + len(data), lengths)
    copy[len(data) + starts[99] + 98] ^= 1
    assert not slices.equal(copy, starts[99:100], starts[99:100] + len(data), lengths[99:100])


@pytest.mark.parametrize("clash", [False, True])
@pytest.mark.parametrize("block", [1, 1 << 17])
def test_texts_are_counted_in_arrays(monkeypatch, clash, block):
    """Also where texts end a block, and where all terms have one hash."""
    monkeypatch.setattr(ngrams, "BLOCK_BYTES", block)
    if clash:
        monkeypatch.setattr(slices, "xxh64", lambda data, starts, lengths: np.full(len(starts), 7, np.uint64))
    expected = [[*ngrams.Counter(ngrams.terms_of(t)).items()] for t in ODD_TEXTS]
    for texts in (pa.array(ODD_TEXTS), pa.array([ngrams.bare_bytes(t) for t in ODD_TEXTS], pa.binary()), pa.array(ODD_TEXTS[:3])):
        counted, ends = ngrams.count_batch(texts)
        got = [*zip(counted.terms(), counted.tfs.tolist())]
        assert [got[a:b] for a, b in zip(ends, ends[1:])] == expected[: len(texts)]


@pytest.mark.parametrize("clash", [False, True])
@pytest.mark.parametrize("held", [1, 9, 1 << 20])
def test_terms_are_sent_and_added_up_in_arrays(monkeypatch, clash, held):
    """Rows per group of terms, not per term; a group goes on over batches."""
    if clash:
        monkeypatch.setattr(slices, "xxh64", lambda data, starts, lengths: np.full(len(starts), 7, np.uint64))
    monkeypatch.setattr(ngrams, "SENT_GROUPS", 4)
    texts = [*ODD_TEXTS, *ODD_TEXTS[3:]]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 5], pa.string())], ["text"]) for i in range(0, len(texts), 5)]
    rows = pa.Table.from_batches(ngrams._distinct_terms(iter(batches), held, 63))
    assert rows.num_rows <= 4 * (len(batches) + 1)
    batches = rows.sort_by("group").combine_chunks().to_batches(max_chunksize=1)
    got = pa.Table.from_batches(ngrams._added_up(iter(batches), 2, held, 63)).to_pylist()
    counts = ngrams.Counter(t for text in texts for t in set(ngrams.terms_of(text)))
    assert sum(r["df"] for r in got if r["term"] is None) == len(texts)
    assert {r["term"]: r["df"] for r in got if r["term"] is not None} == {t: n for t, n in counts.items() if n > 1}
    assert all(r["shared"] == clash for r in got if r["term"] is not None)


def test_first_sums_are_made_where_texts_are_weighed(spark, monkeypatch):
    """A large term table: what is staged for the first sums is made where the texts are weighed."""
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 3} x{i % 5}") for i in range(40)], "k int, text string")
    terms = ngrams.fit_terms(docs, min_df=1)
    weights = spark.createDataFrame([(m, r.term, 0.5) for r in terms.table.collect() for m in "ab"], "model_id string, term string, coefficient double")
    models, plans = classify.linear_models(weights, terms), []
    monkeypatch.setattr(classify, "materialise", lambda df, run=classify.materialise: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), run(df))[1])
    assert classify.ensemble_scores(models, docs, "k", most=3, most_weights=4).count() == 80
    assert sum("InArrow" in line for line in plans[-1].splitlines()) <= 3 and "tfs" not in plans[-1]


def test_counted_candidates_give_the_same_families(spark, pubs, research, rows):
    listed = spark.createDataFrame([("p1",), ("p5",)], "publication_number string")
    long_way = candidates.family_candidates(candidates.all_candidates(research, listed, ["two"], ["A/"]), pubs)
    counted = candidates.counted_candidates(research, listed, ["two"], ["A/"])
    assert counted.count() == counted.select("publication_number", "match").distinct().count()
    assert rows(candidates.candidate_families(counted, pubs, research)) == rows(long_way)


def test_sequences_of_repeated_keys_stay_apart(spark):
    docs = spark.createDataFrame([(1, "a b a"), (1, "b b"), (2, "")], "k int, text string")
    numbered = features.number_words(docs, ["k"], held=1)
    sequences = features.word_sequences(numbered, features.fit_vocabulary(numbered, top_k=9))
    assert sorted((r.k, r.sequence) for r in sequences.collect()) == [(1, [1, 1]), (1, [2, 1, 2]), (2, [])]


def test_sequences(spark):
    docs = spark.createDataFrame([(1, "a b, A c!"), (2, "b"), (3, ""), (4, None), (5, "zzz c")], "k int, text string")
    numbered = features.number_words(docs, ["k"])
    vocabulary = features.fit_vocabulary(numbered, top_k=4)
    assert [tuple(r) for r in vocabulary.orderBy("index").collect()] == [("a", 1), ("b", 2), ("c", 3)]
    sequences = features.word_sequences(numbered, vocabulary)
    padded = features.pad_sequences(sequences, features.sequence_length(sequences, 3))
    assert {r.k: r.sequence for r in padded.collect()} == {1: [2, 1, 3], 2: [0, 0, 2], 3: [0, 0, 0], 4: [0, 0, 0], 5: [0, 0, 3]}


def test_classifier_roundtrip_and_streaming(spark, tmp_path):
    good, bad = "ledger block chain token", "cake sugar flour oven"
    train = spark.createDataFrame([(str(i), (good if i % 2 else bad) + f" w{i % 7}", i % 2) for i in range(60)], "family_id string, text string, is_seed int")
    model = classify.fit_classifier(train, "family_id", top_k=20)
    model.save(str(tmp_path / "model"))
    loaded = type(model).load(str(tmp_path / "model"))
    scored = classify.score(loaded, train.select("family_id", "text"), "family_id")
    metrics = classify.class_metrics(scored.join(train.withColumnRenamed("is_seed", "label"), "family_id")).first()
    assert metrics.binary_accuracy == metrics.precision == metrics.recall == 1.0 and metrics.loss < 0.4
    perceptron = classify.fit_classifier(train, "family_id", top_k=20, layers=2, units=4, max_iter=20)
    assert classify.score(perceptron, train, "family_id").count() == 60
    both = classify.ensemble_scores({"a": model, "b": perceptron}, train, "family_id")
    assert classify.wide_scores(both, "family_id").columns == ["family_id", "a", "b"]

    source, target = str(tmp_path / "in"), str(tmp_path / "scores")
    for _ in range(2):
        files.write_jsonl(train.select("family_id", "text"), source, mode="append")
        score_new_files(spark, loaded, source, target, str(tmp_path / "progress"), "family_id").awaitTermination()
    assert spark.read.json(target).count() == 120


@pytest.mark.parametrize("layers", [1, 2, 3])
def test_scores_are_those_of_spark_ml(spark, layers):
    """The forward pass against the transform of the fitted model, and scoring past the broadcast limits."""
    rnd = np.random.default_rng(1)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rnd.choice(words[5 * y :], 12)) for y in rnd.integers(0, 2, 80)]
    train = spark.createDataFrame([(i, t, int("w1 " in t or "w2 " in t)) for i, t in enumerate(texts)] + [(99, "no label", None)], "k int, text string, is_seed int")
    model = classify.fit_classifier(train, "k", layers=layers, units=3, top_k=30, max_iter=30)
    got = {r.k: r.score for r in classify.score(model, train, "k").collect()}
    weighed = ngrams.tfidf_terms(train, model.terms, ["k"]).withColumn("label", F.col("k"))
    design = classify.sparse_design(weighed, model.ids)
    flat = [Vectors.dense(np.concatenate([np.concatenate((w.ravel(), b)) for w, b in model.layers]))]
    if layers == 1:
        rows = {int(r.label): 1 / (1 + np.exp(-(np.dot(r.features.toArray(), model.layers[0][0][:, 0]) + model.layers[0][1][0]))) for r in design.collect()}
    else:
        shape = [len(model.ids), *[3] * (layers - 1), 2]
        refit = MultilayerPerceptronClassifier(layers=shape, maxIter=1).setInitialWeights(flat[0]).setStepSize(1e-13).setSolver("gd").fit(design.where("label < 2"))
        assert np.allclose(refit.weights.toArray(), flat[0].toArray())
        rows = {int(r.label): r.probability[1] for r in refit.transform(design).collect()}
    assert got == pytest.approx(rows) and len(got) == 81
    assert {r.k: r.score for r in classify.score(model, train, "k", most=1).collect()} == pytest.approx(got)
    pair = classify.ensemble_scores({"a": model, "b": model, "c": model}, train, "k", most_weights=model.layers[0][0].size + 1)
    assert {(r.model_id, r.k): r.score for r in pair.collect()} == pytest.approx({(m, k): s for m in "abc" for k, s in got.items()})


def test_more_terms_than_any_limit_of_the_driver(spark):
    """A fit whose term table is past the broadcast limit all the way."""
    train = spark.createDataFrame([(i, f"{'good' if i % 2 else 'bad'} w{i % 11} w{i % 13}", i % 2) for i in range(80)], "k int, text string, is_seed int")
    small, large = (classify.fit_classifier(train, "k", top_k=8, most=most) for most in (1 << 22, 3))
    assert small.ids.tolist() == large.ids.tolist() and np.allclose(small.layers[0][0], large.layers[0][0], atol=1e-6)


def test_given_linear_models(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (3, None)], "k int, text string")
    terms = ngrams.fit_terms(docs, min_df=1)
    weights = spark.createDataFrame([("m", "alpha", 2.0), ("m", "unheard", 9.0), ("m", None, -1.0), ("n", "beta", 1.0), ("o", None, 0.5)], "model_id string, term string, coefficient double")
    got = {(r.model_id, r.k): r.score for r in classify.ensemble_scores(classify.linear_models(weights, terms), docs, "k").collect()}
    a, b = math.log(4 / 3) + 1, math.log(4 / 2) + 1
    length = math.sqrt(a * a + 2 * b * b)
    s = lambda x: 1 / (1 + math.exp(-x))
    expected = {("m", 1): s(2 * a / length - 1), ("m", 2): s(1.0), ("m", 3): s(-1.0), ("n", 1): s(b / length), ("n", 2): 0.5, ("n", 3): 0.5, **{("o", k): s(0.5) for k in (1, 2, 3)}}
    assert got == pytest.approx(expected)


@pytest.mark.parametrize(("most", "most_weights"), [(1 << 22, 40), (1 << 22, 0), (3, 40), (3, 1 << 22)])
def test_weights_of_linear_models_stay_a_table(spark, monkeypatch, most, most_weights):
    """Scores do not depend on what travels, and what reaches the driver does not grow with the weights."""
    rnd = np.random.default_rng(3)
    docs = spark.createDataFrame([(None if i == 5 else i % 90, " ".join(f"w{w}" for w in rnd.geometric(0.05, 9)) if i % 11 else None) for i in range(120)], "k int, text string").repartition(3)
    terms = ngrams.fit_terms(docs, min_df=1)
    rows = [(f"m{m}", r.term, float(rnd.normal())) for m in range(7) for r in terms.table.orderBy("term").collect() if (m + len(r.term)) % 3]
    weights = spark.createDataFrame([*rows, *rows[:4], ("m1", None, 0.5), ("only", None, -0.5), ("m2", "unheard", 9.0)], "model_id string, term string, coefficient double")
    own = {}
    for m, term, x in [*rows, *rows[:4]]:
        own[m, term] = own.get((m, term), 0.0) + x
    expected = []
    names, idf = [*[f"m{m}" for m in range(7)], "only"], {r.term: r.idf for r in terms.table.collect()}
    for k, text in docs.collect():
        n = ngrams.Counter(ngrams.terms_of(text))
        length = math.sqrt(sum((c * idf[w]) ** 2 for w, c in n.items())) or 1.0
        for m in names:
            s = sum(c * idf[w] / length * own.get((m, w), 0.0) for w, c in n.items()) + {"m1": 0.5, "only": -0.5}.get(m, 0.0)
            expected.append((m, -1 if k is None else k, 1 / (1 + math.exp(-s))))
    gathered = []
    monkeypatch.setattr(type(docs), "toArrow", lambda df, run=type(docs).toArrow: (gathered.append(table := run(df)), table)[1])
    models = classify.linear_models(weights, terms)
    assert not gathered and sorted(models) == names
    scores = classify.ensemble_scores(models, docs, "k", most=most, most_weights=most_weights or 1)
    assert max([t.num_rows for t in gathered if "columns" in t.column_names]) * 4 <= most_weights + 8
    got = sorted((r.model_id, -1 if r.k is None else r.k, r.score) for r in scores.collect())
    assert [g[:2] for g in got] == [e[:2] for e in sorted(expected)] and np.allclose([g[2] for g in got], [e[2] for e in sorted(expected)])
    assert models["only"].ids.tolist() == [] and len(models["m1"].ids) == len({t for m, t in own if m == "m1"})


def test_meta_of_a_fitted_model_is_read_back(spark, tmp_path):
    scored = spark.createDataFrame([(1, 0.9), (0, 0.2), (0, 0.6)], "label int, score double")
    metrics = classify.class_metrics(scored)
    classify.write_meta(metrics, str(tmp_path), "tech", "7", "mlp")
    back = {(r.technology, r.uid, r.architecture, r.metric): r.value for r in files.read_metas(spark, f"{tmp_path}/*/model-best").collect()}
    assert back == {("tech", "7", "mlp", name): value for name, value in metrics.first().asDict().items()}


def test_foreign_model_is_loaded_once_by_a_worker(spark):
    df = spark.range(64).select(F.col("id").alias("k"), F.lit("x").alias("text")).repartition(16)

    def load():
        import os
        import random

        mine = os.getpid() + random.SystemRandom().random()
        return lambda texts: texts.map(lambda _: mine)

    scores = {r.score for _ in range(3) for r in classify.score_with(df, "k", load, name="own").collect()}
    assert len(scores) == len({int(x) for x in scores})  # one load for each process
    assert len({r.score for _ in range(3) for r in classify.score_with(df, "k", load).collect()}) == 48


def test_foreign_model(spark, rows):
    df = spark.createDataFrame([(1, "aa"), (2, None)], "k int, text string")

    def load():
        return lambda texts: texts.str.len() / 10.0

    assert rows(classify.score_with(df, "k", load)) == [(1, 0.2), (2, 0.0)]


def test_metrics_edges(spark):
    df = spark.createDataFrame([(0, 0.2), (1, 0.3), (None, 0.9)], "label int, score double")
    m = classify.class_metrics(df).first()
    assert (m.binary_accuracy, m.precision, m.recall) == (0.5, 0.0, 0.0)
    half = spark.createDataFrame([(1, 0.5, "t"), (0, 0.5, "u"), (0, 0.6, "v")], "label int, score double, text string")
    assert classify.class_metrics(half).first().recall == 1.0
    assert sorted(r.error + r.text for r in classify.error_report(half).collect()) == ["false_negativet", "false_positivev"]


@pytest.mark.parametrize("n", [1, 2, 5, 1000, 50_001])
def test_large_summary_is_exact(spark, n):
    values = np.random.default_rng(n).lognormal(size=n).round(3 if n == 1000 else 12)
    values[: n // 3] = values[0]  # a third of all rows share one value
    pdf = pd.DataFrame({"g": np.where(np.arange(n) % 2, "a", "b"), "v": values})
    df = spark.createDataFrame(pdf).repartition(6)
    small = {r.g: r for r in summary.describe(df, "v", ["g"]).collect()}
    for row in summary.describe_large(df, "v", ["g"]).collect():
        expected = pdf[pdf.g == row.g].v.describe()
        assert [row["min"], row.p25, row.p50, row.p75, row["max"]] == pytest.approx(
            [expected[k] for k in ("min", "25%", "50%", "75%", "max")], rel=1e-12
        )
        assert row["count"] == expected["count"] and row["mean"] == pytest.approx(expected["mean"])
        assert (row["std"] is None) == math.isnan(expected["std"])
        assert row.p50 == pytest.approx(small[row.g].p50)
    assert summary.describe_large(df, "v").first()["count"] == n


def test_consensus_keeps_real_votes(spark, rows):
    scores = [(f"m{m}", k, 0.9 if m < votes else 0.1) for k, votes in enumerate([0, 1, 1, 3]) for m in range(4)]
    df = spark.createDataFrame([("cnn", *x) for x in scores], "architecture string, model_id string, k int, score double")
    got = rows(ensembles.consensus(df, "k"), "nb_models", "nb_positives", "cumshare_positives")
    assert got == [(0, 0, 1.0), (1, 2, 1.0), (3, 3, 0.6)]


def test_representative_model(spark):
    rnd = np.random.default_rng(1)
    base = rnd.random(200)
    pdf = pd.concat(
        [
            pd.DataFrame({"architecture": "mlp", "model_id": m, "k": range(200), "score": v})
            for m, v in {"a": base, "b": base + rnd.random(200) * 0.2, "c": rnd.random(200), "d": np.full(200, 0.5)}.items()
        ]
    )
    df = spark.createDataFrame(pdf)
    wide = pdf.pivot(index="k", columns="model_id", values="score")
    expected = wide.corr().mean()
    got = {r.model_id: r.mean_corr for r in ensembles.representativeness(df, "k", list("abcd")).collect()}
    assert got["d"] is None
    assert {m: got[m] for m in "abc"} == pytest.approx({m: expected[m] for m in "abc"})
    assert ensembles.most_representative(df, "k", list("abcd")).first().model_id == expected.idxmax()


def test_densify_and_weights(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 5), ("b", 4), ("", 50), (None, 60), ("c", 3)], "g string, v int")
    got = rows(stats.densify(df, "g", F.sum("v"), 2).groupBy("g").agg(F.sum("v")))
    assert got == [("a", 6), ("b", 4), ("others", 113)]
    entities = spark.createDataFrame([("p", "x", "US"), ("p", None, "FR"), ("q", None, None)], "publication_number string, inventor_name string, inventor_country string")
    facts = spark.createDataFrame([("p", 2001)], "publication_number string, publication_year int")
    weights = stats.entity_weights(entities, facts, "inventor")
    assert rows(weights, "publication_number", "nb_inventor") == sorted([("p", 0.5), ("p", 0.5), ("q", None)], key=repr)


def test_normalised_counts(spark, rows):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, None)], "y int, c string")
    assert rows(stats.normalised_counts(df, ["y", "c"])) == [(1, "a", 2, 2 / 3), (1, "b", 1, 1 / 3), (2, "a", 1, 1.0)]
    assert rows(stats.normalised_counts(df, ["y", "c"], norm_axis=1)) == [(1, "a", 2, 1.0), (1, "b", 1, 1.0), (2, "a", 1, 0.5)]


@pytest.mark.parametrize("block", [512, 3])
def test_correlations_against_pandas(spark, block):
    """Missing, repeated, constant and null scores, a null group, and models in several blocks."""
    rnd = np.random.default_rng(6)
    rows = [(g, f"m{m}", k, float(rnd.normal() * (m + 1) + 1e6)) for g in ("x", "y", None) for m in range(8) for k in range(40) if rnd.random() < 0.8 and (g, m) != ("y", 7)]
    rows += [("x", "flat", k, 0.3) for k in range(40)] + [("x", "once", 1, 0.5), ("x", "m0", 99, None), ("x", "m1", 99, float("nan")), ("x", "m2", 3, -1e9)]
    df = spark.createDataFrame(rows, "architecture string, model_id string, k int, score double")
    got = {(r.architecture, r.model_a, r.model_b): r["corr"] for r in ensembles.model_correlations(df, "k", block=block).collect()}
    frame = pd.DataFrame(rows, columns=["g", "m", "k", "s"])
    expected = {}
    for g, own in [(g, frame[frame.g.isna()] if g is None else frame[frame.g == g]) for g in ("x", "y", None)]:
        corr = own.dropna(subset="s").groupby(["k", "m"]).s.max().unstack().corr()
        expected |= {(g, a, b): (None if np.isnan(corr.loc[a, b]) else corr.loc[a, b]) for a in corr for b in corr}
    assert set(got) == set(expected)
    for pair, corr in expected.items():
        assert got[pair] == (None if corr is None else pytest.approx(corr, abs=1e-6)), pair


def test_many_models_in_one_plan(spark):
    items, models = 50, 210
    rows = spark.range(items).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(models))).alias("m"))
    rows = rows.select(F.lit("a").alias("architecture"), F.concat(F.lit("m"), "m").alias("model_id"), "k", (F.crc32(F.concat_ws(":", "k", "m").cast("binary")) % 1000).cast("double").alias("score"))
    begin = time.time()
    assert ensembles.model_correlations(rows, "k").count() == models * models
    assert time.time() - begin < 60


def test_exact_quartiles_of_anything(spark):
    values = [0.0, -0.0, 1e-308, -1e-308, 5e-324, 1.5, 1.5, 1.5, -7.25, 1e308, -1e308, float("inf"), float("-inf"), 3.0]
    rows = [(None, v) for v in values] + [("one", 2.0)] + [("same", 4.0)] * 9 + [("gone", None), ("nan", float("nan"))] + [("big", float(x)) for x in np.random.default_rng(3).normal(size=3001)]
    got = {r.g: r for r in summary.describe_large(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]).collect()}
    assert set(got) == {None, "one", "same", "big"}
    for group, row in got.items():
        own = sorted(v for g, v in rows if g == group and v is not None)
        for q, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")):
            low = math.floor(q * (len(own) - 1))
            high = min(low + 1, len(own) - 1)
            part = q * (len(own) - 1) - low
            assert row[name] == pytest.approx(own[low] + (own[high] - own[low]) * part)


def test_copies_are_written_in_parallel(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 0), ("c", None), ("d", 25), ("e", 10), ("f", -3)], "k string, n long")
    for made in (copies.written_out(rows, "n", "i", block=10), copies.spread_out(rows, "n", "i", block=10)):
        found = {}
        for r in made.collect():
            found.setdefault(r.k, []).append(r.i)
        assert {k: sorted(v) for k, v in found.items()} == {"a": [1], "d": list(range(1, 26)), "e": list(range(1, 11))}
    hot = copies.written_out(spark.createDataFrame([("hot", 10_000_000)], "k string, n long"), "n", "i")
    per_task = hot.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.count_distinct("i").alias("d")).collect()
    assert sum(r.n for r in per_task) == sum(r.d for r in per_task) == 10_000_000
    assert max(r.n for r in per_task) < 6_000_000


def test_counts_of_one_aggregation(spark, rows):
    given = [("US", 2000, "SEED"), ("US", 2000, "PC"), ("US", 2001, "PC"), ("FR", None, "PC"), ("FR", 0, "PC"), (None, 2000, "SEED"), ("DE", 2001, None)]
    counted = stats.country_date_counts(spark.createDataFrame(given, "country_code string, publication_year long, expansion_level string"))
    found = {}
    for r in counted.collect():
        found.setdefault(r.kind, {})[tuple(x for x in (r.publication_year, r.expansion_level, r.country_code) if x is not None)] = (r["count"], r.normalized_count)
    assert found["country"] == {("US",): (3, None), ("FR",): (2, None), ("DE",): (1, None)}
    assert found["year"] == {(2000,): (3, None), (2001,): (2, None)}
    assert found["year_level"] == {(2000, "SEED"): (2, None), (2000, "PC"): (1, None), (2001, "PC"): (1, None)}
    assert found["year_country"] == {(2000, "US"): (2, None), (2001, "US"): (1, None), (2001, "DE"): (1, None)}
    assert found["year_country_normalised"] == {(2000, "US"): (2, 1.0), (2001, "US"): (1, 0.5), (2001, "DE"): (1, 1.0)}
    entities = spark.createDataFrame([(2000, "A", "x", 1.0), (2000, "B", "y", 0.5), (None, "A", "x", 2.0), (2001, None, "", 4.0), (2001, "C", "z", 0.1)], "publication_year long, inventor_country string, inventor_name string, nb_inventor double")
    counts = {(r.kind, r.publication_year, r.country, r["name"]): round(r["count"], 6) for r in stats.entity_counts(entities, "inventor", n_keep=2).collect()}
    assert counts == {
        ("country", None, "A", None): 3.0, ("country", None, "B", None): 0.5, ("country", None, "others", None): 4.1,
        ("year_country", 2000, "A", None): 1.0, ("year_country", 2000, "B", None): 0.5, ("year_country", 2001, "others", None): 4.1,
        ("name", None, None, "x"): 3.0, ("name", None, None, "y"): 0.5, ("name", None, None, "others"): 4.1,
        ("year_name", 2000, None, "x"): 1.0, ("year_name", 2000, None, "y"): 0.5, ("year_name", 2001, None, "others"): 4.1,
    }


def test_smallest_text_of_a_group(spark, rows):
    wanted = spark.createDataFrame([(1, "p1"), (1, "p2"), (2, "p3"), (3, "p4"), (4, "gone")], "g int, publication_number string")
    texts = spark.createDataFrame([("p1", "b"), ("p2", "a"), ("p2", "c"), ("p3", "z"), ("p4", None)], "publication_number string, t string")
    assert rows(corpus.smallest_texts(wanted, "g", texts, F.col("t"))) == sorted([(1, "a"), (2, "z"), (3, None)], key=repr)


def test_abstract_is_the_smallest_however_alike_they_begin(spark):
    pubs = spark.createDataFrame([("p1", 1), ("p2", 1), ("p3", 1), ("p4", None), ("p5", 2)], "publication_number string, family_id int")
    texts = spark.createDataFrame([("p1", "same beginning b"), ("p2", "same beginning a"), ("p2", "same"), ("p3", "same beginning é"), ("p4", "x"), ("p5", "")], "publication_number string, abstract string")
    found = {r.publication_number: (r.abstract, r.has_abstract) for r in corpus.family_abstract(pubs, texts).collect()}
    assert found == {"p1,p2,p3": ("same", True), "p4": (None, False), "p5": (None, False)}
    late = texts.where("abstract <> 'same'")
    assert {r.abstract for r in corpus.family_abstract(pubs, late).collect()} == {"same beginning a", None}
    high = spark.createDataFrame([("p1", "\U0001f600"), ("p2", "～"), ("p3", "a")], "publication_number string, abstract string")
    assert {r.abstract for r in corpus.family_abstract(pubs, high).collect()} == {"a", None}


def test_table_sink(spark, rows):
    df = spark.createDataFrame([(i, i % 7) for i in range(100)], "k long, v long")
    name, plain = (f"sink_{uuid.uuid4().hex}" for _ in range(2))
    try:
        files.save_table(df, name, buckets=6, key="k")
        assert rows(spark.table(name)) == rows(df)
        other = spark.range(40).selectExpr("id AS k", "id AS w")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = spark.table(name).join(other, "k")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 40 and plan.count("Exchange hashpartitioning") == 1  # only the other side moves
        files.save_table(df, plain)
        files.save_table(df, plain, append=True)
        assert spark.table(plain).count() == 200
        files.save_table(df.limit(3), plain)
        assert spark.table(plain).count() == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for table in (name, plain):
            spark.sql(f"DROP TABLE IF EXISTS {table}")
