"""Candidates, annotations, training, features and models over the text corpus."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspan.functions.draws import unit_draw
from fieldspan.operators import annotations, candidates, classify, corpus, features, ngrams, training
from fieldspan.operators.expansion import MANUAL, SEED
from fieldspan.plans import corpora as c
from fieldspan.plans.corpora import KEYWORDS, OPTIONS, PREFIXES, PUB, TEXT_SQL, table, u_sql, with_ctes
from fieldspan.session import materialise, shared_dir
from fieldspan.sources import files

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _text(last: str, *names: str) -> str:
    return with_ctes(TEXT_SQL, last, *names)


# --- corpus and candidates --------------------------------------------------

@query(
    """SELECT doc_id // 3 AS family_id, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR) AS publication_number,
    min(usable) AS abstract, coalesce(min(usable) <> '', false) AS has_abstract
    FROM (SELECT doc_id, CASE WHEN lang = 'fr' OR text = '' THEN NULL ELSE text END AS usable FROM documents)
    GROUP BY doc_id // 3"""
)
def family_abstract(spark: SparkSession, d: str) -> DataFrame:
    """Documents in French have an empty abstract, so that some families have none."""
    abstract = F.when(F.col("lang") == "fr", F.lit("")).otherwise(F.col("text"))
    research = table(spark, d, "documents").select(F.col("doc_id").alias(PUB), abstract.alias("abstract"))
    return corpus.family_abstract(c.document_families(spark, d), research)


_CAND = "SELECT k AS publication_number, title, abstract, match FROM {}"


@query(_text(_CAND.format("c_similar"), "doc", "near", "c_similar"))
def candidates_similar(spark: SparkSession, d: str) -> DataFrame:
    return candidates.similar_candidates(c.documents(spark, d), c.listed_documents(spark, d))


@query(_text(_CAND.format("c_keyword"), "doc", "c_keyword"))
def candidates_keyword(spark: SparkSession, d: str) -> DataFrame:
    return candidates.keyword_candidates(c.documents(spark, d), KEYWORDS)


@query(_text(_CAND.format("c_class"), "doc", "c_class"))
def candidates_class(spark: SparkSession, d: str) -> DataFrame:
    return candidates.class_candidates(c.documents(spark, d), PREFIXES)


def _families(spark: SparkSession, d: str) -> DataFrame:
    docs = c.documents(spark, d)
    found = candidates.counted_candidates(docs, c.listed_documents(spark, d), KEYWORDS, PREFIXES)
    return candidates.candidate_families(found, c.document_families(spark, d), docs)


_FAM = ("doc", "near", "c_similar", "c_class", "c_keyword", "cand", "fam")


@query(_text("SELECT * FROM fam", *_FAM))
def candidates_family(spark: SparkSession, d: str) -> DataFrame:
    return _families(spark, d)


@query(
    _text(
        f"""SELECT fam.*, nb_bin, (SELECT count(*) FROM fam) AS nb_total FROM fam
        JOIN (SELECT match, count(*) AS nb_bin FROM fam GROUP BY match) USING (match)
        WHERE {u_sql(5, "family_id || ':' || publication_number")} < 50.0::DOUBLE / nb_bin""",
        *_FAM,
    )
)
def candidates_sample(spark: SparkSession, d: str) -> DataFrame:
    return candidates.sample_candidates(_families(spark, d), size_bin=50, draw_seed=5)


# --- annotations ------------------------------------------------------------

def _records(spark: SparkSession, d: str) -> DataFrame:
    """Annotated documents: quality is the answer, toxic picks a second option, unlabelled is ignore."""
    labels = table(spark, d, "labels")
    accept = F.when(F.col("toxic") == 1, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(1)))
    answer = F.when(F.col("quality") == 1, "accept").when(F.col("quality") == 0, "reject").otherwise("ignore")
    docs = table(spark, d, "documents").select("doc_id", "text").join(labels, "doc_id", "left")
    return docs.select(F.col("doc_id").alias("family_id"), "text", answer.alias("answer"), accept.alias("accept"))


_RECORDS_SQL = """SELECT d.doc_id AS family_id, d.text, CASE quality WHEN 1 THEN 'accept' WHEN 0 THEN 'reject'
    ELSE 'ignore' END AS answer, CASE WHEN toxic = 1 THEN '0,2' ELSE '1' END AS accept
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


@query(f"SELECT family_id, id, option FROM ({_RECORDS_SQL}), (VALUES {', '.join(f'({i}, {t!r})' for i, t in enumerate(OPTIONS))}) AS o(id, option)")
def annotation_options(spark: SparkSession, d: str) -> DataFrame:
    prepared = candidates.with_options(_records(spark, d), OPTIONS)
    return prepared.select("family_id", F.inline("options").alias("id", "option"))


@query(
    f"""SELECT family_id, answer, CASE accept WHEN '1' THEN '{OPTIONS[1]}' ELSE '{OPTIONS[0]},{OPTIONS[2]}' END AS accept_text,
    CASE answer WHEN 'accept' THEN '{SEED}' WHEN 'reject' THEN '{MANUAL}' END AS expansion_level FROM ({_RECORDS_SQL})"""
)
def annotation_fields(spark: SparkSession, d: str) -> DataFrame:
    prepared = candidates.with_options(_records(spark, d), OPTIONS)
    done = annotations.with_practical_fields(prepared)
    return done.select("family_id", "answer", F.array_join("accept_text", ",").alias("accept_text"), "expansion_level")


@query(
    """SELECT d.doc_id::VARCHAR AS family_id,
    CASE WHEN l.quality = 1 THEN 'again' WHEN l.quality = 0 THEN NULL ELSE 'first' END AS answer,
    d.lang AS lang, CASE WHEN l.quality IS NOT NULL THEN 'yes' END AS checked
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def annotation_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Two corrections per labelled document; the later one sets, or nulls, the answer."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    record = F.struct(F.col("doc_id").alias("family_id"), F.lit("first").alias("answer"), "lang")
    lines = docs.select(F.to_json(record).alias("value"))
    options = {"ignoreNullFields": "false"}
    key = F.col("doc_id").alias("family_id")
    early = F.struct(key, F.lit("early").alias("answer"), F.lit("no").alias("lang"))
    late = F.struct(key, F.when(F.col("quality") == 1, F.lit("again")).alias("answer"), F.lit("yes").alias("checked"))
    versions = F.array(
        F.struct(F.lit(1).alias("position"), F.to_json(early).alias("value")),
        F.struct(F.lit(2).alias("position"), F.to_json(late, options).alias("value")),
    )
    corrected = annotations.correct_annotations(lines, labels.select(F.inline(versions)))
    return corrected.select(*[F.col("fields")[name].alias(name) for name in ("family_id", "answer", "lang", "checked")])


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Training documents as JSON lines: toxic ones are cut short, some lack a text or a label."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    text = F.when(F.col("lang") != "es", F.col("text"))
    record = F.to_json(F.struct(text.alias("text"), F.col("quality").alias("is_seed")))
    cut = F.when(F.col("toxic") == 1, F.expr("left(line, length(line) - 2)")).otherwise(F.col("line"))
    return docs.withColumn("line", record).select("doc_id", cut.alias("value"))


@query(
    """SELECT d.doc_id::VARCHAR AS family_id, CASE WHEN quality = 1 THEN 'accept' WHEN quality = 0 THEN 'reject' END AS answer,
    ['kept', lang] AS accept_text, length(text)::BIGINT AS nb_total, text FROM documents d
    LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE coalesce(toxic, 0) <> 1"""
)
def load_annotated(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as JSON lines, those labelled toxic cut short, and loaded again."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    answer = F.when(F.col("quality") == 1, "accept").when(F.col("quality") == 0, "reject")
    fields = F.struct(
        F.col("doc_id").cast("string").alias("family_id"), answer.alias("answer"), F.array(F.lit("kept"), "lang").alias("accept_text"),
        F.length("text").alias("nb_total"), "text", F.lit("not asked for").alias("unknown"),
    )
    line = F.to_json(fields)
    lines = docs.select(F.when(F.coalesce(F.col("toxic"), F.lit(0)) == 1, F.substring(line, 1, 20)).otherwise(line).alias("value"))
    folder = f"{shared_dir(spark)}/annotated-{uuid.uuid4().hex}"
    lines.write.text(folder)
    loaded = files.load_annotated(spark, folder, max_bad_records=(1 << 31) - 2)
    return loaded.select("family_id", "answer", "accept_text", "nb_total", "text")


@query("SELECT doc_id FROM labels WHERE toxic = 1")
def json_defects(spark: SparkSession, d: str) -> DataFrame:
    return annotations.json_defects(_lines(spark, d)).select("doc_id")


@query(
    """SELECT CASE WHEN lang = 'es' THEN '' ELSE text END AS text, quality AS is_seed FROM documents d
    LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE coalesce(toxic, 0) <> 1"""
)
def classifier_input(spark: SparkSession, d: str) -> DataFrame:
    return annotations.classifier_input(_lines(spark, d))


# --- training data ----------------------------------------------------------

def _training(spark: SparkSession, d: str) -> DataFrame:
    labelled = c.labelled_documents(spark, d)
    return training.training_table(labelled, c.document_corpus(spark, d), labelled, 400, "family_id", draw_seed=21)


def _even_training(spark: SparkSession, d: str) -> DataFrame:
    """As many random negatives as there are seeds, so that the strata can be balanced at any size."""
    labelled = c.labelled_documents(spark, d)
    wanted = labelled.agg(F.count_if(F.col("expansion_level") == SEED).alias("quota"))
    return training.training_table(labelled, c.document_corpus(spark, d), labelled, wanted, "family_id", draw_seed=21)


_RANDOM = f"ORDER BY {c.h_sql(21, 'doc_id')} LIMIT"
TRAIN_SQL = {
    "lab": TEXT_SQL["lab"],
    "train": f"""SELECT family_id, expansion_level, (expansion_level = '{SEED}')::INT AS is_seed, text FROM lab
        UNION ALL SELECT * FROM (SELECT doc_id AS family_id, 'ANTISEED-AF' AS expansion_level, 0 AS is_seed, text FROM documents
        WHERE text <> '' AND doc_id NOT IN (SELECT family_id FROM lab) {_RANDOM} 400)""",
    "k": f"SELECT count(*) AS k FROM train WHERE expansion_level = '{SEED}'",
    "drawn": """SELECT * FROM train, (SELECT ceil(0.5::DOUBLE * k)::BIGINT AS k FROM k)
        QUALIFY row_number() OVER (PARTITION BY expansion_level ORDER BY md5('3-balance:' || family_id)) <= k""",
    "split": """SELECT family_id, expansion_level, is_seed,
        CASE WHEN row_number() OVER (ORDER BY md5('3-test:' || family_id)) <= ceil(0.2::DOUBLE * count(*) OVER ())
        THEN 'test' ELSE 'train' END AS split FROM drawn""",
}


@query(
    with_ctes(TRAIN_SQL, """SELECT family_id, expansion_level, is_seed, is_seed AS cat_seed, 1 - is_seed AS cat_not, text
    FROM train""", "lab", "train")
)
def training_table(spark: SparkSession, d: str) -> DataFrame:
    rows = _training(spark, d)
    return rows.select(
        "family_id", "expansion_level", "is_seed", F.col("cats.SEED").alias("cat_seed"), F.col("cats.NOT_SEED").alias("cat_not"), "text"
    )


def _text_expansion(spark: SparkSession, d: str) -> DataFrame:
    """An expansion over the documents: labelled ones and those of some sources."""
    labelled = c.labelled_documents(spark, d).select("family_id", "expansion_level")
    near = table(spark, d, "documents").filter(F.col("source").isin("src1", "src2", "src3"))
    return labelled.unionByName(near.select(F.col("doc_id").alias("family_id"), F.lit("PC").alias("expansion_level")))


@query(
    f"""SELECT doc_id AS family_id, 'PC' AS expansion_level, text FROM documents
    WHERE source IN ('src1', 'src2', 'src3') AND text NOT IN ('', chr(10), chr(10) || chr(10))
    ORDER BY {c.h_sql(8, 'doc_id')} LIMIT 100"""
)
def expansion_extract(spark: SparkSession, d: str) -> DataFrame:
    return training.expansion_texts(
        _text_expansion(spark, d), c.document_corpus(spark, d), "family_id", sample_size=100, draw_seed=8
    )


_EVEN = {**TRAIN_SQL, "train": TRAIN_SQL["train"].replace(
    f"{_RANDOM} 400", f"{_RANDOM} (SELECT count(*) FROM lab WHERE expansion_level = '{SEED}')"
)}


@query(with_ctes(_EVEN, "SELECT family_id, expansion_level, is_seed, split FROM split"))
def split_balanced(spark: SparkSession, d: str) -> DataFrame:
    parts = training.split_train_test(_even_training(spark, d), "family_id", 0.2, seed_share=0.5, draw_seed=3)
    return parts.select("family_id", "expansion_level", "is_seed", "split")


# The share of test rows for the seeds at hand, as in the plan below.
_SHARE_SQL = """CASE WHEN n_seed >= 250 THEN 0.2::DOUBLE
    WHEN n_seed >= 100 THEN 0.5::DOUBLE - (n_seed - 100) / 150::DOUBLE * 0.3::DOUBLE END"""
_SIZE_SQL = """CASE WHEN n_seed >= 250 THEN floor(n_seed / 0.2::DOUBLE)
    WHEN n_seed >= 100 THEN floor(n_seed / (0.1::DOUBLE + (n_seed - 100) / 150::DOUBLE * 0.1::DOUBLE)) END::BIGINT"""


@query(
    f"""WITH lab AS ({TEXT_SQL['lab']}), n AS (SELECT count(*) AS n, count(*) FILTER (expansion_level = '{SEED}') AS n_seed FROM lab)
    SELECT family_id, (expansion_level <> '{SEED}')::INT AS label,
    CASE WHEN row_number() OVER (ORDER BY md5('4-share:' || family_id)) <= ceil(n * {_SHARE_SQL}) THEN 'test' ELSE 'train' END AS split
    FROM lab, n"""
)
def split_share(spark: SparkSession, d: str) -> DataFrame:
    labelled = c.labelled_documents(spark, d).select("family_id", "expansion_level")
    return training.split_by_share(labelled, "family_id", draw_seed=4).drop("expansion_level")


@query(
    f"""SELECT technology, n_seed, {_SIZE_SQL} AS antiseed_size, round({_SHARE_SQL}, 6) AS share_test, n_seed < 100 AS too_small
    FROM (SELECT c_mktsegment || '-' || c_nationkey % 3 AS technology, count(*) FILTER (c_acctbal > 1000) AS n_seed
          FROM customer GROUP BY 1)"""
)
def sampling_plan(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("c_mktsegment", F.lit("-"), (F.col("c_nationkey") % 3).cast("string"))
    level = F.when(F.col("c_acctbal") > 1000, F.lit(SEED)).otherwise(F.lit(MANUAL))
    labelled = table(spark, d, "customer").select(name.alias("technology"), level.alias("expansion_level"))
    return training.sampling_plan(labelled).withColumn("share_test", F.round("share_test", 6))


# --- features ---------------------------------------------------------------

FEATURE_SQL = {
    "bare": "SELECT doc_id AS k, strip_accents(lower(text)) AS t FROM documents",
    "words": r"SELECT k, regexp_extract_all(t, '[\p{L}\p{N}_]{2,}') AS w FROM bare",
    "terms": """SELECT k, unnest(w) AS term FROM words UNION ALL
        SELECT k, unnest(list_transform(list_zip(w[1:len(w) - 1], w[2:]), lambda p: p[1] || ' ' || p[2])) FROM words""",
    "tc": "SELECT k, term, count(*) AS tf FROM terms GROUP BY k, term",
    "idf": """SELECT term, count(*) AS df, ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf
        FROM tc GROUP BY term HAVING count(*) >= 2""",
    "raw": "SELECT k, term, tf, tf * idf AS x FROM tc JOIN idf USING (term)",
    "w": "SELECT k, term, tf, x / sqrt(sum(x * x) OVER (PARTITION BY k)) AS weight FROM raw",
    "ys": "SELECT doc_id AS k, quality AS y FROM labels JOIN documents USING (doc_id)",
    "n": "SELECT count(*) FILTER (y = 0)::DOUBLE AS n0, count(*) FILTER (y = 1)::DOUBLE AS n1 FROM ys",
    "sums": """SELECT term, sum(CASE WHEN y = 0 THEN weight ELSE 0 END) AS s0, sum(CASE WHEN y = 1 THEN weight ELSE 0 END) AS s1,
        sum(weight * weight) AS q FROM w JOIN ys USING (k) GROUP BY term""",
    "f": """SELECT term, (s0*s0/n0 + s1*s1/n1 - (s0+s1)*(s0+s1)/(n0+n1)) /
        ((q - s0*s0/n0 - s1*s1/n1) / (n0 + n1 - 2)) AS f_score FROM sums, n""",
}


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", c.text_partitions(spark)).select("doc_id", "text")


def _weights(spark: SparkSession, d: str) -> DataFrame:
    texts = _texts(spark, d)
    return ngrams.tfidf_terms(texts, ngrams.fit_terms(texts), ["doc_id"])


def _per_text(weights: DataFrame) -> DataFrame:
    """Number of terms, words and sums of each text that has a term."""
    total = F.aggregate("weights", F.lit(0.0), lambda s, w: s + w)
    return weights.where(F.size("ids") > 0).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_terms"),
        F.aggregate("tfs", F.lit(0).cast("long"), lambda s, n: s + n).alias("n_words"),
        F.round(total, 6).alias("total"),
        F.round(F.array_max("weights"), 6).alias("top"),
    )


@query(with_ctes(FEATURE_SQL, "SELECT term, df, round(idf, 6) AS idf FROM idf", "bare", "words", "terms", "tc", "idf"))
def tfidf_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return ngrams.fit_terms(_texts(spark, d)).table.select("term", "df", F.round("idf", 6).alias("idf"))


_PER_TEXT_SQL = """SELECT k AS doc_id, count(*) AS n_terms, sum(tf)::BIGINT AS n_words, round(sum(weight), 6) AS total,
        round(max(weight), 6) AS top FROM w GROUP BY k"""


@query(with_ctes(FEATURE_SQL, _PER_TEXT_SQL, "bare", "words", "terms", "tc", "idf", "raw", "w"))
def tfidf_terms(spark: SparkSession, d: str) -> DataFrame:
    """Weights of all terms of all documents, summed up per document."""
    return _per_text(_weights(spark, d))


_TRAIN = u_sql(17, "doc_id") + " < 0.6::DOUBLE"
_HELD_OUT_SQL = {**FEATURE_SQL, "idf": f"""SELECT term, count(*) AS df,
        ln((1.0::DOUBLE + (SELECT count(*) FROM documents WHERE {_TRAIN})) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf
        FROM tc WHERE {_TRAIN.replace("doc_id", "k")} GROUP BY term HAVING count(*) >= 2"""}


@query(
    with_ctes(
        {**_HELD_OUT_SQL, "raw": FEATURE_SQL["raw"] + f" WHERE NOT ({_TRAIN.replace('doc_id', 'k')})"},
        _PER_TEXT_SQL, "bare", "words", "terms", "tc", "idf", "raw", "w",
    )
)
def tfidf_held_out(spark: SparkSession, d: str) -> DataFrame:
    """Terms and idf of the training texts, applied to the others: terms that only these have drop."""
    texts = _texts(spark, d)
    drawn = unit_draw(17, "doc_id") < 0.6
    return _per_text(ngrams.tfidf_terms(texts.where(~drawn), ngrams.fit_terms(texts.where(drawn)), ["doc_id"]))


@query(
    with_ctes(
        FEATURE_SQL,
        "SELECT term, round(f_score, 6) AS f_score FROM f ORDER BY round(f_score, 6) DESC NULLS LAST, term LIMIT 5000",
    )
)
def anova_f_topk(spark: SparkSession, d: str) -> DataFrame:
    """Terms of all documents; weights and sums of the labelled ones only."""
    texts = _texts(spark, d)
    terms = ngrams.fit_terms(texts)
    labelled = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    weights = ngrams.tfidf_terms(texts.join(labelled, "doc_id"), terms, ["label"])
    return ngrams.top_terms(ngrams.anova_f(weights, terms)).select("term", "f_score")


_SPLIT = r"""[!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~\t\n ]+"""
_SEQ_SQL = {
    "w": f"SELECT doc_id AS k, list_filter(regexp_split_to_array(lower(text), '{_SPLIT}'), lambda x: x <> '') AS w FROM documents",
    "vocab": """SELECT word, row_number() OVER (ORDER BY n DESC, word) AS i FROM (
        SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM w) GROUP BY word ORDER BY n DESC, word LIMIT 999)""",
    "pos": "SELECT k, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w",
    "seq": "SELECT k, list(i ORDER BY p) AS s FROM pos JOIN vocab USING (word) GROUP BY k",
    "m": "SELECT least(max(len(s)), 250) AS m FROM seq",
    "cut": """SELECT w.k, coalesce(s, []) AS s, m, coalesce(len(s), 0) AS n FROM w LEFT JOIN seq ON w.k = seq.k, m""",
}


@query(
    with_ctes(
        _SEQ_SQL,
        """SELECT k AS doc_id, array_to_string(list_concat(
        list_transform(range(greatest(m - n, 0)), lambda x: 0), s[greatest(n - m, 0) + 1:]), ',') AS sequence FROM cut""",
    )
)
def sequence_encode(spark: SparkSession, d: str) -> DataFrame:
    numbered = features.number_words(_texts(spark, d), ["doc_id"])
    sequences = materialise(features.word_sequences(numbered, features.fit_vocabulary(numbered, top_k=1000)))
    padded = features.pad_sequences(sequences, features.sequence_length(sequences))
    return padded.select("doc_id", F.array_join("sequence", ",").alias("sequence"))


# --- models -----------------------------------------------------------------

def _seed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Training rows: labelled documents, those of lower quality and unlabelled ones of a source as negatives."""
    return _training(spark, d).select("family_id", "text", "is_seed")


@query()
def classifier_scores(spark: SparkSession, d: str) -> DataFrame:
    """A model fitted on the training table scores every document."""
    model = classify.fit_classifier(_seed_rows(spark, d), "family_id")
    docs = _texts(spark, d).withColumnRenamed("doc_id", "family_id")
    return classify.score(model, docs, "family_id").withColumn("score", F.round("score", 4))


GIVEN_MODELS = [f"{a}-{m}" for a in c.ARCHITECTURES for m in c.MODELS]
_COEFFICIENT = u_sql(23, "model_id || ':' || term")


@query(
    with_ctes(
        {
            **_HELD_OUT_SQL,
            "models": f"SELECT unnest({GIVEN_MODELS}) AS model_id",
            "coefs": f"""SELECT model_id, term, 8 * {_COEFFICIENT} - 4 AS coefficient FROM idf, models WHERE df >= 20 AND {_COEFFICIENT} < 0.75""",
            "chosen": "SELECT k, model_id, sum(weight * coefficient) AS s FROM w JOIN coefs USING (term) GROUP BY ALL",
        },
        """SELECT model_id, doc_id, round(1 / (1 + exp(-(coalesce(s, 0) + 0.25))), 6) AS score
        FROM (SELECT doc_id FROM documents) CROSS JOIN models LEFT JOIN chosen ON k = doc_id AND chosen.model_id = models.model_id""",
        "bare", "words", "terms", "tc", "idf", "raw", "w", "models", "coefs", "chosen",
    ).replace("SELECT model_id, doc_id, round", "SELECT models.model_id, doc_id, round")
)
def given_model_scores(spark: SparkSession, d: str) -> DataFrame:
    """Thirty linear models over the terms of the training texts, with given coefficients, score all documents in one scan."""
    texts = _texts(spark, d)
    terms = ngrams.fit_terms(texts.where(unit_draw(17, "doc_id") < 0.6))
    models = F.explode(F.array(*[F.lit(m) for m in GIVEN_MODELS])).alias("model_id")
    drawn = terms.table.where("df >= 20").select("term", models).withColumn("u", unit_draw(23, "model_id", "term")).where("u < 0.75")
    intercepts = spark.range(1).select(models, F.lit(None).cast("string").alias("term"), F.lit(0.25).alias("coefficient"))
    weights = drawn.select("model_id", "term", (8 * F.col("u") - 4).alias("coefficient")).union(intercepts)
    scores = classify.ensemble_scores(classify.linear_models(weights, terms), texts, "doc_id")
    return scores.select("model_id", "doc_id", F.round("score", 6).alias("score"))
