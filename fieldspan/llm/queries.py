"""Registered queries of the operators of this subpackage, with SQL twins where SQL can express them."""

from __future__ import annotations

import math
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspan.llm import bpe, chat, decontaminate, licenses, minmax, pseudo_lm, quality, ranked_terms, rotated_codes, slots, topk, turn_repair, url_trust
from fieldspan.llm.common import read
from fieldspan.session import shared_dir

#: Where the ranks of the tokenizer lie; a parameter of the operator.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = f"translate(text, '{_UPPER}', '{_LOWER}')"


def op1_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judge_urls(read(spark, sf_dir, "pages"))


def _op1_sql() -> str:
    rules = sorted(url_trust.RULES, key=lambda r: -len(r.site))
    fits = [f"WHEN ends_with('.' || host, '.{r.host}') AND starts_with(path, '{r.path}') THEN" for r in rules]
    rule, verdict = (" ".join(f"{f} '{x}'" for f, x in zip(fits, xs)) for xs in ([r.site for r in rules], [r.verdict for r in rules]))
    steps = math.ceil(math.log(url_trust.REST) / math.log(url_trust.DAMPING))
    walk = "".join(
        f""", m{i + 1} AS MATERIALIZED (
    SELECT kind, dst AS host, CAST(sum(moved) AS BIGINT) AS mass
    FROM (SELECT kind, dst, CAST(floor(mass * share) AS BIGINT) AS moved FROM m{i} JOIN ways USING (kind, host)) WHERE moved > 0 GROUP BY ALL
)"""
        for i in range(steps)
    )
    every = " UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(steps + 1))
    return f"""
WITH urls AS (
    SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), judged AS (
    SELECT page_id, html, host, path, CASE {rule} END AS rule, CASE {verdict} END AS ruled FROM urls
), targets AS (
    SELECT host AS src, unnest(regexp_extract_all(html, '{url_trust.LINK.replace("'", "''")}', 1)) AS target FROM judged WHERE host <> ''
), links AS (
    SELECT src, dst, count(*) AS n FROM (
        SELECT src, translate(regexp_extract(target, '//([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS dst FROM targets
        WHERE regexp_matches(target, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]')
        UNION ALL SELECT host, regexp_extract(host, '^[^.]*\\.(.*)$', 1) FROM judged WHERE len(string_split(host, '.')) >= 3
    ) WHERE src <> dst AND dst <> '' GROUP BY ALL
), sides AS (
    SELECT 'trust' AS kind, src AS host, dst, n FROM links UNION ALL SELECT 'distrust', dst, src, n FROM links
), ways AS (
    SELECT kind, host, dst, CAST({url_trust.DAMPING} AS DOUBLE) * n / sum(n) OVER (PARTITION BY kind, host) AS share FROM sides
), hosts AS (
    SELECT host, count(*) AS pages, count(*) FILTER (ruled = 'allow') AS trust, count(*) FILTER (ruled = 'block') AS distrust FROM judged WHERE host <> '' GROUP BY host
), m0 AS (
    SELECT 'trust' AS kind, host, trust * {url_trust.UNIT} AS mass FROM hosts WHERE trust > 0
    UNION ALL SELECT 'distrust', host, distrust * {url_trust.UNIT} FROM hosts WHERE distrust > 0
){walk}, scores AS (
    SELECT host, coalesce(sum(mass) FILTER (kind = 'distrust'), 0) - coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS over FROM ({every}) GROUP BY host
)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict, blocked AS host_blocked
FROM (SELECT j.*, coalesce(s.over >= {url_trust.THRESHOLD} * {url_trust.UNIT} * h.pages, false) AS blocked
    FROM judged j LEFT JOIN hosts h USING (host) LEFT JOIN scores s USING (host))
"""


def op2_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(read(spark, sf_dir, "documents"), shingle=2)


OP2_SQL = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, coalesce(regexp_extract_all({_LOWERED}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) < 2 THEN w
        ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words
), reps AS (
    SELECT min(doc_id) AS rep, s FROM (SELECT doc_id, list_sort(s) AS s FROM sets WHERE len(s) > 0) GROUP BY s
), shingles AS (
    SELECT rep, len(s) AS n, unnest(s) AS shingle FROM reps
), links AS (
    SELECT a.rep AS a, b.rep AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.rep <> b.rep
    GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(a, b) AS (
    SELECT rep, rep FROM reps UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), component AS (
    SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a
), placed AS (
    SELECT d.doc_id, len(d.s) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
    FROM sets d LEFT JOIN reps r ON len(d.s) > 0 AND list_sort(d.s) = r.s LEFT JOIN component c ON c.rep = r.rep
)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM placed
"""


def op4_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), path=RANKS, pattern=public_tokenizers.PATTERN)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_LETTER_WORDS = f"coalesce(regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"

OP8_SQL = f"""
WITH docs AS (
    SELECT doc_id, {_LETTER_WORDS} AS w FROM documents
), items AS (
    SELECT item_id, {_LETTER_WORDS} AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS x
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)
), lengths AS (
    SELECT DISTINCT n FROM windows
), spots AS (
    SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS x
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)
), found AS (
    SELECT s.doc_id, s.i, s.n, w.item_id FROM spots s JOIN windows w ON s.n = w.n AND s.x = w.x
), hit AS (
    SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), listed AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
"""



def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: source, language, hundreds of the id, id."""
    docs = read(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 100).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan(docs.select("doc_id", path.alias("path"), "text"), key="doc_id", all_terms=True)


def op5_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return pseudo_lm.score(docs, pseudo_lm.fit(docs), words=True)


def op6_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = slots.shard_by_stored_map(read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/slot-maps-{uuid.uuid4().hex}")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{says}'), (-7L, 1L, 'assistant', '{says}') AS t(conv_id, turn, role, text)")
    return chat.read_back(chat.windows(given.union(more)))


OP9_SQL = f"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
    SELECT *, (length(text) + 3) // 4 + 1 AS tokens, {len(chat.OPEN + chat.MIDDLE + chat.CLOSE)}
        + length(replace(replace(role, '\\', '\\\\'), '<|', '<\\|')) + length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')) AS chars FROM rows
), starts AS (
    SELECT *, row_number() OVER w - 1 AS number, coalesce(sum(tokens) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), placed AS (
    SELECT *, start // {chat.SPAN_TOKENS} AS span FROM starts
), spans AS (
    SELECT conv_id, span, lead(start) OVER (PARTITION BY conv_id ORDER BY span) AS next FROM (SELECT conv_id, span, min(start) AS start FROM placed GROUP BY ALL)
), again AS (
    SELECT p.conv_id, p.number, p.chars, s.next FROM placed p JOIN spans s USING (conv_id, span) WHERE s.next - p.start <= {chat.HISTORY_TOKENS}
), repeated AS (
    SELECT conv_id, sum(chars) AS chars FROM again GROUP BY conv_id
), system AS (
    SELECT p.conv_id, p.chars * (count(s.next) - (SELECT count(*) FROM again a WHERE a.conv_id = p.conv_id AND a.number = 0)) AS chars
    FROM placed p JOIN spans s USING (conv_id) WHERE p.number = 0 AND p.role = 'system' GROUP BY p.conv_id, p.chars
), whole AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY number) AS turns,
        coalesce(string_agg(text, '' ORDER BY number) FILTER (role = 'assistant'), '') AS loss, sum(chars) AS chars FROM placed GROUP BY conv_id
)
SELECT w.conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
    CAST(w.chars + coalesce(r.chars, 0) + coalesce(s.chars, 0) AS BIGINT) AS formatted_chars
FROM whole w LEFT JOIN repeated r USING (conv_id) LEFT JOIN system s USING (conv_id)
"""


def op10_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP10_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), placed AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 10
"""


def op11_ranked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_terms.rank_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_TERMS = f"coalesce(regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), [])"

OP11_SQL = f"""
WITH docs AS (
    SELECT doc_id, row_number() OVER () AS doc, {_TERMS} AS w FROM documents
), sizes AS (
    SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM docs WHERE len(w) > 0
), tfs AS (
    SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(w) AS term FROM docs) GROUP BY ALL
), dfs AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, sizes GROUP BY term, n_docs
), items AS (
    SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)
), lengths AS (
    SELECT doc, doc_id, 50 + (50 * len(w) * n_docs) // n_terms AS m FROM docs, sizes WHERE len(w) > 0
), scored AS (
    SELECT item_id, doc, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
    FROM items JOIN dfs USING (term) JOIN tfs USING (term) JOIN lengths USING (doc) GROUP BY ALL
), placed AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 50
"""


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_damaged(read(spark, sf_dir, "conversations"))


_CRC = """xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(name, ''), lambda c: CAST(ascii(c) AS BIGINT))),
        lambda h, c: list_reduce(list_concat([xor(h, c)], [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))))"""


def _op12_sql() -> str:
    """Backward over the rows: from every state the cheapest way to the end, as a struct of cost, audit and lines, which compares in that order."""
    states, white = ("start", "sys", "usr", "asst"), "\\x20\\x09-\\x0D"
    turns = {"start": "usr", "sys": "usr", "usr": "asst", "asst": "usr"}
    named = {"usr": "user", "asst": "assistant"}
    keeps = {"s": {"start": "sys"}, "u": {"start": "usr", "sys": "usr", "asst": "usr"}, "a": {"usr": "asst"}}

    def way(cost: str, edit: str, line: str, then: str) -> str:
        return f"{{'c': {then}.c + {cost}, 'a': '{edit}' || {then}.a, 'r': {f'list_concat([{line}], {then}.r)' if line else f'{then}.r'}}}"

    def row(state: str) -> str:
        options = [way("4", "D", "", f"d.{state}"), f"CASE WHEN NOT forced THEN {way('3 + extra', 'R', f"'{named[turns[state]]}:' || text", f'd.{turns[state]}')} END"]
        for initial, to in keeps.items():
            if state in to:
                options.append(f"CASE WHEN NOT forced AND left(role, 1) = '{initial}' THEN {way('extra', 'K', "role || ':' || text", f'd.{to[state]}')} END")
        return f"list_min(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL)) AS {state}"

    def closed(state: str, of: str) -> str:
        return f"least({state}, {way('3', 'I', f"'{named[turns[state]]}:'", f'{of}{turns[state]}')}) AS {state}"

    end = {"start": "{'c': 0, 'a': '', 'r': CAST([] AS VARCHAR[])}", "sys": "{'c': 6, 'a': 'II', 'r': ['user:', 'assistant:']}", "usr": "{'c': 3, 'a': 'I', 'r': ['assistant:']}"}
    end["asst"] = end["start"]
    kind = "STRUCT(c BIGINT, a VARCHAR, r VARCHAR[])"
    return f"""
WITH RECURSIVE given AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS kind
    FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations)
), rows AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM given, (VALUES (1), (2)) AS t(copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM rows
), marked AS (
    SELECT *, NOT regexp_matches(text, '[^{white}]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
        regexp_extract(text, '(?s)([^{white}])[{white}]*$', 1) NOT IN ('.', '!', '?') AS cut,
        lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS next
    FROM placed
), faults AS (
    SELECT conv_id, pos, role, text, blank OR again AS forced, CASE WHEN cut AND NOT blank AND NOT again THEN 3 ELSE 0 END AS extra FROM marked
), counts AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
        count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated,
        count(*) FILTER (next IS NOT NULL AND left(role, 1) || next NOT IN ('su', 'ua', 'au')) AS illegal
    FROM marked GROUP BY conv_id
), d AS (
    SELECT conv_id, n + 1 AS pos, {", ".join(f"CAST({end[s]} AS {kind}) AS {s}" for s in states)} FROM counts
    UNION ALL
    SELECT conv_id, pos, {closed("start", "")}, {closed("sys", "")}, usr, asst FROM (
        SELECT conv_id, pos, start, sys, {closed("usr", "x.")}, {closed("asst", "x.")} FROM (
            SELECT d.conv_id, f.pos, {", ".join(row(s) for s in states)}
            FROM d JOIN faults f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.pos = d.pos - 1) x)
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(start.c, 0) AS cost, coalesce(start.a, '') AS audit, sha256(coalesce(array_to_string(start.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN d ON d.conv_id IS NOT DISTINCT FROM o.conv_id AND d.pos = 1
"""


def op13_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated_codes.near_duplicates(read(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach(a, b) AS (
    SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), component AS (
    SELECT a, min(b) AS least FROM reach GROUP BY a
), degree AS (
    SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, coalesce(c.least, e.vec_id) AS component_id, e.vec_id = coalesce(c.least, e.vec_id) AS kept
FROM embeddings e LEFT JOIN degree d ON d.a = e.vec_id LEFT JOIN component c ON c.a = e.vec_id
"""

QUERIES = {
    "op1_link_trust": op1_link_trust,
    "op2_minmax": op2_minmax,
    "op3_licences": op3_licences,
    "op4_prefix_bpe": op4_prefix_bpe,
    "op5_pseudo_likelihood": op5_pseudo_likelihood,
    "op6_slots": op6_slots,
    "op7_quality": op7_quality,
    "op8_decontaminate": op8_decontaminate,
    "op9_chat": op9_chat,
    "op10_threshold": op10_threshold,
    "op11_ranked_terms": op11_ranked_terms,
    "op12_turn_repair": op12_turn_repair,
    "op13_rotated_codes": op13_rotated_codes,
}
ORACLES = {"op1_link_trust": _op1_sql(), "op2_minmax": OP2_SQL, "op8_decontaminate": OP8_SQL, "op9_chat": OP9_SQL, "op10_threshold": OP10_SQL, "op11_ranked_terms": OP11_SQL, "op12_turn_repair": _op12_sql(), "op13_rotated_codes": OP13_SQL}
