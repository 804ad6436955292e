"""Schemas of the exchanged tables."""

# Field names and types of the published tables.
FAMILY_PUBLICATIONS = (
    "family_id STRING, publication_date BIGINT, publication_number ARRAY<STRING>, country_code ARRAY<STRING>, "
    "cpc ARRAY<STRUCT<code:STRING>>, ipc ARRAY<STRUCT<code:STRING>>, citation ARRAY<STRUCT<family_id:STRING>>, "
    "cited_by ARRAY<STRUCT<family_id:STRING>>, abstract STRING"
)
SEED = (
    "family_id STRING, publication_number STRING, expansion_level STRING, match STRING, match_number BIGINT, "
    "answer STRING, accept_text ARRAY<STRING>, nb_total BIGINT, nb_bin BIGINT, text STRING, _input_hash BIGINT"
)
TRAINING = (
    "family_id STRING, expansion_level STRING, is_seed INT, cats STRUCT<SEED:INT, NOT_SEED:INT>, text STRING"
)
SCORES = "family_id STRING, score DOUBLE"
