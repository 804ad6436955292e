"""Annotated records: readable fields, corrections, undecodable lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspan.operators.expansion import MANUAL, SEED

_FIELDS = "map<string,string>"
_BROKEN = "__broken"
# JSON to the letter, without the parser's limit on the length of a string.
_STRICT = {"mode": "PERMISSIVE", "allowSingleQuotes": "false", "maxStringLen": str((1 << 31) - 1)}


def with_practical_fields(records: DataFrame) -> DataFrame:
    """``accept_text`` from the accepted option numbers, ``expansion_level`` from the answer."""
    answer = F.col("answer")
    texts = F.transform(F.col("options"), lambda o: o["text"])
    return records.withColumns(
        {
            "accept_text": F.transform("accept", lambda i: F.element_at(texts, i + 1)),
            "expansion_level": F.when(answer == "accept", F.lit(SEED)).when(answer == "reject", F.lit(MANUAL)),
        }
    )


def parse_fields(lines: DataFrame, line: str = "value") -> Column:
    """A JSON line as a map of its fields; a null field is present, a missing one is not."""
    return F.from_json(F.col(line), _FIELDS, {"maxStringLen": _STRICT["maxStringLen"]})


def correct_annotations(
    records: DataFrame,
    corrections: DataFrame,
    key: str = "family_id",
    order: Sequence[str] = ("position",),
    line: str = "value",
) -> DataFrame:
    """JSON records as ``fields`` maps, with the fields of the last correction of their key put over.

    The last correction is found by an aggregate (``max_by``), which a key corrected
    very often cannot overload as it would a sorted window. Corrections of unknown keys
    change nothing. For lines of several files ``order`` is ``files.ORDER``.
    """
    fixes = corrections.select(parse_fields(corrections, line).alias("fix"), *order)
    fixes = fixes.withColumn("__key", F.col("fix")[key]).filter(F.col("__key").isNotNull())
    last = fixes.groupBy("__key").agg(F.max_by("fix", F.struct(*order)).alias("fix"))
    base = records.withColumn("fields", parse_fields(records, line))
    joined = base.withColumn("__key", F.col("fields")[key]).join(last, "__key", "left")
    kept = F.map_filter("fields", lambda name, _: ~F.map_contains_key("fix", name))
    merged = F.when(F.col("fix").isNull(), F.col("fields")).otherwise(F.map_concat(kept, "fix"))
    return joined.withColumn("fields", merged).drop("__key", "fix")


def json_defects(lines: DataFrame, line: str = "value") -> DataFrame:
    """The lines that do not decode as JSON, with whatever else the table says about them."""
    return lines.filter(~is_json(F.col(line)))


def is_json(line: Column) -> Column:
    """Whether a line is one JSON value, of any length.

    The parser stops behind a value, so the line is read as the only item of a list and as
    the only field of an object: what follows the value breaks one or the other.
    """
    items = F.from_json(F.concat(F.lit("["), line, F.lit("]")), "array<string>", _STRICT)
    field = F.from_json(F.concat(F.lit('{"v":'), line, F.lit("}")), f"v string, {_BROKEN} string", {**_STRICT, "columnNameOfCorruptRecord": _BROKEN})
    return F.coalesce((F.size(items) == 1) & field[_BROKEN].isNull(), F.lit(False))


def classifier_input(lines: DataFrame, line: str = "value") -> DataFrame:
    """(text, is_seed) from JSON lines: undecodable ones are skipped, a missing text is empty.

    Values that are no objects are skipped too. A missing label stays null and the label 0 is a label.
    """
    schema = "text string, is_seed int"
    objects = is_json(F.col(line)) & F.ltrim(F.col(line)).startswith("{")
    good = lines.filter(objects).select(F.from_json(line, schema, _STRICT).alias("r"))
    return good.select(F.coalesce("r.text", F.lit("")).alias("text"), F.col("r.is_seed").alias("is_seed"))
