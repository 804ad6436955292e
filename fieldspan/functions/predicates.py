"""Text, class-code and country predicates as Columns."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(tests: Iterable[Column]) -> Column:
    """OR of the tests; false when there are none."""
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def split_lists(topics: dict[str, str] | None) -> list[str]:
    """Topic -> comma list, as one list without empty entries (blanks are kept)."""
    return [item for listed in (topics or {}).values() for item in listed.split(",") if item]


def holds_keyword(text: str | Column, keywords: Iterable[str]) -> Column:
    """Lower-cased text LIKE ``%keyword%``; keywords are taken as they are, wildcards included."""
    lowered = F.lower(_col(text))
    return any_of(lowered.like(f"%{k}%") for k in keywords)


def has_prefix(code: str | Column, prefixes: Iterable[str]) -> Column:
    """Code LIKE ``prefix%``."""
    return any_of(_col(code).like(f"{p}%") for p in prefixes)


def holds_code(code: str | Column, parts: Iterable[str], main_group: bool = False) -> Column:
    """Code LIKE ``%part%`` for any part, optionally cut at its ``/``; repeats count once."""
    wanted = dict.fromkeys(p.split("/")[0] if main_group else p for p in parts)
    return any_of(_col(code).like(f"%{p}%") for p in wanted)


def any_code_holds(codes: str | Column, parts: Iterable[str], main_group: bool = False) -> Column:
    """:func:`holds_code` for an array of ``{code}`` structs, without exploding it."""
    wanted = list(parts)
    return F.coalesce(F.exists(_col(codes), lambda c: holds_code(c["code"], wanted, main_group)), F.lit(False))


def is_labelled(level: str | Column = "expansion_level") -> Column:
    """Seed and antiseed rows alike; rows without a level are not labelled."""
    return _col(level).like("%SEED%")


def in_countries(country: str | Column, names: Iterable[str]) -> Column:
    """Country among the names; no names means no restriction."""
    names = list(names)
    return _col(country).isin(names) if names else F.lit(True)
