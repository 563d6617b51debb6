"""Criteria as data: dictionaries become column expressions, never SQL text."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEYS = {"values", "exclude", "like"}
#: Spellings that mean null, fixed values.
NULL_WORDS = ("NULL", "null", "NA", "na", "")


def _variants(value: str) -> list[str]:
    sentence = value[:1].upper() + value[1:].lower()
    return list(dict.fromkeys([value, value.lower(), value.title(), sentence, value.upper()]))


def criterion(column: Column, spec: Any, case_sensitive: bool = True, fuzzy: bool = False) -> Column:
    """One column's condition.

    ``spec`` is a value, a list, or a dictionary of values, exclude and like.
    No value, or a word for null, asks for null; several ask for membership.
    ``like`` takes one value, matched without regard to case, with % around it
    if it has none; with several values it stays a membership test.
    """
    spec = spec if isinstance(spec, dict) else {"values": spec}
    unknown = set(spec) - _KEYS
    if unknown:
        raise ValueError(f"unknown keywords in a criterion: {', '.join(sorted(unknown))}")
    values = spec.get("values")
    values = [] if values is None else list(values) if isinstance(values, (list, tuple, set)) else [values]
    if not values or (len(values) == 1 and values[0] in NULL_WORDS):
        out = column.isNull()
    elif len(values) == 1 and (spec.get("like") or fuzzy):
        pattern = str(values[0])
        out = column.ilike(pattern.replace("%%", "%") if "%" in pattern else f"%{pattern}%")
    else:
        if not case_sensitive:
            values = [v for x in values for v in (_variants(x) if isinstance(x, str) else [x])]
        out = column == values[0] if len(values) == 1 else column.isin(values)
    return ~out if spec.get("exclude") else out


def where(df: DataFrame, criteria: dict[str, Any], and_or: str = "AND", case_sensitive: bool = True, fuzzy: bool = False) -> DataFrame:
    """Rows that meet all criteria, or with OR any of them."""
    missing = [c for c in criteria if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    parts = [criterion(F.col(c), spec, case_sensitive, fuzzy) for c, spec in criteria.items()]
    if not parts:
        return df
    glue = {"AND": Column.__and__, "OR": Column.__or__}[and_or.upper()]
    return df.where(reduce(glue, parts))


def table_search(
    df: DataFrame, columns: list[str] | None = None, criteria: dict[str, Any] | None = None, and_or: str = "AND", case_sensitive: bool = True,
    fuzzy: bool = False, distinct: bool = False, order_by: list[tuple[str, bool]] | None = None, limit: int | None = None,
) -> DataFrame:
    """Projection, criteria, distinct, order (column, ascending) and limit over one table or view."""
    out = where(df, criteria or {}, and_or, case_sensitive, fuzzy)
    out = out.select(*columns) if columns else out
    out = out.distinct() if distinct else out
    if order_by:
        out = out.orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in order_by])
    return out if limit is None else out.limit(limit)


def match_rows(df: DataFrame, criteria: DataFrame) -> DataFrame:
    """Rows equal to some row of criteria in all its columns; nulls are equal."""
    wanted = criteria.select(*[F.col(c).alias(f"_{c}") for c in criteria.columns])
    return df.join(wanted, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in criteria.columns]), "left_semi")


def any_column(df: DataFrame, value: str, fuzzy: bool = False) -> DataFrame:
    """Rows in which some column, as text, equals the value (or matches it as a pattern)."""
    text = [F.col(c).cast("string") for c in df.columns]
    return df.where(reduce(Column.__or__, [F.coalesce(c.rlike(value) if fuzzy else c == value, F.lit(False)) for c in text]))


def exists(df: DataFrame, column: str, values: list[Any]) -> bool:
    return not df.where(F.col(column).isin(values)).isEmpty()
