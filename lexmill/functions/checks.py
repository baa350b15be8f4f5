"""Checks of parameters before a plan is made, and of rows while it runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def positive(name: str, value: object) -> int:
    """value, or ValueError where it isn't a whole number above 0; True is no number."""
    if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
        raise ValueError(f"{name} must be a positive whole number, not {value!r}")
    return value


def one_of(name: str, value: object, known: tuple) -> object:
    if value not in known:
        raise ValueError(f"{name} must be one of {', '.join(map(str, known))}, not {value!r}")
    return value


def not_blank(c: Column | str, name: str) -> Column:
    """The text, or an error where a row has none but white space."""
    x = F.col(c) if isinstance(c, str) else c
    blank = F.coalesce(F.regexp_replace(x, r"(?U)\s+", ""), F.lit("")) == ""
    return F.when(blank, F.raise_error(F.lit(f"{name} must not be empty")).cast("string")).otherwise(x)
