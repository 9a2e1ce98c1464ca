"""Shared column expressions: blanks, names, natural order, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def blank_as_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def natural_key(c: Column) -> Column:
    """A text key under which digit runs sort by their number: a2 before a10. Case is folded."""
    padded = F.regexp_replace(F.lower(c), r"(\d+)", "00000000000000000000$1")
    return F.regexp_replace(padded, r"0*(\d{20})(?!\d)", "$1")


def free_name(name: str, taken: list[str]) -> str:
    """name, or with the first of the suffixes _2, _3, ... that is free."""
    if name not in taken:
        return name
    n = 2
    while f"{name}_{n}" in taken:
        n += 1
    return f"{name}_{n}"


def widened(types: list[T.DataType]) -> T.DataType:
    """The type that holds all: integers stay, with fractions they become doubles, with text they become text."""
    if all(t == types[0] for t in types):
        return types[0]
    if all(isinstance(t, T.IntegralType) for t in types):
        return T.LongType()
    if all(isinstance(t, T.NumericType) for t in types):
        return T.DoubleType()
    return T.StringType()


def is_text_type(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType)
