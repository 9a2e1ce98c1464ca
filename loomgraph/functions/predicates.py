"""The three filter vocabularies as Column expressions.

They differ in how they treat null, case and anchoring, so each is compiled on its own:

* ``condition``: one condition of a table filter. A missing number equals 0, a missing text is ''; text is
  compared with its case; a pattern may match anywhere.
* ``all_rows``: filter rows that are ANDed. A missing value meets negated comparisons and nothing else; patterns
  must match the whole text; case can be ignored row by row.
* ``cell_filter``: what is typed into a column's header. Clauses that make no sense are left out.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONDITIONS = ("eq", "ne", "gt", "ge", "lt", "le", "contains", "notContains", "matches", "startsWith", "endsWith", "isEmpty", "notEmpty", "isTrue", "isFalse")
ROW_OPS = ("is", "isNot", "isIn", "isNotIn", "contains", "notContains", "startsWith", "endsWith", "matches", "gt", "ge", "lt", "le", "isEmpty", "notEmpty")


def is_number(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def number(value: object) -> float:
    try:
        return float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        raise ValueError(f"not a number: {value!r}") from None


def ordered(c: Column, op: str, value: Column) -> Column:
    """An ordering that missing values and NaN never meet."""
    held = {"gt": c > value, "ge": c >= value, "lt": c < value, "le": c <= value}[op]
    return F.coalesce(held & ~F.isnan(c.cast("double")), F.lit(False))


def condition(df: DataFrame, column: str, op: str, value: object = None) -> Column:
    if op not in CONDITIONS:
        raise ValueError(f"no such condition: {op}")
    c = F.col(column)
    if op in ("isTrue", "isFalse"):
        return F.coalesce(c.cast("boolean") == (op == "isTrue"), F.lit(False))
    if op in ("isEmpty", "notEmpty"):
        empty = (c.isNull() | (F.trim(c) == "")) if is_text(df, column) else c.isNull()
        return empty if op == "isEmpty" else ~empty
    if is_number(df, column) and op in ("eq", "ne", "gt", "ge", "lt", "le"):
        v = F.lit(number(value))
        if op in ("eq", "ne"):
            same = F.coalesce(c.cast("double"), F.lit(0.0)) == v
            return same if op == "eq" else ~same
        return ordered(c.cast("double"), op, v)
    text, v = F.coalesce(c.cast("string"), F.lit("")), F.lit(str(value))
    return {
        "eq": lambda: text == v,
        "ne": lambda: text != v,
        "gt": lambda: text > v,
        "ge": lambda: text >= v,
        "lt": lambda: text < v,
        "le": lambda: text <= v,
        "contains": lambda: F.contains(text, v),
        "notContains": lambda: ~F.contains(text, v),
        "matches": lambda: text.rlike(str(value)),
        "startsWith": lambda: F.startswith(text, v),
        "endsWith": lambda: F.endswith(text, v),
    }[op]()


def row(df: DataFrame, column: str, op: str, value: object = None, ignore_case: bool = False) -> Column:
    if op not in ROW_OPS:
        raise ValueError(f"no such row operation: {op}")
    c = F.col(column)
    if op in ("isEmpty", "notEmpty"):
        empty = (c.isNull() | (F.trim(c) == "")) if is_text(df, column) else c.isNull()
        return empty if op == "isEmpty" else ~empty
    if is_number(df, column):
        if op in ("isIn", "isNotIn"):
            raise ValueError("numbers have no isIn")
        if op in ("is", "isNot"):
            held = F.coalesce(c.cast("double") == F.lit(number(value)), F.lit(False))
            return held if op == "is" else ~held
        if op in ("gt", "ge", "lt", "le"):
            return ordered(c.cast("double"), op, F.lit(number(value)))
    text = F.lower(c.cast("string")) if ignore_case else c.cast("string")
    fold = (lambda s: str(s).lower()) if ignore_case else str
    values = [fold(v) for v in value] if isinstance(value, list | tuple | set) else fold(value)
    positive = {
        "is": lambda: text == F.lit(values),
        "isNot": lambda: text == F.lit(values),
        "isIn": lambda: text.isin(list(values)),
        "isNotIn": lambda: text.isin(list(values)),
        "contains": lambda: F.contains(text, F.lit(values)),
        "notContains": lambda: F.contains(text, F.lit(values)),
        "startsWith": lambda: F.startswith(text, F.lit(values)),
        "endsWith": lambda: F.endswith(text, F.lit(values)),
        "matches": lambda: c.cast("string").rlike(("(?i)" if ignore_case else "") + f"^(?:{value})$"),
        "gt": lambda: text > F.lit(values),
        "ge": lambda: text >= F.lit(values),
        "lt": lambda: text < F.lit(values),
        "le": lambda: text <= F.lit(values),
    }[op]()
    held = F.coalesce(positive, F.lit(False))
    return ~held if op in ("isNot", "isNotIn", "notContains") else held


def all_rows(df: DataFrame, rows: list[dict]) -> Column:
    """AND of rows {column, op, value, ignore_case}; true without any."""
    terms = [row(df, r["column"], r["op"], r.get("value"), r.get("ignore_case", False)) for r in rows]
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def runs_in_java(pattern: str) -> bool:
    """Whether the JVM, which will match it, takes the pattern."""
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True


_CLAUSE = re.compile(r"^(>=|<=|>|<|==|!=|~)?\s*(.*?)\s*$", re.S)


def unquoted(value: str) -> str:
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value


def cell_filter(df: DataFrame, column: str, typed: str) -> Column:
    """AND of the comma-separated clauses typed: ``>10 <=5 ==x !=x ~pattern text number``, each after ``!`` or ``-`` for its contrary.

    A minus before a number of a numeric column is its sign. Values may stand in quotes; a clause without a value says nothing.
    """
    c, numeric = F.col(column), is_number(df, column)
    text = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    terms = []
    for typed_clause in typed.split(","):
        clause, negate = typed_clause.strip(), False
        signed = numeric and clause.startswith("-") and re.fullmatch(r"-\s*(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", clause)
        if len(clause) > 1 and clause[0] in "!-" and not clause.startswith("!=") and not signed:
            negate, clause = True, clause[1:].strip()
        sign, value = _CLAUSE.match(clause).groups()
        value = unquoted(value)
        if not value:
            continue
        try:
            as_number = float(value.replace(" ", "")) if signed else float(value)
        except ValueError:
            as_number = None
        if sign in (">", ">=", "<", "<="):
            if as_number is None or not numeric:
                continue
            held = ordered(c.cast("double"), {">": "gt", ">=": "ge", "<": "lt", "<=": "le"}[sign], F.lit(as_number))
        elif sign == "~":
            if not runs_in_java(value):
                continue
            held = F.coalesce(c.cast("string"), F.lit("")).rlike("(?i)" + value)
        elif sign in ("==", "!="):
            same = (c.cast("double") == as_number) if numeric and as_number is not None else text == value.lower()
            same = F.coalesce(same, F.lit(False))
            held = same if sign == "==" else ~same
        elif numeric and as_number is not None:
            held = c.cast("double") == as_number
        else:
            held = F.contains(text, F.lit(value.lower()))
        held = F.coalesce(held, F.lit(False))
        terms.append(~held if negate else held)
    return reduce(lambda a, b: a & b, terms, F.lit(True))
