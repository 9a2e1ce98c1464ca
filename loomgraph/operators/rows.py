"""Row and column transforms.

Spark rows have no order, so operators that speak of first, last or every n-th row take ``order``: columns whose
order is total for the rows in question.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.columns import blank_as_null, free_name, natural_key, widened
from loomgraph.functions.lineage import running
from loomgraph.functions.predicates import all_rows, condition, is_text
from loomgraph.operators.charts import drawn


def filter_table(df: DataFrame, column: str, op: str, value: object = None) -> DataFrame:
    return df.where(condition(df, column, op, value))


def filter_rows(df: DataFrame, rows: list[dict]) -> DataFrame:
    return df.where(all_rows(df, rows))


def split_rows(df: DataFrame, rows: list[dict]) -> tuple[DataFrame, DataFrame]:
    """Rows that match, and all others: a row is in exactly one of the two."""
    held = F.coalesce(all_rows(df, rows), F.lit(False))
    return df.where(held), df.where(~held)


def select_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns) if columns else df


def rename_columns(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    """All renames at once, so names can be swapped; a column that stands in the way gets a suffix."""
    wanted = {k: v for k, v in renames.items() if k in df.columns and v}
    taken = list(wanted.values())
    names = []
    for c in df.columns:
        new = wanted.get(c) or free_name(c, taken)
        taken.append(new)
        names.append(new)
    return df.toDF(*names)


def sort_keys(df: DataFrame, column: str, descending: bool = False) -> list[Column]:
    """Missing values last in both directions; text in natural order."""
    c = F.col(column)
    keys = [natural_key(c), c] if is_text(df, column) else [F.when(~F.isnan(c.cast("double")), c) if dict(df.dtypes)[column] in ("double", "float") else c]
    return [k.desc_nulls_last() if descending else k.asc_nulls_last() for k in keys]


def sort(df: DataFrame, column: str, descending: bool = False, limit: int = 0, order: tuple[str, ...] = ()) -> DataFrame:
    """With a limit, Spark keeps the top rows of each partition and never sorts all."""
    out = df.orderBy(*sort_keys(df, column, descending), *order)
    return out.limit(limit) if limit > 0 else out


def numbered(df: DataFrame, order: tuple[str, ...], name: str = "row_at") -> DataFrame:
    """df with row_at = 0, 1, 2, ... in the order of the key columns."""
    return running(df, [F.col(c) for c in order], name=name)


def sample(df: DataFrame, mode: str, order: tuple[str, ...], count: int = 100, step: int = 10, seed: int = 1) -> DataFrame:
    """head, tail, stride (rows 0, step, 2 step, ...) or random (count rows of least seeded hash of all columns)."""
    if mode == "head":
        return df.orderBy(*order).limit(count)
    if mode == "tail":
        return df.orderBy(*[F.col(c).desc() for c in order]).limit(count)
    if mode == "stride":
        return numbered(df, order).where(F.col("row_at") % step == 0).drop("row_at")
    if mode == "random":
        return df.orderBy(drawn(df.columns, seed), *order).limit(count)
    raise ValueError(f"no such mode: {mode}")


def dedupe(df: DataFrame, columns: list[str], keep: str, order: tuple[str, ...]) -> DataFrame:
    """Rows that repeat in columns (all, if none): the first or last in order stays, or none of them."""
    by = columns or df.columns
    if keep == "none":
        others = [c for c in df.columns if c not in by]
        one = df.groupBy(*by).agg(F.count("*").alias("_n"), *([F.first(F.struct(*others)).alias("_row")] if others else []))
        return one.where("_n = 1").select(*[F.col(c) if c in by else F.col(f"_row.{c}") for c in df.columns])
    keys = [F.col(c).desc() if keep == "last" else F.col(c).asc() for c in order]
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*keys))).where("_n = 1").drop("_n")


def combine_columns(df: DataFrame, columns: list[str], into: str, source_column: str | None = None) -> DataFrame:
    """The first of columns that is neither missing nor blank, and optionally that column's name."""
    kind = widened([df.schema[c].dataType for c in columns])
    cells = [blank_as_null(F.col(c)) if is_text(df, c) else F.col(c) for c in columns]
    name = free_name(into, df.columns)
    out = df.withColumn(name, F.coalesce(*[c.cast(kind) for c in cells]))
    if source_column:
        named = F.coalesce(*[F.when(cell.isNotNull(), F.lit(c)) for c, cell in zip(columns, cells)])
        out = out.withColumn(free_name(source_column, out.columns), named)
    return out


def relabel(df: DataFrame, mapping: DataFrame, column: str, key_column: str, value_column: str, unmatched: str = "keep", into: str | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """column through a map, compared as text; null is a key like others, and the first row of a key counts."""
    by = W.partitionBy(F.col(key_column).cast("string")).orderBy(*[F.col(c) for c in (order or (value_column,))])
    first = mapping.withColumn("_n", F.row_number().over(by)).where("_n = 1")
    first = first.select(F.col(key_column).cast("string").alias("_key"), F.col(value_column).alias("_value"), F.lit(True).alias("_hit"))
    out = df.join(first, F.col(column).cast("string").eqNullSafe(F.col("_key")), "inner" if unmatched == "drop" else "left")
    if unmatched == "keep":
        kind = widened([df.schema[column].dataType, mapping.schema[value_column].dataType])
        value = F.when(F.col("_hit"), F.col("_value").cast(kind)).otherwise(F.col(column).cast(kind))
    else:
        value = F.col("_value")
    name = into or column
    return out.withColumn(name, value).select(*df.columns, *([name] if name not in df.columns else []))


def edit_table(df: DataFrame, edits: list[dict]) -> DataFrame:
    """Edits {where: rows, column, value} in turn; later ones see what earlier ones wrote."""
    for e in edits:
        value = F.lit(e["value"])
        held = all_rows(df, e.get("where", []))
        if e["column"] in df.columns:
            kinds = [df.schema[e["column"]].dataType, df.select(value).schema[0].dataType]
            kind = kinds[0] if e["value"] is None else widened(kinds)
            df = df.withColumn(e["column"], F.when(held, value.cast(kind)).otherwise(F.col(e["column"]).cast(kind)))
        else:
            df = df.withColumn(e["column"], F.when(held, value))
    return df


def qualify_ids(df: DataFrame, column: str, prefix: str, direction: str = "add", into: str | None = None) -> DataFrame:
    """Adds ``prefix:`` to ids, or takes it off those that have it. Ids become text."""
    c = F.col(column).cast("string")
    mark = f"{prefix}:"
    new = F.concat(F.lit(mark), c) if direction == "add" else F.when(F.startswith(c, F.lit(mark)), F.substr(c, F.lit(len(mark) + 1))).otherwise(c)
    return df.withColumn(into or column, new)


def unpivot(df: DataFrame, columns: list[str], keep: list[str], name_into: str = "name", value_into: str = "value", drop_empty: bool = False) -> DataFrame:
    kind = widened([df.schema[c].dataType for c in columns])
    out = df.select(*keep, *[F.col(c).cast(kind) for c in columns]).unpivot(keep, columns, name_into, value_into)
    if drop_empty:
        c = F.col(value_into)
        out = out.where(c.isNotNull() & (F.trim(c) != "") if kind.simpleString() == "string" else c.isNotNull())
    return out


def stack(tables: dict[str, DataFrame], source_column: str | None = None) -> DataFrame:
    """UNION ALL by name; missing columns are null, integers and fractions meet as doubles, text and numbers are refused."""
    names = list(dict.fromkeys(c for t in tables.values() for c in t.columns))
    kinds = {}
    for c in names:
        found = [t.schema[c].dataType for t in tables.values() if c in t.columns]
        kinds[c] = widened(found)
        if kinds[c].simpleString() == "string" and any(k.simpleString() != "string" for k in found):
            raise ValueError(f"{c} is text in one table and not in another")
    parts = []
    for label, t in tables.items():
        part = t.select(*[F.col(c).cast(kinds[c]).alias(c) for c in t.columns])
        parts.append(part.withColumn(free_name(source_column, names), F.lit(label)) if source_column else part)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def explore(df: DataFrame, text: str, columns: list[str], limit: int, order: tuple[str, ...]) -> DataFrame:
    """Rows whose columns hold text in any case, exact matches first, then those that begin with it."""
    found = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    low = F.lit(text.lower())
    rank = F.least(*[F.when(c == low, 0).when(F.startswith(c, low), 1).when(F.contains(c, low), 2).otherwise(3) for c in [*found, F.lit("￿")]])
    return df.withColumn("relevance", rank).where("relevance < 3").orderBy("relevance", *order).limit(limit)


def ids_from_label(df: DataFrame, field: str, labels: list[str], match: str = "exact", ignore_case: bool = False) -> DataFrame:
    """Rows whose field equals, or as a whole matches, one of labels."""
    c = F.col(field).cast("string")
    if match == "exact":
        return df.where((F.lower(c) if ignore_case else c).isin([v.lower() if ignore_case else v for v in labels]))
    return df.where(c.rlike(("(?i)" if ignore_case else "") + "^(?:" + "|".join(f"(?:{v})" for v in labels) + ")$"))


def select_one(df: DataFrame, index: int, key: str, order: tuple[str, ...]) -> DataFrame:
    """The rows of one element: the index-th distinct key, counted from 0, by its first row in order. Past the end there are none."""
    firsts = df.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*order)).alias("_at"))
    wanted = firsts.orderBy("_at").offset(index).limit(1)  # one row
    return df.join(F.broadcast(wanted), F.col(key).eqNullSafe(F.col("_key")), "left_semi")
