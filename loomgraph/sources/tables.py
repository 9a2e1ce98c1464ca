"""Table sources and sinks: delimited text with inferred types, columnar files, lists of tables, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.columns import free_name
from loomgraph.operators.aggregates import MOST_COLUMNS

#: Integers beyond this lose digits in a double, and stay text.
EXACT = 1 << 53


def unique_header(names: list[str]) -> list[str]:
    """Header cells as distinct column names; empty ones become col_<n>."""
    taken: list[str] = []
    for i, name in enumerate(names):
        taken.append(free_name((name or "").strip() or f"col_{i + 1}", taken))
    return taken


def inferred(df: DataFrame) -> DataFrame:
    """Text columns as boolean, bigint or double where all their non-empty cells are; empty cells become null.

    One aggregation tests every column. Text stays as it is written; a cell of blanks is text, and makes its column so. 0 and 1 are integers; numbers with leading zeros, and integers that a double cannot
    hold, are identifiers and stay text.
    """
    columns = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]

    def cell(c: str) -> Column:
        return F.when(F.col(f"`{c}`") != "", F.trim(F.col(f"`{c}`")))

    def all_match(c: str, held: Column) -> Column:
        return F.coalesce(F.bool_and(F.when(cell(c).isNotNull(), F.coalesce(held, F.lit(False)))), F.lit(False))

    tests = []
    for c in columns:
        v = cell(c)
        integer = v.rlike(r"^[+-]?(0|[1-9]\d{0,18})$") & (F.abs(v.try_cast("decimal(38,0)")) <= EXACT)
        number = v.rlike(r"^[+-]?((0|[1-9]\d*)(\.\d*)?|\.\d+)([eE][+-]?\d+)?$") & ~(v.rlike(r"^[+-]?\d+$") & ~F.coalesce(integer, F.lit(False)))
        tests += [F.struct(all_match(c, F.lower(v).isin("true", "false")).alias("bool"), all_match(c, integer).alias("int"), all_match(c, number).alias("num")).alias(f"t{len(tests)}")]
    if not tests:
        return df
    found = df.agg(*tests).first()
    kinds = {c: "boolean" if t["bool"] else "bigint" if t["int"] else "double" if t["num"] else "string" for c, t in zip(columns, found)}
    raw = lambda c: F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`"))
    return df.select(*[F.col(f"`{c}`") if c not in kinds else (raw(c) if kinds[c] == "string" else cell(c).cast(kinds[c])).alias(c) for c in df.columns])


def delimiter_of(spark: SparkSession, path: str) -> str:
    """The separator that the first lines hold most evenly."""
    lines = [r.value for r in spark.read.text(path).limit(20).collect() if r.value]
    counts = {d: [line.count(d) for line in lines] for d in (",", "\t", ";", "|")}
    return max(counts, key=lambda d: (min(counts[d], default=0), sum(counts[d])))


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, header: bool = True, id_column: str | None = None) -> DataFrame:
    """A CSV or TSV file with inferred types; id_column becomes neuronId and stays text.

    Quoted cells may hold delimiters and line breaks. Only files with line breaks in cells, which a line with an odd number of quotes
    tells, are read as a whole by a task each; others are split.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    torn = not spark.read.text(path).where(quotes % 2 == 1).isEmpty()
    options = {"sep": delimiter or delimiter_of(spark, path), "inferSchema": False, "multiLine": torn, "escape": '"'}
    # Spark makes names distinct in its own way, so the first row is read as it stands.
    names = spark.read.options(**options, header=False).csv(path).first() if header else None
    raw = spark.read.options(**options, header=header).csv(path)
    raw = raw.toDF(*unique_header(list(names) if names else [""] * len(raw.columns)))
    if id_column is None:
        return inferred(raw)
    ids = raw.withColumn(id_column, F.concat(F.lit("\x00"), F.col(id_column)))
    out = inferred(ids).withColumn(id_column, F.substr(F.col(id_column), F.lit(2)))
    return out.withColumnRenamed(id_column, "neuronId")


def link(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """A lazy handle on a columnar table: filters and columns that later steps ask for reach the scan."""
    return feather(spark, path) if kind == "feather" else spark.read.format(kind).load(path)


def feather(spark: SparkSession, path: str) -> DataFrame:
    """A Feather (Arrow IPC) file, its record batches dealt over tasks; the driver reads the footer alone.

    path is one that every executor can open, or a URI of a file system that Arrow knows.
    """
    import pyarrow as pa
    from pyarrow import fs
    from pyspark.sql.pandas.types import from_arrow_schema

    def opened() -> pa.ipc.RecordBatchFileReader:
        system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        return pa.ipc.open_file(system.open_input_file(at))

    footer = opened()

    def read(batches):
        source = opened()
        for batch in batches:
            for i in batch.column("id").to_pylist():
                yield source.get_batch(i)

    n = footer.num_record_batches
    return spark.range(0, n, 1, max(1, min(n, 10_000))).mapInArrow(read, from_arrow_schema(footer.schema))


def read_rows(file: DataFrame, columns: list[str], ids: DataFrame | None = None, match: str | None = None, id_column: str | None = None, limit: int | None = None) -> DataFrame:
    """columns of the rows whose match column is among ids; no ids, no rows."""
    kept = file
    if ids is not None:
        kept = kept.join(ids.select(F.col(id_column).cast(file.schema[match].dataType).alias(match)).distinct(), match, "left_semi")
    kept = kept.select(*columns)
    return kept.limit(limit) if limit else kept


def list_tables(spark: SparkSession) -> DataFrame:
    found = [(t.name, "view" if t.isTemporary or t.tableType == "VIEW" else "table") for t in spark.catalog.listTables()]
    return spark.createDataFrame(sorted(found), "table string, kind string")


def table_info(df: DataFrame) -> DataFrame:
    """A row a column: name, type, and an example from the first row that has one."""
    examples = df.agg(*[F.first(F.col(f"`{f.name}`").cast("string"), ignorenulls=True).alias(f.name) for f in df.schema]).first()
    rows = [(f.name, f.dataType.simpleString(), examples[i]) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "name string, type string, example string")


def tag_table(long: DataFrame, id_column: str, tag_column: str, value_column: str, tags: list[str] | None = None) -> DataFrame:
    """A long (id, tag, value) table with a column a tag; of several values the least; cell_type is called type.

    Without tags they are found first, and too many are refused.
    """
    if tags is None:
        found = long.select(tag_column).where(F.col(tag_column).isNotNull()).distinct().limit(MOST_COLUMNS + 1).collect()
        if len(found) > MOST_COLUMNS:
            raise ValueError(f"over {MOST_COLUMNS} tags")
        tags = sorted(r[0] for r in found)
    wide = long.groupBy(id_column).pivot(tag_column, tags).agg(F.min(value_column))
    return wide.withColumnRenamed("cell_type", "type")


def export(df: DataFrame, path: str, kind: str = "csv", single: bool = False) -> None:
    """Writes df as csv, parquet or json; single asks for one file, for results that fit one task."""
    out = df.coalesce(1) if single else df
    writer = out.write.mode("overwrite")
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def joined_ids(df: DataFrame, column: str, separator: str = ", ", dedupe: bool = True, quoted: bool = False) -> str:
    """The ids of a result as one text, in order: shorter first, then by digits."""
    c = F.col(column).cast("string")
    ids = df.select(c.alias("id")).where("id is not null")
    ids = ids.distinct() if dedupe else ids
    rows = ids.orderBy(F.length("id"), "id").toLocalIterator()  # for the clipboard: the caller's own list
    return separator.join(f"'{r.id}'" if quoted else r.id for r in rows)


def parsed_ids(spark: SparkSession, text: str, known: DataFrame | None = None, id_column: str = "id") -> DataFrame:
    """(id, found): the whole numbers in pasted text, once each, and whether known has them."""
    raw = spark.createDataFrame([(text,)], "text string").select(F.explode(F.regexp_extract_all("text", F.lit(r"(\d+)"))).alias("id")).distinct()
    if known is None:
        return raw.withColumn("found", F.lit(None).cast("boolean"))
    have = known.select(F.col(id_column).cast("string").alias("id"), F.lit(True).alias("_have")).distinct()
    return raw.join(have, "id", "left").select("id", F.coalesce("_have", F.lit(False)).alias("found"))
