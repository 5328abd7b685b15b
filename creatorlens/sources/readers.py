"""Table readers and writers."""

from __future__ import annotations

import csv
from collections.abc import Iterable, Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .csv_split import first_lines, records

POSITION = "_pos"
BAD_ROW = "_bad_row"

# --- Fixed values: cell texts that mean "missing" in a CSV export ---
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)


class MissingInputError(FileNotFoundError):
    """An input table is absent; the message names the step that creates it."""


def _guard(load, path: str, made_by: str) -> DataFrame:
    try:
        return load()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in (e.getCondition() or ""):
            raise MissingInputError(f"{path} not found: run {made_by} first") from e
        raise


def _columns(header: str) -> tuple[str, ...]:
    """Column names in the first line of a file."""
    return tuple(next(csv.reader([header]), ()))


def _parsed_records(spark: SparkSession, files: list[str], schema: T.StructType) -> DataFrame:
    """Rows of files whose quoted cells may hold line breaks, with the place of each as ``_at``."""
    text = F.regexp_replace("text", "\r$", "")
    body = records(spark, files).where("block > 0 or row > 0").withColumn("text", text).where(F.trim("text") != "")
    ddl = ", ".join("`{}` string".format(n.replace("`", "``")) for n in schema.names)
    options = {"quote": '"', "escape": '"', "multiLine": "true", "columnNameOfCorruptRecord": BAD_ROW}
    return body.select(F.from_csv("text", ddl, options).alias("r"), F.struct("file", "block", "row").alias("_at")).select("r.*", "_at")


def _csv_by_name(
    spark: SparkSession,
    path: str,
    names: Sequence[str],
    multi_line: bool,
    fail_on_malformed: bool,
    with_position: bool = False,
    quoted_breaks: bool = False,
) -> DataFrame:
    """Headered CSV files as text, columns found by name.

    Spark applies a schema by place, so every file's header is read first, by tasks, and files
    of one header are read together; their columns may stand in any order, and others may stand
    between them. A row whose number of cells differs from its header's makes the read fail,
    or is cut and padded if ``fail_on_malformed`` is off.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, line in sorted(first_lines(spark, path)):
        file, header = unquote(file), _columns(line)
        if not header:
            continue
        missing = [n for n in names if n not in header]
        if missing:
            raise ValueError(f"{file}: no column {', '.join(missing)}")
        groups.setdefault(header, []).append(file)
    out = None
    for header, members in groups.items():
        if len(set(header)) < len(header):
            raise ValueError(f"{members[0]}: a column name occurs twice")
        fields = [T.StructField(n, T.StringType()) for n in (*header, BAD_ROW)]
        if quoted_breaks:
            df = _parsed_records(spark, members, T.StructType(fields))
            place = F.col("_at")
        else:
            df = (
                spark.read.schema(T.StructType(fields))
                .option("header", True).option("quote", '"').option("escape", '"')
                .option("multiLine", multi_line).option("columnNameOfCorruptRecord", BAD_ROW)
                .csv(members)
            )
            place = F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("row"),
            )
        if fail_on_malformed:
            # with a data column in it, since Spark reads no file for its bad rows alone
            first = F.coalesce(F.col(f"`{names[0]}`"), F.lit(""))
            text = F.concat(F.lit("row with too many or too few cells: "), F.substring(BAD_ROW, 1, 200), F.lit(" / "), first)
            df = df.where(F.when(F.col(BAD_ROW).isNotNull(), F.raise_error(text).cast("boolean")).otherwise(True))
        df = df.select(*[F.col(f"`{n}`") for n in names], *[place.alias(POSITION)] * with_position)
        out = df if out is None else out.union(df)
    if out is None:
        out = spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in names]))
    return out


def read_strings(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    made_by: str = "the export",
    with_position: bool = True,
    multi_line: bool = False,
    fail_on_malformed: bool = True,
    quoted_breaks: bool = False,
) -> DataFrame:
    """Headered CSV with every column as text, plus each row's place in its file.

    Columns are found by name. Cells holding one of the usual missing-value texts are read
    as null. ``quoted_breaks`` allows line breaks in quoted cells and still splits files over
    tasks; quotes must stand around cells and be doubled inside, a quote never closed takes the
    rest of its file, and lines must end in \\n or \\r\\n. ``multi_line`` leaves all that to Spark's own
    reader, at the price that one task reads a whole file.

    The position orders rows by file, block and row within the block, so
    "first occurrence" does not depend on how Spark packs files into tasks.
    """
    df = _guard(
        lambda: _csv_by_name(spark, path, schema.names, multi_line, fail_on_malformed, with_position, quoted_breaks),
        path,
        made_by,
    )
    values = [
        F.when(~F.col(c).isin(*MISSING_TEXTS), F.col(c)).alias(c) for c in schema.names
    ]
    if with_position and POSITION not in df.columns:  # no file has a row
        df = df.withColumn(POSITION, F.lit(None).cast("struct<file:string,block:bigint,row:bigint>"))
    return df.select(*values, *[POSITION] * with_position)


def read_typed(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "parquet",
    made_by: str = "the cleaning job",
    multi_line: bool = False,
    quoted_breaks: bool = False,
) -> DataFrame:
    """Typed table from Parquet or headered CSV (columns by name, dates as yyyy-MM-dd; a
    cell that does not fit its type is null)."""
    if fmt != "csv":
        return _guard(lambda: spark.read.schema(schema).format(fmt).load(path), path, made_by)
    df = _guard(lambda: _csv_by_name(spark, path, schema.names, multi_line, True, quoted_breaks=quoted_breaks), path, made_by)
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema])


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Overwrite ``path``; CSV output is headered, doubles keep full precision."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = (
            writer.option("header", True)
            .option("quote", '"')
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
        )
    writer.save(path)


def register_views(**tables: DataFrame) -> None:
    """Expose frames to Spark SQL under the given names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def with_column_if_absent(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, value)


def project_existing(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Ordered projection of those ``columns`` the frame has."""
    have = set(df.columns)
    return df.select(*[c for c in columns if c in have])
