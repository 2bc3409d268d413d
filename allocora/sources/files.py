"""File sources and sinks."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allocora.functions.numeric import nan_to_null


class RejectedRowsError(ValueError):
    """A source holds rows that are neither data nor announced."""


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with a header row and a declared schema; a malformed row fails the read, NaN becomes NULL."""
    df = spark.read.schema(schema).csv(path, header=True, mode="FAILFAST", enforceSchema=False)
    return nan_to_null(df.select(*columns) if columns else df)


def preamble_rows(
    spark: SparkSession, path: str, preamble_lines: int, key_column: str, key_pattern: str, footer: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Rows of a CSV whose header follows some preamble lines, and the lines that were rejected.

    A source may be one file or many that begin alike; files may be split between
    tasks. Announced are the first file's preamble and header lines and ``footer``:
    lines equal to one of them, and blank lines, are dropped. Every other line is
    data and must have as many cells as the header and a key that matches, else it
    is rejected. Every column is text. Only the lines up to the header reach the
    driver.
    """
    head = [row[0] for row in spark.read.text(path).limit(preamble_lines + 1).collect()]
    if len(head) <= preamble_lines:
        raise RejectedRowsError(f"{path}: no header after {preamble_lines} lines")
    names = next(csv.reader([head[preamble_lines].lstrip("\ufeff")]))
    columns = [n if n else f"Unnamed: {i}" for i, n in enumerate(names)]
    lines = spark.read.text(path).filter(~F.col("value").isin(*head, *footer) & (F.trim("value") != ""))
    cells = F.from_csv("value", _ddl(columns), {"columnNameOfCorruptRecord": "_rejected"})
    parsed = lines.select("value", cells.alias("_cells")).select("value", "_cells.*")
    bad = F.col("_rejected").isNotNull() | ~F.coalesce(F.col(f"`{key_column}`").rlike(key_pattern), F.lit(False))
    return parsed.filter(~bad).drop("value", "_rejected"), parsed.filter(bad).select(F.col("value").alias("line"))


def _ddl(columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}` string" for c in [*columns, "_rejected"])


def read_csv_with_preamble(
    spark: SparkSession, path: str, preamble_lines: int, key_column: str, key_pattern: str, footer: Sequence[str] = ()
) -> DataFrame:
    """The rows of :func:`preamble_rows`; rejected lines fail the read, with their number and the first of them."""
    rows, rejected = preamble_rows(spark, path, preamble_lines, key_column, key_pattern, footer)
    found = rejected.agg(F.count("*").alias("n"), F.min("line").alias("first")).first()
    if found["n"]:
        raise RejectedRowsError(f"{path}: {found['n']} rows rejected, such as {found['first']!r}")
    return rows


def read_json_records(
    spark: SparkSession, path: str, record: T.StructType | str, key: str, value: str, multiline: bool = False
) -> DataFrame:
    """JSON records, one per line or one array per file, with a usable key and value; a malformed one fails the read."""
    records = spark.read.schema(record).json(path, multiLine=multiline, mode="FAILFAST")
    return usable_records(nan_to_null(records), key, value)


def read_json_pages(spark: SparkSession, path: str, record: str, key: str, value: str) -> DataFrame:
    """Records of service pages, each one line holding ``[meta, [record, …]]``; a malformed page fails the read.

    Pages are opened one by one in their tasks; a page is as large as the service
    makes it, whatever the number of pages.
    """
    strict = {"mode": "FAILFAST"}
    pages = spark.read.text(path).select(F.from_json("value", "array<string>", strict).alias("_page"))
    records = pages.select(F.inline(F.from_json(F.get("_page", F.lit(1)), f"array<struct<{record}>>", strict)))
    return usable_records(nan_to_null(records), key, value)


def records_from_text(df: DataFrame, text: str, record: str) -> DataFrame:
    """Parse a JSON text column into the fields of ``record``; a malformed text fails the query."""
    return df.withColumn("_r", F.from_json(F.col(text), record, {"mode": "FAILFAST"})).select("*", "_r.*").drop("_r", text)


def usable_records(df: DataFrame, key: str, value: str) -> DataFrame:
    """Without records that have a blank key (aggregates) or no value."""
    return df.filter((F.col(key) != "") & F.col(value).isNotNull())


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def csv_text(df: DataFrame, columns: Sequence[str] | None = None, header: bool = False) -> DataFrame:
    """Each row as one CSV line, ready for a download in any number of parts; with ``header``, a line of names first."""
    names = list(columns or df.columns)
    lines = df.select(F.to_csv(F.struct(*names)).alias("line"))
    if not header:
        return lines
    head = df.sparkSession.range(1).select(F.to_csv(F.struct(*[F.lit(n).alias(n) for n in names])).alias("line"))
    return head.unionByName(lines)
