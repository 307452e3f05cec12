"""CSV in and out, Parquet snapshots between jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dugout.functions.nullsafe import no_nan
from dugout.operators.columns import sort_missing_last

MISSING = "NA"


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read CSV with a header under a declared schema.

    Empty fields and the marker are both missing. Spark takes one marker only and keeps a
    quoted empty field as an empty string, hence the second step.
    """
    raw = spark.read.schema(schema).option("header", True).option("nullValue", MISSING).csv(path)
    strings = [f.name for f in schema if isinstance(f.dataType, T.StringType)]
    blanks = {name: F.nullif(F.col(name), F.lit("")) for name in strings}
    return no_nan(raw.withColumns(blanks) if blanks else raw)


def sink_csv(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """Write a directory of CSV parts, one per task, each with a header; replaces what is there.

    With an order, the parts in the order of their names are ascending, missing values last.
    """
    if order:
        df = sort_missing_last(df, *order)
    df.write.mode("overwrite").option("header", True).option("nullValue", MISSING).csv(path)


def write_snapshot(df: DataFrame, path: str, partition_by: str = "game_year") -> None:
    """Write a partitioned Parquet table.

    The rebalance hint sends rows of a partition value together, so a wide job does not leave
    tasks x values small files, and lets adaptive execution split a value that is too large.
    """
    df.hint("rebalance", partition_by).write.mode("overwrite").partitionBy(partition_by).parquet(path)


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)
