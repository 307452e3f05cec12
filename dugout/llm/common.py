"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts that split at ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def boxed(df: DataFrame) -> Column:
    """All columns as one struct, so that no name an operator adds can clash with one of the input."""
    return F.struct(*[col(c) for c in df.columns])


def unboxed(df: DataFrame, box: str, names: list[str]) -> list[Column]:
    return [F.col(box).getField(n).alias(n) for n in names]


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def row_hash(df: DataFrame) -> Column:
    """64 bits over all columns that can be hashed; rows that differ elsewhere only are ties."""
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*[col(c) for c in plain]) if plain else F.lit(0).cast("long")


def source_key(source: Column) -> Column:
    """Sorts by code point with null last, and joins null to null."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))
