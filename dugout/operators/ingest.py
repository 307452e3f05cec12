"""From raw rows to classified pitches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.functions import flags


def snake_names(names: Iterable[str]) -> list[str]:
    """Header names as unique snake_case identifiers.

    Accents are dropped first. Word breaks are taken from case changes and from anything that is
    not a letter or digit; a repeated result gets _2, _3 and so on.
    """
    out: list[str] = []
    for name in names:
        plain = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
        text = plain.replace("%", "_percent_").replace("#", "_number_").replace("'", "").replace('"', "")
        text = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", text)
        text = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", text)
        text = re.sub(r"[^0-9A-Za-z]+", "_", text).strip("_").lower() or "x"
        if text[0].isdigit():
            text = f"x{text}"
        unique, n = text, 1
        while unique in out:
            n += 1
            unique = f"{text}_{n}"
        out.append(unique)
    return out


def clean_names(df: DataFrame) -> DataFrame:
    """Rename all columns at once; metadata only, no data is touched."""
    return df.toDF(*snake_names(df.columns))


def bucket_pitch_group(df: DataFrame) -> DataFrame:
    return df.withColumn("pitch_group", flags.pitch_group())


def known_groups(df: DataFrame) -> DataFrame:
    return df.where(F.col("pitch_group") != flags.UNKNOWN_GROUP)


def clean(raw: DataFrame) -> DataFrame:
    """Classified pitches of known groups."""
    return raw.transform(bucket_pitch_group).transform(known_groups)


def flagged(raw: DataFrame) -> DataFrame:
    return raw.transform(clean).transform(flags.with_flags)


def batting_team(df: DataFrame) -> DataFrame:
    """The away side bats in the top half, the home side otherwise; unknown half, unknown team."""
    top = F.col("inning_topbot") == "Top"
    return df.withColumn("batting_team", F.when(top, F.col("away_team")).when(~top, F.col("home_team")))
