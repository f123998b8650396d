"""Three vocabularies of missing values, which act at different points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as missing when a text table is read (exact, case-sensitive, not trimmed).
READ_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
#: What date and currency parsers take for missing (trimmed, in lower case).
VALUE_TOKENS = ("", "nan", "none", "null", "n/a", "na", "-", "?")
#: What the JSON parser takes for an empty object (trimmed, in lower case).
JSON_TOKENS = ("", "null", "none", "nan", "{}")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it; inside of branches Spark would compute it anew."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space, in the Unicode sense, at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def read_missing(df: DataFrame) -> DataFrame:
    """Every string column with READ_TOKENS as nulls."""
    return df.select(*[F.when(F.col(f"`{n}`").isin(*READ_TOKENS), None).otherwise(F.col(f"`{n}`")).alias(n) if t == "string" else F.col(f"`{n}`") for n, t in df.dtypes])


def value_or_null(c: Column) -> Column:
    """Stripped text, null where it is one of VALUE_TOKENS."""
    return let(strip(c), lambda text: F.when(~F.lower(text).isin(*VALUE_TOKENS), text))


def drop_blank_rows(df: DataFrame) -> DataFrame:
    """Without rows that are null in every column."""
    return df.dropna(how="all")


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)
