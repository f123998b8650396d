"""Text and currency expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.missing import let, nan_to_null, strip, value_or_null

#: Currency marks, removed in this order.
CURRENCY_MARKS = ("US$", "USD", "EUR", "GBP", "$", "€", "£")
#: What a Python float literal may look like.
_NUMBER_LOOK = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
_INFINITE = r"^[+-]?inf(inity)?$"


def squeeze(c: Column) -> Column:
    """Without white space at the ends, and with one space for each run of it inside."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def title_case(c: Column) -> Column:
    """Stripped; a letter is upper-case after anything but a letter, and lower-case otherwise."""
    words = F.split(F.lower(strip(c)), r"(?<=\P{L})(?=\p{L})")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), "")


def currency(c: Column) -> Column:
    """An amount as double, null if missing or unreadable.

    Leading minus signs make it negative; currency marks go; of comma and point the last one is the decimal separator; a comma alone
    is one if two characters follow the last; a point alone always is.
    """
    return let(value_or_null(c), _signed)


def _signed(text: Column) -> Column:
    bare = strip(F.regexp_replace(text, "^-+", ""))
    for mark in CURRENCY_MARKS:
        bare = F.replace(bare, F.lit(mark), F.lit(""))
    value = let(let(strip(bare), _plain), _number)
    return let(value, lambda v: nan_to_null(F.when(F.startswith(text, F.lit("-")), -v).otherwise(v)))


def _plain(bare: Column) -> Column:
    """Digits with a decimal point, if it is a number at all."""
    comma, point = F.contains(bare, F.lit(",")), F.contains(bare, F.lit("."))
    tail = F.substring_index(bare, ",", -1)
    no_comma = F.replace(bare, F.lit(","), F.lit(""))
    return (
        F.when(comma & point & ~F.contains(tail, F.lit(".")), F.translate(bare, ",.", "."))
        .when(comma & point, no_comma)
        .when(comma & (F.length(tail) == 2), F.replace(bare, F.lit(","), F.lit(".")))
        .when(comma, no_comma)
        .otherwise(bare)
    )


def _number(plain: Column) -> Column:
    number = F.when(F.rlike(plain, F.lit(_NUMBER_LOOK)), F.replace(plain, F.lit("_"), F.lit("")).try_cast("double"))
    infinite = F.when(F.startswith(plain, F.lit("-")), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(F.rlike(F.lower(plain), F.lit(_INFINITE)), infinite).otherwise(number)


def on_columns(df: DataFrame, columns: list[str], change) -> DataFrame:
    """`change` applied to each of the columns as text; an unknown column raises."""
    return df.withColumns({n: change(df[n].cast("string")) for n in columns})


def squeeze_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return on_columns(df, columns, squeeze)


def title_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return on_columns(df, columns, title_case)
