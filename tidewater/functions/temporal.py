"""Dates in mixed formats and zones to UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.missing import let, value_or_null
from tidewater.functions.names import named

#: Zone names and the offsets that they stand for, without daylight saving.
ZONES = {"UTC": "+00:00", "Z": "+00:00", "EST": "-05:00", "PST": "-08:00", "CET": "+01:00"}
_NAMED = r"^(?:(.*) |(.*[0-9]))(UTC|Z|EST|PST|CET)$"

_MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
_DAYS = "mon(?:day)?|tue(?:s|sday)?|wed(?:nesday)?|thu(?:rs|rsday)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?"
#: The grammar, see to_utc: a date in one of five forms, then a time, then an offset.
_GRAMMAR = (
    rf"(?i)^(?:(?:{_DAYS}),? +)?"
    r"(?:(?<y1>\d{4})(?<sep>[-/.])(?<a1>\d{1,2})\k<sep>(?<b1>\d{1,2})"
    r"|(?<y2>\d{4})(?<a2>\d{2})(?<b2>\d{2})"
    r"|(?<a3>\d{1,2})(?<mark>[-/.])(?<b3>\d{1,2})\k<mark>(?<y3>\d{4}|\d{2})"
    rf"|(?<n4>{_MONTHS})\.? +(?<d4>\d{{1,2}})(?:st|nd|rd|th)?,? +(?<y4>\d{{4}})"
    rf"|(?<d5>\d{{1,2}})(?:st|nd|rd|th)?(?:-| +)(?<n5>{_MONTHS})\.?(?:-|,? +)(?<y5>\d{{4}}|\d{{2}}))"
    r"(?:(?:T|,? +)(?<h>\d{1,2}):(?<min>\d{2})(?::(?<s>\d{2})(?:[.,](?<f>\d{1,9})\d*)?)?(?: *(?<ap>[ap])m)?"
    r"(?: *(?<sign>[+-])(?<oh>\d{2}):?(?<om>\d{2})?)?)?$"
)
#: What each part is made of: one of the forms has it, the others leave it empty.
_PARTS = {
    "y": "${y1}${y2}${y3}${y4}${y5}", "a": "${a1}${a2}${a3}", "b": "${b1}${b2}${b3}", "day": "${d4}${d5}", "name": "${n4}${n5}",
    "h": "${h}", "min": "${min}", "s": "${s}", "f": "${f}", "ap": "${ap}", "sign": "${sign}", "oh": "${oh}", "om": "${om}",
}
_MARK = "\x01"
#: Two digits below this are years after 2000; what a 64-bit count of nanoseconds reaches.
_CENTURY, _FIRST, _LAST = 69, "1677-09-21 00:12:43.145224Z", "2262-04-11 23:47:16.854775Z"


def use_utc(spark: SparkSession) -> None:
    """Timestamps as text are in UTC in this session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def zone_to_offset(text: Column) -> Column:
    """A text whose zone name at the end, after a space or a digit, has become an offset."""
    base = F.trim(F.coalesce(F.nullif(F.regexp_extract(text, _NAMED, 1), F.lit("")), F.regexp_extract(text, _NAMED, 2)))
    offset = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])[F.regexp_extract(text, _NAMED, 3)]
    return F.when(F.rlike(text, F.lit(_NAMED)), F.concat_ws(" ", base, offset)).otherwise(text)


def to_utc(c: Column) -> Column:
    """A timestamp, null if missing or unreadable; without a zone the text is in UTC.

    Dates: year, month and day parted by one of `-/.`, or as eight digits; month, day and year parted so; month's name, day and
    year; day, month's name and year. Where the first of two numbers can't be a month, the second is. Before a date a weekday may
    stand. Times: hours and minutes, with seconds and a fraction or without, by 24 hours or with AM or PM. Offsets, after a time only:
    `+HH:MM`, `+HHMM` or `+HH`, or a name of ZONES.
    """
    return let(let(value_or_null(c.cast("string")), zone_to_offset), _read)


def _read(text: Column) -> Column:
    cut = F.split(F.regexp_replace(text, _GRAMMAR, _MARK.join(_PARTS.values())), _MARK)
    return let(F.when(~F.contains(text, F.lit(_MARK)), cut), _put_together)


def _put_together(parts: Column) -> Column:
    part = {name: F.get(parts, F.lit(k)) for k, name in enumerate(_PARTS)}

    def number(name: str, empty: int | None = 0) -> Column:
        return F.when(part[name] == "", F.lit(empty)).otherwise(part[name].cast("int"))

    def filled(name: str, digits: int) -> Column:
        return F.rpad(F.substring(part[name], 1, digits), digits, "0").cast("int")

    year = F.when(F.length(part["y"]) > 2, number("y")).when(number("y") < _CENTURY, number("y") + 2000).otherwise(number("y") + 1900)
    from_name = F.position(F.lower(F.left(part["name"], F.lit(3))), F.lit("janfebmaraprmayjunjulaugsepoctnovdec"))
    swapped = number("a") > 12
    by_name = part["name"] != ""
    month = F.when(by_name, ((from_name + 2) / 3).cast("int")).when(swapped, number("b")).otherwise(number("a"))
    day = F.when(by_name, number("day")).when(swapped, number("a")).otherwise(number("b"))
    late, early = F.lower(part["ap"]) == "p", F.lower(part["ap"]) == "a"
    hour = F.when(late & (number("h") < 12), number("h") + 12).when(early & (number("h") == 12), 0).otherwise(number("h"))
    second = number("s").cast("decimal(16,6)") + filled("f", 6) / F.lit(1_000_000).cast("decimal(8,0)")
    at = F.try_make_timestamp(year, month, day, hour, number("min"), second.cast("decimal(16,6)"), F.lit("UTC"))
    minutes = (number("oh") * 60 + number("om")) * F.when(part["sign"] == "-", -1).otherwise(1)
    good = (F.size(parts) == len(_PARTS)) & (number("s") < 60) & ((part["ap"] == "") | (number("h") <= 12)) & (number("oh") < 24) & (number("om") < 60)
    utc = F.timestamp_micros(F.unix_micros(at) - minutes * F.lit(60_000_000).cast("long"))
    return F.when(good, let(utc, lambda t: F.when(t.between(F.lit(_FIRST).cast("timestamp"), F.lit(_LAST).cast("timestamp")), t)))


def utc_column(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    return df.withColumn(output or column, to_utc(named(column)))


def iso8601(ts: Column) -> Column:
    """ISO 8601 text with offset; a fraction only if there is one."""
    whole = F.unix_micros(ts) % 1_000_000 == 0
    return F.when(whole, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))


def iso_column(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, iso8601(named(column)))


def hours_between(begin: Column, end: Column) -> Column:
    """Hours from one timestamp to another, with fractions; may be negative."""
    return (F.unix_micros(end) - F.unix_micros(begin)) / F.lit(3.6e9)
