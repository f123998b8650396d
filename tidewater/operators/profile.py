"""Profiles of dirty and clean tables; small results that charts can be drawn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.names import named
from tidewater.session import checkpointed


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, nulls) from one pass, most nulls first."""
    counted = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return counted.unpivot([], [F.col(f"`{c}`") for c in df.columns], "column_name", "nulls").orderBy(F.desc("nulls"), "column_name")


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def blank_ratio(df: DataFrame) -> DataFrame:
    """(blank_rows, n_rows, ratio): rows that are null in every column."""
    blank = F.greatest(*[F.col(f"`{c}`").isNotNull() for c in df.columns]) if len(df.columns) > 1 else F.col(f"`{df.columns[0]}`").isNotNull()
    out = df.agg(F.count_if(~blank).alias("blank_rows"), F.count("*").alias("n_rows"))
    return out.withColumn("ratio", F.coalesce(F.col("blank_rows") / F.nullif("n_rows", F.lit(0)), F.lit(0.0)))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of the values that aren't null, most frequent first, then by value."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def distinct_count(df: DataFrame, *columns: str) -> DataFrame:
    """(distinct_<column>) for each column, nulls not counted, exact."""
    return df.agg(*[F.countDistinct(c).alias(f"distinct_{c}") for c in columns])


def containing(df: DataFrame, column: str, *parts: str) -> DataFrame:
    """Different values that have all parts, without regard to case."""
    text = F.lower(F.col(column))
    hit = F.lit(True)
    for p in parts:
        hit = hit & F.contains(text, F.lit(p.lower()))
    return df.where(hit).select(F.col(column).alias("value")).distinct()


def box_stats(df: DataFrame, value: str, group: str) -> DataFrame:
    """Quartiles and whiskers (the farthest values within 1.5 interquartile ranges) of each group, exact.

    Different values and their counts go to ranges of the order; a value's place is its place in the range and what earlier ranges
    hold of the group, so no task gathers a group, however large.
    """
    g, v = named(group), named(value)
    known = df.where(v.isNotNull() & ~F.isnan(v) & g.isNotNull()).select(g.alias("g"), v.alias("v"))
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = known.groupBy("g", "v").agg(F.count("*").alias("n")).repartitionByRange(ranges, "g", "v")
    ranged = checkpointed(counts.withColumn("part", F.spark_partition_id()))
    held = ranged.groupBy("g", "part").agg(F.sum("n").alias("n"))  # a row for each group in a range
    by_group = Window.partitionBy("g")
    based = held.select("g", "part", F.sum("n").over(by_group).alias("total"), (F.sum("n").over(by_group.orderBy("part")) - F.col("n")).alias("base"))
    inside = F.sum("n").over(Window.partitionBy("g", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("end", inside).join(based, ["g", "part"]).withColumn("end", F.col("end") + F.col("base"))
    shares = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    parts = []
    for name, share in shares.items():
        at = (F.col("total") - 1) * share
        for side, place in (("low", F.floor(at)), ("high", F.ceil(at))):
            parts.append(F.max(F.when((F.col("end") - F.col("n") <= place) & (place < F.col("end")), F.col("v"))).alias(f"{name}_{side}"))
    found = placed.groupBy("g").agg(F.first("total").alias("total"), *parts)

    def between(name: str) -> Column:
        at = (F.col("total") - 1) * shares[name]
        return (F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * (at - F.floor(at))).alias(name)

    quartiles = found.select("g", *map(between, shares))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    near = ranged.join(quartiles, "g").where((F.col("v") >= F.col("q1") - reach) & (F.col("v") <= F.col("q3") + reach))
    whiskers = near.groupBy("g").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return quartiles.join(whiskers, "g").select(F.col("g").alias(group), "low", *shares, "high")


def error_count_top(invalid: DataFrame, k: int = 10) -> DataFrame:
    """(first_line, n): how many errors rejected rows have, by the first line of their text; the k most common."""
    line = F.substring_index("validation_error", "\n", 1).alias("first_line")
    return invalid.groupBy(line).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "first_line").limit(k)


def reasons(invalid: DataFrame) -> DataFrame:
    """(field, n): in how many rows each field is at fault."""
    return invalid.select(F.explode("errors.field").alias("field")).groupBy("field").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field")


def outcome(annotated: DataFrame) -> DataFrame:
    """(n_rows, n_valid, n_invalid, share_invalid) from one pass over rows with `errors`."""
    out = annotated.agg(F.count("*").alias("n_rows"), F.count_if(F.size("errors") == 0).alias("n_valid"), F.count_if(F.size("errors") > 0).alias("n_invalid"))
    return out.withColumn("share_invalid", F.coalesce(F.col("n_invalid") / F.nullif("n_rows", F.lit(0)), F.lit(0.0)))


def _drawn(seed: int, value: Column) -> Column:
    """A place in a seeded order: the MD5 digest of the seed and the value's text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), value.cast("string")))


def sample_of(df: DataFrame, column: str, k: int, seed: int = 42) -> DataFrame:
    """k values that aren't null, by the order of a seeded digest: the same ones whatever the partitions."""
    own = df.where(named(column).isNotNull()).select(named(column).alias("value"))
    return own.orderBy(_drawn(seed, F.col("value")), "value").limit(k)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """All rows in a seeded order."""
    return df.orderBy(_drawn(seed, named(key)), named(key))
