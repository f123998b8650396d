"""Imputation: group means, and linear interpolation in a global order without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.names import named, unused
from tidewater.session import checkpointed


def impute_by_group(df: DataFrame, value: str, group: str) -> DataFrame:
    """Missing values as the mean of their group, or the mean of all where the group is null or has none.

    Means are partial and final aggregates, joined back on the group; rows themselves aren't shuffled unless the groups are many. Other
    columns may have any names.
    """
    key, known, mean = unused(df, "group", "known", "mean")
    number = F.when(~F.isnan(named(value)), named(value))
    rows = df.select(named(group).alias(key), number.alias(known))
    means = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(known).alias(mean))
    overall = rows.agg(F.avg(known)).scalar()
    joined = df.join(means, named(group) == F.col(key), "left")
    filled = F.coalesce(number, F.col(mean), overall).alias(value)
    return joined.select(*[filled if c == value else named(c) for c in df.columns])


def interpolate(df: DataFrame, column: str, sort_by: str | None = None, tie: str | list[str] = "_row_id", partitions: int | None = None) -> DataFrame:
    """Missing values on the line between the known ones before and after, by position in the order of `sort_by`, then `tie`.

    Nulls of `sort_by` come last; before the first and after the last known value that value holds. Rows go to ranges of the order;
    windows run inside a range, and what reaches across is a row for each range, so no task sees the whole order. Both neighbours are
    running values of a growing frame (the later one in the opposite order), so the time grows with the rows of a range.
    """
    spark = df.sparkSession
    ties = [tie] if isinstance(tie, str) else tie
    order = [named(c).asc_nulls_last() for c in ([sort_by] if sort_by else []) + ties]
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    part, value, at, before, after = unused(df, "range", "value", "at", "before", "after")
    number = F.when(~F.isnan(named(column)), named(column))
    ranged = checkpointed(df.repartitionByRange(count, *order).withColumn(part, F.spark_partition_id()))
    placed = ranged.withColumn(value, number).withColumn(at, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("at"), F.col(value).alias("x")))

    def so_far(by: Column) -> Column:
        return F.last(known, True).over(Window.partitionBy(part).orderBy(by).rowsBetween(Window.unboundedPreceding, 0))

    local = placed.withColumn(before, so_far(F.asc(at))).withColumn(after, so_far(F.desc(at)))

    summary = placed.groupBy(F.col(part).alias("of")).agg(F.count("*").alias("n"), F.min(known).alias("first"), F.max(known).alias("last"))
    ranges = Window.orderBy("of")  # a row for each range
    earlier, later = ranges.rowsBetween(Window.unboundedPreceding, -1), ranges.rowsBetween(1, Window.unboundedFollowing)
    based = summary.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))

    def globally(c: Column) -> Column:
        return F.when(c.isNotNull(), F.struct((c["at"] + F.col("base")).alias("at"), c["x"].alias("x")))

    left, right = F.last(globally(F.col("last")), True).over(earlier), F.first(globally(F.col("first")), True).over(later)
    carried = based.select(F.struct("of", "base", left.alias("left"), right.alias("right")).alias(unused(df, "carried")[0]))
    across = carried.columns[0]
    joined = local.join(F.broadcast(carried), F.col(part) == F.col(across)["of"])

    def known_at(own: str, other: str) -> Column:
        shifted = F.when(F.col(own).isNotNull(), F.struct((F.col(own)["at"] + F.col(across)["base"]).alias("at"), F.col(own)["x"].alias("x")))
        return F.coalesce(shifted, F.col(across)[other])

    here, left, right = F.col(at) + F.col(across)["base"], known_at(before, "left"), known_at(after, "right")
    line = left["x"] + (right["x"] - left["x"]) * (here - left["at"]) / F.nullif(right["at"] - left["at"], F.lit(0))
    filled = F.coalesce(value, line, left["x"], right["x"]).alias(column)
    return joined.select(*[filled if c == column else named(c) for c in df.columns])
