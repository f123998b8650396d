"""Exact deduplication by content sort, with DataFrame functions only.

Rows go to ranges between sampled splitters; a range's rows are sorted, which puts equal texts side by side, and whole
neighbouring texts are compared. A place in the order is the first bytes, a hash of the text and the id: texts with a long
common beginning spread over ranges, and so do the copies of one text. What lies at both sides of a range's end is a row
or two for each range, and is put together at last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch, partitions_for, text_of

#: Sampled places for each range, and ranges for each shuffle partition.
OVERSAMPLE, RANGES = 24, 4
#: Leading bytes in a place.
LEAD = 16


def _place(text: str, id_col: str) -> Column:
    lead = F.rpad(F.hex(F.substring(F.encode(F.col(text), "UTF-8"), 1, LEAD)), 2 * LEAD, " ")
    order = F.lpad(F.hex(F.col(id_col).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(lead, F.lpad(F.hex(F.xxhash64(text)), 16, "0"), F.coalesce(order, F.lit("")))


def _range_of(place: Column, splitters: list[str]) -> Column:
    """How many splitters are at or before a place; two levels, so that a row meets about 2 sqrt(n) of them."""
    if not splitters:
        return F.lit(0)
    step = max(1, int(len(splitters) ** 0.5))
    chunks = [splitters[i : i + step] for i in range(0, len(splitters), step)]
    heads = F.array(*[F.lit(c[0]) for c in chunks])
    before = F.size(F.filter(heads, lambda s: s <= place))
    inner = F.element_at(F.array(*[F.array(*map(F.lit, c)) for c in chunks]), F.greatest(before, F.lit(1)))
    within = F.size(F.filter(inner, lambda s: s <= place))
    return F.when(before == 0, 0).otherwise((before - 1) * step + within)


def exact_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise: Callable[[Column], Column] | None = None, scratch: Scratch | None = None
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), a row for each input row.

    Texts are equal if they are after `normalise`; a null text is empty. Of a group the row with the smallest (or largest)
    id stays; null ids come first, and of repeated ids one row stays. Empty tables give no rows. Other columns of `docs`
    are left out, so their names can't clash.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "exact")
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (normalise(text) if normalise else text).alias("body"))
    placed = rows.withColumn("place", _place("body", "id"))
    ranges = RANGES * partitions_for(spark)
    fraction = min(1.0, OVERSAMPLE * ranges / max(1, docs.count()))
    sampled = sorted(r[0] for r in placed.sample(fraction, seed=11).select("place").collect())
    cut = [sampled[len(sampled) * k // ranges] for k in range(1, ranges)] if sampled else []
    dealt = placed.withColumn("part", _range_of(F.col("place"), sorted(set(cut))))

    # the place begins with bytes and hash of the text: with the whole text after it, equal texts are neighbours
    order = Window.partitionBy("part").orderBy(F.substring("place", 1, 2 * LEAD + 16), "body", F.col("id").asc_nulls_first())
    begins = ~F.coalesce(F.lag("body").over(order) == F.col("body"), F.lit(False))
    ends = ~F.coalesce(F.lead("body").over(order) == F.col("body"), F.lit(False))
    marked = dealt.select("*", begins.alias("begins"), ends.alias("ends"), F.row_number().over(order).alias("at"))
    slim = marked.select("id", "part", "at", "begins", "ends", F.sha2("body", 256).alias("digest"))
    run = F.sum(F.col("begins").cast("long")).over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    least = keep == "smallest"
    whole = Window.partitionBy("part", "run")
    found = slim.withColumn("run", run).select(
        "id", "part", "run", "digest",
        (F.col("begins") if least else F.col("ends")).alias("stands"),
        F.count("*").over(whole).alias("n"),
        (F.min("id") if least else F.max("id")).over(whole).alias("best"),
    )
    found = scratch.write(found, "runs")

    # runs at the ends of ranges: at most two for each range, so a table of bounded size
    final = found.groupBy("part").agg(F.max("run").alias("last"))
    edges = found.join(F.broadcast(final), "part").where((F.col("run") == 1) | (F.col("run") == F.col("last")))
    pieces = edges.groupBy("part", "run", "digest").agg(F.first("n").alias("n"), F.first("best").alias("best"))
    across = pieces.groupBy("digest").agg(
        F.sum("n").alias("all_n"), (F.min("best") if least else F.max("best")).alias("all_best"), (F.min("part") if least else F.max("part")).alias("home"), F.count("*").alias("parts")
    ).where("parts > 1")
    joined = found.join(F.broadcast(across), "digest", "left")
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce("all_best", "best").alias("keep_id"),
        F.coalesce("all_n", "n").cast("long").alias("group_size"),
        (F.col("stands") & (F.coalesce("home", "part") == F.col("part"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
