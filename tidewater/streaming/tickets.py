"""Cleansing of a stream of tickets, beyond batch.

Stages that look at one row at a time run on the stream itself. Means, the order and the names need a whole table; a stream takes
them from tables that a batch run has made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewater.functions.missing import drop_blank_rows, read_missing
from tidewater.functions.temporal import hours_between, iso_column, use_utc
from tidewater.operators.contract import TICKETS
from tidewater.plans.tickets import tidy


def clean_stream(raw: DataFrame, paths: dict, means: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """Annotated tickets. paths: of the JSON column; means: (category, cost); names: (name, canonical), both static."""
    use_utc(raw.sparkSession)
    df = tidy(drop_blank_rows(read_missing(raw)), paths)
    if names is not None:
        known = names.withColumnsRenamed({"name": "company_name", "canonical": "__canonical"})
        df = df.join(known, "company_name", "left").withColumn("company_name", F.coalesce("__canonical", "company_name")).drop("__canonical")
    df = df.withColumn("response_time_hours", hours_between(F.col("created_at"), F.col("resolved_at")))
    if means is not None:
        df = df.join(means.withColumnRenamed("cost", "__mean"), "category", "left").withColumn("cost", F.coalesce("cost", "__mean")).drop("__mean")
    return TICKETS.annotate(iso_column(iso_column(df, "created_at"), "resolved_at"))


def write_split(annotated: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Valid and invalid rows to two Parquet tables, each batch in a folder of its own, so that a batch that runs again replaces itself."""

    def sink(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for name, rows in (("valid", kept.where(F.size("errors") == 0)), ("invalid", kept.where(F.size("errors") > 0))):
                rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        finally:
            kept.unpersist()

    return annotated.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
