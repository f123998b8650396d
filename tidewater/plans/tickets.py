"""The ticket cleansing plan, from a dirty table to valid and invalid rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.missing import drop_blank_rows, read_missing
from tidewater.functions.temporal import hours_between, iso_column, use_utc, utc_column
from tidewater.functions.text import currency, squeeze_columns, title_columns
from tidewater.operators.contract import TICKETS
from tidewater.operators.flatten import flatten_json
from tidewater.operators.impute import impute_by_group, interpolate
from tidewater.operators.profile import error_count_top, outcome
from tidewater.operators.unify import unify_names
from tidewater.session import checkpointed
from tidewater.sources.tables import read_csv, with_row_id, write_csv

TEXT_COLUMNS = ["company_name", "agent_name", "customer_email", "priority", "status", "category"]
CASE_COLUMNS = ["priority", "status", "category"]


def tidy(df: DataFrame, paths=None) -> DataFrame:
    """The stages that look at one row at a time: JSON, dates, white space, case, cost. With `paths` it works on streams."""
    df = flatten_json(df, "user_metadata", paths=paths)
    df = utc_column(utc_column(df, "created_at"), "resolved_at")
    df = title_columns(squeeze_columns(df, TEXT_COLUMNS), CASE_COLUMNS)
    return df.withColumn("cost", currency(F.col("cost")))


def clean_tickets(raw: DataFrame, threshold: float = 80) -> DataFrame:
    """All rows but blank ones, cleansed and annotated with `errors`; rows that will be rejected count in means and orders too."""
    use_utc(raw.sparkSession)
    # a ticket's id places it whatever the partitions; the scan's order decides where ids are missing or repeated
    df = checkpointed(with_row_id(drop_blank_rows(raw)))
    df = tidy(df)
    df = unify_names(df, "company_name", threshold)
    df = df.withColumn("response_time_hours", hours_between(F.col("created_at"), F.col("resolved_at")))
    df = impute_by_group(df, "cost", "category")
    df = interpolate(df, "response_time_hours", sort_by="created_at", tie=["ticket_id", "_row_id"])
    df = iso_column(iso_column(df, "created_at"), "resolved_at").drop("_row_id")
    return TICKETS.annotate(df)


def run_pipeline(spark: SparkSession, source: str | DataFrame, threshold: float = 80) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) tickets of a CSV path or a raw table; what both share is computed once."""
    raw = read_csv(spark, source) if isinstance(source, str) else read_missing(source)
    annotated = checkpointed(clean_tickets(raw, threshold))
    invalid = annotated.where(F.size("errors") > 0).withColumn("validation_error", TICKETS.rendered(F.col("errors")))
    return annotated.where(F.size("errors") == 0).drop("errors"), invalid


def write_outcome(valid: DataFrame, invalid: DataFrame, folder: str) -> None:
    """Both tables as CSV; both are always written, so none is left from an earlier run."""
    write_csv(valid, f"{folder}/clean_tickets")
    write_csv(invalid.drop("errors"), f"{folder}/invalid_tickets")


def summary(annotated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of rows, and the most common first lines of errors."""
    invalid = annotated.where(F.size("errors") > 0).withColumn("validation_error", TICKETS.rendered(F.col("errors")))
    return outcome(annotated), error_count_top(invalid)
