"""Reading and writing dirty tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.missing import read_missing

TICKET_COLUMNS = (
    "ticket_id", "company_name", "customer_email", "created_at", "resolved_at", "priority",
    "status", "category", "agent_name", "cost", "user_metadata",
)
TICKET_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in TICKET_COLUMNS])


def read_csv(spark: SparkSession, path: str, schema: T.StructType = TICKET_SCHEMA, multi_line: bool = False) -> DataFrame:
    """A CSV table with a header as text columns, missing values as nulls. `multi_line` allows line feeds in values, but then a file isn't split."""
    reader = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", multi_line)
    return read_missing(reader.csv(path))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; null and empty text are both empty; what was there is replaced. Arrays and structs become JSON text."""
    shown = df.select(*[F.to_json(f"`{n}`").alias(n) if t.startswith(("array", "struct", "map")) else F.col(f"`{n}`") for n, t in df.dtypes])
    shown.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def read_table(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return spark.read.format(kind).load(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    df.write.mode("overwrite").format(kind).save(path)


def with_row_id(df: DataFrame) -> DataFrame:
    """A column _row_id that follows the order of the scan; to be added before any shuffle."""
    return df.withColumn("_row_id", F.monotonically_increasing_id())
