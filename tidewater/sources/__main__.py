"""python -m tidewater.sources OUT [ROWS] [SEED]: write synthetic dirty tickets as CSV."""

import sys

from pyspark.sql import SparkSession

from tidewater.sources.synthetic import dirty_tickets
from tidewater.sources.tables import write_csv

if __name__ == "__main__":
    spark = SparkSession.builder.getOrCreate()
    rows = int(sys.argv[2]) if len(sys.argv) > 2 else 10_000
    write_csv(dirty_tickets(spark, rows, int(sys.argv[3]) if len(sys.argv) > 3 else 42), sys.argv[1])
    print(f"{rows} rows to {sys.argv[1]}")
