"""python -m tidewater.plans IN OUT: cleanse a CSV of tickets and write valid and invalid ones."""

import sys

from pyspark.sql import SparkSession

from tidewater.operators.profile import error_count_top
from tidewater.plans.tickets import run_pipeline, write_outcome

if __name__ == "__main__":
    session = SparkSession.builder.getOrCreate()
    good, bad = run_pipeline(session, sys.argv[1])
    write_outcome(good, bad, sys.argv[2])
    print(f"valid: {good.count()}, invalid: {bad.count()}")
    error_count_top(bad).show(10, truncate=False)
