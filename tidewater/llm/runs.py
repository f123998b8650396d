"""Levelled sorted runs of counted hashes, a log-structured index over batches that can be opened again by its path.

A run has a row (keys, total) for each hash of a batch, sorted: how often the batch and all before it had the hash. A new batch is
merge-joined with the runs: what none has is new and begins with the batch's own count, the rest goes on from the largest total.
So a run tells by itself which hashes have reached a limit, and the batch's totals come from that join alone. FANOUT runs of a level
are compacted into one of the next level, which keeps the largest totals. Runs are written once and never changed; one that isn't
finished has no mark of success and doesn't count, and totals that two runs have are the same for it, so a job that is lost between
a compaction and the removal of what it replaces leaves an index that still is right.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import files

#: Runs of a level before they become one of the next level.
FANOUT = 3


class LevelledRuns:
    """The runs under `path`, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    def names(self) -> list[tuple[int, str]]:
        """(level, name) of the finished runs, in the order in which they were made."""
        there = files(self.spark, self.path)
        return [(int(n.rpartition("-")[2]), n) for n in sorted(there.folders()) if n.startswith("run-") and there.exists(f"{n}/_SUCCESS")]

    def _read(self, names: list[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/{n}") for n in names])

    def _write(self, rows: DataFrame, level: int) -> str:
        last = max((int(n.split("-")[1]) for _, n in self.names()), default=-1)
        name = f"run-{last + 1:08d}-{level}"
        rows.select(*self.keys, "total").sortWithinPartitions(*self.keys).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}")
        return name

    def add(self, counts: DataFrame) -> DataFrame:
        """Add a batch (keys, n), distinct; returns its own finished run (keys, total), which the next compaction may remove."""
        if earlier := self.names():
            seen = self._read([n for _, n in earlier]).groupBy(*self.keys).agg(F.max("total").alias("before"))
            joined = counts.join(seen.hint("merge"), self.keys, "left")
            counts = joined.withColumn("n", F.col("n") + F.coalesce("before", F.lit(0)))
        name = self._write(counts.withColumn("total", F.col("n").cast("long")), 0)
        return self.spark.read.parquet(f"{self.path}/{name}")

    def compact(self) -> None:
        """Put levels of FANOUT runs together, from the lowest on."""
        level = 0
        while any(k >= level for k, _ in self.names()):
            own = [n for k, n in self.names() if k == level]
            if len(own) >= FANOUT:
                self._write(self._read(own).groupBy(*self.keys).agg(F.max("total").alias("total")), level + 1)
                for name in own:
                    files(self.spark, self.path).delete(name)
            level += 1
