"""Session helpers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let the executors import this package, once for each application; it is a small archive of source files."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="tidewater-")) / f"{_PACKAGE.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(_PACKAGE.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a local session without one gets a temporary one."""
    context = spark.sparkContext
    there = context._jsc.sc().getCheckpointDir()
    if not there.isEmpty():
        return spark.conf.get("spark.checkpoint.dir", None) or there.get()
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tidewater-")
    context.setCheckpointDir(where)
    return where


def checkpointed(df: DataFrame) -> DataFrame:
    """A DataFrame cut from its lineage, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
