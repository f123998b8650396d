"""Column names: any text as a reference, and names that a table doesn't have yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, *stems: str) -> list[str]:
    """For each stem a name that `df` doesn't have, without regard to case."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name, k = f"__{stem}", 2
        while name.lower() in taken:
            name, k = f"__{stem}_{k}", k + 1
        taken.add(name.lower())
        out.append(name)
    return out
