"""One name for each group of similar names.

Names are taken from the most frequent to the least; a name that no earlier leader has claimed leads, and claims all unclaimed names
that are similar enough. So a name leads exactly if no leader before it is similar, and otherwise belongs to the first such
leader: rounds settle all names whose earlier neighbours are settled, which needs only the pairs that are similar.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.missing import strip
from tidewater.functions.names import named, unused
from tidewater.session import checkpointed

#: Different names in a block; each pair of blocks is a task's work.
BLOCK = 1000
#: Different names that are compared unless more are asked for: twenty thousand tasks of a million pairs each.
MOST_NAMES = 200_000


def name_counts(df: DataFrame, column: str) -> DataFrame:
    """(name, n) of the stripped, non-empty names."""
    return df.select(strip(named(column).cast("string")).alias("name")).where("name <> ''").groupBy("name").agg(F.count("*").alias("n"))


def similar_pairs(ranked: DataFrame, threshold: float, blocks: int) -> DataFrame:
    """(a, b): places, a before b, of names scoring at least `threshold`. Names meet in pairs of blocks; only similar pairs come out.

    Scores are computed only where an exact upper bound, from the numbers of each character and the common words, reaches the threshold.
    """
    own = F.pmod(F.xxhash64("rank"), F.lit(blocks))
    met = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.least(own, k) * blocks + F.greatest(own, k))
    dealt = ranked.select("rank", "name", own.alias("block"), F.explode(met).alias("task"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from tidewater.functions.similarity import Bounds, prepared, weighted_ratio

        task = int(pdf["task"].iloc[0])
        low, high = divmod(task, blocks)
        pdf = pdf.sort_values("rank", ignore_index=True)
        rank, block, texts = pdf["rank"].to_list(), pdf["block"].to_numpy(), [prepared(t) for t in pdf["name"]]
        bounds, found = Bounds(texts), []
        other = (block == high).nonzero()[0]
        for i in (block == low).nonzero()[0].tolist():
            against = other[other > i] if low == high else other
            for j in against[bounds.reach(i, against) >= threshold].tolist():
                if weighted_ratio(texts[i], texts[j]) >= threshold:
                    found.append((rank[min(i, j)], rank[max(i, j)]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="object")

    return dealt.groupBy("task").applyInPandas(run, "a string, b string")


def canonical_names(df: DataFrame, column: str, threshold: float = 80, block: int = BLOCK, most_names: int = MOST_NAMES) -> DataFrame:
    """(name, canonical) of the different names; of equally frequent ones the lesser text comes first.

    All different names are compared, so the work is quadratic in their number; more than `most_names` raise before it begins.
    """
    counts = checkpointed(name_counts(df, column))
    if (many := counts.count()) > most_names:
        raise ValueError(f"{column} has {many} different names; comparing them takes {many * many // 2} pairs. Raise `most_names` to do so")
    blocks = max(1, -(-many // block))
    # the place in the order of taking: a number with leading zeros that falls with the frequency, then the name
    place = F.concat(F.lpad(F.hex(F.lit(1 << 62) - F.col("n")), 16, "0"), F.col("name"))
    ranked = checkpointed(counts.select(place.alias("rank"), "name"))
    pairs = checkpointed(similar_pairs(ranked, threshold, blocks))
    state = ranked.select("rank", F.lit(None).cast("boolean").alias("leads"))
    while True:
        before = pairs.join(state.select(F.col("rank").alias("a"), "leads"), "a")
        seen = before.groupBy("b").agg(F.bool_or("leads").alias("claimed"), F.count_if(F.col("leads").isNull()).alias("open"))
        decided = F.when(F.coalesce("claimed", F.lit(False)), False).when(F.coalesce("open", F.lit(0)) == 0, True)
        state = checkpointed(state.join(seen, F.col("rank") == F.col("b"), "left").select("rank", F.coalesce("leads", decided).alias("leads")))
        if state.where("leads IS NULL").isEmpty():
            break
    leaders = pairs.join(state.where("leads").select(F.col("rank").alias("a")), "a").groupBy("b").agg(F.min("a").alias("leader"))
    of = ranked.join(leaders, ranked["rank"] == leaders["b"], "left").select("name", F.coalesce("leader", "rank").alias("leader"))
    return of.join(ranked.select(F.col("rank").alias("leader"), F.col("name").alias("canonical")), "leader").select("name", "canonical")


def unify_names(df: DataFrame, column: str, threshold: float = 80, block: int = BLOCK, most_names: int = MOST_NAMES) -> DataFrame:
    """`column` with each name as its group's leader; missing and blank names are null. Other columns may have any names."""
    stripped, name, leader = unused(df, "stripped", "name", "leader")
    names = canonical_names(df, column, threshold, block, most_names).select(F.col("name").alias(name), F.col("canonical").alias(leader))
    given = df.withColumn(stripped, F.nullif(strip(named(column).cast("string")), F.lit("")))
    joined = given.join(names, F.col(stripped) == F.col(name), "left")
    unified = F.coalesce(leader, stripped).alias(column)
    return joined.select(*[unified if c == column else named(c) for c in df.columns])


def are_unified(names: DataFrame, threshold: float = 80) -> bool:
    """Whether, of (given, name), each given name is at least so similar to its group's name, or is it, and no two of the latter are."""
    from tidewater.functions.similarity import similarity

    pairs = checkpointed(names.where("given IS NOT NULL").distinct())
    score = F.udf(lambda a, b: similarity(a, b), "double")
    if not pairs.where("name IS NULL").isEmpty() or not pairs.where("given <> name").where(score("given", "name") < threshold).isEmpty():
        return False
    left = checkpointed(pairs.select(F.col("name").alias("rank"), "name").distinct())
    return similar_pairs(left, threshold, max(1, -(-left.count() // BLOCK))).isEmpty()
