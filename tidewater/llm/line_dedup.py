"""Removal of lines that many documents share, with DataFrame functions only.

The line hashes of earlier batches lie in levelled sorted runs (see runs.py). A new batch counts its own lines and merge-joins the
runs: lines that none has are new, the others go on counting from there, and what the batch brings to the limit goes from then on.
The batch adds its run, and runs are compacted. An index that is kept by its path serves the batches of later days.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch, row_key, text_of
from tidewater.llm.runs import LevelledRuns

#: Shared lines that are broadcast at most (16 bytes each); beyond it the join sorts both sides.
BROADCAST_ROWS = 500_000
#: The white space that is stripped, and the letters that are lower-cased.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _hashes(key: Column) -> list[Column]:
    """128 bits of a key, of two functions; lines that are equal in both count as the same line."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.md5(key.cast("binary"))).alias("h2")]


def line_hashes(docs: DataFrame, text_col: str, least_chars: int, batch: Column) -> DataFrame:
    """(batch, h1, h2) of the different lines of each document."""
    keys = F.array_distinct(F.transform(F.split(text_of(text_col), "\n"), line_key))
    lines = docs.select(batch.alias("batch"), F.explode(F.filter(keys, lambda k: F.length(k) >= least_chars)).alias("key"))
    return lines.select("batch", *_hashes(F.col("key")))


def shared_lines(docs: DataFrame, *, id_col: str, text_col: str, least_docs: int, least_chars: int, batches: int, index: str | None, scratch: Scratch) -> DataFrame:
    """(h1, h2) of the lines of `docs` that at least `least_docs` documents have, of these and of all that `index` has seen.

    The documents are read once, for counts by batch; batches then go through the runs one after the other.
    """
    keys = ["h1", "h2"]
    slot = F.pmod(F.xxhash64(F.col(id_col)), F.lit(batches)).cast("int")
    counted = line_hashes(docs, text_col, least_chars, slot).groupBy("batch", *keys).agg(F.count("*").alias("n"))
    counted = scratch.write(counted, "counted", partition_by="batch")
    runs, found = LevelledRuns(docs.sparkSession, index or f"{scratch.root}/runs", keys), []
    for k in range(batches):
        run = runs.add(counted.where(F.col("batch") == k).select(*keys, "n"))
        found.append(scratch.write(run.where(F.col("total") >= least_docs).select(*keys), f"reached-{k}"))
        runs.compact()
    shared = scratch.write(reduce(DataFrame.unionByName, found).distinct(), "shared")
    scratch.drop_but("shared")
    if index is None:
        scratch.drop("runs")
    return shared


def drop_shared_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_docs: int = 10,
    least_chars: int = 1,
    batches: int = 4,
    index: str | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    scratch: Scratch | None = None,
) -> DataFrame:
    """`docs` without the lines that at least `least_docs` documents have: (row, kept_text, n_lines, n_dropped).

    `row` is a struct of all columns of the input row, whatever their names. A line's key is the line stripped of ASCII
    white space, with A-Z in lower case; keys shorter than `least_chars` code points stay. A null or empty text is one
    empty line. Every row counts as a document, repeated rows and null ids too; an empty table gives no rows.

    With `index`, a folder, the documents are counted together with those of earlier calls, and stay counted for later ones: a
    line goes from the call on that brings it to the limit. Without it, the index lives as long as the call's other tables.
    """
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    shared = shared_lines(docs, id_col=id_col, text_col=text_col, least_docs=least_docs, least_chars=least_chars, batches=batches, index=index, scratch=scratch)
    small = shared.count() <= broadcast_rows

    lines = docs.select(*row_key(id_col, text_col), F.posexplode(F.split(text_of(text_col), "\n")).alias("at", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= least_chars).select("k1", "k2", "at", *_hashes(F.col("key")))
    hit = keyed.join(F.broadcast(shared) if small else shared.hint("merge"), ["h1", "h2"], "left_semi")
    dropped = hit.groupBy("k1", "k2").agg(F.collect_set("at").alias("dropped"))
    whole = docs.select(*row_key(id_col, text_col), F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row"))
    joined = whole.join(dropped, ["k1", "k2"], "left")
    body = F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))
    rows = joined.select("row", "dropped", body.alias("body"), F.split(body, "\n").alias("parts"))
    left = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("dropped"))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("parts"), i)), "\n")
    return rows.select(
        "row",
        F.when(F.col("dropped").isNull(), F.col("body")).otherwise(kept).alias("kept_text"),
        F.size("parts").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def line_digests(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, n_lines, n_dropped, kept_sha256) of each document."""
    rows = drop_shared_lines(docs, id_col=id_col, **options)
    return rows.select(F.col("row").getField(id_col).alias(id_col), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
