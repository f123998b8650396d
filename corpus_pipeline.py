"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that is written and read
again before the next one. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch, give_back, release, tokenizer_path
from tidewater.llm.line_dedup import drop_shared_lines
from tidewater.llm.packing import pack_documents
from tidewater.llm.queries import toxicity_chain
from tidewater.llm.similar import keep_one_of_similar
from tidewater.llm.suffix_dedup import drop_repeats
from tidewater.llm.toxicity import score


def _as_documents(docs: DataFrame, rows: DataFrame, text: Column | None = None) -> DataFrame:
    """The struct column `row` as the columns of `docs`; a new text brings a new n_chars."""
    columns = {c: F.col("row").getField(c) for c in docs.columns if text is None or c != "text"}
    if text is not None:
        columns["text"] = text
        if "n_chars" in docs.columns:
            columns["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[columns[c].alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go.

    Null and empty texts have no features and are as likely toxic as such texts are by the model; rows with null or repeated ids are
    judged each by its text, equal texts alike. Without labels nothing goes; an empty table stays empty.
    """
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chain = toxicity_chain(spark, source, sf_dir)
    give_back()  # it was trained in the driver
    scored = score(docs, chain)
    return _as_documents(docs, scored.where(F.element_at("probabilities", -1) < chain.threshold))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go.

    A null text becomes empty, which is one empty line; repeated rows and rows with null ids count as documents of their own. A text
    of shared lines alone becomes empty and stays. An empty table stays empty.
    """
    return _as_documents(docs, drop_shared_lines(docs, least_docs=10, least_chars=1), F.col("kept_text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: those that texts connect whose five-word shingles have a Jaccard
    similarity of 0.8 or more. SimHash fingerprints find candidates, which are verified; no fingerprint of 64 bits finds all such
    pairs, so what they leave apart is searched for exactly by the shingles themselves.

    Null and blank texts have no shingles and are one group. Of a group the row with the smallest id stays, one with a null id only if
    there is no other; of equal rows one stays. An empty table stays empty.
    """
    return _as_documents(docs, keep_one_of_similar(docs, words=5))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Characters that a 200-byte string covers which occurs elsewhere too go, at every place.

    A null text becomes empty; repeated rows and rows with null ids are texts of their own, so both of two equal long texts become
    empty. Characters stay whole at the ends of what goes. An empty table stays empty.
    """
    return _as_documents(docs, drop_repeats(docs, length=200), F.col("kept_text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in sequences of 4096 tokens, as op10_best_fit_packing returns them.

    A null or empty text is its end id alone; rows with null or repeated ids are packed each. An empty table gives no rows.
    """
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeated_passages),
    ("best_fit_packing", pack),
]

#: A classifier, fingerprints and tokens can't be expressed in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's result is written; then the tables that it was made of go, and the stage before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, before = Scratch(spark, "pipeline"), tuple(Scratch.folders.get(spark.sparkContext.applicationId, []))
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.drop_but(name)
        release(spark, but=(*before, scratch.root))
    return docs
