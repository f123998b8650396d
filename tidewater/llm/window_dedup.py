"""Removal of repeated windows of words, with a log-structured index of fingerprints.

Batches of documents go through an index: the fingerprints of a batch's windows (the anchors of WIDTH words that neighbouring windows
have in common, see repeats.py) are merge-joined with the sorted runs of earlier batches, added as a run with the totals so far, and
runs are compacted level by level (see runs.py). Fingerprints that thereby occur twice point to windows that may repeat; those are
verified word by word. Kept by a path, the index serves batches of later days.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch, column_of, files
from tidewater.llm.repeats import CHUNK, Runs, anchors_of, keyed_documents, pieces, placed_runs, removed_runs, spans_of, with_spans
from tidewater.llm.runs import LevelledRuns
from tidewater.llm.words import SPACES, word_hashes

#: Words of an anchor.
WIDTH = 8


# -- fingerprints -----------------------------------------------------------------------------------------------------


def find_windows(texts: list[bytes], length: int) -> Runs:
    """Runs of windows of `length` words that share an anchor."""
    at, size = 0, 0
    for i in range(len(texts) + 1):
        if i == len(texts) or (size and size + len(texts[i]) > CHUNK):
            (values,), counts = word_hashes(texts[at:i], SPACES)
            begins = np.cumsum(counts) - counts
            for group in pieces(counts.tolist(), length):
                some = np.concatenate([values[begins[k] + a : begins[k] + b] for k, a, b in group])
                owner, anchor, place = placed_runs(group, some, WIDTH, length)
                yield owner + at, anchor, place
            at, size = i, 0
        if i < len(texts):
            size += len(texts[i])


# -- verification -----------------------------------------------------------------------------------------------------


def cut_words(body: bytes):
    words = body.split()
    return lambda start, n: b" ".join(words[start : start + n])


def same_texts(texts: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(t, len(known)) for t in texts], np.int64)


def repeated_windows(contexts: list[bytes], anchor: np.ndarray, offset: np.ndarray, more: np.ndarray, many: np.ndarray, length: int) -> np.ndarray:
    """(context, l): does the window that begins l words before the context's anchor occur in another context too?

    Words get numbers; then contexts that agree on one word more to the right, or to the left, are told apart step by step, so
    that equal classes are equal words and not merely equal hashes. anchor: the anchors' hashes, ascending; offset: words before
    the anchor; more: windows after the first; many: contexts that occur twice at least by themselves.
    """
    words = [c.split(b" ") for c in contexts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = list(chain.from_iterable(words))
    known = {w: k for k, w in enumerate(dict.fromkeys(flat))}
    number = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
    end = np.cumsum(sizes)
    centre, n, span = end - sizes + offset, len(contexts), length - WIDTH + 1
    base = len(known) + n + 1

    def refine(classes: np.ndarray, at: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Classes that also agree on the word at a place; outside of its words a context stands alone."""
        word = np.where(inside, number[np.where(inside, at, 0)], len(known) + np.arange(n))
        return np.unique(classes * base + word, return_inverse=True)[1].ravel()

    first = np.cumsum(np.append(True, anchor[1:] != anchor[:-1]))
    right, classes = [first], first
    for r in range(length):
        classes = refine(classes, centre + r, centre + r < end)
        right.append(classes)
    found, classes = np.zeros((n, span), bool), first
    for l in range(span):
        if l:
            classes = refine(classes, centre - l, l <= offset)
        asked = np.flatnonzero((l <= offset) & (l >= offset - more))
        key = right[length - l][asked] * (n + 1) + classes[asked]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        hit = many[asked[by]]
        hit[1:] |= same
        hit[:-1] |= same
        found[asked[by[hit]], l] = True
    return found


# -- Spark ------------------------------------------------------------------------------------------------------------


class WindowIndex:
    """Runs of fingerprints of windows, over batches of keyed documents: all batches of a call, and of earlier calls with one path.

    Kept by a path, the index also has the documents and where their fingerprints are, so that a later batch's windows can be
    verified word by word against them.
    """

    def __init__(self, scratch: Scratch, length: int, path: str | None) -> None:
        self.scratch, self.length, self.path = scratch, length, path
        self.spark = scratch.spark
        self.runs = LevelledRuns(self.spark, f"{path}/runs-{length}" if path else f"{scratch.root}/runs", ["anchor"])

    def _history(self, name: str) -> DataFrame | None:
        there = files(self.spark, f"{self.path}/{name}-{self.length}") if self.path else None
        days = sorted(d for d in there.folders() if there.exists(f"{d}/_SUCCESS")) if there else []
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/{name}-{self.length}/{d}") for d in days]) if days else None

    def keep(self, df: DataFrame, name: str, day: str) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}-{self.length}/{day}")

    def matched(self, keyed: DataFrame, batches: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(documents, anchors, twice) of a call's keyed documents and of the earlier ones that share a fingerprint with them.

        twice: the fingerprints that occur twice or more up to the last batch that has them, which the merge-joins tell. Documents of
        earlier calls are marked as `old`.
        """
        length = self.length
        batch = F.pmod(F.xxhash64("k1"), F.lit(batches)).cast("int")
        anchors = self.scratch.write(anchors_of(keyed, lambda texts: find_windows(texts, length)).withColumn("batch", batch), "anchors", partition_by="batch")
        found = []
        for k in range(batches):
            counts = anchors.where(F.col("batch") == k).groupBy("anchor").agg(F.count("*").alias("n"))
            run = self.runs.add(counts)
            found.append(self.scratch.write(run.where("total > 1"), f"again-{k}"))
            self.runs.compact()
        twice = reduce(DataFrame.unionByName, found).groupBy("anchor").agg(F.max("total").alias("n"))
        twice = self.scratch.write(twice, "twice")
        self.scratch.drop_but("anchors", "twice")
        if not self.path:
            self.scratch.drop("runs")
            return keyed, anchors.drop("batch"), twice
        docs = keyed.withColumn("old", F.lit(False))
        anchors, earlier, texts = anchors.drop("batch"), self._history("anchors"), self._history("texts")
        if earlier is not None:
            shared = self.scratch.write(earlier.join(twice.select("anchor").hint("merge"), "anchor", "left_semi"), "earlier")
            needed = shared.select("k1", "k2").distinct()
            rows = keyed.schema["row"].dataType
            old = texts.join(needed, ["k1", "k2"], "left_semi").select("k1", "k2", "body", F.lit(None).cast(rows).alias("row"), F.lit(True).alias("old"))
            docs, anchors = docs.unionByName(old), anchors.unionByName(shared)
        day = uuid.uuid4().hex
        self.keep(keyed.select("k1", "k2", "body"), "texts", day)
        self.keep(self.scratch.read("anchors").drop("batch"), "anchors", day)
        return docs, anchors, twice


def drop_windows(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 35, batches: int = 4, index: str | None = None, scratch: Scratch | None = None
) -> DataFrame:
    """(row, n_words, n_removed, kept_text) of each document, without the words of windows that start elsewhere too.

    Words are runs of other bytes than ASCII white space, windows are `length` of them, judged on the input; the kept words are
    joined by one space. row is a struct of the other columns of the input row. A null text has no words. Each row is a document,
    even if ids are null or repeated: a repeated row repeats all its windows. An empty table gives no rows.

    With `index`, a folder, windows that documents of earlier calls had go too, and the documents are kept there for later calls.
    """
    if not WIDTH < length <= WIDTH + 255:
        raise ValueError(f"a length between {WIDTH + 1} and {WIDTH + 255} is needed")
    scratch = scratch or Scratch(docs.sparkSession, "windows")
    every, anchors, twice = WindowIndex(scratch, length, index).matched(keyed_documents(docs, id_col, text_col), batches)
    joined = with_spans(every, anchors, twice, contexts_of=cut_words, same_contexts=same_texts, repeated=repeated_windows, length=length)
    joined = joined.where(~F.col("old")) if index else joined

    def run(batches_: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for bodies, spans_ in batches_:
            n, removed, kept = [], [], []
            for body, spans in zip(bodies.cast(pa.binary()), spans_of(spans_)):
                words = body.as_py().split()
                n.append(len(words))
                if spans is not None:
                    for begin, end in removed_runs(spans, length)[::-1].tolist():
                        del words[begin:end]
                removed.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            kept = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(removed, pa.int64()), kept], ["n_words", "n_removed", "kept_text"])

    found = column_of(docs.sparkSession, run, "struct<n_words:long,n_removed:long,kept_text:string>")("body", "spans")
    return joined.select("row", found.alias("found")).select("row", "found.*")


def window_digests(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of each document."""
    rows = drop_windows(docs.select(id_col, options.get("text_col", "text")), id_col=id_col, **options)
    return rows.select(F.col("row").getField(id_col).alias(id_col), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
