"""Best-fit packing of documents into sequences, by linear grouping.

Lengths are whole numbers up to the capacity, so their histogram is a table of bounded size and the packing is made on it, for
runs of sequences at a time. Large pieces are put, largest first, into a few groups of equal numbers and rounded up to the
largest of their group; how often to use each configuration of these few sizes is a small linear program, solved by column
generation. Then the actual pieces take the rounded places, leftovers and small pieces go best-fit, largest first, to the
sequence that they leave the least room in. The result is a list of slots (length, ranks, sequences, offset); each piece finds
its slot by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch, mapped, partitions_for, slices, text_of
from tidewater.llm.token_counts import word_bpe

#: Settings that are tried; the one with the fewest sequences counts: how many of the large pieces fit into a sequence at most,
#: and the groups that their lengths are rounded to.
SETTINGS = ((2, 24), (4, 48), (4, 96), (8, 24))


# -- packing a histogram ----------------------------------------------------------------------------------------------


class Packing:
    """Runs of sequences by their free room; slots say which pieces went where."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.sequences = capacity, 0
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free room: runs (first sequence, how many)
        self.rooms: list[int] = []
        self.used: dict[int, int] = defaultdict(int)  # length: pieces placed
        self.slots: list[tuple[int, int, int, int, int]] = []  # length, first rank, pieces, first sequence, offset

    def free(self, room: int, first: int, many: int) -> None:
        if not self.room[room]:
            insort(self.rooms, room)
        self.room[room].append((first, many))

    def take(self, room: int) -> tuple[int, int]:
        run = self.room[room].pop()
        if not self.room[room]:
            self.rooms.pop(bisect_left(self.rooms, room))
        return run

    def put(self, length: int, room: int, first: int, many: int) -> None:
        """One piece of a length into each of some neighbouring sequences that have `room` left."""
        self.slots.append((length, self.used[length], many, first, self.capacity - room))
        self.used[length] += many

    def new(self, many: int) -> int:
        self.sequences += many
        return self.sequences - many

    def best_fit(self, lengths: dict[int, int]) -> None:
        for length in sorted(lengths, reverse=True):
            many = lengths[length]
            while many:
                at = bisect_left(self.rooms, length)
                if at == len(self.rooms):
                    opened = -(-many // (self.capacity // length))
                    self.free(self.capacity, self.new(opened), opened)
                    continue
                room = self.rooms[at]
                first, there = self.take(room)
                some = min(there, many)
                self.put(length, room, first, some)
                self.free(room - length, first, some)
                if there > some:
                    self.free(room, first + some, there - some)
                many -= some


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """(pieces of each size, how often): whole parts of the best fractional use of configurations, by column generation."""
    n = len(sizes)
    if not n:
        return []
    columns = np.zeros((n, n))
    for i, s in enumerate(sizes):
        columns[i, i] = capacity // s
    demand = np.array(counts, float)
    for _ in range(40 * n):
        use = np.linalg.solve(columns, demand)
        price = np.linalg.solve(columns.T, np.ones(n))
        value, pick = _knapsack(sizes, price, capacity)
        if value <= 1 + 1e-9:
            break
        change = np.linalg.solve(columns, pick)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(change > 1e-9, np.maximum(use, 0) / change, np.inf)
        columns[:, int(np.argmin(ratio))] = pick
    use = np.linalg.solve(columns, demand)
    return [([int(x) for x in columns[:, j]], int(use[j] + 1e-9)) for j in range(n) if use[j] >= 1 - 1e-9]


def _knapsack(sizes: list[int], price: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of the greatest price; several sizes at a time for each number of pieces."""
    best, via = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for _ in range(capacity // min(sizes)):
        better, choice = best.copy(), via.copy()
        for i, s in enumerate(sizes):
            gain = np.zeros(capacity + 1)
            gain[s:] = best[:-s] + price[i]
            more = gain > better + 1e-12
            better[more], choice[more] = gain[more], i
        if np.array_equal(better, best):
            break
        best, via = better, choice
    pick, left = np.zeros(len(sizes)), capacity
    while via[left] >= 0 and best[left] > 1e-12:
        i = via[left]
        pick[i] += 1
        left -= sizes[i]
    return float(pick @ price), pick


def pack_histogram(histogram: dict[int, int], capacity: int) -> Packing:
    """Slots for so many pieces of each length (capacity at most)."""
    return min((_grouped(histogram, capacity, *setting) for setting in SETTINGS), key=lambda p: p.sequences)


def _grouped(histogram: dict[int, int], capacity: int, large_per_sequence: int, count: int) -> Packing:
    packing = Packing(capacity)
    left = dict(histogram)
    full = left.pop(capacity, 0)
    if full:
        packing.put(capacity, capacity, packing.new(full), full)
    large = sorted((x for x in left if x * large_per_sequence > capacity), reverse=True)
    total = sum(left[x] for x in large)
    if total >= count:
        groups: list[list[list[int]]] = [[] for _ in range(count)]  # [length, pieces], largest first
        seen = 0
        for x in large:
            many = left[x]
            while many:
                g = min(count - 1, seen * count // total)
                some = many if g == count - 1 else min(many, -(-total * (g + 1) // count) - seen)
                groups[g].append([x, some])
                seen, many = seen + some, many - some
        groups = [g for g in groups if g]
        sizes = [g[0][0] for g in groups]
        merged: dict[int, list[list[int]]] = defaultdict(list)  # groups that round to one size
        for size, g in zip(sizes, groups):
            merged[size] += g
        sizes = list(merged)
        for pattern, times in configurations(sizes, [sum(m for _, m in merged[s]) for s in sizes], capacity):
            runs = [(packing.new(times), times, capacity)] if times else []
            for size, each in zip(sizes, pattern):
                for _ in range(each):
                    runs = _fill(packing, runs, merged[size], left)
            for first, many, room in runs:
                packing.free(room, first, many)
    packing.best_fit({x: n for x, n in left.items() if n})
    return packing


def _fill(packing: Packing, runs: list[tuple[int, int, int]], pieces: list[list[int]], left: dict[int, int]) -> list[tuple[int, int, int]]:
    """Put one actual piece of a group into each sequence of some runs; actual pieces may be shorter than the group's size."""
    out = []
    for first, many, room in runs:
        while many and pieces:
            length, there = pieces[0]
            some = min(many, there)
            packing.put(length, room, first, some)
            left[length] -= some
            out.append((first, some, room - length))
            first, many = first + some, many - some
            pieces[0][1] -= some
            if not pieces[0][1]:
                pieces.pop(0)
        if many:
            out.append((first, many, room))
    return out


# -- Spark ------------------------------------------------------------------------------------------------------------


def pieces_of(docs: DataFrame, tokenizer: str, *, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of each document's ids, an end id included, cut where longer than a sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for part, texts in slices(batches, "text"):
            rows, piece, start, length, crc = [], [], [], [], []
            for i, packed in enumerate(bpe.packed_ids(texts)):
                packed += end
                for k in range(0, len(packed), 4 * capacity):
                    some = packed[k : k + 4 * capacity]
                    rows.append(i)
                    piece.append(k // (4 * capacity))
                    start.append(k // 4)
                    length.append(len(some) // 4)
                    crc.append(zlib.crc32(some))
            arrays = [part.column(0).take(pa.array(rows)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return mapped(given, run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def pack_documents(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, scratch: Scratch | None = None
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): each document's pieces and their places in sequences.

    Ids are the tokenizer's, without added ones, and an end id; only documents longer than `capacity` are cut. Places in a sequence
    are gapless from 0. A null text is empty and has the end id alone; null ids stay null and repeated rows are packed each; an
    empty table gives no rows. Other columns are left out.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    pieces = pieces_of(docs, tokenizer, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id)
    # a bucket keeps the pieces of a common length apart; its ranks begin after those of the buckets before
    buckets = 4 * partitions_for(spark)
    pieces = scratch.write(pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")), "pieces")
    counts = scratch.write(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    packing = pack_histogram(histogram, capacity)
    columns = list(zip(*packing.slots)) or [[]] * 5
    slots = spark.createDataFrame(pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("length", "rank", "many", "first", "offset"), columns)}))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    based = counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("own", own).join(based, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("own"))
    # each length's slots as one sorted row; the table has a few slots for each length, however many documents there are
    lists = slots.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("rank", "many", "first", "offset"))).alias("slots"))
    placed = ranked.join(F.broadcast(lists), "length")
    slot = F.element_at(F.filter("slots", lambda s: s["rank"] <= F.col("rank")), -1)
    return placed.withColumn("slot", slot).select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("slot.first") + F.col("rank") - F.col("slot.rank")).alias("sequence_id"),
        F.col("slot.offset").alias("offset"),
    )
