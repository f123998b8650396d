"""Repeated windows: what suffix dedup and window dedup share.

A text is a row of units (bytes or words), a window is `length` units. Every window is filed under one place in it, its anchor:
the `width` units with the least hash. Equal windows have the same anchor at the same offset, so only windows whose anchor
occurs twice can repeat, and a run of neighbouring windows with one anchor is handled as one context: the units from the
run's first window to its last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import mapped, partitions_for, row_key, text_of

#: Units that are hashed at a time (a power of two); contexts that are compared at a time.
CHUNK, TOGETHER = 1 << 20, 40_000
#: Occurrences of an anchor beyond which its contexts are dealt out window by window.
HOT = 20_000
_MULTIPLIER = 0x9E3779B97F4A7C15

#: (text, anchor hash, place) of the runs in some texts; place: first start << 16 | offset of the anchor << 8 | more starts.
Runs = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random value of each byte; powers of the multiplier and of its inverse, modulo 2^64."""
    values = np.random.default_rng(42).integers(0, 1 << 64, 256, dtype=np.uint64)
    inverse = pow(_MULTIPLIER, -1, 1 << 64)
    step = np.full(CHUNK + 1, _MULTIPLIER, np.uint64), np.full(CHUNK + 1, inverse, np.uint64)
    step[0][0] = step[1][0] = 1
    return values, np.cumprod(step[0], dtype=np.uint64), np.cumprod(step[1], dtype=np.uint64)


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each `width` neighbours of at most CHUNK 64-bit values."""
    _, power, inverses = powers()
    sums = np.zeros(values.size + 1, np.uint64)
    np.cumsum(values * power[: values.size], out=sums[1:])
    out = sums[width:] - sums[:-width]
    out *= inverses[: out.size]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    count = values.size - width + 1
    rows = -(-values.size // width)
    padded = np.full(rows * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: values.size] = values
    table = padded.reshape(rows, width)
    after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(table, axis=1).ravel()
    return np.minimum(after[:count], before[width - 1 : width - 1 + count])


def anchor_runs(values: np.ndarray, sizes: np.ndarray, width: int, length: int) -> tuple[np.ndarray, ...]:
    """(sequence, first start, anchor's offset, more starts, anchor hash) of the runs in sequences of `length` values or more."""
    begins = np.cumsum(sizes) - sizes
    hashes = rolling(values, width)
    # the place in the low bits: of equal hashes the leftmost counts
    low = np.uint64(CHUNK - 1)
    tagged = (hashes & ~low) | np.arange(hashes.size, dtype=np.uint64)
    least = _sliding_least(tagged, length - width + 1)
    many = sizes - length + 1
    owner = np.repeat(np.arange(len(sizes)), many)
    start = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + begins[owner]
    least = least[start]
    first = np.ones(start.size, bool)
    first[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    runs = np.flatnonzero(first)
    more = np.diff(np.append(runs, start.size)) - 1
    anchor = (least[runs] & low).astype(np.int64)
    start, owner = start[runs], owner[runs]
    return owner, start - begins[owner], anchor - start, more, hashes[anchor].view(np.int64)


def pieces(sizes: list[int], length: int) -> Iterator[list[tuple[int, int, int]]]:
    """(text, begin, end) that together fill a chunk; a longer text is several pieces that overlap by a window less a unit."""
    group, size = [], 0
    for i, n in enumerate(sizes):
        for at in range(0, n - length + 1, CHUNK - length + 1):
            end = min(n, at + CHUNK)
            if size + end - at > CHUNK:
                yield group
                group, size = [], 0
            group.append((i, at, end))
            size += end - at
    if group:
        yield group


def placed_runs(group: list[tuple[int, int, int]], values: np.ndarray, width: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One item of Runs for the values of a group of pieces."""
    table = np.array(group)
    owner, start, offset, more, anchor = anchor_runs(values, table[:, 2] - table[:, 1], width, length)
    return table[owner, 0], anchor, (start + table[owner, 1]) << 16 | offset << 8 | more


def _ranges(found: np.ndarray, anchor_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first start, last start) of the runs of repeated windows."""
    edge = np.diff(np.pad(found[:, ::-1].astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    last = found.shape[1] - 1
    return row, anchor_at[row] - last + begin, anchor_at[row] - last + end - 1


def keyed_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, body, row): row is a struct of the other columns, with their names and whatever these are."""
    others = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c != text_col]
    return docs.select(*row_key(id_col, text_col), text_of(text_col).alias("body"), F.struct(*(others or [F.lit(0).alias("no_columns")])).alias("row"))


def anchors_of(keyed: DataFrame, find: Callable[[list[bytes]], Runs]) -> DataFrame:
    """(anchor, k1, k2, place) of all runs of windows."""

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(k).to_numpy() for k in range(2)]
            for owner, anchor, place in find(batch.column(2).cast(pa.binary()).to_pylist()):
                arrays = [pa.array(anchor), pa.array(keys[0][owner]), pa.array(keys[1][owner]), pa.array(place)]
                yield pa.RecordBatch.from_arrays(arrays, names=["anchor", "k1", "k2", "place"])

    return keyed.select("k1", "k2", "body").transform(mapped, anchored, "anchor long, k1 long, k2 long, place long")


def with_spans(
    keyed: DataFrame,
    anchors: DataFrame,
    twice: DataFrame,
    *,
    contexts_of: Callable[[bytes], Callable[[int, int], bytes]],
    same_contexts: Callable[[list[bytes]], np.ndarray],
    repeated: Callable[..., np.ndarray],
    length: int,
) -> DataFrame:
    """`keyed` with spans, an array of first and last starts of repeated windows (null: none).

    twice: the anchors that occur twice or more (anchor, n), distinct, as a table of its own, so that both sides of the join with it are
    plain exchanges and a hot anchor can be split. contexts_of: of a text, a function that cuts out the
    context of so many windows from a start. same_contexts: numbers that are equal for equal contexts. repeated: which windows
    of some contexts occur in others. The documents are dealt out by their keys once and used twice.
    """
    spark = keyed.sparkSession
    parts = partitions_for(spark)
    wanted = anchors.join(twice.hint("merge"), "anchor").withColumn("hot", F.col("n") > HOT)
    lists = wanted.groupBy("k1", "k2").agg(F.collect_set(F.struct("anchor", "place", "hot")).alias("anchors"))
    both = keyed.repartition(parts, "k1", "k2")

    schema = "anchor long, k1 long, k2 long, place long, many boolean, context binary"

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def settle(rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
            """Of rows (anchor, k1, k2, place, context, hot, many): those that occur twice here, which is all there is to know of
            them, and one of each context, so that others can find it."""
            if not rows:
                return [], []
            number = same_contexts([r[4] for r in rows])
            order = np.argsort(number, kind="stable")
            begins = np.append(True, number[order][1:] != number[order][:-1])
            group = np.cumsum(begins) - 1
            flags = np.array([r[6] for r in rows])[order]
            many = ((np.bincount(group) > 1) | (np.bincount(group, flags) > 0))[group]
            return [rows[i] for i in order[many].tolist()], [(*rows[i][:6], bool(m)) for i, m in zip(order[begins].tolist(), many[begins].tolist())]

        def batch_of(rows: list[tuple], settled: bool) -> pa.RecordBatch:
            arrays = [
                pa.array([r[1] ^ r[2] if settled else r[0] for r in rows], pa.int64()),
                *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3)),
                pa.array([r[6] for r in rows], pa.bool_()),
                pa.array([None if settled else r[4] for r in rows], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=["anchor", "k1", "k2", "place", "many", "context"])

        def out() -> Iterator[pa.RecordBatch]:
            done, going = settle(held)
            held.clear()
            yield batch_of(done, True)
            yield batch_of([r for r in going if not r[5]], False)
            # an anchor of very many occurrences: each window goes by its own hash, so that no task gets all contexts
            windows: list[tuple] = []
            for r in going:
                if not r[5]:
                    continue
                cut = contexts_of(r[4])
                for k in range((r[3] & 255) + 1):
                    window = cut(k, length)
                    key = xxhash.xxh64_intdigest(window) - (1 << 63)
                    windows.append((key, r[1], r[2], (r[3] >> 16) + k << 16, window, False, r[6]))
                if len(windows) >= TOGETHER:
                    done, rest = settle(windows)
                    yield batch_of(done, True)
                    yield batch_of(rest, False)
                    windows = []
            done, rest = settle(windows)
            yield batch_of(done, True)
            yield batch_of(rest, False)

        for batch in batches:
            k1, k2 = (batch.column(k).to_pylist() for k in range(2))
            bodies = batch.column(2).cast(pa.binary())
            lists_ = batch.column(batch.num_columns - 1)
            offsets = lists_.offsets.to_numpy() - lists_.offsets[0].as_py()
            flat = lists_.flatten()
            anchor, place, hot = (flat.field(k).to_pylist() for k in range(3))
            for i in range(batch.num_rows):
                cut = contexts_of(bodies[i].as_py())
                own = slice(offsets[i], offsets[i + 1])
                for a, p, h in zip(anchor[own], place[own], hot[own]):
                    held.append((a, k1[i], k2[i], p, cut(p >> 16, (p & 255) + length), h, False))
                if len(held) >= TOGETHER:
                    yield from out()
        if held:
            yield from out()

    # the other columns aren't needed here, but with them both joins read the same exchange of the documents
    asked = both.join(lists, ["k1", "k2"]).select("k1", "k2", "body", *[c for c in keyed.columns if c not in ("k1", "k2", "body")], "anchors")
    found = asked.transform(mapped, contexts, schema).repartition(parts, "anchor").sortWithinPartitions("anchor")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def out(t: pa.Table) -> pa.RecordBatch:
            k1, k2, place = (t.column(k).to_numpy() for k in (1, 2, 3))
            open_ = t.column(5).is_valid().to_numpy()
            done = ~open_
            first = [place[done] >> 16]
            last = [first[0] + (place[done] & 255)]
            owner = [np.flatnonzero(done)]
            # an anchor that only one context has can't settle anything
            anchor = t.column(0).to_numpy()
            rows = np.flatnonzero(open_)
            if rows.size:
                own = anchor[rows]
                twin = np.append(False, own[1:] == own[:-1])
                rows = rows[twin | np.append(twin[1:], False)]
            if rows.size:
                offset, more = place[rows] >> 8 & 255, place[rows] & 255
                texts = t.column(5).take(pa.array(rows)).to_pylist()
                hit = repeated(texts, anchor[rows], offset, more, t.column(4).to_numpy()[rows], length)
                row, a, b = _ranges(hit, (place[rows] >> 16) + offset)
                first.append(a), last.append(b), owner.append(rows[row])
            who = np.concatenate(owner)
            arrays = [k1[who], k2[who], np.concatenate(first), np.concatenate(last)]
            return pa.RecordBatch.from_arrays(list(map(pa.array, arrays)), names=["k1", "k2", "first", "last"])

        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) < TOGETHER or waiting[0].column(0)[0] == batch.column(0)[-1]:
                continue
            t = pa.Table.from_batches(waiting).combine_chunks()
            cut = int(np.searchsorted(t.column(0).to_numpy(), t.column(0)[-1].as_py()))  # the last anchor may go on
            yield out(t.slice(0, cut))
            waiting = t.slice(cut).to_batches()
        if waiting:
            yield out(pa.Table.from_batches(waiting).combine_chunks())

    ranges = found.transform(mapped, compared, "k1 long, k2 long, first long, last long")
    spans = ranges.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    return both.join(spans, ["k1", "k2"], "left")


def removed_runs(spans: np.ndarray, length: int) -> np.ndarray:
    """Maximal runs of covered units (begin, end) of an array of first and last starts."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 1] + length)
    opens = np.append(True, spans[1:, 0] > ends[:-1])
    return np.column_stack([spans[opens, 0], ends[np.append(np.flatnonzero(opens)[1:] - 1, len(spans) - 1)]])


def spans_of(column: pa.Array) -> Iterator[np.ndarray | None]:
    for value in column:
        yield np.column_stack([value.values.field(k).to_numpy() for k in range(2)]) if value.is_valid and len(value.values) else None
