"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A 64-bit fingerprint is four blocks of 16 bits. If two fingerprints differ in at most three bits, one block is equal, and
of the two 24-bit halves of the other blocks one differs in at most one bit. The perfect binary Golay code maps a half
(23 of its bits) to the codewords near it: one, or six where the half is three bits from its codeword; two halves at
distance two or less share one. So (block, equal bits, half, codeword) is a key that some bucket has in common for every
pair to be linked; in the buckets, distances are measured and what is too far apart goes. For four and five bits there are six
blocks of 10 or 11 bits: one is equal, and of the two halves of the others one differs in at most two bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch, mapped, partitions_for, row_key, slices, text_of
from tidewater.llm.components import components

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Fixed value: the Golay code's generator polynomial, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: Buckets beyond this many fingerprints are cut up by their remaining bits before distances are measured.
LARGE = 2048
#: Where windows of 12 bits begin: of those that are apart from each other, and the last four bits, five errors leave one equal.
WINDOWS = range(0, 64, 4)


# -- fingerprints -----------------------------------------------------------------------------------------------------


def shingle_hashes(text: str, words: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of all word shingles, repeats included, some at a time."""
    parts = text.encode("utf-8").translate(_LOWER).split()
    if not parts:
        return
    line = memoryview(b" ".join(parts))
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    n = max(1, len(parts) - words + 1)
    starts, ends = (ends - lengths)[:n].tolist(), ends[-n:].tolist()
    del parts
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):
        yield np.array([digest(line[a:b], 42) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])], "<u8")


def fingerprint(text: str, words: int) -> int:
    """Majority bits of all word shingles' hashes; 0 without words."""
    ones, n = np.zeros(64, np.int64), 0
    for some in shingle_hashes(text, words):
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += some.size
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, k1, k2, fp long) of each document; k1 and k2 tell rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            found = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(found)], names=["id", "k1", "k2", "fp"])

    given = docs.select(F.col(id_col).cast("long").alias("id"), *row_key(id_col, text_col), text_of(text_col).alias("text"))
    return given.transform(mapped, run, "id long, k1 long, k2 long, fp long")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# -- Golay code -------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of each value of the three bytes of a word; the error pattern of each syndrome; that pattern's weight."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    single = [remainder(1 << b) for b in range(23)]
    tables = np.zeros((3, 256), np.uint32)
    for k in range(3):
        for value in range(256):
            for b in range(8):
                if value >> b & 1 and 8 * k + b < 23:
                    tables[k, value] ^= single[8 * k + b]
    errors, weight = np.zeros(2048, np.uint32), np.zeros(2048, np.uint8)
    for n in range(1, 4):
        for bits in combinations(range(23), n):
            syndrome = 0
            for b in bits:
                syndrome ^= single[b]
            errors[syndrome], weight[syndrome] = sum(1 << b for b in bits), n
    return tables, errors, weight


def _decoded(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index (12 bits) of the nearest codeword and its distance."""
    tables, errors, weight = _golay()
    syndrome = tables[0][words & 255] ^ tables[1][words >> 8 & 255] ^ tables[2][words >> 16 & 127]
    return (words ^ errors[syndrome]) >> 11 & 0xFFF, weight[syndrome]


def nearby_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) pairs: all codewords that a word, or a word one bit from it, decodes to. 23-bit words as uint32."""
    own, weight = _decoded(words)
    near, far = np.flatnonzero(weight < 3), np.flatnonzero(weight == 3)
    flips = np.uint32(1) << np.arange(23, dtype=np.uint32)
    around = np.sort(_decoded(words[far, None] ^ flips)[0], axis=1)
    first = np.ones(around.shape, bool)
    first[:, 1:] = around[:, 1:] != around[:, :-1]
    rows, columns = np.nonzero(first)
    return np.concatenate([near, far[rows]]), np.concatenate([own[near], around[rows, columns]])


def bucket_keys(fps: np.ndarray, distance: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for the 64-bit fingerprints; any two at the distance (five at most) or less share a key."""
    ends = (0, 16, 32, 48, 64) if distance <= 3 else (0, 11, 22, 33, 44, 54, 64)
    rows, keys = [], []
    for i, (begin, end) in enumerate(zip(ends, ends[1:])):
        block = fps >> np.uint64(begin) & np.uint64((1 << end - begin) - 1)
        rest = fps & np.uint64((1 << begin) - 1)
        if end < 64:
            rest |= fps >> np.uint64(end) << np.uint64(begin)
        for j in range(2):
            half = (rest >> np.uint64((24 if distance <= 3 else 27) * j) & np.uint64(0x7FFFFF)).astype(np.uint32)
            row, index = nearby_codewords(half)
            head = block | np.uint64((i * 2 + j) << 16)
            rows.append(row)
            keys.append(head[row] << np.uint64(12) | index.astype(np.uint64))
    return np.concatenate(rows), np.concatenate(keys).astype(np.int64)


# -- links ------------------------------------------------------------------------------------------------------------


def _small_groups(key: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Within groups of equal neighbouring keys, what pairs at distance `most` or less connect: each fingerprint with the first
    of its connected ones. A group of n gives fewer than n rows however many pairs it has."""
    left, right = [], []
    at, step = np.arange(key.size), 0
    while at.size:
        step += 1
        at = at[at + step < key.size]
        at = at[key[at] == key[at + step]]
        close = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= most]
        left.append(close)
        right.append(close + step)
    if not left:
        return fp[:0], fp[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    label = np.arange(key.size)
    while True:  # the least place spreads over pairs, and over places that have it already
        least = np.minimum(label[a], label[b])
        spread = label.copy()
        np.minimum.at(spread, a, least)
        np.minimum.at(spread, b, least)
        spread = spread[spread]
        if np.array_equal(spread, label):
            break
        label = spread
    moved = np.flatnonzero(label != np.arange(key.size))
    return fp[moved], fp[label[moved]]


def _large_group(fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within one large bucket that connect what all its links connect.

    Groups by each window of 12 bits find every link (see WINDOWS). Groups that stay large are compared in blocks; a
    fingerprint's links beyond its first in a block are implied by those that the block's members have among themselves.
    """
    left, right = [], []
    for shift in WINDOWS:
        part = fp >> np.uint64(shift) & np.uint64(0xFFF)
        order = np.argsort(part, kind="stable")
        part, some = part[order], fp[order]
        bounds = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        small = np.repeat(np.diff(bounds) <= LARGE, np.diff(bounds))
        for a, b in [_small_groups(part[small], some[small], most)]:
            left.append(a)
            right.append(b)
        for begin, end in zip(bounds[:-1], bounds[1:]):
            if end - begin > LARGE:
                a, b = _blocks(some[begin:end], most)
                left.append(a)
                right.append(b)
    return np.concatenate(left), np.concatenate(right)


def _blocks(fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among `fp`, found block by block."""
    parent = np.arange(fp.size)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left, right = [], []
    for at in range(0, fp.size, 1024):
        for other in range(at, fp.size, 1024):
            close = np.bitwise_count(fp[at : at + 1024, None] ^ fp[None, other : other + 1024]) <= most
            for x, y in zip(*(v.tolist() for v in np.nonzero(close))):
                a, b = find(at + x), find(other + y)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    left.append(at + x)
                    right.append(other + y)
    return fp[left], fp[right]


def links(distinct: DataFrame, distance: int, parts: int, scratch: Scratch | None = None) -> DataFrame:
    """(a, b) fingerprints (column fp, distinct): they connect the same ones as all pairs at most `distance` bits apart would.

    Buckets of more than LARGE fingerprints are dealt out by the windows of WINDOWS too, one of which is equal for every pair to be
    linked, so that a task gets a part of such a bucket.
    """
    scratch = scratch or Scratch(distinct.sparkSession, "links")
    if not 0 <= distance <= 5:
        raise ValueError("the keys are made for distances of five bits at most")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            row, key = bucket_keys(fps.view(np.uint64), distance)
            for at in range(0, key.size, 200_000):
                some = slice(at, at + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(fps[row[some]])], names=["key", "fp"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp = [], []

        def out(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            bounds = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if key.size else np.zeros(1, int)
            sizes = np.diff(bounds)
            small = np.repeat((sizes > 1) & (sizes <= LARGE), sizes)
            found = [_small_groups(key[small], fp[small], distance)]
            for k in np.flatnonzero(sizes > LARGE):
                found.append(_large_group(fp[bounds[k] : bounds[k + 1]], distance))
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held_key.append(batch.column(0).to_numpy())
            held_fp.append(batch.column(1).to_numpy().view(np.uint64))
            if held_key[0][0] == held_key[-1][-1]:
                continue  # one bucket so far
            key, fp = np.concatenate(held_key), np.concatenate(held_fp)
            cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
            yield from out(key[:cut], fp[:cut])
            held_key, held_fp = [key[cut:]], [fp[cut:]]
        if held_key:
            yield from out(np.concatenate(held_key), np.concatenate(held_fp))

    def linked(buckets: DataFrame) -> DataFrame:
        return buckets.repartition(parts, "key").sortWithinPartitions("key").transform(mapped, compared, "a long, b long")

    buckets = scratch.write(distinct.select("fp").transform(mapped, keyed, "key long, fp long"), "buckets")
    large = scratch.write(buckets.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > LARGE).select("key"), "large")
    found = linked(buckets.join(large, "key", "left_anti"))
    if not large.isEmpty():
        windows = F.array(*[F.xxhash64("key", F.lit(s), F.shiftrightunsigned("fp", s).bitwiseAND(0xFFF)) for s in WINDOWS])
        found = found.unionByName(linked(buckets.join(large, "key", "left_semi").select(F.explode(windows).alias("key"), "fp")))
    return found.distinct()


def _components(docs: DataFrame, id_col: str, text_col: str, words: int, distance: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all documents, and (fp, least, root) of the different ones; a component has one root."""
    every = scratch.write(fingerprints(docs, id_col, text_col, words), "fingerprints")
    # ids count before null ids, and of rows with one id the text's hash decides
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")).alias("least")
    distinct = every.groupBy("fp").agg(first)
    roots = components(links(distinct.select("fp"), distance, partitions_for(docs.sparkSession), scratch), scratch)
    scratch.drop_but("fingerprints", "edges-")
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return every, named


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3, scratch: Scratch | None = None
) -> DataFrame:
    """(id, fingerprint, component_id) of each document; documents whose fingerprints link share a component.

    component_id is the smallest id reachable over links. Equal fingerprints are one node however many documents have
    them. Null and blank texts have fingerprint 0 and link to each other like any others; a null id gets a row and the
    component of its fingerprint (null if all ids there are null); repeated rows each give a row; an empty table gives
    none. Other columns of `docs` are left out, so their names can't clash.
    """
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    every, named = _components(docs, id_col, text_col, words, distance, scratch)
    least = named.groupBy("root").agg(F.min("least").alias("first"))
    found = named.select("fp", "root").join(least, "root").select("fp", F.col("first.id").alias("component_id"))
    # as a table of its own, so that both sides of the join are plain exchanges and a common fingerprint can be split
    return every.join(scratch.write(found, "components"), "fp").select(F.col("id").alias(id_col), hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one_of_each(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3, scratch: Scratch | None = None
) -> DataFrame:
    """(row) of the documents that stay, one of each component: the one with the smallest id.

    row is a struct of all columns of the input row. A row with a null id stays only if its component has no other; of
    equal rows one stays.
    """
    _, named = _components(docs, id_col, text_col, words, distance, scratch or Scratch(docs.sparkSession, "simhash"))
    return first_rows(docs, named, id_col, text_col)


def first_rows(docs: DataFrame, named: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row) of the document of the least `least` of each root in `named`."""
    stay = named.groupBy("root").agg(F.min("least").alias("first")).select("first.k1", "first.k2")
    whole = docs.select(*row_key(id_col, text_col), F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row"))
    # rows with one id and text, of which there may be very many, become one before they are dealt out
    once = whole.groupBy("k1", "k2").agg(F.first("row").alias("row"))
    return once.join(stay.hint("merge"), ["k1", "k2"]).select("row")
