"""Near-duplicates by the Jaccard similarity of word shingles, all of them: at least 4/5 of the shingles of both texts together.

SimHash fingerprints come first: what is near by them and turns out to be similar is connected before anything else is compared. The
links that fingerprints miss are found exactly:

Sets of p and q shingles that are so similar differ in (p + q) / 9 shingles at most. Sizes fall into classes that grow by 5/4, so
similar sets are in one class or in neighbouring ones, and each set goes by its own class and by the next. A class deals shingles by
their hash to more parts than similar sets in it can differ in; so in some part both have the same ones. (class, part, the set's
shingles in it) is a key that all similar sets have in common, and it is of their own class for one of them at least; a part of one shingle or none counts only for a set that has so
many of them that it can be like another in nothing else. Sets that share a key are candidates unless fingerprints connected them;
only those found similar are links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch, mapped, partitions_for, row_key, slices, text_of
from tidewater.llm.components import components
from tidewater.llm.line_dedup import LOWER, UPPER
from tidewater.llm.simhash import fingerprint, first_rows, links, shingle_hashes

#: The largest size of each class.
_TOPS = [4]
while _TOPS[-1] < 1 << 40:
    _TOPS.append(-(-5 * _TOPS[-1] // 4))
#: Buckets of more sets are compared in further rounds, where what earlier ones connected is left out; there, this many sets are a
#: block, and each two blocks of a bucket are compared by themselves.
LARGE, BLOCK = 16, 2048
#: Bits of a set's signature.
SIGNED = 1024
#: Words of the shingles that fingerprints are made of, and bits by which fingerprints of candidates differ at most.
MARK_WORDS, MARK_BITS = 2, 5


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted different hashes of the word shingles; none without words."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(text, words)]))


def digest(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 42)).view(np.int64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.intersect1d(a, b, assume_unique=True).size
    return 9 * both >= 4 * (a.size + b.size)


def _mixed(x: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> np.uint64(33)) * np.uint64(factor)
    return x ^ x >> np.uint64(33)


def set_keys(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set of shingles, and which are of the next class: any two sets that are similar share a key that isn't of the next
    class for both."""
    if own.size < 4:  # similar to equal sets only
        return np.array([digest(own)]), np.zeros(1, np.int8)
    at, found, mixed, counts = int(np.searchsorted(_TOPS, own.size)), [], _mixed(own), []
    for level in (at, at + 1):
        differ = 2 * _TOPS[level] // 9
        parts = 13 * differ // 10 + 1
        part = (own >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        many = np.diff(np.append(begin, own.size)) > 1
        key = _mixed(np.add.reduceat(mixed, begin) + _mixed(part[begin] + np.uint64(level << 40)))
        # similar sets have parts - own.size / 4 parts in common, or more
        if parts - np.count_nonzero(many) >= parts - min(differ, own.size // 4):
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), part[begin])
            found += [key, _mixed(_mixed(empty + np.uint64(level << 40)))]
        else:
            found.append(key[many])
        counts.append(sum(x.size for x in found) - sum(counts))
    return np.concatenate(found).view(np.int64), np.repeat(np.array([0, 1], np.int8), counts)


def signature(own: np.ndarray) -> bytes:
    """For each value of ten bits of the hashes, whether an odd number has it: signatures differ in no more bits than sets in shingles."""
    return np.packbits(np.bincount((own & np.uint64(SIGNED - 1)).astype(np.int64), minlength=SIGNED) & 1).tobytes()


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SIGNED // 64)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, key, root) of rows sorted by key, next, node and root: the pairs of a bucket that aren't of the next class both nor of one
    root, without key and root; of a large one each set b with its root and the bucket's first set, or with itself if that has the same
    root. A bucket that is of the next class for all its sets has nothing new. A bucket of any size goes by in pieces; only its first
    LARGE sets are kept until it turns out to be large."""

    def held(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole buckets of LARGE sets at most."""
        key, following, node, root = rows
        left, right = [node[:0]], [node[:0]]
        for step in range(1, LARGE):
            at = np.flatnonzero((key[:-step] == key[step:]) & (following[:-step] == 0) & (root[:-step] != root[step:]))
            left.append(node[at])
            right.append(node[at + step])
        a, b = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1)
        none = pa.nulls(a.size, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none], names=["a", "b", "key", "root"])

    def starred(first: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        key, _, node, root = rows
        a = np.where(root == first[3], node, first[2])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (a, node, key, root)], names=["a", "b", "key", "root"])

    waiting, star = np.empty((4, 0), np.int64), None  # star: first and last row of a large bucket that may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "next", "node", "root")])
        if star is not None:
            first, last = star
            end = int(np.searchsorted(rows[0], first[0], "right"))
            own = rows[:, :end]
            own = own[:, np.append(own[2, :1] != last[2], own[2, 1:] != own[2, :-1])]
            if not first[1]:  # else nothing new
                yield starred(first, own)
            rows = rows[:, end:]
            if not rows.shape[1]:
                if own.shape[1]:
                    star = (first, own[:, -1])
                continue
            star = None
        rows = np.concatenate([waiting, rows], axis=1)
        rows = rows[:, np.append(True, (rows[:, 1:] != rows[:, :-1]).any(0))]  # copies in several tasks
        key, following = rows[:2]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(begin, key.size))
        open_ = np.repeat(size <= LARGE, size)
        last = int(begin[-1])
        waiting = rows[:, last:][:, : (LARGE if open_[-1] else 0)]
        small = open_.copy()
        small[last:] = False  # it may go on
        if small.any():
            yield from held(rows[:, small])
        for k in np.flatnonzero((size > LARGE) & (following[begin] == 0)):
            yield starred(rows[:, begin[k]], rows[:, begin[k] : begin[k] + size[k]])
        if not open_[-1]:
            star = (rows[:, last], rows[:, -1])
    if waiting.shape[1]:
        yield from held(waiting)


def _across(batches: Iterator[pa.RecordBatch], forest: bool) -> Iterator[pa.RecordBatch]:
    """(a, b) of rows sorted by key and the two blocks that meet (low, high): pairs that aren't connected yet and that signatures
    don't rule out; of a forest, only so many that they connect the same."""

    def compared(table: pa.Table) -> pa.RecordBatch:
        block, nodes, roots, sizes = (table.column(c).to_numpy() for c in ("block", "node", "root", "size"))
        sign = _signatures(table.column("signed"))
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        first = np.argsort(block != low, kind="stable")
        nodes, sizes, sign, block = nodes[first], sizes[first], sign[first], block[first]
        label, left, right = np.unique(roots[first], return_inverse=True)[1], [nodes[:0]], [nodes[:0]]
        many = int((block == low).sum())
        for at in range(many):
            begin = at + 1 if low == high else many
            later = np.flatnonzero(label[begin:] != label[at]) + begin
            differ = np.bitwise_count(sign[later] ^ sign[at]).sum(1, dtype=np.int64)
            later = later[9 * differ <= sizes[later] + sizes[at]]
            if forest and later.size:
                later = later[np.unique(label[later], return_index=True)[1]]
                label[np.isin(label, label[later])] = label[at]
            left.append(np.full(later.size, nodes[at]))
            right.append(nodes[later])
        a, b = np.concatenate(left), np.concatenate(right)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    held: list[pa.RecordBatch] = []  # of two blocks, so never many
    for batch in batches:
        if not batch.num_rows:
            continue
        where = np.stack([batch.column(c).to_numpy() for c in ("key", "low", "high")])
        bounds = np.flatnonzero(np.concatenate([[True], (where[:, 1:] != where[:, :-1]).any(0), [True]])).tolist()
        if held and any(held[0].column(c)[0] != batch.column(c)[0] for c in ("key", "low", "high")):
            yield compared(pa.Table.from_batches(held).combine_chunks())
            held = []
        for begin, end in zip(bounds[:-1], bounds[1:]):
            held.append(batch.slice(begin, end - begin))
            if end < batch.num_rows:
                yield compared(pa.Table.from_batches(held).combine_chunks())
                held = []
    if held:
        yield compared(pa.Table.from_batches(held).combine_chunks())


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of nodes, those whose sets are similar. What signatures rule out goes before whole sets are read."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            differ = np.bitwise_count(_signatures(batch.column("signed_a")) ^ _signatures(batch.column("signed_b"))).sum(1, dtype=np.int64)
            yield batch.filter(pa.array(9 * differ <= batch.column("both").to_numpy())).select(["a", "b"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("own_a"), batch.column("own_b")
            found = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(left, right)]
            yield batch.filter(pa.array(found, pa.bool_())).select(["a", "b"])

    def side(name: str, *columns: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    signed = pairs.join(side("a", "size", "signed"), "a").join(side("b", "size", "signed"), "b")
    some = signed.select("a", "b", (F.col("size_a") + F.col("size_b")).alias("both"), "signed_a", "signed_b").transform(mapped, possible, "a long, b long")
    return some.join(side("a", "own"), "a").join(side("b", "own"), "b").select("a", "b", "own_a", "own_b").transform(mapped, alike, "a long, b long")


def node_of(text: Column) -> Column:
    """A hash of the text's words, one for all texts of the same words in the same order."""
    return F.xxhash64(F.btrim(F.regexp_replace(F.translate(text, UPPER, LOWER), r"[ \t\n\x0B\f\r]+", " ")))


def near_marks(docs: DataFrame, text_col: str, scratch: Scratch) -> DataFrame:
    """(a, b) nodes whose SimHash fingerprints are equal or differ in MARK_BITS bits at most: they connect the same as all such pairs."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            found = np.array([fingerprint(t, MARK_WORDS) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], names=["node", "fp"])

    text, buckets = text_of(text_col), Scratch(docs.sparkSession, "marks")
    found = docs.select(node_of(text).alias("node"), text.alias("text")).transform(mapped, marked, "node long, fp long")
    marks = buckets.write(found.distinct(), "marks")
    firsts = buckets.write(marks.groupBy("fp").agg(F.min("node").alias("first")), "firsts")
    equal = marks.join(firsts, "fp").where("first <> node").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = links(firsts.select("fp"), MARK_BITS, partitions_for(docs.sparkSession), buckets)
    for end in ("a", "b"):
        near = near.join(firsts.select(F.col("fp").alias(end), F.col("first").alias(f"node_{end}")), end)
    near = near.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    near = scratch.write(equal.unionByName(near).distinct(), "near")
    buckets.drop_but()
    return near


def similar_links(docs: DataFrame, nodes: DataFrame, words: int, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(a, b) nodes with similar sets of shingles: they connect what all such pairs would. nodes: (node, least), a row for each text,
    and the row key of a document in `least`."""
    parts = partitions_for(docs.sparkSession)
    text = text_of(text_col)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part, texts in slices(batches, "text"):
            for node, root, one in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts):
                if node not in seen:
                    seen.add(node)
                    keys, following = set_keys(shingles(one, words))
                    for at in range(0, keys.size, 200_000):
                        some = keys[at : at + 200_000]
                        own = [pa.array(some), pa.array(following[at : at + 200_000]), pa.array(np.full(some.size, node)), pa.array(np.full(some.size, root))]
                        yield pa.RecordBatch.from_arrays(own, names=["key", "next", "node", "root"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            own = [shingles(t, words) for t in texts]
            size, signed = pa.array([x.size for x in own], pa.int64()), pa.array([signature(x) for x in own], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), size, signed, pa.array([x.tobytes() for x in own], pa.binary())], names=["node", "size", "signed", "own"])

    def sets_of(needed: DataFrame, name: str) -> DataFrame:
        rows = needed.join(nodes.select("node", "least.k1", "least.k2"), "node")
        texts = docs.select(*row_key(id_col, text_col), text.alias("text")).join(rows, ["k1", "k2"]).select("node", "text")
        found = texts.transform(mapped, whole, "node long, size long, signed binary, own binary")
        return scratch.write(found.groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", "signed", "own")]), name)

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()

    near = near_marks(docs, text_col, scratch)
    first_sets = sets_of(ends(near), "sets-near")
    by_marks = scratch.write(_verified(near, first_sets), "links-near")
    roots = components(by_marks, Scratch(docs.sparkSession, "similar"))

    rooted = docs.select(node_of(text).alias("node"), text.alias("text")).join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "text")
    buckets = rooted.transform(mapped, _gathered(keyed), "key long, next tinyint, node long, root long")
    order = ["key", "next", "node"]
    met = scratch.write(buckets.repartition(parts, "key").sortWithinPartitions(*order).transform(mapped, _met, "a long, b long, key long, root long"), "met")
    pairs = scratch.write(met.where("a <> b").select("a", "b").distinct(), "pairs")
    large = scratch.write(_apart(met.where("key IS NOT NULL").select("key", F.col("b").alias("node"), "root")).select("key", "node"), "large")
    needed = ends(pairs).union(large.select("node")).distinct()
    sets = first_sets.unionByName(sets_of(needed.join(first_sets, "node", "left_anti"), "sets"))
    found = by_marks.unionByName(scratch.write(_verified(pairs, sets), "links"))
    if large.isEmpty():
        return found
    for forest in (True, False):  # after the forests, few pairs are left that aren't connected
        roots = components(found, Scratch(docs.sparkSession, "similar"))
        known = _apart(large.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")))
        known = known.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
        known = scratch.write(known.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")), f"apart-{forest}")
        large = known.select("key", "node")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        dealt = known.select("key", "node", "root", "block", other).join(sets.select("node", "size", "signed"), "node")
        where = ["key", "low", "high"]
        dealt = dealt.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "root", "size", "signed")
        more = dealt.repartition(parts, *where).sortWithinPartitions(*where, "node").transform(mapped, partial(_across, forest=forest), "a long, b long").distinct()
        more = scratch.write(_verified(scratch.write(more, f"more-{forest}"), sets), f"links-{forest}")
        found = found.unionByName(more)
    return found


def _apart(known: DataFrame) -> DataFrame:
    """Rows (key, node, root) of the keys that have several roots, with how many rows a key has; buckets of one root stay so."""
    several = known.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("n")).where("least <> most")
    return known.join(several.select("key", "n"), "key")


def _gathered(run):
    """Small batches of `run` put together."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in run(batches):
            held.append(batch)
            size += batch.num_rows
            if size >= 100_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return gathered


def keep_one_of_similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """(row) of the documents that stay, one of each component of similar texts: the one with the smallest id.

    Shingles are of words parted by white space, ASCII letters in lower case; a text of fewer words is one shingle. Texts of the same
    words are one node. Rows as in simhash.keep_one_of_each.
    """
    scratch = scratch or Scratch(docs.sparkSession, "similar")
    every = docs.select(F.col(id_col).cast("long").alias("id"), *row_key(id_col, text_col), node_of(text_of(text_col)).alias("node"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")).alias("least")
    nodes = scratch.write(every.groupBy("node").agg(first), "nodes")
    roots = components(similar_links(docs, nodes, words, id_col, text_col, scratch), scratch).withColumnRenamed("node", "of")
    scratch.drop_but("nodes", "edges-")
    named = nodes.join(roots, F.col("node") == F.col("of"), "left").select("least", F.coalesce("root", "node").alias("root"))
    return first_rows(docs, named, id_col, text_col)
