"""Removal of repeated substrings by suffix sorting.

Strings are found by anchors of 64 bytes, and only the contexts of anchors that occur twice need sorting (see repeats.py). The contexts of an anchor are suffix-sorted to the right of it, and to the left (reversed), by deep-shallow sorting:
multikey quicksort over 8-byte symbols to a shallow depth, then a blind trie for each group that still ties. Neighbours' common
prefixes tell which contexts agree on r bytes to the right and on l to the left: the string that begins l bytes before the
anchor repeats if another context agrees on l bytes left and `length` - l right.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch, column_of
from tidewater.llm.repeats import Runs, anchors_of, keyed_documents, pieces, placed_runs, powers, removed_runs, spans_of, with_spans

#: Bytes of an anchor; the shallow depth.
ANCHOR, SHALLOW = 64, 16


# -- deep-shallow sorting -----------------------------------------------------------------------------------------------


def common_prefix(a: bytes, b: bytes) -> int:
    if a == b:
        return len(a)
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class BlindTrie:
    """A compacted trie that keeps only branching depths and first bytes; one comparison places a string."""

    def __init__(self) -> None:
        self.root: list | None = None  # a node: [depth, {byte: node}]; a leaf: list of numbers of equal strings

    def insert(self, number: int, strings: list[bytes]) -> None:
        text = strings[number]
        if self.root is None:
            self.root = [-1, [number]]
            return
        node = self.root
        while node[0] >= 0:  # blind: bytes between branching depths are not looked at
            child = node[1].get(text[node[0]] if node[0] < len(text) else -1)
            node = child if child is not None else next(iter(node[1].values()))
        other = strings[node[1][0]]
        shared = common_prefix(text, other)
        if shared == len(text) == len(other):
            node[1].append(number)
            return
        node, parent, edge = self.root, None, None
        while 0 <= node[0] < shared:
            parent, edge = node, text[node[0]] if node[0] < len(text) else -1
            node = node[1][edge]
        own = text[shared] if shared < len(text) else -1
        if node[0] == shared:
            node[1][own] = [-1, [number]]
            return
        split = [shared, {own: [-1, [number]], other[shared] if shared < len(other) else -1: node}]
        if parent is None:
            self.root = split
        else:
            parent[1][edge] = split

    def sorted(self, strings: list[bytes]) -> Iterator[tuple[int, int]]:
        """(number, common prefix with the one before) in order; the first one's prefix is 0."""
        waiting, shared = [(self.root, 0)], 0
        while waiting:
            node, shared = waiting.pop()
            if node[0] < 0:
                for k, number in enumerate(node[1]):
                    yield number, len(strings[number]) if k else shared
            else:
                edges = sorted(node[1], reverse=True)
                waiting += [(node[1][e], node[0] if e != edges[-1] else shared) for e in edges]


def multikey_quicksort(symbols: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of `symbols` within ascending groups, and whether a row equals the one before in group and all symbols.

    Each part has a pivot, the median of three of its rows at the part's depth, and falls into rows below it, equal to it, and above
    it; the equal ones go on at the next symbol. All parts of a round are split at once.
    """
    n, depths = symbols.shape
    order, tied = np.arange(n), np.zeros(n, bool)
    rng = np.random.default_rng(n)
    place, first, depth = np.arange(n), np.append(True, group[1:] != group[:-1])[:n], np.zeros(n, np.int64)
    while True:
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, place.size))
        done = np.repeat(size, size) == 1
        full = ~done & (depth == depths)
        tied[place[full & ~first]] = True
        going = ~done & ~full
        if not going.any():
            return order, tied
        place, first, depth = place[going], first[going], depth[going]
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, place.size))
        part = np.cumsum(first) - 1
        own = symbols[order[place], depth]
        three = own[begin[:, None] + rng.integers(0, size[:, None], (size.size, 3))]
        pivot = np.sort(three, axis=1)[:, 1][part]
        side = 3 * part + (own > pivot) + (own >= pivot)
        by = np.argsort(side, kind="stable")
        order[place] = order[place[by]]
        side = side[by]
        depth = depth[by] + (side % 3 == 1)
        first = np.append(True, side[1:] != side[:-1])


def deep_shallow(strings: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings within ascending groups, and each one's common prefix with the one before (-1: a new group)."""
    n = len(strings)
    lengths = np.fromiter(map(len, strings), np.int64, n)
    padded = b"".join([s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings])
    symbols = np.frombuffer(padded, ">u8").reshape(n, SHALLOW // 8).astype(np.uint64)
    order, tied = multikey_quicksort(symbols, group)
    prefix = np.full(n, -1, np.int64)
    # deep: blind tries for what ties at the shallow depth
    bounds = np.flatnonzero(~tied)
    sizes = np.diff(np.append(bounds, n))
    for at in np.flatnonzero(sizes > 1):
        begin, end = bounds[at], bounds[at] + sizes[at]
        members = order[begin:end].tolist()
        if len(members) == 2:  # a trie of two leaves
            a, b = strings[members[0]], strings[members[1]]
            if a > b:
                members.reverse()
            shared = [0, common_prefix(a, b)]
        else:
            trie = BlindTrie()
            for m in members:
                trie.insert(m, strings)
            members, shared = zip(*trie.sorted(strings))
        order[begin:end] = members
        prefix[begin + 1 : end] = shared[1:]
    inside = np.flatnonzero(np.append(False, group[order][1:] == group[order][:-1]) & ~tied)
    if inside.size:  # neighbours that the shallow symbols tell apart
        differ = symbols[order[inside]] ^ symbols[order[inside - 1]]
        bits = np.zeros(inside.size, np.int64)
        for k in range(SHALLOW // 8):
            open_ = bits == 64 * k
            value = differ[:, k]
            lead = np.full(inside.size, 64)
            some = open_ & (value != 0)
            lead[some] = _leading_zeros(value[some])
            bits = np.where(open_, bits + lead, bits)
        prefix[inside] = np.minimum(bits // 8, np.minimum(lengths[order[inside]], lengths[order[inside - 1]]))
    return order, prefix


def _leading_zeros(values: np.ndarray) -> np.ndarray:
    high = (values >> np.uint64(32)).astype(np.float64)
    low = (values & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 - np.frexp(high)[1], 64 - np.frexp(low)[1])


# -- repeated starts ----------------------------------------------------------------------------------------------------


def repeated_starts(contexts: list[bytes], anchor: np.ndarray, offset: np.ndarray, more: np.ndarray, many: np.ndarray, length: int) -> np.ndarray:
    """(context, l): does the string that begins l bytes before the context's anchor occur in another context too?

    anchor: the anchors' hashes, ascending; offset: bytes before the anchor; more: starts after the first; many: contexts that
    occur twice at least by themselves.
    """
    n = len(contexts)
    where = offset.tolist()
    right, prefix = deep_shallow([c[o:] for c, o in zip(contexts, where)], anchor)
    left, back = deep_shallow([c[:o][::-1] for c, o in zip(contexts, where)], anchor)
    span = length - ANCHOR + 1
    found = np.zeros((n, span), bool)
    rank_right, rank_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for l in range(span):
        rank_right[right] = np.cumsum(prefix < length - l)  # equal rank: the same length - l bytes
        rank_left[left] = np.cumsum(back < l)
        asked = np.flatnonzero((l <= offset) & (l >= offset - more))
        if not asked.size:
            continue
        key = rank_right[asked] * (n + 1) + rank_left[asked]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        hit = many[asked[by]]
        hit[1:] |= same
        hit[:-1] |= same
        found[asked[by[hit]], l] = True
    return found


# -- Spark ----------------------------------------------------------------------------------------------------------------


def find_anchors(texts: list[bytes], length: int) -> Runs:
    """Runs of strings of `length` bytes that share an anchor."""
    for group in pieces([len(t) for t in texts], length):
        data = np.frombuffer(b"".join([texts[i][a:b] for i, a, b in group]), np.uint8)
        yield placed_runs(group, powers()[0][data], ANCHOR, length)


def same_strings(texts: list[bytes]) -> np.ndarray:
    """Equal numbers for equal strings, by sorting them."""
    order, prefix = deep_shallow(texts, np.zeros(len(texts), np.int8))
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))[order]
    out = np.empty(len(texts), np.int64)
    out[order] = np.cumsum(np.append(True, (prefix[1:] != lengths[1:]) | (lengths[1:] != lengths[:-1])))
    return out


def _cut(body: bytes, runs: np.ndarray) -> bytes:
    out, at = [], 0
    for begin, end in runs.tolist():
        out.append(body[at:begin])
        at = end
    out.append(body[at:])
    return b"".join(out)


def _to_characters(body: bytes, runs: np.ndarray) -> np.ndarray:
    """Runs shrunk so that they begin and end between characters."""
    out = []
    for begin, end in runs.tolist():
        while begin < end and body[begin] & 0xC0 == 0x80:
            begin += 1
        while end > begin and end < len(body) and body[end] & 0xC0 == 0x80:
            end -= 1
        if begin < end:
            out.append((begin, end))
    return np.array(out, np.int64).reshape(-1, 2)


def _joined(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    if not ANCHOR < length <= ANCHOR + 255:
        raise ValueError(f"a length between {ANCHOR + 1} and {ANCHOR + 255} is needed")
    keyed = keyed_documents(docs, id_col, text_col)
    scratch = Scratch(docs.sparkSession, "repeats")
    anchors = scratch.write(anchors_of(keyed, lambda texts: find_anchors(texts, length)), "anchors")
    twice = scratch.write(anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "twice")
    cut = lambda body: lambda start, n: body[start : start + n]
    return with_spans(keyed, anchors, twice, contexts_of=cut, same_contexts=same_strings, repeated=repeated_starts, length=length)


def drop_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """(row, kept_text) of each document, without the whole characters that strings of `length` bytes found elsewhere cover.

    row is a struct of the other columns of the input row, whatever their names. Nulls, repeats and empty tables as in
    `repeat_digests`.
    """
    joined = _joined(docs, id_col, text_col, length)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for bodies, spans_ in batches:
            kept = []
            for body, spans in zip(bodies.cast(pa.binary()), spans_of(spans_)):
                kept.append(body.as_py() if spans is None else _cut(text := body.as_py(), _to_characters(text, removed_runs(spans, length))))
            yield pa.array(kept, pa.binary()).cast(pa.string())

    return joined.select("row", column_of(docs.sparkSession, run, "string")("body", "spans").alias("kept_text"))


def repeat_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of each document.

    Removed is each byte that a string of `length` bytes covers which also starts elsewhere, in this or another document;
    strings are judged on the input. A null text is empty. Each row is a document, even if ids are null or repeated: a
    repeated row repeats all its strings. An empty table gives no rows; other columns are left out.
    """
    joined = _joined(docs.select(id_col, text_col), id_col, text_col, length)
    columns = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for bodies, spans_ in batches:
            sizes, removed, runs_, digests = [], [], [], []
            for value, spans in zip(bodies.cast(pa.binary()), spans_of(spans_)):
                body = value.as_py()
                runs = np.empty((0, 2), np.int64) if spans is None else removed_runs(spans, length)
                sizes.append(len(body))
                removed.append(int((runs[:, 1] - runs[:, 0]).sum()))
                runs_.append(len(runs))
                digests.append(hashlib.sha256(_cut(body, runs)).hexdigest())
            yield pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip((sizes, removed, runs_, digests), columns.values())], list(columns))

    found = column_of(docs.sparkSession, run, "struct<n_bytes:long,n_removed:long,n_spans:long,kept_sha256:string>")("body", "spans")
    return joined.select(F.col("row").getField(id_col).alias(id_col), found.alias("found")).select(id_col, "found.*")
