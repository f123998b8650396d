"""Token counts by rank-synchronous array merging.

The distinct pre-tokens of a batch lie in one ragged symbol array. Each round looks up every neighbouring pair's merge
rank, takes the lowest rank of every sequence, and applies all of a sequence's pairs of that rank at once; sequences
without a mergeable pair leave. What survives of a sequence is its tokens. One round serves all sequences, so the number
of numpy calls follows the longest sequence and not the number of words.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Memory, mapped, slices, text_of

#: Fixed value: the pattern of pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters of texts that split() parts as the pattern does: of Latin-1, white space, visible ASCII, and letters.
PLAIN = bytes([*range(0x09, 0x0E), *range(0x20, 0x7F), *(b for b in range(0x80, 0x100) if unicodedata.category(chr(b))[0] == "L")])
_NONE = np.int32(np.iinfo(np.int32).max)
#: Bytes that a worker may use to remember units, for counts and for ids.
MEMORY = 40 << 20
#: Characters of a text that are split into words at a time; cut at white space, which this kind of vocabulary drops.
PIECE = 1 << 20


class MergeTable:
    """Rank of a pair of symbols, by open addressing in two arrays."""

    BITS = 18

    def __init__(self, left: np.ndarray, right: np.ndarray) -> None:
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.ranks = np.full(1 << self.BITS, _NONE, np.int32)
        self.probes = 1
        mask = (1 << self.BITS) - 1
        wanted = (left.astype(np.int64) << 32) | right
        for rank, (key, slot) in enumerate(zip(wanted.tolist(), self._slot(wanted).tolist())):
            tried = 1
            while self.keys[slot] not in (-1, key):
                slot, tried = (slot + 1) & mask, tried + 1
            if self.keys[slot] == -1:
                self.keys[slot], self.ranks[slot] = key, rank
            self.probes = max(self.probes, tried)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.ranks[slot], _NONE)
        todo = np.flatnonzero((there != key) & (there != -1))
        for step in range(1, self.probes):
            if not todo.size:
                break
            at = (slot[todo] + step) & ((1 << self.BITS) - 1)
            there = self.keys[at]
            found = there == key[todo]
            out[todo[found]] = self.ranks[at[found]]
            todo = todo[~found & (there != -1)]
        return out


class WordBpe:
    """A lower-casing word BPE with word-end symbols, read from a tokenizers file."""

    def __init__(self, path: str) -> None:
        self.path, self.library = path, None
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if spec["model"]["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("not a lower-casing word BPE")
        vocab, merges, end = spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.table = MergeTable(np.array([vocab[a] for a, _ in pairs]), np.array([vocab[b] for _, b in pairs]))
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        shown = byte_symbols()
        self.inner = np.array([vocab[c] for c in shown], np.int32)
        self.last = np.array([vocab[c + end] for c in shown], np.int32)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern).findall
        self.by_space = pattern == PATTERN
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.known, self.known_ids = Memory(MEMORY), Memory(MEMORY)

    # -- rank-synchronous merging -------------------------------------------------------------------------------

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each word has."""
        raw = [w.encode("utf-8") for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbol = self.inner[data]
        ends = np.cumsum(lengths) - 1
        symbol[ends] = self.last[data[ends]]
        owner = np.repeat(np.arange(len(raw), dtype=np.int32), lengths)
        done_symbols, done_owners = [], []
        while symbol.size:
            start = np.empty(symbol.size, bool)
            start[0] = True
            np.not_equal(owner[1:], owner[:-1], out=start[1:])
            rank = np.full(symbol.size, _NONE, np.int32)
            inside = np.flatnonzero(~start[1:])
            rank[inside] = self.table.rank(symbol[inside], symbol[inside + 1])
            lowest = np.minimum.reduceat(rank, np.flatnonzero(start))[np.cumsum(start) - 1]
            open_ = lowest != _NONE
            if not open_.all():
                done_symbols.append(symbol[~open_])
                done_owners.append(owner[~open_])
                symbol, owner, rank, lowest = symbol[open_], owner[open_], rank[open_], lowest[open_]
                if not symbol.size:
                    break
            hit = np.flatnonzero(rank == lowest)
            if hit.size > 1:  # of pairs that overlap (a a a) every other one, from the left
                new_run = np.ones(hit.size, bool)
                new_run[1:] = np.diff(hit) > 1
                place = np.arange(hit.size)
                hit = hit[(place - np.maximum.accumulate(np.where(new_run, place, 0))) % 2 == 0]
            symbol[hit] = self.merged[rank[hit]]
            keep = np.ones(symbol.size, bool)
            keep[hit + 1] = False
            symbol, owner = symbol[keep], owner[keep]
        if not done_owners:
            return np.empty(0, np.int32), np.zeros(len(raw), np.int64)
        owners = np.concatenate(done_owners)
        order = np.argsort(owners, kind="stable")
        return np.concatenate(done_symbols)[order], np.bincount(owners, minlength=len(raw))

    # -- texts --------------------------------------------------------------------------------------------------

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # lower-cased letter by letter, so without a final sigma
        return text.lower()

    def units(self, text: str) -> list[str]:
        """A normalised text as strings that are tokenised each by itself: what white space parts, or pre-tokens."""
        if self.by_space:
            try:
                if not text.encode("latin-1").translate(None, PLAIN):
                    return text.split()
            except UnicodeEncodeError:
                pass
        return self.words(text)

    def tokens_of(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in a row, and how many each has."""
        words, many = [], []
        for unit in units:
            own = (unit,) if unit.isalpha() else self.words(unit)
            words += own
            many.append(len(own))
        ids, each = self.merge(words)
        return ids, np.add.reduceat(each, np.cumsum(many) - many)

    def segments(self, text: str) -> Iterator[tuple[list[str], bytes]]:
        """Units of each stretch of a text and the ids that follow it: of a special token, or none.

        A text with characters that Python's Unicode tables don't know yet is left to the tokenizers library, whose tables may.
        """
        if not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text)):
            from tokenizers import Tokenizer

            self.library = self.library or Tokenizer.from_file(self.path)
            yield [], np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            return
        pieces = self.cut.split(text) if "<|" in text else [text]
        for i in range(0, len(pieces), 2):
            tail = self.special[pieces[i + 1]].to_bytes(4, "little") if i + 1 < len(pieces) else b""
            parts = list(cut_at_space(pieces[i], PIECE))
            for part in parts[:-1]:
                yield self.units(self.normal(part)), b""
            yield self.units(self.normal(parts[-1])), tail

    def counts(self, texts: Iterable[str | None]) -> list[int]:
        """Tokens of each text."""
        flat, sizes, extra = [], [], []
        totals: list[int] = []

        def settle() -> None:
            fresh, known = self.known.missing(set(flat)), self.known.known
            for at in range(0, len(fresh), 200_000):
                some = fresh[at : at + 200_000]
                known.update(zip(some, self.tokens_of(some)[1].tolist()))
            each = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
            ends = np.cumsum(np.array(sizes, np.int64))
            sums = np.concatenate([[0], np.cumsum(each)])
            totals.extend((sums[ends] - sums[ends - np.array(sizes, np.int64)] + np.array(extra, np.int64)).tolist())
            flat.clear(), sizes.clear(), extra.clear()

        spread = []  # stretches of each text
        for text in texts:
            n = 0
            for units, tail in self.segments(text or ""):
                flat += units
                sizes.append(len(units))
                extra.append(len(tail) // 4)
                n += 1
                if len(flat) > 1_000_000:
                    settle()
            spread.append(n)
        if sizes:
            settle()
        sums = np.concatenate([[0], np.cumsum(np.array(totals, np.int64))])
        ends = np.cumsum(np.array(spread, np.int64))
        return (sums[ends] - sums[ends - np.array(spread, np.int64)]).tolist()

    def ids(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        for packed in self.packed_ids(texts):
            yield np.frombuffer(packed, "<u4")

    def packed_ids(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        stretches = [list(self.segments(text or "")) for text in texts]
        every = set().union(*[units for parts in stretches for units, _ in parts])
        fresh, known = self.known_ids.missing(every), self.known_ids.known
        for at in range(0, len(fresh), 200_000):
            some = fresh[at : at + 200_000]
            ids, many = self.tokens_of(some)
            data = ids.astype("<u4").tobytes()
            ends = (4 * np.cumsum(many)).tolist()
            known.update(zip(some, [data[a:b] for a, b in zip([0, *ends], ends)]))
        for parts in stretches:
            out = []
            for units, tail in parts:
                out += map(known.__getitem__, units)
                out.append(tail)
            yield b"".join(out)


def cut_at_space(text: str, size: int) -> Iterator[str]:
    """Pieces of at least `size` characters that end at a space or line feed; at least one piece."""
    at = 0
    while len(text) - at > size:
        ends = [e for e in (text.find(" ", at + size), text.find("\n", at + size)) if e >= 0]
        if not ends:
            break
        yield text[at : min(ends)]
        at = min(ends)
    yield text[at:]


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def count_tokens(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Tokens of each whole text: (id, n_bytes, n_tokens, over_limit), a row for each input row.

    A null text is empty and has no tokens; a null id stays null; repeated rows each give a row. Special strings inside a
    text count as one token, none are added. Other columns of `docs` are left out, so their names can't clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for part, texts in slices(batches, "text"):
            n = pa.array(bpe.counts(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), n], names=[id_col, "n_bytes", "n_tokens"])

    given = docs.select(F.col(id_col).alias("id"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"), text_of(text_col).alias("text"))
    counted = mapped(given, run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
