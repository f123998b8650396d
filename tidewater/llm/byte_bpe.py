"""Byte-level BPE encoding in linear time, by longest matches and backtracking, and decoding.

An Aho-Corasick automaton over the vocabulary (bytes mapped to Latin-1 characters, which pyahocorasick takes) lists all
tokens that occur in a pre-token. Encoding walks from the longest match at each place and steps back to shorter ones
where two neighbours could not stand side by side in a BPE result. Whether they could is a property of the two tokens
alone, so it is remembered; a place that failed once is never entered again, so the work is linear in the length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Memory, mapped, slices, text_of

#: Bytes that a worker may use to remember pre-tokens, and pairs that it remembers; each memory is emptied when full.
MEMORY, PAIRS = 60 << 20, 400_000
#: Characters of a text beyond which its words are listed bit by bit.
PIECE = 1 << 20


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.size = [len(t) for t in self.bytes_of]
        self.words = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.halves = [self._halves(t) for t in self.bytes_of]
        self.joined = {pair: rank for rank, pair in enumerate(self.halves) if pair is not None}
        self.shorter = [self._shorter(t) for t in self.bytes_of]
        self.fits: dict[int, bool] = {}
        self.known = Memory(MEMORY)

    # -- tables -------------------------------------------------------------------------------------------------

    def _halves(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens whose merge makes `token`; None for a single byte."""
        if len(token) < 2:
            return None
        own, parts = self.ranks[token], [self.ranks[token[i : i + 1]] for i in range(len(token))]
        while len(parts) > 2:
            best, at = own, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(self.bytes_of[parts[i]] + self.bytes_of[parts[i + 1]], own)
                if rank < best:
                    best, at = rank, i
            if at < 0:
                return None  # can't arise by merges
            parts[at : at + 2] = [best]
        return parts[0], parts[1]

    def _shorter(self, token: bytes) -> int:
        """The longest token that is a proper prefix, or -1."""
        return next((self.ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), -1)

    def _stands(self, left: int, right: int) -> bool:
        """Do the merges of both tokens, replayed side by side, leave the boundary between them alone?

        Undo the merges nearest to the boundary, latest first. At each step the two symbols that face each other must not
        merge earlier than the step being undone, else BPE would have joined them.
        """
        ceiling = len(self.bytes_of)
        while True:
            met = self.joined.get((left, right))
            if met is not None and met < ceiling:
                return False
            for turn in ((0, 1) if left > right else (1, 0)):
                if turn == 0 and self.halves[left]:
                    ceiling, left = left, self.halves[left][1]
                    break
                if turn == 1 and self.halves[right]:
                    # of equal ranks the left one merges first, so a merge as late as this one still wins
                    ceiling, right = right + 1, self.halves[right][0]
                    break
            else:
                return True

    def stands(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            known = self.fits[key] = self._stands(left, right)
        return known

    # -- encoding -----------------------------------------------------------------------------------------------

    def encode_word(self, word: bytes) -> list[int]:
        """Token ids of one pre-token."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        n = len(word)
        longest = [-1] * n
        size = self.size
        for end, rank in self.automaton.iter(word.decode("latin-1")):
            start = end + 1 - size[rank]
            if longest[start] < 0 or size[longest[start]] < size[rank]:
                longest[start] = rank
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token, fits, shorter, stands = 0, longest[0], self.fits, self.shorter, self.stands
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                if not dead[at + size[token]]:
                    if last < 0:
                        break
                    good = fits.get(last << 32 | token)
                    if good or good is None and stands(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                token = longest[at] if at < n else -1
            else:  # nothing fits here: give up this place and shorten what led to it
                dead[at] = 1
                token = shorter[out.pop()]
                at -= size[last]
        return out

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text, each match of the pattern by itself."""
        out = []
        if len(text) <= PIECE:
            words = [self.words.findall(text)]
        else:
            matches = self.words.finditer(text)
            words = iter(lambda: [m[0] for m in islice(matches, PIECE // 8)], [])
        for some in words:
            fresh, known = self.known.missing(set(some)), self.known.known
            for word in fresh:
                ids = self.encode_word(word.encode("utf-8"))
                known[word] = pack(f"<{len(ids)}I", *ids)
            out.append(b"".join(map(known.__getitem__, some)))
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    with open(path, "rb") as file:
        return ByteBpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}, pattern)


def encode_documents(docs: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<long>) of each whole text; `ranks` is a tiktoken file.

    A null text is empty and has no ids; a null id stays null; repeated rows each give a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks, pattern)
        for part, texts in slices(batches, "text"):
            each = [bpe.ids(t) for t in texts]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32)
            flat = pa.array(np.concatenate(each).astype(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], names=[id_col, "ids"])

    given = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return mapped(given, run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<long>")


def decode_documents(encoded: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes binary) from arrays of ids; null arrays are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks, pattern)
        for batch in batches:
            texts = [bpe.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=[id_col, "bytes"])

    given = encoded.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<long>")).alias("ids"))
    return mapped(given, run, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, bytes binary")


def round_trip(docs: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of each whole text's ids and of what they decode to: (id, n_tokens, ids_sha256, decoded_sha256).

    Encoding and decoding happen in one pass, so that ids don't cross between the JVM and Python; nulls as in
    `encode_documents`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks, pattern)
        for part, texts in slices(batches, "text"):
            n, coded, decoded = [], [], []
            for text in texts:
                ids = bpe.ids(text)
                n.append(len(ids))
                coded.append(hashlib.sha256(ids.tobytes()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            arrays = [part.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    given = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return mapped(given, run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
