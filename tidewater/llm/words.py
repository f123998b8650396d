"""Hashes of the words of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

from tidewater.llm.repeats import CHUNK, powers


def _table(separators: Iterator[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(separators)] = True
    return table


#: Bytes between words: ASCII white space, or all ASCII but letters and digits.
SPACES = _table(b for b in range(128) if chr(b) in " \t\n\x0b\x0c\r")
SIGNS = _table(b for b in range(128) if not chr(b).isalnum())


def _segments(text: bytes, between: np.ndarray) -> Iterator[bytes]:
    """Parts of a text that end between words, of less than CHUNK bytes unless one word is longer."""
    at, whole = 0, np.frombuffer(text, np.uint8)
    while len(text) - at >= CHUNK:
        gaps = np.flatnonzero(between[whole[at : at + CHUNK - 1]])
        if gaps.size:
            end = at + int(gaps[-1]) + 1
        else:
            gaps = np.flatnonzero(between[whole[at:]])
            end = at + int(gaps[0]) + 1 if gaps.size else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def word_hashes(texts: list[bytes], between: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[list[np.ndarray], np.ndarray]:
    """64-bit hashes of the words of all texts in a row (and of their first so many bytes), and how many words each text has."""
    hashes: list[list[np.ndarray]] = [[] for _ in range(1 + len(prefixes))]
    counts = np.zeros(len(texts), np.int64)
    held: list[tuple[int, bytes]] = []

    def mixed(x: np.ndarray) -> np.ndarray:
        x = x ^ x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(29)

    def settle() -> None:
        values, power, inverse = powers()
        data = np.frombuffer(b" ".join([s for _, s in held]), np.uint8)
        word = np.diff(np.pad(~between[data], 1).astype(np.int8))
        begin, end = np.flatnonzero(word == 1), np.flatnonzero(word == -1)
        sums = np.zeros(data.size + 1, np.uint64)
        np.cumsum(values[data] * power[: data.size], out=sums[1:])
        for out, most in zip(hashes, (CHUNK, *prefixes)):
            out.append(mixed((sums[np.minimum(end, begin + most)] - sums[begin]) * inverse[begin]))
        bounds = np.cumsum([len(s) + 1 for _, s in held])
        np.add.at(counts, np.array([i for i, _ in held])[np.searchsorted(bounds, begin, "right")], 1)
        held.clear()

    size = 0
    for i, text in enumerate(texts):
        for part in _segments(text, between):
            if size + len(part) + 1 > CHUNK and held:
                settle()
                size = 0
            if len(part) >= CHUNK:  # one word, and what separates it from the next
                one = part.strip(bytes(np.flatnonzero(between).tolist()))
                for out, most in zip(hashes, (None, *prefixes)):
                    out.append(np.array([xxhash.xxh64_intdigest(one[:most])], np.uint64))
                counts[i] += 1
                continue
            held.append((i, part))
            size += len(part) + 1
    if held:
        settle()
    return [np.concatenate(h) if h else np.empty(0, np.uint64) for h in hashes], counts
