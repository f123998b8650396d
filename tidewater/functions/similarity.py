"""Similarity of short strings, 0 to 100, by the published definition of the weighted ratio over indel distances."""

from __future__ import annotations

import re

import numpy as np

_OTHER = re.compile(r"(?u)[\W_]")
#: Weights of token scores and of partial scores, and the length ratios at which they change.
TOKEN_WEIGHT, PARTIAL_WEIGHT, FAR_WEIGHT, PARTIAL_FROM, FAR_FROM = 0.95, 0.9, 0.6, 1.5, 8.0


def prepared(text: str) -> str:
    """Lower case, other characters than letters and digits as spaces, stripped."""
    return _OTHER.sub(" ", text).lower().strip()


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of `a`."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & masks.get(ch, 0)
        state = (state + hit | state - hit) & full
    return len(a) - state.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * _common(a, b) / total if total else 100.0


def _whole(distance: int, total: int) -> float:
    return 100.0 * (1 - distance / total) if total else 100.0


def token_ratio(a: str, b: str) -> float:
    """The best of comparing sorted words, and common words with each side's rest."""
    words_a, words_b = sorted(a.split()), sorted(b.split())
    best = ratio(" ".join(words_a), " ".join(words_b))
    both = set(words_a) & set(words_b)
    rest_a, rest_b = sorted(set(words_a) - both), sorted(set(words_b) - both)
    if both and not (rest_a and rest_b):
        return 100.0
    text_a, text_b = " ".join(rest_a), " ".join(rest_b)
    shared = len(" ".join(both))
    gap = 1 if shared else 0
    full_a, full_b = shared + gap + len(text_a), shared + gap + len(text_b)
    distance = len(text_a) + len(text_b) - 2 * _common(text_a, text_b)
    best = max(best, _whole(distance, full_a + full_b))
    if shared:
        best = max(best, _whole(gap + len(text_a), shared + full_a), _whole(gap + len(text_b), shared + full_b))
    return best


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a part of the longer one, parts at its ends included."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n, letters = len(a), set(a)
    best = 0.0
    windows = [(i, min(len(b), i + n)) for i in range(len(b))] + [(0, k) for k in range(1, n)]
    for begin, end in windows:
        if b[end - 1] in letters or b[begin] in letters:
            best = max(best, ratio(a, b[begin:end]))
            if best == 100.0:
                break
    if len(a) == len(b) and best < 100.0:
        for begin, end in [(i, n) for i in range(n)] + [(0, k) for k in range(1, n)]:
            best = max(best, ratio(b, a[begin:end]))
    return best


def partial_token_ratio(a: str, b: str) -> float:
    words_a, words_b = a.split(), b.split()
    both = set(words_a) & set(words_b)
    if both:
        return 100.0
    best = partial_ratio(" ".join(sorted(words_a)), " ".join(sorted(words_b)))
    rest_a, rest_b = sorted(set(words_a)), sorted(set(words_b))
    if len(rest_a) != len(words_a) or len(rest_b) != len(words_b):
        best = max(best, partial_ratio(" ".join(rest_a), " ".join(rest_b)))
    return best


def weighted_ratio(a: str, b: str) -> float:
    """Of two prepared strings; 0 if one is empty."""
    if not a or not b:
        return 0.0
    spread = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if spread < PARTIAL_FROM:
        return max(best, TOKEN_WEIGHT * token_ratio(a, b))
    weight = PARTIAL_WEIGHT if spread <= FAR_FROM else FAR_WEIGHT
    best = max(best, weight * partial_ratio(a, b))
    return max(best, TOKEN_WEIGHT * weight * partial_token_ratio(a, b))


def similarity(a: str, b: str) -> float:
    return weighted_ratio(prepared(a), prepared(b))


class Texts:
    """Many strings as rows of character numbers, for subsequences in common with one of them."""

    def __init__(self, texts: list[str]) -> None:
        known = {c: i for i, c in enumerate(sorted(set("".join(texts))))}
        self.size = np.array([len(t) for t in texts], np.int64)
        self.codes = np.full((len(texts), int(self.size.max(initial=0))), len(known), np.int64)
        self.counts = np.zeros((len(texts), len(known)), np.int32)
        for row, text in enumerate(texts):
            self.codes[row, : len(text)] = [known[c] for c in text]
            np.add.at(self.counts[row], self.codes[row, : len(text)], 1)

    def common(self, row: int, others: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences with a row; over 64 characters how many are in both, which is no less."""
        n = int(self.size[row])
        if n > 64:
            return np.minimum(self.counts[others], self.counts[row]).sum(1)
        masks = np.zeros(self.counts.shape[1] + 1, np.uint64)
        np.bitwise_or.at(masks, self.codes[row, :n], np.uint64(1) << np.arange(n, dtype=np.uint64))
        full = np.uint64((1 << n) - 1)
        state = np.full(len(others), full)
        for k in range(int(self.size[others].max(initial=0))):
            hit = state & masks[self.codes[others, k]]
            state = ((state + hit) | (state - hit)) & full
        return n - np.bitwise_count(state).astype(np.int64)


class Bounds:
    """What weighted ratios of many prepared strings with others reach at most; mostly that is what they are.

    A part of a string has no longer a subsequence in common with another string than the whole. Strings with repeated words aren't
    bounded, as they are compared without the repeats too.
    """

    def __init__(self, texts: list[str]) -> None:
        parts = [t.split() for t in texts]
        numbers = {w: i for i, w in enumerate(sorted({w for p in parts for w in p}))}
        self.whole, self.by_word = Texts(texts), Texts([" ".join(sorted(p)) for p in parts])
        self.open = np.array([len(set(p)) < len(p) for p in parts], bool)
        self.words = np.zeros((len(texts), len(numbers)), np.float32)
        for row, p in enumerate(parts):
            for w in p:
                self.words[row, numbers[w]] = np.sqrt(len(w) + 1.0)

    def reach(self, row: int, others: np.ndarray) -> np.ndarray:
        """At least the weighted ratio of the string `row` with each of `others`, rows too."""
        sizes = self.whole.size
        if not sizes[row] or not len(others):
            return np.zeros(len(others))

        def ratios(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
            """Of whole strings; and at most those of the shorter one with parts of the longer."""
            common, low, high = texts.common(row, others), np.minimum(texts.size[row], texts.size[others]), np.maximum(texts.size[row], texts.size[others])
            return 200 * common / np.maximum(low + high, 1), 200 * common / np.maximum(low + common, 1)

        plain, part = ratios(self.whole)
        words, words_part = ratios(self.by_word)
        # words in common, with the spaces between them, against each side and against what is left of both sides
        a, b = float(self.by_word.size[row]), self.by_word.size[others].astype(float)
        shared = np.minimum(np.round(self.words[others] @ self.words[row]) - 1, np.minimum(a, b))
        shares = shared > 0
        least = np.minimum(a, b)
        left = 100 * np.maximum(1 - (least - shared) / np.maximum(least + shared, 1), 2 * np.minimum(self.by_word.counts[others], self.by_word.counts[row]).sum(1) / np.maximum(a + b, 1))
        words = np.maximum(words, np.where(shares, left, 0))
        spread = np.maximum(sizes[row], sizes[others]) / np.maximum(np.minimum(sizes[row], sizes[others]), 1)
        weight = np.where(spread <= FAR_FROM, PARTIAL_WEIGHT, FAR_WEIGHT)
        partly = np.maximum(weight * part, TOKEN_WEIGHT * weight * np.where(shares, 100.0, words_part))
        out = np.maximum(plain, np.where(spread < PARTIAL_FROM, TOKEN_WEIGHT * words, partly)) + 1e-6
        return np.where(sizes[others] == 0, 0.0, np.where(self.open[others] | self.open[row], 100.0, out))
