"""Toxicity by a classifier chain.

A chain has a linear model for each category, in order; a model's inputs are the text's features and the probabilities of the
categories before it. It is trained with out-of-fold probabilities, so a later model sees earlier ones with the errors that they
make on new texts. Features are the words of a text, and their beginnings, as hashes; those that tell most about a category
are kept. Training takes a bounded sample of labelled rows; scoring takes every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import column_of, mapped, slices, text_of
from tidewater.llm.words import SIGNS, word_hashes

#: Labelled rows that a chain is trained on at most, the bytes of their texts at most, features of each category, and the bytes of a
#: word's beginning.
LABELLED, LABELLED_BYTES, FEATURES, PREFIX = 10_000, 96 << 20, 384, 5
#: Folds, strength of the penalty, and texts that must have a feature.
FOLDS, PENALTY, LEAST_TEXTS = 4, 1.0, 3


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features (uint32) of all texts in a row, repeats included, and how many each text has."""
    (whole, prefix), counts = word_hashes([t.lower().encode("utf-8") for t in texts], SIGNS, (PREFIX,))
    both = np.stack([whole, prefix ^ np.uint64(0x5555)], axis=1).ravel()
    return (both >> np.uint64(32)).astype(np.uint32), 2 * counts


class Rows:
    """Sparse 0/1 rows: for each entry its row and its column."""

    def __init__(self, row: np.ndarray, column: np.ndarray, shape: tuple[int, int]) -> None:
        self.row, self.column, self.shape = row, column, shape

    def times(self, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weight[self.column], self.shape[0])

    def back(self, value: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, value[self.row], self.shape[1])

    def only(self, pick: np.ndarray) -> Rows:
        place = np.cumsum(pick) - 1
        keep = pick[self.row]
        return Rows(place[self.row[keep]], self.column[keep], (int(pick.sum()), self.shape[1]))


def _probability(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


@dataclass
class Linear:
    weight: np.ndarray  # of the features
    extra: np.ndarray  # of the earlier probabilities
    bias: float

    def predict(self, rows: Rows, earlier: np.ndarray) -> np.ndarray:
        return _probability(rows.times(self.weight) + earlier @ self.extra + self.bias)


def fit(rows: Rows, earlier: np.ndarray, y: np.ndarray) -> Linear:
    """Logistic regression with a squared penalty, by Newton steps solved with conjugate gradients."""
    n, m, k = *rows.shape, earlier.shape[1]
    if not y.any() or y.all():
        return Linear(np.zeros(m), np.zeros(k), 30.0 if n and y.all() else -30.0)

    def forward(w: np.ndarray) -> np.ndarray:
        return rows.times(w[:m]) + earlier @ w[m : m + k] + w[-1]

    def backward(v: np.ndarray) -> np.ndarray:
        return np.concatenate([rows.back(v), earlier.T @ v, [v.sum()]])

    def loss(w: np.ndarray) -> float:
        score = forward(w)
        return float(np.logaddexp(0, score).sum() - y @ score + (penalty * w * w).sum() / 2)

    penalty = np.full(m + k + 1, PENALTY)
    penalty[-1] = 1e-6
    w = np.zeros(m + k + 1)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    for _ in range(20):
        p = _probability(forward(w))
        gradient = backward(p - y) + penalty * w
        curve = np.maximum(p * (1 - p), 1e-6)
        step, residual = np.zeros_like(w), -gradient
        direction, size = residual.copy(), float(residual @ residual)
        start = size
        for _ in range(25):
            if size < 1e-4 * start:
                break
            bent = backward(curve * forward(direction)) + penalty * direction
            alpha = size / float(direction @ bent)
            step += alpha * direction
            residual -= alpha * bent
            size, old = float(residual @ residual), size
            direction = residual + size / old * direction
        here, size = loss(w), 1.0
        while size > 1e-3 and loss(w + size * step) > here:
            size /= 2
        w += size * step
        if np.abs(step).max() < 1e-4:
            break
    return Linear(w[:m], w[m : m + k], float(w[-1]))


@dataclass
class Chain:
    categories: list[str]
    known: np.ndarray  # sorted hashes of the kept features
    models: list[Linear]
    threshold: float = 0.5  # of the last category

    def rows(self, hashed: np.ndarray, counts: np.ndarray) -> Rows:
        owner = np.repeat(np.arange(len(counts)), counts)
        if not self.known.size:
            return Rows(owner[:0], owner[:0], (len(counts), 0))
        at = np.minimum(np.searchsorted(self.known, hashed), self.known.size - 1)
        hit = self.known[at] == hashed
        entry = np.unique(owner[hit] * self.known.size + at[hit])  # a feature counts once in a text
        return Rows(entry // self.known.size, entry % self.known.size, (len(counts), self.known.size))

    def predict(self, rows: Rows) -> np.ndarray:
        """(text, category) probabilities, category by category."""
        out = np.zeros((rows.shape[0], 0))
        for model in self.models:
            out = np.column_stack([out, model.predict(rows, out)])
        return out


def _kept_features(texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The features with the largest likelihood ratio for some category, sorted."""
    found, seen = np.unique(np.concatenate(texts) if texts else np.empty(0, np.uint32), return_counts=True)
    found, seen = found[seen >= LEAST_TEXTS], seen[seen >= LEAST_TEXTS]
    if not found.size:
        return found
    n, keep = len(texts), np.zeros(found.size, bool)

    def part(x: np.ndarray, of: np.ndarray, base: float) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log(x / (of * base)), 0)

    for y in labels.T:
        if not y.any() or y.all():
            continue
        own = np.concatenate([t for t, flag in zip(texts, y) if flag])
        at = np.minimum(np.searchsorted(found, own), found.size - 1)
        with_ = np.bincount(at[found[at] == own], minlength=found.size).astype(float)
        base = y.mean()
        score = part(with_, seen, base) + part(seen - with_, seen, 1 - base) + part(y.sum() - with_, n - seen, base) + part(n - seen - (y.sum() - with_), n - seen, 1 - base)
        keep[np.argsort(-score, kind="stable")[:FEATURES]] = True
    return found[keep]


def train(texts: list[np.ndarray], labels: np.ndarray, categories: list[str]) -> Chain:
    """A chain from the features of some texts (each sorted, without repeats) and their 0/1 labels (text, category)."""
    chain = Chain(categories, _kept_features(texts, labels), [])
    rows = chain.rows(np.concatenate(texts) if texts else np.empty(0, np.uint32), np.array([len(t) for t in texts], np.int64))
    fold = np.arange(len(texts)) % FOLDS
    earlier = np.zeros((len(texts), 0))
    for y in labels.T.astype(float):
        outside = np.zeros(len(texts))
        for k in range(FOLDS):
            held = fold == k
            if held.any():
                outside[held] = fit(rows.only(~held), earlier[~held], y[~held]).predict(rows.only(held), earlier[held])
        chain.models.append(fit(rows, earlier, y))
        earlier = np.column_stack([earlier, outside])
    if len(texts):
        chain.threshold = _threshold(earlier[:, -1], labels[:, -1])
    return chain


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the best F1 for out-of-fold probabilities, half way to the next lower one; 0.5 if that does as well."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(p) + 1) + max(1, y.sum()))
    ends = np.append(p[order][1:] < p[order][:-1], True)  # equal probabilities stay together
    best = int(np.argmax(np.where(ends, f1, -1)))
    half = int((p >= 0.5).sum())
    if not y.any() or half and f1[half - 1] >= f1[best]:
        return 0.5
    below = p[order[best + 1]] if best + 1 < len(p) else 0.0
    return float(np.clip((p[order[best]] + below) / 2, 0.05, 0.95))


def train_on(docs: DataFrame, labelled: DataFrame, categories: dict[str, Column], *, id_col: str = "doc_id", text_col: str = "text", most: int = LABELLED, most_bytes: int = LABELLED_BYTES) -> Chain:
    """A chain trained on at most `most` labelled rows, taken by the order of a hash of their ids, as far as their texts have
    `most_bytes` together; features of these rows, at most twice as large, come to the driver.

    categories: for each category, in the chain's order, a condition on the columns of `labelled` (a table of ids and labels) and
    of `docs`; where it is null the label is 0. Equal texts count once, so that a text of many copies doesn't outweigh others. Ids without a
    document, null ids and null texts teach nothing; without positive rows a category's probability is 0.
    """
    sample = labelled.where(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(most)
    both = docs.where(F.col(text_col).isNotNull()).join(F.broadcast(sample), id_col)  # `most` rows of ids and labels at most
    sizes = both.groupBy(id_col).agg(F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("bytes"))  # `most` rows at most
    so_far = F.sum("bytes").over(Window.orderBy(F.xxhash64(id_col), id_col).rowsBetween(Window.unboundedPreceding, 0))
    both = both.join(F.broadcast(sizes.select(id_col, so_far.alias("so_far")).where(F.col("so_far") <= most_bytes).select(id_col)), id_col, "left_semi")
    flags = F.array(*[F.coalesce(c.cast("int"), F.lit(0)) for c in categories.values()])
    given = both.select(F.xxhash64(text_col).alias("key"), flags.alias("flags"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in slices(batches, "text"):
            hashed, counts = features(values)
            own = [np.unique(x) for x in np.split(hashed, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.tobytes() for x in own], pa.binary())], names=["key", "flags", "features"])

    found = given.transform(mapped, run, "key long, flags array<int>, features binary").toArrow()
    order = np.argsort(found["key"].to_numpy(), kind="stable")
    keys = found["key"].to_numpy()[order]
    order = order[np.append(True, keys[1:] != keys[:-1])] if len(keys) else order
    texts = [np.frombuffer(found["features"][int(i)].as_py(), np.uint32) for i in order]
    labels = np.array([found["flags"][int(i)].as_py() for i in order], np.int8).reshape(len(order), len(categories))
    return train(texts, labels, list(categories))


def score(docs: DataFrame, chain: Chain, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, probabilities) for each input row: a struct of all its columns, and the categories' probabilities in order.

    A null or empty text has no features and gets the probabilities of none; an empty table gives no rows. Texts go to Python once,
    and only probabilities come back.
    """
    held = docs.sparkSession.sparkContext.broadcast(chain)  # a few thousand weights

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = held.value
        for batch in batches:
            found = [np.zeros((0, len(model.models)))]
            for _, texts in slices([pa.RecordBatch.from_arrays([batch], names=["text"])], "text"):
                found.append(model.predict(model.rows(*features(texts))))
            p = np.concatenate(found)
            ends = pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1])
            yield pa.ListArray.from_arrays(ends, pa.array(p.ravel()))

    whole = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
    scored = column_of(docs.sparkSession, run, "array<double>")(text_of(text_col))
    return docs.select(whole.alias("row"), scored.alias("probabilities"))


def label_categories(labelled: DataFrame, docs: DataFrame, *, id_col: str = "doc_id", most: int = LABELLED, languages: int = 8) -> dict[str, Column]:
    """The chain's categories: toxic in each of the labelled rows' most common languages, and at last toxic at all."""
    sample = labelled.where(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(most)
    toxic = F.col("toxic") == 1
    common = docs.select(id_col, "lang").join(F.broadcast(sample), id_col).where(toxic & F.col("lang").isNotNull()).groupBy("lang").count()
    names = [r["lang"] for r in common.orderBy(F.desc("count"), "lang").limit(languages).collect()]
    return {f"toxic_{n}": toxic & (F.col("lang") == n) for n in names} | {"toxic": toxic}


def toxicity(docs: DataFrame, chain: Chain, *, id_col: str = "doc_id", text_col: str = "text", threshold: float | None = None) -> DataFrame:
    """(id, toxic_probability, toxic, categories) of each document; categories: those at or over the threshold, by commas.

    The threshold is the chain's own unless given. Nulls and empty tables as in `score`.
    """
    threshold = chain.threshold if threshold is None else threshold
    scored = score(docs.select(id_col, text_col), chain, id_col=id_col, text_col=text_col)
    last = F.element_at("probabilities", -1)
    names = [F.when(F.get("probabilities", F.lit(k)) >= threshold, F.lit(c)) for k, c in enumerate(chain.categories)]
    return scored.select(
        F.col("row").getField(id_col).alias(id_col), last.alias("toxic_probability"), (last >= threshold).alias("toxic"), F.concat_ws(",", *names).alias("categories")
    )
