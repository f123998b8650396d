from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm.toxicity import features, fit, Rows, label_categories, score, toxicity, train, train_on
from tidewater.llm.vp_search import VpTree, nearest


# -- toxicity ---------------------------------------------------------------------------------------------------------


def corpus(seed, n):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    bad = {"en": ["idiotic", "scummy"], "de": ["mistkerl", "dummkopf"]}
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        toxic = int(rng.random() < 0.15)
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad[lang]) + rng.choice(["", ",", "."]))
        rows.append((i, " ".join(words), lang, toxic))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(1, 900)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows if r[0] < 500], "doc_id long, toxic int")
    chain = train_on(docs, labels, label_categories(labels, docs))
    assert chain.categories[-1] == "toxic" and set(chain.categories[:-1]) == {"toxic_en", "toxic_de"}
    assert len(chain.models[2].extra) == 2
    found = {r["doc_id"]: r["toxic"] for r in toxicity(docs, chain).collect()}
    assert sum(found[r[0]] == bool(r[3]) for r in rows if r[0] >= 500) >= 395


def test_later_models_use_earlier_probabilities():
    rng = np.random.default_rng(2)
    texts = [np.unique(rng.integers(0, 40, 6).astype(np.uint32)) for _ in range(300)]
    first = np.array([int(1 in t) for t in texts])
    chain = train(texts, np.column_stack([first, first]), ["a", "b"])
    assert chain.models[1].extra[0] > 0
    rows = chain.rows(np.concatenate(texts), np.array([len(t) for t in texts]))
    assert ((chain.predict(rows)[:, 1] > chain.threshold) == first).mean() > 0.99


def newton_brute(x, y):
    """Penalised logistic regression with the last column as the bias, by dense Newton steps to the end."""
    penalty = np.append(np.ones(x.shape[1] - 1), 1e-6)
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T * (p * (1 - p)) @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
    return w


def test_chain_like_brute_force(spark):
    """Models, probabilities and decisions against dense Newton steps and plain sums, on all rows."""
    rows = corpus(5, 260)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows if r[0] < 200], "doc_id long, toxic int")
    chain = train_on(docs, labels, label_categories(labels, docs))
    texts = [np.unique(features([r[1]])[0]) for r in rows]
    dense = np.array([np.isin(chain.known, t) for t in texts], float)
    earlier = np.zeros((len(rows), 0))
    for model in chain.models:
        score_ = [sum(w for w, x in zip(model.weight, row) if x) + float(np.dot(model.extra, e)) + model.bias for row, e in zip(dense, earlier)]
        earlier = np.column_stack([earlier, 1 / (1 + np.exp(-np.array(score_)))])
    found = {r["row"]["doc_id"]: r["probabilities"] for r in score(docs, chain).collect()}
    assert np.allclose([found[r[0]] for r in rows], earlier, atol=1e-9)
    assert {r["doc_id"]: r["toxic"] for r in toxicity(docs, chain).collect()} == {r[0]: p >= chain.threshold for r, p in zip(rows, earlier[:, -1])}

    rng = np.random.default_rng(4)
    x, before = (rng.random((120, 30)) < 0.2).astype(float), rng.random((120, 2))
    y = (x[:, 3] + x[:, 7] + before[:, 1] + 0.5 * rng.normal(size=120) > 1).astype(float)
    model = fit(Rows(*np.nonzero(x), x.shape), before, y)
    exact = newton_brute(np.column_stack([x, before, np.ones(120)]), y)
    assert np.allclose([*model.weight, *model.extra, model.bias], exact, atol=1e-3)


def test_fit_of_one_class():
    rows = Rows(np.zeros(0, int), np.zeros(0, int), (3, 0))
    assert (fit(rows, np.zeros((3, 0)), np.zeros(3)).predict(rows, np.zeros((3, 0))) < 1e-6).all()


def test_odd_rows_and_no_labels(spark):
    rows = [(1, None, None, "x"), (2, "", "en", "x"), (None, "a b", "en", "x"), (2, "a b", "en", "x"), (3, "long " * 50_000, "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, row string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    chain = train_on(docs, none, label_categories(none, docs))
    found = toxicity(docs, chain).collect()
    assert len(found) == 5 and not any(r["toxic"] for r in found)
    some = spark.createDataFrame([(1, 1), (2, 1), (2, None), (None, 1), (9, 0)], "doc_id long, toxic int")
    assert score(docs, train_on(docs, some, label_categories(some, docs))).count() == 5
    assert toxicity(docs.limit(0), chain).count() == 0


def test_features_ignore_case_and_signs():
    (a, n), (b, m) = features(["Idiot, you!"]), features(["idiot you"])
    assert np.array_equal(a, b) and n.tolist() == m.tolist() == [4]


# -- nearest neighbours -----------------------------------------------------------------------------------------------


def vectors(seed, n, width=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, width))
    x = centres[rng.integers(0, 8, n)] + 0.3 * rng.normal(size=(n, width))
    return (x * rng.uniform(0.2, 2, (n, 1))).astype(np.float32)


def brute(x, ids, asked, k):
    out = []
    for q in asked:
        a = x[ids.index(q)].astype(float)
        scored = sorted(((-float(np.dot(a, x[j].astype(float))), ids[j]) for j in range(len(ids)) if ids[j] != q))
        out += [(q, r + 1, v, -s) for r, (s, v) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("relax,least", [(1.0, 1.0), (1.25, 0.9)])
def test_tree_recall(relax, least):
    x = vectors(3, 4000).astype(float)
    square = (x**2).sum(1)
    points = np.column_stack([x, np.sqrt(square.max() - square)])
    queries = np.column_stack([x[:200], np.zeros(200)])
    rows, away = VpTree(points).search(queries, 20, relax)
    exact = np.argsort(-x[:200] @ x.T, axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(rows.tolist(), exact.tolist())]) >= least


def test_search_like_brute_force(spark):
    x = vectors(4, 300)
    x[50:120] = x[7]  # a common vector
    ids = [3 * k for k in range(300)]
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in zip(ids, x)], "vec_id long, embedding array<float>, score string").repartition(3)
    found = sorted(tuple(r) for r in nearest(df, df.where("vec_id % 20 = 0"), k=20).collect())
    expected = sorted(brute(x, ids, [i for i in ids if i % 20 == 0], 20))
    assert [r[:3] for r in found] == [r[:3] for r in expected]
    assert np.allclose([r[3] for r in found], [r[3] for r in expected])


@pytest.mark.parametrize("relax, least", [(1.0, 1.0), (1.25, 0.9)])
def test_search_of_many_cells_and_deep_trees(spark, relax, least):
    """20,000 vectors in some 19 cells, shards with inner nodes, cells of several shards, and shards planted for parts of the queries."""
    x = vectors(6, 20_000)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    found = nearest(df, df.where("vec_id % 100 = 0"), k=20, relax=relax, shard_rows=1500, cell_rows=1024, query_rows=30).toPandas()
    y = x.astype(float)
    products = y[::100] @ y.T
    products[np.arange(200), np.arange(0, 20_000, 100)] = -np.inf
    exact = np.argsort(-products, axis=1, kind="stable")[:, :20]
    own = {q: g.sort_values("rank") for q, g in found.groupby("query_id")}
    assert len(found) == 4000 and all(own[100 * q]["rank"].tolist() == list(range(1, 21)) for q in range(200))
    recall = np.mean([len(set(own[100 * q]["vec_id"]) & set(exact[q].tolist())) / 20 for q in range(200)])
    assert recall >= least
    assert all(np.allclose(own[100 * q]["score"], [products[q, v] for v in own[100 * q]["vec_id"]]) for q in range(200))


def test_vectors_that_take_no_part(spark):
    good = [1.0, 2.0]
    rows = [(0, good), (20, [2.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, [1.0]), (None, good), (7, good), (7, [3.0, 3.0]), (40, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = sorted(tuple(r) for r in nearest(df, df.where("vec_id % 20 = 0"), k=5).collect())
    assert found == [(0, 1, 7, 9.0), (0, 2, 20, 4.0), (20, 1, 7, 9.0), (20, 2, 0, 4.0)]
    assert nearest(df.limit(0), df, k=5).count() == 0 and nearest(df, df.limit(0), k=5).count() == 0
