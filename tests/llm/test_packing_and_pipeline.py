from __future__ import annotations

import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidewater.llm.common import Scratch
from tidewater.llm.packing import configurations, pack_documents, pack_histogram

WORDS = P.path("word_bpe_49k.json")


def checked(histogram, capacity):
    packing = pack_histogram(histogram, capacity)
    seen, used = Counter(), defaultdict(list)
    for length, _, many, first, offset in packing.slots:
        seen[length] += many
        for k in range(many):
            used[first + k].append((offset, length))
    assert seen == Counter({k: v for k, v in histogram.items() if v})
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(used) == packing.sequences
    return packing.sequences, -(-sum(k * v for k, v in histogram.items()) // capacity)


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_valid_and_tight(seed):
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 4097, 3000), np.minimum(4096, rng.lognormal(6.3, 1, 20_000).astype(int) + 1), rng.integers(1000, 2500, 2000), np.minimum(4096, rng.lognormal(6.8, 1, 9000).astype(int) + 1)][seed]
    n, bound = checked(dict(Counter(lengths.tolist())), 4096)
    assert n <= bound * 1.03 + 1


def test_small_packings():
    assert checked({}, 10) == (0, 0)
    assert checked({10: 3, 1: 5}, 10)[0] == 4
    assert checked({6: 4, 4: 4}, 10)[0] == 4
    assert checked({7: 1}, 10)[0] == 1
    assert configurations([], [], 10) == []


def ids_of(text):
    return Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids + [1]


def assert_packed(found, rows, capacity):
    expected = []
    for i, t in rows:
        ids = ids_of(t)
        for k in range(0, len(ids), capacity):
            some = ids[k : k + capacity]
            expected.append((i, k // capacity, k, len(some), zlib.crc32(np.array(some, "<u4").tobytes())))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found), key=str) == sorted(expected, key=str)
    places = defaultdict(list)
    for r in found:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity


def test_documents_are_packed(spark):
    rng = random.Random(1)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "same"), (4, "same"), (None, "same"), (5, "word " * 700)]
    rows += [(10 + i, " ".join(rng.choice(["river", "stone", "zzyzx"]) for _ in range(rng.choice([3, 3, 3, 40, 90])))) for i in range(120)]
    df = spark.createDataFrame([(i, t, "x", "x") for i, t in rows], "doc_id long, text string, length string, bucket string").repartition(4)
    assert_packed(pack_documents(df, WORDS, capacity=128).collect(), rows, 128)
    assert pack_documents(df.limit(0), WORDS).count() == 0


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
def test_pipeline_stage_by_stage(spark):
    from tests.llm.test_dedup import grouped, jaccard_brute, lines_brute, repeats_brute, sha

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    scratch, names = Scratch(spark, "test"), [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    inputs, outputs, current = {}, {}, docs
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = [(r["doc_id"], r["text"]) for r in current.collect()]
        current = scratch.write(stage(spark, current, DATA), name)
        outputs[name] = current.collect()
        if name != "best_fit_packing":
            assert current.columns == docs.columns and current.where(F.col("n_chars") != F.length("text")).count() == 0
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in outputs["toxicity"]}
    assert sum(bool(t) == (i not in kept) for i, t in labels.items()) >= 0.95 * len(labels)

    lines = {x[0]: x[3] for x in lines_brute(inputs["line_dedup"], 10)}
    assert {r["doc_id"]: sha(r["text"]) for r in outputs["line_dedup"]} == lines
    given = inputs["simhash_near_dedup"]
    least = {}
    for (i, _), r in zip(given, grouped([t or "" for _, t in given], jaccard_brute)):
        least[r] = min(i, least.get(r, i))
    assert {r["doc_id"] for r in outputs["simhash_near_dedup"]} == set(least.values())
    removed = {x[0]: x[1] - x[2] for x in repeats_brute(inputs["suffix_array_dedup"], 200)}
    for r in outputs["suffix_array_dedup"]:  # split characters stay whole
        assert 0 <= len(r["text"].encode()) - removed[r["doc_id"]] < 200
    assert_packed(outputs["best_fit_packing"], inputs["best_fit_packing"], 4096)


def test_pipeline_of_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b", "en", "s", 3), (3, "a b", "en", "s", 3), (None, "c d", "en", None, 3), (4, "e\n" * 5000, "de", "s", 10000)]
    for name, data in (("some", rows), ("none", [])):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(3, 0, 0)] if data else [], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        found = corpus_pipeline.run(spark, str(tmp_path / name))
        assert (found.count() > 0) == bool(data)
