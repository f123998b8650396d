from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewater.llm.byte_bpe import byte_bpe, decode_documents, encode_documents, round_trip
from tidewater.llm.token_counts import count_tokens, cut_at_space, word_bpe

WORDS = P.path("word_bpe_49k.json")
RANKS = P.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "aa", "the", "'s", " the", "É", "Σ", "ΑΣ", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "<|endoftext|>", "<|startoftext|>", "<|", "1", "23", "½", "²", "漢字", "😀", "ß", "İ", "_", "...", "\x00", "ﬁ", "́", "er", "tion", "xq"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_word_tokens_equal_the_library(library):
    rng, bpe = random.Random(2), word_bpe(WORDS)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert bpe.counts(texts) == [len(x) for x in expected]
    assert [x.tolist() for x in bpe.ids(texts)] == expected


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_any_text(library, encoding, text):
    assert next(word_bpe(WORDS).ids([text])).tolist() == library.encode(text, add_special_tokens=False).ids
    assert byte_bpe(RANKS, P.PATTERN).ids(text).tolist() == encoding.encode_ordinary(text)


def test_pairs_that_overlap(library):
    texts = ["a" * n for n in range(1, 60)] + ["ab" * 30, "aab" * 20]
    assert word_bpe(WORDS).counts(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_pieces_join_up():
    text = "ab cd\nef" * 50
    for size in (1, 7, 1000):
        pieces = list(cut_at_space(text, size))
        assert "".join(pieces) == text
    assert list(cut_at_space("", 5)) == [""]


def test_byte_tokens_equal_the_library(encoding):
    rng, bpe = random.Random(3), byte_bpe(RANKS, P.PATTERN)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    texts += ["".join(rng.choice("etaoinshr") for _ in range(200)) for _ in range(200)] + ["a" * 5000, "=" * 3000]
    for t in texts:
        ids = bpe.ids(t)
        assert ids.tolist() == encoding.encode_ordinary(t)
        assert bpe.decode(ids) == t.encode()


DOCS = [(1, "Hello there, world!"), (None, "x"), (2, None), (3, ""), (3, "again <|endoftext|>"), (4, "wörd " * 60_000)]


def test_counts_of_odd_rows(spark, library):
    df = spark.createDataFrame([(i, t, "e") for i, t in DOCS], "doc_id long, text string, n_tokens string")
    found = sorted((tuple(r) for r in count_tokens(df, WORDS).collect()), key=str)
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert found == sorted(((i, len((t or "").encode()), n(t), n(t) > 2048) for i, t in DOCS), key=str)
    assert count_tokens(df.limit(0), WORDS).count() == 0


def test_round_trip_of_odd_rows(spark, encoding):
    df = spark.createDataFrame([(i, t, "e") for i, t in DOCS], "doc_id long, text string, ids string")
    found = sorted((tuple(r) for r in round_trip(df, RANKS, P.PATTERN).collect()), key=str)
    expected = []
    for i, t in DOCS:
        ids = encoding.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert found == sorted(expected, key=str)
    assert round_trip(df.limit(0), RANKS, P.PATTERN).count() == 0
    back = decode_documents(encode_documents(df, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert sorted(bytes(r["bytes"]) for r in back.collect()) == sorted((t or "").encode() for _, t in DOCS)


def test_memory_is_bounded_and_forgets_whole():
    from tidewater.llm.common import Memory

    memory = Memory(10 * (Memory.ENTRY + 4))
    for at in range(0, 40, 4):
        wanted = {f"{k:04}" for k in range(at, at + 4)}
        fresh = memory.missing(wanted)
        memory.known.update((w, len(w)) for w in fresh)
        assert wanted <= memory.known.keys() and len(memory.known) <= 10
    assert memory.missing({"0036"}) == [] and memory.missing({"0000"}) == ["0000"]
    assert sorted(memory.missing({f"{k:04}" for k in range(100, 130)})) == [f"{k:04}" for k in range(100, 130)]  # more than there is room for


def test_scratch_tables_go_when_released(spark):
    from tidewater.llm.common import Scratch, files, release

    kept, gone = Scratch(spark, "kept"), Scratch(spark, "gone")
    for scratch in (kept, gone):
        assert scratch.write(spark.range(3).toDF("id"), "a").count() == 3
        scratch.write(spark.range(3).toDF("id"), "b")
    kept.drop_but("a")
    others = tuple(r for r in Scratch.folders[spark.sparkContext.applicationId] if r != gone.root)
    release(spark, but=others)
    assert files(spark, kept.root).folders() == ["a"] and files(spark, gone.root).folders() == []
    assert gone.root not in Scratch.folders[spark.sparkContext.applicationId]
