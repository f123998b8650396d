from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch
from tidewater.llm.components import components
from tidewater.llm.exact_dedup import exact_duplicates
from tidewater.llm.line_dedup import line_digests
from tidewater.llm.runs import LevelledRuns
from tidewater.llm.simhash import bucket_keys, keep_one_of_each, links, near_duplicates
from tidewater.llm.similar import keep_one_of_similar, set_keys, shingles, similar
from tidewater.llm.suffix_dedup import BlindTrie, common_prefix, deep_shallow, drop_repeats, multikey_quicksort, repeat_digests
from tidewater.llm.window_dedup import drop_windows, window_digests

SPACE = " \t\n\x0b\x0c\r"
#: Columns whose names the operators use themselves.
CLASHING = "k1 string, k2 string, row string, body string, spans string, anchor string, fp string, id string, part string, h1 string, _ string, found string, node string, `a.b` string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, *["x"] * 14) for i, t in rows], "doc_id long, text string, " + CLASHING).repartition(parts)


def as_set(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


ODD = [(1, None), (2, ""), (3, " \n "), (4, "same"), (4, "same"), (4, "other"), (None, "same"), (None, None), (5, "a\nb\na"), (6, "long " * 20_000)]


# -- exact ------------------------------------------------------------------------------------------------------------


def exact_brute(rows, keep):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max(known) if keep == "largest" else min(known)) if known else None
        out += [(i, best, len(ids), sha(text)) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_groups(spark, keep):
    rng = random.Random(4)
    rows = ODD + [(100 + i, rng.choice(["hot copy"] * 3 + ["start " * 40 + str(rng.randint(0, 40))])) for i in range(600)]
    rng.shuffle(rows)
    found = exact_duplicates(frame(spark, rows), keep=keep).collect()
    assert sorted(((r[0], r[1], r[2], r[4]) for r in found), key=str) == exact_brute(rows, keep)
    kept = defaultdict(list)
    for r in found:
        if r["kept"]:
            kept[r["text_sha256"]].append(r)
    assert set(kept) == {sha(t or "") for _, t in rows} and all(len(v) == 1 for v in kept.values())
    if keep == "largest":
        assert all(v[0]["doc_id"] == v[0]["keep_id"] for v in kept.values())


def test_exact_empty_and_normalised(spark):
    df = frame(spark, [(1, " A "), (2, "a")])
    assert exact_duplicates(df.limit(0)).count() == 0
    assert {r["group_size"] for r in exact_duplicates(df, normalise=lambda c: F.lower(F.trim(c))).collect()} == {2}


# -- lines ------------------------------------------------------------------------------------------------------------


def lines_brute(rows, least, chars=1):
    key = lambda x: x.strip(SPACE).translate({c: c + 32 for c in range(65, 91)})
    seen = defaultdict(set)
    for n, (_, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            seen[key(line)].add(n)
    gone = {k for k, v in seen.items() if len(k) >= chars and len(v) >= least}
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if key(x) not in gone]
        out.append((i, len(parts), len(parts) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


def test_shared_lines(spark):
    rng = random.Random(5)
    pool = ["License X", " license x\t", "ÄB", "äb", "one", "", "two ", "TWO", "\x0bthree\x0c"] + [f"rare {k}" for k in range(30)]
    rows = ODD + [(100 + i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 8)))) for i in range(80)]
    assert as_set(line_digests(frame(spark, rows), least_docs=10)) == lines_brute(rows, 10)
    assert as_set(line_digests(frame(spark, rows), least_docs=3, batches=6)) == lines_brute(rows, 3)
    assert as_set(line_digests(frame(spark, rows), least_docs=3, broadcast_rows=0)) == lines_brute(rows, 3)  # both sides sorted
    assert line_digests(frame(spark, rows).limit(0)).count() == 0


def test_lines_of_later_days(spark, tmp_path):
    """Day two goes through the runs of day one alone, and what it brings to the limit goes from then on."""
    index = "file://" + str(tmp_path / "lines")
    days = [[(10 * d + k, f"daily {d}\nheader\nown {d} {k}\nrare {k}") for k in range(4)] for d in range(4)]
    left = []
    for day in days:
        found = line_digests(frame(spark, day), least_docs=6, batches=2, index=index).collect()
        left.append({r["doc_id"]: (r["n_dropped"], r["kept_sha256"]) for r in found})
    assert left[0] == {i: (0, sha(t)) for i, t in days[0]}
    for d in (1, 2, 3):  # 8, 12 and 16 documents have the header by then
        assert left[d] == {i: (1, sha(t.replace("header\n", ""))) for i, t in days[d]}
    again = LevelledRuns(spark, index, ["h1", "h2"])
    assert len(again.names()) < 8 and any(level > 0 for level, _ in again.names())
    total = again._read([n for _, n in again.names()]).groupBy("h1", "h2").agg(F.max("total").alias("n"))
    assert {r["n"] for r in total.collect()} == {16, 4, 1}


def test_runs_carry_totals(spark, tmp_path):
    runs, count = LevelledRuns(spark, "file://" + str(tmp_path / "runs"), ["k"]), Counter()
    rng = random.Random(3)
    for _ in range(8):
        batch = Counter(rng.choices("abcdefgh", k=5))
        count.update(batch)
        run = runs.add(spark.createDataFrame(list(batch.items()), "k string, n long"))
        assert {r["k"]: r["total"] for r in run.collect()} == {k: count[k] for k in batch}
        runs.compact()
        assert all(len([1 for at, _ in runs.names() if at == level]) < 3 for level, _ in runs.names())


# -- SimHash ----------------------------------------------------------------------------------------------------------


def simhash_brute(text, words=3):
    parts = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
    if not parts:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(parts[k : k + words]), 42) for k in range(max(1, len(parts) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def grouped(items, near):
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(items)):
        for b in range(a):
            if near(items[a], items[b]):
                parent[find(a)] = find(b)
    return [find(k) for k in range(len(items))]


def test_near_duplicates_like_brute_force(spark):
    rng = random.Random(6)
    vocabulary = ["w%d" % k for k in range(50)]
    bases = [[rng.choice(vocabulary) for _ in range(300)] for _ in range(6)]
    rows = list(ODD[:9])
    for i in range(150):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 1, 2, 40])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary).upper()
        rows.append((100 + i, rng.choice([" ", "\n"]).join(words)))
    fps = [simhash_brute(t) for _, t in rows]
    roots = grouped(fps, lambda a, b: bin(a ^ b).count("1") <= 3)
    least = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    expected = sorted(((i, f"{f:016x}", least.get(r)) for (i, _), f, r in zip(rows, fps, roots)), key=str)
    df = frame(spark, rows)
    assert as_set(near_duplicates(df)) == expected
    stay = [r["row"] for r in keep_one_of_each(df).collect()]
    assert len(stay) == len(set(roots)) and stay[0].asDict().keys() >= {"doc_id", "k1", "row"}
    assert near_duplicates(df.limit(0)).count() == 0 and keep_one_of_each(df.limit(0)).count() == 0


def test_close_fingerprints_share_a_key():
    rng = np.random.default_rng(7)
    a = rng.integers(0, 1 << 64, 1500, dtype=np.uint64)
    b = a.copy()
    for k in range(len(b)):
        for bit in rng.choice(64, k % 4, replace=False):
            b[k] ^= np.uint64(1) << np.uint64(bit)
    keys = []
    for x in (a, b):
        own = defaultdict(set)
        for row, key in zip(*bucket_keys(x)):
            own[int(row)].add(int(key))
        keys.append(own)
    assert all(keys[0][k] & keys[1][k] for k in range(len(a)))


def test_large_buckets_lose_no_component(spark, monkeypatch):
    import tidewater.llm.simhash as module

    rng = np.random.default_rng(8)
    centre = rng.integers(0, 1 << 64, 3, dtype=np.uint64)
    fps = set()
    for c in centre:
        for _ in range(400):
            x = int(c)
            for bit in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    order = np.array(fps, np.uint64)
    roots = grouped(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    for large in (2048, 16):
        old, module.LARGE = module.LARGE, large
        try:
            a, b = module._large_group(order, 3)
        finally:
            module.LARGE = old
        pairs = {frozenset(p) for p in zip(a.tolist(), b.tolist())}
        again = grouped(fps, lambda x, y: frozenset((x, y)) in pairs)
        assert len(set(again)) == len(set(roots)) and len(set(zip(again, roots))) == len(set(roots))
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    for large in (2048, 16):  # dealt out by windows
        monkeypatch.setattr(module, "LARGE", large)
        pairs = {frozenset(np.array([r["a"], r["b"]]).view(np.uint64).tolist()) for r in links(df, 3, 4).collect()}
        again = grouped(fps, lambda x, y: frozenset((x, y)) in pairs)
        assert len(set(again)) == len(set(roots)) and len(set(zip(again, roots))) == len(set(roots))


@pytest.mark.parametrize("distance", [4, 5])
def test_every_pair_at_the_distance_is_linked(spark, distance):
    import tidewater.llm.simhash as module

    rng = np.random.default_rng(distance)
    fps = rng.integers(0, 1 << 64, 3000, np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, distance, replace=False)) for _ in fps], np.uint64)
    (left, a), (right, b) = bucket_keys(fps, distance), bucket_keys(fps ^ flips, distance)
    shared = set(zip(left.tolist(), a.tolist())) & set(zip(right.tolist(), b.tolist()))
    assert {row for row, _ in shared} == set(range(len(fps)))
    some = np.unique(np.concatenate([fps[:300], (fps ^ flips)[:300]]))
    df = spark.createDataFrame([(int(f),) for f in some.view(np.int64)], "fp long")
    found = {frozenset(np.array([r["a"], r["b"]]).view(np.uint64).tolist()) for r in links(df, distance, 4).collect()}
    brute = {frozenset((int(x), int(y))) for k, x in enumerate(some) for y in some[k + 1 :] if int(x ^ y).bit_count() <= distance}
    assert found == brute and len(brute) >= 300
    old, module.LARGE = module.LARGE, 8  # pairs of one large bucket
    try:
        x, y = module._large_group(some, distance)
    finally:
        module.LARGE = old
    assert {frozenset(p) for p in zip(x.tolist(), y.tolist())} == brute


def test_pipeline_distance_links_at_least_three_bits(spark):
    words = [f"w{k}" for k in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:200], "changed", *words[201:]])), (3, " ".join(reversed(words))), (4, " ".join(words[:200]))]
    stay = {r["row"]["doc_id"] for r in keep_one_of_each(frame(spark, rows), words=2, distance=5).collect()}
    assert stay == {1, 3, 4}


def jaccard_brute(a, b):
    a, b = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in (a.lower().split(), b.lower().split()))
    return not a | b or 10 * len(a & b) >= 8 * len(a | b)


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("copies", [3, 40])  # 40: large buckets
def test_similar_texts_like_brute_force(spark, copies):
    rng = random.Random(copies)
    rows = ODD + [(7, "A b c d e f g h"), (8, "a B c  d e f g h i"), (9, "a b c d e f g"), (20, "a b c d")]
    for base in range(6):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([9, 30, 60, 120, 250]))]
        rows += [(100 * (base + 1) + k, changed(rng, words, rng.randrange(0, max(2, len(words) // 25)))) for k in range(copies)]
    rng.shuffle(rows)
    roots = grouped([t or "" for _, t in rows], jaccard_brute)
    groups = defaultdict(list)
    for (i, _), r in zip(rows, roots):
        groups[r].append(i)
    least = [min((i for i in g if i is not None), default=None) for g in groups.values()]
    found = [r["row"]["doc_id"] for r in keep_one_of_similar(frame(spark, rows)).collect()]
    assert sorted(found, key=str) == sorted(least, key=str)
    assert keep_one_of_similar(frame(spark, rows).limit(0)).count() == 0


def test_similar_sets_share_a_key():
    rng = np.random.default_rng(5)
    for size in [*range(4, 60), 99, 100, 101, 350, 2000]:
        for _ in range(10):
            every = rng.integers(0, 1 << 64, 2 * size, np.uint64)
            drop = rng.integers(0, size // 5 + 1)  # a part of the others goes, new ones come
            add = (size * 5 - 5 * drop) // 4 - size
            a, b = np.unique(every[:size]), np.unique(np.append(every[drop:size], every[size : size + max(0, add)]))
            (left, x), (right, y) = set_keys(a), set_keys(b)
            own = [np.intersect1d(left[x == 0], right), np.intersect1d(left, right[y == 0])]
            assert not similar(a, b) or np.concatenate(own).size


def test_pipeline_stage_goes_by_similarity_not_by_fingerprints(spark):
    from corpus_pipeline import drop_near_duplicates

    rng, near, far, rows = random.Random(2), [], [], []
    while len(near) < 5 or len(far) < 5:
        words = [f"w{rng.randrange(60)}" for _ in range(120)]
        a, b = " ".join(words), changed(rng, words, rng.choice([3, 4, 5, 6]))
        bits = (simhash_brute(a, 2) ^ simhash_brute(b, 2)).bit_count()
        alike = jaccard_brute(a, b)
        if alike and bits > 5 and len(near) < 5:
            near.append((a, b))
        elif not alike and bits <= 5 and len(far) < 5:
            far.append((a, b))
    for k, (a, b) in enumerate(near + far):
        rows += [(10 * k, a), (10 * k + 1, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    stay = {r["doc_id"] for r in drop_near_duplicates(spark, df, "").collect()}
    assert stay == {10 * k for k in range(10)} | {10 * k + 1 for k in range(5, 10)}


def test_fingerprints_connect_similar_texts_first(spark, monkeypatch):
    import tidewater.llm.similar as module

    def nothing(batches):
        for _ in batches:
            pass
        yield from ()

    words = [f"w{k}" for k in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:150], "new", *words[151:]])), (3, " ".join(reversed(words)))]
    monkeypatch.setattr(module, "_met", nothing)  # the exact search for what fingerprints miss
    assert {r["row"]["doc_id"] for r in keep_one_of_similar(frame(spark, rows)).collect()} == {1, 3}


def test_edges_of_one_task_need_no_round(spark, monkeypatch):
    names, write = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name, *more: (names.append(name), write(self, df, name, *more))[1])
    found = components(spark.createDataFrame([(k, k + 1) for k in range(300)], "a long, b long"), Scratch(spark, "test"))
    assert {(r["node"], r["root"]) for r in found.collect()} == {(k, 0) for k in range(301)} and found.count() == 301
    assert names == ["edges-0"]


def test_components_over_several_tasks(spark, monkeypatch):
    import tidewater.llm.components as module

    monkeypatch.setattr(module, "_oriented", lambda edges, own=module._oriented: own(edges).repartition(3))
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)]
    nodes = sorted({n for e in edges if e[0] != e[1] for n in e})
    linked = {frozenset(e) for e in edges}
    roots = grouped(nodes, lambda a, b: frozenset((a, b)) in linked)
    found = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()
    least = {}
    for n, r in zip(nodes, roots):
        least[r] = min(n, least.get(r, n))
    assert sorted((r["node"], r["root"]) for r in found) == [(n, least[r]) for n, r in zip(nodes, roots)]


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r["node"]: r["root"] for r in components(df, Scratch(spark, "test")).collect()}
    assert found == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(30)}, 200: 200, 201: 200}
    assert components(df.limit(0), Scratch(spark, "test")).count() == 0


# -- suffix sorting ---------------------------------------------------------------------------------------------------


def test_deep_shallow_order_and_prefixes():
    rng = random.Random(9)
    for _ in range(150):
        strings = [rng.choice([b"", b"x" * 16, b"x" * 40, b"\0" * 3]) + bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 1, 5, 17, 40]))) for _ in range(rng.randint(1, 50))]
        group = np.sort(np.array([rng.randint(0, 3) for _ in strings]))
        order, prefix = deep_shallow(strings, group)
        assert [(group[k], strings[k]) for k in order] == sorted(zip(group, strings))
        for at in range(1, len(order)):
            a, b = order[at - 1], order[at]
            assert prefix[at] == (-1 if group[a] != group[b] else common_prefix(strings[a], strings[b]))


def test_multikey_quicksort_like_sorting():
    rng = np.random.default_rng(3)
    for n in [0, 1, 2, 3, 50, 400]:
        symbols = rng.integers(0, 4, (n, 3), np.uint64) << np.uint64(61)
        group = np.sort(rng.integers(0, 5, n))
        order, tied = multikey_quicksort(symbols, group)
        rows = [(int(group[k]), *symbols[k].tolist()) for k in order]
        assert rows == sorted(rows) and sorted(order.tolist()) == list(range(n))
        assert tied.tolist() == [k > 0 and rows[k] == rows[k - 1] for k in range(n)]


def test_blind_trie():
    strings = [b"abc", b"abd", b"ab", b"", b"abc", b"b", b"abcdef"]
    trie = BlindTrie()
    for k in range(len(strings)):
        trie.insert(k, strings)
    assert [strings[k] for k, _ in trie.sorted(strings)] == sorted(strings)


def repeats_brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = defaultdict(int)
    for _, b in texts:
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]] += 1
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 2, int)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s + 1 : s + 1 + length] = 1
        runs = int((np.diff(gone) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, sha(bytes(np.frombuffer(b, np.uint8)[gone[1 : len(b) + 1] == 0]))))
    return sorted(out, key=str)


def passages(seed, units, join, cuts):
    rng = random.Random(seed)
    base = [rng.choice(units) for _ in range(3000)]
    rows = []
    for i in range(50):
        text = []
        for _ in range(rng.randint(0, 5)):
            at = rng.randint(0, 2700)
            text += base[at : at + rng.choice(cuts)] + [rng.choice("xyz") for _ in range(rng.choice([0, 1, 2, 50]))]
        rows.append((i, join(rng).join(text)))
    return rows + [(60, None), (61, ""), (None, rows[3][1]), (5, "same"), (5, rows[5][1]), (7, "aé" * 300), (8, "z" * 1000)]


def test_repeated_strings_like_brute_force(spark):
    rows = passages(10, "abcdé ", lambda r: "", [10, 150, 199, 200, 201, 260, 300, 700])
    df = frame(spark, rows)
    assert as_set(repeat_digests(df)) == repeats_brute(rows, 200)
    assert as_set(repeat_digests(df, length=80)) == repeats_brute(rows, 80)
    assert repeat_digests(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [1, 3])
def test_hot_anchors_like_brute_force(spark, monkeypatch, hot):
    import tidewater.llm.repeats as module

    monkeypatch.setattr(module, "HOT", hot)
    rows = passages(12, "abcdé ", lambda r: "", [150, 200, 201, 260, 700])
    assert as_set(repeat_digests(frame(spark, rows))) == repeats_brute(rows, 200)
    rows = passages(13, "a b c d ab é".split(), lambda r: " ", [34, 35, 36, 60, 200])
    assert as_set(window_digests(frame(spark, rows))) == windows_brute(rows, 35)


def test_kept_text_has_whole_characters(spark):
    rows = [(1, "é" * 150 + "x"), (2, "y" + "é" * 150 + "ê"), (3, None)]
    found = {r["row"]["doc_id"]: r["kept_text"] for r in drop_repeats(frame(spark, rows)).collect()}
    assert found == {1: "x", 2: "yê", 3: ""}


def test_long_texts_are_cut_into_overlapping_chunks(monkeypatch):
    import tidewater.llm.repeats as module
    from tidewater.llm.suffix_dedup import find_anchors

    text = bytes(random.Random(1).choice(b"abcd") for _ in range(5000))
    whole = [np.concatenate(x) for x in zip(*find_anchors([text], 200))]
    monkeypatch.setattr(module, "CHUNK", 1024)
    cut = [np.concatenate(x) for x in zip(*find_anchors([text], 200))]
    covered = lambda place: {(p >> 16) + k for p in place.tolist() for k in range((p & 255) + 1)}
    assert covered(whole[2]) == covered(cut[2]) == set(range(4801)) and set(whole[1]) == set(cut[1])


# -- windows of words -------------------------------------------------------------------------------------------------


def windows_brute(rows, length):
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    seen = defaultdict(int)
    for _, w in texts:
        for s in range(len(w) - length + 1):
            seen[tuple(w[s : s + length])] += 1
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            if seen[tuple(w[s : s + length])] > 1:
                gone[s : s + length] = [True] * length
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out, key=str)


def test_repeated_windows_like_brute_force(spark, tmp_path):
    rows = passages(11, "a b c d ab é".split(), lambda r: r.choice([" ", "\n", " \t "]), [5, 30, 34, 35, 36, 60, 200])
    df = frame(spark, rows)
    assert as_set(window_digests(df)) == windows_brute(rows, 35)
    assert as_set(window_digests(df, length=12, batches=5)) == windows_brute(rows, 12)
    assert window_digests(df.limit(0)).count() == 0
    index = "file://" + str(tmp_path / "windows")  # in three days, each of which knows of the earlier ones
    days = [rows[k::3] for k in range(3)]
    for k, day in enumerate(days):
        known = [x for d in days[: k + 1] for x in d]
        expected = Counter(windows_brute(known, 35))
        found = Counter(as_set(window_digests(frame(spark, day), batches=2, index=index)))
        assert sum(found.values()) == len(day) and not found - expected
    assert drop_windows(df).columns == ["row", "n_words", "n_removed", "kept_text"]


def test_word_hashes_of_long_texts(monkeypatch):
    import tidewater.llm.words as module

    text = (b"alpha beta\tgamma " * 100) + b"x" * 700 + b" tail"
    (whole,), n = module.word_hashes([text, b"", b"beta"], module.SPACES)
    assert n.tolist() == [302, 0, 1] and whole[1] == whole[-1] and len(set(whole.tolist())) == 5
    monkeypatch.setattr(module, "CHUNK", 600)
    (cut,), n = module.word_hashes([text, b"", b"beta"], module.SPACES)
    assert n.tolist() == [302, 0, 1] and np.array_equal(np.delete(cut, 300), np.delete(whole, 300))
