"""The heavy-light join against all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillwork.llm import jaccard_join
from tillwork.llm.common import column_bytes
from tillwork.llm.jaccard_join import jaccard_components, keep_one_of_each, overlap, subset_sizes


def brute(rows, k=4, percent=85):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(fold))
        sets.append({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    return sorted((doc, len(sets[i]), min(groups[find(i)])) for i, (doc, _) in enumerate(rows))


def corpus(seed, n=160):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(vocab) for _ in range(40)]
    bases = [[rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 3, 5, 8, 12, 16, 20, 40, 90, 200]))] for _ in range(24)]
    rows = []
    for doc in range(n):
        words = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
            at = rnd.randrange(len(words) + 1)
            words[at:at + rnd.choice([0, 1])] = [rnd.choice(vocab)]
        if rnd.random() < .2:
            words += passage
        text = " ".join(words)
        rows.append((doc, rnd.choice([text, text.upper(), text.replace(" ", "\n", 1)])))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "É é"), (n + 4, "É É")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(spark, seed, monkeypatch):
    rows = corpus(seed)
    if seed == 2:     # everything small goes the way of subsets
        monkeypatch.setattr(jaccard_join, "_boundary", lambda *a: 20)
    if seed == 3:     # nothing does
        monkeypatch.setattr(jaccard_join, "_boundary", lambda *a: 0)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(docs).collect())) == brute(rows)


def test_group_of_near_copies_apart_from_the_pivot(spark):
    """Neighbours in a chain link, its ends do not, and all lists are shared."""
    words = [f"w{i}" for i in range(120)]
    rows = []
    for doc in range(40):
        own = list(words)
        for j in range(doc):
            own[3 * j] = f"x{j}"
        rows.append((doc, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(docs).collect())) == brute(rows)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(empty).collect() == []
    rows = [(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (None, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, root string, size int")
    got = sorted(map(str, jaccard_components(docs).collect()))
    assert len(got) == 4 and sum("component_id=3" in g for g in got) == 3
    kept = keep_one_of_each(docs)
    assert kept.columns == ["doc_id", "text", "root", "size"]
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "t1 t2 t3 t4")]
    assert sorted(map(tuple, jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == [
        (1, 59_997, 1), (2, 59_998, 1), (3, 1, 3)]


def test_many_buckets_give_the_same(spark, monkeypatch):
    rows = corpus(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "BUCKET_TOKENS", 90)
    assert sorted(map(tuple, jaccard_components(docs).collect())) == brute(rows)


def test_sketch_never_exceeds_the_difference_and_spares_whole_sets(spark):
    rng = np.random.default_rng(5)
    for size in (1, 30, 400, 20_000):
        common, a, b = (rng.integers(1, 1 << 62, n).astype(np.uint64) for n in (size, size // 3, size // 5))
        x, y = (np.frombuffer(jaccard_join._sketch(np.concatenate([common, own])), np.uint64) for own in (a, b))
        assert int(np.bitwise_count(x ^ y).sum()) <= len(a) + len(b)
    # Documents of three out of eight passages: every passage is shared, no two selections link.
    words = [[f"p{i}w{j}" for j in range(60)] for i in range(8)]
    texts = [" ".join(sum((words[i] for i in pick), [])) for pick in combinations(range(8), 3)]
    held = spark.createDataFrame([(t,) for t in texts + [texts[0] + " end"]], "text string")
    docs = held.select(F.monotonically_increasing_id().alias("doc_id"), "text")
    numbered = [tuple(r) for r in docs.collect()]
    assert sorted(map(tuple, jaccard_components(docs).collect())) == brute(numbered)
    sets = [jaccard_join.shingle_sets(*column_bytes(pa.array([t])), 4)[0] for t in texts]
    table = spark.createDataFrame([(bytes([i]), len(s), s.tobytes(), len(s), jaccard_join._sketch(s)) for i, s in enumerate(sets)],
                                  "class binary, size long, tokens binary, held long, sketch binary")
    pairs = spark.createDataFrame([(bytes([i]), bytes([j])) for i in range(56) for j in range(i)], "a binary, b binary")
    assert jaccard_join._not_too_different(pairs, table, 85, 100).count() < 10


def test_overlaps():
    for s in range(1, 60):
        for t in range(s, 60):
            o = overlap(s, t, 85, 100)
            assert all((100 * i >= 85 * (s + t - i)) == (i >= o) for i in range(s + 1))
            if o <= s:
                assert o in subset_sizes(s, 85, 100) and o in subset_sizes(t, 85, 100)


def test_rows_are_judged_not_ids(spark):
    long, other = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, long, "x"), (None, long + " end", "x"), (None, "quite another text", "x"), (2, other, "x"), (3, other + " end", "x"), (3, "a text of its own", "x"),
            (4, None, "x"), (4, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone string")
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [rows[0], *rows[2:4], *rows[5:]]))
