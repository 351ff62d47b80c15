"""Chunk recipes against plain equality of texts."""

import hashlib
import random

import numpy as np
import pytest

from tillwork.llm.chunk_dedup import cut_points, drop_exact_duplicates, exact_duplicates


def brute(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(text or "", []).append(doc)
    out = []
    for doc, text in rows:
        own = groups[text or ""]
        known = [d for d in own if d is not None]
        keep = max(known) if known else None
        out.append((doc, keep, len(own), doc == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    texts = ["", "a", "é" * 5000, "x" * 100_000] + ["".join(rnd.choice("abcdefé \n") for _ in range(rnd.choice([3, 300, 4000, 30_000]))) for _ in range(12)]
    texts += [t + "!" for t in texts] + ["!" + t for t in texts]
    rows = [(i, rnd.choice(texts)) for i in range(120)]
    return rows + [(7, rows[3][1]), (7, rows[3][1]), (None, rows[3][1]), (None, "alone"), (500, None), (501, None)]


@pytest.mark.parametrize("digest_bytes", [16, 1])
def test_against_equality(spark, digest_bytes):
    """With digests of one byte nearly all chunks collide, and the result is the same."""
    rows = corpus(digest_bytes)
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, group_size int, digest string")
    assert sorted(map(tuple, exact_duplicates(docs, digest_bytes=digest_bytes).collect()), key=str) == brute(rows)


def test_cuts_depend_on_the_text_alone():
    rnd = np.random.default_rng(1)
    text = rnd.integers(97, 123, 50_000).astype(np.uint8)
    alone = cut_points(text, np.array([0, len(text)]), 8, 64, 1024)[0]
    joined = np.concatenate([text[:777], text, text[:5]])
    within = cut_points(joined, np.array([0, 777, 777 + len(text), len(joined)]), 8, 64, 1024)[1]
    assert [c - 777 for c in within] == alone and alone[-1] == len(text)
    assert all(b - a <= 1024 for a, b in zip([0, *alone], alone))
    edited = np.concatenate([text[:100], rnd.integers(97, 123, 9).astype(np.uint8), text[100:]])
    shifted = {c - 9 for c in cut_points(edited, np.array([0, len(edited)]), 8, 64, 1024)[0]}
    assert len(shifted & set(alone)) > 0.9 * len(alone)


def test_drop(spark):
    rows = [(1, "t", "x"), (2, "t", "y"), (2, "t", "y"), (3, None, "z"), (None, "u", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, recipe string")
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [(2, "t", "y"), (3, None, "z"), (None, "u", "w")]))
    assert exact_duplicates(docs.limit(0)).count() == 0


def test_rows_that_differ_elsewhere_and_clashing_names(spark):
    rows = [(1, "t", "b", "k"), (1, "t", "a", "k"), (1, "t", "a", "k"), (2, "u", None, "k"), (2, "u", None, "k"), (None, "t", "c", "k"), (3, "v", "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string, _once string")
    for at in (docs, docs.repartition(5)):
        kept = drop_exact_duplicates(at)
        assert kept.columns == docs.columns
        got = sorted(map(str, map(tuple, kept.collect())))
        assert len(got) == 3 and got[1:] == ["(2, 'u', None, 'k')", "(3, 'v', 'x', None)"] and got[0] in ("(1, 't', 'a', 'k')", "(1, 't', 'b', 'k')")
    assert drop_exact_duplicates(docs.limit(0)).count() == 0
