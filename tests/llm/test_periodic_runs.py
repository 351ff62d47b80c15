import random

import numpy as np
import pytest

from tillwork.llm import periodic_runs
from tillwork.llm.queries import QUERIES


def plain_runs(words, min_length, min_exponent):
    """Every period in turn: stretches in which words so far apart agree."""
    found = {}
    for q in range(1, len(words) // min_exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, min_exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def some_text(rng):
    n, kinds = rng.choice([0, 1, 3, 10, 40, 150]), rng.choice([1, 2, 3, 5, 50])
    words = [f"w{rng.randrange(kinds)}" for _ in range(n)]
    if n and rng.random() < 0.5:
        first, parts = rng.randrange(n), rng.randint(3, 10)
        period = 1 + (n - first) // parts
        words = words[:first] + [words[first + (i - first) % period] for i in range(first, n)]
    return words


@pytest.mark.parametrize("min_length,min_exponent", [(6, 4), (2, 2), (5, 3), (9, 2), (1, 5)])
def test_runs_against_every_period(min_length, min_exponent):
    rng = random.Random(min_length * 10 + min_exponent)
    for _ in range(60):
        texts = [some_text(rng) for _ in range(rng.randint(1, 6))]
        codes = np.array([int(w[1:]) for t in texts for w in t], np.int64)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        got = [tuple(r) for r in periodic_runs.runs_of(codes, bounds, min_length, min_exponent).tolist()]
        assert got == [(k, *r) for k, t in enumerate(texts) for r in plain_runs(t, min_length, min_exponent)]


def test_suffix_array_and_lcp_are_sorted_and_exact():
    codes = np.array([2, 1, 2, 1, 2, 0, 1, 2, 1, 0])
    text_of = np.array([0] * 6 + [1] * 4)
    order, ranks = periodic_runs.suffix_array(text_of, codes)
    suffixes = [(text_of[i], list(codes[i:6 if i < 6 else 10])) for i in range(10)]
    assert [suffixes[i] for i in order] == sorted(suffixes)
    lcp = periodic_runs.lcp_array(order, ranks)
    for a, b, n in zip(order, order[1:], lcp[1:]):
        same = 0
        while suffixes[a][0] == suffixes[b][0] and suffixes[a][1][same:same + 1] == suffixes[b][1][same:same + 1] != []:
            same += 1
        assert n == same


def test_few_tests_at_once_find_the_same(monkeypatch):
    monkeypatch.setattr(periodic_runs, "TESTS_AT_ONCE", 3)
    assert periodic_runs.runs_of(np.zeros(40, np.int64), np.array([0, 40])).tolist() == [[0, 0, 40, 1]]


def test_long_texts_of_one_word_end():
    assert periodic_runs.runs_of(np.zeros(200_000, np.int64), np.array([0, 200_000])).tolist() == [[0, 0, 200_000, 1]]


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n ", "x"), (4, "a a a a a", "x"), (5, "b\x0ba a\fa a a\ra c", "x"), (5, "b\x0ba a\fa a a\ra c", "x"),
            (None, "ä ö ä ö ä ö ä ö", "x"), (6, "one two one two one two one two one two one two", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = {(r["doc_id"], r["n_words"], tuple(tuple(x) for x in r["runs"]), r["collapsed"]) for r in periodic_runs.find_runs(docs).collect()}
    assert got == {(1, 0, (), ""), (2, 0, (), ""), (3, 0, (), ""), (4, 5, (), "a a a a a"), (5, 8, ((1, 6, 1),), "b a c"),
                   (None, 8, ((0, 8, 2),), "ä ö"), (6, 6, ((0, 6, 1),), "one two")}
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0


def test_the_query_keeps_every_document(spark, sf):
    rows = QUERIES["op11_periodic_runs"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert any(r["n_runs"] for r in rows) and all((r["start"] is None) == (r["n_runs"] == 0) for r in rows)
