"""Winnowing against a comparison of all windows."""

import random
import re

import pytest

from tillwork.llm.winnowing import contamination, drop_contaminated

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute(docs, items, window=10):
    out = []
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for item, body in items:
            b = words(body)
            n = min(len(b), window)
            grams = {tuple(b[j:j + n]) for j in range(len(b) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i:i + n]) in grams:
                    hit |= set(range(i, i + n))
                    names.add("" if item is None else str(item))
        out.append((doc, len(w), len(hit), len(names), sorted(names), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed, window, k", [(1, 10, 5), (2, 10, 5), (3, 6, 3), (4, 10, 10), (5, 4, 1)])
def test_against_all_windows(spark, seed, window, k):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["É", "é", "it's"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 4, 9, 10, 11, 25, 40])))) for i in range(25)]
    items += [(3, items[0][1]), (None, "null id item " * 5), (90, ""), (91, None), (92, "same same " * 12)]
    docs = []
    for d in range(60):
        w = [rnd.choice(vocab) for _ in range(rnd.choice([0, 3, 9, 30, 80]))]
        for _ in range(rnd.choice([0, 1, 2])):
            part = words(rnd.choice(items)[1])
            lo = rnd.randrange(len(part) + 1)
            at = rnd.randrange(len(w) + 1)
            w[at:at] = part[lo:lo + rnd.choice([5, 9, 10, 15, 50])]
        docs.append((d, rnd.choice(["{}", "{}!", "\n{}", "({})"]).format(rnd.choice([" ", ", ", "\n"]).join(w).upper())))
    docs += [(1, "same same " * 30), (1, "same same " * 30), (None, "null id item " * 6), (None, None), (70, "")]
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"),
                        spark.createDataFrame(items, "item_id long, text string"), window=window, k=k).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items, window)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a " * 40_000, 2, "x"), (2, "clean text", 3, "y")], "doc_id long, text string, item_id int, row string")
    items = spark.createDataFrame([(5, "a a a a a a a a a a a a")], "item_id long, text string")
    assert [r["n_hit"] for r in contamination(docs, items).orderBy("doc_id").collect()] == [40_000, 0]
    assert contamination(docs.limit(0), items).count() == 0
    assert [r["contaminated"] for r in contamination(docs, items.limit(0)).collect()] == [False, False]
    assert drop_contaminated(docs, items).collect() == docs.where("doc_id = 2").collect()
    with pytest.raises(ValueError):
        contamination(docs, items, window=3, k=4)


def test_clean_rows_that_share_an_id_stay(spark):
    dirty, other = " ".join(f"b{i}" for i in range(12)), "say " + " ".join(f"b{i}" for i in range(12))
    rows = [(None, dirty, "a"), (None, "clean without id", "b"), (None, None, "c"), (1, dirty, "d"), (1, "clean with id", "e"),
            (1, "clean with id", "f"), (2, other, "g"), (2, other, "h"), (3, None, "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    items = spark.createDataFrame([(1, dirty)], "item_id long, text string")
    left = drop_contaminated(docs, items)
    assert left.columns == docs.columns
    assert sorted(r["row"] for r in left.collect()) == ["b", "c", "e", "f", "i"]


def test_ids_and_texts_that_join_to_the_same(spark):
    words = " ".join(f"c{i}" for i in range(12))
    docs = spark.createDataFrame([("a|b", words), ("a", "b|" + words), ("null", "x"), (None, words)], "doc_id string, text string")
    got = contamination(docs, spark.createDataFrame([(1, "b " + words)], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["n_hit"]) for r in got} == {("a|b", 12), ("a", 13), ("null", 0), (None, 12)}
