"""The pipeline and the queries of the subpackage."""

import re

import pytest
from oracle import compare

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from tillwork.llm.pieces import Vocabulary, decode_ids
from tillwork.llm.queries import ORACLES, PIECES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    if name in ORACLES:
        assert [p for p in compare(QUERIES[name](spark, sf), ORACLES[name], sf) if p != "EMPTY"] == []
    else:
        assert QUERIES[name](spark, sf).count() > 0


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(queries()) and set(ORACLES) <= set(oracle_sql()) and len(QUERIES) == 13


def without_copies(rows):
    best = {}
    for r in rows:
        best[r["text"] or ""] = max(r["doc_id"], best.get(r["text"] or "", -1))
    return set(best.values())


def without_near_copies(rows):
    """Linked documents by comparing all pairs: the smallest id of each component."""
    sets = {}
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[r["doc_id"]] = {tuple(words[i:i + 4]) for i in range(max(len(words) - 3, 1))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in sets if find(i) == i}


def without_benchmark(rows, items):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))

    windows = set()
    for item in items:
        w = words(item["text"])
        windows |= {tuple(w[i:i + 10]) for i in range(max(len(w) - 9, 1))} if w else set()
    sizes = {len(w) for w in windows}
    return {r["doc_id"] for r in rows
            if not any(tuple(w[i:i + n]) in windows for w in [words(r["text"])] for n in sizes for i in range(len(w) - n + 1))}


def test_stages(spark, sf):
    import numpy as np

    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    plain = {"exact dedup": without_copies, "n-gram Jaccard join": without_near_copies, "benchmark decontamination": lambda rows: without_benchmark(rows, items)}

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, at = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, sf)
        assert after.columns == columns
        ids = {r[0] for r in after.select("doc_id").collect()}
        before = at.collect()
        assert ids and ids <= {r["doc_id"] for r in before}, name
        assert name not in plain or ids == plain[name](before), name
        at = spark.createDataFrame(after.collect(), docs.schema)
    v = Vocabulary.load(PIECES)
    texts = {r["doc_id"]: r["text"] for r in at.collect()}
    out = corpus_pipeline.STAGES[-1][1](spark, at, sf).collect()
    assert {r["doc_id"]: decode_ids(v, np.frombuffer(r["pieces"], "<i4").tolist()) for r in out} == texts


def test_run_and_empty(spark, tmp_path):
    rows = [(1, "A plain text of some words that nobody repeats here."), (2, "A plain text of some words that nobody repeats here."),
            (3, " ".join(f"w{i}" for i in range(40))), (4, " ".join(f"w{i}" for i in range(40)) + " w40"), (5, "Take " + " ".join(f"b{i}" for i in range(12))), (6, None)]
    docs = spark.createDataFrame([(*r, None, "s", None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(12)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [2, 3, 6]
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
