"""N-best segmentation against enumeration, and exact round trips."""

import random

import numpy as np
import pytest

from tillwork.llm import pieces
from tillwork.llm.pieces import MARK, Vocabulary, decode_ids, encode_text, encode_texts, n_best, viterbi, viterbi_all

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load(MODEL)


def toy(seed):
    rnd = random.Random(seed)
    names = {"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 3))) for _ in range(8)} | {"a"} | {MARK, MARK + "a", MARK + "ab"}
    scores = {p: (300 + i, -float(rnd.randint(1, 40)) - i / 64) for i, p in enumerate(sorted(names))}
    listed = [f"<{i}>" for i in range(300)] + sorted(names)
    return Vocabulary(scores, {p[:j] for p in names for j in range(1, len(p))}, listed, 3, 0, min(s for _, s in scores.values()), True)


def every_path(v, word):
    into = pieces.edges(v, word)

    def back(at):
        if at == 0:
            return [(0.0, ())]
        return [(s + score, (*path, (i, at))) for i, _, score in into[at] for s, path in back(i)]
    return sorted((s for s, _ in back(len(word))), reverse=True)


@pytest.mark.parametrize("seed", range(20))
def test_words_against_enumeration(seed):
    v, rnd = toy(seed), random.Random(seed + 100)
    word = MARK + "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 8)))
    scores = every_path(v, word)
    found = n_best(v, word, 6)
    assert [s for s, _ in found] == pytest.approx(scores[:6])
    best, ids, detour = viterbi(v, word)
    assert best == pytest.approx(scores[0]) and ids == found[0][1]
    assert detour == pytest.approx(scores[0] - scores[1]) if len(scores) > 1 else detour == float("inf")
    assert len({tuple(i) for _, i in found}) == len(found)


@pytest.mark.parametrize("seed", range(20))
def test_texts_against_enumeration(seed):
    v, rnd = toy(seed), random.Random(seed)
    text = " ".join("".join(rnd.choice("ab") for _ in range(rnd.randint(1, 3))) for _ in range(3))
    scores = every_path(v, MARK + text.replace(" ", MARK))
    raw, n, best, others = encode_text(v, text, 5)
    assert [best, *(s for s, _ in others)] == pytest.approx(scores[:5])
    ids = np.frombuffer(raw, "<i4").tolist()
    assert len(ids) == n and decode_ids(v, ids) == text
    seen = {tuple(ids)}
    for _, edits in others:
        other, drift = list(ids), 0
        for at, replaced, new in sorted(edits):
            other[at + drift:at + drift + replaced] = new
            drift += len(new) - replaced
        assert decode_ids(v, other) == text
        seen.add(tuple(other))
    assert len(seen) == 1 + len(others)


def test_round_trip(vocabulary):
    for text in ("", " ", "a", " a", "a  b \n\n c", f"{MARK}x {MARK}{MARK} y{MARK}", "Zażółć 日本語 \U0001f600\u0000\r\n\t", "\n", "x" * 5000, "﷐﷑"):
        raw, _, _, others = encode_text(vocabulary, text, 3)
        assert decode_ids(vocabulary, np.frombuffer(raw, "<i4").tolist()) == text


def test_tables(spark):
    rows = [(1, "The cat sat.\nAgain", "x"), (1, "The cat sat.\nAgain", "y"), (None, None, "z"), (3, "", "w"), (4, "word " * 20_000, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pieces string")
    out = pieces.encode(docs, MODEL)
    got = {(r["doc_id"], r["text"]) for r in pieces.decode(out, MODEL, ["doc_id"]).collect()}
    assert got == {(d, t or "") for d, t, _ in rows} and out.count() == 5
    assert pieces.encode(docs.limit(0), MODEL).count() == 0
    first = out.where("doc_id = 1").first()
    assert len(first["alternatives"]) == 3 and first["n_pieces"] * 4 == len(first["pieces"])
    assert all(a["score"] <= first["score"] for a in first["alternatives"])


def best_scores(v, text, n):
    """The n best scores of a text: the n best of every node, from those of the nodes before it."""
    whole = [0.0]
    for word in pieces.split_words(v, text):
        ends = [[0.0]]
        for into in pieces.edges(v, word)[1:]:
            ends.append(sorted((s + score for i, _, score in into for s in ends[i]), reverse=True)[:n])
        whole = sorted((a + b for a in whole for b in ends[-1]), reverse=True)[:n]
    return whole


@pytest.mark.parametrize("spaces", [209, 305, 1009])
def test_ties_in_runs_of_spaces(vocabulary, spaces, monkeypatch):
    """Millions of segmentations of such a run tie with the best; the search must not visit them all."""
    pops, pop = [0], pieces.heapq.heappop

    def counted(queue):
        pops[0] += 1
        if pops[0] > 10_000:
            raise AssertionError("too many partial paths")
        return pop(queue)
    monkeypatch.setattr(pieces.heapq, "heappop", counted)
    for text in ("a" + " " * spaces + "b", "a" + " " * spaces, " " * spaces, " " * spaces + "\n" + " " * spaces):
        pops[0] = 0
        raw, _, best, others = encode_text(vocabulary, text, 4)
        ids = np.frombuffer(raw, "<i4").tolist()
        assert decode_ids(vocabulary, ids) == text and [best, *(s for s, _ in others)] == best_scores(vocabulary, text, 4)
        seen = {tuple(ids)}
        for _, edits in others:
            other, drift = list(ids), 0
            for at, replaced, new in sorted(edits):
                other[at + drift:at + drift + replaced] = new
                drift += len(new) - replaced
            assert decode_ids(vocabulary, other) == text
            seen.add(tuple(other))
        assert len(seen) == 4


def test_ties_without_exact_sums():
    """Pieces of scores that add up with rounding: many equal paths, one order of addition apart."""
    names = [MARK, *("a" * k for k in range(1, 8))]
    v = Vocabulary({p: (i + 1, -0.1 if p != MARK else -0.3) for i, p in enumerate(names)}, {p[:j] for p in names for j in range(1, len(p))},
                   ["<unk>", *names], None, 0, -0.3, True)
    word = MARK + "a" * 401
    found = n_best(v, word, 4)
    assert found[0][1] == viterbi(v, word)[1] and [s for s, _ in found] == pytest.approx([found[0][0]] * 4)


def test_all_words_at_once_like_one_by_one(vocabulary):
    words = ["a", MARK, MARK + "the", "zebra", "日本", "😀x", MARK * 7, "é" * 60, "the" * 20, "\u0378q"]
    ids, bounds, scores, detours = viterbi_all(vocabulary, words)
    for k, word in enumerate(words):
        score, own, detour = viterbi(vocabulary, word)
        assert (scores[k], ids[bounds[k]:bounds[k + 1]].tolist(), detours[k]) == (score, own, detour)


def test_texts_together_like_texts_alone(vocabulary):
    texts = ["", "one two two", MARK + " x", "y" * 200 + " z", "two one\n\n", " " * 90]
    assert encode_texts(vocabulary, texts, 4) == [encode_text(vocabulary, t, 4) for t in texts]
