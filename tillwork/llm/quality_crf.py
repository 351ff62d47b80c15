"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its features are measured on the line and on the lines before and after it;
the chain adds a weight for each pair of neighbouring labels. Forward-backward gives each line's
probability of being good, and the length-weighted mean of those is the document's quality, brought to
the labels' scale by a logistic curve.

Training labels are of documents; each line of a document carries its document's label. The gradient
is summed by Spark over the sample's feature tables, and the driver takes L-BFGS steps on a vector of
some fifty weights.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.llm.common import mix, materialize, send_by_value, text_slices, word_hashes

# The byte classes that lines are measured by.
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".,;:'\"()-?"]] = True
_SYMBOL = ~(_LETTER | _DIGIT | _BLANK | _STOPS)

OWN = 11        # features of a line itself
AROUND = 5      # of which the neighbours' values are added, for the line before and the line after
WIDTH = OWN + 2 * AROUND
GOOD = 1


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, bytes, first line of each text) of the lines of a run of texts. A text has one line
    more than line feeds, so an empty text has one empty line."""
    n = len(data)
    texts = len(offsets) - 1
    feeds = np.flatnonzero(data == 10)
    lines_of = np.bincount(np.searchsorted(offsets[1:], feeds, side="right"), minlength=texts)[:texts] + 1
    first = np.r_[0, np.cumsum(lines_of)]
    owner = np.repeat(np.arange(texts), lines_of)
    begins, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    starts_at = first[:-1]
    inner = np.ones(len(begins), bool)
    inner[starts_at] = False
    begins[starts_at] = offsets[:-1]
    begins[inner] = feeds + 1
    closing = np.ones(len(begins), bool)
    closing[first[1:] - 1] = False
    ends[first[1:] - 1] = offsets[1:]
    ends[closing] = feeds
    size = (ends - begins).astype(np.float64)

    def share(table):
        sums = np.zeros(n + 1, np.int32)
        np.cumsum(table[data], out=sums[1:], dtype=np.int32)
        return (sums[ends] - sums[begins]).astype(np.float64)

    letters, upper, digits, blank, stops, symbols = map(share, (_LETTER, _UPPER, _DIGIT, _BLANK, _STOPS, _SYMBOL))
    start, _, hashes, _ = word_hashes(data, offsets, ~_BLANK)
    line_of = np.searchsorted(begins, start, side="right") - 1
    words = np.bincount(line_of, minlength=len(begins)).astype(np.float64)
    same = np.zeros(len(start), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])
    stutter = np.bincount(line_of, weights=same, minlength=len(begins))
    named = np.sort((line_of.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    fresh = named[np.r_[True, named[1:] != named[:-1]]] if len(named) else named
    distinct = np.bincount((fresh >> np.uint64(40)).astype(np.int64), minlength=len(begins)).astype(np.float64)
    # A line repeated in its text: same sum of word hashes and same length.
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes, out=sums[1:])
    edge = np.searchsorted(line_of, np.arange(len(begins) + 1))
    key = mix(mix(sums[edge[1:]] - sums[edge[:-1]]) + owner.astype(np.uint64))
    _, index, often = np.unique(key, return_inverse=True, return_counts=True)
    repeated = ((often[index.reshape(-1)] > 1) & (words > 1)).astype(np.float64)

    body, text_words = np.maximum(size, 1), np.maximum(words, 1)
    variety = distinct / text_words
    own = np.stack([
        np.ones_like(size), np.log1p(size) / 8, (size == 0).astype(np.float64),
        np.minimum(symbols / body, 0.2) * 5, np.minimum(upper / np.maximum(letters, 1), 0.5) * 2,
        (1 - variety) * np.minimum(words / 8, 1), stutter / text_words, repeated,
        np.minimum(digits / body, 0.5) * 2, np.minimum(stops / text_words, 1), np.minimum(letters / text_words, 20) / 20], axis=1)
    near = own[:, 3:3 + AROUND]
    before, after = np.zeros_like(near), np.zeros_like(near)
    before[1:], after[:-1] = near[:-1], near[1:]
    before[starts_at] = 0
    after[first[1:] - 1] = 0
    return np.hstack([own, before, after]), size, first


def forward_backward(scores: np.ndarray, first: np.ndarray, moves: np.ndarray):
    """For chains laid end to end: (log partition of each chain, probability of label 1 at each line,
    expected number of each move). `scores`: the weight of label 1 at each line, that of label 0 is 0.
    All chains advance together; the longest decides the number of steps."""
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    begin, length = first[:-1][order], lengths[order]
    alive = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")   # chains longer than t
    a = np.zeros((len(scores), 2))
    if len(begin):
        a[begin, 1] = scores[begin]
    for t in range(1, len(alive)):
        at = begin[:alive[t]] + t
        a[at] = np.logaddexp(a[at - 1, 0:1] + moves[0], a[at - 1, 1:2] + moves[1])
        a[at, 1] += scores[at]
    b = np.zeros((len(scores), 2))
    for t in range(len(alive) - 2, -1, -1):
        at = begin[:alive[t + 1]] + t
        after = b[at + 1] + np.stack([np.zeros(len(at)), scores[at + 1]], axis=1)
        b[at, 0] = np.logaddexp(moves[0, 0] + after[:, 0], moves[0, 1] + after[:, 1])
        b[at, 1] = np.logaddexp(moves[1, 0] + after[:, 0], moves[1, 1] + after[:, 1])
    log_z = np.logaddexp(a[first[1:] - 1, 0], a[first[1:] - 1, 1]) if len(begin) else np.zeros(0)
    z = np.repeat(log_z, lengths)
    good = np.exp(np.minimum(a[:, 1] + b[:, 1] - z, 0))
    pairs = np.ones(len(scores), bool)
    pairs[first[:-1]] = False
    to = np.flatnonzero(pairs)
    expected = np.zeros((2, 2))
    for i in range(2):
        for j in range(2):
            expected[i, j] = np.exp(a[to - 1, i] + moves[i, j] + b[to, j] + (scores[to] if j else 0) - z[to]).sum()
    return log_z, good, expected


def _sample_features(batches):
    for batch in batches:
        label = batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False)
        for first, last, data, offsets in text_slices(batch, "text"):
            x, size, lines = line_features(data, offsets)
            rows = [(int(label[first + i]), x[lines[i]:lines[i + 1]].astype(np.float32).tobytes(), size[lines[i]:lines[i + 1]].astype(np.float32).tobytes())
                    for i in range(last - first)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))],
                                             ["label", "features", "sizes"])


def _unpacked(frame: pd.DataFrame):
    x = np.frombuffer(b"".join(frame["features"]), np.float32).reshape(-1, WIDTH).astype(np.float64)
    size = np.frombuffer(b"".join(frame["sizes"]), np.float32).astype(np.float64)
    lines = np.array([len(s) // 4 for s in frame["sizes"]])
    return x, size, np.r_[0, np.cumsum(lines)]


def _gradient(weights: np.ndarray):
    def run(frames):
        for frame in frames:
            if len(frame):
                x, _, first = _unpacked(frame)
                label = frame["label"].to_numpy()
                scores, moves = x @ weights[:WIDTH], np.array([[0.0, weights[WIDTH]], [weights[WIDTH + 1], weights[WIDTH + 2]]])
                log_z, good, _ = forward_backward(scores, first, moves)
                lines, weight = np.diff(first), 1 / np.diff(first)
                # A document counts once, however many lines it has.
                share, true = np.repeat(weight, lines), np.repeat(label, lines)
                at_start = np.bincount(np.repeat(np.arange(len(label)), lines), weights=scores * true, minlength=len(label))
                gold = at_start + (lines - 1) * np.where(label == GOOD, moves[1, 1], moves[0, 0])
                loss = ((log_z - gold) * weight).sum()
                slope = x.T @ ((good - true) * share)
                drift = _moves(scores, first, moves) - np.array([0, 0, ((lines - 1) * weight)[label == GOOD].sum()])
                yield pd.DataFrame({"loss": [loss], "slope": [np.r_[slope, drift].tolist()], "n": [len(label)]})
    return run


def _moves(scores, first, moves):
    """Expected moves 0-1, 1-0 and 1-1, each chain weighted by one over its lines."""
    lengths = np.diff(first)
    total = np.zeros(3)
    # Chains of one weight are summed together: there are few distinct lengths.
    for n in np.unique(lengths[lengths > 1]):
        pick = np.flatnonzero(lengths == n)
        at = (first[:-1][pick][:, None] + np.arange(n)).reshape(-1)
        _, _, expected = forward_backward(scores[at], np.arange(0, len(at) + 1, n), moves)
        total += np.array([expected[0, 1], expected[1, 0], expected[1, 1]]) / n
    return total


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    scale: float
    shift: float

    @classmethod
    def constant(cls, share: float) -> "Model":
        return cls(np.zeros(WIDTH + 3), 0.0, float(np.log(share / (1 - share))))

    def scores(self, x: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' probabilities of being good; lines count one byte at least."""
        moves = np.array([[0.0, self.weights[WIDTH]], [self.weights[WIDTH + 1], self.weights[WIDTH + 2]]])
        _, good, _ = forward_backward(x @ self.weights[:WIDTH], first, moves)
        length = np.maximum(size, 1)
        return np.add.reduceat(good * length, first[:-1]) / np.add.reduceat(length, first[:-1]) if len(first) > 1 else np.zeros(0)

    def calibrated(self, mean: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * mean + self.shift)))


def _minimise(value, w: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking."""
    f, g = value(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, coefficients = g.copy(), []
        for s, y in reversed(past):
            c = (s @ d) / (s @ y)
            coefficients.append(c)
            d -= c * y
        if past:
            s, y = past[-1]
            d *= (s @ y) / (y @ y)
        for (s, y), c in zip(past, reversed(coefficients)):
            d += (c - (y @ d) / (s @ y)) * s
        rate = 1.0 if past else min(1.0, 1 / (np.abs(g).sum() + 1e-12))
        for _ in range(12):
            new = w - rate * d
            f_new, g_new = value(new)
            if f_new <= f - 1e-4 * rate * (g @ d):
                break
            rate /= 2
        else:
            break
        s, y = new - w, g_new - g
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        done = abs(f - f_new) < 1e-5 * max(1.0, abs(f))
        w, f, g = new, f_new, g_new
        if done:
            break
    return w


def _logistic(mean: np.ndarray, label: np.ndarray, weight: np.ndarray, ridge: float) -> tuple[float, float]:
    """Newton steps for P(label 1) = 1 / (1 + exp(-(scale * mean + shift)))."""
    x, beta = np.stack([mean, np.ones_like(mean)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ beta)))
        slope = x.T @ (weight * (p - label)) + ridge * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample_per_label: int = 3000, ridge: float = 1e-3, steps: int = 40) -> Model:
    """Fit on a sample of at most `sample_per_label` documents of each label, those with the smallest
    hash of the id. Labels other than 0 and 1 are ignored; of several labels of one id the smallest
    counts; an id that repeats brings each of its texts.
    Without sampled texts of both labels the score of every text is the smoothed share of label 1."""
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("label")).where("_id is not null")
    known = materialize(known, "labels")
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
    if set(totals) != {0, 1}:
        return Model.constant(prior)
    # Two top lists of a stated length; that length bounds the broadcast.
    picked = [known.where(F.col("label") == v).orderBy(F.xxhash64("_id"), "_id").limit(sample_per_label) for v in (0, 1)]
    chosen = picked[0].unionByName(picked[1])
    taken = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id").select("label", "text")
    sample = materialize(taken.mapInArrow(_sample_features, "label int, features binary, sizes binary"), "line-features")
    counts = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    if set(counts) != {0, 1}:
        return Model.constant(prior)

    def value(w: np.ndarray):
        parts = sample.mapInPandas(_gradient(w), "loss double, slope array<double>, n long").collect()   # one row per batch
        loss, slope = sum(p["loss"] for p in parts), np.sum([p["slope"] for p in parts], axis=0)
        return loss / total + ridge * (w @ w), slope / total + 2 * ridge * w

    weights = _minimise(value, np.zeros(WIDTH + 3), steps)
    raw = Model(weights, 1.0, 0.0)
    means = sample.mapInPandas(_means(raw), "label int, mean double").toPandas()   # at most two numbers per sampled document
    label = means["label"].to_numpy(np.float64)
    share = np.where(label == 1, totals[1] / max(counts.get(1, 1), 1), totals[0] / max(counts.get(0, 1), 1))
    scale, shift = _logistic(means["mean"].to_numpy(), label, share / share.sum() * len(label), 0.1)
    return Model(weights, scale, shift)


def _means(model: Model):
    def run(frames):
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"label": frame["label"], "mean": model.scores(*_unpacked(frame))})
    return run


def _score_rows(model: Model, names: list[str]):
    def run(batches):
        for batch in batches:
            for first, last, data, offsets in text_slices(batch, "_text"):
                mean = model.scores(*line_features(data, offsets))
                piece = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*(piece.column(batch.schema.get_field_index(c)) for c in names),
                                                  pa.array(model.calibrated(mean), pa.float64())], [*names, "_score"])
    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """`docs` with the quality of each whole text (0 to 1) in column `into`, replacing one of that
    name. Null counts as empty; an empty text is one empty line. An empty table gives no rows."""
    kept = [c for c in docs.columns if c != into]
    held = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(text_col).alias("_text"))
    names = [f"c{i}" for i in range(len(kept))]
    kinds = ", ".join(f"{n} {held.schema[n].dataType.simpleString()}" for n in names)
    scored = held.mapInArrow(_score_rows(model, names), f"{kinds}, _score double")
    return scored.select(*[F.col(n).alias(c) for n, c in zip(names, kept)], F.col("_score").alias(into))


send_by_value(sys.modules[__name__])
