"""Language of a text: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three code points are hashed to buckets. Document frequencies are counted over all
learning documents. Weights are learned by follow-the-regularised-leader with an elastic net on a
bounded sample: in each round every part of the sample runs over its documents from the common state,
and the states are averaged. The softmax is then cooled or warmed to fit documents kept out of that.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwork.llm.common import materialize, send_by_value

BITS = 14
BUCKETS = 1 << BITS
# Odd constants of a rule, one per place in an n-gram and one per length.
_K = ((np.arange(1, 8, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
UNKNOWN = "und"
TEST_SHARE = 5      # one in so many sampled documents sets the temperature


def term_counts(text: str) -> np.ndarray:
    """Counts of the hashed 1-, 2- and 3-grams of the lower-cased text, a space at each end."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    shift = np.uint32(32 - BITS)
    one = c * _K[0] + _K[3]
    two = c[:-1] * _K[1] + c[1:] * _K[2] + _K[4]
    three = c[:-2] * _K[0] + c[1:-1] * _K[1] + c[2:] * _K[2] + _K[5]
    counts = np.zeros(BUCKETS, np.int64)
    for grams in (one, two, three):
        mixed = (grams ^ (grams >> np.uint32(15))) * _K[6]
        counts += np.bincount((mixed >> shift).astype(np.int64), minlength=BUCKETS)
    return counts


def _vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero buckets and their TF-IDF values, of length one."""
    counts = term_counts(text)
    at = np.flatnonzero(counts)
    value = (1 + np.log(counts[at])) * idf[at]
    norm = np.sqrt(value @ value)
    return at, value / norm if norm else value


def _frequencies(batches):
    """Documents per bucket seen by one task: one row of bounded size."""
    seen, total = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
            seen += term_counts(text) > 0
            total += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, BUCKETS], pa.int32()), pa.array(np.r_[seen[at], total], pa.int64())], ["bucket", "n"])


@dataclass(frozen=True)
class Settings:
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-3
    l2: float = 1e-3
    rounds: int = 4
    parts: int = 4


def _weights(z: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    """The leader's weights of a state; exactly 0 where |z| stays within the first penalty."""
    return np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _round(z0: np.ndarray, n0: np.ndarray, idf: np.ndarray, s: Settings):
    """One pass over the documents of a part, from the common state."""
    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        z, n = z0.copy(), n0.copy()
        for text, label in zip(frame.sort_values("rank")["text"], frame.sort_values("rank")["label"]):
            at, x = _vector(text, idf)
            w = _weights(z[at], n[at], s)
            error = _softmax(x @ w)
            error[label] -= 1
            g = x[:, None] * error
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha
            z[at] += g - sigma * w
            n[at] += g * g
        return pd.DataFrame({"z": [z.tobytes()], "n": [n.tobytes()]})
    return run


@dataclass(frozen=True)
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its probability; `und` and 0 for a text without a letter, or if no language is known."""
        if not self.langs or text is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        at, x = _vector(text, self.idf)
        p = _softmax(x @ self.weights[at] / self.temperature)
        best = int(np.argmax(p))    # the first of equal ones
        return self.langs[best], float(p[best])


def _margins(weights: np.ndarray, idf: np.ndarray):
    def run(frames):
        for frame in frames:
            scores = [(x @ weights[at]).tolist() for at, x in (_vector(t, idf) for t in frame["text"])]
            yield pd.DataFrame({"scores": scores, "label": frame["label"]})
    return run


def _temperature(scores: np.ndarray, label: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm. The true label's
    target is one less 1 / (n + 2), so that a faultless sample does not cool to nothing."""
    if not len(scores) or scores.shape[1] < 2:
        return 1.0
    doubt = 1 / (len(label) + 2)

    def loss(t):
        logs = np.log(np.maximum(_softmax(scores / np.exp(t)), 1e-300))
        true = logs[np.arange(len(label)), label]
        return -((1 - doubt) * true + doubt * (logs.sum(axis=1) - true) / (scores.shape[1] - 1)).mean()
    low, high, ratio = np.log(0.01), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_lang: int = 600,
          settings: Settings = Settings()) -> Model:
    """Learn from rows with text and language. Document frequencies cover all of them; the weights
    come from at most `sample_per_lang` documents of each language, those with the smallest hash of the
    id. Rows that repeat an id and language count once, with the text of the smallest hash; rows without an
    id are ranked by their text. A part of
    the sample is a bounded number of documents, whatever the table's size. Without such rows the
    model knows no language."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    counted = known.select("text").mapInArrow(_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS rows at most
    df = np.zeros(BUCKETS + 1)
    for row in counted:
        df[row["bucket"]] = row["n"]
    idf = np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1

    langs = sorted(r[0] for r in known.select("lang").distinct().collect())     # names of languages
    if not langs:
        return Model([], idf, np.zeros((BUCKETS, 0)), 1.0)
    names = F.array(*[F.lit(x) for x in langs])
    # The rank limit is applied in each task before the shuffle; the stated length bounds the broadcast.
    # First within slices of a language, so that what all tasks send for it does not meet in one.
    rank = F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id"))
    ranked = known.select("lang", rank.alias("rank")).distinct().withColumn("slice", F.pmod(F.xxhash64("rank"), F.lit(64)))
    for by in (["lang", "slice"], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy("rank"))
        ranked = ranked.withColumn("place", place).where(F.col("place") <= sample_per_lang)
    chosen = ranked.select("rank", "lang")
    chosen = F.broadcast(materialize(chosen, "chosen"))
    once = (known.withColumn("rank", rank).join(chosen, ["rank", "lang"]).groupBy("rank", "lang")
            .agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")))
    sample = materialize(
        once.select("rank", "text", (F.array_position(names, F.col("lang")) - 1).cast("int").alias("label"),
                F.pmod("rank", F.lit(settings.parts)).alias("part"), F.pmod(F.xxhash64("rank"), F.lit(TEST_SHARE)).alias("fold")), "sample")
    learn, test = sample.where("fold > 0"), sample.where("fold = 0")

    z, n = np.zeros((BUCKETS, len(langs))), np.zeros((BUCKETS, len(langs)))
    for _ in range(settings.rounds):
        states = learn.groupBy("part").applyInPandas(_round(z, n, idf, settings), "z binary, n binary").collect()   # `parts` states
        if states:
            z, n = (np.mean([np.frombuffer(s[k]).reshape(BUCKETS, len(langs)) for s in states], axis=0) for k in ("z", "n"))
    weights = _weights(z, n, settings)
    held = test.mapInPandas(_margins(weights, idf), "scores array<double>, label int").collect()   # a fifth of the sample
    scores = np.array([r["scores"] for r in held]).reshape(len(held), len(langs))
    return Model(langs, idf, weights, _temperature(scores, np.array([r["label"] for r in held], np.int64)))


def _rows(model: Model):
    def run(batches):
        for batch in batches:
            found = [model.predict(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("id")), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["id", "lang_pred", "score"])
    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score. Null texts and texts without a letter are `und`
    with score 0. Nothing but the text is looked at; other columns are not read; an empty table gives
    no rows."""
    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = held.schema["id"].dataType.simpleString()
    return held.mapInArrow(_rows(model), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


send_by_value(sys.modules[__name__])
