"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Sources share a number of words by weight. Among all rates of a source's documents (how often a document
is taken) whose words add up to the source's target, those are sought that differ least, in relative
entropy, from taking every document once, and that stay below `most` copies. They are exponentially
tilted, min(most, exp(lambda * size / mean size)), and lambda solves the convex dual. All sources take a
Newton step at a time, each an aggregation over (source, size) counts, so an iteration costs as much as
there are different sizes; steps that leave the bracket of the solution are halved instead.

Rates are rounded into whole copies: running totals of the expected copies, from long documents to short
ones, are rounded, which leaves less than a long document's words open; those are then given to or taken
from ever shorter documents. Which of the documents of one size are copied once more is decided by a hash.
All sums are of decimals, so that reruns agree whatever the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.llm.common import materialize, small
from tillwork.operators.ordered import Running, scan

WORD = r"[^\x20\x09-\x0D]+"
SUM = "decimal(38,9)"
NEWTON_STEPS = 100      # the bracket halves at worst, so this is never reached
PRECISION = 1e-9        # of the target, where iterations end
REPAIRS = 12
FEW_SOURCES = 10_000    # so many rows of sums may be broadcast
NEAR = 0.0005           # of the target, where repairs end


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, share: float, weights: Sequence[float], most: int) -> DataFrame:
    """Add `target` to (source, source_size, documents), and `place`, the number of each source by code
    point, null last. Targets are weight * level, at most `most` times the source's size. The level is what
    resharing the excess by weight leads to: with sources in the order in which they reach their limit, it
    is the largest of (words left / weight left) over all numbers of sources that are at it."""
    sources = sources.withColumn("_last", F.col("source").isNull())
    n = sources.count()
    placed = scan(sources, [], ["_last", "source"], [Running("place", "count", F.lit(1))], largest=n)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    limited = placed.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
    limited = limited.withColumn("_full_at", F.col("limit") / F.col("weight"))
    ranked = materialize(scan(limited, [], ["_full_at", "place"], [
        Running("_full", "sum", F.col("limit"), current=False), Running("_used", "sum", F.col("weight"), current=False)], largest=n), "sources")
    words, all_weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    left = F.lit(float(words or 0) * share) - F.coalesce("_full", F.lit(0))
    level = ranked.agg(F.max(left / (F.lit(float(all_weight or 0)) - F.coalesce("_used", F.lit(0.0))))).first()[0]
    return ranked.select("source", "source_size", "documents", "place",
                         F.least(F.col("limit").cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def _rate(tilt: Column, size: Column, mean: Column, most: int) -> Column:
    # A null tilt stands for no bound on it: every document at its limit.
    return F.coalesce(F.least(F.exp(F.least(tilt * size / mean, F.lit(40.0))), F.lit(float(most))), F.lit(float(most)))


def tilts(bins: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """(place, tilt) of every source: the dual's solution. `bins` holds (place, size, n), sizes positive;
    `sources` (place, source_size, documents, target)."""
    mean = F.try_divide("source_size", "documents")
    free = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * most)
    # At the upper end even one word is taken `most` times; at the lower end no size yields more than its
    # share of the target, as x * exp(-x) is at most exp(-1).
    state = sources.where(free).select(
        "place", "target", mean.alias("mean"), F.lit(0.0).alias("tilt"), F.try_divide(-F.col("source_size"), F.col("target")).alias("low"),
        (F.lit(most).cast("double") * mean).alias("high"), F.lit(False).alias("done"))
    state = materialize(state, "tilts")
    few = state.count() <= FEW_SOURCES
    for _ in range(NEWTON_STEPS):
        if not state.agg(F.count_if(~F.col("done"))).first()[0]:
            break
        rate = _rate(F.col("tilt"), F.col("size"), F.col("mean"), most)
        words = F.col("n") * F.col("size") * rate
        slope = F.when(rate < most, words * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = (bins.join(F.broadcast(state) if few else state, "place").groupBy("place", "target", "mean", "tilt", "low", "high", "done")
                .agg(F.sum(words.cast(SUM)).cast("double").alias("_words"), F.sum(slope.cast(SUM)).cast("double").alias("_slope")))
        low = F.when(F.col("_words") <= F.col("target"), F.col("tilt")).otherwise(F.col("low"))
        high = F.when(F.col("_words") >= F.col("target"), F.col("tilt")).otherwise(F.col("high"))
        # Newton's step for the logarithm of the words, which bends less than the words themselves.
        step = F.col("tilt") - F.log(F.col("_words") / F.col("target")) * F.col("_words") / F.col("_slope")
        step = F.when((F.col("_words") > 0) & (F.col("_slope") > 0), step)
        near = F.abs(F.col("_words") - F.col("target")) <= F.col("target") * PRECISION
        narrow = F.col("high") - F.col("low") <= F.greatest(F.abs("high"), F.abs("low")) * 1e-15
        moved = sums.withColumns({"low": low, "high": high}).withColumn("_step", step)
        inside = (F.col("_step") > F.col("low")) & (F.col("_step") < F.col("high"))
        state = materialize(moved.select(
            "place", "target", "mean", F.when(near | F.col("done"), F.col("tilt")).when(inside, F.col("_step"))
            .otherwise((F.col("low") + F.col("high")) / 2).alias("tilt"), "low", "high", (F.col("done") | near | narrow).alias("done")), "tilts")
    return state.select("place", "tilt")


def round_copies(bins: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """Add `copies`, the copies of all documents of a bin together, to (place, size, n, rate)."""
    down = bins.withColumns({"_down": -F.col("size"), "_expected": (F.col("n") * F.col("rate")).cast(SUM)})
    totals = scan(down, ["place"], ["_down"], [Running("_upto", "sum", F.col("_expected"))])
    half = F.lit("0.5").cast(SUM)
    copies = F.floor(F.col("_upto") + half) - F.floor(F.col("_upto") - F.col("_expected") + half)
    rounded = totals.select("place", "size", "n", "rate", F.least(F.greatest(copies, F.lit(0)), F.col("n") * most).cast("long").alias("copies"))
    rounded = materialize(rounded, "copies")
    for _ in range(REPAIRS):
        taken = rounded.groupBy("place").agg(F.sum(F.col("copies") * F.col("size")).alias("_taken"))
        open_ = sources.join(taken, "place").select("place", "target", (F.col("target") - F.col("_taken")).alias("_open"))
        open_ = materialize(open_, "open")
        wrong = open_.where(F.abs("_open") > F.col("target") * NEAR)
        if not wrong.limit(1).count():
            break
        # Documents not longer than what is open, the longest first, as far as they go.
        spare = F.when(F.col("_open") > 0, F.col("n") * most - F.col("copies")).otherwise(F.col("copies"))
        held = rounded.join(small(wrong.select("place", "_open")), "place", "left")
        fits = F.col("_open").isNotNull() & (F.col("size") <= F.abs("_open"))
        held = held.withColumns({"_down": -F.col("size"), "_spare": F.when(fits, spare).otherwise(0)})
        held = scan(held, ["place"], ["_down"], [Running("_before", "sum", F.col("_spare") * F.col("size"), current=False)])
        room = F.abs("_open") - F.coalesce("_before", F.lit(0))
        change = F.least(F.greatest(F.floor(room / F.col("size")), F.lit(0)), F.col("_spare")) * F.signum("_open")
        after = held.select("place", "size", "n", "rate", (F.col("copies") + F.coalesce(change, F.lit(0))).cast("long").alias("copies"),
                            F.coalesce(change != 0, F.lit(False)).alias("_changed"))
        after = materialize(after, "copies")
        if not after.where("_changed").limit(1).count():
            break
        rounded = after.drop("_changed")
    return rounded


def mix(docs: DataFrame, share: float = 1.5, weights: Sequence[float] = (3, 1, 2), most: int = 2, source_col: str = "source",
        text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns `keep` of every row with its size in words, source_size, target (its source's words in the
    mix), rate (its tilted rate), copies and taken (copies * size).

    `share` times all words are mixed; `weights` go to sources by code point, null last, over and over. A
    source gets at most `most` times its words and a document at most `most` copies. A source's words come as
    near its target as whole documents allow: they stop where less is open than its shortest document with a
    copy to spare, or NEAR of the target. Null and empty texts have size 0 and no copies, but their source
    counts. Repeated rows are documents of their own. An empty table gives an empty mix. Texts are read
    once, whole, and only counted, so their length does not matter; `keep` must not name the columns added.
    """
    names = [f"_k{i}" for i in range(len(keep))]
    sized = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    sized = materialize(sized, "sizes")
    counts = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "bins")
    sources = source_targets(counts.groupBy("source").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("documents")),
        share, weights, most)
    sources = small(materialize(sources, "targets"))
    same = counts["source"].eqNullSafe(sources["source"])
    bins = materialize(counts.join(sources, same).where("size > 0").select("place", "size", "n"), "bins")
    tilted = tilts(bins, sources, most)
    state = sources.join(tilted, "place", "left").select("place", "target", "tilt", F.try_divide("source_size", "documents").alias("_mean"))
    rate = F.when(F.col("target") > 0, _rate(F.col("tilt"), F.col("size"), F.col("_mean"), most)).otherwise(0.0)
    rated = bins.join(small(state), "place").select("place", "size", "n", rate.alias("rate"))
    copied = round_copies(rated, sources, most)
    copied = copied.select("place", "size", "rate", F.floor(F.col("copies") / F.col("n")).alias("_each"), (F.col("copies") % F.col("n")).alias("_more"))

    known = sized.join(sources.select(F.col("source").alias("_source"), "place", "source_size", "target"),
                       sized["source"].eqNullSafe(F.col("_source"))).drop("source", "_source")
    chosen = known.join(small(copied, 100_000), ["place", "size"], "left")
    picked = F.col("_more") > 0
    rows = chosen.where(picked).withColumn("_hash", F.xxhash64(*[F.col(n) for n in names]))
    ranked = scan(rows, ["place", "size"], ["_hash", *names], [Running("_rank", "count", F.lit(1))])
    more = ranked.withColumn("copies", F.col("_each") + (F.col("_rank") <= F.col("_more")).cast("long")).drop("_hash", "_rank")
    rest = chosen.where(~F.coalesce(picked, F.lit(False))).withColumn("copies", F.coalesce("_each", F.lit(0)).cast("long"))
    mixed = more.unionByName(rest)
    return mixed.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "size", "source_size", "target",
                        F.coalesce("rate", F.lit(0.0)).alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken"))
