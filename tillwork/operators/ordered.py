"""Ordered computations per key that stay balanced when one key holds a large share of the rows.

A plain window sends a whole key to one task. `scan` uses one for every key of at most `limit` rows.
The rows of larger keys are range-partitioned on (key, order) into segments of about half that many
rows, pinned, summarised per (key, segment), and finished inside segments with the summaries carried
forward. A segment has at most one key continuing from the segment before, so the carries number at
most the segments.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwork.session import hot_rows, materialize, small

_SEG = "_seg"
# Rows per key up to which re-reading a sliding frame on every row is cheaper than splitting it.
SLIDING_ROWS = 20_000


@dataclass(frozen=True)
class Running:
    """One output of `scan`.

    kind: sum, count, min, max, last (latest non-null) or prev (value on the row before).
    current: whether the row itself belongs to the frame.
    """

    name: str
    kind: str
    value: Column
    current: bool = True


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def scan(df: DataFrame, by: Sequence[str], order: Sequence[str], outputs: Sequence[Running],
         limit: int | None = None, largest: int | None = None) -> DataFrame:
    """Add running values per `by` in ascending `order` (which must order the rows totally).

    `largest`, if known, is the size of the largest group and saves counting when that is at most `limit`.
    """
    limit = hot_rows(df.sparkSession) if limit is None else limit
    keep = df.columns
    held = df.select("*", *[o.value.alias(f"_v{i}") for i, o in enumerate(outputs)])
    busy, rows = (None, 0) if largest is not None and largest <= limit else busy_keys(df, by, limit)
    if not rows:
        return _plain(held, keep, by, order, outputs)
    if not by:
        return _segmented(held, keep, by, order, outputs, segments(rows, limit))
    same = reduce(lambda a, b: a & b, [held[k].eqNullSafe(busy[f"_b_{k}"]) for k in by])
    # A busy key has more than `limit` rows, so there are few of them; `small` checks that.
    listed = small(busy)
    cold = _plain(held.join(listed, same, "left_anti"), keep, by, order, outputs)
    hot = _segmented(held.join(listed, same, "left_semi"), keep, by, order, outputs, segments(rows, limit))
    return cold.unionByName(hot)


def busy_keys(df: DataFrame, by: Sequence[str], limit: int) -> tuple[DataFrame | None, int]:
    """The keys of more than `limit` rows (columns `_b_<key>`), pinned, and how many rows they have.
    Counted in one pass."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    busy = materialize(sizes.select(*[F.col(k).alias(f"_b_{k}") for k in by], "_n"), "busy")
    rows = busy.agg(F.sum("_n")).first()[0] or 0
    return busy.drop("_n"), rows


def segments(rows: int, limit: int) -> int:
    """Segments for so many rows: half of `limit` on average, since range bounds are estimates."""
    return max(2, -(-2 * rows // max(limit, 1)))


def _plain(held, keep, by, order, outputs) -> DataFrame:
    window = Window.partitionBy(*by).orderBy(*order)
    return held.select(*keep, *[_within(o, f"_v{i}", window).alias(o.name) for i, o in enumerate(outputs)])


def _within(out: Running, value: str, window) -> Column:
    frame = window.rowsBetween(Window.unboundedPreceding, 0 if out.current else -1)
    if out.kind == "prev":
        return F.lag(value).over(window)
    if out.kind == "last":
        return F.last(value, ignorenulls=True).over(frame)
    return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[out.kind](value).over(frame)


def _segmented(held, keep, by, order, outputs, parts: int) -> DataFrame:
    ranged = held.repartitionByRange(parts, *by, *order).withColumn(_SEG, F.spark_partition_id())
    pinned = materialize(ranged, "segments")

    position = F.struct(*order)
    summaries = []
    for i, out in enumerate(outputs):
        value = F.col(f"_v{i}")
        if out.kind == "prev":
            agg = F.max_by(value, position)
        elif out.kind == "last":
            agg = F.max_by(value, F.when(value.isNotNull(), position))
        else:
            agg = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[out.kind](value)
        summaries.append(agg.alias(f"_s{i}"))
    summary = pinned.groupBy(*by, _SEG).agg(*summaries)

    before = (Window.partitionBy(*by).orderBy(_SEG)
              .rowsBetween(Window.unboundedPreceding, -1))
    carried = []
    for i, out in enumerate(outputs):
        s = f"_s{i}"
        if out.kind == "prev":
            carry = F.last(s).over(before)
        elif out.kind == "last":
            carry = F.last(s, ignorenulls=True).over(before)
        else:
            carry = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}[out.kind](s).over(before)
        carried.append(carry.alias(f"_c{i}"))
    carries = (summary.select(*[F.col(k).alias(f"_k_{k}") for k in by], F.col(_SEG).alias("_k_seg"),
                              F.count(F.lit(1)).over(before).alias("_prior"), *carried)
               .where("_prior > 0"))

    same = [pinned[k].eqNullSafe(carries[f"_k_{k}"]) for k in by] + [pinned[_SEG] == carries["_k_seg"]]
    joined = pinned.join(small(carries), reduce(lambda a, b: a & b, same), "left")
    window = Window.partitionBy(*by, _SEG).orderBy(*order)
    types = {f"_v{i}": t for i, t in enumerate(_result_types(held, outputs, by, order))}
    results = []
    for i, out in enumerate(outputs):
        local, carry = _within(out, f"_v{i}", window), F.col(f"_c{i}")
        if out.kind == "prev":
            whole = F.when(F.row_number().over(window) == 1, carry).otherwise(local)
        elif out.kind == "last":
            whole = F.coalesce(local, carry)
        elif out.kind == "max":
            whole = F.greatest(local, carry)
        elif out.kind == "min":
            whole = F.least(local, carry)
        elif out.kind == "count":
            whole = local + F.coalesce(carry, F.lit(0))
        else:
            whole = F.when(local.isNull(), carry).when(carry.isNull(), local).otherwise(local + carry)
        results.append(whole.cast(types[f"_v{i}"]).alias(out.name))
    return joined.select(*keep, *results)


def _result_types(held, outputs, by, order):
    window = Window.partitionBy(*by).orderBy(*order)
    plain = held.select(*[_within(o, f"_v{i}", window).alias(f"_r{i}") for i, o in enumerate(outputs)])
    return [field.dataType for field in plain.schema]


def sliding_sums(df: DataFrame, by: Sequence[str], micros: str, tie: str,
                 outputs: dict[str, tuple[Column, int]], limit: int | None = None,
                 largest: int | None = None) -> DataFrame:
    """Sums over the `width` microseconds up to and including each row's time, peers included; null
    where the frame holds no value.

    Spark re-reads the frame on every row, which is quadratic for a busy key. Past `limit` rows
    per key each value becomes an entry at its time and an exit just after it leaves the frame,
    so the window is a running sum and `scan` can split the key.
    """
    limit = min(SLIDING_ROWS, hot_rows(df.sparkSession)) if limit is None else limit
    largest = largest_group(df, by) if largest is None else largest
    if largest <= limit:
        order = Window.partitionBy(*by).orderBy(micros)
        return df.select("*", *[F.sum(value).over(order.rangeBetween(-width, 0)).alias(name)
                                for name, (value, width) in outputs.items()])

    names = list(outputs)
    typed = df.select("*", *[outputs[n][0].alias(f"_w{i}") for i, n in enumerate(names)])
    types = [typed.schema[f"_w{i}"].dataType for i in range(len(names))]
    row = F.struct(*df.columns)

    def change(at, kind, index, sign, payload):
        # Each value comes with a count, which tells an empty frame from one that sums to 0.
        deltas = [d for i in range(len(names)) for d in (
            (F.col(f"_w{i}") * sign if index in (i, None) else F.lit(0)).cast(types[i]).alias(f"_d{i}"),
            (F.col(f"_w{i}").isNotNull().cast("int") * sign if index in (i, None) else F.lit(0)).cast("long").alias(f"_n{i}"))]
        return F.struct(at.alias("_at"), F.lit(kind).alias("_kind"), *deltas, payload.alias("_row"))

    nothing = F.when(F.lit(False), row)
    changes = [change(F.col(micros), 0, None, 1, nothing)]
    changes += [change(F.col(micros) + (outputs[n][1] + 1), 0, i, -1, nothing) for i, n in enumerate(names)]
    asks = F.struct(F.col(micros).alias("_at"), F.lit(1).alias("_kind"),
                    *[d for i, t in enumerate(types) for d in (F.lit(0).cast(t).alias(f"_d{i}"), F.lit(0).cast("long").alias(f"_n{i}"))],
                    row.alias("_row"))
    stream = (typed.select(*by, F.col(tie).alias("_tie"), F.explode(F.array(*changes, asks)).alias("_e"))
              .select(*by, "_tie", "_e.*"))
    summed = scan(stream, by, ["_at", "_kind", "_tie"],
                  [r for i, n in enumerate(names) for r in (Running(n, "sum", F.col(f"_d{i}")), Running(f"_held{i}", "sum", F.col(f"_n{i}")))],
                  limit=limit)
    return summed.where("_kind = 1").select("_row.*", *[F.when(F.col(f"_held{i}") > 0, F.col(n)).alias(n) for i, n in enumerate(names)])


def asof_left(left: DataFrame, right: DataFrame, left_time: str, right_time: str,
              take: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Each left row with the `take` columns of the latest right row at or before its time.

    No row pairs are formed: both sides are merged on time and the last right row is carried
    forward. Right rows at one time are resolved to the greatest `take` tuple.
    """
    row = F.struct(*left.columns)
    match = F.struct(*take)
    lefts = left.select(*by, F.col(left_time).alias("_t"), F.lit(1).alias("_side"),
                        F.xxhash64(*left.columns).alias("_tie"), row.alias("_row"),
                        F.lit(None).alias("_match"))
    latest = right.groupBy(*by, F.col(right_time).alias("_t")).agg(F.max(match).alias("_match"))
    rights = latest.select(*by, "_t", F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_tie"),
                           F.lit(None).alias("_row"), "_match")
    merged = lefts.unionByName(rights)
    found = scan(merged, by, ["_t", "_side", "_tie"], [Running("_found", "last", F.col("_match"))])
    return found.where("_side = 1").select("_row.*", *[F.col(f"_found.{c}").alias(c) for c in take])


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows `n` per distinct value. Kept in the scratch folder: what follows reads it several
    times, and it is as a rule far smaller than its input, which is then scanned once."""
    return materialize(df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n")), "counts")


def prefix_counts(counted: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Add to value counts the rows up to and including each value, `upto`."""
    return scan(counted, by, [value], [Running("upto", "sum", F.col("n"))])


def nth_row(df: DataFrame, order: Sequence[str], k: int) -> tuple:
    """Order key of the k-th row (from 1) in ascending order, found by narrowing down one column
    at a time over pre-aggregated counts, so the rows are never sorted as a whole."""
    found: list = []
    for column in order:
        hit = (prefix_counts(value_counts(df, column), column).where((F.col("upto") >= k) & (F.col("upto") - F.col("n") < k))
               .first())
        found.append(hit[column])
        k -= hit["upto"] - hit["n"]
        df = df.where(F.col(column).eqNullSafe(F.lit(hit[column])))
    return tuple(found)


def exact_quantiles(df: DataFrame, value: str, shares: Sequence[float],
                    by: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles of a column as an array `quantiles`, per `by` group.

    `percentile` keeps every distinct value of a group in one task; here the values stay spread
    and only the two rows around each rank are picked out. Nulls do not count.
    """
    return quantiles_of_counts(value_counts(df, value, by), value, shares, by)


def quantiles_of_counts(counted: DataFrame, value: str, shares: Sequence[float],
                        by: Sequence[str] = ()) -> DataFrame:
    """The same from value counts."""
    known = counted.where(F.col(value).isNotNull())
    ranked = prefix_counts(known, value, by)
    totals = known.groupBy(*by).agg(F.sum("n").alias("_n"))
    if by:
        ranked = ranked.join(totals, list(by))
    else:
        ranked = ranked.withColumn("_n", F.lit(totals.first()[0]))
    picks = []
    for i, share in enumerate(shares):
        at = F.lit(float(share)) * (F.col("_n") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            inside = (F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank)
            picks.append(F.max(F.when(inside, F.col(value).cast("double"))).alias(f"_{side}{i}"))
    picked = ranked.groupBy(*by).agg(F.max("_n").alias("_n"), *picks)
    values = []
    for i, share in enumerate(shares):
        at = F.lit(float(share)) * (F.col("_n") - 1)
        values.append(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (at - F.floor(at)))
    return picked.select(*by, F.array(*values).alias("quantiles"))
