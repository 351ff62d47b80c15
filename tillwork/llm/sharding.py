"""Sharding by a permutation-filled lookup table, in DataFrame functions only.

Each shard has a preference order over the slots of a prime-sized table, a permutation given by an
offset and a step. Shards take turns; in its turn a shard claims the first free slot it prefers. A key
goes to the shard of the slot its hash falls in. Slots are spread evenly over shards, and adding or
removing a shard moves few slots beyond its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# At least a hundred slots per shard keep shards within a few per cent of each other.
DEFAULT_SLOTS = 2039
MOST_SLOTS = 16_381     # filling looks at slots x slots places in one task


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def key_hash(key: Column, salt: str = "") -> Column:
    """32 bits of a digest, as a long; null counts as the empty string."""
    text = F.concat(F.lit(salt), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def lookup_table(shards: DataFrame, name_col: str = "shard", slots: int = DEFAULT_SLOTS) -> DataFrame:
    """(slot, shard): every slot of the table. Turns go by shard name; null and repeated names are
    left out. `shards` must be at most `slots` many: the table is one row until it is laid out."""
    if not is_prime(slots) or slots > MOST_SLOTS:
        raise ValueError(f"slots must be a prime up to {MOST_SLOTS}")
    names = shards.select(F.col(name_col).cast("string").alias("name")).where("name is not null").distinct()
    names = names.limit(slots + 1)      # one row beyond the bound is enough to refuse
    order = names.agg(F.array_sort(F.collect_list(F.struct(
        "name", (key_hash(F.col("name"), "offset|") % slots).cast("int").alias("offset"),
        (key_hash(F.col("name"), "step|") % (slots - 1) + 1).cast("int").alias("step")))).alias("shards"))
    order = order.select("shards", F.size("shards").alias("n")).where("n > 0").select(
        F.when(F.col("n") <= slots, F.col("shards")).otherwise(F.raise_error(F.lit("more shards than slots"))).alias("shards"), "n")

    places = F.sequence(F.lit(0), F.lit(slots - 1))

    def slot(shard: Column, k: Column) -> Column:
        return ((shard["offset"].cast("long") + k.cast("long") * shard["step"]) % slots).cast("int")

    def turn(taken: Column, t: Column) -> Column:
        at = t % F.greatest(F.col("n"), F.lit(1))      # also evaluated where no shard is left
        shard = F.get("shards", at)
        free = F.get(F.filter(places, lambda k: F.get(taken, slot(shard, k)) < 0), F.lit(0))
        # An array of one element binds the claimed slot, so that it is found once and not at every place.
        return F.get(F.transform(F.array(slot(shard, free)), lambda claimed: F.transform(
            taken, lambda old, s: F.when(s == claimed, at).otherwise(old))), F.lit(0))

    filled = order.select("shards", F.aggregate(places, F.array_repeat(F.lit(-1), slots), turn).alias("slots"))
    return filled.select("shards", F.posexplode("slots").alias("slot", "at")).select("slot", F.get("shards", F.col("at"))["name"].alias("shard"))


def assign(rows: DataFrame, table: DataFrame, key_col: str, slots: int = DEFAULT_SLOTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns `keep`, slot and shard for every row; equal keys share a shard. The table has `slots`
    rows, which bounds the broadcast. A null key is the empty key; no shards give null."""
    held = rows.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], (key_hash(F.col(key_col)) % slots).cast("int").alias("slot"))
    return held.join(F.broadcast(table), "slot", "left").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "slot", "shard")
