"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.llm.common import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first())


def components(links: DataFrame, a: str, b: str, max_rounds: int = 200) -> DataFrame:
    """(node, root) for every node of `links`; root is the smallest node of the component.

    Each round replaces the edges by edges to the smallest neighbour, first of larger neighbours,
    then of smaller ones; the table of edges never grows beyond the number of links. Neighbours are
    met by joins on the node and minima are combined before the shuffle, so a node with very many
    links is never gathered in one task. Each round is written to the shared folder. Null ends and
    loops are ignored; no links give no rows.
    """
    edges = materialize(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges")
    seen = _state(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are written before they are joined back: a join of two plain shuffles can split a hot node.
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = materialize(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        kept = large.join(low, "u")
        small = (kept.select("u", F.col("m").alias("v"))
                 .unionByName(kept.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        edges = materialize(small, "edges")
        now = _state(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())
