"""Exact duplicates of long texts through content-defined chunk recipes.

Texts are cut where a rolling hash of the last 16 bytes says so, so equal texts get equal cuts.
Chunks are deduplicated to identifiers that are checked against the chunk bytes, a text becomes the
ordered list of its identifiers, and texts are compared by those lists: the text itself is never
shuffled, each chunk at most once per task.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.llm.common import MOST_KEYS, materialize, send_by_value, small, text_slices

_GEAR = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(29)).astype(np.uint32)
WINDOW = 16


def cut_points(data: np.ndarray, offsets: np.ndarray, bits: int, least: int, most: int) -> list[list[int]]:
    """Chunk ends of each text in `data`. A cut needs `bits` zero bits of the hash of the 16 bytes
    before it and lies `least` to `most` bytes after the cut before; `least` covers the window, so
    a cut depends on its own text only."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint32(step)
        h = h + shifted
    marks = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1
    bounds = np.searchsorted(marks, offsets)
    cuts = []
    for i in range(len(offsets) - 1):
        begin, end = int(offsets[i]), int(offsets[i + 1])
        found, at = [], begin
        for mark in marks[bounds[i]:bounds[i + 1]].tolist():
            while mark - at > most:
                at += most
                found.append(at)
            if mark - at >= least and mark < end:
                found.append(mark)
                at = mark
        while end - at > most:
            at += most
            found.append(at)
        if end > at:
            found.append(end)
        cuts.append(found)
    return cuts


def _digest(chunk: bytes, size: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()[:size]


def _chunk_rows(bits, least, most, size) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in batches:
            for _, _, data, offsets in text_slices(batch, "text"):
                raw, seen = data.tobytes(), {}
                for i, ends in enumerate(cut_points(data, offsets, bits, least, most)):
                    at = int(offsets[i])
                    for end in ends:
                        chunk = raw[at:end]
                        seen[chunk] = None
                        at = end
                chunks = list(seen)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_digest(c, size) for c in chunks], pa.binary()), pa.array(chunks, pa.binary())], ["digest", "chunk"])
    return run


def _recipe_rows(bits, least, most, size, whole: bool):
    """`whole` keeps the chunks themselves next to their digests."""
    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("id"))
            for first, last, data, offsets in text_slices(batch, "text"):
                raw, recipes, shas = data.tobytes(), [], []
                for i, ends in enumerate(cut_points(data, offsets, bits, least, most)):
                    at, recipe = int(offsets[i]), []
                    shas.append(hashlib.sha256(raw[at:int(offsets[i + 1])]).hexdigest())
                    for end in ends:
                        recipe.append({"digest": _digest(raw[at:end], size), "chunk": raw[at:end]} if whole
                                      else _digest(raw[at:end], size))
                        at = end
                    recipes.append(recipe)
                kind = pa.struct([("digest", pa.binary()), ("chunk", pa.binary())]) if whole else pa.binary()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, last - first), pa.array(recipes, pa.list_(kind)), pa.array(shas, pa.string())],
                    ["id", "recipe", "text_sha256"])
    return run


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None,
                     bits: int = 10, least: int = 256, most: int = 8192, digest_bytes: int = 16) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Equal texts (after `normalise`, if given) form a group; the largest id stays. A chunk's digest
    is its identifier once no other chunk bytes share it; for a digest that two chunks do share the
    bytes themselves are the identifier, so equality never rests on a digest. (`digest_bytes` is
    there for tests of that case.)

    Null texts count as empty; empty texts have the empty recipe and are equal. A null id is the
    smallest; rows that repeat an id and its text count in group_size and carry the same decision.
    An empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = docs.select(F.col(id_col).alias("id"), (normalise(text) if normalise else text).alias("text"))
    id_type = held.schema["id"].dataType.simpleString()
    cut = (bits, least, most, digest_bytes)

    chunks = held.select("text").mapInArrow(_chunk_rows(*cut), "digest binary, chunk binary").groupBy("digest", "chunk").agg(F.lit(1).alias("one"))
    shared = materialize(chunks.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "shared-digests")
    recipes = held.mapInArrow(_recipe_rows(*cut, False), f"id {id_type}, recipe array<binary>, text_sha256 string")
    if not shared.isEmpty():
        recipes = _with_bytes(held, cut, shared, id_type)
    recipes = materialize(recipes, "recipes")

    # Written first: the join then has a plain shuffle on both sides and can split a hot recipe.
    groups = materialize(recipes.groupBy("recipe").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
                         .where("group_size > 1").withColumnRenamed("recipe", "same"), "groups")
    joined = recipes.join(groups, recipes["recipe"] == groups["same"], "left")
    grouped = F.col("group_size").isNotNull()
    keep = F.when(grouped, F.col("keep_id")).otherwise(F.col("id"))
    return joined.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                         F.col("id").eqNullSafe(keep).alias("kept"), "text_sha256")


def _with_bytes(held, cut, shared, id_type) -> DataFrame:
    """Recipes in which a shared digest is replaced by the digest and the chunk's bytes."""
    row = F.monotonically_increasing_id()
    rows = materialize(held.mapInArrow(_recipe_rows(*cut, True), f"id {id_type}, recipe array<struct<digest:binary,chunk:binary>>, "
                                       "text_sha256 string").withColumn("row", row), "recipes-with-bytes")
    parts = rows.select("row", F.posexplode("recipe").alias("at", "part")).select("row", "at", "part.*")
    marked = parts.join(shared.withColumn("shared", F.lit(True)), "digest", "left")
    ident = F.when(F.col("shared"), F.concat("digest", "chunk")).otherwise(F.col("digest"))
    lists = marked.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", ident.alias("ident")))), lambda x: x["ident"]).alias("recipe"))
    return (rows.drop("recipe").join(lists, "row", "left")
            .select("id", F.coalesce("recipe", F.array().cast("array<binary>")).alias("recipe"), "text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with their columns. Of equal texts the row with the largest id stays,
    of rows that agree in id and text the one whose other columns have the largest digest, and of rows
    repeated whole one. Texts are not moved to find out, only keys and chunks are."""
    others = F.md5(F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col], F.lit(0).alias("end")), {"ignoreNullFields": "false"}))
    named = docs.select(F.struct(docs[id_col].isNotNull().alias("some"), docs[id_col].alias("id"), others.alias("others")).alias("id"),
                        docs[text_col].alias("text"))
    judged = exact_duplicates(named, "id", "text")
    listed = judged.groupBy("id.others", "text_sha256").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    listed = materialize(listed.where("n > 1 or not stays").select(F.col("others").alias("_others"), F.col("text_sha256").alias("_sha"), "stays"), "repeats")
    same = (others == listed["_others"]) & (F.sha2(F.coalesce(docs[text_col], F.lit("")), 256) == listed["_sha"])
    alone = docs.join(small(listed, MOST_KEYS), same, "left_anti")
    repeated = docs.join(small(listed.where("stays"), MOST_KEYS), same, "left_semi")
    once = "_once"
    while once in docs.columns:
        once += "_"
    return alone.unionByName(repeated.withColumn(once, others).dropDuplicates([once, text_col]).drop(once))


send_by_value(sys.modules[__name__])
