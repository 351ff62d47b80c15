"""Jaccard self-join on word n-grams: a size-aware heavy-light join, reported as components.

Two sets of sizes s and t with Jaccard similarity of at least theta share at least
ceil(theta / (1 + theta) * (s + t)) elements. Small sets enumerate their subsets of exactly that
many elements and meet in a subset they share; large sets meet in inverted lists of their rarest
elements. The boundary between the two is where the estimated cost of both is least. Every candidate
is verified on the whole sets.

How it stays linear on busy data:

* Equal sets are one class, represented once, so copies cost nothing further.
* Elements are dealt to buckets as packed arrays and counted there; the number of buckets grows with
  the number of elements, and each bucket is a task of its own. An element of one class only can
  never be shared, so only the others travel back, and a class whose shared elements are too few to
  reach theta * size is out. Lists are over the rarest elements of the rest, so a passage that very
  many documents share is hardly ever listed.
* Within a list each member is first held against one pivot, not against each other member. After
  the links so found are merged into components, only members of a list that are still apart are
  compared, and that is done for all of them: no list is cut, so no component is lost.
* A candidate is first held against a parity sketch of both sets, of fixed size, which never rejects a
  pair that links; only pairs it leaves are joined to their whole sets.
"""

from __future__ import annotations

import hashlib
import sys
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.llm.common import MOST_KEYS, materialize, mix, row_key, send_by_value, small, text_slices, word_hashes
from tillwork.llm.components import components

# Largest size for which subsets are ever enumerated; the cost decides below it.
SMALL_SIZE = 24
# Elements that a task gathers before it packs them by bucket (8 bytes each, a few copies at a time).
RUN_TOKENS = 1_500_000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_MULTIPLIERS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
# Elements aimed at for a bucket, and the most buckets the 16 bits of a hash can tell apart.
BUCKET_TOKENS = 4_000_000
MOST_BUCKETS = 1 << 16
# A bucket is counted in 2**RANGE_BITS ranges of its elements, one after the other.
RANGE_BITS = 3
SKETCH_BITS = 1024
_ID_BYTES = 12
_ONE = np.dtype(f"V{_ID_BYTES}")


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of each text; a text of fewer words has
    one element, the whole sequence; a text without words has none."""
    _, _, words, first = word_hashes(_FOLD[data], offsets, ~_SPACE)
    n = len(words)
    sums = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        sums += words[j:n - k + 1 + j] * _MULTIPLIERS[j] if len(sums) else sums
    grams = mix(sums)
    sets = []
    for i in range(len(offsets) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= k:
            sets.append(np.unique(grams[a:b - k + 1]))
        elif b > a:
            short = np.add.reduce(words[a:b] * _MULTIPLIERS[k:k + b - a], dtype=np.uint64) + np.uint64(b - a)
            sets.append(mix(np.array([short], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _set_id(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=_ID_BYTES).digest()


def _class_rows(k):
    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("id"))
            for first, last, data, offsets in text_slices(batch, "text"):
                sets = shingle_sets(data, offsets, k)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, last - first), pa.array([_set_id(s) for s in sets], pa.binary()),
                     pa.array([len(s) for s in sets], pa.int64())], ["id", "set_id", "n_shingles"])
    return run


def _pack(tokens: np.ndarray) -> bytes:
    """The upper 48 bits of each hash; the lower 16 are spent on the bucket."""
    return (tokens >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view(np.uint64)


def _parts(names: np.ndarray) -> np.ndarray:
    return names.view(np.uint32).reshape(-1, _ID_BYTES // 4)


def _sketch(tokens: np.ndarray) -> bytes:
    """For each of SKETCH_BITS remainders whether an odd number of elements has it. Two sketches differ
    in at most as many bits as there are elements in one set only."""
    return np.packbits((np.bincount((mix(tokens) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes()


def _bucket_rows(k, buckets):
    """Packed (classes, sizes, counts, elements) per bucket and run of texts. A class is sent once
    per task at most."""
    def packed(ids, sizes, sets):
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        bucket = ((tokens & np.uint64(0xFFFF)) * np.uint64(buckets) >> np.uint64(16)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        tokens, owner, edges = tokens[order], owner[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
        names, sizes, rows = np.array(ids, object), np.array(sizes, np.uint32), []
        for b in range(buckets):
            lo, hi = edges[b], edges[b + 1]
            if lo < hi:
                who, count = np.unique(owner[lo:hi], return_counts=True)
                rows.append((b, b"".join(names[who]), sizes[who].tobytes(), count.astype(np.uint32).tobytes(), _pack(tokens[lo:hi])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))],
                                          ["bucket", "classes", "sizes", "counts", "tokens"])

    def run(batches):
        sent, ids, sizes, sets, held = set(), [], [], [], 0
        for batch in batches:
            for _, _, data, offsets in text_slices(batch, "text"):
                for grams in shingle_sets(data, offsets, k):
                    name = _set_id(grams)
                    if len(grams) and name not in sent:
                        sent.add(name)
                        ids.append(name)
                        sizes.append(len(grams))
                        sets.append(grams)
                        held += len(grams)
                if held >= RUN_TOKENS:
                    yield packed(ids, sizes, sets)
                    ids, sizes, sets, held = [], [], [], 0
        if held:
            yield packed(ids, sizes, sets)
    return run


_PACKED = "bucket int, classes binary, sizes binary, counts binary, tokens binary"


def _shared_rows(buckets):
    """Count in how many classes each element of a bucket is; send the shared ones, with that count,
    to the bucket of their class."""
    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        names = np.frombuffer(b"".join(frame["classes"]), _ONE)
        sizes = np.frombuffer(b"".join(frame["sizes"]), np.uint32)
        counts = np.frombuffer(b"".join(frame["counts"]), np.uint32)
        tokens = np.empty(int(counts.sum(dtype=np.int64)), np.uint64)
        at = 0
        for raw in frame["tokens"]:
            tokens[at:at + len(raw) // 6] = _unpack(raw)
            at += len(raw) // 6
        _, keep = np.unique(_parts(names), axis=0, return_index=True)
        first = np.zeros(len(names), bool)
        first[keep] = True
        owner = np.repeat(np.arange(len(names), dtype=np.uint32), counts)
        once = first[owner]
        owners, found, dfs = [], [], []
        for r in range(1 << RANGE_BITS):
            mine = np.flatnonzero((tokens >> np.uint64(48 - RANGE_BITS) == np.uint64(r)) & once)
            order = mine[np.argsort(tokens[mine], kind="stable")]
            values = tokens[order]
            edge = np.flatnonzero(np.r_[True, values[1:] != values[:-1], True]) if len(values) else np.zeros(1, np.int64)
            df = np.repeat(np.diff(edge), np.diff(edge))
            owners.append(owner[order[df > 1]].astype(np.int64))
            found.append(values[df > 1] * np.uint64(buckets) + np.uint64(key[0]))
            dfs.append(df[df > 1].astype(np.uint32))
        del tokens, once
        owner, tokens, df = np.concatenate(owners), np.concatenate(found), np.concatenate(dfs)
        target = (_parts(names)[owner, 0] % np.uint32(buckets)).astype(np.int64)
        order = np.lexsort((owner, target))
        owner, tokens, df, target = owner[order], tokens[order], df[order], target[order]
        start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
        who, count, target = owner[start], np.diff(np.r_[start, len(owner)]), target[start]
        edges, rows = np.flatnonzero(np.r_[True, target[1:] != target[:-1], True]) if len(who) else np.zeros(1, np.int64), []
        ends = np.r_[start, len(owner)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            a, b = ends[lo], ends[hi]
            rows.append((int(target[lo]), names[who[lo:hi]].tobytes(), sizes[who[lo:hi]].tobytes(),
                         count[lo:hi].astype(np.uint32).tobytes(), tokens[a:b].tobytes(), df[a:b].tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "classes", "sizes", "counts", "tokens", "dfs"])
    return run


def need(size: int, num: int, den: int) -> int:
    """Elements a set of this size must share with any partner."""
    return -(-num * size // den)


def overlap(s: int, t: int, num: int, den: int) -> int:
    return -(-num * (s + t) // (num + den))


def subset_sizes(s: int, num: int, den: int) -> list[int]:
    """Overlaps that sets of size s need with partners of each possible size."""
    return sorted({o for t in range(need(s, num, den), s * den // num + 1) if (o := overlap(s, t, num, den)) <= min(s, t)})


def _survivor_rows(num, den):
    """Gather each class; keep it if its shared elements suffice. Elements sorted; `rare`: positions
    of the rarest, as many as the prefix has left after the elements nobody shares."""
    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        names = np.frombuffer(b"".join(frame["classes"]), _ONE)
        sizes = np.frombuffer(b"".join(frame["sizes"]), np.uint32).astype(np.int64)
        counts = np.frombuffer(b"".join(frame["counts"]), np.uint32).astype(np.int64)
        tokens = np.frombuffer(b"".join(frame["tokens"]), np.uint64)
        df = np.frombuffer(b"".join(frame["dfs"]), np.uint32)
        _, first, index = np.unique(_parts(names), axis=0, return_index=True, return_inverse=True)
        index = index.reshape(-1)
        total = np.bincount(index, weights=counts).astype(np.int64)
        stays = total >= -(-num * sizes[first] // den)
        owner = np.repeat(index, counts)
        mask = stays[owner]
        owner, tokens, df = owner[mask], tokens[mask], df[mask]
        order = np.argsort(owner, kind="stable")
        owner, tokens, df = owner[order], tokens[order], df[order]
        rows = []
        for c in np.flatnonzero(stays):
            lo, hi = np.searchsorted(owner, (c, c + 1))
            size, mine, often = int(sizes[first[c]]), tokens[lo:hi], df[lo:hi]
            order = np.argsort(mine)
            mine, often = mine[order], often[order]
            rare = np.lexsort((mine, often))[:len(mine) - need(size, num, den) + 1]
            rows.append((names[first[c]].tobytes(), size, mine.tobytes(), mine[rare].tobytes(),
                         float(often[rare].astype(np.float64).sum()), len(mine), _sketch(mine)))
        return pd.DataFrame(rows, columns=["class", "size", "tokens", "rare", "scan_cost", "held", "sketch"])
    return run


def _index_rows(boundary, num, den):
    """(key, class, size, rest): subsets of small sets, rarest elements of the others. Small sets that
    can be partners of larger ones are in both. rest: elements of the set from this one on in the order
    of rarity, which bounds what a pair can share if this is the first element it shares."""
    meets = need(boundary + 1, num, den)

    def run(frames):
        for frame in frames:
            keys, classes, sizes, rests = [], [], [], []
            for name, size, raw, rare in zip(frame["class"], frame["size"], frame["tokens"], frame["rare"]):
                own, rest = [], []
                if size <= boundary:
                    elements = np.frombuffer(raw, np.uint64)
                    for o in subset_sizes(size, num, den):
                        if o <= len(elements):
                            picks = np.array(list(combinations(range(len(elements)), o)))
                            sums = (elements[picks] * _MULTIPLIERS[:o]).sum(axis=1, dtype=np.uint64) + np.uint64(o)
                            own.append(mix(mix(sums) + np.uint64(1)))
                            rest.append(np.full(len(picks), size))
                if size > boundary or size >= meets:
                    own.append(np.frombuffer(rare, np.uint64))
                    rest.append(len(raw) // 8 - np.arange(len(rare) // 8))
                own = np.concatenate(own) if own else np.zeros(0, np.uint64)
                keys.append(own)
                rests.append(np.concatenate(rest) if rest else np.zeros(0, np.int64))
                classes += [name] * len(own)
                sizes += [size] * len(own)
            yield pd.DataFrame({"key": np.concatenate(keys).view(np.int64) if keys else [], "class": classes, "size": sizes,
                                "rest": np.concatenate(rests) if rests else []})
    return run


def _boundary(survivors: DataFrame, num: int, den: int) -> int:
    """The size up to which enumerating subsets costs less than scanning lists; sums over all sets."""
    seen = {r["size"]: r for r in survivors.where(F.col("size") <= SMALL_SIZE).groupBy("size")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("scan_cost").alias("cost")).collect()}
    best, at, balance = 0, 0, 0.0
    for size in range(1, SMALL_SIZE + 1):
        if size in seen:
            balance += seen[size]["n"] * sum(comb(size, o) for o in subset_sizes(size, num, den)) - seen[size]["cost"]
        if balance <= best:
            best, at = balance, size
    return at


def _possible(s, t, rest_s, rest_t, num, den):
    """Whether sets of these sizes can share enough if they first meet with so many elements left."""
    s, t, rest_s, rest_t = map(F.col, (s, t, rest_s, rest_t))
    return (F.least(s, t) * F.lit(den) >= F.greatest(s, t) * F.lit(num)) & (F.least(rest_s, rest_t) * F.lit(num + den) >= (s + t) * F.lit(num))


def _not_too_different(pairs: DataFrame, survivors: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sketches do not rule the similarity out."""
    @F.pandas_udf("int")
    def apart(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="int32")
        both = [np.frombuffer(b"".join(v), np.uint64).reshape(len(v), -1) for v in (x, y)]
        return pd.Series(np.bitwise_count(both[0] ^ both[1]).sum(axis=1).astype(np.int32))

    sets = survivors.select("class", "size", "held", "sketch")
    left = sets.toDF("a", "s", "m", "x")
    right = sets.toDF("b", "t", "n", "y")
    # Elements in one set only: at most what both hold, less twice the least overlap.
    most = (F.col("m") + F.col("n")) * F.lit(num + den) - F.lit(2 * num) * (F.col("s") + F.col("t"))
    return (pairs.select("a", "b").join(left, "a").join(right, "b")
            .where(apart("x", "y") * F.lit(num + den) <= most).select("a", "b"))


def _verify(pairs: DataFrame, survivors: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity."""
    @F.pandas_udf("boolean")
    def reached(x: pd.Series, y: pd.Series, s: pd.Series, t: pd.Series) -> pd.Series:
        found = []
        for a, b, m, n in zip(x, y, s, t):
            both = len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
            found.append(den * both >= num * (m + n - both))
        return pd.Series(found, dtype=bool)

    sets = survivors.select("class", "tokens", "size")
    left = sets.select(F.col("class").alias("a"), F.col("tokens").alias("x"), F.col("size").alias("s"))
    right = sets.select(F.col("class").alias("b"), F.col("tokens").alias("y"), F.col("size").alias("t"))
    pairs = _not_too_different(pairs, survivors, num, den)
    return pairs.join(left, "a").join(right, "b").where(reached("x", "y", "s", "t")).select("a", "b")


def linked_classes(docs: DataFrame, text_col: str, k: int, num: int, den: int, elements: int) -> DataFrame:
    """(node, root): components of linked sets; sets without links have no row. `elements`: of all
    distinct sets together, from which the number of buckets follows."""
    spark = docs.sparkSession
    # A bucket repeats the name of each class that has an element in it, so no more buckets are taken
    # than bound a task's memory and keep the cluster busy.
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")) // 4, 1)
    buckets = min(max(-(-elements // BUCKET_TOKENS), least), MOST_BUCKETS)
    packed = docs.select(F.col(text_col).alias("text")).mapInArrow(_bucket_rows(k, buckets), _PACKED)
    # Each bucket is its own partition; a hash of so few numbers would put several into one task.
    shared = packed.repartitionById(buckets, F.col("bucket")).groupBy("bucket").applyInPandas(_shared_rows(buckets), _PACKED + ", dfs binary")
    survivors = materialize(
        shared.repartitionById(buckets, F.col("bucket")).groupBy("bucket").applyInPandas(
            _survivor_rows(num, den), "class binary, size long, tokens binary, rare binary, scan_cost double, held long, sketch binary"), "sets")

    boundary = _boundary(survivors, num, den)
    index = materialize(survivors.select("class", "size", "tokens", "rare").mapInPandas(
        _index_rows(boundary, num, den), "key long, class binary, size long, rest long"), "lists")

    # The pivot of a list is the member with most elements left: of near copies, the least altered one.
    # Tables that are joined on the key of the lists are written first, so that a join of two plain
    # shuffles can split a long list.
    first = F.max(F.struct("rest", F.xxhash64("class", "key").alias("h"), F.col("class").alias("pivot"), F.col("size").alias("pivot_size")))
    pivots = materialize(index.groupBy("key").agg(first.alias("p"), F.count(F.lit(1)).alias("n")).where("n > 1")
                         .select("key", "p.pivot", "p.pivot_size", F.col("p.rest").alias("pivot_rest")), "pivots")
    pairs = materialize(
        index.join(pivots, "key").where((F.col("class") != F.col("pivot")) & _possible("size", "pivot_size", "rest", "pivot_rest", num, den))
        .select(F.least("class", "pivot").alias("a"), F.greatest("class", "pivot").alias("b")).distinct(), "pairs")
    links = materialize(_verify(pairs, survivors, num, den), "links")
    found = components(links, "a", "b")

    # Members of a list that are still apart: the rest of the list against its largest component.
    placed = materialize(index.join(found.withColumnRenamed("node", "class"), "class", "left")
                         .select("key", "class", "size", "rest", F.coalesce("root", "class").alias("root")), "placed")
    parts = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    most = materialize(parts.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots"))
                       .where("roots > 1").select("key", "main"), "mains")
    open_lists = materialize(placed.join(most, "key"), "open")
    others = open_lists.where("root != main").select("key", F.col("class").alias("c"), F.col("size").alias("z"), F.col("root").alias("r"), F.col("rest").alias("y"))
    apart = (open_lists.join(others, "key").where((F.col("root") != F.col("r")) & _possible("size", "z", "rest", "y", num, den))
             .select(F.least("class", "c").alias("a"), F.greatest("class", "c").alias("b")).distinct())
    more = materialize(_verify(apart.join(pairs, ["a", "b"], "left_anti"), survivors, num, den), "links")
    if more.isEmpty():
        return found
    return components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), "a", "b")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id reachable by links).

    Words are runs of bytes other than ASCII white space after A-Z is lower-cased. Null and empty
    texts have the empty set and are linked with nothing, not even with each other. Sets are compared
    through 64-bit hashes of their elements (of which the join keeps 48 bits and the bucket), equal sets
    through a 96-bit digest. A null id is ignored as a component's name unless all ids of the
    component are null; rows that repeat an id are separate rows. Other columns are not read; an empty
    table gives no rows.
    """
    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = held.schema["id"].dataType.simpleString()
    rows = materialize(held.mapInArrow(_class_rows(k), f"id {kind}, set_id binary, n_shingles long"), "set-ids")
    classes = rows.where("n_shingles > 0").groupBy("set_id").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    elements = rows.groupBy("set_id").agg(F.max("n_shingles").alias("n")).agg(F.sum("n")).first()[0] or 0
    found = linked_classes(held, "text", k, percent, 100, elements)

    linked = classes.join(found, classes["set_id"] == found["node"])
    names = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = linked.join(names, "root").select("set_id", "component_id")
    copies = classes.where("n > 1").join(linked, "set_id", "left_anti").select("set_id", F.col("first_id").alias("component_id"))
    # Written first, so that the join below has plain shuffles on both sides and can split a hot set.
    named = materialize(linked.unionByName(copies).withColumnRenamed("set_id", "same"), "names")
    joined = rows.join(named, rows["set_id"] == named["same"], "left")
    return joined.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """The rows of `docs` that name their component, with their columns: of linked documents that with the
    smallest id (null last), of rows that share that id the one with the smallest key of id and text. Rows
    that agree in id and text are one document and stay or go together. Documents without words stay."""
    key = row_key(docs[id_col], docs[text_col])
    named = docs.select(F.struct(docs[id_col].isNull().alias("none"), docs[id_col].alias("id"), key.alias("key")).alias("id"), docs[text_col].alias("text"))
    judged = jaccard_components(named, "id", "text", k, percent)
    gone = materialize(judged.where(F.col("id.key") != F.col("component_id.key")).select(F.col("id.key").alias("_gone")).distinct(), "similar")
    return docs.join(small(gone, MOST_KEYS), key == gone["_gone"], "left_anti")


send_by_value(sys.modules[__name__])
