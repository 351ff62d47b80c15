"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every `window` consecutive words the smallest hash of their k-grams is kept, in documents and
items alike, so every shared span of `window` words leaves a shared fingerprint. Fingerprints are
joined; documents with a shared one are looked at again: each place of a shared k-gram gives an
alignment of document and item, and the alignment is extended to all windows that agree word by word.
Items shorter than a window are windows themselves and are met by the hash of all their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.llm.common import UPPER, LOWER, count_at_most, materialize, row_key

# Fingerprints (8 bytes each) and document keys (32 bytes each) up to which a side is broadcast;
# beyond it the join shuffles.
BROADCAST_ROWS = 200_000
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def word_list(text: Column) -> Column:
    """Words of a text after A-Z is lower-cased; null gives none."""
    folded = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(folded, F.lit("")), _NOT_WORD), "")


def _gram_hashes(words: str, k: int, salt: int | None = None) -> Column:
    """Hash of the k-gram at each position of a column of words."""
    n = F.greatest(F.size(words) - (k - 1), F.lit(0))
    seed = [] if salt is None else [F.lit(salt)]
    return F.transform(F.slice(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(1), n), lambda i: F.xxhash64(*seed, F.slice(words, i, k)))


def _anchors(df: DataFrame, key: str, k: int, window: int, salt: int | None = None) -> DataFrame:
    """(key, pos, print, length, left, around): each k-gram with the words that windows around it can
    reach, `left` of them before it. A row holds those words only, however long the text is."""
    reach = window - k
    n = F.greatest(F.size("words") - (k - 1), F.lit(0))
    seed = [] if salt is None else [F.lit(salt)]

    def anchor(i):
        left = F.least(i - 1, F.lit(reach))
        return F.struct((i - 1).alias("pos"), F.xxhash64(*seed, F.slice("words", i, k)).alias("print"), left.alias("left"),
                        F.slice("words", i - left, left + k + reach).alias("around"))

    grams = F.transform(F.slice(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(1), n), anchor)
    return df.select(key, F.explode_outer(grams).alias("a")).where("a is not null").select(key, "a.*", F.lit(window).alias("length"))


def _with_minima(df: DataFrame, hashes: str, width: int) -> DataFrame:
    """Column `hashes` replaced by the distinct minima of each `width` neighbours, by doubling: of 2,
    of 4, ... Each step is a projection of its own, since it looks at the step before twice. The last
    few windows are cut short by the end of the text, which adds fingerprints and loses none."""
    covered = 1
    while covered < width:
        step = min(covered, width - covered)
        df = df.withColumn(hashes, F.zip_with(hashes, F.slice(hashes, step + 1, F.size(hashes)), lambda a, b: F.least(a, b)))
        covered += step
    return df.withColumn(hashes, F.array_distinct(hashes))


def _fit(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if count_at_most(df, BROADCAST_ROWS) else df


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
                  item_text_col: str = "text", window: int = 10, k: int = 5) -> DataFrame:
    """One row per input row: id, n_words, n_hit (words inside an occurrence of a window of an item),
    n_items (items with such windows), item_ids (sorted strings), contaminated.

    Null texts have no words; an item without words has no window. A null item id counts as the
    empty string; rows that repeat an item id count once. Rows that repeat a document id are judged
    on their own texts. Empty tables give no rows, or no hits. Other columns are not read.
    """
    rows, verdict = _judged(docs, items, id_col, text_col, item_id_col, item_text_col, window, k)
    return rows.join(verdict, "row", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.col("n_hit").isNotNull().alias("contaminated"))


def _judged(docs, items, id_col, text_col, item_id_col="item_id", item_text_col="text", window=10, k=5) -> tuple[DataFrame, DataFrame]:
    """(id, row, n_words) of every row, and (row, n_hit, n_items, item_ids) of the keys of contaminated rows."""
    if not 1 <= k <= window:
        raise ValueError("k must lie between 1 and the window")
    width = window - k + 1
    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = (items.select(F.coalesce(F.col(item_id_col).cast("string"), F.lit("")).alias("item_id"), word_list(F.col(item_text_col)).alias("item_words"))
             .withColumn("size", F.size("item_words")).where("size > 0"))
    known = materialize(known, "items").withColumn("item", F.xxhash64("item_id", "item_words"))
    lengths = sorted(r[0] for r in known.where(F.col("size") < window).select("size").distinct().collect())   # below `window` many

    full = known.where(F.col("size") >= window).select("item", F.col("item_words").alias("words"))
    minima = _with_minima(full.select("item", _gram_hashes("words", k).alias("hashes")), "hashes", width).select("item", F.explode_outer("hashes").alias("print"))
    places = _anchors(full, "item", k, window).join(minima, ["item", "print"], "left_semi")
    for n in lengths:
        short = known.where(F.col("size") == n).select("item", F.col("item_words").alias("words"))
        places = places.unionByName(_anchors(short, "item", n, n, n))
    # Places of one item with the same surroundings are one, so a repeated word does not multiply them.
    places = materialize(places.drop("pos").distinct(), "prints")

    suspect = _suspects(held, places.select("print").distinct(), lengths, window, k, width)
    found = materialize(held.select(row_key(F.col("id"), F.col("text")).alias("row"), "text").join(_fit(suspect), "row", "left_semi")
                        .dropDuplicates(["row"]).select("row", word_list(F.col("text")).alias("words")), "suspects")

    spread = _anchors(found, "row", k, window)
    for n in lengths:
        spread = spread.unionByName(_anchors(found, "row", n, n, n))
    met = spread.join(_fit(places.withColumnRenamed("left", "item_left").withColumnRenamed("around", "item_around")), ["print", "length"])

    # Extension: every window around the shared k-gram that agrees word by word.
    def agrees(back):
        mine = F.slice("around", F.greatest(F.col("left") - back + 1, F.lit(1)), F.col("length"))
        theirs = F.slice("item_around", F.greatest(F.col("item_left") - back + 1, F.lit(1)), F.col("length"))
        return (back <= F.col("left")) & (back <= F.col("item_left")) & (F.size(mine) == F.col("length")) & (mine == theirs)

    steps = F.filter(F.sequence(F.lit(0), F.lit(window - k)), agrees)
    hits = materialize(met.select("row", "item", "length", "pos", F.explode_outer(steps).alias("back")).where("back is not null")
                       .select("row", "item", (F.col("pos") - F.col("back")).alias("start"), "length").distinct(), "hits")

    words_hit = (hits.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("word")).distinct()
                 .groupBy("row").agg(F.count(F.lit(1)).alias("n_hit")))
    names = (hits.select("row", "item").distinct().join(known.select("item", "item_id").distinct(), "item").select("row", "item_id").distinct()
             .groupBy("row").agg(F.count(F.lit(1)).alias("n_items"), F.array_sort(F.collect_set("item_id")).alias("item_ids")))
    verdict = words_hit.join(names, "row")
    rows = held.select("id", row_key(F.col("id"), F.col("text")).alias("row"),
                       F.coalesce(F.regexp_count("text", F.lit(_RAW_WORD)), F.lit(0)).cast("long").alias("n_words"))
    return rows, verdict


def _suspects(held, prints, lengths, window, k, width) -> DataFrame:
    """Keys of the documents that share a fingerprint with an item."""
    # The key is made before fingerprints are laid out in rows, so that a row carries no text.
    own = held.select(row_key(F.col("id"), F.col("text")).alias("row"), word_list(F.col("text")).alias("words"))
    own = own.select("row", "words", _gram_hashes("words", k).alias("hashes"))
    own = _with_minima(own, "hashes", width)
    for n in lengths:
        own = own.withColumn("hashes", F.concat("hashes", F.array_distinct(_gram_hashes("words", n, n))))
    # explode_outer: for explode Spark adds a filter on the array's size and pushes it down through the
    # projections above, where it would repeat their expressions many times over.
    spread = own.select("row", F.explode_outer("hashes").alias("print"))
    return materialize(spread.join(_fit(prints), "print", "left_semi").select("row").distinct(), "suspect-rows")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without any hit, with their columns. Rows that share an id, or have none, are
    judged each by its own text."""
    _, verdict = _judged(docs, items, id_col, text_col)
    bad = _fit(materialize(verdict.select("row"), "contaminated"))
    return docs.join(bad, row_key(docs[id_col], docs[text_col]) == bad["row"], "left_anti")
