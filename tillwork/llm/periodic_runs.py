"""Runs of periodic repetition among the words of a text, from an enhanced suffix array.

A run of smallest period q ends with a square (a stretch of q words, twice) whose next word breaks the
period. The two halves are suffixes that agree in exactly q words, so they lie in different children of
one LCP interval of depth q: a branching tandem. Every interval is split into two parts at each place
where its depth is the LCP; for the suffixes i of the smaller part the inverse suffix array says whether
i + depth or i - depth lies in the other part. That is O(n log n) tests and needs no tree: intervals are
found bottom-up from the LCP array with a stack. Squares are then rotated to the left as far as the
period goes, which gives the run, and squares that only repeat a shorter period are merged into it.

The suffix array is sorted by prefix doubling for a slice of many texts at once: the number of the text
is the first sort key and a mark no other word equals ends each text, so texts never meet.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.llm.common import send_by_value

SLICE_BYTES = 2 << 20
TESTS_AT_ONCE = 1 << 21
MIN_LENGTH, MIN_EXPONENT = 6, 4


def suffix_array(text_of: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix array, ranks by prefixes of 1, 2, 4, ... words). A rank is the place of the first suffix
    with the same prefix, so only suffixes that still tie are sorted again. `codes` must hold a code of
    its own at the end of each text."""
    n = len(codes)
    key = text_of * (int(codes.max(initial=0)) + 1) + codes
    order = np.argsort(key)
    place = np.arange(n)
    ranks: list[np.ndarray] = []
    tied, suffixes, sorted_key, width = place, order, key[order], 1
    order = order.copy()
    rank = np.zeros(n, np.int32)
    while True:
        opens = np.ones(len(tied), bool)
        opens[1:] = sorted_key[1:] != sorted_key[:-1]
        rank = rank.copy()
        rank[suffixes] = tied[np.maximum.accumulate(np.where(opens, np.arange(len(tied)), 0))] if len(tied) else 0
        ranks.append(rank)
        again = ~(opens & np.append(opens[1:], True))
        tied, suffixes = tied[again], suffixes[again]
        if not len(tied):
            return order, ranks
        sorted_key = rank[suffixes].astype(np.int64) * (n + 1) + rank[suffixes + width]
        o = np.argsort(sorted_key)
        suffixes, sorted_key = suffixes[o], sorted_key[o]
        order[tied] = suffixes
        width *= 2


def lcp_array(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Words that each suffix shares with the one before it in the array; 0 for the first."""
    lcp = np.zeros(len(order), np.int64)
    at = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]]) + 1
    left, right = order[at - 1].astype(np.int64), order[at].astype(np.int64)
    shared = np.zeros(len(at), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        same = ranks[k][left + shared] == ranks[k][right + shared]
        shared[same] += 1 << k
    lcp[at] = shared
    return lcp


def lcp_intervals(lcp: list[int]) -> list[tuple[int, int, int, int]]:
    """Places where the LCP intervals of one text split: (depth, first, middle, past). Suffixes
    first..middle-1 and middle..past-1 of the array agree in exactly `depth` words across the middle.
    An interval with c children splits at c - 1 places, each time from all children before."""
    found, stack = [], []       # stack of (depth, first suffix of the interval, middle)
    for at in range(1, len(lcp) + 1):
        depth, first = (lcp[at] if at < len(lcp) else 0), at - 1
        while stack and stack[-1][0] >= depth:
            d, first, middle = stack.pop()
            found.append((d, first, middle, at))
        if depth:
            stack.append((depth, first, at))
    return found


def branching_tandems(order: np.ndarray, place: np.ndarray, splits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every square whose halves agree in exactly `period` words."""
    depth, first, middle, past = splits.T
    left = middle - first <= past - middle
    low, high = np.where(left, first, middle), np.where(left, middle, past)         # the smaller part
    other_low, other_high = np.where(left, middle, first), np.where(left, past, middle)
    sizes = high - low
    ends = np.cumsum(sizes)
    starts, periods = [], []
    begin = 0
    while begin < len(sizes):
        done = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, done + TESTS_AT_ONCE, side="right")))
        part = np.repeat(np.arange(begin, stop), sizes[begin:stop])
        within = np.arange(len(part)) - (ends[part] - sizes[part] - done)
        suffix, d = order[low[part] + within], depth[part]
        ahead = place[suffix + d]
        hit = (ahead >= other_low[part]) & (ahead < other_high[part])
        starts.append(suffix[hit])
        periods.append(d[hit])
        # Before the first word of the slice there is nothing; place 0 belongs to a mark, never to a part.
        behind = np.where(suffix >= d, place[np.maximum(suffix - d, 0)], 0)
        hit = (behind >= other_low[part]) & (behind < other_high[part])
        starts.append(suffix[hit] - d[hit])
        periods.append(d[hit])
        begin = stop
    return np.concatenate(starts or [np.zeros(0, np.int64)]), np.concatenate(periods or [np.zeros(0, np.int64)])


def rotate(codes: np.ndarray, first: int, start: int, period: int) -> int:
    """The leftmost start from which words `period` apart stay identical up to `start`."""
    step = 32
    while start > first:
        low = max(first, start - step)
        differ = np.flatnonzero(codes[low:start] != codes[low + period:start + period])
        if len(differ):
            return low + int(differ[-1]) + 1
        start, step = low, min(2 * step, 1 << 16)
    return first


def runs_of(codes: np.ndarray, bounds: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """Rows (text, start, length, period) of the runs in texts laid end to end, by text, start and
    period. `bounds` are the texts' first words and the end of the last; start counts from the text's
    first word. At least 2 periods must be asked for."""
    if min_exponent < 2:
        raise ValueError("a run repeats its period at least twice")
    texts = len(bounds) - 1
    lengths = np.diff(bounds)
    # Texts with a mark at the end of each: code 0, as codes of words are shifted by one.
    marked = np.zeros(len(codes) + texts, np.int64)
    text_of = np.repeat(np.arange(texts), lengths + 1)
    is_word = np.ones(len(marked), bool)
    is_word[bounds[1:] + np.arange(texts)] = False
    marked[is_word] = codes + 1
    first_of = bounds[:-1] + np.arange(texts)
    order, ranks = suffix_array(text_of, marked)
    lcp = lcp_array(order, ranks)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    del ranks
    # A run of period q has two suffixes that share its length less q: texts without so long a repeat have none.
    least = min(max(min_length - q, (min_exponent - 1) * q) for q in range(1, max(min_length, 2)))
    splits = []
    for t in np.unique(text_of[order[lcp >= least]]).tolist():
        low, n = int(first_of[t]), int(lengths[t])
        for depth, first, middle, past in lcp_intervals(lcp[low:low + n + 1].tolist()):
            if depth * min_exponent <= n:
                splits.append((depth, low + first, low + middle, low + past))
    if not splits:
        return np.zeros((0, 4), np.int64)
    start, period = branching_tandems(order, place, np.array(splits, np.int64))
    end, text = start + 2 * period, text_of[start]
    head = end - np.maximum(min_exponent * period, min_length)      # a run reaches back to here at least
    fits = head >= first_of[text]
    start, period, end, text, head = (a[fits] for a in (start, period, end, text, head))
    likely = (marked[head] == marked[head + period]) & ((head >= start) | (marked[start - 1] == marked[start - 1 + period]))
    start, period, end, text = (a[likely] for a in (start, period, end, text))
    found: list[tuple[int, int, int, int]] = []
    here, kept = -1, []                                              # the runs that end at `here`
    for k in np.lexsort((period, end)).tolist():
        s, q, e, t = int(start[k]), int(period[k]), int(end[k]), int(text[k])
        if e != here:
            here, kept = e, []
        # A square of a multiple of a shorter period, inside that run, is part of it.
        if any(q % p == 0 and 2 * q <= length for p, length in kept):
            continue
        begin = rotate(marked, int(first_of[t]), s, q)
        kept.append((q, e - begin))
        if e - begin >= max(min_length, min_exponent * q):
            found.append((t, begin - int(first_of[t]), e - begin, q))
    return np.array(sorted(found, key=lambda r: (r[0], r[1], r[3])), np.int64).reshape(-1, 4)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words, bounds of each text's words). Words are what is between runs of the six ASCII blanks."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat, offsets = parts.flatten(), np.asarray(parts.offsets, np.int64)
    real = np.asarray(pc.binary_length(flat)) > 0
    counts = np.concatenate([[0], np.cumsum(real)])
    return flat.filter(pa.array(real)), counts[offsets - offsets[0]]


def _slices(texts: pa.Array):
    """Row ranges of about SLICE_BYTES of text; a longer text is a range of its own."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    first = 0
    while first < len(ends):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + SLICE_BYTES, side="right")))
        yield first, last
        first = last


def _find(min_length: int, min_exponent: int):
    row_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first, last in _slices(texts):
                words, bounds = _words(texts.slice(first, last - first))
                codes = np.asarray(words.dictionary_encode().indices, np.int64)
                found = runs_of(codes, bounds, min_length, min_exponent)
                # Words of a run after its first period go.
                edge = np.zeros(len(codes) + 1, np.int64)
                begin = bounds[found[:, 0]] + found[:, 1]
                np.add.at(edge, begin + found[:, 3], 1)
                np.add.at(edge, begin + found[:, 2], -1)
                keep = np.cumsum(edge[:-1]) == 0
                left = np.concatenate([[0], np.cumsum(keep)])[bounds]
                kept = pa.LargeListArray.from_arrays(pa.array(left, pa.int64()), words.filter(pa.array(keep)))
                upto = np.searchsorted(found[:, 0], np.arange(last - first + 1))
                rows = pa.StructArray.from_arrays([pa.array(found[:, c]) for c in (1, 2, 3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, last - first), pa.array(np.diff(bounds)),
                     pa.ListArray.from_arrays(pa.array(upto, pa.int32()), rows).cast(row_type),
                     pc.binary_join(kept, pa.scalar(" ", pa.large_string())).cast(pa.string())],
                    ["id", "n_words", "runs", "collapsed"])
    return run


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
              min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """One row per input row: id, n_words, `runs` (array of start, length, period, by start and period)
    and `collapsed`, the words that remain when each run keeps its first period, joined by one space.

    A run is a stretch of words with smallest period q, `min_exponent` periods and `min_length` words
    long at least, that no neighbouring word extends. Words are what lies between the six ASCII blanks;
    null and empty texts have none. Nothing but the id and the text is read, so clashing names of other
    columns do not matter; repeated rows are judged each for itself. Rows are never moved. A text is
    handled whole in its task with some 30 to 150 bytes a word, the more the longer its repeats.
    """
    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shape = (f"id {held.schema['id'].dataType.simpleString()}, n_words long, "
             "runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return held.mapInArrow(_find(min_length, min_exponent), shape).withColumnRenamed("id", id_col)


def longest(runs: Column) -> Column:
    """The longest of an array of runs (of equals the earliest, then the shortest period), or null."""
    return F.get(F.array_sort(F.transform(runs, lambda r: F.struct(
        (-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), F.lit(0))


send_by_value(sys.modules[__name__])
