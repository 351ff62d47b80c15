"""Stateful steps of the feature stream. A key of the steps is a bucket of source partitions or cards, so
that what starting a key costs (a call, frames, a state handle) does not grow with the number of cards; the
state inside stays one small value per card. The rows of a bucket are handled in arrival order; the trigger
limit of the source bounds how many those are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MICROS = 1_000_000
COUNT_WINDOW, SUM_WINDOW = 300 * MICROS, 3600 * MICROS


INLINE_IDS = 200     # ids of a card held in its own value; more are filed by the hour


def _groups(keys: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[object, np.ndarray]]:
    """(key, places of its rows in order of arrival) of every key."""
    codes, names = pd.factorize(keys)
    order = np.lexsort((offsets, codes))
    starts = np.searchsorted(codes[order], np.arange(len(names) + 1))
    for k, name in enumerate(names):
        yield name, order[starts[k]:starts[k + 1]]


class LateTagger(StatefulProcessor):
    """Marks events older than the newest seen from their source partition by more than the
    allowed lateness. The comparison comes before the newest time advances."""

    def __init__(self, lateness_seconds: float):
        self.lateness = int(lateness_seconds * MICROS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "part array<long>, micros array<long>")

    def handleInputRows(self, key, rows, timerValues):
        frames = list(rows)
        part, offset, micros = (np.concatenate([f[c].to_numpy(np.int64) for f in frames]) for c in ("part", "offset", "micros"))
        seen = dict(zip(*(self.newest.get() or ((), ()))))
        late = np.zeros(len(part), bool)
        for name, at in _groups(part, offset):
            times, before = micros[at], seen.get(int(name), 0)
            running = np.maximum(np.maximum.accumulate(times), before)
            late[at] = times < np.concatenate([[before], running[:-1]]) - self.lateness
            seen[int(name)] = int(running[-1])
        self.newest.update((list(seen), list(seen.values())))
        start = 0
        for frame in frames:        # as they came, so that the wide rows are neither copied together nor sorted
            out = frame.drop(columns="_bucket", errors="ignore")
            out["is_late"] = late[start:start + len(frame)]
            start += len(frame)
            yield out

    def close(self) -> None:
        pass


def window_features(ts, amounts, at, held, last):
    """(count of five minutes, sum of an hour) for new transactions in order of arrival, and what is left
    in the window after them. `at` (ascending) and `held` are the times and amounts that are in it before;
    `last` is the newest time so far. Each row sees what has arrived up to itself, is not newer than itself
    and has not left the window, which moves with the newest time.

    Prefix sums over all rows by time count what lies in a range; of that, rows that arrive later are taken
    off again. Only rows that are not newer than one before them can be such, so the loop is over those.
    """
    newest = np.maximum.accumulate(ts) if last is None else np.maximum(np.maximum.accumulate(ts), last)
    low = newest - SUM_WINDOW
    times, values = np.concatenate([at, ts]), np.concatenate([held, amounts])
    order = np.argsort(times, kind="stable")
    times, values = times[order], values[order]
    upto = np.concatenate([[0], np.cumsum(values)])
    high, bottom = np.searchsorted(times, ts, "right"), np.searchsorted(times, low, "right")
    sums = upto[high] - upto[bottom]
    counts = high - np.maximum(np.searchsorted(times, ts - COUNT_WINDOW, "left"), bottom)
    for x in (np.flatnonzero(ts[1:] <= newest[:-1]) + 1).tolist():
        first = int(np.searchsorted(newest[:x], ts[x], "left"))
        early = (ts[first:x] >= ts[x]) & (low[first:x] < ts[x])
        sums[first:x] -= np.where(early, amounts[x], 0)
        counts[first:x] -= early & (ts[first:x] - COUNT_WINDOW <= ts[x])
    stays = times > newest[-1] - SUM_WINDOW
    return counts, sums, newest, times[stays], values[stays]


class CardFeatures(StatefulProcessor):
    """Drops repeats of a transaction and adds the card's window features. Late rows pass through
    untouched, without features, and leave the state alone.

    A card is one entry of a map. Its transaction ids, each with its time, are held in that entry while they
    are few; more are filed by the hour of their time, each hour an entry of its own, so that a batch does not
    rewrite a day of ids of a busy card. An hour is dropped as a whole once the card's newest time has passed
    all of its ids. An id blocks repeats up to `dedupe` after its own time, to the microsecond.
    """

    def __init__(self, dedupe_seconds: int, ttl_ms: int | None = None):
        self.dedupe, self.ttl = dedupe_seconds * MICROS, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cards = handle.getMapState("cards", "card string", "last long, countries array<string>, at array<long>, "
                                        "amount array<long>, ids array<string>, id_at array<long>, hours array<long>", self.ttl)
        self.seen = handle.getMapState("seen", "card string, hour long", "ids array<string>, at array<long>", self.ttl)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Start from history: last time, known countries, and the last hour's transactions."""
        for row in initialState.to_dict("records"):
            ordered = sorted(zip(row["recent_at"], row["recent_amount"], row["recent_id"]))
            ids = [(i, int(a)) for a, _, i in ordered]
            self._store(row["card_token"], int(row["last_micros"]), list(row["ip_countries"]), [int(a) for a, _, _ in ordered],
                        [round(v * MICROS) for _, v, _ in ordered], ids, [])

    def _passed(self, hour: int, last: int) -> bool:
        return (hour + 1) * SUM_WINDOW <= last - self.dedupe

    def _store(self, card, last: int, countries: list, at: list, held: list, ids: list[tuple[str, int]], hours: list[int]) -> None:
        """Write a card with the ids that still count; hours that have passed go."""
        ids = [(txn, t) for txn, t in ids if not self._passed(t // SUM_WINDOW, last)]
        for hour in hours:
            if self._passed(hour, last):
                self.seen.removeKey((card, hour))
        hours = [hour for hour in hours if not self._passed(hour, last)]
        if len(ids) > INLINE_IDS:
            added: dict[int, tuple[list[str], list[int]]] = {}
            for txn, t in ids:
                own = added.setdefault(t // SUM_WINDOW, ([], []))
                own[0].append(txn)
                own[1].append(t)
            for hour, (txns, times) in added.items():
                before = self.seen.getValue((card, hour)) if hour in hours else ((), ())
                self.seen.updateValue((card, hour), (list((before or ((), ()))[0]) + txns, list((before or ((), ()))[1]) + times))
            ids, hours = [], sorted({*hours, *added})
        self.cards.updateValue((card,), (last, countries, at, held, [txn for txn, _ in ids], [t for _, t in ids], hours))

    def _known(self, card, ids, times, hours) -> dict[str, int]:
        """Newest time of every id remembered."""
        known: dict[str, int] = {}
        for txns, at in [(ids, times), *((self.seen.getValue((card, hour)) or ((), ())) for hour in hours)]:
            for txn, t in zip(txns, at):
                known[txn] = max(t, known.get(txn, t))
        return known

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows), ignore_index=True).drop(columns="_bucket", errors="ignore")
        on_time = ~batch["is_late"].to_numpy(dtype=bool)
        micros, offsets = batch["micros"].to_numpy(np.int64), batch["offset"].to_numpy(np.int64)
        amounts = np.zeros(len(batch), np.int64)
        amounts[on_time] = np.rint(batch["amount"].to_numpy(float)[on_time] * MICROS).astype(np.int64)
        txns, named = batch["transaction_id"].to_numpy(object), batch["ip_country"].fillna("").to_numpy(object)
        keep = np.ones(len(batch), bool)
        counts, sums, gaps, news = (np.full(len(batch), np.nan) for _ in range(4))
        for card, places in _groups(batch["card_token"].to_numpy(object), offsets):
            places = places[on_time[places]]
            if not len(places):
                continue
            last, countries, at, held, ids, id_at, hours = self.cards.getValue((card,)) or (None, [], [], [], [], [], [])
            known, left, fresh = self._known(card, ids, id_at, hours), [], []
            for i, txn, t in zip(places.tolist(), txns[places], micros[places].tolist()):
                before = known.get(txn)
                if before is not None and t <= before + self.dedupe:
                    keep[i] = False
                else:
                    known[txn] = t
                    left.append((txn, t))
                    fresh.append(i)
            if not fresh:
                continue
            ts = micros[fresh]
            at, held = np.array(at, np.int64), np.array(held, np.int64)
            by_time = np.argsort(at, kind="stable")
            counts[fresh], total, newest, at, held = window_features(ts, amounts[fresh], at[by_time], held[by_time], last)
            sums[fresh] = total / MICROS
            before = np.concatenate([[ts[0] + 1 if last is None else last], newest[:-1]])
            gaps[fresh] = np.where(ts >= before, (ts - before) / MICROS, np.nan)
            visited = set(countries)
            for i in fresh:
                news[i] = bool(named[i] and visited and named[i] not in visited)
                if named[i]:
                    visited.add(named[i])
            self._store(card, int(newest[-1]), sorted(visited), at.tolist(), held.tolist(), [*zip(ids, id_at), *left], hours)
        out = batch[keep].reset_index(drop=True)
        out["card_txn_count_5m"] = pd.array(pd.Series(counts[keep]), dtype="Int64")
        out["card_amount_sum_1h"] = pd.array(sums[keep], dtype="Float64")
        out["seconds_since_last_card_txn"] = pd.array(gaps[keep], dtype="Float64")
        out["is_new_ip_country"] = pd.array(pd.Series(news[keep]).astype("Int64"), dtype="boolean") if len(out) else pd.array([], dtype="boolean")
        yield out

    def close(self) -> None:
        pass
