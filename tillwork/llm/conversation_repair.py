"""Repair of the turn structure of conversations by weighted CYK parsing of row intervals.

A conversation ought to read `(s?(ua)+)?` by role initials: nothing, or pairs of user and assistant after
at most one system row. Edits cost: keep 0, rerole to user or assistant 2, delete 3 (the only choice for
blank and repeated rows), insert an empty user or assistant row anywhere 2; a truncated row that stays adds 1.

The repair grammar in Chomsky normal form has a nonterminal N(p,q) for each two of the four positions in
that pattern between which rows can lead: N(p,q) -> N(p,r) N(r,q), and N(p,q) -> row for each edit of a row
that leads from p to q, closed under insertions before and after it. A cell holds for each nonterminal the
least (cost, audit) of its interval, audits being the edits' initials in order. Cells are combined bottom-up
by the length of the interval, from all places where it can be cut.

Minima compose, since no audit of an interval is the beginning of another of the same cost (it could only
lack insertions). For the same reason every way to cut an interval gives one and the same cell, as
nonterminals are pairs of positions. So a long conversation is parsed in intervals of eight rows, these
eight at a time as the words of the next round, and so on: no task sees more than eight cells of a
conversation, and the rounds grow with the logarithm of the longest.
"""

from __future__ import annotations

import hashlib
import sys

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.llm.common import materialize, send_by_value
from tillwork.operators.ordered import Running, largest_group, scan

BLANKS = " \t\n\x0b\x0c\r"
FAN = 8                 # cells that one parse takes
MEMORY = 100_000        # parses a task remembers; a full memory starts anew
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

START, SYSTEM, USER, ASSISTANT = range(4)       # positions in the pattern, named by the row just read
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
LEGAL = ("su", "ua", "au")
NAMES = {"u": "user", "a": "assistant"}

# A row's symbol: its role initial (x if none of s, u, a), upper case if truncated, d if it must go.
Cell = dict[tuple[int, int], tuple[int, str]]


def _better(cell: Cell, pair, cost: int, audit: str) -> None:
    if pair not in cell or (cost, audit) < cell[pair]:
        cell[pair] = (cost, audit)


def combine(left: Cell, right: Cell, into: Cell | None = None) -> Cell:
    """N(p,q) -> N(p,r) N(r,q) for two neighbouring intervals."""
    into = {} if into is None else into
    for (p, r), (cost, audit) in left.items():
        for q in range(4):
            other = right.get((r, q))
            if other is not None:
                _better(into, (p, q), cost + other[0], audit + other[1])
    return into


def _insertions() -> Cell:
    """The empty interval: what insertions alone can do."""
    closed: Cell = {(p, p): (0, "") for p in range(4)}
    for _ in range(4):      # no two positions are further apart than that
        for (p, q), (cost, audit) in list(closed.items()):
            for letter in NAMES:
                if (q, letter) in STEPS:
                    _better(closed, (p, STEPS[q, letter]), cost + INSERT, audit + "I")
    return closed


INSERTIONS = _insertions()


def row_cell(symbol: str) -> Cell:
    """The interval of one row: its edits, and insertions around it."""
    edits: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if symbol != "d":
        extra = TRUNCATED if symbol.isupper() else 0
        for (p, letter), q in STEPS.items():
            if letter == symbol.lower():
                _better(edits, (p, q), KEEP + extra, "K")
            if letter in NAMES:
                _better(edits, (p, q), REROLE + extra, "R")
    return combine(combine(INSERTIONS, edits), INSERTIONS)


def parse(cells: list[Cell]) -> Cell:
    """The cell over all of `cells`: a CYK table filled by the length of the interval."""
    table = {(i, i + 1): cell for i, cell in enumerate(cells)}
    for length in range(2, len(cells) + 1):
        for i in range(len(cells) - length + 1):
            whole: Cell = {}
            for cut in range(i + 1, i + length):
                combine(table[i, cut], table[cut, i + length], whole)
            table[i, i + length] = whole
    return table[0, len(cells)] if cells else INSERTIONS


def cheapest(cell: Cell) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    return min(cell[pair] for pair in ((START, START), (START, ASSISTANT)) if pair in cell)


def _pack(cell: Cell) -> list[str | None]:
    return [None if (p, q) not in cell else f"{cell[p, q][0]}:{cell[p, q][1]}" for p in range(4) for q in range(4)]


def _unpack(packed: list[str | None]) -> Cell:
    cell: Cell = {}
    for k, held in enumerate(packed):
        if held is not None:
            cost, audit = held.split(":")
            cell[k // 4, k % 4] = (int(cost), audit)
    return cell


def _parse_symbols(batches):
    """Intervals of up to FAN symbol strings of up to FAN rows each."""
    known, solved = {}, {}
    for batch in batches:
        packed, costs, audits = [], [], []
        for symbols in batch.column(2).to_pylist():
            key = tuple(symbols)
            if key not in solved:
                if len(solved) >= MEMORY or len(known) >= MEMORY:
                    solved.clear()
                    known.clear()
                for part in key:
                    if part not in known:
                        known[part] = parse([row_cell(s) for s in part])
                cell = parse([known[part] for part in key])
                solved[key] = (_pack(cell), *cheapest(cell))
            cells, cost, audit = solved[key]
            packed.append(cells)
            costs.append(cost)
            audits.append(audit)
        yield _intervals(batch, packed, costs, audits)


def _parse_cells(batches):
    """Intervals of up to FAN cells."""
    for batch in batches:
        cells = [parse([_unpack(c) for c in packed]) for packed in batch.column(2).to_pylist()]
        best = [cheapest(c) for c in cells]
        yield _intervals(batch, [_pack(c) for c in cells], [c for c, _ in best], [a for _, a in best])


def _intervals(batch, packed, costs, audits) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), pa.array(packed, pa.list_(pa.string())), pa.array(costs, pa.int64()), pa.array(audits, pa.string())],
        ["conv", "part", "cells", "cost", "audit"])


def number_rows(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, place, initial, before, opens, fault), pinned: each row with its place in
    its conversation (from 1, by turn with nulls first, then role and text), the initial of the row
    before, whether it opens a turn, and its first fault (blank, duplicate, truncated or null)."""
    space = F.lit(" ")
    held = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), space).alias("role"),
                       F.coalesce(F.col(text_col), space).alias("text"))
    held = held.withColumn("initial", F.substring("role", 1, 1))
    largest = largest_group(held, ["conv"])      # no group of one role and text is larger
    placed = scan(held, ["conv"], ["turn", "role", "text"], largest=largest, outputs=[
        Running("place", "count", F.lit(1)), Running("before", "prev", F.col("initial")), Running("_turn", "prev", F.col("turn"))])
    same = scan(placed, ["conv", "role", "text"], ["place"], [Running("_copy", "count", F.lit(1))], largest=largest)
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = (F.when(body == "", "blank").when(F.col("_copy") > 1, "duplicate")
             .when(~F.substring(body, -1, 1).isin(".", "!", "?"), "truncated"))
    opens = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_turn"))
    return materialize(same.select("conv", "turn", "role", "text", "place", "initial", "before", opens.alias("opens"), fault.alias("fault")), "turns")


def diagnose(numbered: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation."""
    symbol = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    symbol = (F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(symbol)).otherwise(symbol))
    illegal = F.col("before").isNotNull() & ~F.concat("before", "initial").isin(*LEGAL)
    counts = {"blank": F.col("fault") == "blank", "duplicate": F.col("fault") == "duplicate", "truncated": F.col("fault") == "truncated",
              "illegal": illegal, "turns": F.col("opens")}
    block = F.floor((F.col("place") - 1) / FAN)
    blocks = numbered.groupBy("conv", block.alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", symbol.alias("symbol")))), lambda s: s["symbol"]), "").alias("symbols"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), *[F.count_if(c).alias(n) for n, c in counts.items()])
    parts = blocks.groupBy("conv", F.floor(F.col("block") / FAN).alias("part")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("block", "symbols"))), lambda s: s["symbols"]).alias("symbols"),
        F.min("low").alias("low"), F.max("high").alias("high"), *[F.sum(n).alias(n) for n in counts])
    parts = materialize(parts, "parts")
    most = parts.agg(F.max("part")).first()[0] or 0
    shape = f"conv {numbered.schema['conv'].dataType.simpleString()}, part long, cells array<string>, cost long, audit string"
    best = parts.select("conv", "part", "symbols").mapInArrow(_parse_symbols, shape)
    while most > 0:
        grouped = best.groupBy("conv", F.floor(F.col("part") / FAN).alias("part")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("part", "cells"))), lambda s: s["cells"]).alias("cells"))
        best = materialize(grouped.mapInArrow(_parse_cells, shape), "intervals")
        most //= FAN
    sums = parts.groupBy("conv").agg(F.min("low").alias("low"), F.max("high").alias("high"), *[F.sum(n).alias(n) for n in counts])
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    found = sums.withColumnRenamed("conv", "_conv").join(best, F.col("_conv").eqNullSafe(F.col("conv")))
    return found.select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _rebuild(batches):
    """Rows of conversations in order, each conversation headed by a row with its audit in `text`, to
    repaired rows. Only the audit and the row at hand are held."""
    conv, audit, at, place, last = None, "", 0, 0, START
    out: list[tuple] = []

    def step(initial: str) -> None:
        nonlocal last, place
        last = STEPS.get((last, initial), last)
        place += 1

    def insertions() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            initial = "a" if last == USER else "u"
            step(initial)
            out.append((conv, place, None, NAMES[initial], "", "I"))
            at += 1

    for batch in batches:
        for head, turn, role, text, number in zip(*[batch.column(i).to_pylist() for i in range(5)]):
            if number == 0:
                insertions()
                conv, audit, at, place, last = head, text, 0, 0, START
                continue
            insertions()
            edit = audit[at]
            at += 1
            if edit != "D":
                initial = role[:1] if edit == "K" else ("a" if last == USER else "u")
                step(initial)
                out.append((conv, place, turn, role if edit == "K" else NAMES[initial], text, edit))
        yield _rows(out, batch)
        out = []
    insertions()
    if out:
        yield _rows(out, batch)


def _rows(out: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
    columns = list(zip(*out)) or [()] * 6
    types = [like.schema.field(0).type, pa.int64(), like.schema.field(1).type, pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv", "place", "turn", "role", "text", "edit"])


def rebuild(numbered: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, place, turn, role, text, edit): the rows of each repaired conversation (edit K, R, or I for
    an empty row put in, which has no turn). The rows of a conversation stand together in one partition,
    in order; they stream through its task, so a long one is sorted on disk and never held."""
    kind = {n: numbered.schema[n].dataType.simpleString() for n in ("conv", "turn")}
    heads = found.select("conv", F.lit(None).cast(kind["turn"]).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"),
                         F.lit(0).cast("long").alias("place"))
    rows = numbered.select("conv", "turn", "role", "text", "place")
    sorted_rows = heads.unionByName(rows).repartition("conv").sortWithinPartitions("conv", "place")
    return sorted_rows.mapInArrow(_rebuild, f"conv {kind['conv']}, place long, turn {kind['turn']}, role string, text string, edit string")


def _digest(batches):
    conv, digest, kept = None, None, []
    shape = None
    for batch in batches:
        shape = batch.schema.field(0).type
        for head, place, role, text in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv", "place", "role", "text")]):
            if place == 1:
                if digest is not None:
                    kept.append((conv, digest.hexdigest()))
                conv, digest = head, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode("utf-8"))
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in kept], shape), pa.array([d for _, d in kept], pa.string())], ["conv", "sha256"])
        kept = []
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], shape), pa.array([digest.hexdigest()], pa.string())], ["conv", "sha256"])


def conversation_digests(rebuilt: DataFrame) -> DataFrame:
    """(conv, sha256 of `role:text` lines joined by a line feed) from the rows of `rebuild` as they
    come, read in one go. Conversations without rows have none."""
    return rebuilt.mapInArrow(_digest, f"conv {rebuilt.schema['conv'].dataType.simpleString()}, sha256 string")


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings per conversation, repaired rows); see `diagnose` and `rebuild`.

    Null roles and texts count as one space, null turns come first and do not count for gaps, a null
    conversation id is an id like any other. Rows with equal turns are ordered by role and text; repeated
    rows are duplicates. A row without a final `.`, `!` or `?` (blanks aside) is truncated. Of edits of one
    cost the ASCII-least audit wins. Columns other than the four are not read. An empty table gives two.
    """
    numbered = number_rows(rows, conv_col, turn_col, role_col, text_col)
    found = diagnose(numbered)
    return found, rebuild(numbered, found)


send_by_value(sys.modules[__name__])
