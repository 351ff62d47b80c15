import hashlib
import itertools
import random

from tillwork.llm import conversation_repair as repair
from tillwork.llm.queries import QUERIES

TARGETS = [""] + [s + "ua" * k for k in range(1, 8) for s in ("", "s")]


def plain_best(symbols):
    """Every target in turn: the cheapest (cost, audit) that makes the rows read like it, by edit distance."""
    found = []
    for target in TARGETS:
        best = {(0, 0): (0, "")}
        for i, j in itertools.product(range(len(symbols) + 1), range(len(target) + 1)):
            ways = []
            if i:
                symbol = symbols[i - 1]
                ways.append((best[i - 1, j], 3, "D"))
                if j and symbol != "d":
                    extra = int(symbol.isupper())
                    if symbol.lower() == target[j - 1]:
                        ways.append((best[i - 1, j - 1], extra, "K"))
                    elif target[j - 1] != "s":
                        ways.append((best[i - 1, j - 1], 2 + extra, "R"))
            if j and target[j - 1] != "s":
                ways.append((best[i, j - 1], 2, "I"))
            done = [(before[0] + cost, before[1] + letter) for before, cost, letter in ways if before is not None]
            if i or j:
                best[i, j] = min(done, default=None)
        if best[len(symbols), len(target)] is not None:
            found.append(best[len(symbols), len(target)])
    return min(found)


def test_parse_against_every_target():
    rng = random.Random(3)
    for _ in range(250):
        symbols = "".join(rng.choice("suaUAxXSd") for _ in range(rng.randint(0, 7)))
        assert repair.cheapest(repair.parse([repair.row_cell(s) for s in symbols])) == plain_best(symbols)


def test_intervals_of_intervals_give_the_same():
    rng = random.Random(4)
    for _ in range(40):
        symbols = "".join(rng.choice("suaUAxd") for _ in range(rng.randint(9, 14)))
        parts = [symbols[i:i + 3] for i in range(0, len(symbols), 3)]
        whole = repair.parse([repair.parse([repair.row_cell(s) for s in part]) for part in parts])
        assert whole == repair.parse([repair.row_cell(s) for s in symbols])
        assert repair._unpack(repair._pack(whole)) == whole


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, audit string")


def test_rows_faults_and_repairs(spark):
    rows = [(1, 0, "system", "Be good."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Yes."), (1, 2, "assistant", "Yes."), (1, 5, "user", "and"),
            (2, None, "user", "first?"), (2, 3, "tool", None), (2, 3, "user", "."), (None, 1, "assistant", "Lone."), (3, None, None, None), (4, 0, "user", "Done. \n")]
    found, rebuilt = repair.repair(rows_of(spark, rows))
    got = {r["conv"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"]) for r in found.collect()}
    assert got == {1: (2, 0, 1, 1, 1, 6, "KKKDD"), 2: (0, 1, 0, 0, 2, 5, "KDR"), None: (0, 0, 0, 0, 0, 2, "IK"), 3: (0, 1, 0, 0, 0, 3, "D"),
                   4: (0, 0, 0, 0, 0, 2, "KI")}
    made = {}
    for r in sorted(rebuilt.collect(), key=lambda r: (r["conv"] or 0, r["place"])):
        made.setdefault(r["conv"], []).append((r["role"], r["text"], r["turn"], r["edit"]))
    assert made[2] == [("user", "first?", None, "K"), ("assistant", ".", 3, "R")]
    assert made[None] == [("user", "", None, "I"), ("assistant", "Lone.", 1, "K")]
    assert 3 not in made and len(made[1]) == 3
    digests = {r["conv"]: r["sha256"] for r in repair.conversation_digests(rebuilt).collect()}
    assert digests[4] == hashlib.sha256(b"user:Done. \n\nassistant:").hexdigest() and set(digests) == {1, 2, None, 4}


def test_long_conversations_in_rounds(spark, split):
    """One conversation of 700 rows beside short ones, all groups treated as busy: three rounds of parses."""
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no", "", f"n{t}.", f"m{t}"])) for t in range(700)]
    rows += [(8, t, "user", f"n{t}.") for t in range(3)]
    found, rebuilt = repair.repair(rows_of(spark, rows))
    numbered = sorted((r for r in rows if r[0] == 7), key=lambda r: (r[1], r[2], r[3]))
    seen, symbols = set(), []
    for _, _, role, text in numbered:
        gone = not text or (role, text) in seen
        seen.add((role, text))
        symbols.append("d" if gone else role[0] if text.endswith(".") else role[0].upper())
    cells = [repair.row_cell(s) for s in symbols]
    while len(cells) > 1:
        cells = [repair.combine(*cells[i:i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    best = {r["conv"]: (r["cost"], r["audit"]) for r in found.collect()}
    assert best == {7: repair.cheapest(cells[0]), 8: plain_best("uuu")}
    rebuilt_roles = "".join(r["role"][0] for r in sorted((r for r in rebuilt.collect() if r["conv"] == 7), key=lambda r: r["place"]))
    assert rebuilt_roles in ("ua" * (len(rebuilt_roles) // 2), "s" + "ua" * (len(rebuilt_roles) // 2))


def test_empty_tables(spark):
    found, rebuilt = repair.repair(rows_of(spark, [(1, 0, "user", "a.")]).limit(0))
    assert found.count() == 0 and rebuilt.count() == 0 and repair.conversation_digests(rebuilt).count() == 0


def test_the_query_keeps_every_conversation(spark, sf):
    chats = spark.read.parquet(f"{sf}/conversations.parquet")
    assert QUERIES["op13_conversation_repair"](spark, sf).count() == chats.select("conv_id").distinct().count()
