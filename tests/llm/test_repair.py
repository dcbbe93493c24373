import hashlib
import itertools
import random
import re

from subgrade.llm import repair
from tests.conftest import DATA, same_rows

CONVS = "conv_id long, turn long, role string, text string"


def brute(rows):
    """All edits of a short conversation, by cost and letters. rows: (turn, role, text) in order."""
    symbols, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "dup" if (role, text) in seen else "late" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        symbols.append(fault)
    best = None
    bound = 4 * len(rows)

    def go(i, out, letters, cost):
        nonlocal best
        if cost > bound:
            return
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out)):
                best = min(best or (cost, letters, out), (cost, letters, out), key=lambda b: b[:2])
            if len(out) < 2 * len(rows) + 2:
                for role in ("user", "assistant"):
                    go(i, [*out, (role, "")], letters + "I", cost + 3)
            return
        if not re.fullmatch("(s?(ua)*u?)?", "".join(r[:1] or "?" for r, _ in out)):
            return
        _, role, text = rows[i]
        go(i + 1, out, letters + "D", cost + 4)
        for given in ("user", "assistant"):
            go(i, [*out, (given, "")], letters + "I", cost + 3)
        if symbols[i] not in ("blank", "dup"):
            late = 3 * (symbols[i] == "late")
            if role:
                go(i + 1, [*out, (role, text)], letters + "K", cost + late)
            for given in ("user", "assistant"):
                go(i + 1, [*out, (given, text)], letters + "R", cost + 3 + late)

    go(0, [], "", 0)
    return best, [sum(s == k for s in symbols) for k in ("blank", "dup", "late")]


def test_block_tables_agree_with_single_steps():
    tables = repair.block_tables()
    r = random.Random(3)
    for n in [*range(8), 40]:
        symbols = "".join(r.choice(repair.SYMBOLS) for _ in range(n))
        v, cost, behind = repair.FINAL, 0, 0
        each = []
        for s in reversed(symbols):
            each.append(v)
            v = repair._before(s, v)
        for block in reversed(tables.blocks(symbols)):
            behind, add = tables.look_up(block, behind)
            cost += add
        assert tuple(x + cost for x in tables.vectors[behind]) == tuple(v)
        assert [repair._normal(x)[0] for x in reversed(each)] == [tables.vectors[b] for b in tables.behind_each(symbols, 0)]


def test_against_all_edits(spark):
    r = random.Random(5)
    texts = ["Yes.", "no", "", " \t", "Well!", "so"]
    rows = []
    for c in range(60):
        for t in range(r.randrange(1, 5)):
            rows.append((c, t, r.choice(["system", "user", "assistant", "user", "assistant", "tool", "Ünder", ""]), r.choice(texts)))
    df = spark.createDataFrame(rows, CONVS)
    report = {x.conv_id: x for x in repair.repair_report(df).collect()}
    turns = {}
    for x in sorted(repair.repaired_turns(df).collect(), key=lambda x: (x.conv_id, x.position)):
        turns.setdefault(x.conv_id, []).append((x.role, x.text))
    for c, own in itertools.groupby(rows, key=lambda x: x[0]):
        (cost, letters, out), faults = brute([x[1:] for x in own])
        x = report[c]
        assert (x.cost, x.audit, [x.blank, x.duplicate, x.truncated]) == (cost, letters, faults)
        assert turns.get(c, []) == out
        assert x.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()


def test_query_against_sql(spark, duck):
    same_rows(repair.op12_conversation_repair(spark, str(DATA)).toPandas(), duck.sql(repair.OP12_SQL).df())


def test_nulls_ties_repeats_gaps_a_long_conversation_and_an_empty_table(spark, duck):
    r = random.Random(8)
    rows = [(1, None, "user", "Hi."), (1, None, None, None), (1, 5, "user", "A."), (1, 5, "user", "A."), (1, 5, "assistant", "B."), (1, 9, "system", "C?"),
            (None, 1, "user", "x"), (None, 2, "assistant", "y."), (2, None, "tool", "z " * 50_000), (3, 1, "user", None)]
    rows += [(7, t, r.choice(["user", "assistant", "system"]), r.choice(["One.", "two", f"{t}!", f"{t}", " "])) for t in range(5000)]
    df = spark.createDataFrame(rows, CONVS).selectExpr("*", "'x' AS digest", "'x' AS part", "'x' AS symbols")
    got = repair.repair_report(repair.damaged(df), df).toPandas()
    duck.register("odd", df.drop("digest", "part", "symbols").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    wanted = duck.sql(repair.OP12_SQL.replace("FROM conversations", "FROM odd")).df()
    same_rows(got, wanted)
    assert repair.repair_report(df.limit(0)).count() == 0
    assert repair.repaired_turns(df.limit(0)).count() == 0
    whole = repair.repaired_turns(df.filter("conv_id = 7")).toPandas().sort_values("position")
    assert re.fullmatch("(s?(ua)+)?", "".join(whole["role"].str[:1]))
    assert list(whole["position"]) == list(range(len(whole)))


def test_a_conversation_that_is_dropped_whole(spark):
    ids = spark.createDataFrame([(4,), (5,)], "conv_id long")
    x = {r.conv_id: r for r in repair.repair_report(spark.createDataFrame([(5, 0, "user", "Q."), (5, 1, "assistant", "A.")], CONVS), ids).collect()}
    assert (x[4].cost, x[4].audit, x[4].repaired_sha256) == (0, "", hashlib.sha256(b"").hexdigest())
    assert (x[5].cost, x[5].audit) == (0, "KK")
