import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rinsework.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string, repaired_sha256 int"
WHITE = " \t\n\x0b\x0c\r"


def said(x):
    return " " if x is None else str(x)


def damaged(rows):
    for c, t, role, text in rows:
        role, text, fault = said(role), said(text), zlib.crc32(f"{said(c)}:{said(t)}".encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        yield from [(c, t, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)


def plan(turns):
    """(cost, audit) by keeping, for each number of turns read and each state of the pattern, the cheapest and then least string."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def inserted(best):
        for _ in range(4):
            for s, (cost, audit) in list(best.items()):
                for r in "ua":
                    if r in step[s]:
                        t = step[s][r]
                        best[t] = min(best.get(t, (10**9, "")), (cost + 5, audit + "I"))
        return best

    best = inserted({"": (0, "")})
    for initial, fault in turns:
        more, new = (5 if fault == 2 else 0), {}
        for s, (cost, audit) in best.items():
            options = [(2, "D", s)]
            if fault not in (0, 1):
                options += [(more, "K", step[s][initial])] if initial in step[s] else []
                options += [(1 + more, "R", step[s][r]) for r in "ua" if r in step[s]]
            for c, letter, t in options:
                new[t] = min(new.get(t, (10**9, "")), (cost + c, audit + letter))
        best = inserted(new)
    return min(best[s] for s in ("", "a") if s in best)


def brute(rows):
    groups = defaultdict(list)
    for r in damaged(rows):
        groups[r[0]].append(r[1:])
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted(groups[c], key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, faults = set(), []
        for _, role, text in turns:
            bare = text.rstrip(WHITE)
            faults.append(0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        cost, audit = plan([(role[:1], f) for (_, role, _), f in zip(turns, faults)])
        lines, state, at = [], "", 0
        for letter in audit:
            asked = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
            role, text = (asked, "") if letter == "I" else turns[at][1:]
            at += letter != "I"
            if letter != "D":
                role = role if letter == "K" else asked
                lines.append(f"{role}:{text}")
                state = role[:1]
        numbers = [t[0] for t in turns if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        initials = [t[1][:1] for t in turns]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
        out[c] = (gaps, faults.count(0), faults.count(1), faults.count(2), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def check(spark, rows):
    table = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    got = {r[0]: tuple(r[1:]) for r in repair.digest(repair.damage(table), table).collect()}
    assert got == brute(rows)


TEXTS = ["Yes.", "No!", "cut", "cut \t\x0b", " ", "", None, "é?", "a.b", "Yes. \n", "x" * 100_000 + "."]


def test_small_conversations_against_brute_force(spark):
    own = random.Random(3)
    rows = []
    for c in range(400):
        for t in range(own.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c, own.choice([t, t, t, t + 2, None]), own.choice(["system", "user", "assistant", "user", "assistant", "tool", None, "", "speaker"]), own.choice(TEXTS)))
    check(spark, rows)


def test_nulls_ties_and_repeats(spark):
    rows = [(None, None, None, None), (None, 1, "user", "a."), (7, None, "user", "b."), (7, None, "assistant", "c."), (8, 2, "user", "d."), (8, 2, "user", "d."), (8, 2, "assistant", "d."), (9, 0, "system", "e.")]
    check(spark, rows)


def test_all_turns_dropped(spark):
    gone = [t for t in range(200) if zlib.crc32(f"5:{t}".encode()) % 20 == 0]
    check(spark, [(5, t, "user", "x.") for t in gone] + [(6, 1, "user", "x.")])


def test_empty(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert repair.digest(repair.damage(table), table).collect() == []


def test_one_long_conversation_over_many_blocks(spark):
    own = random.Random(5)
    check(spark, [(1, t, own.choice(["user", "assistant", "tool"]), f"{t % 4000}{own.choice(['.', '.', '', '?'])}") for t in range(9000)] + [(2, 0, "user", "a."), (2, 1, "assistant", "b.")])


def test_repaired_turns_fit_the_pattern(spark):
    own = random.Random(7)
    rows = [(c, t, own.choice(["system", "user", "assistant", "tool"]), own.choice(["a.", "b!", "c", "d?"]) + str(t) + ".") for c in range(60) for t in range(own.choice([1, 4, 8]))]
    turns, found = repair.repair(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA))
    by = defaultdict(list)
    for r in repair.repaired(turns, found).orderBy("conv_id", "place").collect():
        by[r.conv_id].append(r.role[:1])
    assert by and all(re.fullmatch(r"(s?(ua)+)?", "".join(x)) for x in by.values())


@pytest.mark.parametrize("seed", range(3))
def test_cheapest_is_the_least_of_all(seed):
    own = random.Random(seed)
    for _ in range(2000):
        codes = [own.randrange(12) for _ in range(own.randrange(12))]
        cost, audit = plan([("suat"[c // 3], {0: None, 1: 0, 2: 2}[c % 3]) for c in codes])
        assert repair.cheapest(codes) == (audit, cost)


def test_query_on_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r[1:]) for r in queries.op12_conversation_repair(spark, "/root/testdata/sf0.001").collect()}
    assert got == brute(rows)


def test_half_of_all_rows_in_one_conversation_stay_in_many_tasks(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat("id", F.lit(".")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would be put together
    try:
        turns = repair._sorted(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by_task = turns.filter("conv_id = 1").groupBy(F.shiftright("id", 33)).count().collect()
    assert len(by_task) > 1 and max(r[1] for r in by_task) < 20_000
