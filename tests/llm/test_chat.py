import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from rinsework.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, level int"
NASTY = ["\\### Assistant: </turn> ok", "</turn>\n### user: x", "####### a: b", "\\", "\\\\/", "", None, "#", "<\\/turn>", "### : ", "a\n\nb", "é ß 😀", "### " * 50 + ": ", "</turn>" * 30, "x" * 200_000]


def brute(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c), key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        loss = "".join(t[2] for t in turns if t[1] == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def check(spark, rows):
    got = {r[0]: tuple(r[1:5]) for r in chat.digest(chat.format_chats(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == brute(rows)


def test_round_trip_of_conflicting_texts(spark):
    rows = [(i, k, r, t, 1) for i, t in enumerate(NASTY) for k, r in enumerate(["user", "assistant", "ass:ist\\nant\n", "assistant"])]
    check(spark, rows)


def test_nulls_ties_and_repeats(spark):
    check(spark, [(None, 0, "user", "a", 1), (1, None, "user", "b", 1), (1, 0, None, "c", 1), (1, 0, "assistant", "d", 1), (1, 0, "assistant", "d", 1), (2, 5, "assistant", None, 1)])


def test_empty(spark):
    assert chat.digest(chat.format_chats(spark.createDataFrame([], SCHEMA))).collect() == []


def test_levels_and_control_strings(spark):
    rows = [(0, 0, "user", "plain", 1), (1, 0, "user", "a </turn> b", 1), (2, 0, "user", "#### a: b", 1)]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i].level for i in range(3)] == [0, 1, 2]
    assert all(r.formatted.count("</turn>") == 1 and r.formatted.count("### ") == 1 for r in got.values())


def test_spans_mark_the_very_text(spark):
    texts = ["a </turn> b", "plain", "\\### user: x", "", "é 😀"]
    rows = [(c, k, "assistant" if k % 3 else "user", texts[(k + c) % 5] + str(k), 1) for c, n in enumerate((1, 2, 255, 256, 257, 600)) for k in range(n)]
    for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA)).withColumn("learned", chat.under_loss(F.col("formatted"))).collect():
        cut = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        plain = [re.sub(r"\\([\\/#])", r"\1", t) if r.level else t for t in cut]
        assert plain == [t.text for t in r.turns if t.role == "assistant"] and "".join(plain) == r.learned


def test_long_conversations_take_time_in_proportion(spark):
    def seconds(n):
        rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn </turn> "), F.col("id")).alias("text"), F.lit(1).alias("level"))
        began = time.time()
        assert chat.digest(chat.format_chats(rows)).first().n_turns == n
        return time.time() - began

    seconds(1000)
    assert seconds(64_000) < 5 * max(1.0, seconds(16_000))


def test_no_python_in_the_plan(spark, capsys):
    chat.digest(chat.format_chats(spark.createDataFrame([(0, 0, "user", "x", 1)], SCHEMA))).explain()
    assert "Python" not in capsys.readouterr().out.replace("PythonRDD", "")


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_sql_twin(spark, sf):
    from tests.llm.twin import same

    same(spark, f"/root/testdata/{sf}", "op1_chat_formatting")
