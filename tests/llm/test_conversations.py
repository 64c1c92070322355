from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import conversations as C

T0 = datetime(2025, 1, 1)
SCHEMA = "sid string, id bigint, at timestamp, turn int, who string, said string, op string, role string, session_id string"
COLS = {"session": "sid", "message": "id", "version": "at", "turn": "turn", "speaker": "who", "content": "said"}


def log(spark, rows):
    full = [(s, i, T0 + timedelta(minutes=n), t, w, c, op, "x", "y") for n, (s, i, t, w, c, op) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def reasons(spark, rows, **kw):
    return {r.session_id: r.reason for r in C.judge(C.by_turn(C.fold(log(spark, rows), **COLS, **kw))).collect()}


def talk(s, *turns, start=1, ids=0):
    return [(s, ids * 100 + i, start + i, w, c, None) for i, (w, c) in enumerate(turns)]


def test_reasons(spark):
    ok = [("user", "Hi there"), ("assistant", "Hello"), ("user", "More"), ("user", "And"), ("AI", "Sure")]
    rows = talk("Good ", *ok, ids=1) + talk("zero", *ok, start=0, ids=2) + talk("two", *ok, start=2, ids=3)
    rows += talk("gap", *ok[:2], ids=4) + [("gap", 499, 5, "user", "x", None), ("gap", 498, 6, "bot", "x", None)]
    rows += talk("sys", ("System:", "Rules"), ("Human:", "Hi"), ("model", "Yo"), ("sys", "end"), ids=5)
    rows += talk("open", ("assistant", "Hi"), ("user", "a"), ("bot", "b"), ids=6) + talk("close", ("user", "a"), ids=7) + talk("only", ("system", "a"), ids=8)
    rows += talk("who", ("user", "a"), ("???", "b"), ids=9) + talk("empty", ("user", "a"), ("bot", "​ ..."), ids=10) + talk("mark", ("user", "[error: timed out]"), ("bot", "x"), ids=11)
    rows += talk("clash", ("user", "a"), ("bot", "b"), ids=12) + [("clash", 1299, 2, "bot", "other", None)]
    rows += talk("again", ("user", "a"), ("bot", "b"), ids=13) + [("AGAIN", 1399, 2, "Assistant ", " b\n", None), ("again", 1300, 1, "user", "a", None)]
    rows += [(None, 1, 1, "user", "a", None), (" ", 2, 1, "user", "a", None), ("nullturn", 3, None, "user", "a", None), ("nullturn", 4, 1, "bot", "a", None)]
    assert reasons(spark, rows) == {
        "good": None, "zero": None, "two": "gap", "gap": "gap", "sys": None, "open": "opening", "close": "unanswered", "only": "opening", "who": "speaker", "empty": "empty", "mark": "empty", "clash": "conflict", "again": None, "nullturn": "gap",
    }


def test_fold_of_edits_and_deletes(spark):
    rows = [("s", 1, 1, "user", "first", "create"), ("s", 2, 2, "bot", "answer", "create"), ("s", 1, 1, "user", "better", "edit"), ("s", 3, 2, "bot", "stray", "create"), ("s", 3, 2, "bot", "stray", "delete"), ("s", 2, 2, "bot", "answer", "retry")]
    turns = C.fold(log(spark, rows), **COLS, op="op", keep_content=True)
    assert reasons(spark, rows, op="op") == {"s": None}
    got = [(r.position, r.role, r.content) for r in C.conversations(turns).orderBy("position").collect()]
    assert got == [(0, "user", "better"), (1, "assistant", "answer")]


def test_an_edit_moves_a_message_to_another_session(spark):
    rows = [("a", 1, 1, "user", "q", None), ("a", 2, 2, "bot", "r", None), ("a", 3, 3, "user", "stray", None), ("b", 3, 1, "user", "moved", None), ("b", 4, 2, "bot", "r", None), ("b", 5, 3, "user", "lost", None), (None, 5, 3, "user", "lost", None)]
    assert reasons(spark, rows) == {"a": None, "b": None}


def test_turns_come_in_order(spark):
    rows = [r for n in range(1, 40) for r in talk(f"s{n:02}", *[("user", f"q{n}"), ("bot", f"a{n}")] * (200 if n == 7 else 3), ids=10 * n)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tables would end in one partition
    try:
        df = C.conversations(C.fold(log(spark, rows[::-1]), **COLS, keep_content=True))
        got = [(r.part, r.session_id, r.turn_num) for r in df.withColumn("part", F.spark_partition_id()).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(rows) and [r[1:] for r in got] == sorted(r[1:] for r in got)
    assert len({p for p, s, _ in got if s == "s07"}) > 1


def test_null_ids_and_empty_log(spark):
    rows = [("s", None, 1, "user", "a", None), ("s", None, 2, "bot", "b", None), ("s", None, 2, "bot", "b", None)]
    assert reasons(spark, rows) == {"s": None}
    assert reasons(spark, []) == {}


@pytest.mark.parametrize(
    ("text", "want"),
    [(None, False), ("", False), (" ", False), ("﻿", False), ("—", False), ("...", False), ("None", False), ("null", False), ("(empty)", False), ("<no content> ", False), ("[generation failed]", False), ("[no response]", False), ("(no reply)", False)]
    + [("Ok.", True), ("No, it is not.", True), ("Yes.", True), ("None of them works", True), ("The error was mine", True), ("[1] see the list", True), ("x" * 100_000, True), ("no", True), ("7", True), ("文", True)],
)
def test_says_something(spark, text, want):
    df = spark.createDataFrame([(text,)], "c string")
    assert df.select(F.coalesce(C.says_something(df.c), F.lit(False)).alias("x")).first().x is want


def test_p2_on_the_tables(spark, sf):
    from palimpsest.llm import queries as q

    bad = {r.session_id for r in q.p2_found(spark, sf).collect()}
    rows = q.p2_conversations(spark, sf).collect()
    assert bad and rows and not bad & {r.session_id for r in rows}
    by: dict = {}
    for r in rows:
        by.setdefault(r.session_id, []).append(r)
    for rs in by.values():
        rs.sort(key=lambda r: r.position)
        assert [r.position for r in rs] == list(range(rs[0].n_turns))
        said = [r.role for r in rs if r.role != "system"]
        assert said[0] == "user" and said[-1] == "assistant"
