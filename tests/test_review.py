from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wordmill.operators import decks as D
from wordmill.operators import review as R
from wordmill.operators import users as U
from wordmill.sources.store import append, bootstrap, numbered

START = dt.datetime(2024, 1, 1, 12)


def log(spark, answers):
    """answers: lists of (day, quality) for each card."""
    rows = [(i * 100 + j, 1, i, START + dt.timedelta(days=d), q) for i, a in enumerate(answers) for j, (d, q) in enumerate(a)]
    return spark.createDataFrame(rows, "event_id bigint, user_id bigint, card_id bigint, ts timestamp_ntz, quality int")


def states(spark, *answers):
    return {r["card_id"]: r for r in R.card_states(log(spark, answers)).collect()}


def test_memory_invariants(spark):
    got = states(spark, [(0, 2)], [(0, 2), (3, 2)], [(0, 2), (3, 0)], [(0, 0)], [(0, 3)], [(0, 2), (0, 2)])
    assert got[1]["stability"] > got[0]["stability"] > got[2]["stability"]
    assert got[2]["lapses"] == 1 and got[2]["state"] == "relearning" and got[3]["state"] == "learning"
    assert got[3]["next_due"] == START + dt.timedelta(minutes=10)
    assert got[4]["stability"] > got[0]["stability"] > got[3]["stability"]
    assert all(1 <= r["difficulty"] <= 10 and r["stability"] > 0 for r in got.values())
    assert got[5]["reps"] == 2
    df = spark.createDataFrame([(5.0,)], "s double")
    m = R.Memory()
    assert df.select(m.recall(F.col("s"), F.col("s"))).first()[0] == pytest.approx(0.9)
    assert df.select(m.interval(F.col("s"))).first()[0] == pytest.approx(5.0)


def test_due_and_known(spark):
    st = spark.createDataFrame([(1, 1, 29.99, START), (1, 2, 30.0, START), (1, 3, 50.0, START), (2, 1, 1.0, START + dt.timedelta(seconds=1))], "user_id bigint, k int, stability double, next_due timestamp_ntz")
    marks = spark.createDataFrame([(1, 3), (1, 9), (2, 8)], "user_id bigint, k int")
    ignored = spark.createDataFrame([(1, 3), (2, 8)], "user_id bigint, k int")
    assert {(r["user_id"], r["k"]) for r in R.known_words(st, marks, ignored).collect()} == {(1, 2), (1, 9)}
    now = F.lit(START).cast("timestamp_ntz")
    assert {(r["user_id"], r["k"]) for r in R.due_cards(st, ignored, now).collect()} == {(1, 1), (1, 2)}
    assert R.mark(marks, ignored).count() == 3
    assert R.seed_known(st, marks).where("stability >= 30").count() == 2


def test_capacity_and_queue(spark):
    answers = log(spark, [[(0, 2)] for _ in range(25)])
    users = spark.createDataFrame([(1,), (2,)], "user_id bigint")
    got = {r["user_id"]: (r["learned_today"], r["capacity"]) for r in R.new_capacity(users, answers, F.lit("2024-01-01").cast("date")).collect()}
    assert got == {1: (25, 0), 2: (0, 20)}
    due = spark.createDataFrame([(2, 7, START), (2, 5, START), (2, 6, START - dt.timedelta(days=1))], "user_id bigint, k int, next_due timestamp_ntz")
    new = spark.createDataFrame([(2, k) for k in range(40, 70)] + [(1, 40)], "user_id bigint, k int")
    capacity = R.new_capacity(users, answers, F.lit("2024-01-01").cast("date"))
    rows = R.queue(due, new, capacity).orderBy("user_id", "place").collect()
    assert [r["k"] for r in rows][:4] == [6, 5, 7, 40] and len(rows) == 23
    assert {r["user_id"]: r["k"] for r in R.next_cards(R.queue(due, new, capacity)).collect()} == {2: 6}


def test_null_safe_keys(spark):
    cards = spark.createDataFrame([(1, "a", None), (1, "a", None), (1, "b", 3)], "user_id bigint, lemma string, mwe_id bigint").distinct()
    assert cards.count() == 2
    gone = spark.createDataFrame([(1, "a", None)], "user_id bigint, lemma string, mwe_id bigint")
    assert [r["lemma"] for r in R.without(cards, gone, ("user_id", "lemma", "mwe_id")).collect()] == ["b"]


def test_users_and_decks(spark):
    users = spark.createDataFrame([(4, "a@x", True)], "id bigint, email string, email_verified boolean").withColumn("settings", U.parse_settings(F.lit(None).cast("string")))
    emails = spark.createDataFrame([("c@x",), ("a@x",), ("b@x",), ("b@x",), (None,)], "email string")
    got = {r["email"]: r["id"] for r in U.get_or_create(users, emails).collect()}
    assert got == {"a@x": 4, "b@x": 5, "c@x": 6}
    assert U.get_or_create(U.get_or_create(users, emails), emails).count() == 3
    bad = spark.createDataFrame([("{oops",)], "raw string").select(U.parse_settings(F.col("raw")).alias("s")).first()["s"]
    assert bad is None or bad["new_per_day"] is None
    uploads = spark.createDataFrame([(1, "B", "FI", "x"), (1, "A", "ET", "y"), (1, "", "FI", "z")], "user_id bigint, title string, lang string, text string")
    good, refused = D.create_decks(uploads, 10)
    assert {r["title"]: r["deck_id"] for r in good.collect()} == {"A": 10, "B": 11}
    assert [r["reason"] for r in refused.collect()] == ["title"]


def test_summary_keeps_empty_decks(spark):
    decks = spark.createDataFrame([(1, 1, "A"), (2, 1, "B")], "id bigint, user_id bigint, title string")
    words = spark.createDataFrame([(1, "x", "NOUN", 3), (1, "y", "NOUN", 1)], "deck_id bigint, lemma string, pos string, n bigint")
    known = spark.createDataFrame([(1, "x", "NOUN")], "user_id bigint, lemma string, pos string")
    got = {r["deck_id"]: (r["tokens"], r["unique_lemmas"], r["known_lemmas"], r["new_lemmas"]) for r in D.summary(words, decks, known).collect()}
    assert got == {1: (4, 2, 1, 1), 2: (0, 0, 0, 0)}
    assert D.orphans(decks, spark.createDataFrame([(9,)], "id bigint")).count() == 2


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    assert all(r["id"] == r["v"] + 5 for r in numbered(df, ["v"], 5).collect())


def test_store(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS wm_test LOCATION '{tmp_path}/db'")
    try:
        assert len(bootstrap(spark, "wm_test")) == len(bootstrap(spark, "wm_test")) == 11
        rows = spark.createDataFrame([(1, 2, 0, "x", "FI")], "id bigint, deck_id bigint, sentence_ix int, text string, lang string")
        append(spark, "wm_test", "sentences", rows)
        append(spark, "wm_test", "sentences", rows)
        assert spark.table("wm_test.sentences").count() == 2
    finally:
        spark.sql("DROP DATABASE wm_test CASCADE")
