from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from wordmill.operators.review import card_states
from wordmill.sources.files import parse_requests, read_texts
from wordmill.streaming.reviews import answers, daily_counts, latest_states, state_sink


def test_read_texts(spark, tmp_path):
    (tmp_path / "one.txt").write_text("Hei.\nMoi.", "utf-8")
    (tmp_path / "two.md").write_text("ä" * 10, "utf-8")
    (tmp_path / "big.txt").write_text("x" * 100, "utf-8")
    (tmp_path / "no.csv").write_text("x", "utf-8")
    got = {r["title"]: r["text"] for r in read_texts(spark, str(tmp_path), 50).collect()}
    assert got == {"one": "Hei.\nMoi.", "two": "ä" * 10}


def test_parse_requests(spark):
    df = spark.createDataFrame([('{"title":"T","lang":"FI","text":"x"}',), ("{oops",), (None,)], "body string")
    rows = parse_requests(df).collect()
    assert [r["bad_json"] for r in rows] == [False, True, True] and rows[0]["title"] == "T"


def test_stream_equals_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, i % 3, i % 3 * 10 + i % 5, start + dt.timedelta(hours=7 * i), i % 4) for i in range(60)]
    schema = "event_id bigint, user_id bigint, card_id bigint, ts timestamp, quality int"
    log = spark.createDataFrame(rows, schema)
    for part in range(3):
        log.where(f"event_id div 20 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state_sink(stream, str(tmp_path / "log"), str(tmp_path / "state"), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    got = {r["card_id"]: (round(r["stability"], 6), r["reps"]) for r in latest_states(spark.read.parquet(str(tmp_path / "state"))).collect()}
    want = {r["card_id"]: (round(r["stability"], 6), r["reps"]) for r in card_states(log.withColumn("ts", F.col("ts").cast("timestamp_ntz"))).collect()}
    assert got == want
    q = daily_counts(answers(stream), None).writeStream.format("memory").queryName("daily").outputMode("append").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("daily").agg(F.sum("n")).first()[0] > 0
