"""Text files as decks, and JSON requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import REQUEST

MAX_BYTES = 2 * 1024 * 1024


def read_texts(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, title, text of .txt and .md files of at most max_bytes; the size is checked before a file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = files.where(F.lower("path").rlike(r"\.(txt|md)$") & (F.col("length") <= max_bytes))
    title = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return small.select("path", title.alias("title"), F.decode("content", "UTF-8").alias("text"))


def parse_requests(raw: DataFrame, column: str = "body") -> DataFrame:
    """The request's fields; a body that isn't JSON gives nulls and bad_json."""
    parsed = raw.withColumn("request", F.from_json(column, REQUEST, {"mode": "PERMISSIVE"}))
    bad = F.col("request").isNull() | (F.get_json_object(column, "$").isNull())
    return parsed.select(*raw.columns, "request.title", "request.lang", "request.text", bad.alias("bad_json"))
