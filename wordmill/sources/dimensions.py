"""Dimension tables from files: lexicon, labels, frequency lists and set phrases, as Parquet or JSON lines.

A path that ends in .parquet is read as Parquet, else as JSON lines, under a fixed schema: a missing column is null, rows
without their key columns are refused with an error that counts them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEXICON = "form string, lemma string, pos string, feats string, gloss string, weight int"
LABELS = "pos string, feats string, label string"
FREQUENCY = "lemma string, pos string, weight int"
PHRASES = "id bigint, name string, pattern array<array<string>>"


def _read(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    reader = spark.read.schema(schema)
    rows = reader.parquet(path) if path.rstrip("/").endswith(".parquet") else reader.json(path)
    bad = F.lit(False)
    for key in keys:
        bad = bad | F.col(key).isNull()
    broken = rows.where(bad).count()
    if broken:
        raise ValueError(f"{broken} rows of {path} lack one of {', '.join(keys)}")
    return rows


def read_lexicon(spark: SparkSession, path: str, frequency: DataFrame | None = None) -> DataFrame:
    """form (lower case), lemma, pos, feats, gloss, weight. A frequency list (lemma, pos, weight) gives the weights that lack."""
    rows = _read(spark, path, LEXICON, ["form", "lemma", "pos"])
    weight = F.col("weight")
    if frequency is not None:
        listed = frequency.groupBy("lemma", "pos").agg(F.max("weight").alias("listed"))
        rows, weight = rows.join(listed, ["lemma", "pos"], "left"), F.coalesce("weight", "listed")
    return rows.select(F.lower("form").alias("form"), "lemma", "pos", F.coalesce("feats", F.lit("")).alias("feats"), "gloss", F.coalesce(weight, F.lit(0)).alias("weight")).distinct()


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """pos, feats, label; of several labels for one analysis the first in order."""
    rows = _read(spark, path, LABELS, ["pos", "label"])
    return rows.groupBy("pos", F.coalesce("feats", F.lit("")).alias("feats")).agg(F.min("label").alias("label"))


def read_frequency(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, FREQUENCY, ["lemma", "pos", "weight"])


def read_phrases(spark: SparkSession, path: str, most: int = 1_000_000) -> list[tuple]:
    """(id, name, pattern) for phrase_matches(): an element with one word is that word, with several a slot, empty or null any word.

    The list goes to every task, so a table of more than `most` phrases is refused.
    """
    rows = _read(spark, path, PHRASES, ["id", "pattern"])
    if rows.count() > most:
        raise ValueError(f"more than {most} phrases")
    out = []
    for r in rows.orderBy("id").collect():
        pattern = tuple(None if not e else e[0] if len(e) == 1 else frozenset(e) for e in r["pattern"])
        if not pattern or not isinstance(pattern[0], str):
            raise ValueError(f"phrase {r['id']} doesn't begin with a word")
        out.append((r["id"], r["name"], pattern))
    return out
