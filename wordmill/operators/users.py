"""Accounts: lookup, get-or-create, settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SETTINGS
from ..sources.store import numbered

DEFAULT_SETTINGS = '{"new_per_day":20,"retention":0.9,"theme":"system"}'


def parse_settings(raw, default: str = DEFAULT_SETTINGS):
    """Settings from JSON text; text that can't be read gives nulls."""
    return F.from_json(F.coalesce(raw, F.lit(default)), SETTINGS)


def find_user(users: DataFrame, email: str) -> DataFrame:
    return users.where(F.col("email") == email)


def get_or_create(users: DataFrame, emails: DataFrame) -> DataFrame:
    """users with a row for every email that had none: verified, with default settings, numbered on by email."""
    last = users.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = emails.select("email").where("email is not null").distinct().join(users.select("email"), "email", "left_anti")
    made = numbered(new, ["email"], first=last + 1)
    rows = made.select("id", "email", F.lit(True).alias("email_verified"), parse_settings(F.lit(None).cast("string")).alias("settings"))
    return users.select("id", "email", "email_verified", "settings").unionByName(rows)


def update_settings(users: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: user_id, ts, settings. The latest change of each user holds (ties: the larger settings)."""
    latest = changes.groupBy("user_id").agg(F.max_by("settings", F.struct("ts", "settings")).alias("__new"))
    joined = users.join(latest, F.col("id") == F.col("user_id"), "left")
    return joined.select("id", "email", "email_verified", F.coalesce("__new", "settings").alias("settings"))


def latest_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")
