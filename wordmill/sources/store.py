"""The store: nine tables (and three of this engine's) as Parquet tables of a catalog database."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import DDL


def bootstrap(spark: SparkSession, database: str) -> list[str]:
    """Creates what is missing; returns the tables' full names. Running it again changes nothing."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in DDL.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
    return [f"{database}.{name}" for name in DDL]


def append(spark: SparkSession, database: str, name: str, rows: DataFrame) -> None:
    """One atomic append of rows in the table's column order."""
    rows.select(*spark.table(f"{database}.{name}").columns).write.mode("append").format("parquet").saveAsTable(f"{database}.{name}")


def numbered(rows: DataFrame, order: list[str], first: int = 1, parts: int | None = None, name: str = "id") -> DataFrame:
    """Consecutive ids in the order of columns, from `first`, without one task that sorts all rows.

    Rows are range-partitioned by the order's columns; the partitions' sizes give each its first id. The partitions are
    kept by a checkpoint (and follow the session's setting in number), as a range's bounds come from a sample that differs when it is taken again.
    """
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:  # on a cluster spark.checkpoint.dir sets it
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="wordmill-"))
    parts = parts or max(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()).checkpoint()
    sizes = dealt.groupBy("__p").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("__p").alias("__q"), (F.coalesce(F.sum("__n").over(before), F.lit(0)) + first).alias("__first"))
    inside = Window.partitionBy("__p").orderBy(*order)
    ranked = dealt.withColumn("__r", F.row_number().over(inside) - 1).join(F.broadcast(starts), F.col("__p") == F.col("__q"))
    return ranked.withColumn(name, (F.col("__first") + F.col("__r")).cast("bigint")).drop("__p", "__q", "__r", "__first")
