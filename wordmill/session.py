"""Session settings, and shipping of this package to the executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, memory: str = "8g", name: str = "wordmill") -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers once for each context, so that they need no installed copy."""
    context = spark.sparkContext
    if getattr(context, "_wordmill_shipped", False):
        return
    here = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as top:
        shutil.copytree(here, f"{top}/zip/{here.name}", ignore=shutil.ignore_patterns("__pycache__"))
        target = tempfile.mkdtemp(prefix="wordmill-code-")
        context.addPyFile(shutil.make_archive(f"{target}/{here.name}", "zip", f"{top}/zip"))
    context._wordmill_shipped = True
