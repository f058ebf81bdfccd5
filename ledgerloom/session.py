"""Sessions: settings for local runs, and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def local_session(cpus: int = 8, name: str = "ledgerloom", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    settings = {
        "spark.driver.memory": memory,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable in Python workers, wherever the executors run (once for each context)."""
    context = spark.sparkContext
    if getattr(context, "_ledgerloom_shipped", False):
        return spark
    path = os.path.join(tempfile.mkdtemp(prefix="ledgerloom-"), "ledgerloom_code.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(_PACKAGE.rglob("*.py")):
            archive.write(source, str(Path(_PACKAGE.name) / source.relative_to(_PACKAGE)))
    context.addPyFile(path)
    context._ledgerloom_shipped = True
    return spark
