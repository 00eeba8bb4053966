"""Sessions, and sending this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Rows, and bytes, of one Arrow batch between the JVM and Python; texts may be long, so both are small.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def session(master: str = "local[8]", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session with what the plans rely on: UTC, adaptive execution, ANSI arithmetic."""
    builder = SparkSession.builder.master(master).appName("lumenfold")
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Once per application: give Python workers this package, whatever their path. The session's Arrow batches become small, so
    that a worker holds no more of long texts however large the input is; Spark reads these two settings when a plan runs."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="lumenfold-"), "lumenfold.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)
