"""Session settings this package relies on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submitted configuration counts."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("spanguard")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder of the cluster (``spark.checkpoint.dir``).

    Where that is unset and everything runs in this process, a temporary folder does.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spanguard-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def smaller_batches(spark: SparkSession, rows: int) -> None:
    """From now on Arrow batches of this session hold at most so many rows.

    Spark counts the rows of a batch, not what is found in them, and every Python step of a plan holds a batch and its answer. The
    setting is only ever lowered.
    """
    now = int(spark.conf.get(_BATCH))
    if now <= 0 or now > rows:
        spark.conf.set(_BATCH, str(rows))
