"""Session helpers: building a local session, and the settings every query relies on."""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ARROW_BYTES, ARROW_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A UTC session on this machine, for tests and benchmarks."""
    paths = [ROOT, *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]
    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys(paths))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tarn")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """UTC for every query, bounded Arrow batches, and Python workers that can import this package."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    # batches to Python by bytes, not by rows: texts may be of any length
    if spark.conf.isModifiable(ARROW_BYTES):
        spark.conf.set(ARROW_BYTES, ARROW_LIMIT)
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where it is unset (tests) one of our own.

    A folder of this machine will do only where the executors are threads of this process.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tarn-shared-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")
