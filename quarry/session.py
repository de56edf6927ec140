"""Sessions for the command line, the daemon and the benchmark."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder that the driver and all executors see, in `spark.checkpoint.dir`. Only a local
    session may leave that unset; its folder is removed when Python ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, base, True)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def session(cores: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC; without a configured master it is local. Partition counts follow
    the cores; on a cluster, set spark.sql.shuffle.partitions to the cluster's size and
    leave the rest to adaptive execution."""
    builder = (
        SparkSession.builder.appName("quarry")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if cores:
        builder = builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(cores))
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
