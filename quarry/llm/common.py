"""Worker set-up, shared storage and row numbering for the operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
_own_dir: str | None = None
_made: list[str] = []


def ensure_workers(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def shared_dir(spark: SparkSession, what: str) -> str:
    """URI of a new folder, visible to the driver and all executors.

    It lies in `spark.checkpoint.dir`. Only a local session may leave that
    unset; its folder is removed when Python ends.
    """
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if _own_dir is None:
            _own_dir = tempfile.mkdtemp(prefix="quarry-")
            atexit.register(shutil.rmtree, _own_dir, True)
        base = Path(_own_dir).as_uri()
    if "://" not in base and base.startswith("/"):
        base = f"file://{base}"
    _made.append(f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}")
    return _made[-1]


def clean(spark: SparkSession, keep: int = 0) -> None:
    """Delete what this process has written to shared storage, but for the first `keep` folders.

    To be called when every result that may still read from there is stored elsewhere;
    `len(made())` before a run, given as `keep`, limits it to that run.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while len(_made) > keep:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


def made() -> list[str]:
    return list(_made)


def clean_steps(spark: SparkSession, first: int) -> None:
    """Delete the folders made from number `first` on, but for the last: the steps towards a table that is now written."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while len(_made) > first + 1:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop(first))
        path.getFileSystem(conf).delete(path, True)


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write a frame to shared storage and read it again: the lineage ends there,
    and what a lost executor held is read back, not computed anew."""
    path = shared_dir(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spare_name(taken: list[str], name: str) -> str:
    """`name`, with underscores added until no column clashes (names compare without case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Add a row number that repeats on every scan of the same deterministic source
    (files, a checkpoint): partition in the upper bits, position in the lower."""
    return df.withColumn(name, F.monotonically_increasing_id())


def from_files(df: DataFrame) -> DataFrame:
    """The frame, if each of its rows has a place in a file; else it is written and read."""
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return materialise(df, "rows")
    return df


def placed(df: DataFrame, name: str) -> DataFrame:
    """Add the row's place in its files as a number: the file's rank in the upper bits, the row's
    index in the file in the lower 36. It is the same in every scan, however splits are packed and
    whichever executors are alive, so a table can be joined back by it without being stored again.

    One name a file goes to the driver and back as a broadcast, less than Spark's own listing of them.
    """
    df = from_files(df)
    files = sorted(r[0] for r in df.select("_metadata.file_path").distinct().collect())
    file, rank, index = (spare_name(df.columns, x) for x in ("file_", "rank_", "index_"))
    ranks = df.sparkSession.createDataFrame(list(enumerate(files)), f"{rank} long, {file} string")
    rows = df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(index))
    number = F.shiftleft(rank, 36).bitwiseOR(F.col(index))
    return rows.join(F.broadcast(ranks), file).select(*[rows[c] for c in df.columns], number.alias(name))


def release() -> None:
    """Give memory that Python, Arrow and the allocator hold but don't use back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_of(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
