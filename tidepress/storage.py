"""Written tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
BATCH_ROWS = 1000
BATCH_BYTES = 32 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches sent to Python by rows and bytes, so that a worker holds no more as tables grow.

    The bounds are only ever lowered: a plan that runs later has them too, and a session with lower ones keeps those.
    """
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    if _bytes(spark.conf.get(size)) > BATCH_BYTES:
        spark.conf.set(size, f"{BATCH_BYTES}b")


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"(-?\d+)([a-z]*)", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit[0] if unit not in ("", "b") else " ")


def work_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a temporary folder, on a local master only."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="tidepress-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return _LOCAL[0]


class Tables:
    """Tables under one folder; each is written once and read back with its schema."""

    def __init__(self, spark: SparkSession, name: str, path: str | None = None):
        self.spark, self.path = spark, path or f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, table: str, *partition: str) -> DataFrame:
        (df.write.partitionBy(*partition) if partition else df.write).parquet(f"{self.path}/{table}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{table}")

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}")


def spread(df: DataFrame) -> DataFrame:
    """df on all cores before costly work: a table of few row groups is read by as few tasks, a large one is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores else df
