"""What the training-data operators share: tables, a shared work folder, range buckets."""

from __future__ import annotations

import atexit
import json
import math
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidepress.storage import BATCH_BYTES, BATCH_ROWS, bound_batches  # noqa: F401

_FALLBACK: list[str] = []
#: Rows that the cut points of text and fractional keys are taken from.
SAMPLE = 20_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(columns: list[str], name: str) -> str:
    """The name, with underscores before it until no column has it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Unset: a temporary one, on a local master only."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _FALLBACK:
        _FALLBACK.append(tempfile.mkdtemp(prefix="tidepress-"))
        atexit.register(shutil.rmtree, _FALLBACK[0], True)
    return _FALLBACK[0]


class Store:
    """Tables of one run, written under the shared folder: they cut lineage and outlive any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, step: str) -> str:
        return f"{self.root}/{step}"

    def write(self, df: DataFrame, step: str) -> DataFrame:
        df.write.parquet(self.path(step))
        return self.spark.read.schema(df.schema).parquet(self.path(step))

    def drop(self, step: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path(step))
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, column: str, buckets: int) -> list:
    """Ascending cut points that part the column's values into nearly equal buckets: at most buckets - 1 values.

    Whole numbers are cut by their quantiles; values of other types by those of a sample of about
    SAMPLE rows, as many whatever the table's size. Cuts that aren't quite even cost balance, never rows.
    """
    if buckets < 2:
        return []
    if isinstance(df.schema[column].dataType, IntegralType):
        shares = [i / buckets for i in range(1, buckets)]
        cuts = df.agg(F.percentile_approx(F.col(column), shares, max(10_000, 20 * buckets)).alias("c")).first()["c"]
        return sorted(set(cuts or []))
    known = df.select(column).filter(F.col(column).isNotNull())
    share = min(1.0, SAMPLE / max(1, known.count()))
    seen = sorted(r[0] for r in known.sample(share, 42).collect())
    return sorted({seen[len(seen) * i // buckets] for i in range(1, buckets)}) if seen else []


def bucket_of(column: Column, bounds: list) -> Column:
    """Number of bounds at or below the value (null: 0), found in two steps of about sqrt(len(bounds)) each.

    The bounds take their type from their Python values; they must compare as the column's values do.
    """
    if not bounds:
        return F.lit(0)
    width = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    if all(isinstance(b, int) and not isinstance(b, bool) for b in bounds):
        heads = F.from_json(F.lit(json.dumps([g[0] for g in groups])), "array<bigint>")
        inner = F.from_json(F.lit(json.dumps([[], *groups])), "array<array<bigint>>")
    else:
        heads = F.array(*(F.lit(g[0]) for g in groups))
        inner = F.array(F.slice(heads, 1, 0), *(F.array(*map(F.lit, g)) for g in groups))
    at = lambda edges: F.size(F.filter(edges, lambda h: h <= column))
    group = at(heads)
    place = (group - 1) * width + at(F.element_at(inner, group + 1))
    return F.when(column.isNull() | (group == 0), F.lit(0)).otherwise(place).cast("int")


def crc32_of(column: Column) -> Column:
    return F.crc32(F.coalesce(column.cast("binary"), F.lit(b"")))
