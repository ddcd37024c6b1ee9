"""Shared-folder staging, size-checked broadcasts and small column helpers.

Intermediate results that cut lineage are written as Parquet below
``spark.checkpoint.dir``, the folder that the driver and all executors see.
Only a local session without that setting (tests, notebooks on one machine) gets a
temporary folder; on a cluster its absence is an error. Nothing is ever kept in executor memory alone, so a lost
executor costs a re-read and never a result.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its counted rows stay below this bound.
BROADCAST_ROWS = 20_000

WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


#: Folders made for sessions that name none, by application.
_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder: the session's checkpoint directory, or a new one if unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        root = _own.get(app) or _own.setdefault(app, tempfile.mkdtemp(prefix="veilspark-"))
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_or_plain(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if at most ``bound`` rows were counted, else unmarked.

    Call it on staged or otherwise cheap frames: the count is a job. Beyond the
    bound the join is a shuffled one that AQE may split.
    """
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or the first of ``_wanted``, ``__wanted``, ... that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted
