"""Sessions and scratch tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "tessera", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings that the operators assume."""
    builder = SparkSession.builder.appName(name)
    builder = builder.master(master) if master else builder
    return builder.config(map=SETTINGS | {k: str(v) for k, v in settings.items()}).getOrCreate()


@cache
def _own() -> str:
    return tempfile.mkdtemp(prefix="tessera-")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. A
    temporary one is used only where that isn't set and everything runs in one
    process; on a cluster its absence is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (where or _own()).rstrip("/")


def scratch_path(spark: SparkSession, name: str = "step") -> str:
    """A new path in that folder."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, without its lineage."""
    spark = df.sparkSession
    path = scratch_path(spark)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
