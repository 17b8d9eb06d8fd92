"""A manifest of ingested documents in versions, guarded and committed at once.

A version is a table in a folder of its own. It counts once a small file in ``commits``
names it, which a rename puts there whole; a run that dies before leaves the version
before as it was, and folders without a commit are ignored. A commit tells the schema
and the ingest version it was written by; if one isn't that of the run, the manifest
counts as empty and everything is ingested anew.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

COMMIT = "number long, folder string, schema_version int, ingest_version string"


class Conflict(RuntimeError):
    """Another run committed the same version."""


def _store(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def latest(spark: SparkSession, path: str) -> Row | None:
    """The last whole commit; files that aren't one are passed over."""
    where, store = _store(spark, f"{path}/commits")
    if not store.exists(where):
        return None
    return spark.read.schema(COMMIT).json(f"{path}/commits").where("number is not null and folder is not null").orderBy(F.desc("number")).limit(1).first()


def save(rows: DataFrame, path: str, schema_version: int, ingest_version: str, after: int | None = None) -> int:
    """Write ``rows`` as the next version and return its number. ``after`` is the
    version that the run has read (0 for none); if another came since, it fails and
    nothing changes."""
    spark = rows.sparkSession
    folder = f"versions/{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{folder}")
    last = latest(spark, path)
    known = last["number"] if last else 0
    if after is not None and after != known:
        raise Conflict(f"version {known} was committed after {after}")
    target, store = _store(spark, f"{path}/commits/{known + 1:012d}.json")
    draft, _ = _store(spark, f"{path}/commits/.{uuid.uuid4().hex}.tmp")
    out = store.create(draft, False)
    out.write(bytearray(json.dumps({"number": known + 1, "folder": folder, "schema_version": schema_version, "ingest_version": ingest_version}).encode()))
    out.close()
    if store.exists(target) or not store.rename(draft, target):
        store.delete(draft, False)
        raise Conflict(f"version {known + 1} is committed already")
    return known + 1


def load(spark: SparkSession, path: str, schema: str, schema_version: int, ingest_version: str) -> tuple[DataFrame, str, int]:
    """The manifest (with ``schema``), why it is empty if a guard emptied it (``ok``,
    ``missing``, ``schema`` or ``ingest``), and the number of the last version."""
    last = latest(spark, path)
    if last is None:
        return spark.createDataFrame([], schema), "missing", 0
    state = "schema" if last["schema_version"] != schema_version else "ingest" if last["ingest_version"] != ingest_version else "ok"
    if state != "ok":
        return spark.createDataFrame([], schema), state, last["number"]
    return spark.read.schema(schema).parquet(f"{path}/{last['folder']}"), state, last["number"]


def prune(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete the folders of all but the last ``keep`` versions, those of runs that
    died included; return how many. Not to be run beside a run that writes."""
    where, store = _store(spark, f"{path}/versions")
    if not store.exists(where):
        return 0
    named = spark.read.schema(COMMIT).json(f"{path}/commits").where("folder is not null").orderBy(F.desc("number")).limit(keep).collect() if latest(spark, path) else []
    held = {r["folder"].rpartition("/")[2] for r in named}
    gone = [f.getPath() for f in store.listStatus(where) if f.getPath().getName() not in held]
    return sum(bool(store.delete(p, True)) for p in gone)
