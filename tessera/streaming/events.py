"""Event-time windows, sessions, request telemetry and flow control.

Aggregates take a batch or a streaming DataFrame. ``run_available`` runs a
streaming query over what is there and returns its result, so the two can be
compared. TIMESTAMP_NTZ columns are cast with the session's time zone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.retrieval import DIGITS
from tessera.session import stored


def with_time(events: DataFrame, ts: str = "ts", late: str | None = None) -> DataFrame:
    """``ts`` as TIMESTAMP, with a watermark on a stream."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return rows.withWatermark(ts, late) if late and rows.isStreaming else rows


def tumbling(events: DataFrame, size: str, by: list[str], value: str, ts: str = "ts", slide: str | None = None) -> DataFrame:
    """Counts and sums by window and key; sliding windows with ``slide``."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = events.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str, by: list[str], ts: str = "ts") -> DataFrame:
    """Counts by session: events of a key less than ``gap`` apart."""
    out = events.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: list[str]) -> DataFrame:
    """First of equal events; within the watermark on a stream."""
    return events.dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def stage_latency(events: DataFrame, by: str, ts: str, kind: str, first: str) -> DataFrame:
    """Requests by key: events, total seconds, seconds to the first event of a kind."""
    start, end = F.min(ts), F.max(ts)
    hit = F.min(F.when(F.col(kind) == first, F.col(ts)))
    seconds = lambda a, b: F.round((F.unix_micros(b) - F.unix_micros(a)) / 1e6, DIGITS)
    return events.groupBy(by).agg(F.count(F.lit(1)).alias("n"), seconds(start, end).alias("total_s"), seconds(start, hit).alias("first_s"))


def failure_islands(events: DataFrame, failed: Column, by: str, order: list[str], threshold: int = 3) -> DataFrame:
    """Runs of at least ``threshold`` failures in a row: key, number, first and last event."""
    w = Window.partitionBy(by).orderBy(*order)
    rows = events.withColumn("_bad", F.coalesce(failed, F.lit(False)).cast("int"))
    rows = rows.withColumn("_island", F.sum(1 - F.col("_bad")).over(w)).where("_bad = 1")
    out = rows.groupBy(by, "_island").agg(F.count(F.lit(1)).alias("failures"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))
    return out.where(F.col("failures") >= threshold).drop("_island")


def breaker(events: DataFrame, by: str, threshold: int = 3, cooldown_s: float = 60.0) -> DataFrame:
    """State of each key's circuit breaker after each event, as a stream operator.

    ``events`` has the key, ``t`` (seconds) and ``ok``. It opens at ``threshold``
    failures in a row; after ``cooldown_s`` an event is let through half open: if
    it fails the breaker opens again, else it closes. Events of a micro-batch are
    put in order of t.
    """
    key_type = dict(events.dtypes)[by]

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        failures, opened = state.get if state.exists else (0, -1.0)
        rows = pd.concat(list(frames)).sort_values(["t", "ok"], kind="stable")
        out = []
        for t, ok in zip(rows["t"], rows["ok"]):
            if opened >= 0 and t - opened < cooldown_s:
                out.append((key[0], t, "open"))
                continue
            half = opened >= 0
            if ok:
                failures, opened = 0, -1.0
            else:
                failures += 1
                opened = t if half or failures >= threshold else -1.0
            out.append((key[0], t, "open" if opened >= 0 else "closed"))
        state.update((int(failures), float(opened)))
        yield pd.DataFrame(out, columns=[by, "t", "state"])

    return events.groupBy(by).applyInPandasWithState(update, f"{by} {key_type}, t double, state string", "failures int, opened double", "append", "NoTimeout")


def limiter_schedule(requests: DataFrame, by: str, t: str, spacing: float, id_col: str) -> DataFrame:
    """Start of each request where starts are ``spacing`` apart at least:
    due_i = max over j <= i of (t_j + (i - j) * spacing), a running maximum."""
    w = Window.partitionBy(by).orderBy(t, id_col)
    rows = requests.withColumn("_i", F.row_number().over(w))
    due = F.max(F.col(t) - F.col("_i") * spacing).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_i") * spacing
    return rows.withColumn("due", F.round(due, DIGITS)).drop("_i")


def sse_events(bodies: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """id, pos, event: the JSON text after 'data: ' of each line of a body."""
    lines = F.filter(F.split(body_col, "\n"), lambda x: F.startswith(x, F.lit("data: ")))
    return bodies.select(F.col(id_col).alias("id"), F.posexplode(F.transform(lines, lambda x: F.substr(x, F.lit(7)))).alias("pos", "event"))


def run_available(stream: DataFrame, mode: str, schema_of: DataFrame | None = None) -> DataFrame:
    """Run a streaming query over the input that is there; its rows as a table.

    ``append`` and ``update`` keep what every batch emits; ``complete`` keeps the
    last batch's. State and results are in the shared scratch folder.
    """
    spark = stream.sparkSession
    scratch = stored(spark.range(1))
    base = scratch.inputFiles()[0].rpartition("/")[0]
    out = f"{base}-stream"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{'last' if mode == 'complete' else number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(out)
