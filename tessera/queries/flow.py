"""Event-time windows, telemetry and flow control over the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.queries.registry import Tables, query
from tessera.streaming import events as E


def timed(t: Tables) -> DataFrame:
    return E.with_time(t.events)


def stream(t: Tables, late: str = "40 days") -> DataFrame:
    """The events as a file stream."""
    return E.with_time(t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parquet*"), late=late)


def epochs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.unix_seconds(c) for c in columns})


TUMBLING = """
select epoch(time_bucket(interval '1 hour', ts))::bigint as start, epoch(time_bucket(interval '1 hour', ts))::bigint + 3600 as "end", event_type, count(*) as n, round(sum(value), 4) as total from events group by all
"""


@query("ST-2 2.19", TUMBLING)
def tumbling_counts(t: Tables) -> DataFrame:
    return epochs(E.tumbling(timed(t), "1 hour", ["event_type"], "value"), "start", "end")


@query("ST-2 2.19", TUMBLING)
def streaming_tumbling_counts(t: Tables) -> DataFrame:
    return epochs(E.run_available(E.tumbling(stream(t), "1 hour", ["event_type"], "value"), "complete"), "start", "end")


@query("2.19", """
with s as (select epoch(time_bucket(interval '1 hour', ts))::bigint - k * 3600 as start, value from events cross join (select unnest([0, 1]) as k))
select start, start + 7200 as "end", count(*) as n, round(sum(value), 4) as total from s group by start
""")
def sliding_counts(t: Tables) -> DataFrame:
    return epochs(E.tumbling(timed(t), "2 hours", [], "value", slide="1 hour"), "start", "end")


@query("2.19", """
with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as new from events), s as (select user_id, ts, sum(new) over (partition by user_id order by ts, new desc rows unbounded preceding) as k from g)
select user_id, floor(epoch(min(ts)))::bigint as start, floor(epoch(max(ts)))::bigint + 1800 as "end", count(*) as n from s group by user_id, k
""")
def session_counts(t: Tables) -> DataFrame:
    return epochs(E.sessions(timed(t), "30 minutes", ["user_id"]), "start", "end")


@query("ST-2 AG-34", """
select user_id, count(*) as n, round(epoch(max(ts)) - epoch(min(ts)), 3) as total_s, round(epoch(min(case when event_type = 'click' then ts end)) - epoch(min(ts)), 3) as first_s from events group by user_id
""")
def stage_latency(t: Tables) -> DataFrame:
    out = E.stage_latency(timed(t), "user_id", "ts", "event_type", "click")
    return out.select("user_id", "n", F.round("total_s", 3).alias("total_s"), F.round("first_s", 3).alias("first_s"))


@query("ST-3", """
with x as (select user_id, event_id, case when value < 30 then 1 else 0 end as bad, sum(case when value < 30 then 0 else 1 end) over (partition by user_id order by event_id) as k from events)
select user_id, count(*) as failures, min(event_id) as first, max(event_id) as last from x where bad = 1 group by user_id, k having count(*) >= 3
""")
def breaker_islands(t: Tables) -> DataFrame:
    return E.failure_islands(t.events, F.col("value") < 30, "user_id", ["event_id"])


@query("ST-3 ST-1")
def streaming_breaker(t: Tables) -> DataFrame:
    rows = stream(t).select("user_id", (F.unix_micros("ts") / 1e6).alias("t"), (F.col("value") >= 30).alias("ok"))
    return E.run_available(E.breaker(rows, "user_id"), "append")


@query("ST-4 ST-7", """
with x as (select event_id, user_id, epoch(ts) as t, row_number() over (partition by user_id order by epoch(ts), event_id) as i from events)
select event_id, user_id, round(max(t - i * 600) over (partition by user_id order by i) + i * 600, 1) as due from x
""")
def limiter_schedule(t: Tables) -> DataFrame:
    rows = timed(t).select("event_id", "user_id", (F.unix_micros("ts") / 1e6).alias("t"))
    return E.limiter_schedule(rows, "user_id", "t", 600.0, "event_id").select("event_id", "user_id", F.round("due", 1).alias("due"))


@query("TXT-34", """
select event_id as id, k as pos, case when k = 0 then props else '{}' end as event from events cross join (select unnest([0, 1]) as k)
""")
def sse_events(t: Tables) -> DataFrame:
    bodies = t.events.select("event_id", F.concat(F.lit("event: x\ndata: "), "props", F.lit("\n\ndata: {}")).alias("body"))
    return E.sse_events(bodies, "event_id", "body")


@query("2.19 ST-8", "select user_id, event_type, count(*) as n from events group by all")
def streaming_dedupe(t: Tables) -> DataFrame:
    rows = E.deduplicated(stream(t), ["event_id"]).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return E.run_available(rows, "complete")
