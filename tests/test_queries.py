"""Every registered query against its SQL, and its schema, at the smallest size."""

import os

import duckdb
import pytest

from tessera import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    connection.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return connection


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, sql, name):
    df = catalog.QUERIES[name](spark, DATA)
    result = sql.execute(catalog.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    got, want = rows(df.columns, df.collect()), rows(columns, result.fetchall())
    assert got == want and got


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_streaming_breaker_equals_batch(spark):
    import collections

    events = spark.read.parquet(f"{DATA}/events.parquet").selectExpr("user_id", "unix_micros(cast(ts as timestamp)) / 1e6 as t", "value >= 30 as ok").collect()
    want = collections.Counter()
    by_user = collections.defaultdict(list)
    for r in events:
        by_user[r.user_id].append((r.t, r.ok))
    for user, rows_ in by_user.items():
        failures, opened = 0, None
        for t, ok in sorted(rows_):
            if opened is not None and t - opened < 60:
                state = "open"
            elif ok:
                failures, opened, state = 0, None, "closed"
            else:
                failures += 1
                opened = t if opened is not None or failures >= 3 else None
                state = "open" if opened is not None else "closed"
            want[(user, state)] += 1
    got = catalog.QUERIES["streaming_breaker"](spark, DATA).groupBy("user_id", "state").count().collect()
    assert {(r["user_id"], r["state"]): r["count"] for r in got} == dict(want)
