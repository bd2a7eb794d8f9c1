"""Date and time functions; timestamps stay without time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.base import Registry, Tables
from ..sql.to_char import java_pattern

R = Registry()


def date_trunc(unit: str, ts: Column) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def to_char(ts: Column, template: str) -> Column:
    return F.date_format(ts, java_pattern(template))


def date_bin(seconds: int, ts: Column) -> Column:
    """The start of the interval of so many seconds since the epoch that holds ts."""
    epoch = F.unix_seconds(ts.cast("timestamp"))
    return F.timestamp_seconds(epoch - F.pmod(epoch, F.lit(seconds))).cast("timestamp_ntz")


@R.operator("SELECT o_orderkey, extract(year FROM o_orderdate) AS y, extract(month FROM o_orderdate) AS m, extract(day FROM o_orderdate) AS d, extract(quarter FROM o_orderdate) AS q, extract(doy FROM o_orderdate) AS doy FROM orders")
def fn_extract(t: Tables) -> DataFrame:
    ts = F.col("o_orderdate")
    return t.orders.select("o_orderkey", *(f(ts).cast("bigint").alias(n) for f, n in ((F.year, "y"), (F.month, "m"), (F.dayofmonth, "d"), (F.quarter, "q"), (F.dayofyear, "doy"))))


@R.operator("SELECT event_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS d, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h, CAST(date_trunc('month', ts) AS TIMESTAMP) AS m FROM events")
def fn_date_trunc(t: Tables) -> DataFrame:
    ts = F.col("ts")
    return t.events.select("event_id", date_trunc("day", ts).alias("d"), date_trunc("hour", ts).alias("h"), date_trunc("month", ts).alias("m"))


@R.operator("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS a, strftime(ts, '%d %b %Y') AS b, strftime(ts, 'day %j, %I %p') AS c FROM events")
def fn_to_char(t: Tables) -> DataFrame:
    ts = F.col("ts")
    return t.events.select("event_id", to_char(ts, "YYYY-MM-DD HH24:MI:SS").alias("a"), to_char(ts, "DD Mon YYYY").alias("b"), F.concat(F.lit("day "), to_char(ts, "DDD, HH12 AM")).alias("c"))


@R.operator("""
SELECT event_id, time_bucket(INTERVAL '15 minutes', ts) AS bin, ts + INTERVAL '36 hours' AS later, CAST(floor(epoch(ts)) AS BIGINT) AS secs, date_diff('day', TIMESTAMP '2020-01-01', ts) AS days,
       make_date(CAST(extract(year FROM ts) AS BIGINT), 1, 1) AS jan, CAST(ts AS DATE) AS day FROM events""")
def fn_date_arithmetic(t: Tables) -> DataFrame:
    ts = F.col("ts")
    return t.events.select(
        "event_id", date_bin(900, ts).alias("bin"), (ts + F.expr("INTERVAL '36' HOUR")).alias("later"), F.unix_seconds(ts.cast("timestamp")).alias("secs"),
        F.datediff(ts, F.lit("2020-01-01").cast("date")).cast("bigint").alias("days"), F.make_date(F.year(ts), F.lit(1), F.lit(1)).alias("jan"), F.to_date(ts).alias("day"),
    )


@R.operator("SELECT CAST(to_timestamp(1700000000) AT TIME ZONE 'UTC' AS TIMESTAMP) AS a, CAST('2024-02-29' AS DATE) AS b, CAST('2024-02-29 12:30:00' AS TIMESTAMP) AS c")
def fn_date_parse(t: Tables) -> DataFrame:
    return t.spark.range(1).select(
        F.timestamp_seconds(F.lit(1700000000)).cast("timestamp_ntz").alias("a"), F.to_date(F.lit("2024-02-29")).alias("b"), F.lit("2024-02-29 12:30:00").cast("timestamp_ntz").alias("c")
    )
