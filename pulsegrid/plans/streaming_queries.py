"""Queries that run the streaming operators over the events table (as a table, or as a stream of its files)."""

from pyspark.sql import functions as F

from pulsegrid.sources.events import events
from pulsegrid.streaming import online

from .registry import query


def timed(spark, d):
    return events(spark, d).select(F.col("user_id").alias("train"), F.col("ts").cast("timestamp").alias("ts"))


@query("""WITH g AS (SELECT user_id AS train, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), k AS (SELECT *, sum(new) OVER (PARTITION BY train ORDER BY ts) AS run FROM g)
SELECT train, epoch_us(min(ts))::BIGINT AS start_us, epoch_us(max(ts) + INTERVAL 2 HOUR)::BIGINT AS end_us, count(*) AS n FROM k GROUP BY train, run""")
def session_packets(spark, d):
    x = online.packets(timed(spark, d), "2 hours")
    return x.select("train", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("SELECT user_id AS train, epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01'))::BIGINT AS start_us, count(*) AS n FROM events GROUP BY ALL")
def window_counts(spark, d):
    return online.window_counts(timed(spark, d), "6 hours").select("train", F.unix_micros("start").alias("start_us"), "n")
