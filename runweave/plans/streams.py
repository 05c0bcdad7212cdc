"""Queries of the streaming operators: a stream over the events table, drained, against the batch answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import growing as G
from ..streaming import streams as X
from .grid import ZONES, query
from .ingest import LOG_GRID, named, read_in_lots

STATE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events(spark: SparkSession, d: str) -> DataFrame:
    spark.conf.set(STATE, ROCKS)
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events[.]parquet")  # a pattern, as the table may be one file or a folder


def orders(spark: SparkSession, d: str) -> DataFrame:
    spark.conf.set(STATE, ROCKS)
    return spark.readStream.schema(spark.read.parquet(f"{d}/orders.parquet").schema).parquet(f"{d}/orders[.]parquet")


@query("stream_cumulative", "user_id n", "total", "o AS (SELECT user_id, value, epoch_us(ts) / 1e6 AS t FROM events), l AS (SELECT user_id, 5e-1 * (value + lag(value) OVER w) * (t - lag(t) OVER w) / 1e6 AS a FROM o WINDOW w AS (PARTITION BY user_id ORDER BY t, value)) ;; SELECT user_id, count(*) AS n, coalesce(sum(a), 0) AS total FROM l GROUP BY 1", grid=False)
def stream_cumulative(spark, d):
    s = events(spark, d).select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("value").alias("y"))
    out = X.drained(X.cumulative(s, "user_id"), "cumulative")
    return out.groupBy("user_id").agg(F.count("*").alias("n"), (F.max_by("total", "t") / 1e6).alias("total"))


@query("stream_in_order", "user_id n", "total", "m AS (SELECT max(epoch_ms(ts)) - 3600000 AS passed FROM events), o AS (SELECT user_id, value, epoch_us(ts) / 1e6 AS t FROM events, m WHERE epoch_ms(ts) <= passed), l AS (SELECT user_id, 5e-1 * (value + lag(value) OVER w) * (t - lag(t) OVER w) / 1e6 AS a FROM o WINDOW w AS (PARTITION BY user_id ORDER BY t, value)) ;; SELECT user_id, count(*) AS n, coalesce(sum(a), 0) AS total FROM l GROUP BY 1", grid=False)
def stream_in_order(spark, d):
    """The integral of all rows that the watermark, an hour late, has passed at the end."""
    s = events(spark, d).select("user_id", F.col("ts").cast("timestamp").alias("at"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("value").alias("y"))
    out = X.drained(X.cumulative(s, "user_id", at="at", delay="1 hour"), "in-order")
    return out.groupBy("user_id").agg(F.count("*").alias("n"), (F.max_by("total", "t") / 1e6).alias("total"))


@query("stream_run_status", "user_id n last_valid last_time", "", "SELECT user_id, count(*) AS n, max(epoch_us(ts)) AS last_time, max_by(value > 1e1, event_id) AS last_valid FROM events GROUP BY 1", grid=False)
def stream_run_status(spark, d):
    s = events(spark, d).select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("time_s"), F.col("event_id").alias("snapshot_index"), (F.col("value") > 10).alias("valid"))
    return X.drained(X.run_status(s, "user_id"), "status", "complete")


@query("stream_out_of_order", "key n", "", "o AS (SELECT o_custkey AS key, o_orderkey AS n, o_orderdate AS t, max(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM orders) ;; SELECT key, n FROM o WHERE t < m", grid=False)
def stream_out_of_order(spark, d):
    """Orders of a customer whose date is before that of one with a smaller number."""
    s = orders(spark, d).select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("n"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("t"))
    return X.drained(X.out_of_order(s), "order").select("key", "n")


@query("stream_front")
def stream_front(spark, d):
    """Order lines as scores: a supplier is a run, a quarter a snapshot, a part class an interface."""
    spark.conf.set(STATE, ROCKS)
    lines = spark.readStream.schema(spark.read.parquet(f"{d}/lineitem.parquet").schema).parquet(f"{d}/lineitem[.]parquet")
    when = F.col("l_shipdate")
    s = lines.select(F.col("l_suppkey").alias("run_id"), ((F.year(when) - 1992) * 4 + F.quarter(when) - 1).cast("int").alias("snapshot_index"), (F.col("l_partkey") % ZONES).cast("int").alias("interface_id"), F.col("l_quantity").alias("score"))
    return X.drained(X.front(s, threshold=20.0), "front")


@query("stream_means", "start event_type n", "mean", "SELECT epoch_us(date_trunc('hour', ts)) AS start, event_type, avg(value) AS mean, count(*) AS n FROM events GROUP BY 1, 2", grid=False)
def stream_means(spark, d):
    s = events(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("w", F.lit(1.0))
    out = X.drained(X.means(s, "ts", "1 hour", ["event_type"], "value", "w"), "means", "complete")
    return out.select(F.unix_micros("window.start").alias("start"), "event_type", "mean", "n")


@query("stream_snapshots", "file block cycle", "time_s time_step_s", "s AS (SELECT DISTINCT run_id, snapshot_index, time_s FROM g) ;; SELECT 'run_' || run_id AS file, CAST(row_number() OVER (PARTITION BY run_id ORDER BY snapshot_index) - 1 AS INT) AS block, CAST(snapshot_index AS BIGINT) AS cycle, time_s, 1e-1 AS time_step_s FROM s")
def stream_snapshots(spark, d):
    """Logs that lie in a folder of arriving files, one per run."""
    return read_in_lots(spark, d, "arriving", lambda folder, _: named(X.drained(X.snapshot_stream(spark, folder), "snapshots")))


@query("stream_growing_logs", "file cycle zones", "time_s density", LOG_GRID + ";; SELECT 'run_' || run_id AS file, CAST(snapshot_index AS BIGINT) AS cycle, count(*) AS zones, any_value(time_s) AS time_s, sum(3e0 * density) AS density FROM (SELECT *, snapshot_index = max(snapshot_index) OVER (PARTITION BY run_id) AS fin FROM w) WHERE NOT fin OR (run_id % 4 > 0 AND run_id % 5 > 0) GROUP BY 1, 2")
def stream_growing_logs(spark, d):
    """Logs that are still written: a last block counts once the run's footer is there."""

    def read(folder, _):
        b = G.arriving_blocks(spark, folder)
        density = F.aggregate(F.col("fields")["density"], F.lit(0.0), lambda a, x: a + x)
        return X.drained(named(b).select("file", "cycle", F.size("zones").cast("long").alias("zones"), "time_s", density.alias("density")), "growing")

    return read_in_lots(spark, d, "growing", read)
