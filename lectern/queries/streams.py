"""Streams, run over a table until all of it has been read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import storage
from ..streaming import histories, sessions
from .registry import query


def _drained(spark, stream, name):
    """What an append-mode stream has written when it has read everything there is."""
    path = storage.new_path(spark, name)
    running = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("x11_reading_sessions", """with e as (select user_id, ts, coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval 30 minute, true) as opens from events),
s as (select user_id, ts, sum(case when opens then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as k from e),
g as (select user_id, min(ts) as start, max(ts) + interval 30 minute as stop, count(*) as events from s group by user_id, k)
select user_id, epoch_us(start) as start_us, epoch_us(stop) as stop_us, events from g where stop <= (select max(ts) from events) - interval 1 hour""")
def reading_sessions(spark, d):
    """The sessions that the watermark has closed: those that end an hour or more before the last event."""
    done = _drained(spark, sessions.sessions(sessions.activity(spark, f"{d}/events.parquet*")), "sessions")
    return done.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("stop").cast("timestamp")).alias("stop_us"), "events")


@query("x12_history_stream", """with l as (select user_id, event_type, max(ts) as ts, arg_max(event_id, (ts, event_id)) as event_id from events group by user_id, event_type)
select user_id, event_type as address, epoch_us(ts) as at_us, event_id, rank from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rank from l) where rank <= 40""")
def history_stream(spark, d):
    """Histories from a stream's state, when it has read all activity."""
    events = sessions.activity(spark, f"{d}/events.parquet*")
    visits = events.select("user_id", F.col("event_type").alias("address"), F.unix_micros("ts").alias("at"), F.col("event_id").alias("tie"))
    path = storage.new_path(spark, "histories")
    histories.write(histories.lists(visits), path).awaitTermination()
    return histories.read(spark, path).select("user_id", "address", F.col("at").alias("at_us"), F.col("tie").alias("event_id"), "rank")
