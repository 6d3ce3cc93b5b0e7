"""Registered queries over time series and keyed records, batch and stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import series
from lectern.plans.base import finish, query, table
from lectern.session import work_path
from lectern.streaming import records

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _stamp(col):
    """Times as text, so that results do not depend on a session's time zone or clock resolution."""
    return F.date_format(col, STAMP)


def stamp_sql(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S.%f')"


def _long(spark, sf):
    return table(spark, sf, "events").select("ts", F.col("event_type").alias("tag"), "value")


@query(
    "load_series",
    f"SELECT {stamp_sql('ts')} AS ts, CASE WHEN event_id % 7 <> 3 THEN value END AS tag_1, event_id * 1.5::DOUBLE AS tag_2 FROM events WHERE event_id % 50 <> 0",
)
def load_series(spark, sf):
    k = F.col("event_id")
    wide = table(spark, sf, "events").select(
        F.when(k % 50 == 0, "X2XJQLH").otherwise(_stamp(F.col("ts"))).alias("time"),
        F.when(k % 7 == 3, "bad").otherwise(F.col("value").cast("string")).alias("tag_1"),
        (k * 1.5).cast("string").alias("tag_2"),
    )
    return series.load_series(wide, "time").select(_stamp(F.col("ts")).alias("ts"), "tag_1", "tag_2")


STATS = "round(avg(value), 9) AS mean_value, min(value) AS min_value, max(value) AS max_value"


@query("series_profile", f"SELECT event_type AS tag, count(*) AS n, {stamp_sql('min(ts)')} AS first_ts, {stamp_sql('max(ts)')} AS last_ts, {STATS} FROM events GROUP BY 1")
def series_profile(spark, sf):
    out = series.series_profile(_long(spark, sf))
    return out.withColumn("first_ts", _stamp(F.col("first_ts"))).withColumn("last_ts", _stamp(F.col("last_ts")))


@query("wide_profile", "SELECT tag, count(*) AS n, round(avg(v), 9) AS mean_value, min(v) AS min_value, max(v) AS max_value FROM (SELECT 'tag_1' AS tag, value AS v FROM events UNION ALL SELECT 'tag_2', value * 2 FROM events) GROUP BY tag")
def wide_profile(spark, sf):
    wide = table(spark, sf, "events").select("ts", F.col("value").alias("tag_1"), (F.col("value") * 2).alias("tag_2"))
    return series.series_profile(series.to_long(wide, ["tag_1", "tag_2"])).drop("first_ts", "last_ts")


@query(
    "range_stats",
    "SELECT event_type AS tag, count(*) AS n, " + STATS + f", {stamp_sql('arg_min(ts, row(value, ts))')} AS min_at, {stamp_sql('arg_min(ts, row(-value, ts))')} AS max_at "
    "FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' GROUP BY 1",
)
def range_stats(spark, sf):
    a, b = (F.to_timestamp_ntz(F.lit(d)) for d in ("2024-01-05 00:00:00", "2024-01-20 00:00:00"))
    out = series.range_stats(_long(spark, sf), a, b)
    return out.withColumn("min_at", _stamp(F.col("min_at"))).withColumn("max_at", _stamp(F.col("max_at")))


@query("resample", f"SELECT event_type AS tag, {stamp_sql(chr(116) + 'ime_bucket(INTERVAL 1 HOUR, ts)')} AS bucket, count(value) AS n, {STATS} FROM events GROUP BY 1, 2")
def resample(spark, sf):
    return series.resample(_long(spark, sf), "1 hour").withColumn("bucket", _stamp(F.col("bucket")))


@query(
    "trend",
    "SELECT *, CASE WHEN slope > 0 THEN 'up' WHEN slope < 0 THEN 'down' ELSE 'flat' END AS direction FROM (SELECT event_type AS tag, round(regr_slope(value, epoch_us(ts) / 3.6e9::DOUBLE), 6) AS slope, "
    "round(arg_max(value, ts) - arg_min(value, ts), 9) AS change, count(*) AS n FROM events GROUP BY 1)",
)
def trend(spark, sf):
    return series.trend(_long(spark, sf))


# ------------------------------------------------------------------------------------------------ keyed records

UPDATES = "up AS (SELECT user_id, epoch_us(ts) AS tm, CASE WHEN event_id % 4 <> 0 THEN event_type END AS status, CASE WHEN event_id % 3 <> 0 THEN value END AS percent, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS pos FROM events)"


def record_sql(keys: str, span: int, unstored: str = "false") -> str:
    on = " AND ".join(f"i.{k.strip()} = f.{k.strip()}" for k in keys.split(","))
    cols = ", ".join(f"i.{k.strip()}" for k in keys.split(","))
    return f"""rc AS (SELECT {keys}, pos, tm AS opened, {unstored} AS lost FROM up WHERE pos = 1
  UNION ALL SELECT {cols}, i.pos, CASE WHEN f.lost OR i.tm >= f.opened + {span} THEN i.tm ELSE f.opened END,
  CASE WHEN f.lost OR i.tm >= f.opened + {span} THEN {unstored} ELSE false END
  FROM rc f JOIN up i ON {on} AND i.pos = f.pos + 1)"""


DAY, HOUR = 24 * records.MICROS_PER_HOUR, records.MICROS_PER_HOUR
TASK_SQL = finish(UPDATES, record_sql("user_id", DAY), select="SELECT user_id, opened, count(*) AS n_updates, arg_max(status, pos) FILTER (WHERE status IS NOT NULL) AS status, arg_max(percent, pos) FILTER (WHERE percent IS NOT NULL) AS percent FROM rc JOIN up USING (user_id, pos) GROUP BY 1, 2")


def _updates(events):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    k = F.col("event_id")
    return events.select(
        "user_id", F.col("ts").cast("timestamp").alias("ts"), at.alias("at"), F.when(k % 4 != 0, F.col("event_type")).alias("status"),
        F.when(k % 3 != 0, F.col("value")).alias("percent"),
    )


@query("latest_task_state", TASK_SQL)
def latest_task_state(spark, sf):
    return records.latest_task_state(_updates(table(spark, sf, "events")), "user_id", "at", ["status", "percent"])


ASKS = "up AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS tm, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS pos FROM events)"
ASK_SQL = finish(ASKS, record_sql("user_id, event_type", 24 * HOUR, "up.event_id % 10 = 0").replace("THEN up.event_id % 10 = 0", "THEN i.event_id % 10 = 0"),
                 select="SELECT event_id, opened < tm AS answered_from_store FROM rc JOIN up USING (user_id, event_type, pos)")


def _asks(events):
    return events.select(
        "event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        (F.col("event_id") % 10 == 0).alias("lost"),
    )


@query("repeat_query_dedup", ASK_SQL)
def repeat_query_dedup(spark, sf):
    asked = _asks(table(spark, sf, "events"))
    return records.repeat_query_dedup(asked, ["user_id", "event_type"], "at", 24, "lost").select("event_id", "answered_from_store")


def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _drain(spark, events, name, shape):
    """Run a stream to its end, close it, and read its results."""
    path = work_path(spark, name)
    records.open_stream(spark, f"{path}-end", "ts")
    for last in (False, True):
        if last:
            records.close_stream(spark, f"{path}-end", "ts")
        out = shape(records.closing(events, "ts", f"{path}-end"))
        records.write_outputs(out, path, f"{path}-checkpoint").awaitTermination()
    return records.read_outputs(spark, out, path)[0]


@query("latest_task_state_stream", TASK_SQL)
def latest_task_state_stream(spark, sf):
    records.use_rocksdb(spark)
    shape = lambda up: records.stream_task_state(up, "user_id", "ts", "at", ["status", "percent"])
    rows = _drain(spark, _updates(_event_stream(spark, sf)), "tasks", shape)
    newest = rows.groupBy("user_id", "opened").agg(F.max_by(F.struct("n_updates", "status", "percent"), "n_updates").alias("r"))
    return newest.select("user_id", "opened", "r.n_updates", "r.status", "r.percent")


@query("repeat_query_dedup_stream", ASK_SQL)
def repeat_query_dedup_stream(spark, sf):
    records.use_rocksdb(spark)
    shape = lambda asked: records.stream_repeat_dedup(asked, ["user_id", "event_type"], "ts", "at", ["event_id"], 24, "lost")
    return _drain(spark, _asks(_event_stream(spark, sf)), "asks", shape).select("event_id", "answered_from_store")
