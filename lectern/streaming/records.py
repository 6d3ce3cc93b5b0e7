"""Keyed records with a lifetime: task state from partial updates, and repeated questions.

Both follow one rule: a record opens at an event, lives for a fixed time from there, and the first event
behind that opens the next one. The batch forms find the openings with ``mark_spans``, which spreads heavy
keys; the stream forms keep one small state per key. State needs the RocksDB store, set by ``use_rocksdb``.

The stream forms apply events in the order of their times, not of their arrival: an event waits in its key's list until the watermark has
passed it, so that none that may still come is older. What arrives behind the watermark is late: it changes nothing and goes to a side
output, with its time in ``late_at``. A stream that has an end is closed by one row far in the future (``closing``), which lets go of
all events that wait.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.operators.runs import mark_spans
from lectern.session import path_exists

TASK_HOURS = 24  # fixed value: lifetime of a task record
ANSWER_HOURS = 1  # fixed value: lifetime of a stored answer
MICROS_PER_HOUR = 3_600_000_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


# ---------------------------------------------------------------------------------------------------- batch


def latest_task_state(
    updates: DataFrame, key: str, at: str, fields: Sequence[str], hours: int = TASK_HOURS, tie: str | None = None
) -> DataFrame:
    """(key, opened, *fields, n_updates): per record the last value of each field that was given.

    ``at`` is a time in microseconds. Updates of equal time are ordered by ``tie``.
    """
    times = updates.select(key, at).distinct()
    spans = mark_spans(times, [key], at, hours * MICROS_PER_HOUR)
    order = F.struct(at, tie) if tie else F.col(at)
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields]
    return updates.join(spans, [key, at]).groupBy(key, F.col("run_start").alias("opened")).agg(*last, F.count("*").alias("n_updates"))


def repeat_query_dedup(
    asked: DataFrame, keys: Sequence[str], at: str, hours: int = ANSWER_HOURS, fallback: str | None = None
) -> DataFrame:
    """Add ``answered_from_store``: false for the ask that opens a record, true until its lifetime is over.

    ``at`` (microseconds) is unique per key. The answer to an ask marked ``fallback`` is not stored, so the
    next ask is answered anew.
    """
    unstored = None if fallback is None else F.col(fallback)
    marked = mark_spans(asked, list(keys), at, hours * MICROS_PER_HOUR, unstored)
    return marked.withColumn("answered_from_store", F.col("run_start") < F.col(at)).drop("run_start")


# --------------------------------------------------------------------------------------------------- stream

END = "9999-01-01 00:00:00"  # later than any event


class InEventOrder(StatefulProcessor):
    """Keeps a key's events until the watermark has passed them and hands them on in order.

    ``columns`` are an event's values, the time in microseconds (``at``) among them; ``tie`` orders events of equal time. Subclasses give
    ``apply(key, events)``, which returns output rows and registers nothing, and ``ends()``, the time in microseconds at which the key's
    record is over (None without one) with ``forget()`` to drop it.
    """

    def __init__(self, columns: Sequence[str], event_schema: str, at: str, tie: str | None, late_schema: Sequence[str], kinds: dict[str, str]):
        self.columns, self.event_schema, self.at, self.tie = list(columns), event_schema, self._place(columns, at), tie
        self.order = [self.at] + ([self._place(columns, tie)] if tie else [])
        self.out_columns, self.kinds = list(late_schema), kinds

    @staticmethod
    def _place(columns: Sequence[str], name: str) -> int:
        return list(columns).index(name)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.event_schema)

    def frame(self, rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.out_columns).astype(self.kinds)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        late, kept = [], []
        for frame in rows:
            for event in frame[self.columns].astype(object).itertuples(index=False, name=None):
                event = tuple(None if v is None or v != v else getattr(v, "item", lambda v=v: v)() for v in event)
                (late if event[self.at] // 1000 < mark else kept).append(event)
        if kept:
            self.waiting.appendList(kept)
            self.handle.registerTimer(min(e[self.at] for e in kept) // 1000 + 1)
        if late:
            yield self.frame([self.late(key, e) for e in late])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        events = [tuple(e) for e in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((e for e in events if e[self.at] // 1000 < mark), key=lambda e: tuple(e[i] for i in self.order))
        rest = [e for e in events if e[self.at] // 1000 >= mark]
        out = self.apply(key, ready) if ready else []
        if ready:
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(min(e[self.at] for e in rest) // 1000 + 1)
            else:
                self.waiting.clear()
        ends = self.ends()
        if ends is not None:
            # All events before the watermark are applied, so a record that ends before it serves no more.
            if ends // 1000 < mark:
                self.forget()
            elif ready:
                self.handle.registerTimer(ends // 1000 + 1)
        if out:
            yield self.frame(out)

    def late(self, key, event: tuple) -> dict:
        return {**dict(zip(self.columns, event)), **self.key_of(key), "late_at": event[self.at]}

    def key_of(self, key) -> dict:
        return {}

    def close(self) -> None:
        pass


class TaskRecords(InEventOrder):
    """Merges partial updates; emits the merged record whenever the watermark passes updates of it."""

    def __init__(self, key: str, key_type: str, at: str, fields: Sequence[str], types: Sequence[str], span: int, tie: str | None = None, tie_type: str = "bigint"):
        more = [(tie, tie_type)] if tie and tie not in fields else []
        columns = [at, *fields, *[n for n, _ in more]]
        events = ", ".join(f"`{n}` {t}" for n, t in [(at, "bigint"), *zip(fields, types), *more])
        super().__init__(columns, events, at, tie, [key, "opened", "n_updates", *fields, "late_at"], {"opened": "Int64", "n_updates": "Int64", "late_at": "Int64"})
        self.key, self.fields, self.span = key, list(fields), span
        self.state_schema = "opened bigint, n_updates bigint, " + ", ".join(f"`{f}` {t}" for f, t in zip(fields, types))
        self.output_schema = f"`{key}` {key_type}, {self.state_schema}, late_at bigint"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.record = handle.getValueState("record", self.state_schema)

    def key_of(self, key) -> dict:
        return {self.key: key[0]}

    def apply(self, key, events: list[tuple]) -> list[dict]:
        current = list(self.record.get()) if self.record.exists() else None
        touched = []
        for event in events:
            t = event[self.at]
            if current is None or t >= current[0] + self.span:
                current = [t, 0, *([None] * len(self.fields))]
                touched.append(current)
            elif not touched:
                touched.append(current)
            current[1] += 1
            for i, value in enumerate(event[1 : 1 + len(self.fields)]):
                if value is not None:
                    current[2 + i] = value
        self.record.update(tuple(current))
        return [dict(zip(self.out_columns, [key[0], *r, None])) for r in touched]

    def ends(self) -> int | None:
        return int(self.record.get()[0]) + self.span if self.record.exists() else None

    def forget(self) -> None:
        self.record.clear()


class RepeatedAsks(InEventOrder):
    """Marks asks that a stored answer serves; the state is the time of the last ask that was answered anew."""

    def __init__(self, columns: Sequence[str], types: Sequence[str], at: str, span: int, fallback: str | None, tie: str | None = None, more: dict[str, str] | None = None):
        extra = {at: "bigint", **({fallback: "boolean"} if fallback else {}), **(more or {})}
        named = {**extra, **dict(zip(columns, types))}
        events = ", ".join(f"`{n}` {t}" for n, t in named.items())
        super().__init__(list(named), events, at, tie, [*columns, "answered_from_store", "late_at"], {"answered_from_store": "boolean", "late_at": "Int64"})
        self.span, self.lost = span, self._place(list(named), fallback) if fallback else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.opened = handle.getValueState("opened", "at bigint")

    def apply(self, key, events: list[tuple]) -> list[dict]:
        opened = int(self.opened.get()[0]) if self.opened.exists() else None
        out = []
        for event in events:
            t = event[self.at]
            hit = opened is not None and t < opened + self.span
            if not hit:
                opened = None if self.lost is not None and event[self.lost] else t
            out.append({**dict(zip(self.columns, event)), "answered_from_store": hit, "late_at": None})
        if opened is not None:
            self.opened.update((opened,))
        elif self.opened.exists():
            self.opened.clear()
        return out

    def ends(self) -> int | None:
        return int(self.opened.get()[0]) + self.span if self.opened.exists() else None

    def forget(self) -> None:
        self.opened.clear()


def _in_order(stream: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str], delay: str, processor: InEventOrder, schema) -> DataFrame:
    """Run a processor over the events; the row that closes the stream only moves the watermark."""
    wanted = list(dict.fromkeys([*keys, *columns]))
    # Without the time column behind this point, rows behind the watermark reach the processor, which counts them as late.
    marked = stream.withWatermark(ts, delay).where(F.col(ts) < F.lit(END).cast("timestamp")).select(*wanted)
    return marked.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def stream_task_state(
    updates: DataFrame, key: str, ts: str, at: str, fields: Sequence[str], hours: int = TASK_HOURS, delay: str = "1 hour", tie: str | None = None
) -> DataFrame:
    """Stream form of ``latest_task_state``: rows of touched records, the one with most updates counts; late updates have ``late_at``."""
    kind = lambda c: updates.schema[c].dataType.simpleString()
    processor = TaskRecords(key, kind(key), at, fields, [kind(f) for f in fields], hours * MICROS_PER_HOUR, tie, kind(tie) if tie else "bigint")
    return _in_order(updates, [key], ts, processor.columns, delay, processor, processor.output_schema)


def stream_repeat_dedup(
    asked: DataFrame, keys: Sequence[str], ts: str, at: str, columns: Sequence[str], hours: int = ANSWER_HOURS,
    fallback: str | None = None, delay: str = "1 hour", tie: str | None = None,
) -> DataFrame:
    """Stream form of ``repeat_query_dedup`` over ``columns``; late asks have ``late_at`` and no answer."""
    kind = lambda c: asked.schema[c].dataType.simpleString()
    more = {tie: kind(tie)} if tie else {}
    processor = RepeatedAsks(columns, [kind(c) for c in columns], at, hours * MICROS_PER_HOUR, fallback, tie, more)
    schema = T.StructType([asked.schema[c] for c in columns] + [T.StructField("answered_from_store", T.BooleanType()), T.StructField("late_at", T.LongType())])
    return _in_order(asked, keys, ts, processor.columns, delay, processor, schema)


def closing(stream: DataFrame, ts: str, folder: str) -> DataFrame:
    """The stream with a second source that ``close_stream`` writes to."""
    marks = stream.sparkSession.readStream.schema(f"`{ts}` timestamp").parquet(folder)
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema if f.name != ts]
    return stream.unionByName(marks.select(ts, *rest))


def open_stream(spark: SparkSession, folder: str, ts: str) -> None:
    """An empty folder for ``closing``."""
    spark.createDataFrame([], f"`{ts}` timestamp").write.mode("overwrite").parquet(folder)


def close_stream(spark: SparkSession, folder: str, ts: str) -> None:
    """Say that no more events will come: when the stream runs again, all that wait are handed on."""
    spark.range(1).select(F.lit(END).cast("timestamp").alias(ts)).write.mode("append").parquet(folder)


def write_outputs(out: DataFrame, path: str, checkpoint: str):
    """Run a stream of records over all its input: results to ``path``, late rows to ``<path>-late``; a repeated batch changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        is_late: Column = F.col("late_at").isNotNull()
        batch.where(~is_late).drop("late_at").write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.where(is_late).write.mode("overwrite").parquet(f"{path}-late/batch={number}")
        batch.unpersist()

    return out.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_outputs(spark: SparkSession, out: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(results, late rows) that ``write_outputs`` has written so far."""
    schema = out.schema
    kept = T.StructType([f for f in schema if f.name != "late_at"])

    def read(folder: str, columns: T.StructType) -> DataFrame:
        if not path_exists(spark, folder):
            return spark.createDataFrame([], columns)
        return spark.read.schema(columns).parquet(f"{folder}/batch=*")

    return read(path, kept), read(f"{path}-late", schema)
