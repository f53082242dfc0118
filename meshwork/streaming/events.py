"""Event-time streams: windows, sessions, joins, deduplication, speeds, late rows, and their batch twins."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.store import shared_dir


def read(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    """Parquet files as they come; ts becomes a time that watermarks know."""
    reader = spark.readStream.schema(schema)
    rows = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


#: The state store that timers, lists and times to live need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run(stream: DataFrame, label: str, mode: str = "append", *, watch: list[dict] | None = None) -> DataFrame:
    """Runs the stream over what there is, into a table in the shared folder, and reads that.

    In append mode rows are added once they are final. In the other modes each batch
    writes a table of its own, under its number, and the last one is read: a batch
    that runs again replaces its own, and no reader loses what it holds. ``watch``
    gets the progress of each batch.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{label}-{uuid.uuid4().hex}"
    last = [0]

    def batch(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out/{n}")
        last[0] = n

    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(name, ROCKS)  # a query keeps the settings that it starts with
    try:
        if mode == "append":
            query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        else:
            query = stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    query.awaitTermination()
    if watch is not None:
        watch.extend(json.loads(p.json) for p in query.recentProgress)
    return spark.read.schema(stream.schema).parquet(f"{base}/out" if mode == "append" else f"{base}/out/{last[0]}")


def late_rows(stream: DataFrame, label: str, late: str = "1 hour", *, time: str = "ts") -> DataFrame:
    """The rows that a watermark of ``late`` finds too old, with the batch that brought them, kept on the side.

    A batch's watermark is the greatest time of the batches before it less ``late``.
    Windows drop those of these rows whose window has closed.
    Each batch writes its late rows and its greatest time under its number, so that
    one that runs again changes nothing.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/late-{label}-{uuid.uuid4().hex}"
    schema = stream.schema.add("batch", "long")

    def batch(df: DataFrame, n: int) -> None:
        marks = spark.read.schema("batch long, most timestamp").parquet(f"{base}/marks/*") if n else None
        mark = marks.filter(F.col("batch") < n).agg(F.max("most")).first()[0] if marks is not None else None
        old = df.filter(F.lit(False)) if mark is None else df.filter(F.col(time) < F.lit(mark) - F.expr(f"INTERVAL {late}"))
        old.withColumn("batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{base}/rows/{n}")
        df.agg(F.max(time).alias("most")).select(F.lit(n).cast("long").alias("batch"), "most").write.mode("overwrite").parquet(f"{base}/marks/{n}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/rows/*")


def followed(first: DataFrame, then: DataFrame, key: str, *, within: str = "1 hour", late: str = "1 hour", id_col: str = "event_id") -> DataFrame:
    """Each row of ``first`` with every row of ``then`` of its key in the time ``within`` behind it: id, key, ts, next_id, next_ts.

    On streams both sides are kept until the watermark says that nothing can match
    any more; only then a row without a match comes out, with nulls.
    """
    a = first.select(F.col(id_col), F.col(key), F.col("ts"))
    b = then.select(F.col(id_col).alias("next_id"), F.col(key).alias("next_key"), F.col("ts").alias("next_ts"))
    if first.isStreaming:
        a, b = a.withWatermark("ts", late), b.withWatermark("next_ts", late)
    near = (F.col(key) == F.col("next_key")) & (F.col("next_ts") >= F.col("ts")) & (F.col("next_ts") <= F.col("ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, near, "leftOuter").drop("next_key")


def tumbling(events: DataFrame, width: str = "1 hour", *, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Average value of each user and window; works on streams and tables."""
    e = events.withWatermark("ts", late) if late else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return e.groupBy(w.alias("w"), "user_id").agg(F.round(F.avg("value"), 6).alias("avg_value"), F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("window_start"), "avg_value", "n")


def sessions(events: DataFrame, gap: str = "6 hours", *, late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select("user_id", F.col("w.start").alias("session_start"), "n", "total")


def distinct_events(events: DataFrame, keys: list[str], late: str | None = None) -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if late else events.dropDuplicates(keys)


def rates(events: DataFrame) -> DataFrame:
    """event_id, user_id, rate: change of value per hour since the user's event before; stateful, for streams.

    The state of a user is the last time and value. Events of one batch are put in
    order; ones older than the state are passed over.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(parts).sort_values(["ts", "event_id"])
        last = state.get if state.exists else None
        out = []
        micros = rows["ts"].astype("datetime64[us]").astype("int64")
        for e, t, v in zip(rows["event_id"], micros, rows["value"], strict=True):
            if last is not None and t > last[0]:
                out.append((e, key[0], (v - last[1]) / ((t - last[0]) / 3.6e9)))
            if last is None or t > last[0]:
                last = (float(t), float(v))
        if last is not None:
            state.update(last)
        yield pd.DataFrame(out, columns=["event_id", "user_id", "rate"])

    return events.groupBy("user_id").applyInPandasWithState(step, "event_id long, user_id long, rate double", "t double, v double", "append", GroupStateTimeout.NoTimeout)


class SteadyRates:
    """Per user: rows that wait for the watermark, in a list, and the last row that came out.

    A timer stands at the first waiting row, or, when none waits, at the end of the
    last row's life; so a user who stays away leaves the state.
    """

    def __init__(self, keep_ms: int) -> None:
        self.keep = keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "event_id long, t long, v double")
        self.last = handle.getValueState("last", "t long, v double")

    def close(self) -> None:
        pass

    def _timer(self, at_ms: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done = timerValues.getCurrentWatermarkInMs() * 1000
        new = [(int(e), int(t), float(v)) for part in rows for e, t, v in zip(part["event_id"], part["ts"].astype("datetime64[us]").astype("int64"), part["value"], strict=True) if t > done]
        if new:
            first = min([t for _, t, _ in new] + [r[1] for r in self.waiting.get()])
            self.waiting.appendList(new)
            self._timer(-(-first // 1000))
        yield pd.DataFrame({"event_id": [], "user_id": [], "rate": []}).astype({"event_id": "int64", "user_id": "int64", "rate": "float64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(((r[1], r[0], r[2]) for r in self.waiting.get()))
        last = tuple(self.last.get()) if self.last.exists() else None
        out, left = [], [r for r in rows if r[0] > done]
        for t, e, v in rows[: len(rows) - len(left)]:
            if last is not None and t > last[0] and t - last[0] <= self.keep * 1000:
                out.append((e, key[0], (v - last[1]) / ((t - last[0]) / 3.6e9)))
            if last is None or t > last[0]:
                last = (t, v)
        self.waiting.clear()
        if left:
            self.waiting.put([(e, t, v) for t, e, v in left])
        gone = last is None or last[0] + self.keep * 1000 <= done
        if gone:
            self.last.clear()
        else:
            self.last.update(last)
        if left:
            self.handle.registerTimer(-(-left[0][0] // 1000))
        elif not gone:
            self.handle.registerTimer(-(-last[0] // 1000) + self.keep)
        yield pd.DataFrame(out, columns=["event_id", "user_id", "rate"]).astype({"event_id": "int64", "user_id": "int64", "rate": "float64"})


def steady_rates(events: DataFrame, *, late: str = "1 hour", keep_ms: int = 6 * 3_600_000) -> DataFrame:
    """event_id, user_id, rate per hour since the user's event before, in the order of time whatever the order of arrival.

    A row waits until the watermark has passed it; rows older than the watermark are
    passed over. A user's last row is forgotten after ``keep_ms``: the next one then
    has no rate.
    """
    from pyspark.sql.streaming import StatefulProcessor

    processor = type("SteadyRatesProcessor", (SteadyRates, StatefulProcessor), {})(keep_ms)
    rows = events.withWatermark("ts", late).select("user_id", "event_id", "ts", "value")
    return rows.groupBy("user_id").transformWithStateInPandas(processor, "event_id long, user_id long, rate double", "Append", "EventTime")


def latest(events: DataFrame) -> DataFrame:
    """The newest value of each user; in complete mode on streams."""
    return events.groupBy("user_id").agg(F.max("ts").alias("ts"), F.max_by("value", F.struct("ts", "event_id")).alias("value"))
