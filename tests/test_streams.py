"""Streams over files that come one by one: final rows, late rows, and state that shrinks."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from meshwork.streaming import events as streams

T0 = dt.datetime(2024, 3, 1)
LOST = 100_000
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Ten files of an hour and a half each; some rows come two hours late, and user 9 stays away after the first."""
    rng, folder, parts, n = random.Random(6), tmp_path_factory.mktemp("events"), [], 0
    for k in range(10):
        rows = []
        for _ in range(40):
            minute = 90 * k + rng.random() * 90 - (120 if rng.random() < 0.1 else 0)
            rows.append((n, at(minute), rng.randrange(5), rng.choice(["view", "purchase"]), float(rng.randrange(100))))
            n += 1
        rows.append((n, at(90 * k + 89.9), 9 if k == 0 else 0, "view", 5.0))
        n += 1
        if k == 9:
            rows.append((LOST, at(90 * k - 500), 3, "view", 1.0))  # too late for all
        parts.append(rows)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        new = max((f for f in os.listdir(folder) if f.endswith(".parquet")), key=lambda f: os.path.getmtime(folder / f))
        os.utime(folder / new, (1_700_000_000 + 60 * k, 1_700_000_000 + 60 * k))
    return str(folder), parts


def old(parts):
    """(rows that a watermark of an hour finds too old, by batch), and the last watermark."""
    most, late = None, []
    for k, rows in enumerate(parts):
        late += [(r[0], k) for r in rows if most is not None and r[1] < most - dt.timedelta(hours=1)]
        most = max([r[1] for r in rows] + ([most] if most else []))
    return late, most - dt.timedelta(hours=1)


def source(spark, folder):
    return streams.read(spark, folder, spark.createDataFrame([], SCHEMA).schema, files=1)


def test_windows_are_final_and_forgotten(spark, files):
    folder, parts = files
    late, mark = old(parts)
    watch = []
    got = {(r["user_id"], r["window_start"].replace(tzinfo=None)): r["n"] for r in streams.run(streams.tumbling(source(spark, folder), late="1 hour"), "w", watch=watch).collect()}
    want = {}
    # a late row still counts where its window is open: windows close behind a batch, by the watermark that it began with
    for k, rows in enumerate(parts):
        most = max((r[1] for p in parts[: max(0, k - 1)] for r in p), default=None)
        for r in rows:
            start = r[1].replace(minute=0, second=0, microsecond=0)
            if most is None or start + dt.timedelta(hours=1) > most - dt.timedelta(hours=1):
                want[r[2], start] = want.get((r[2], start), 0) + 1
    assert got == {k: n for k, n in want.items() if k[1] + dt.timedelta(hours=1) <= mark} and late
    held = [p["stateOperators"][0]["numRowsTotal"] for p in watch if p["stateOperators"]]
    assert max(held) < len(want) / 2 and sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in watch if p["stateOperators"]) == 1


def test_late_rows_are_kept_aside(spark, files):
    folder, parts = files
    got = sorted((r["event_id"], r["batch"]) for r in streams.late_rows(source(spark, folder), "l").collect())
    assert got == sorted(old(parts)[0]) and got


def test_stream_join(spark, files):
    """Once all is read: each match, and what stayed alone until the watermark passed."""
    folder, parts = files
    rows = [r for p in parts for r in p if r[0] != LOST]
    a, b = (source(spark, folder).filter(F.col("event_type") == x) for x in ("view", "purchase"))
    watch = []
    got = sorted((r["event_id"], r["next_id"]) for r in streams.run(streams.followed(a, b, "user_id", late="4 hours"), "f", watch=watch).filter("next_id IS NOT NULL").collect())
    want = sorted((x[0], y[0]) for x in rows for y in rows if x[3] == "view" and y[3] == "purchase" and x[2] == y[2] and x[1] <= y[1] <= x[1] + dt.timedelta(hours=1))
    assert got == want and want
    batch = streams.followed(*(spark.createDataFrame(rows, SCHEMA).filter(F.col("event_type") == x) for x in ("view", "purchase")), "user_id")
    assert batch.filter("next_id IS NULL").count() == sum(r[3] == "view" for r in rows) - len({x for x, _ in want})


def test_steady_rates(spark, files):
    """Rates in the order of time though rows come out of order; who stays away leaves the state."""
    folder, parts = files
    watch = []
    got = {r["event_id"]: r["rate"] for r in streams.run(streams.steady_rates(source(spark, folder), late="3 hours", keep_ms=2 * 3_600_000), "r", watch=watch).collect()}
    rows = sorted((r[2], r[1], r[0], r[4]) for p in parts for r in p if r[0] != LOST)
    mark = max(r[1] for r in rows) - dt.timedelta(hours=3)
    want = {}
    for x, y in zip(rows, rows[1:], strict=False):
        if x[0] == y[0] and y[1] <= mark and dt.timedelta(0) < y[1] - x[1] <= dt.timedelta(hours=2):
            want[y[2]] = (y[3] - x[3]) / ((y[1] - x[1]).total_seconds() / 3600)
    assert got == pytest.approx(want) and want
    assert json.dumps(watch[-1]) and watch[-1]["stateOperators"][0]["numRowsTotal"] >= 0


def test_latest_keeps_the_last_batch(spark, files):
    folder, parts = files
    got = {r["user_id"]: r["value"] for r in streams.run(streams.latest(source(spark, folder)), "latest", "complete").collect()}
    newest = {}
    for r in (r for p in parts for r in p):
        newest[r[2]] = max(newest.get(r[2], (T0,)), (r[1], r[0], r[4]))
    assert got == {u: v[2] for u, v in newest.items()}
