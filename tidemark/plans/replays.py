"""Replays over messages made from the driver's events. Where SQL doesn't express one, tests hold it to golden cases and to a second implementation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import replay, schedule
from tidemark.plans.registry import query
from tidemark.storage import read

_MINUTE = 60_000_000_000
#: Samples of a day; each book's entry times are half of them, in the session.
SAMPLES = 100


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four messages a run: two adds, the cancel of the one, a smaller size for the other; five instruments, two publishers."""
    e = F.col("event_id")
    run = F.floor(e / 4)
    side = F.when(F.floor(run / 10) % 2 == 0, "B").otherwise("A")
    order = F.when(e % 4 < 2, e).otherwise(e - 2)
    away = 1 + F.floor((order * 7) / 4) % 9
    return read(spark, sf_dir, "events").select(
        e.alias("seq"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_event"),
        (run % 5).cast("int").alias("instrument_id"),
        (F.floor(run / 5) % 2).cast("int").alias("publisher_id"),
        order.alias("order_id"),
        F.when(e % 4 < 2, "A").when(e % 4 == 2, "C").otherwise("M").alias("action"),
        side.alias("side"),
        (10_000 + F.when(side == "B", -away).otherwise(away)).cast("long").alias("price"),
        (F.when(e % 4 == 3, 3).otherwise(5 + order % 4)).cast("long").alias("size"),
        F.lit(0).alias("flags"),
    )


#: What the books of ``messages`` hold at each price after each message: a modification leaves 3 of an order of 6.
_BOOKS = """mg AS (SELECT event_id AS seq, epoch_us(ts) * 1000 AS ts_event, event_id // 4 AS run, CASE WHEN event_id % 4 < 2 THEN event_id ELSE event_id - 2 END AS order_id FROM events),
 md AS (SELECT seq, ts_event, CAST(run % 5 AS INTEGER) AS instrument_id, CAST((run // 5) % 2 AS INTEGER) AS publisher_id, CASE WHEN (run // 10) % 2 = 0 THEN 'B' ELSE 'A' END AS side,
 CASE WHEN (run // 10) % 2 = 0 THEN 9999 - (order_id * 7 // 4) % 9 ELSE 10001 + (order_id * 7 // 4) % 9 END AS price, CASE WHEN seq % 4 < 2 THEN 5 + order_id % 4 WHEN seq % 4 = 2 THEN -(5 + order_id % 4) ELSE -3 END AS delta FROM mg),
 lv AS (SELECT DISTINCT instrument_id, publisher_id, side AS lside, price AS lprice FROM md),
 bk AS (SELECT seq, ts_event, instrument_id, publisher_id, lside, lprice, sum(CASE WHEN side = lside AND price = lprice THEN delta ELSE 0 END) OVER (PARTITION BY instrument_id, publisher_id, lside, lprice ORDER BY ts_event, seq) AS size FROM md JOIN lv USING (instrument_id, publisher_id)),
 qt AS (SELECT instrument_id, publisher_id, seq, ts_event, max(lprice) FILTER (lside = 'B' AND size > 0) AS bid_px, CAST(arg_max(size, lprice) FILTER (lside = 'B' AND size > 0) AS BIGINT) AS bid_sz, min(lprice) FILTER (lside = 'A' AND size > 0) AS ask_px,
 CAST(arg_min(size, lprice) FILTER (lside = 'A' AND size > 0) AS BIGINT) AS ask_sz FROM bk GROUP BY instrument_id, publisher_id, seq, ts_event)"""


@query(f"WITH {_BOOKS} SELECT *, NULL::VARCHAR AS error FROM qt")
def book_replay_fifo(spark, sf_dir):
    return replay.quotes(messages(spark, sf_dir))


@query(f"""WITH {_BOOKS}, la AS (SELECT instrument_id, publisher_id, arg_max(bid_px, seq) AS bp, arg_max(bid_sz, seq) AS bs, arg_max(ask_px, seq) AS ap, arg_max(ask_sz, seq) AS az FROM qt GROUP BY ALL),
 be AS (SELECT instrument_id, max(bp) AS bid, min(ap) AS ask FROM la GROUP BY instrument_id)
 SELECT instrument_id, bid, ask, CAST(sum(bs) FILTER (bp = bid) AS BIGINT) AS bid_size, CAST(sum(az) FILTER (ap = ask) AS BIGINT) AS ask_size FROM la JOIN be USING (instrument_id) GROUP BY instrument_id, bid, ask""")
def aggregated_last_quotes(spark, sf_dir):
    return replay.aggregated_quotes(replay.quotes(messages(spark, sf_dir)))


@query(f"WITH {_BOOKS} SELECT seq, instrument_id, publisher_id, CAST(sum(delta) OVER (PARTITION BY instrument_id, publisher_id ORDER BY ts_event, seq) AS BIGINT) AS resting FROM md")
def resting_of_orders(spark, sf_dir):
    return replay.resting(messages(spark, sf_dir)).select("seq", "instrument_id", "publisher_id", "resting")


def _due(spark, rows):
    """The schedule of each day and book. Days are few."""
    days = [r.day for r in rows.select(schedule.local_day(F.col("ts_event")).alias("day")).distinct().orderBy("day").collect()]
    times = spark.createDataFrame([(t,) for day in days for t in schedule.entry_times(day, SAMPLES)], "ts_event long")
    return rows.select("instrument_id", "publisher_id").distinct().crossJoin(F.broadcast(times))


@query()
def virtual_order_tracking(spark, sf_dir):
    rows = messages(spark, sf_dir)
    return replay.track(rows, _due(spark, rows), horizon_ns=48 * 60 * _MINUTE, windows=(60_000, 600_000))


@query()
def session_tracking(spark, sf_dir):
    """Orders that end with their session at the latest."""
    rows = messages(spark, sf_dir)
    return replay.track(rows, _due(spark, rows), horizon_ns=48 * 60 * _MINUTE, windows=(60_000, 600_000), sessions=True)


@query()
def tracking_in_chunks(spark, sf_dir):
    """The orders of ``virtual_order_tracking`` from a replay in chunks."""
    rows = messages(spark, sf_dir)
    return replay.track(rows, _due(spark, rows), horizon_ns=48 * 60 * _MINUTE, windows=(60_000, 600_000), rows_each=2_000)


@query()
def snapshot_books(spark, sf_dir):
    return replay.snapshots(messages(spark, sf_dir), 15)


@query()
def order_feature_steps(spark, sf_dir):
    """Feature rows of each order's history and life, a row for each step."""
    rows = messages(spark, sf_dir)
    tracked = replay.track(rows, _due(spark, rows), horizon_ns=6 * 60 * _MINUTE, windows=(60_000,), every=15, lookback=20)
    full = replay.order_sequences(tracked, replay.snapshots(rows, 15), "raw_top5", tick=1)
    return full.select("instrument_id", "publisher_id", "entry_time", "side", F.posexplode("order_sequence").alias("step", "features"))


def _best_sizes():
    b, a = F.col("bids"), F.col("asks")
    return {"bid_size": F.try_element_at(b, F.array_max(F.map_keys(b))), "ask_size": F.try_element_at(a, F.array_min(F.map_keys(a)))}


@query()
def policy_backtest_outcomes(spark, sf_dir):
    """Every added order under a policy: submitted if its side's best size is no less than the other, held while it is over half."""
    rows = messages(spark, sf_dir)
    same, other = (F.when(F.col("side") == "B", F.col(x)).otherwise(F.col(y)) for x, y in (("bid_size", "ask_size"), ("ask_size", "bid_size")))
    done = replay.policy_backtest(rows, _orders(rows), replay.snapshots(rows, 15), _best_sizes(), same >= other, F.col("bid_size") * 2 > F.col("ask_size"), latency_ns=5_000_000, stride=4, windows=(60_000,), patience_ns=_MINUTE)
    return replay.counters(done)


def _orders(rows):
    return rows.filter("action = 'A'").select("instrument_id", "publisher_id", "order_id", F.col("ts_event").alias("entry_time"), "side", "price", (F.col("ts_event") + 24 * 60 * _MINUTE).alias("deadline"))


@query()
def raw_backtest_latency(spark, sf_dir):
    rows = messages(spark, sf_dir)
    return replay.backtest(rows, _orders(rows), latency_ns=5_000_000)
