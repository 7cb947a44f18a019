import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.fifo import F_TOB, UNDEF_PRICE, Book, Invalid, Queue
from tidemark.operators import flow, replay, schedule
from tidemark.sources.files import MESSAGES


def book(*messages):
    b = Book()
    for m in messages:
        b.apply(*m)
    return b


def test_priority_is_kept_by_smaller_and_lost_by_larger_sizes():
    b = book(("A", "B", 100, 5, 1), ("A", "B", 100, 4, 2), ("M", "B", 100, 3, 1))
    assert b.position(2) == 3
    b.apply("M", "B", 100, 9, 1)
    assert b.position(1) == 4 and b.quotes() == (100, 13, None, None)


def test_cancel_modify_clear_and_top_of_book():
    b = book(("A", "A", 101, 5, 1), ("C", "A", 101, 5, 1))
    assert b.quotes() == (None, None, None, None)
    b.apply("M", "A", 102, 4, 7)
    assert b.best("A") == 102
    with pytest.raises(Invalid):
        b.apply("C", "A", 102, 9, 7)
    with pytest.raises(Invalid):
        b.apply("M", "B", 102, 4, 7)
    b.apply("A", "A", 99, 8, 0, F_TOB)
    assert b.quotes()[2:] == (99, 8) and b.ahead("A", 99) == {}
    b.apply("A", "A", UNDEF_PRICE, 0, 0, F_TOB)
    assert b.best("A") is None
    b.apply("R", "N", 0, 0, 0)
    assert not b.placed


def test_snapshot_pads_the_shorter_side():
    b = book(("A", "B", 100, 5, 1), ("A", "B", 99, 1, 2), ("A", "A", 101, 2, 3))
    assert b.snapshot(5) == [(100, 5, 1, 101, 2, 1), (99, 1, 1, None, None, None)]


def test_queue_golden_cases():
    q = Queue(10, {1: 5, 2: 3, 3: 2})
    assert not q.update("C", 1, 2) and not q.update("F", 2, 1) and not q.update("M", 3, 1)
    assert q.left == 6
    q = Queue(5, {1: 2})
    q.update("M", 1, 5)
    assert q.left == 3


def test_split_points():
    assert flow.select_points([10, 20, 30, 40], [5, 35, 35, 20, 5], 3) == [20, 30]
    assert flow.select_points([10, 20, 30, 40], None, 2) == [20] and flow.select_points([], None, 3) == []
    assert flow.select_points([7], None, 3) == []


def frame(spark, rows):
    full = [(k, t, 1, 1, o, a, s, p, n, 0) for k, (t, a, s, p, n, o) in enumerate(rows)]
    return spark.createDataFrame(full, MESSAGES)


ROWS = [(100, "A", "B", 10, 5, 1), (101, "A", "A", 12, 5, 2), (110, "A", "B", 10, 2, 3), (120, "C", "B", 10, 5, 1), (130, "T", "B", 10, 1, 0), (140, "C", "A", 12, 5, 2), (141, "A", "A", 13, 1, 4), (150, "A", "B", 9, 1, 5)]


def test_quotes_report_messages_that_do_not_fit(spark):
    got = replay.quotes(frame(spark, ROWS + [(160, "C", "B", 9, 9, 5)])).orderBy("seq").collect()
    assert [r.bid_sz for r in got[:4]] == [5, 5, 7, 2] and got[0].ask_px is None
    assert got[-1].error and got[-1].bid_px == 10


def test_tracked_orders_fill_when_all_that_was_ahead_is_gone(spark):
    due = spark.createDataFrame([(1, 1, 105)], "instrument_id int, publisher_id int, ts_event long")
    rows = {r.side: r for r in replay.track(frame(spark, ROWS), due, horizon_ns=1000, windows=(0,)).collect()}
    assert rows["B"].queue_ahead == 7 and rows["B"].status_reason == "CENSORED_END"
    assert rows["A"].queue_ahead == 5 and rows["A"].status_reason == "FILLED" and rows["A"].end_time == 140
    assert rows["A"].entry_time == 105 and rows["A"].post_trade[0][2] == 13


def random_feed(seed, n=400):
    """Books of two publishers that fill and empty again and again."""
    draw, rows, t, order = random.Random(seed), [], 0, 0
    held = {1: {}, 2: {}}
    emptying = {1: False, 2: False}
    for k in range(n):
        t += draw.randint(0, 3) * 1_000_000
        p = draw.choice((1, 2))
        mine = held[p]
        emptying[p] = bool(mine) if draw.random() < 0.15 else emptying[p] and bool(mine)
        if mine and (emptying[p] or draw.random() < 0.4):
            o = draw.choice(sorted(mine))
            side, price, size = mine[o]
            if draw.random() < 0.25 and not emptying[p]:
                new = draw.randint(1, 9)
                rows.append((k, t, 1, p, o, "M", side, price, new, 0))
                mine[o] = side, price, new
            else:
                gone = size if emptying[p] or draw.random() < 0.6 else draw.randint(1, size)
                rows.append((k, t, 1, p, o, "C", side, price, gone, 0))
                mine[o] = side, price, size - gone
                if gone == size:
                    del mine[o]
        else:
            order += 1
            side = draw.choice("BA")
            mine[order] = side, 100 + (-1 if side == "B" else 1) * draw.randint(1, 4), draw.randint(1, 9)
            rows.append((k, t, 1, p, order, "A", *mine[order], 0))
    return rows, t


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chunks_change_no_result(spark, seed):
    rows, end = random_feed(seed)
    feed = spark.createDataFrame(rows, MESSAGES).repartition(3)
    draw = random.Random(seed)
    due = spark.createDataFrame([(1, p, draw.randint(0, end)) for p in (1, 2) for _ in range(30)], "instrument_id int, publisher_id int, ts_event long")
    settings = dict(horizon_ns=20_000_000, windows=(1, 5))
    whole = sorted(map(str, replay.track(feed, due, **settings).collect()))
    chunked, starts = replay.chunked(feed, 25)
    assert starts.count() > 6 and chunked.count() == len(rows)
    first = chunked.groupBy("publisher_id", "chunk").agg(F.min_by("action", F.struct("ts_event", "seq")).alias("a")).collect()
    assert {r.a for r in first} == {"A"}
    for each in (25, 70):
        assert sorted(map(str, replay.track(feed, due, rows_each=each, **settings).collect())) == whole
    assert len({r.split("status_reason=")[1].split(",")[0] for r in whole}) == 3


@pytest.mark.parametrize("seed", [1, 4])
def test_chunks_change_no_backtest(spark, seed):
    rows, end = random_feed(seed)
    feed = spark.createDataFrame(rows, MESSAGES).repartition(3)
    draw = random.Random(seed)
    orders = []
    for k in range(80):
        t = draw.randint(0, end)
        orders.append((1, draw.choice((1, 2)), 1000 + k, t, draw.choice("BA"), 100 + draw.randint(-3, 3), t + draw.randint(0, 30) * 1_000_000, t + draw.randint(0, 20) * 1_000_000 if k % 3 else None))
    frame_of = spark.createDataFrame(orders, "instrument_id int, publisher_id int, order_id long, entry_time long, side string, price long, deadline long, cancel_time long")
    settings = dict(latency_ns=1_500_000, windows=(1, 4), patience_ns=5_000_000)
    whole = sorted(map(str, replay.backtest(feed, frame_of, **settings).collect()))
    assert len(whole) == 80 and len({r.split("status_reason=")[1].split(",")[0] for r in whole}) >= 4
    for each in (25, 60):
        assert sorted(map(str, replay.backtest(feed, frame_of, rows_each=each, **settings).collect())) == whole


def test_a_policy_submits_skips_and_cancels_by_features(spark):
    feed = frame(spark, ROWS)
    books = replay.snapshots(feed, 2)
    orders = spark.createDataFrame(
        [(1, 1, 70, 90, "B", 9, 400), (1, 1, 71, 102, "B", 9, 400), (1, 1, 72, 125, "B", 9, 400), (1, 1, 73, 142, "B", 9, 400)],
        "instrument_id int, publisher_id int, order_id long, entry_time long, side string, price long, deadline long",
    )
    size = {"bid_size": book_size("bids")}
    got = {r.order_id: r for r in replay.policy_backtest(feed, orders, books, size, F.col("bid_size") >= 5, F.col("bid_size") > 2, latency_ns=3).collect()}
    assert (got[70].status_reason, got[70].reason) == ("SKIPPED", "no_features")  # before the first snapshot
    assert got[71].status_reason == "CANCELED" and got[71].end_time == 123 and got[71].submit_time == 105  # 2 rest at 120
    assert (got[72].status_reason, got[72].reason) == ("SKIPPED", "policy") and got[73].reason == "policy"
    held = replay.policy_backtest(feed, orders, books, size, F.lit(True), F.lit(True), latency_ns=3, stride=2, most=1)
    assert {(r.status_reason, r.reason): r.orders for r in replay.counters(held).collect()} == {("SKIPPED", "no_features"): 1, ("CENSORED_END", "submit"): 3}
    labelled = orders.withColumn("known", F.when(F.col("order_id") == 70, F.struct(F.lit(9.0).alias("bid_size"))))
    seen = {r.order_id: (r.source, r.bid_size) for r in replay.observed(labelled, books, size, label="known").collect()}
    assert seen == {70: ("label", 9.0), 71: ("live", 5.0), 72: ("live", 2.0), 73: ("live", 2.0)}


def book_size(side):
    return F.aggregate(F.map_values(side), F.lit(0.0), lambda a, x: a + x)


def test_levels_and_sizes_are_those_of_the_orders():
    for seed in range(6):
        rows, _ = random_feed(seed, 600)
        books = {1: Book(), 2: Book()}
        for _, _, _, p, o, a, s, price, size, flags in rows:
            b = books[p]
            b.apply(a, s, price, size, o, flags)
            for side in "BA":
                assert b.prices[side] == sorted(b.sides[side]) and b.totals[side] == {k: sum(x.values()) for k, x in b.sides[side].items()}


def test_resting_follows_every_order(spark):
    rows, _ = random_feed(5)
    books, want = {1: Book(), 2: Book()}, {}
    for k, t, _, p, o, a, s, price, size, flags in rows:
        books[p].apply(a, s, price, size, o, flags)
        want[k] = sum(sum(x.values()) for side in books[p].sides.values() for x in side.values())
    assert {r.seq: r.resting for r in replay.resting(spark.createDataFrame(rows, MESSAGES)).collect()} == want


def test_sessions_end_open_orders_and_place_pending_ones(spark):
    from datetime import date, time

    day = date(2025, 3, 3)
    base, close = schedule.nanoseconds(day, time(15, 59)), schedule.nanoseconds(day, time(16))
    feed = frame(spark, [(base + t, *x) for t, *x in ROWS] + [(close + 10**9, "C", "B", 10, 2, 3)])
    due = spark.createDataFrame([(1, 1, base + 105), (1, 1, base + 10**9)], "instrument_id int, publisher_id int, ts_event long")
    got = {(r.entry_time - base, r.side): r for r in replay.track(feed, due, horizon_ns=10**15, windows=(60_000,), sessions=True).collect()}
    assert got[105, "B"].status_reason == "CENSORED_END" and got[105, "B"].end_time == close
    assert got[105, "A"].status_reason == "FILLED" and got[105, "A"].post_trade == []
    assert got[10**9, "B"].status_reason == "CENSORED_END" and got[10**9, "B"].end_time == close and len(got) == 4
    open_end = {(r.entry_time - base, r.side): r for r in replay.track(feed, due, horizon_ns=10**15, windows=(60_000,)).collect()}
    assert open_end[105, "B"].status_reason == "FILLED" and open_end[105, "B"].end_time == close + 10**9
    assert schedule.session_end(date(2025, 11, 28)) == schedule.nanoseconds(date(2025, 11, 28), time(13))
    late = spark.createDataFrame([(schedule.nanoseconds(date(2025, 11, 28), time(11)),), (close + 5,)], "t long").select(schedule.next_session_end(F.col("t"))).collect()
    assert [r[0] for r in late] == [schedule.session_end(date(2025, 11, 28)), schedule.session_end(date(2025, 3, 4))]


def test_orders_carry_their_own_queue_through_the_snapshots(spark):
    feed = frame(spark, ROWS)
    due = spark.createDataFrame([(1, 1, 105)], "instrument_id int, publisher_id int, ts_event long")
    books = replay.snapshots(feed, 2)
    assert [(r.number, r.ts_event) for r in books.orderBy("number").collect()] == [(1, 101), (2, 120), (3, 141)]
    tracked = replay.track(feed, due, horizon_ns=1000, windows=(0,), every=2)
    rows = {r.side: r for r in tracked.collect()}
    # the snapshot of a message is taken before the message reaches the queue
    assert rows["B"].history == [1, 1] and rows["B"].steps == [[2, 7], [3, 2]] and rows["A"].steps == [[2, 5]]
    got = {r.side: r for r in replay.order_sequences(tracked, books, "raw_top5", tick=1).collect()}
    assert len(got["B"].book_sequence) == 3 and len(got["B"].order_sequence[0]) == 12
    assert [round(math.expm1(x[-1])) for x in got["B"].order_sequence] == [7, 7, 2]
    assert [x[10] for x in got["B"].order_sequence] == [0.0, math.log1p(19 / 1e6), math.log1p(21 / 1e6)]
    assert got["A"].book_sequence[1][:4] == [12.0, 5.0, 10.0, 2.0]


def test_schedule_values_are_fixed():
    """Uniform floats cut to whole nanoseconds, drawn by a seed of the day."""
    import hashlib
    from datetime import date

    day = date(2025, 3, 3)
    start, end = schedule.nanoseconds(day, schedule.OPEN), schedule.nanoseconds(day, schedule.LAST_ENTRY)
    seed = int.from_bytes(hashlib.sha256(f"4718|2025-03-03|{start}|{end}|9".encode()).digest()[:8], "big")
    draw = random.Random(seed)
    assert schedule.entry_times(day, 9) == sorted(int(draw.uniform(start, end)) for _ in range(5))
    assert schedule.in_chunk_times([1, 5, 9], 2, 9) == [5]


def test_the_horizon_censors_only_what_lasts_longer(spark):
    due = spark.createDataFrame([(1, 1, 105)], "instrument_id int, publisher_id int, ts_event long")
    one = {r.side: r for r in replay.track(frame(spark, ROWS), due, horizon_ns=45, windows=(0,)).collect()}
    assert one["B"].status_reason == "CENSORED_END"
    two = {r.side: r for r in replay.track(frame(spark, ROWS), due, horizon_ns=44, windows=(0,)).collect()}
    assert two["B"].status_reason == "CENSORED_TIME" and two["B"].end_time == 149


def test_backtest_latency_crossing_cancel_and_deadline(spark):
    orders = spark.createDataFrame(
        [(1, 1, 50, 100, "B", 10, 200, None), (1, 1, 51, 100, "B", 12, 200, None), (1, 1, 52, 100, "B", 10, 105, None), (1, 1, 53, 100, "B", 10, 200, 105)],
        "instrument_id int, publisher_id int, order_id long, entry_time long, side string, price long, deadline long, cancel_time long",
    )
    got = {r.order_id: r for r in replay.backtest(frame(spark, ROWS), orders, latency_ns=10).collect()}
    assert got[50].submit_time == 110 and got[50].status_reason == "FILLED" and got[50].end_time == 120
    assert got[51].status_reason == "FILLED" and got[51].fill_price == 12 and got[51].end_time == 110
    assert got[52].status_reason == "CENSORED_LATENCY"
    assert got[53].status_reason == "CANCELED" and got[53].end_time == 115


def test_resting_size_and_queue_fold(spark):
    m = F.array(*(F.struct(F.lit(a).alias("action"), F.lit(n).cast("long").alias("size")) for a, n in (("C", 2), ("F", 1), ("A", 5))))
    assert spark.range(1).select(flow.queue_left(F.lit(10), m)).first()[0] == 7
    got = flow.resting(frame(spark, ROWS)).orderBy("seq").collect()
    assert [r.resting for r in got] == [5, 10, 12, 7, 7, 2, 3, 4]


def test_schedule_is_fixed_and_within_the_session(spark):
    from datetime import date

    a, b = schedule.entry_times(date(2025, 3, 3), 9), schedule.entry_times(date(2025, 3, 3), 9)
    assert a == b and len(a) == 5 and schedule.entry_times(date(2025, 11, 28), 9) == []
    rows = spark.createDataFrame([(t,) for t in a] + [(a[0] - 12 * 3600 * 10**9,)], "t long")
    assert [r[0] for r in rows.select(schedule.in_session(F.col("t"))).collect()] == [True] * 5 + [False]


def test_stream_equals_batch(spark, tmp_path):
    from tidemark.streaming.books import stream_quotes

    frame(spark, ROWS).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(MESSAGES).parquet(str(tmp_path / "in"))
    q = stream_quotes(stream).writeStream.format("memory").queryName("quotes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = replay.quotes(frame(spark, ROWS)).orderBy("seq").collect()
    assert spark.sql("select * from quotes order by seq").collect() == batch


def test_a_stream_goes_on_after_a_restart_with_the_books_that_it_had(spark, tmp_path):
    from tidemark.streaming.books import stream_quotes

    rows = frame(spark, ROWS)

    def run():
        stream = spark.readStream.schema(MESSAGES).parquet(str(tmp_path / "in"))
        out = stream_quotes(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        out.outputMode("append").trigger(availableNow=True).start().awaitTermination()

    for part in ("seq < 3", "seq between 3 and 5", "seq > 5"):
        rows.filter(part).write.mode("append").parquet(str(tmp_path / "in"))
        run()  # a new query each time, from the checkpoint of the one before
    run()
    assert spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect() == replay.quotes(rows).orderBy("seq").collect()


def test_streamed_orders_end_as_in_the_batch(spark, tmp_path):
    from tidemark.streaming.books import stream_track

    rows, end = random_feed(7, 200)
    feed = spark.createDataFrame(rows, MESSAGES)
    due = spark.createDataFrame([(1, p, t) for p in (1, 2) for t in range(0, end, 12_000_000)], "instrument_id int, publisher_id int, ts_event long")
    settings = dict(horizon_ns=20_000_000, windows=(1,))

    def run():
        read = spark.readStream
        stream = stream_track(read.schema(MESSAGES).parquet(str(tmp_path / "in")), read.schema(due.schema).parquet(str(tmp_path / "due")), **settings)
        out = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        out.outputMode("append").trigger(availableNow=True).start().awaitTermination()

    half = rows[100][1]
    for a, b in ((0, half), (half, end + 1)):
        feed.filter(f"ts_event >= {a} and ts_event < {b}").write.mode("append").parquet(str(tmp_path / "in"))
        due.filter(f"ts_event >= {a} and ts_event < {b}").write.mode("append").parquet(str(tmp_path / "due"))
        run()
    got = {str(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    whole = {str(r): r for r in replay.track(feed, due, **settings).collect()}
    assert len(got) > 20 and got <= set(whole)
    assert all(r.status_reason == "CENSORED_END" or not r.post_trade for k, r in whole.items() if k not in got)


def test_flow_in_event_time_windows(spark, tmp_path):
    from tidemark.streaming.books import windowed_flow

    frame(spark, ROWS).withColumn("ts", F.timestamp_seconds(F.col("ts_event") * 10)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq long, ts_event long, instrument_id int, size long, ts timestamp").parquet(str(tmp_path / "in"))
    q = windowed_flow(stream).writeStream.format("memory").queryName("flow").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(messages), sum(volume) from flow").first()[:] == (len(ROWS), sum(r[4] for r in ROWS))


def test_the_registered_replays_take_every_order_and_the_schedule(spark, sf_dir):
    from tidemark.plans import replays

    rows = replays.messages(spark, sf_dir)
    assert replays.raw_backtest_latency(spark, sf_dir).count() == rows.filter("action = 'A'").count()
    ts = F.from_utc_timestamp(F.timestamp_micros(F.floor(F.col("ts_event") / 1000)), schedule.NEW_YORK)
    days = [r[0] for r in rows.select(F.to_date(ts)).distinct().collect()]
    times = {t for d in days for t in schedule.entry_times(d, replays.SAMPLES)}
    got = {r.entry_time for r in replays.virtual_order_tracking(spark, sf_dir).select("entry_time").collect()}
    assert got and got <= times
