"""The registered replays against a second, slow implementation: every order on its own, over all messages of its book."""

from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import schedule
from tidemark.plans import replays

MINUTE = 60_000_000_000


@pytest.fixture(scope="module")
def feed(spark, sf_dir):
    books = defaultdict(list)
    for m in replays.messages(spark, sf_dir).orderBy("ts_event", "seq").collect():
        books[m.instrument_id, m.publisher_id].append(m)
    return books


def after(resting, m):
    """The resting orders, as (id, side, price, size) in priority, after a message."""
    if m.action == "A":
        return [*resting, (m.order_id, m.side, m.price, m.size)]
    mine = next(o for o in resting if o[0] == m.order_id)
    others = [o for o in resting if o[0] != m.order_id]
    if m.action == "C":
        return others if m.size == mine[3] else [(*o[:3], o[3] - m.size) if o[0] == m.order_id else o for o in resting]
    if m.price == mine[2] and m.size <= mine[3]:
        return [(*o[:3], m.size) if o[0] == m.order_id else o for o in resting]
    return [*others, (m.order_id, m.side, m.price, m.size)]


def best(resting):
    bids, asks = [o[2] for o in resting if o[1] == "B"], [o[2] for o in resting if o[1] == "A"]
    return (max(bids) if bids else None), (min(asks) if asks else None)


def less(ahead, m):
    """What is left ahead of an order after a message on one of those that made it up."""
    out = dict(ahead)
    if m.order_id in out and m.action == "C":
        out[m.order_id] -= m.size
    elif m.order_id in out and m.action == "M":
        out[m.order_id] = m.size if m.size <= out[m.order_id] else 0
    return {k: v for k, v in out.items() if v > 0}


def slow_backtest(messages, order, latency, life):
    """(status, submitted, ended, price) of one order."""
    arrives, deadline = order.ts_event + latency, order.ts_event + life
    resting, ahead, submitted = [], None, None
    for m in messages:
        if submitted is None and m.ts_event >= arrives:
            submitted = arrives
            across = best(resting)[1 if order.side == "B" else 0]
            if across is not None and (across <= order.price if order.side == "B" else across >= order.price):
                return "FILLED", submitted, arrives, across
            ahead = {o[0]: o[3] for o in resting if o[1] == order.side and o[2] == order.price}
        if submitted is not None and m.ts_event > deadline:
            return "CENSORED_TIME", submitted, deadline, None
        resting = after(resting, m)
        if submitted is not None and ahead:
            ahead = less(ahead, m)
            if not ahead:
                return "FILLED", submitted, m.ts_event, order.price
    last = messages[-1].ts_event
    return ("CENSORED_END", submitted, min(last, deadline), None) if submitted is not None else ("NOT_REACHED", None, None, None)


def test_every_added_order_of_the_backtest(spark, sf_dir, feed):
    got = {(r.instrument_id, r.publisher_id, r.order_id): (r.status_reason, r.submit_time, r.end_time, r.fill_price) for r in replays.raw_backtest_latency(spark, sf_dir).collect()}
    want = {(*key, m.order_id): slow_backtest(rows, m, 5_000_000, 24 * 60 * MINUTE) for key, rows in feed.items() for m in rows if m.action == "A"}
    assert got == want and len({x[0] for x in want.values()}) > 1


def slow_tracks(messages, due, horizon, windows):
    """The virtual orders of a scheduled time: (time, side, price, ahead, status, end, posts) of each."""
    resting, out, place = [], [], None
    for k, m in enumerate(messages):
        resting = after(resting, m)
        bid, ask = best(resting)
        if m.ts_event >= due and bid is not None and ask is not None:
            place = k
            break
    if place is None or messages[place].ts_event - due > horizon:
        return out
    for side, price in (("B", bid), ("A", ask)):
        ahead = {o[0]: o[3] for o in resting if o[1] == side and o[2] == price}
        total, state, status = sum(ahead.values()), resting, None
        for m in messages[place + 1 :]:
            state, ahead = after(state, m), less(ahead, m)
            if status is None and m.ts_event - due > horizon:
                status, end, posts = "CENSORED_TIME", due + horizon, []
                break
            if status is None and not ahead:
                status, end, posts = "FILLED", m.ts_event, []
            if status and m.ts_event - end <= horizon + max(windows) * 1_000_000:
                now = best(state)
                if None not in now:
                    posts += [[w, *now] for w in windows if m.ts_event - end >= w * 1_000_000 and w not in [p[0] for p in posts]]
        if status is None:
            status, end, posts = "CENSORED_END", messages[-1].ts_event, []
        out.append((due, side, price, total, status, end, str(sorted(posts))))
    return out


def test_every_virtual_order(spark, sf_dir, feed):
    columns = "instrument_id", "publisher_id", "entry_time", "side", "price", "queue_ahead", "status_reason", "end_time"
    horizon, windows = 48 * 60 * MINUTE, (60_000, 600_000)
    for query in (replays.virtual_order_tracking, replays.tracking_in_chunks):
        got = sorted((*(r[c] for c in columns), str(sorted(r.post_trade))) for r in query(spark, sf_dir).collect())
        first, last = (F.to_date(F.timestamp_micros(F.floor(F.lit(f(m[k].ts_event for m in feed.values())) / 1000))) for f, k in ((min, 0), (max, -1)))
        a, b = spark.range(1).select(first, last).first()
        days = [a + timedelta(k) for k in range(-1, (b - a).days + 2)]
        times = [t for d in days if isinstance(d, date) for t in schedule.entry_times(d, replays.SAMPLES)]
        want = sorted((*key, *x) for key, rows in feed.items() for t in times for x in slow_tracks(rows, t, horizon, windows))
        assert got == want and len({x[6] for x in want}) > 1
