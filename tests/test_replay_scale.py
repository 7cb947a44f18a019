"""The backtest's shared queues and a policy's looks against plain ones, and their work as orders grow."""

import random
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidemark.functions.fifo import F_TOB, UNDEF_PRICE, Book, Invalid, Queue
from tidemark.operators import replay
from tidemark.operators.replay import _Backtest


def plain(rows, latency):
    """order: (status, submitted, ended, price), each order with a queue of its own, looked at with every message."""
    b, waiting, live, out, last = Book(), [], {}, {}, 0
    for m in rows:
        if m.kind == 1:
            waiting.append(m)
            continue
        for o in [o for o in waiting if o.ts_event + latency <= m.ts_event]:
            waiting.remove(o)
            at = o.ts_event + latency
            across = b.best("A" if o.side == "B" else "B")
            if at > o.deadline:
                out[o.order_id] = "CENSORED_LATENCY", None, o.deadline, None
            elif across is not None and (across <= o.price if o.side == "B" else across >= o.price):
                out[o.order_id] = "FILLED", at, at, across
            else:
                ahead = b.ahead(o.side, o.price)
                live[o.order_id] = o, at, Queue(sum(ahead.values()), ahead)
        for k, (o, at, _) in list(live.items()):
            leaves = o.cancel + latency if o.cancel >= 0 else None
            if leaves is not None and leaves <= min(m.ts_event, o.deadline):
                out[live.pop(k)[0].order_id] = "CANCELED", at, leaves, None
            elif m.ts_event > o.deadline:
                out[live.pop(k)[0].order_id] = "CENSORED_TIME", at, o.deadline, None
        try:
            b.apply(m.action, m.side, m.price, m.size, m.order_id, m.flags)
        except Invalid:
            continue
        last = m.ts_event
        for k, (o, at, queue) in list(live.items()):
            known = bool(queue.orders)
            through = m.action in "TF" and (m.price <= o.price if o.side == "B" else m.price >= o.price)
            if queue.update(m.action, m.order_id, m.size) if known else through:
                out[live.pop(k)[0].order_id] = "FILLED", at, m.ts_event, o.price
    out |= {k: ("CENSORED_END", at, min(last, o.deadline), None) for k, (o, at, _) in live.items()}
    return out | {o.order_id: ("NOT_REACHED", None, None, None) for o in waiting}


def feed_of(seed):
    """Few order ids, so that messages meet queues: fills, changes of price and size, cleared books, what doesn't fit."""
    draw, rows, t = random.Random(seed), [], 0
    for k in range(250):
        t += draw.choice((0, 0, 1, 2, 5, 30)) * 100_000
        if draw.random() < 0.4:
            end, cancel = t + draw.randint(0, 60) * 1_000_000, t + draw.randint(0, 40) * 1_000_000 if draw.random() < 0.4 else -1
            rows.append(SimpleNamespace(kind=1, ts_event=t, seq=k, order_id=1000 + k, side=draw.choice("BA"), price=100 + draw.randint(-3, 3), deadline=end, cancel=cancel))
        side = draw.choice("BA")
        price, flags = 100 + (-1 if side == "B" else 1) * draw.randint(draw.random() > 0.2, 3), F_TOB if draw.random() < 0.01 else 0
        price = UNDEF_PRICE if flags and draw.random() < 0.5 else price
        action = draw.choice("AAAAACCCMMMFTN") if draw.random() < 0.985 else "R"
        rows.append(SimpleNamespace(kind=2, ts_event=t, seq=k, action=action, side=side, price=price, size=draw.randint(draw.random() > 0.1, 6), order_id=draw.randint(1, 20), flags=flags))
    return sorted(rows, key=lambda m: (m.ts_event, m.kind, m.seq))


@pytest.mark.parametrize("latency", [0, 1_500_000])
def test_shared_queues_end_orders_as_their_own_would(latency):
    seen = set()
    for seed in range(150):
        rows = feed_of(seed)
        state = _Backtest((1, 1), latency, (), 0)
        out = [x for m in rows for x in state.on(m)] + state.end()
        got = {x[2]: (x[4], x[5], x[6], x[7]) for x in out}
        assert got == plain(rows, latency) and len(got) == len(out)
        seen |= {x[0] for x in got.values()}
    assert len(seen) >= 4


def test_a_message_costs_no_look_at_every_open_order():
    """20,000 orders stay open behind others; a look at each with every message took minutes."""
    state, began = _Backtest((1, 1), 5, (1,), 0), time.process_time()
    out = []
    for k in range(20_000):
        out += state.on(SimpleNamespace(kind=2, ts_event=10 * k, seq=k, action="A", side="BA"[k % 2], price=99 + 2 * (k % 2), size=3, order_id=k, flags=0))
        out += state.on(SimpleNamespace(kind=1, ts_event=10 * k, order_id=k, side="BA"[k % 2], price=99 + 2 * (k % 2), deadline=10**9, cancel=-1))
    out += state.end()
    assert len(out) == 20_000 and {x[4] for x in out} == {"CENSORED_END", "NOT_REACHED"}
    assert time.process_time() - began < 10


FEED = "seq long, ts_event long, instrument_id int, publisher_id int, order_id long, action string, side string, price long, size long, flags int"
ORDERS = "instrument_id int, publisher_id int, order_id long, entry_time long, side string, price long, deadline long"


@pytest.mark.parametrize("stride, most", [(1, None), (3, None), (4, 2)])
def test_an_order_is_canceled_at_its_first_look_that_fails(spark, stride, most):
    draw, messages, shots, orders = random.Random(stride), [], [], []
    for p in (1, 2):
        times = sorted(draw.randint(0, 3_000) for _ in range(300))
        messages += [(k, 10 * k, 1, p, k, "A", "B", 90, 1, 0) for k in range(400)]  # what's ahead never goes, nothing crosses
        shots += [(1, p, 2 * n + 7, t, draw.choice((0.0, 1.0, 1.0, 1.0, 1.0, 1.0, None))) for n, t in enumerate(times)]
        orders += [(1, p, 1000 + k, t, "B", 90, t + draw.randint(0, 1_500)) for k, t in enumerate(draw.randint(0, 3_000) for _ in range(60))]
    books = spark.createDataFrame(shots, "instrument_id int, publisher_id int, number long, ts_event long, good double")
    own = spark.createDataFrame(orders, ORDERS)
    done = replay.policy_backtest(spark.createDataFrame(messages, FEED), own, books, {"good": F.col("good")}, F.lit(True), F.col("good") > 0, latency_ns=0, stride=stride, most=most)
    got = {(r.publisher_id, r.order_id): r.end_time if r.status_reason == "CANCELED" else None for r in done.filter("reason = 'submit'").collect()}
    want = {}
    for _, p, k, entry, _, _, deadline in orders:
        mine = [s for s in shots if s[1] == p]
        if any(s[3] <= entry for s in mine):
            looks = [s for s in mine if entry < s[3] <= deadline][::stride][:most]
            want[p, k] = min((s[3] for s in looks if s[4] == 0.0), default=None)
    assert got == want and None in want.values() and len(set(want.values())) > 10


def test_looks_are_not_paired_with_orders(spark):
    """30,000 orders that live through 30,000 snapshots: 900 million looks, if each were a row."""
    n = 30_000
    base = spark.range(n).select(F.lit(1).alias("instrument_id"), F.lit(1).alias("publisher_id"), "id")
    books = base.select("instrument_id", "publisher_id", F.col("id").alias("number"), (F.col("id") + 1).alias("ts_event"), F.when(F.col("id") < n - 2, 1.0).otherwise(0.0).alias("good"))
    orders = base.select("instrument_id", "publisher_id", F.col("id").alias("order_id"), F.lit(1).cast("long").alias("entry_time"), F.lit("B").alias("side"), F.lit(90).cast("long").alias("price"), F.lit(10 * n).cast("long").alias("deadline"))
    feed = spark.createDataFrame([(0, 1, 1, 1, 5, "A", "B", 90, 1, 0), (1, 10 * n, 1, 1, 6, "A", "B", 90, 1, 0)], FEED)
    began = time.time()
    done = replay.policy_backtest(feed, orders, books, {"good": F.col("good")}, F.lit(True), F.col("good") > 0, latency_ns=3, stride=2)
    assert {(r.status_reason, r.reason): r.orders for r in replay.counters(done).collect()} == {("CANCELED", "submit"): n}
    assert done.agg(F.min("end_time"), F.max("end_time")).first()[:] == (n + 3, n + 3)
    assert time.time() - began < 60
