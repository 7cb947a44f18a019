"""Books over message streams: the same book as the batch replay, kept as keyed state."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.fifo import Book, Invalid
from tidemark.operators.replay import MESSAGE, QUOTES, TRACKED, _Tracker


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    book, last = pickle.loads(state.get[0]) if state.exists else (Book(), (-1, -1))
    rows = []
    for m in pd.concat(frames).sort_values(["ts_event", "seq"]).itertuples(index=False):
        wrong = None
        if (m.ts_event, m.seq) <= last:
            wrong = "late"
        else:
            last = (m.ts_event, m.seq)
            try:
                book.apply(m.action, m.side, m.price, m.size, m.order_id, m.flags)
            except Invalid as error:
                wrong = str(error)
        rows.append((*key, m.seq, m.ts_event, *book.quotes(), wrong))
    state.update((pickle.dumps((book, last)),))
    yield pd.DataFrame(rows, columns=[x.strip().split()[0] for x in QUOTES.split(",")], dtype=object)


def stream_quotes(messages: DataFrame) -> DataFrame:
    """The best quotes after every message of a stream; late messages change nothing and say so."""
    return messages.groupBy("instrument_id", "publisher_id").applyInPandasWithState(_update, QUOTES, "state binary", "append", GroupStateTimeout.NoTimeout)


def stream_track(messages: DataFrame, due: DataFrame, *, horizon_ns: int, windows: tuple[int, ...] = ()) -> DataFrame:
    """Virtual orders over a stream, as ``operators.replay.track`` has them, each when it ends: books, queues and open orders are the state.

    Both streams come in order of time, a micro-batch of what is due no later
    than the messages after it. Late rows change nothing. Orders that are open
    stay in the state; there is no end that censors them.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker, last = pickle.loads(state.get[0]) if state.exists else (_Tracker(key, horizon_ns, windows, 0, 0), (-1, -1, -1))
        out = []
        for m in pd.concat(frames).sort_values(["ts_event", "kind", "seq"]).itertuples(index=False):
            if (m.ts_event, m.kind, m.seq) > last or m.kind == 1 and (m.ts_event, m.kind) >= last[:2]:
                last = (m.ts_event, m.kind, m.seq)
                out += tracker.on(m)
        state.update((pickle.dumps((tracker, last)),))
        yield pd.DataFrame(out, columns=[x.strip().split()[0] for x in TRACKED.split(",")], dtype=object)

    rows = messages.select(*MESSAGE).withColumns({"kind": F.lit(2), "within": F.lit(True)})
    both = rows.unionByName(due.select("instrument_id", "publisher_id", "ts_event", F.lit(1).alias("kind")), allowMissingColumns=True)
    both = both.fillna(0, ["seq", "price", "size", "order_id", "flags"])
    return both.groupBy("instrument_id", "publisher_id").applyInPandasWithState(update, TRACKED, "state binary", "append", GroupStateTimeout.NoTimeout)


def windowed_flow(messages: DataFrame, *, time: str = "ts", lateness: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Messages and volume of each instrument in event-time windows, with a watermark."""
    return messages.withWatermark(time, lateness).groupBy(F.window(time, window), "instrument_id").agg(F.count("*").alias("messages"), F.sum("size").alias("volume"))
