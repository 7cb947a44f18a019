"""Ordered replay of messages: books, virtual orders, and policies with latency.

Messages are partitioned by instrument and publisher, and within one by chunks
that begin where its book is empty, and sorted within the partition; each task
streams its rows through the books that it holds. What it keeps is the books and
the open orders, never the messages, so a long feed needs no more memory than a
short one, and one busy book is the work of many tasks. A chunk goes on past its
end for as long as its own orders can live and be watched, so that the number of
chunks changes no result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import book
from tidemark.functions.fifo import Book, Invalid, Queue, Queues
from tidemark.functions.names import GRID_WINDOW, WINDOWS_MS, post_columns
from tidemark.operators import asof, running, schedule
from tidemark.storage import stage

MESSAGE = ("instrument_id", "publisher_id", "ts_event", "seq", "action", "side", "price", "size", "order_id", "flags")
_KEY = ["instrument_id", "publisher_id"]
#: Partitions of a replay, at least.
_PARTS = 32
#: Nanoseconds of a stretch of an as-of join.
_HOUR = 3_600_000_000_000
#: Snapshots of a stretch of the search for a look that doesn't hold.
_LOOKS = 4096


def _stream(rows: DataFrame, schema: str, start: Callable[[tuple], object]) -> DataFrame:
    """Each key's rows, in order, through the object that ``start`` makes for it; its ``on`` and ``end`` return rows."""
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False):
                if (row.instrument_id, row.publisher_id, row.chunk) != key:
                    if state is not None:
                        out += state.end()
                    key = row.instrument_id, row.publisher_id, row.chunk
                    state = start(key[:2])
                out += state.on(row)
            yield pd.DataFrame(out, columns=names, dtype=object)
        if state is not None:
            yield pd.DataFrame(state.end(), columns=names, dtype=object)

    rows = rows if "chunk" in rows.columns else rows.withColumn("chunk", F.lit(0).cast("long"))
    # books are few and costly: by number, since adaptive execution would put small partitions together
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), _PARTS)
    ordered = rows.repartition(parts, *_KEY, "chunk").sortWithinPartitions(*_KEY, "chunk", "ts_event", "kind", "seq")
    return ordered.mapInPandas(run, schema)


def resting(messages: DataFrame) -> DataFrame:
    """``messages`` with the size that rests in their book after each of them, by running sums of what each changes of its order."""
    of_order = Window.partitionBy(*_KEY, "order_id").orderBy("ts_event", "seq")
    sets = F.col("action").isin("A", "M")
    rows = messages.withColumn("__set", F.sum(sets.cast("int")).over(of_order))
    of_set = Window.partitionBy(*_KEY, "order_id", "__set").orderBy("ts_event", "seq")
    taken = F.sum(F.when(F.col("action") == "C", F.col("size")).otherwise(0)).over(of_set)
    left = F.greatest(F.first(F.when(sets, F.col("size")), ignorenulls=True).over(of_set) - taken, F.lit(0).cast("long"))
    rows = rows.withColumn("__left", F.when(F.col("action").isin("A", "M", "C"), F.coalesce(left, F.lit(0).cast("long"))))
    last = F.last("__left", ignorenulls=True).over(of_order.rowsBetween(Window.unboundedPreceding, -1))
    change = F.coalesce(F.col("__left") - F.coalesce(last, F.lit(0).cast("long")), F.lit(0).cast("long"))
    rows = rows.withColumn("__change", change).drop("__set", "__left")
    return running.running(rows, _KEY, ["ts_event", "seq"], {"resting": F.col("__change")}).drop("__change")


def chunked(messages: DataFrame, rows_each: int) -> tuple[DataFrame, DataFrame]:
    """``messages`` with a chunk of about ``rows_each`` rows, which begins after a message that leaves the book of its key empty;
    and (key, chunk, start, last) for each chunk. A feed that clears a book by ``R`` is one chunk from there on. Both are staged."""
    empty = running.running(resting(messages), _KEY, ["ts_event", "seq"], {"number": F.lit(1).cast("long"), "cleared": (F.col("action") == "R").cast("long")})
    empty = stage(empty.withColumn("__ends", (F.col("resting") == 0) & (F.col("cleared") == 0)), "resting")
    ends = empty.filter("__ends").select(*_KEY, "number").withColumn("slot", F.floor(F.col("number") / rows_each))
    ends = ends.groupBy(*_KEY, "slot").agg(F.min("number").alias("number")).filter("slot > 0")  # at most one cut for rows_each rows
    starts = ends.select(*_KEY, (F.col("number") + 1).alias("number"), F.lit(1).cast("long").alias("cut"))
    marked = empty.drop("resting", "cleared", "__ends").join(starts.hint("shuffle_hash"), [*_KEY, "number"], "left").fillna(0, ["cut"])
    out = stage(running.running(marked, _KEY, ["ts_event", "seq"], {"chunk": F.col("cut")}).drop("cut", "number"), "chunks")
    return out, stage(out.groupBy(*_KEY, "chunk").agg(F.min("ts_event").alias("start"), F.max("ts_event").alias("last")), "chunk-starts")


def _over_chunks(rows: DataFrame, due: DataFrame, rows_each: int | None, reach_ns: int) -> DataFrame:
    """Messages and what is due, with the chunks that need them: a message its own and those before that still reach it, what is due the
    one that it falls in, and where a chunk's reach ends a close, when nothing of it is open any more."""
    if rows_each is None:
        return rows.unionByName(due, allowMissingColumns=True)
    messages, starts = chunked(rows, rows_each)
    order, whole = Window.partitionBy(*_KEY).orderBy("chunk"), Window.partitionBy(*_KEY)
    bounds = starts.withColumns({"end": F.lead("start").over(order), "last": F.max("last").over(whole)})  # a row for each chunk
    until = F.col("end") + reach_ns
    reach = bounds.select(*_KEY, F.col("chunk").alias("of"), F.when(until <= F.col("last"), until).alias("until"))  # else to the end of the feed
    first = bounds.join(reach, _KEY).filter((F.col("of") <= F.col("chunk")) & (F.col("until").isNull() | (F.col("until") >= F.col("start")))).groupBy(*_KEY, "chunk").agg(F.min("of").alias("first"))
    spread = messages.join(F.broadcast(first), [*_KEY, "chunk"]).withColumn("of", F.explode(F.sequence("first", "chunk")))
    spread = spread.join(F.broadcast(reach), [*_KEY, "of"]).filter(F.col("until").isNull() | (F.col("ts_event") <= F.col("until")))
    spread = spread.drop("chunk", "first", "until").withColumnRenamed("of", "chunk")
    begins = bounds.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("start", "chunk"))).alias("__b"))  # the chunks of a book
    over = reach.filter("until IS NOT NULL").select(*_KEY, F.col("of").alias("chunk"), F.col("until").alias("ts_event"), F.lit(3).alias("kind"))
    at = F.greatest(F.size(F.filter("__b", lambda b: b["start"] < F.col("ts_event"))) - 1, F.lit(0))
    dealt = due.join(F.broadcast(begins), _KEY).withColumn("chunk", F.get(F.col("__b"), at)["chunk"]).drop("__b")
    return spread.unionByName(dealt, allowMissingColumns=True).unionByName(over, allowMissingColumns=True)


def _messages(messages: DataFrame) -> DataFrame:
    return messages.select(*MESSAGE).withColumn("kind", F.lit(0))


class _Quotes:
    def __init__(self, key: tuple) -> None:
        self.key, self.book = key, Book()

    def on(self, m) -> list[tuple]:
        try:
            self.book.apply(m.action, m.side, m.price, m.size, m.order_id, m.flags)
            wrong = None
        except Invalid as error:
            wrong = str(error)
        return [(*self.key, m.seq, m.ts_event, *self.book.quotes(), wrong)]

    def end(self) -> list[tuple]:
        return []


QUOTES = "instrument_id int, publisher_id int, seq long, ts_event long, bid_px long, bid_sz long, ask_px long, ask_sz long, error string"


def quotes(messages: DataFrame) -> DataFrame:
    """The best quotes after every message; a message that doesn't fit leaves the book and says why in ``error``."""
    return _stream(_messages(messages), QUOTES, _Quotes)


def aggregated_quotes(books: DataFrame) -> DataFrame:
    """Best bid and ask of each instrument over its publishers' last quotes, sizes summed at the best price."""
    last = books.groupBy(*_KEY).agg(*(F.max_by(c, F.struct("ts_event", "seq")).alias(c) for c in ("bid_px", "bid_sz", "ask_px", "ask_sz")))
    best = last.groupBy("instrument_id").agg(F.max("bid_px").alias("bid"), F.min("ask_px").alias("ask"))
    both = last.join(best, "instrument_id")
    return both.groupBy("instrument_id", "bid", "ask").agg(F.sum(F.when(F.col("bid_px") == F.col("bid"), F.col("bid_sz"))).alias("bid_size"), F.sum(F.when(F.col("ask_px") == F.col("ask"), F.col("ask_sz"))).alias("ask_size"))


def _side(book: Book, side: str) -> list[list[int]]:
    return [[p, book.size(side, p)] for p in book.prices[side]]


class _Snapshots:
    """The book at every ``every``-th message of the session, or at the first after it that leaves both sides quoted."""

    def __init__(self, key: tuple, every: int) -> None:
        self.key, self.book, self.every = key, Book(), every
        self.seen, self.number, self.day = 0, 0, None

    def due(self, m) -> bool:
        """Count an in-session message; whether a snapshot is taken after it."""
        if m.day != self.day:
            self.day, self.seen = m.day, 0
        self.seen += 1
        bid, _, ask, _ = self.book.quotes()
        if self.seen < self.every or bid is None or ask is None:
            return False
        self.seen, self.number = 0, self.number + 1
        return True

    def on(self, m) -> list[tuple]:
        try:
            self.book.apply(m.action, m.side, m.price, m.size, m.order_id, m.flags)
        except Invalid:
            return []
        if not m.within or not self.due(m):
            return []
        return [(*self.key, self.number, m.ts_event, _side(self.book, "B"), _side(self.book, "A"))]

    def end(self) -> list[tuple]:
        return []


SNAPSHOTS = "instrument_id int, publisher_id int, number long, ts_event long, bid_levels array<array<long>>, ask_levels array<array<long>>"


def _in_session(messages: DataFrame, sessions: bool) -> DataFrame:
    within = schedule.in_session(F.col("ts_event")) if sessions else F.lit(True)
    return messages.withColumns({"within": within, "day": F.datediff(schedule.local_day(F.col("ts_event")), F.lit("1970-01-01").cast("date")) if sessions else F.lit(0)})


def snapshots(messages: DataFrame, every: int, *, sessions: bool = False) -> DataFrame:
    """(instrument_id, publisher_id, number, ts_event, bids, asks): the books of every ``every`` messages, counted anew each session."""
    rows = _stream(_in_session(_messages(messages), sessions), SNAPSHOTS, lambda key: _Snapshots(key, every))

    def levels(name: str):
        return F.map_from_entries(F.transform(name, lambda x: F.struct(x[0].alias("price"), x[1].cast("double").alias("size"))))

    return rows.select("instrument_id", "publisher_id", "number", "ts_event", levels("bid_levels").alias("bids"), levels("ask_levels").alias("asks"))


class _Tracker:
    """Virtual orders at both best quotes of scheduled times, until they fill, their horizon passes or their session ends."""

    def __init__(self, key: tuple, horizon: int, windows: tuple[int, ...], every: int, lookback: int) -> None:
        self.key, self.horizon, self.windows, self.lookback = key, horizon, windows, lookback
        self.watch = max(windows, default=0) * 1_000_000 + horizon
        self.shots = _Snapshots(key, every) if every else None
        self.book = self.shots.book if self.shots else Book()
        self.pending: list[int] = []
        self.active: list[dict] = []
        self.after: list[dict] = []
        self.last = 0

    def _row(self, o: dict, status: str, end: int) -> tuple:
        posts = o.get("posts", {})
        return (*self.key, o["entry"], o["side"], o["price"], o["ahead"], status, end, (end - o["entry"]) / 1e9, *o["quotes"], *o.get("exec", (None, None)), [[w, *posts[w]] for w in self.windows if w in posts], o["history"], o["steps"])

    def on(self, m) -> list[tuple]:
        if m.kind == 1:
            self.pending.append(m.ts_event)
            return []
        if m.kind == 3:
            return self._close(m.ts_event)
        try:
            self.book.apply(m.action, m.side, m.price, m.size, m.order_id, m.flags)
        except Invalid:
            return []
        if not m.within:
            return []
        self.last = m.ts_event
        if self.shots and self.shots.due(m):
            for o in self.active:
                o["steps"].append([self.shots.number, o["queue"].left])
        bid, _, ask, _ = self.book.quotes()
        out = []
        still = []
        for o in self.active:
            filled = o["queue"].update(m.action, m.order_id, m.size)
            if m.ts_event - o["entry"] > self.horizon:
                out.append(self._row(o, "CENSORED_TIME", o["entry"] + self.horizon))
            elif filled:
                o |= {"end": m.ts_event, "exec": (bid, ask), "posts": {}}
                self.after.append(o)
            else:
                still.append(o)
        self.active = still
        if bid is not None and ask is not None:
            out += self._posted(m.ts_event, bid, ask)
            self._spawn(m.ts_event, bid, ask)
        return out

    def _spawn(self, now: int, bid: int, ask: int) -> None:
        """Orders of the times that are pending; one that is past its horizon is never placed."""
        for t in self.pending:
            if now - t > self.horizon:
                continue
            for side, price in (("B", bid), ("A", ask)):
                ahead, number = self.book.size(side, price), self.shots.number if self.shots else 0
                queue = Queue(ahead, dict(self.book.ahead(side, price)))
                # all that is known of the books before the order, with its place from the first of them on
                history = [max(1, number - self.lookback + 1), number] if number else None
                self.active.append({"entry": t, "side": side, "price": price, "ahead": ahead, "queue": queue, "quotes": (bid, ask), "history": history, "steps": []})
        self.pending = []

    def _posted(self, now: int, bid: int, ask: int) -> list[tuple]:
        out, still = [], []
        for o in self.after:
            watched = now - o["end"] <= self.watch
            for w in self.windows if watched else ():
                if w not in o["posts"] and now - o["end"] >= w * 1_000_000:
                    o["posts"][w] = (bid, ask)
            if not watched or len(o["posts"]) == len(self.windows):
                out.append(self._row(o, "FILLED", o["end"]))
            else:
                still.append(o)
        self.after = still
        return out

    def _close(self, at: int) -> list[tuple]:
        """The end of a session: open orders end there, filled ones are watched no longer, pending ones are placed and end."""
        out = [self._row(o, "FILLED", o["end"]) for o in self.after]
        bid, _, ask, _ = self.book.quotes()
        if bid is not None and ask is not None:
            self._spawn(at, bid, ask)
        for o in self.active:
            late = at - o["entry"] > self.horizon
            out.append(self._row(o, "CENSORED_TIME" if late else "CENSORED_END", o["entry"] + self.horizon if late else at))
        self.active, self.after, self.pending = [], [], []
        return out

    def end(self) -> list[tuple]:
        self.pending = []
        return self._close(self.last)


TRACKED = (
    "instrument_id int, publisher_id int, entry_time long, side string, price long, queue_ahead long, status_reason string, end_time long, "
    "duration_s double, best_bid_at_entry long, best_ask_at_entry long, best_bid_at_execution long, best_ask_at_execution long, "
    "post_trade array<array<long>>, history array<long>, steps array<array<long>>"
)


def track(messages: DataFrame, due: DataFrame, *, horizon_ns: int, windows: tuple[int, ...] = WINDOWS_MS, sessions: bool = False, every: int = 0, lookback: int = 500, rows_each: int | None = None) -> DataFrame:
    """Virtual orders of the scheduled times ``due`` (instrument_id, publisher_id, ts_event).

    An order joins the best quote after the first message at or after its time
    that leaves both sides quoted, and reacts from the next message on; if that
    comes after its horizon there is no order. It fills
    when nothing that was ahead is left; it is censored if it lasts longer than
    the horizon. post_trade has, for each window, the first quotes at or after
    it, up to the last window and the horizon after the fill. A message that doesn't fit its book changes nothing.

    sessions: messages outside the session change books only, and its end ends
    all orders. every: take a snapshot each so many messages; ``history`` says
    from which to which snapshot (of ``snapshots``, at most ``lookback``) the
    books before an order are, ``steps`` what was ahead of it at each one after.
    rows_each: replay in chunks of so many messages, without snapshots.
    """
    if every and rows_each:
        raise ValueError("snapshots are counted over a whole feed: replay it without chunks")
    due = due.select("instrument_id", "publisher_id", "ts_event", F.lit(1).alias("kind"))
    rows = _in_session(_messages(messages).withColumn("kind", F.lit(2)), sessions)
    if sessions:
        days = rows.select(schedule.local_day(F.col("ts_event")).alias("d")).distinct().collect()  # a row for each day
        closes = messages.sparkSession.createDataFrame([(schedule.session_end(r.d),) for r in days], "ts_event long")
        due = due.unionByName(due.select(*_KEY).distinct().crossJoin(F.broadcast(closes)).withColumn("kind", F.lit(3)))
    reach = 2 * horizon_ns + max(windows, default=0) * 1_000_000
    both = _over_chunks(rows, due, rows_each, reach).fillna(0, ["seq", "price", "size", "order_id", "flags"])
    return _stream(both, TRACKED, lambda key: _Tracker(key, horizon_ns, windows, every, lookback))


def serialized(tracked: DataFrame, base: int = 0) -> DataFrame:
    """``tracked`` as the rows of a data file: a number for each order, one unit, and whether it was filled, with a column for the quotes of each window."""
    numbered = running.numbered(tracked, [], [*_KEY, "entry_time", "side"], "order_id").withColumn("order_id", F.col("order_id") + base)
    quotes = {}
    for w in WINDOWS_MS:
        found = F.get(F.filter("post_trade", lambda x, w=w: x[0] == w), F.lit(0))
        quotes |= {name: found[k] for k, name in enumerate(post_columns(w), 1)}
    return numbered.withColumns({"volume": F.lit(1), "event": (F.col("status_reason") == "FILLED").cast("int"), **quotes}).drop("post_trade")


def order_sequences(tracked: DataFrame, books: DataFrame, form: str, *, tick: int, window: int = GRID_WINDOW) -> DataFrame:
    """``tracked`` with ``book_sequence`` and ``order_sequence``: rows of features of the snapshots before an order and while it is open.

    Book features have the form of ``functions.book.FORMS``, each on its own
    grid. Order features are those of ``functions.names.MICROSTRUCTURE``: of the
    book, the log gap to the snapshot before, and the log size ahead, which
    before the order's time is that at its entry.
    """
    keyed = tracked.withColumn("order", F.struct(*_KEY, "entry_time", "side"))
    earlier = F.when(F.col("history").isNotNull(), F.transform(F.sequence(F.col("history")[0], F.col("history")[1]), lambda n: F.array(n, F.col("queue_ahead"))))
    numbers = F.concat(F.coalesce(earlier, F.array().cast("array<array<long>>")), "steps")
    each = keyed.select("order", *_KEY, F.explode(numbers).alias("x")).select("order", *_KEY, F.col("x")[0].alias("number"), F.col("x")[1].alias("ahead"))
    featured = book.add_microstructure(books, "features")
    bids, asks = F.col("bids"), F.col("asks")
    rows = featured.select(*_KEY, "number", "ts_event", "features", book.FORMS[form](bids, asks, book.anchor(book.mid(bids, asks), tick), tick, window).alias("cells"))
    met = each.join(rows, [*_KEY, "number"]).groupBy("order").agg(F.array_sort(F.collect_list(F.struct("number", "ts_event", "ahead", "features", "cells"))).alias("s"))
    s = F.col("s")
    with_gap = book.with_gaps(F.transform(s, lambda x: x["features"]), F.transform(s, lambda x: x["ts_event"]))
    full = met.select("order", F.transform(s, lambda x: x["cells"]).alias("book_sequence"), book.with_queue(with_gap, F.transform(s, lambda x: x["ahead"])).alias("order_sequence"))
    return keyed.join(full, "order", "left").drop("order")


class _Backtest:
    """Limit orders that reach the book with latency, queue, fill, are canceled or censored, and are watched after a fill.

    A message costs what it changes, however many orders are open: those that are due stand in order of time,
    those that queue by what is ahead of them, those with nothing ahead by price.
    """

    def __init__(self, key: tuple, latency: int, windows: tuple[int, ...], patience: int) -> None:
        self.key, self.book, self.latency, self.windows = key, Book(), latency, windows
        self.watch = max(windows, default=0) * 1_000_000 + patience
        self.queues = Queues()
        self.waiting: deque[dict] = deque()  # by arrival
        self.open: dict[int, dict] = {}
        self.ends: list[tuple] = []  # (time, number, status, end) of open orders, a heap; some have ended before
        self.front: dict[str, list[tuple]] = {"B": [], "A": []}  # (price, best first, number) of those with nothing ahead, heaps
        self.after: deque[dict] = deque()  # by end
        self.posts: dict[int, deque[dict]] = {w: deque() for w in windows}
        self.last = self.number = 0

    def _row(self, o: dict, status: str, end: int | None, price: int | None = None) -> tuple:
        bid, _, ask, _ = self.book.quotes()
        quotes = o.get("exec", (bid, ask)) if end is not None else (None, None)
        posts = o.get("posts", {})
        return (*self.key, o["order_id"], o["side"], status, o.get("submitted"), end, price, *o.get("quotes", (None, None)), *quotes, [[w, *posts[w]] for w in self.windows if w in posts])

    def _fill(self, o: dict, at: int, price: int) -> list[tuple]:
        bid, _, ask, _ = self.book.quotes()
        o |= {"end": at, "price": price, "exec": (bid, ask), "posts": {}}
        if not self.windows:
            return [self._row(o, "FILLED", at, price)]
        self.after.append(o)
        for due in self.posts.values():
            due.append(o)
        return []

    def _enter(self, o: dict) -> None:
        self.number += 1
        self.open[self.number] = o
        leaves = o["cancel"] + self.latency if o["cancel"] is not None else None
        if leaves is not None and leaves <= o["deadline"]:
            heappush(self.ends, (leaves, self.number, "CANCELED", leaves))
        else:
            heappush(self.ends, (o["deadline"] + 1, self.number, "CENSORED_TIME", o["deadline"]))
        o["ticket"] = self.queues.join(o["side"], o["price"], self.number)
        if o["ticket"] is None:
            heappush(self.front[o["side"]], (-o["price"] if o["side"] == "B" else o["price"], self.number))

    def _arrive(self, now: int) -> list[tuple]:
        """Before a message: what has reached the market by now, on the book as it is."""
        out = []
        while self.waiting and self.waiting[0]["at"] <= now:
            o = self.waiting.popleft()
            if o["at"] > o["deadline"]:
                out.append(self._row(o, "CENSORED_LATENCY", o["deadline"]))
                continue
            bid, _, ask, _ = self.book.quotes()
            o |= {"submitted": o["at"], "quotes": (bid, ask)}
            across = ask if o["side"] == "B" else bid
            if across is not None and (across <= o["price"] if o["side"] == "B" else across >= o["price"]):
                out += self._fill(o, o["at"], across)
            else:
                self._enter(o)
        while self.ends and self.ends[0][0] <= now:
            _, number, status, end = heappop(self.ends)
            o = self.open.pop(number, None)
            if o is not None:
                if o["ticket"] is not None:
                    self.queues.leave(o["ticket"])
                out.append(self._row(o, status, end))
        return out

    def _watched(self, now: int) -> list[tuple]:
        out = []
        bid, _, ask, _ = self.book.quotes()
        if bid is not None and ask is not None:
            for w, due in self.posts.items():
                while due and now - due[0]["end"] >= w * 1_000_000:
                    o = due.popleft()
                    if now - o["end"] <= self.watch:
                        o["posts"][w] = (bid, ask)
        while self.after and (now - self.after[0]["end"] > self.watch or len(self.after[0]["posts"]) == len(self.windows)):
            o = self.after.popleft()
            out.append(self._row(o, "FILLED", o["end"], o["price"]))
        return out

    def _through(self, price: int) -> list[int]:
        """The orders with nothing ahead that a trade at a price takes: at theirs or beyond."""
        out = []
        for front, at in ((self.front["B"], -price), (self.front["A"], price)):
            while front and front[0][0] <= at:
                out.append(heappop(front)[1])
        return out

    def on(self, m) -> list[tuple]:
        if m.kind == 1:
            self.waiting.append({"order_id": m.order_id, "side": m.side, "price": m.price, "at": m.ts_event + self.latency, "deadline": m.deadline, "cancel": m.cancel if m.cancel >= 0 else None})
            return []
        out = self._arrive(m.ts_event)
        if m.kind == 3:
            return out + self._rest()
        try:
            self.book.apply(m.action, m.side, m.price, m.size, m.order_id, m.flags)
        except Invalid:
            return out
        self.last = m.ts_event
        filled = self.queues.update(self.book, m.action, m.order_id, m.size, m.flags)
        if m.action in ("T", "F"):
            filled += self._through(m.price)
        for number in filled:
            o = self.open.pop(number, None)
            if o is not None:
                out += self._fill(o, m.ts_event, o["price"])
        return out + self._watched(m.ts_event)

    def _rest(self) -> list[tuple]:
        out = [self._row(o, "FILLED", o["end"], o["price"]) for o in self.after]
        self.after.clear()
        for due in self.posts.values():
            due.clear()
        return out

    def end(self) -> list[tuple]:
        out = self._arrive(self.last) + self._rest()
        out += [self._row(o, "CENSORED_END", min(self.last, o["deadline"])) for o in self.open.values()]
        return out + [self._row(o, "NOT_REACHED", None) for o in self.waiting]


BACKTEST = (
    "instrument_id int, publisher_id int, order_id long, side string, status_reason string, submit_time long, end_time long, fill_price long, "
    "bid_at_submit long, ask_at_submit long, bid_at_end long, ask_at_end long, post_trade array<array<long>>"
)


def backtest(messages: DataFrame, orders: DataFrame, *, latency_ns: int, windows: tuple[int, ...] = (), patience_ns: int = 0, rows_each: int | None = None) -> DataFrame:
    """Replay of limit orders (instrument_id, publisher_id, order_id, entry_time, side, price, deadline[, cancel_time]).

    An order decided on at entry_time reaches the book a latency later, on the
    book before the next message; it fills at once against the opposite best if
    it crosses, else it queues behind what rests there. A cancel takes the
    latency too. One that would arrive past its deadline is CENSORED_LATENCY.
    post_trade has the first quotes at or after each window after a fill, up to
    ``patience_ns`` after the last window. rows_each: replay in chunks of so
    many messages.
    """
    cancel = F.coalesce(F.col("cancel_time"), F.lit(-1)).cast("long") if "cancel_time" in orders.columns else F.lit(-1).cast("long")
    due = orders.select("instrument_id", "publisher_id", F.col("entry_time").alias("ts_event"), F.lit(1).alias("kind"), "order_id", "side", "price", "deadline", cancel.alias("cancel"))
    rows = _messages(messages).withColumn("kind", F.lit(2))
    life = due.agg(F.max(F.col("deadline") - F.col("ts_event"))).first()[0] or 0 if rows_each else 0
    reach = max(life, latency_ns) + latency_ns + max(windows, default=0) * 1_000_000 + patience_ns
    both = _over_chunks(rows, due, rows_each, reach).fillna(0, ["seq", "size", "flags", "deadline"]).fillna(-1, ["cancel"]).fillna(0, ["price", "order_id"])
    return _stream(both, BACKTEST, lambda key: _Backtest(key, latency_ns, windows, patience_ns))


def observed(orders: DataFrame, books: DataFrame, features: dict, *, label: str | None = None) -> DataFrame:
    """``orders`` with the features of the last snapshot at or before their entry_time, and ``source``: of the label where the order
    has them, else live from the snapshot, else null. features: column to an expression over bids and asks."""
    shots = books.select(*_KEY, (-F.col("ts_event")).alias("back"), (-F.col("number")).alias("place"), "number", *(e.alias(f"live_{n}") for n, e in features.items()))
    timed = orders.withColumn("__back", -F.col("entry_time"))
    met = asof.forward(timed, shots, by=_KEY, at="__back", time="back", values=["number", *(f"live_{n}" for n in features)], tie="place", width=_HOUR).drop("__back", "next_back")
    out = met.withColumnRenamed("next_number", "seen")
    known = F.col(label).isNotNull() if label else F.lit(False)
    source = F.when(known, "label").when(F.col("seen").isNotNull(), "live")
    values = {n: F.when(known, F.col(label)[n]).otherwise(F.col(f"next_live_{n}")) if label else F.col(f"next_live_{n}") for n in features}
    return out.withColumn("source", source).withColumns(values).drop(*(f"next_live_{n}" for n in features))


def policy_backtest(messages: DataFrame, orders: DataFrame, books: DataFrame, features: dict, act, hold, *, latency_ns: int, stride: int = 1, most: int | None = None, label: str | None = None, **settings) -> DataFrame:
    """A replay of the orders that a policy submits, each canceled at its first look that doesn't hold; one row for each order.

    ``act`` decides on the features at entry, ``hold`` at every ``stride``-th
    snapshot after it up to the deadline, ``most`` of them at the most. An order
    without features, or one that isn't acted on, is SKIPPED with a reason. The
    policy is columns: all decisions are made at once, before the replay. Since
    ``hold`` is of a snapshot (its features, ``ts_event`` and number ``look``),
    an order's first look that doesn't hold is found without its other looks.
    """
    shots = stage(books.select(*_KEY, "ts_event", "number", *(e.alias(n) for n, e in features.items())), "snapshots")
    shots = running.numbered(shots.withColumn("look", F.col("number")), _KEY, ["look"], "number")
    seen = observed(orders, shots, {n: F.col(n) for n in features}, label=label)
    decision = F.when(F.col("source").isNull(), "no_features").when(act, "submit").otherwise("policy")
    decided = stage(seen.withColumn("reason", decision), "decisions")
    submitted = decided.filter("reason = 'submit'").drop("cancel_time", *features)
    # an order looks at every stride-th snapshot from its first one on: at those of one turn
    begun = submitted.withColumn("__begins", F.coalesce(F.col("seen") + 1, F.lit(0).cast("long")))
    begun = begun.withColumn("__turn", F.col("__begins") % stride)
    fails = shots.filter(~hold).select(*_KEY, (F.col("number") % stride).alias("__turn"), "number", F.col("ts_event").alias("cancel_time"))
    met = asof.forward(begun, fails, by=[*_KEY, "__turn"], at="__begins", time="number", values=["cancel_time"], tie="cancel_time", width=_LOOKS, prefix="__")
    alive = F.col("__cancel_time") <= F.col("deadline")
    if most:
        alive &= F.col("__number") < F.col("__begins") + most * stride
    submitted = met.withColumn("cancel_time", F.when(alive, F.col("__cancel_time")))
    done = backtest(messages, submitted, latency_ns=latency_ns, **settings)
    skipped = decided.filter("reason <> 'submit'").select(*_KEY, "order_id", "side", F.lit("SKIPPED").alias("status_reason"), "reason")
    return done.withColumn("reason", F.lit("submit")).unionByName(skipped, allowMissingColumns=True)


def counters(results: DataFrame) -> DataFrame:
    """(status_reason, reason, orders): how the orders of a replay ended."""
    return results.groupBy("status_reason", "reason").agg(F.count("*").alias("orders"))
