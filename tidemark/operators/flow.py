"""Message streams: resting size, empty points, segments, gaps, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import running


def in_order(by: list[str], *order: str) -> Window:
    return Window.partitionBy(*by).orderBy(*order)


def signed_size(action: Column, size: Column) -> Column:
    """What a message adds to the resting size; messages that don't change it, 0."""
    return F.when(action == "A", size).when(action == "C", -size).otherwise(F.lit(0).cast("long"))


def resting(ticks: DataFrame, by: list[str] = ["instrument_id"]) -> DataFrame:
    """``ticks`` with the running resting size of their book."""
    return running.running(ticks, by, ["ts_event", "seq"], {"resting": signed_size(F.col("action"), F.col("size"))})


def empty_points(ticks: DataFrame, by: list[str] = ["instrument_id"]) -> DataFrame:
    """Messages that leave a book without resting size that had some before."""
    size = signed_size(F.col("action"), F.col("size"))  # what rested before a message is what rests after it, less its own
    return resting(ticks, by).filter((F.col("resting") <= 0) & (F.col("resting") - size > 0))


def gaps(ticks: DataFrame, by: list[str] = ["instrument_id"]) -> DataFrame:
    """``ticks`` with the microseconds since the last message and log1p of the milliseconds; 0 for the first."""
    out = running.lagged(ticks, by, ["ts_event", "seq"], {"__before": "ts_event"})
    gap = F.coalesce(F.col("ts_event") - F.col("__before"), F.lit(0).cast("long"))
    out = out.withColumn("gap_us", F.floor(gap / 1000)).drop("__before")
    return out.withColumn("gap_log_ms", F.log1p(F.greatest(F.col("gap_us") / 1000.0, F.lit(0.0))))


def count_buckets(ticks: DataFrame, every: int, by: list[str] = ["instrument_id"]) -> DataFrame:
    """One row for each full run of ``every`` messages: its last message and what it held."""
    numbered = running.numbered(ticks, by, ["ts_event", "seq"], "bucket").withColumn("bucket", F.floor(F.col("bucket") / every))
    out = numbered.groupBy(*by, "bucket").agg(F.count("*").alias("messages"), F.max("ts_event").alias("ts_event"), F.max_by("price", F.struct("ts_event", "seq")).alias("price"), F.count_if(F.col("action") == "T").alias("trades"), F.sum("size").alias("volume"))
    return out.filter(F.col("messages") == every)


def select_points(points: list[int], counts: list[int] | None, n: int) -> list[int]:
    """At most n - 1 of the candidate points that cut a stream into about equal parts.

    counts: messages in each segment that the points cut; without them, or with
    another number of them than segments, the points are spread evenly over time.
    """
    if n < 2 or not points:
        return []
    points = sorted(points)
    if counts is None or len(counts) != len(points) + 1:
        low, high = points[0], points[-1]
        targets = [low + k * (high - low) // n for k in range(1, n)] if low < high else []
        place = points
    else:
        place, total = [], 0
        for c in counts[:-1]:
            total += c
            place.append(total)
        total += counts[-1]
        targets = [k * total / n for k in range(1, n)] if total else []
    best = {min(range(len(points)), key=lambda j: (abs(place[j] - t), j)) for t in targets}
    return sorted({points[j] for j in best})


def segments(ticks: DataFrame, points: list[int]) -> DataFrame:
    """``ticks`` with the number of their segment; a message at a point belongs to the next one."""
    return ticks.withColumn("segment", sum((F.col("ts_event") >= p).cast("int") for p in points) if points else F.lit(0))


def queue_left(ahead: Column, messages: Column) -> Column:
    """Fold of messages (action, size), in order, on the size that rests ahead.

    Cancels and fills take off at most what is left; a modification to more
    loses the place and takes all, one to less leaves the new size.
    """

    def step(left: Column, m: Column) -> Column:
        taken = F.greatest(left - m["size"], F.lit(0).cast("long"))
        return F.when(m["action"].isin("C", "F"), taken).when(m["action"] == "M", F.when(m["size"] <= left, m["size"]).otherwise(F.lit(0).cast("long"))).otherwise(left)

    return F.aggregate(messages, ahead.cast("long"), step)


def time_censor(entry: Column, end: Column, horizon: int) -> tuple[Column, Column]:
    """End and whether it is censored: only what lasts longer than the horizon is, and then ends at it."""
    late = end - entry > horizon
    return F.when(late, entry + horizon).otherwise(end), late


def chunks(points: list[int], all_points: list[int], counts: list[int]) -> list[tuple[int | None, int | None, int]]:
    """Half-open chunks between the chosen points: start, end and the messages of the segments in between.

    counts: messages in each segment that ``all_points`` cut, one more than points.
    """
    if len(counts) != len(all_points) + 1:
        raise ValueError("a count is needed for each segment")
    edges = [None, *sorted(points), None]
    out, k = [], 0
    for start, end in zip(edges, edges[1:]):
        total = counts[k]
        while k < len(all_points) and all_points[k] != end:
            k += 1
            total += counts[k]
        k += 1
        out.append((start, end, total))
    return out


def market_is_empty(size: str = "size") -> Column:
    """Aggregate: whether no book of the market has resting size."""
    return F.coalesce(F.sum(size), F.lit(0)) <= 0


def lookback(rows: DataFrame, length: int, value: str, by: list[str] = ["instrument_id"], order: str = "bucket") -> DataFrame:
    """``rows`` with ``history``: their value and those of the rows before them, at most ``length``, the oldest first."""
    frame = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - length, 0)
    return rows.withColumn("history", F.collect_list(value).over(frame))


def split_analysis(ticks: DataFrame, n: int, by: list[str] = ["instrument_id"]) -> dict:
    """What ``sources.files.split_cache`` keeps: at most n - 1 of the points that leave a book empty, the messages between them, and all messages.

    The points are chosen on the driver; the messages are counted where they are.
    """
    points = sorted(r["ts_event"] for r in empty_points(ticks, by).select("ts_event").distinct().collect())
    counts = {r["segment"]: r["count"] for r in segments(ticks, points).groupBy("segment").count().collect()}
    each = [counts.get(k, 0) for k in range(len(points) + 1)]
    chosen = select_points(points, each, n)
    return {"split_points": chosen, "messages_between_splits": [c for _, _, c in chunks(chosen, points, each)], "total_messages": sum(each)}


def reaching(orders: DataFrame, messages: DataFrame, by: list[str], *, ahead: str = "ids_ahead", start: str = "entry_time", end: str = "end_time") -> DataFrame:
    """Messages of the orders that are ahead of a virtual one, from after its start to its end; the join is on the order's id."""
    each = orders.withColumn("order_id", F.explode(ahead)).drop(ahead)
    return each.join(messages, [*by, "order_id"]).filter((F.col("ts_event") > F.col(start)) & (F.col("ts_event") <= F.col(end)))
