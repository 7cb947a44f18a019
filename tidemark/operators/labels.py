"""Competing-risk labels and the days that they are learned and judged on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.names import CENSORED, FAVORABLE_FILL, TOXIC_FILL, post_columns, quoted
from tidemark.operators import markout
from tidemark.operators.running import quantiles


def label(orders: DataFrame, window_ms: int | None) -> DataFrame:
    """``orders`` with event_type, labeling_valid, spread_source, the threshold and the adverse move in bps.

    A fill is favorable if its price moved against it by less than half the
    spread at execution, toxic otherwise. Fills in under 100 ms without quotes
    at execution use the spread and the mid at entry. Whatever lacks a price,
    entry quotes, a spread or quotes after the trade is censored and not valid.
    window_ms None: the quotes ``best_bid_at_post_trade``, ``best_ask_at_post_trade``.
    """
    names = post_columns(window_ms) if window_ms is not None else ("best_bid_at_post_trade", "best_ask_at_post_trade")
    after = markout.mid(*(F.col(quoted(c)) for c in names))
    entry = [F.col("best_bid_at_entry"), F.col("best_ask_at_entry")]
    execution = [F.col("best_bid_at_execution"), F.col("best_ask_at_execution")]
    known = F.col("price").isNotNull() & entry[0].isNotNull() & entry[1].isNotNull()
    at_fill = execution[0].isNotNull() & execution[1].isNotNull()
    source = F.when(known & at_fill, "execution").when(known & (F.col("duration_s") < 0.1), "entry")

    def chosen(f) -> Column:
        return F.when(F.col("spread_source") == "execution", f(*execution)).when(F.col("spread_source") == "entry", f(*entry))

    filled = F.col("status_reason") == "FILLED"
    base = chosen(markout.mid)
    threshold = F.try_divide(chosen(lambda b, a: (a - b) / 2.0), base) * 10000
    move = F.try_divide(markout.side_sign(F.col("side")) * (F.col("price") - after), base) * 10000
    out = orders.withColumn("spread_source", F.when(filled, source)).withColumn("spread_threshold_bps", F.nanvl(threshold, F.lit(None)))
    out = out.withColumn("post_trade_adverse_move_bps", F.nanvl(move, F.lit(None)))
    valid = F.when(filled, F.col("post_trade_adverse_move_bps").isNotNull() & F.col("spread_threshold_bps").isNotNull())
    event = F.when(valid, F.when(F.col("post_trade_adverse_move_bps") < F.col("spread_threshold_bps"), FAVORABLE_FILL).otherwise(TOXIC_FILL)).otherwise(CENSORED)
    return out.withColumns({"event_type": event, "labeling_valid": valid})


def label_calibrated(orders: DataFrame, select: markout.Selector = markout.settled_window, day: str = "day") -> DataFrame:
    """``label`` with the window that the fills of the training days settle at, and dataset_split.

    Where no window is found the single quotes after the trade are used; without
    three days or without fills in the training days nothing is labelled: no rows.
    """
    split = split_days(orders, day_cuts(orders, day=day), day)
    train = split.filter("dataset_split = 'train' AND status_reason = 'FILLED'")
    if train.isEmpty():
        return label(split, None).limit(0)
    return label(split, markout.analyze(train, select)[1])


def day_cuts(orders: DataFrame, train: float = 0.70, validation: float = 0.85, day: str = "day") -> DataFrame:
    """One row (train_last, validation_last): the days that the parts end with.

    A part ends with the day whose cumulative rows are closest to its share (the
    earlier of two), such that every part has a day. At least three days are
    needed, else the row is null. The window is over days, not over orders.
    """
    days = orders.groupBy(day).count()
    by_day = Window.orderBy(day)
    days = days.select(day, F.sum("count").over(by_day).alias("rows"), F.row_number().over(by_day).alias("number"))
    total = days.agg(F.max("rows").alias("total"), F.max("number").alias("days"))
    near = days.crossJoin(F.broadcast(total))

    def closest(share: float) -> Column:
        return F.min_by("number", F.struct(F.abs(F.col("rows") - F.col("total") * share), F.col("number")))

    cuts = near.agg(closest(train).alias("a"), closest(validation).alias("b"), F.max("days").alias("days"))
    first = F.least(F.greatest(F.col("a"), F.lit(1)), F.col("days") - 2)
    second = F.least(F.greatest(F.col("b"), first + 1), F.col("days") - 1)
    cuts = cuts.filter("days >= 3").select(first.alias("a"), second.alias("b"))
    both = days.crossJoin(F.broadcast(cuts))
    return both.agg(F.max(F.when(F.col("number") == F.col("a"), F.col(day))).alias("train_last"), F.max(F.when(F.col("number") == F.col("b"), F.col(day))).alias("validation_last"))


def split_days(orders: DataFrame, cuts: DataFrame, day: str = "day") -> DataFrame:
    """``orders`` with dataset_split by the cuts of ``day_cuts``, which is one row and is broadcast."""
    part = F.when(F.col(day) <= F.col("train_last"), "train").when(F.col(day) <= F.col("validation_last"), "val").otherwise("test")
    return orders.crossJoin(F.broadcast(cuts)).withColumn("dataset_split", part).drop("train_last", "validation_last")


def horizon(durations: DataFrame, percentile: float = 95.0, value: str = "duration_s") -> DataFrame:
    """One row: the linear percentile of the fills' durations."""
    return quantiles(durations, [], value, [percentile / 100]).select(F.col("q")[0].alias("horizon_s"))


def recensor(duration: Column, event: Column, limit: Column) -> tuple[Column, Column]:
    """Duration and event with everything beyond the limit censored there."""
    late = duration > limit
    return F.least(duration, limit), F.when(late, CENSORED).otherwise(event)


def lead_time(seconds: Column) -> Column:
    """The bin of a lead time: right-closed, the lowest edge included, outside null."""
    return F.when((seconds >= 0) & (seconds <= 1), "0-1").when((seconds > 1) & (seconds <= 5), "1-5").when((seconds > 5) & (seconds <= 15), "5-15").when((seconds > 15) & (seconds <= 60), "15-60")
