"""Markouts after fills, their statistics, and the window where they settle."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import STABLE_FRACTION, WINDOWS_MS, post_columns, quoted
from tidemark.operators.running import quantiles
from tidemark.storage import stage


#: From the statistics of the windows to one row (selected_window_ms, long_run_mean): what users of their own rule write.
Selector = Callable[[DataFrame], DataFrame]


def side_sign(side: Column) -> Column:
    """1 for a buyer, -1 for a seller, else null."""
    return F.when(side == "B", 1).when(side == "A", -1)


def mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2.0


def complete(orders: DataFrame, windows: Sequence[int] = WINDOWS_MS) -> DataFrame:
    """Orders that have every quote after the trade."""
    return orders.dropna(subset=[quoted(c) for w in windows for c in post_columns(w)])


def markouts(orders: DataFrame, windows: Sequence[int] = WINDOWS_MS, *, base: str = "mid") -> DataFrame:
    """(order_id, window_ms, markout, markout_bps), a row for each order and window.

    base: ``mid`` of the quotes at entry, or the order's ``price``.
    """
    reference = F.col("price").cast("double") if base == "price" else mid(F.col("best_bid_at_entry"), F.col("best_ask_at_entry"))
    after = F.array(*(F.struct(F.lit(w).alias("window_ms"), mid(F.col(quoted(b)), F.col(quoted(a))).alias("mid")) for w in windows for b, a in [post_columns(w)]))
    long = complete(orders, windows).select("order_id", side_sign(F.col("side")).alias("sign"), reference.alias("base"), F.explode(after).alias("w"))
    move = F.col("sign") * (F.col("w.mid") - F.col("base")) + F.lit(0.0)  # no negative zero
    return long.select("order_id", F.col("w.window_ms").alias("window_ms"), move.alias("markout"), (F.lit(10000.0) * F.try_divide(move, F.col("base"))).alias("markout_bps"))


def winsorize(long: DataFrame, value: str = "markout_bps", by: str = "window_ms", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """``value`` held between two quantiles of its group. One row for each group is joined back."""
    bounds = quantiles(long, [by], value, [low, high]).select(by, F.col("q").alias("__q"))
    return long.join(F.broadcast(bounds), by).withColumn(value, F.least(F.greatest(F.col(value), F.col("__q")[0]), F.col("__q")[1])).drop("__q")


def statistics(long: DataFrame, value: str = "markout_bps", by: str = "window_ms") -> DataFrame:
    """Count, moments, quantiles and the share below zero for each group; values that aren't finite don't count."""
    long = long.withColumn("__x", F.when(~F.isnan(value) & (F.abs(value) != float("inf")), F.col(value)))
    x = F.col("__x")
    q = quantiles(long, [by], "__x", [0.05, 0.25, 0.5, 0.75, 0.95]).select(by, "q")
    out = long.groupBy(by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.avg(F.when(x < 0, 1.0).when(x >= 0, 0.0)).alias("toxic_rate")).join(F.broadcast(q), by, "left")
    error = F.col("std") / F.sqrt("n")
    return out.select(by, "n", "mean", "std", error.alias("se"), F.try_divide(F.col("mean"), error).alias("tstat"), *(F.col("q")[k].alias(name) for k, name in enumerate(("p05", "p25", "median", "p75", "p95"))), "toxic_rate")


def settled_window(stats: DataFrame, fraction: float = STABLE_FRACTION) -> DataFrame:
    """One row: the first window whose mean has the long-run sign and ``fraction`` of its size.

    The long run is the largest window. No window is chosen if there is none, or
    if the long-run mean is about zero. The statistics, a row for each window, are staged: they are read twice.
    """
    stats = stage(stats, "window-statistics")
    last = stats.agg(F.max_by("mean", "window_ms").alias("long_run_mean"))
    near = (F.abs("mean") >= F.abs("long_run_mean") * fraction) & (F.signum("mean") == F.signum("long_run_mean")) & (F.abs("long_run_mean") >= 1e-12)
    return stats.crossJoin(F.broadcast(last)).agg(F.min(F.when(near, F.col("window_ms"))).alias("selected_window_ms"), F.first("long_run_mean").alias("long_run_mean"))


def analyze(orders: DataFrame, select: Selector = settled_window, *, winsorized: bool = True) -> tuple[DataFrame, int | None]:
    """The statistics of the fills' markouts, staged, and the window that the selector picks from them; none without fills."""
    long = markouts(orders.filter("status_reason = 'FILLED'"))
    stats = stage(statistics(winsorize(long) if winsorized else long), "window-statistics")
    chosen = select(stats).first()
    return stats, chosen["selected_window_ms"] if chosen else None
