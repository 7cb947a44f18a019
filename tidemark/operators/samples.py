"""Dynamic survival samples: manifests, windows, normalisation, cuts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.running import numbered, quantiles


def spaced(size: Column, most: int) -> Column:
    """At most ``most`` indices from 0 to size - 1, evenly spaced, the ends included.

    Rounded halves go to even; if that repeats an index, the smallest free ones
    fill up.
    """
    everything = F.sequence(F.lit(0), size - 1)
    if most == 1:
        return F.when(size > 1, F.array((size - 1).cast("int"))).otherwise(everything)
    step = (size - 1) / F.lit(most - 1)
    picked = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.rint(i * step).cast("int")))
    rest = F.slice(F.array_except(everything, picked), F.lit(1), F.lit(most) - F.size(picked))
    return F.when(size <= most, everything).otherwise(F.array_sort(F.concat(picked, rest)))


def elapsed_seconds(gap_logs: Column) -> Column:
    """Seconds up to each step from log1p of the milliseconds before it, the logs held in 0 to 50."""
    held = F.transform(gap_logs, lambda x: F.expm1(F.least(F.greatest(x, F.lit(0.0)), F.lit(50.0))) / 1000.0)
    return F.aggregate(held, F.array().cast("array<double>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + x)))


def gap_column(width: int, index: int | None = None) -> int:
    """Where a row of ``width`` features has its log gap: last, or last but one where the queue follows it."""
    if index is not None:
        if not -width <= index < width:
            raise IndexError(f"no feature {index} among {width}")
        return index % width
    return width - 2 if width >= 12 else width - 1


def manifest(orders: DataFrame, *, lookback: int, censor_s: float | None = None, most: int | None = None, gaps: str = "gap_logs") -> DataFrame:
    """A row (source_row, order_id, update_idx, end_idx, remaining_s, event_type) for each sample of each order.

    Samples end at the steps from min(lookback, steps) - 1 on, at most ``most``
    of them, evenly spaced. What remains is the duration less the time passed
    since the anchor step; beyond ``censor_s`` it is censored there. Orders
    without steps have none.
    """
    steps = F.size(gaps)
    rows = orders.filter(steps > 0).withColumn("__e", elapsed_seconds(F.col(gaps))).withColumn("__a", F.least(F.lit(lookback), steps) - 1)
    count = steps - F.col("__a")
    picked = spaced(count, most) if most else F.sequence(F.lit(0), count - 1)
    rows = rows.select("source_row", "order_id", "duration_s", "event_type", "__e", "__a", F.explode(picked).alias("update_idx"))
    end = F.col("__a") + F.col("update_idx")
    passed = F.element_at("__e", end + 1) - F.element_at("__e", F.col("__a") + 1)
    left = F.greatest(F.col("duration_s") - passed, F.lit(0.0))
    out = rows.select("source_row", "order_id", "update_idx", end.alias("end_idx"), left.alias("remaining_s"), "event_type")
    return admin_censor(out, censor_s) if censor_s is not None else out


def admin_censor(samples: DataFrame, limit: float, remaining: str = "remaining_s", event: str = "event_type") -> DataFrame:
    """An event stays if it comes up to the limit; all else is censored at the limit at the latest."""
    stays = (F.col(event) > 0) & (F.col(remaining) <= limit)
    return samples.withColumns({event: F.when(stays, F.col(event)).otherwise(0), remaining: F.least(F.col(remaining), F.lit(limit))})


def random_cap(samples: DataFrame, most: int, seed: int, by: str = "source_row", index: str = "update_idx") -> DataFrame:
    """At most ``most`` samples of each source row, drawn by a seeded hash."""
    order = Window.partitionBy(by).orderBy(F.xxhash64(F.lit(seed), by, index), index)
    return samples.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= most).drop("__n")


def order_weights(samples: DataFrame, by: str = "order_id") -> DataFrame:
    """``samples`` with 1 / (samples of the order), and that over its mean."""
    weighted = samples.withColumn("weight", F.lit(1.0) / F.count("*").over(Window.partitionBy(by)))
    mean = samples.agg((F.count_distinct(by) / F.count("*")).alias("__mean"))
    return weighted.crossJoin(F.broadcast(mean)).withColumn("weight_mean_one", F.try_divide(F.col("weight"), F.col("__mean"))).drop("__mean")


def normalizer(windows: DataFrame, cells: str = "window", passthrough: list[int] = []) -> DataFrame:
    """(feature, mean, std) over all cells of all windows, padding included; std is the population's plus 1e-8.

    Features that pass through have 0 and 1. Sums are partial on each task.
    """
    each = windows.select(F.explode(cells).alias("row")).select(F.posexplode("row").alias("feature", "x"))
    stats = each.groupBy("feature").agg(F.avg("x").alias("mean"), (F.stddev_pop("x") + 1e-8).alias("std"))
    passes = F.col("feature").isin(passthrough) if passthrough else F.lit(False)
    return stats.select("feature", F.when(passes, 0.0).otherwise(F.col("mean")).alias("mean"), F.when(passes, 1.0).otherwise(F.col("std")).alias("std"))


def normalize(windows: DataFrame, stats: DataFrame, cells: str = "window", mask: int | None = None) -> DataFrame:
    """Windows in units of the statistics (a row for each feature, broadcast). Rows whose ``mask`` feature is 0 become zeros."""
    arrays = stats.agg(F.array_sort(F.collect_list(F.struct("feature", "mean", "std"))).alias("__s"))

    def row(r: Column) -> Column:
        z = F.zip_with(r, F.col("__s"), lambda x, s: (x - s["mean"]) / s["std"])
        return z if mask is None else F.when(r[mask] == 0, F.array_repeat(F.lit(0.0), F.size(r))).otherwise(z)

    return windows.crossJoin(F.broadcast(arrays)).withColumn(cells, F.transform(cells, row)).drop("__s")


def finish_cuts(quantiles: list[float], low: float, high: float) -> list[float]:
    """Quantiles as strictly growing cuts from low to high; evenly spaced if they can't be."""
    n = len(quantiles)
    if n < 2 or not high > low:
        return [low + k * (max(high, low + 1e-9) - low) / max(n - 1, 1) for k in range(n)]
    cuts, least = [low, *quantiles[1:-1], high], (high - low) * 1e-9
    for k in range(1, n):
        cuts[k] = max(cuts[k], cuts[k - 1] + least)
    if not all(math.isfinite(x) for x in cuts) or cuts[-1] > high + n * least:
        return [low + k * (high - low) / (n - 1) for k in range(n)]
    return cuts


def quantile_cuts(samples: DataFrame, bins: int, duration: str = "remaining_s", event: str = "event_type") -> list[float]:
    """``bins`` cuts at linear quantiles; rows censored at the largest duration don't count. The cuts are the model's time grid."""
    limits = samples.agg(F.min(duration), F.max(duration)).first()
    if limits[0] is None:
        return []
    used = samples.filter(~((F.col(event) == 0) & (F.col(duration) >= limits[1])))
    found = quantiles(used, [], duration, [k / (bins - 1) for k in range(bins)]).first()
    return finish_cuts(list(found["q"]) if found else [limits[0]] * bins, limits[0], limits[1])


def discretize(duration: Column, event: Column, cuts: list[float]) -> tuple[Column, Column]:
    """Bin and event: an event falls in the first cut at or after it, a censored time in the last at or before it; events past the cuts are censored."""
    grid = F.array(*(F.lit(float(c)) for c in cuts))
    late = duration > cuts[-1]
    event = F.when(late, 0).otherwise(event)
    up = F.size(F.filter(grid, lambda c: c < duration))
    down = F.greatest(F.size(F.filter(grid, lambda c: c <= duration)) - 1, F.lit(0))
    return F.when(event > 0, up).otherwise(down), event


def materialize(manifest: DataFrame, orders: DataFrame, *, lookback: int, width: int, rows: str = "rows") -> DataFrame:
    """The manifest with the window that ends at each sample, left-padded with zero rows. Sequences are joined late, once each order."""
    from tidemark.functions.book import window_ending

    sequences = orders.select("source_row", F.col(rows).alias("__rows"))
    return manifest.join(sequences, "source_row").withColumn("window", window_ending(F.col("__rows"), F.col("end_idx"), lookback, width)).drop("__rows")


def order_batches(samples: DataFrame, orders_each: int, seed: int, by: str = "order_id") -> DataFrame:
    """``samples`` with a batch that holds all samples of its orders: orders are dealt by a seeded hash, about ``orders_each`` a batch."""
    count = samples.agg(F.greatest(F.ceil(F.count_distinct(by) / orders_each), F.lit(1)).alias("__n"))
    return samples.crossJoin(F.broadcast(count)).withColumn("batch", F.pmod(F.xxhash64(F.lit(seed), by), F.col("__n"))).drop("__n")


def subsample_orders(orders: DataFrame, fraction: float, seed: int, by: str = "source_row") -> DataFrame:
    """About a fraction of the orders, drawn by a seeded hash."""
    return orders.filter(F.pmod(F.xxhash64(F.lit(seed), by), F.lit(1_000_000)) < int(fraction * 1_000_000))


def prepare(orders: DataFrame, *, lookback: int, bins: int, percentile: float = 95.0, fraction: float = 1.0, most: int | None = None, seed: int = 4718) -> dict:
    """The tables of a training run from split orders (dataset_split): horizon_s, cuts, and a manifest for each part.

    The horizon is a percentile of the training fills; parts are subsampled, and
    all but the test part are capped at ``most`` samples an order.
    """
    train = orders.filter("dataset_split = 'train'")
    found = quantiles(train.filter("event_type > 0"), [], "duration_s", [percentile / 100]).first()
    if found is None:
        raise ValueError("no fills in the training part")
    horizon = found["q"][0]
    parts = {}
    for name in ("train", "val", "test"):
        part = subsample_orders(orders.filter(F.col("dataset_split") == name), fraction, seed) if fraction < 1 else orders.filter(F.col("dataset_split") == name)
        rows = manifest(part, lookback=lookback, censor_s=horizon)
        parts[name] = random_cap(rows, most, seed) if most and name != "test" else rows
    return {"horizon_s": horizon, "cuts": quantile_cuts(parts["train"], bins), "parts": parts}


def end_index(policy: str, steps: Column, lookback: int) -> Column:
    """The step that a snapshot is taken at: ``entry``, ``latest`` or ``final``, or ``index:n`` held within the steps."""
    if policy == "entry":
        return F.least(F.lit(lookback - 1), F.greatest(steps - 1, F.lit(0)))
    if policy in ("latest", "final"):
        return steps - 1
    if policy.startswith("index:"):
        return F.least(F.greatest(F.lit(int(policy[6:])), F.lit(0)), steps - 1)
    raise ValueError(f"no snapshot policy {policy!r}")


def clipped_length(seen: Column, said: Column) -> Column:
    """The steps that a sequence has: what it says, if that is positive and no more than there are."""
    number = said.try_cast("int")
    return F.when(number > 0, F.least(seen, number)).otherwise(seen)


def increases(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value is above that of the row before them, with that one as ``before``."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("before", before).filter(F.col(value) > F.col("before"))


def require_falling(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """``rows``, or an error where a value grows within a group: remaining time can't."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    grows = F.raise_error(F.concat(F.lit(f"{value} grows within "), F.to_json(F.struct(*by)))).cast(rows.schema[value].dataType)
    return rows.withColumn(value, F.when(F.col(value) > before, grows).otherwise(F.col(value)))


def keep_orders(manifest: DataFrame, wanted: DataFrame, key: str = "order_id") -> DataFrame:
    """Manifest rows of the wanted orders (or source rows), each once."""
    return manifest.join(wanted.select(key), key, "left_semi")


def static_normalizer(rows: DataFrame, cells: str, least: float = 1e-6) -> DataFrame:
    """(feature, mean, std) of the features of flat rows; a deviation below ``least`` counts as 1."""
    each = rows.select(F.posexplode(cells).alias("feature", "x"))
    out = each.groupBy("feature").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return out.withColumn("std", F.when(F.col("std") < least, 1.0).otherwise(F.col("std")))


def histogram_edges(low: float, high: float, bins: int) -> list[float]:
    """Evenly spaced edges of a histogram; a single value has a unit around it."""
    low, high = (low - 0.5, high + 0.5) if low == high else (low, high)
    return [low + k * (high - low) / bins for k in range(bins + 1)]


def digitized(value: Column, edges: list[float]) -> Column:
    """The bin of a value by growing edges, each of which belongs to the bin below it: -1 up to the first."""
    return sum((value > float(e)).cast("int") for e in edges) - 1


def pad_right(values: Column, length: int) -> Column:
    """The first ``length`` values, NaN after the last where there are fewer."""
    return F.concat(F.slice(values, 1, length), F.array_repeat(F.lit(float("nan")), F.greatest(F.lit(length) - F.size(values), F.lit(0))))


def bin_seconds(rows: DataFrame, index: str, grid: list[float], clip: bool = True) -> DataFrame:
    """``rows`` with the seconds of a bin of the time grid; an index beyond it is the nearest, or null without ``clip``. The grid is a literal."""
    at = F.least(F.greatest(F.col(index), F.lit(0)), F.lit(len(grid) - 1)) if clip else F.col(index)
    seconds = F.array(*(F.lit(float(x)) for x in grid))
    return rows.withColumn("seconds", F.when(at >= 0, F.get(seconds, at.cast("int"))))


def sample_orders(orders: DataFrame, fraction: float, seed: int, by: str = "order_id") -> DataFrame:
    """Exactly the whole part of a fraction of the orders, one at least, drawn by a seeded hash of their unique id."""
    text = F.concat(F.lit(f"{seed}:"), F.col(by).cast("string"))
    ranked = numbered(orders.withColumn("__h", F.md5(text.cast("binary"))), [], ["__h", by], "__n")
    return ranked.filter(F.col("__n") < max(1, int(orders.count() * fraction))).drop("__h", "__n")
