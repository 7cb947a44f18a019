"""Summaries, rankings, bootstrap intervals and significance of backtests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, fill rate, mean, median and total shortfall, and counts by sign of the fill-adjusted cost, for all or for each ``by``."""
    bps, adjusted = F.col("implementation_shortfall_bps"), F.col("fill_adjusted_toxic_cost_bps")
    rows = results.groupBy(*(by or []))
    return rows.agg(
        F.count("*").alias("orders"),
        F.count_if("submitted").alias("submitted"),
        F.count_if("filled").alias("filled"),
        F.count_if("canceled").alias("canceled"),
        F.count_if(F.col("metric_status") == "failed").alias("failed"),
        F.try_divide(F.count_if("filled"), F.count_if("submitted")).alias("fill_rate"),
        F.avg(bps).alias("mean_bps"),
        F.median(bps).alias("median_bps"),
        F.sum("implementation_shortfall_raw").alias("total_raw"),
        F.avg(adjusted).alias("adjusted_mean_bps"),
        F.count_if(adjusted > 0).alias("adjusted_costs"),
        F.count_if(adjusted < 0).alias("adjusted_savings"),
    )


def cost_breakdown(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A row for each cost type of the rows that succeeded, for all or for each ``by``: count, mean and median cost; and the counts of
    failures by reason and of the fill-adjusted cost's status, component, missing, zero, median and sum, as (kind, name, rows, mean, median, total)."""
    keys, bps, adjusted = by or [], F.col("implementation_shortfall_bps"), F.col("fill_adjusted_toxic_cost_bps")
    ok = F.col("metric_status") == "ok"
    kinds = F.array(
        F.struct(F.lit("cost_type").alias("kind"), F.when(ok, F.col("cost_type")).alias("name"), F.when(ok, bps).alias("value")),
        F.struct(F.lit("failed").alias("kind"), F.when(~ok, F.coalesce("missing_reason", F.lit("unknown"))).alias("name"), F.lit(None).cast("double").alias("value")),
        F.struct(F.lit("adjusted_status").alias("kind"), F.col("fill_adjusted_toxic_cost_status").alias("name"), adjusted.alias("value")),
        F.struct(F.lit("adjusted_component").alias("kind"), F.col("fill_adjusted_toxic_cost_component").alias("name"), adjusted.alias("value")),
        F.struct(F.lit("adjusted_sign").alias("kind"), F.when(adjusted.isNull(), "missing").when(adjusted > 0, "positive").when(adjusted < 0, "negative").otherwise("zero").alias("name"), adjusted.alias("value")),
    )
    each = results.select(*keys, F.explode(kinds).alias("k")).select(*keys, "k.*").filter(F.col("name").isNotNull())
    return each.groupBy(*keys, "kind", "name").agg(F.count("*").alias("rows"), F.avg("value").alias("mean"), F.sum("value").alias("total"))


def wide(breakdown: DataFrame, by: list[str], names: dict[str, list[str]]) -> DataFrame:
    """The counts of a breakdown as one row with a column ``<kind>_<name>_count`` for each of the given names."""
    columns = [F.coalesce(F.sum(F.when((F.col("kind") == k) & (F.col("name") == n), F.col("rows"))), F.lit(0)).alias(f"{k}_{n}_count") for k, v in names.items() for n in v]
    return breakdown.groupBy(*by).agg(*columns)


def feasible(limits: dict[str, tuple[float | None, float | None]], columns: list[str]) -> Column:
    """Whether each named column is within its limits (least, most); a limit of None, or a column that isn't there, doesn't count, a null fails."""
    held = F.lit(True)
    for name, (least, most) in limits.items():
        if name in columns:
            held = held & (F.lit(True) if least is None else F.col(name) >= least) & (F.lit(True) if most is None else F.col(name) <= most)
    return F.coalesce(held, F.lit(False))


def objective(columns: list[str], wanted: list[str]) -> str:
    """The first of the wanted columns that is there; without any, an error."""
    for name in wanted:
        if name in columns:
            return name
    raise ValueError(f"none of {', '.join(wanted)} is there")


def ranked_min(rows: DataFrame, value: str, by: list[str] = [], into: str = "rank") -> DataFrame:
    """``rows`` with the rank of a value, equal ones alike, the least first and nulls last. Without ``by`` the window is over settings."""
    return rows.withColumn(into, F.rank().over(Window.partitionBy(*by).orderBy(F.asc_nulls_last(value))))


def described(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, median, deviation, least, most and count of a value for each group."""
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))


def mean_over(rows: DataFrame, group: str, axis: str, value: str) -> DataFrame:
    """The mean over groups of a value at each point of an axis, and how many groups have it."""
    each = rows.groupBy(group, axis).agg(F.avg(value).alias("__v"))
    return each.groupBy(axis).agg(F.avg("__v").alias("mean"), F.count("__v").alias("groups"))


def first_rows(parts: list[DataFrame], order: str) -> DataFrame:
    """The first row of each part, by name, in order."""
    out = parts[0].limit(1)
    for part in parts[1:]:
        out = out.unionByName(part.limit(1), allowMissingColumns=True)
    return out.orderBy(order)


def rolled_up(rows: DataFrame, by: list[str], value: str, keep: list[str], order: str) -> DataFrame:
    """Mean, deviation and count of a value for each group, and the first of other columns by ``order``; NaN counts as missing."""
    known = F.nanvl(value, F.lit(None))
    return rows.groupBy(*by).agg(F.avg(known).alias("mean"), F.stddev_samp(known).alias("std"), F.count(known).alias("n"), *(F.min_by(c, order).alias(c) for c in keep))


def pivoted(rows: DataFrame, row: str, column: str, value: str, names: list) -> DataFrame:
    """A row for each ``row`` with a column for each name, and the mean over them."""
    out = rows.groupBy(row).pivot(column, names).agg(F.avg(value))
    known = F.filter(F.array(*(F.col(f"`{n}`") for n in names)), lambda x: x.isNotNull())
    return out.withColumn("row_mean", F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known)))


def setting_of(rows: DataFrame, settings: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``rows`` with the first setting of their keys; a row without one is an error."""
    first = best_by(settings, keys, [F.col(order)]).withColumn("__there", F.lit(True))
    out = rows.join(first, keys, "left")
    some = next(c for c in settings.columns if c not in keys)
    missing = F.raise_error(F.concat(F.lit("no setting for "), F.to_json(F.struct(*keys)))).cast(settings.schema[some].dataType)
    return out.withColumn(some, F.when(F.col("__there"), F.col(some)).otherwise(missing)).drop("__there")


def cached(wanted: DataFrame, cache: DataFrame, keys: list[str], compute) -> DataFrame:
    """Rows of the wanted keys: those of the cache, and what ``compute`` makes of the keys that it lacks, each once."""
    missing = wanted.select(*keys).distinct().join(cache.select(*keys), keys, "left_anti")
    return cache.join(wanted.select(*keys), keys, "left_semi").unionByName(compute(missing))


def normalized_weights(rows: DataFrame, weight: str, by: list[str] = []) -> DataFrame:
    """``rows`` with finite positive weights that sum to one in each group."""
    usable = rows.filter((F.col(weight) > 0) & ~F.isnan(weight) & (F.col(weight) != float("inf")))
    whole = usable.groupBy(*by).agg(F.sum(weight).alias("__w"))
    joined = usable.join(whole, by) if by else usable.crossJoin(F.broadcast(whole))
    return joined.withColumn(weight, F.col(weight) / F.col("__w")).drop("__w")


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: the mean under weights of the values that are known."""
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def time_weighted(results: DataFrame, horizon_ms: Column, value: str = "implementation_shortfall_bps", by: str | None = None) -> DataFrame:
    """Mean with weights 1 / max(horizon, 0.001 ms), of one sum over all rows; for each ``by``, its part of the weights and mean under them."""
    rows = results.withColumn("__w", F.lit(1.0) / F.greatest(horizon_ms, F.lit(0.001))).filter(F.col("__w").isNotNull() & F.col(value).isNotNull())
    whole = rows.agg(F.sum("__w").alias("__all"))
    keys = [by] if by else []
    each = rows.groupBy(*keys).agg(F.sum("__w").alias("__s"), F.sum(F.col("__w") * F.col(value)).alias("__x"))
    return each.crossJoin(F.broadcast(whole)).select(*keys, (F.col("__s") / F.col("__all")).alias("weight"), (F.col("__x") / F.col("__s")).alias("weighted_mean"))


def ranked(grid: DataFrame, *, cost: str, fills: str, least_fills: int, band: float, keys: list[str]) -> DataFrame:
    """``grid`` with feasible, rank_all, rank_feasible and rank_near_best: among feasible rows within ``band`` of the best cost, most fills first.

    The windows are over settings, whose number doesn't grow with the orders.
    """
    feasible = F.coalesce(F.col(fills) >= least_fills, F.lit(False)) & F.col(cost).isNotNull()
    out = grid.withColumn("feasible", feasible)
    best = out.filter("feasible").agg(F.min(cost).alias("__best"))
    out = out.crossJoin(F.broadcast(best)).withColumn("near_best", F.col("feasible") & (F.col(cost) <= F.col("__best") + band)).drop("__best")
    by_cost = [F.asc_nulls_last(cost), *keys]
    out = out.withColumn("rank_all", F.row_number().over(Window.orderBy(*by_cost)))
    out = out.withColumn("rank_feasible", F.when(F.col("feasible"), F.row_number().over(Window.partitionBy("feasible").orderBy(*by_cost))))
    return out.withColumn("rank_near_best", F.when(F.col("near_best"), F.row_number().over(Window.partitionBy("near_best").orderBy(F.desc(fills), *by_cost))))


def best_by(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__n = 1").drop("__n")


def improvement(grid: DataFrame, *, limit: str, cost: str, thresholds: list[float], baseline: float) -> DataFrame:
    """(threshold, best_cost, improvement): the best feasible cost with the limit up to each threshold, against the baseline limit's."""
    points = grid.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    base = grid.filter(F.col(limit) == baseline).agg(F.min(cost).alias("__base"))
    allowed = grid.filter("feasible").join(F.broadcast(points), F.col(limit) <= F.col("threshold"))
    return allowed.groupBy("threshold").agg(F.min(cost).alias("best_cost")).crossJoin(F.broadcast(base)).select("threshold", "best_cost", (F.col("__base") - F.col("best_cost")).alias("improvement"))


def against_baseline(metrics: DataFrame, by: list[str], axis: str, value: str, baseline: float = 0.0) -> DataFrame:
    """``metrics`` with the difference of ``value`` to the row of the same ``by`` whose axis is the baseline; without one, an error."""
    base = metrics.filter(F.abs(F.col(axis) - baseline) <= 1e-9).select(*by, F.col(value).alias("__base"), F.lit(True).alias("__there"))
    out = metrics.join(base, by, "left")
    delta = F.when(F.col("__there"), F.col(value) - F.col("__base")).otherwise(F.raise_error(F.lit("no baseline row")).cast("double"))
    return out.withColumn("delta", delta).drop("__base", "__there")


#: The distribution function of a Poisson variable of mean 1.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)


def poisson_weights(rows: DataFrame, uniform: Column, trials: int) -> DataFrame:
    """``rows`` once for each ``trial`` with their number of ``copies`` in it.

    Resampling n of n rows gives each row about a Poisson number of copies, which
    a uniform number of row and trial tells; no join, no count of rows.
    """
    each = rows.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).withColumn("__u", uniform)
    return each.withColumn("copies", sum(F.when(F.col("__u") >= p, 1.0).otherwise(0.0) for p in POISSON)).drop("__u")


def poisson_bootstrap(rows: DataFrame, value: str, uniform: Column, trials: int) -> DataFrame:
    """(trial, mean): resamples as Poisson weights of a uniform number for each row and ``trial``; sums are partial on each task."""
    each = poisson_weights(rows, uniform, trials)
    return each.groupBy("trial").agg((F.sum(F.col(value) * F.col("copies")) / F.sum(F.when(F.col(value).isNotNull(), F.col("copies")))).alias("mean"))


def bootstrap_metrics(results: DataFrame, uniform: Column, trials: int, horizon_ms: Column, least_ms: float = 0.001) -> DataFrame:
    """A row for each trial: mean and median shortfall, its time-weighted mean, the mean toxic cost and the mean fill-adjusted cost."""
    each = poisson_weights(results, uniform, trials).filter("copies > 0")
    bps, copies = F.when(F.col("metric_status") == "ok", F.col("implementation_shortfall_bps")), F.col("copies")
    toxic = F.when(F.col("cost_type") == "toxic_cost", bps)
    return each.groupBy("trial").agg(
        weighted_mean(bps, copies).alias("mean_is_bps"),
        F.percentile(bps, 0.5, copies.cast("long")).alias("median_is_bps"),
        weighted_mean(bps, copies / F.greatest(horizon_ms, F.lit(least_ms))).alias("time_weighted_mean_is_bps"),
        weighted_mean(toxic, copies).alias("toxic_cost_mean_bps"),
        weighted_mean(F.col("fill_adjusted_toxic_cost_bps"), copies).alias("fill_adjusted_toxic_cost_mean_bps"),
    )


def interval(trials: DataFrame, value: str = "mean", low: float = 0.025, high: float = 0.975) -> DataFrame:
    """One row: the mean over trials and the percentile interval."""
    q = F.percentile(value, F.array(F.lit(low), F.lit(high)))
    return trials.agg(F.avg(value).alias("estimate"), q.alias("q")).select("estimate", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


#: More pairs than this are not tested exactly: 2 ** n sign vectors.
MOST_PAIRS = 24


def sign_flip(differences: DataFrame, value: str = "difference", by: list[str] = [], alternative: str = "two-sided") -> DataFrame:
    """(by, n, observed, p_value): the exact sign-flip test of each group's mean, with one added to both counts.

    All 2 ** n sign vectors are evaluated, in rows of 2 ** 8; more than
    ``MOST_PAIRS`` pairs are an error. alternative: two-sided, greater or less.
    """
    values = differences.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("x")).filter(F.size("x") > 0)
    size = F.when(F.size("x") <= MOST_PAIRS, F.size("x")).otherwise(F.raise_error(F.lit(f"more than {MOST_PAIRS} pairs")).cast("int"))
    values = values.withColumn("n", size).withColumn("observed", F.aggregate("x", F.lit(0.0), lambda a, v: a + v))
    signs = values.withColumn("s", F.explode(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.col("n")) - 1)))
    flipped = F.aggregate(F.transform("x", lambda v, i: F.when(F.col("s").bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0, -v).otherwise(v)), F.lit(0.0), lambda a, v: a + v)
    far = {"two-sided": F.abs(flipped) >= F.abs("observed") - 1e-12, "greater": flipped >= F.col("observed") - 1e-12, "less": flipped <= F.col("observed") + 1e-12}[alternative]
    tested = signs.select(*by, "n", (F.col("observed") / F.col("n")).alias("observed"), far.alias("as_far"))
    return tested.groupBy(*by, "n", "observed").agg(((F.count_if("as_far") + 1) / (F.count("*") + 1)).alias("p_value"))


def holm(tests: DataFrame, p: str = "p_value", keys: list[str] = ["name"]) -> DataFrame:
    """``tests`` with holm_p: step-down adjusted, at most 1, never falling. The window is over tests."""
    order = Window.orderBy(F.asc(p), *keys)
    m = F.count("*").over(Window.partitionBy())
    stepped = tests.withColumn("__a", (m - F.row_number().over(order) + 1) * F.col(p))
    return stepped.withColumn("holm_p", F.least(F.lit(1.0), F.max("__a").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("__a")


def most_complete(rows: DataFrame, by: list[str], of: list[str], keys: list[str]) -> DataFrame:
    """Of the rows that share ``by``, the one with the most values among ``of``."""
    known = reduce(lambda a, b: a + b, (F.col(c).isNotNull().cast("int") for c in of))
    return best_by(rows, by, [known.desc(), *(F.col(k) for k in keys)])


def coverage(rows: DataFrame, by: list[str], distinct: list[str], counted: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), *(F.count_distinct(c).alias(f"distinct_{c}") for c in distinct), *(F.count(c).alias(f"known_{c}") for c in counted))


def annualized_volatility(bars: DataFrame, by: str = "ticker", day: str = "day", close: str = "close") -> DataFrame:
    """Low, high, range, mean close and sqrt(252) times the deviation of daily log returns."""
    before = F.lag(close).over(Window.partitionBy(by).orderBy(day))
    returns = bars.withColumn("__r", F.log(F.try_divide(F.col(close), before)))
    out = returns.groupBy(by).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.avg(close).alias("mean_close"), (F.stddev_samp("__r") * F.sqrt(F.lit(252.0))).alias("volatility"))
    return out.withColumn("range_pct", (F.col("high") / F.col("low") - 1) * 100)


def timing(rows: DataFrame, by: list[str], milliseconds: str = "ms", batch: str = "batch") -> DataFrame:
    """Mean, population deviation, median, 90th percentile and samples a second of timed runs."""
    q = F.percentile(milliseconds, F.array(F.lit(0.5), F.lit(0.9)))
    out = rows.groupBy(*by).agg(F.avg(milliseconds).alias("mean"), F.stddev_pop(milliseconds).alias("std"), q.alias("q"), F.avg(batch).alias("__b"))
    return out.select(*by, "mean", "std", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p90"), F.try_divide(F.col("__b") * 1000, F.col("mean")).alias("samples_per_s"))


def mean_interval(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, deviation, count, standard error and the mean plus and minus 1.96 of it."""
    out = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n")).withColumn("sem", F.try_divide(F.col("std"), F.sqrt("n")))
    return out.withColumns({"low": F.col("mean") - F.col("sem") * 1.96, "high": F.col("mean") + F.col("sem") * 1.96})


def pairwise(rows: DataFrame, unit: str, model: str, value: str) -> DataFrame:
    """(model_a, model_b, n, mean_difference, wins): every pair of models over the units that both have. Rows are one for each unit and model."""
    a = rows.select(unit, F.col(model).alias("model_a"), F.col(value).alias("__a"))
    b = rows.select(unit, F.col(model).alias("model_b"), F.col(value).alias("__b"))
    both = a.join(b, unit).filter("model_a < model_b")
    return both.groupBy("model_a", "model_b").agg(F.count("*").alias("n"), F.avg(F.col("__a") - F.col("__b")).alias("mean_difference"), F.count_if(F.col("__a") > F.col("__b")).alias("wins"))


def pairwise_tests(rows: DataFrame, unit: str, model: str, value: str) -> DataFrame:
    """``pairwise`` with the exact sign-flip p-value of each pair of models and that adjusted over all pairs."""
    a = rows.select(unit, F.col(model).alias("model_a"), F.col(value).alias("__a"))
    b = rows.select(unit, F.col(model).alias("model_b"), F.col(value).alias("__b"))
    differences = a.join(b, unit).filter("model_a < model_b").withColumn("difference", F.col("__a") - F.col("__b"))
    return holm(sign_flip(differences, by=["model_a", "model_b"]), keys=["model_a", "model_b"])


def flattened(results: DataFrame, struct: str = "decision") -> DataFrame:
    """The fields of a struct as columns of their own, with its name before theirs."""
    fields = results.schema[struct].dataType.names
    return results.select(*(c for c in results.columns if c != struct), *(F.col(f"{struct}.{f}").alias(f"{struct}_{f}") for f in fields))
