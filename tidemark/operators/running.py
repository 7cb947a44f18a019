"""Running sums and exact ranks over any order, without a task that sees all rows.

Rows are dealt into ranges of the order and written once, so that the ranges
stay what they are; each range is summed, the sums of the ranges before it are
added to what a window gives within it. There is a row for each group and
range in the middle: some thousands, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import stage

#: Rows of a range, about.
RANGE = 1 << 20


def ranges(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` with the number of their range ``__part``; ranges follow by and order. Staged."""
    count = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = rows.repartitionByRange(count, *(F.col(c) for c in [*by, *order]))
    return stage(dealt.withColumn("__part", F.spark_partition_id()), "ranges")


def _carried(dealt: DataFrame, by: list[str], aggregates: dict[str, Column], merge) -> DataFrame:
    """For each group and range what the aggregates of the ranges before it come to. Ranges are few."""
    each = dealt.groupBy(*by, "__part").agg(*(a.alias(n) for n, a in aggregates.items()))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return each.select(*by, "__part", *(merge(F.col(n)).over(before).alias(n) for n in aggregates))


def _with(dealt: DataFrame, carried: DataFrame, by: list[str]) -> DataFrame:
    return dealt.join(F.broadcast(carried), [*by, "__part"])  # a row for each group and range


def running(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column], *, backwards: bool = False) -> DataFrame:
    """``rows`` with the sums over the rows of their group up to and including them, by ``order``; or, ``backwards``, over those after them.

    order: columns that tell the rows of a group apart.
    """
    values = {f"__v{k}": v for k, v in enumerate(sums.values())}
    dealt = ranges(rows.withColumns(values), by, order)
    carried = _carried(dealt, by, {f"__c{k}": F.sum(v) for k, v in enumerate(values)}, F.sum)
    inside = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = _with(dealt, carried, by)
    up = {n: F.coalesce(F.col(f"__c{k}"), F.lit(0)) + F.sum(f"__v{k}").over(inside) for k, n in enumerate(sums)}
    out = out.withColumns(up)
    if backwards:
        whole = dealt.groupBy(*by).agg(*(F.sum(v).alias(f"__t{k}") for k, v in enumerate(values)))
        out = out.join(F.broadcast(whole), by) if by else out.crossJoin(F.broadcast(whole))
        out = out.withColumns({n: F.col(f"__t{k}") - F.col(n) for k, n in enumerate(sums)})
    return out.drop("__part", *values, *(f"__c{k}" for k in range(len(sums))), *(f"__t{k}" for k in range(len(sums))))


def lagged(rows: DataFrame, by: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """``rows`` with the values (new name: column) of the row before them in their group."""
    dealt = ranges(rows, by, order)
    last = {f"__c{k}": F.max_by(F.struct(F.col(c).alias("v")), F.struct(*order)) for k, c in enumerate(values.values())}
    carried = _carried(dealt, by, last, lambda c: F.last(c, ignorenulls=True))
    inside = Window.partitionBy(*by, "__part").orderBy(*order)
    out = _with(dealt, carried, by).withColumn("__first", F.row_number().over(inside) == 1)
    new = {n: F.when(F.col("__first"), F.col(f"__c{k}")["v"]).otherwise(F.lag(c).over(inside)) for k, (n, c) in enumerate(values.items())}
    return out.withColumns(new).drop("__part", "__first", *(f"__c{k}" for k in range(len(values))))


def numbered(rows: DataFrame, by: list[str], order: list[str], into: str = "number") -> DataFrame:
    """``rows`` with their number in their group, from 0."""
    return running(rows, by, order, {into: F.lit(1).cast("long")}).withColumn(into, F.col(into) - 1)


def quantiles(rows: DataFrame, by: list[str], value: str, probabilities: list[float]) -> DataFrame:
    """(by, n, q): for each group the exact linear quantiles of its values, nulls and NaN left out.

    Equal values are counted first, so that a frequent one is one row. Groups
    without values have no row.
    """
    known = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = known.groupBy(*by, F.col(value).cast("double").alias("__x")).agg(F.count("*").alias("__n"))
    upto = running(counts, by, ["__x"], {"__upto": F.col("__n")})
    whole = upto.groupBy(*by).agg(F.max("__upto").alias("n"))
    both = upto.join(F.broadcast(whole), by) if by else upto.crossJoin(F.broadcast(whole))  # a row for each group
    picks = []
    for k, p in enumerate(probabilities):
        place = (F.col("n") - 1) * F.lit(float(p))
        for rank in (F.floor(place), F.ceil(place)):
            there = (rank >= F.col("__upto") - F.col("__n")) & (rank < F.col("__upto"))
            picks.append(F.max(F.when(there, F.col("__x"))).alias(f"__q{len(picks)}"))
    found = both.groupBy(*by, "n").agg(*picks)

    def between(k: int, p: float) -> Column:
        place = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.col(f"__q{2 * k}"), F.col(f"__q{2 * k + 1}")
        return low + (place - F.floor(place)) * (high - low)

    return found.select(*by, "n", F.array(*(between(k, p) for k, p in enumerate(probabilities))).alias("q"))
