"""Forward as-of and interval joins, without pairing all rows of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def forward(left: DataFrame, right: DataFrame, *, by: list[str], at: str, time: str, values: list[str], tie: str, width: int, prefix: str = "next_") -> DataFrame:
    """``left`` with the values of the first row of ``right`` at or after its ``at``, for equal ``by``.

    Rows of equal time are taken in the order of ``tie``. A key's rows are split
    into stretches of ``width`` time units, each a task's work of its own; a row
    without a match in its stretch takes the first of the next one that has
    rows. Rows of ``left`` without any match have nulls.
    """
    payload = F.struct(F.col(time), F.col(tie), *(c for c in values if c not in (time, tie)))
    r = right.select(*by, F.floor(F.col(time) / width).alias("__s"), F.col(time).alias("__t"), F.lit(0).alias("__k"), payload.alias("__v"))
    first = r.groupBy(*by, "__s").agg(F.min("__v").alias("__first"))
    marked = left.withColumns({"__s": F.floor(F.col(at) / width), "__t": F.col(at), "__k": F.lit(1)})
    rows = marked.unionByName(r, allowMissingColumns=True)
    # from the last to the first: at equal times rows of right are seen before rows of left
    back = Window.partitionBy(*by, "__s").orderBy(F.desc("__t"), "__k", F.desc("__v")).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("__here", F.last("__v", ignorenulls=True).over(back)).filter("__k = 1").drop("__v", "__t", "__k")
    stretches = marked.select(*by, "__s").distinct().join(first, [*by, "__s"], "full")
    later = Window.partitionBy(*by).orderBy(F.desc("__s")).rowsBetween(Window.unboundedPreceding, -1)
    nexts = stretches.select(*by, "__s", F.last("__first", ignorenulls=True).over(later).alias("__later"))
    out = found.join(nexts, [*by, "__s"], "left").withColumn("__m", F.coalesce("__here", "__later"))
    return out.select(*left.columns, *(F.col(f"__m.{c}").alias(f"{prefix}{c}") for c in dict.fromkeys([time, *values])))


def within(intervals: DataFrame, points: DataFrame, *, by: list[str], start: str, end: str, time: str, width: int) -> DataFrame:
    """Pairs of an interval and a point with start < time <= end, for equal ``by``.

    Both are keyed by stretches of ``width``, an interval once for each that it touches.
    """
    first, last = F.floor(F.col(start) / width), F.floor(F.col(end) / width)
    spread = intervals.withColumn("__s", F.explode(F.sequence(first, F.greatest(first, last))))
    keyed = points.withColumn("__s", F.floor(F.col(time) / width))
    return spread.join(keyed, [*by, "__s"]).filter((F.col(time) > F.col(start)) & (F.col(time) <= F.col(end))).drop("__s")
