"""Spans of regular-expression matches as native column expressions.

``split`` and ``regexp_extract_all`` walk the same leftmost, non-overlapping
matches, so the lengths of the parts between matches and of the matches give
every position, in code points.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,end:bigint,hit:string,part:string,before:string,after:string>>"


@dataclass(frozen=True)
class Rule:
    """kind: its name. pattern: a Java regular expression whose matches are never
    empty. part: the group that ``holds`` looks at, 0 for the match. holds: of
    the match and that group, whether the match stands; None: all do."""

    kind: str
    pattern: str
    part: int = 0
    holds: Callable[[Column, Column], Column] | None = None


def find(df: DataFrame, text: str, rules: list[Rule], gate: Callable[[Rule], Column | None]) -> DataFrame:
    """``df`` with a column ``s_<kind>`` of spans for each rule, in order of start.

    gate: a condition without which a rule has no match in the row. Each text is
    split only where the rule's pattern is in it. The steps are projections of
    their own, so that no expression is evaluated twice.
    """
    keep = df.columns
    for rule in rules:
        found = F.col(text).rlike(rule.pattern)
        if (may := gate(rule)) is not None:
            found = may & found
        df = df.withColumn(f"m_{rule.kind}", F.coalesce(found, F.lit(False)))
    parts = []
    for rule in rules:
        there = F.col(f"m_{rule.kind}")
        parts.append(F.when(there, F.split(text, rule.pattern, -1)).alias(f"g_{rule.kind}"))
        parts.append(F.when(there, F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))).alias(f"h_{rule.kind}"))
        if rule.part:
            parts.append(F.when(there, F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.part))).alias(f"p_{rule.kind}"))
    df = df.select(*keep, *parts)
    return df.select(*keep, *(_placed(rule).alias(f"s_{rule.kind}") for rule in rules))


def _placed(rule: Rule) -> Column:
    gaps, hits = F.col(f"g_{rule.kind}"), F.col(f"h_{rule.kind}")
    part = F.col(f"p_{rule.kind}") if rule.part else hits
    rows = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), part.alias("part"), F.slice(gaps, F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(1))).alias("next"))
    rows = F.slice(rows, F.lit(1), F.greatest(F.size(hits), F.lit(0)))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"), x["part"].alias("part"), F.right(x["gap"], F.lit(40)).alias("before"), F.left(x["next"], F.lit(40)).alias("after"))
        holds = rule.holds(x["hit"], x["part"]) if rule.holds else F.lit(True)
        return F.struct(end.alias("at"), F.when(holds, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("out"))
    return F.when(hits.isNull(), F.array().cast(SPAN)).otherwise(F.aggregate(rows, start, step, lambda acc: acc["out"]))


def label(kind: str, x: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string"))
