"""Decisions of policies on labelled orders, and what they cost."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import post_columns, quoted
from tidemark.operators.markout import mid

#: A policy: from columns of the orders and predictions to whether to act (submit, or hold once submitted).
Policy = Callable[[], Column]


@dataclass(frozen=True)
class Threshold:
    """Act if the toxic share of the fill probability is at most ``most`` and the fill probability at least ``fill``."""

    most: float
    fill: float = 0.0

    def __call__(self, favorable: str = "favorable", toxic: str = "toxic") -> Column:
        total, toxic = F.col(favorable) + F.col(toxic), F.col(toxic)
        share = F.coalesce(F.try_divide(toxic, total), F.lit(0.0))
        return (share <= self.most) & (total >= self.fill)


@dataclass(frozen=True)
class ToxicCif:
    """Act if the toxic incidence is at most ``most``."""

    most: float

    def __call__(self, toxic: str = "toxic") -> Column:
        return F.col(toxic) <= self.most


def always() -> Column:
    return F.lit(True)


def decide(orders: DataFrame, act: Column) -> DataFrame:
    """``orders`` with decision_action submit or skip."""
    return orders.withColumn("decision_action", F.when(act, "submit").otherwise("skip"))


def first_cancel(decided: DataFrame, evaluations: DataFrame, hold: Column, by: str = "order_id", step: str = "end_idx") -> DataFrame:
    """``decided`` after later evaluations: a submitted order is canceled at its first step that isn't held; a skipped one stays skipped.

    reference_end_idx is the step of the cancel, else null.
    """
    cancels = evaluations.filter(~hold).groupBy(by).agg(F.min(step).alias("__at"))
    out = decided.join(cancels, by, "left")
    gone = (F.col("decision_action") == "submit") & F.col("__at").isNotNull()
    return out.withColumn("reference_end_idx", F.when(gone, F.col("__at"))).withColumn("decision_action", F.when(gone, "cancel").otherwise(F.col("decision_action"))).drop("__at")


def lifecycle_diagnostics(decided: DataFrame, evaluations: DataFrame, hold: Column, by: str = "order_id", step: str = "end_idx") -> DataFrame:
    """``first_cancel`` with what led to it: looks up to the cancel, or all of them, the last of these, and whether a skipped order was never looked at."""
    marked = evaluations.select(by, step, (~hold).alias("__stop"))
    first = marked.filter("__stop").groupBy(by).agg(F.min(step).alias("__until"))
    seen = marked.join(first, by, "left").filter(F.col("__until").isNull() | (F.col(step) <= F.col("__until")))
    counted = seen.groupBy(by).agg(F.count("*").alias("looks"), F.max(step).alias("last_look"))
    out = first_cancel(decided, evaluations, hold, by, step).join(counted, by, "left")
    skipped = F.col("decision_action") == "skip"
    return out.withColumns({"looks": F.when(skipped, 0).otherwise(F.coalesce("looks", F.lit(0))), "last_look": F.when(~skipped, F.col("last_look"))})


def run(orders: DataFrame, act: Column, window_ms: int, *, evaluations: DataFrame | None = None, hold: Column | None = None, later_bid: str, later_ask: str, calibration: DataFrame | None = None) -> DataFrame:
    """All of a backtest on labelled orders: decide at entry, cancel at later looks, then the costs of every order.

    calibration: fills, other than the orders, whose settled window is used in place of ``window_ms``.
    """
    from tidemark.operators import markout

    decided = decide(orders, act)
    if evaluations is not None and hold is not None:
        decided = lifecycle_diagnostics(decided, evaluations, hold)
    found = markout.analyze(calibration)[1] if calibration is not None else None
    used = found or window_ms
    return shortfall(decided, used, later_bid=later_bid, later_ask=later_ask).withColumn("selected_window_ms", F.lit(used))


def strategies(orders: DataFrame, rules: dict[str, Column], window_ms: int, **quotes: str) -> DataFrame:
    """The costs of all orders under each rule, with its name as ``strategy``: the orders are read once for all rules."""
    names = F.array(*(F.struct(F.lit(n).alias("strategy"), F.coalesce(rule, F.lit(False)).alias("__act")) for n, rule in rules.items()))
    each = orders.withColumn("__r", F.explode(names)).withColumns({"strategy": F.col("__r.strategy"), "__act": F.col("__r.__act")}).drop("__r")
    return shortfall(decide(each, F.col("__act")).drop("__act"), window_ms, **quotes)


def lifecycle_steps(steps: Column, first: Column, stride: int) -> Column:
    """Indices after the first at which an order is looked at again."""
    return F.when(steps - 1 >= first + stride, F.sequence(first + stride, steps - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))


def capped_steps(steps: Column, first: Column, stride: int, most: int | None) -> Column:
    """As ``lifecycle_steps`` from the step after the first on, at most ``most`` of them, evenly spaced."""
    from tidemark.operators.samples import spaced

    if stride < 1 or (most is not None and most < 1):
        raise ValueError("stride and the number of looks must be positive")
    all_of = F.when(steps - 1 >= first + 1, F.sequence(first + 1, steps - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    if most is None:
        return all_of
    return F.when(F.size(all_of) <= most, all_of).otherwise(F.transform(spaced(F.size(all_of), most), lambda k: F.get(all_of, k)))


def orders_in_chunks(orders: DataFrame, chunks: list[tuple[int | None, int | None]], time: str = "entry_time") -> DataFrame:
    """``orders`` with the number of the half-open chunk that their time is in. The chunks are a literal."""
    number = F.lit(None).cast("int")
    for k, (start, end) in enumerate(chunks):
        number = F.when(in_chunk(F.col(time), start, end), k).otherwise(number)
    return orders.withColumn("chunk", number).filter(F.col("chunk").isNotNull())


def replay_end(end: int | None, lifetime_s: float | None, windows_ms: tuple[int, ...]) -> int | None:
    """How far a chunk's messages must be read: its end, and what an order from its last moment can live and be watched after."""
    if end is None or lifetime_s is None:
        return None
    return end + int(lifetime_s * 1_000_000_000) + max(windows_ms, default=0) * 1_000_000


def legacy_post(side: int) -> Column:
    """The bid (0) or ask (1) of the last window captured below the fifth: the single quote of older files."""
    from tidemark.functions.names import WINDOWS_MS

    return F.coalesce(*(F.col(quoted(post_columns(w)[side])) for w in reversed(WINDOWS_MS[:4])))


def side_cost(side: Column, price: Column, reference: Column) -> Column:
    """What a fill at ``price`` costs against a reference; null for an unknown side."""
    return F.when(side == "B", price - reference).when(side == "A", reference - price)


def opportunity(side: Column, entry_bid: Column, entry_ask: Column, later_bid: Column, later_ask: Column) -> tuple[Column, Column, Column]:
    """Drift of the quote on the other side of a missed fill, the quote at entry, and what is missing if that is unknown."""
    cost = F.when(side == "B", later_ask - entry_ask).when(side == "A", entry_bid - later_bid)
    basis = F.when(side == "B", entry_ask).when(side == "A", entry_bid)
    reason = (
        F.when((side == "B") & entry_ask.isNull(), "missing_entry_ask")
        .when((side == "B") & later_ask.isNull(), "missing_reference_ask")
        .when((side == "A") & entry_bid.isNull(), "missing_entry_bid")
        .when((side == "A") & later_bid.isNull(), "missing_reference_bid")
        .when(~side.isin("A", "B"), "invalid_side")
    )
    return cost, basis, reason


def shortfall(decided: DataFrame, window_ms: int, *, later_bid: str, later_ask: str, price_unit: float = 1.0) -> DataFrame:
    """``decided`` with the implementation shortfall of each order.

    A submitted order that was filled costs its price against the mid of the
    selected window (toxic_cost); any other one the drift of the opposite quote
    since entry (opportunity_cost). Rows that lack an input fail with a reason.
    The fill-adjusted cost is the realised one, or the negated cost of a fill
    that the policy avoided, or 0.
    """
    side = F.col("side")
    actual = F.col("status_reason") == "FILLED"
    submitted = F.col("decision_action") != "skip"
    canceled = F.col("decision_action") == "cancel"
    filled = submitted & ~canceled & actual
    after = mid(*(F.col(quoted(c)) for c in post_columns(window_ms)))
    toxic = side_cost(side, F.col("price"), after)
    missed, basis, reason = opportunity(side, F.col("best_bid_at_entry"), F.col("best_ask_at_entry"), F.col(later_bid), F.col(later_ask))
    why = F.when(filled, F.when(F.col("price").isNull(), "missing_limit_price").when(after.isNull(), "missing_reference_mid").when(toxic.isNull(), "invalid_side")).otherwise(reason)
    out = decided.withColumns({"submitted": submitted, "canceled": canceled, "filled": filled, "actual_filled": actual, "missing_reason": why, "cost_type": F.when(filled, "toxic_cost").otherwise("opportunity_cost")})
    ok = F.col("missing_reason").isNull()
    raw = F.when(ok, F.when(filled, toxic).otherwise(missed.cast("double")))
    base = F.when(filled, after).otherwise(basis.cast("double"))
    theoretical = F.try_divide(toxic, after) * 10000
    avoided = ~filled & (~submitted | canceled) & actual
    return out.withColumns(
        {
            "metric_status": F.when(ok, "ok").otherwise("failed"),
            "implementation_shortfall_raw": raw,
            "implementation_shortfall": raw / price_unit,
            "implementation_shortfall_bps": F.try_divide(raw, base) * 10000,
            "fill_adjusted_toxic_cost_component": F.when(filled, "realized_toxic_cost").when(avoided, "flipped_counterfactual_toxic_cost").otherwise("unfilled_zero"),
            "fill_adjusted_toxic_cost_bps": F.when(filled, F.when(ok, theoretical)).when(avoided, -theoretical).otherwise(0.0),
            "fill_adjusted_toxic_cost_status": F.when((filled & ~ok) | (avoided & theoretical.isNull()), F.when(filled, "pending_realized_toxic_cost").otherwise("failed")).otherwise("ok"),
        }
    )


def valid_quotes(sequence: Column, end_idx: Column | None = None) -> Column:
    """(ask, bid) of the latest step of a top-of-book sequence with both quotes above 0, or of exactly ``end_idx``."""
    pair = F.transform(sequence, lambda r: F.struct(r[0].alias("ask"), r[2].alias("bid")))
    good = F.filter(pair, lambda p: (p["ask"] > 0) & (p["bid"] > 0))
    latest = F.try_element_at(good, F.lit(-1))
    if end_idx is None:
        return latest
    exact = F.get(pair, end_idx)
    return F.when(end_idx.isNull(), latest).otherwise(F.when((exact["ask"] > 0) & (exact["bid"] > 0), exact))


def effective(observed_ns: Column, latency_ms: float) -> Column:
    """When a decision reaches the market."""
    return observed_ns + int(latency_ms * 1_000_000)


@dataclass(frozen=True)
class StaticLatency:
    """The same latency for every decision."""

    ns: int

    @classmethod
    def milliseconds(cls, ms: float) -> StaticLatency:
        return cls(int(ms * 1_000_000))

    @classmethod
    def microseconds(cls, us: float) -> StaticLatency:
        return cls(int(us * 1_000))

    def at(self, observed_ns: Column) -> Column:
        return observed_ns + self.ns


@dataclass(frozen=True)
class MeasuredLatency:
    """A column of measured nanoseconds, never below a floor."""

    measured: str
    floor_ns: int = 0

    def at(self, observed_ns: Column) -> Column:
        return observed_ns + F.greatest(F.coalesce(F.col(self.measured), F.lit(0)), F.lit(self.floor_ns))


def deadline(entry: Column, session_end: Column, lifetimes_s: list[float | None]) -> Column:
    """The end of the session, or earlier by the caps on an order's lifetime."""
    caps = [entry + int(s * 1_000_000_000) for s in lifetimes_s if s is not None]
    return F.least(session_end, *caps) if caps else session_end


def check_coverage(messages: DataFrame, orders: DataFrame, entry: str = "entry_time", end: str = "deadline") -> None:
    """Raise if the feed starts after the first order or ends before the last deadline."""
    first, last = messages.agg(F.min("ts_event"), F.max("ts_event")).first()
    start, stop = orders.agg(F.min(entry), F.max(end)).first()
    if start is not None and (first is None or first > start or last < stop):
        raise ValueError(f"the feed covers {first} to {last}, the orders need {start} to {stop}")


def in_chunk(time: Column, start: int | None, end: int | None) -> Column:
    """Whether a time is in a half-open chunk."""
    after = F.lit(True) if start is None else time >= start
    return after & (F.lit(True) if end is None else time < end)


def overlapping(chunks: list[tuple[int | None, int | None]], first: int, last: int) -> list[int]:
    """Indices of the half-open chunks that the range from first to last touches."""
    return [k for k, (a, b) in enumerate(chunks) if (b is None or first < b) and (a is None or last >= a)]


def score_with(rows: DataFrame, predict: Callable, features: str, bins: int) -> DataFrame:
    """``rows`` with logits from a model: ``predict`` takes a list of feature windows and returns a list of 2 * bins logits each.

    It runs once for each Arrow batch; thresholds and horizons are swept over the
    result, not over the model.
    """
    @F.pandas_udf("array<double>")
    def logits(windows: pd.Series) -> pd.Series:
        out = predict(list(windows))
        if any(len(x) != 2 * bins for x in out):
            raise ValueError(f"a prediction isn't {2 * bins} wide")
        return pd.Series([list(map(float, x)) for x in out])

    return rows.withColumn("logits", logits(features))
