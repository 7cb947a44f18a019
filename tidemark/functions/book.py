"""Book features as native columns over maps of price to size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import GRID_WINDOW, OF_BOOK


def as_maps(levels: DataFrame, by: str = "book_id") -> DataFrame:
    """Rows (book, bids, asks): price to size of every book, summed over venues and orders."""
    sized = levels.groupBy(by, "side", "price").agg(F.sum("size").cast("double").alias("size"))

    def of(side: str) -> Column:
        return F.map_from_entries(F.collect_list(F.when(F.col("side") == side, F.struct("price", "size"))))

    return sized.groupBy(by).agg(of("B").alias("bids"), of("A").alias("asks"))


def ordered(book: Column, best_first: str) -> Column:
    """Levels (key, value) of a side, the best first: ``bid`` or ``ask``."""
    return F.sort_array(F.map_entries(book), asc=best_first == "ask")


def best(book: Column, side: str) -> Column:
    return F.array_max(F.map_keys(book)) if side == "bid" else F.array_min(F.map_keys(book))


def two_sided(bids: Column, asks: Column) -> Column:
    return (F.size(bids) > 0) & (F.size(asks) > 0)


def mid(bids: Column, asks: Column) -> Column:
    """Between the best quotes; 0 if a side is empty."""
    return F.when(two_sided(bids, asks), (best(bids, "bid") + best(asks, "ask")) / 2.0).otherwise(0.0)


def anchor(middle: Column, tick: int) -> Column:
    """The grid price nearest to a price, halves to even."""
    return (F.rint(middle / tick) * tick).cast("long")


def top_levels(bids: Column, asks: Column, n: int = 5) -> Column:
    """Ask price, ask size, bid price, bid size of each of n levels; 0 where there is none."""
    b, a = ordered(bids, "bid"), ordered(asks, "ask")

    def pair(side: Column, k: int) -> list[Column]:
        level = F.get(side, F.lit(k))
        return [F.coalesce(level["key"].cast("double"), F.lit(0.0)), F.coalesce(level["value"].cast("double"), F.lit(0.0))]

    return F.array(*(x for k in range(n) for x in pair(a, k) + pair(b, k)))


def top_differences(bids: Column, asks: Column, n: int = 5) -> Column:
    """As ``top_levels`` with prices less the mid; a missing level repeats the last difference and has size 0."""
    b, a, middle = ordered(bids, "bid"), ordered(asks, "ask"), mid(bids, asks)

    def pair(side: Column, k: int) -> list[Column]:
        seen = F.get(side, F.least(F.lit(k), F.size(side) - 1))
        return [F.when(F.size(side) > 0, seen["key"] - middle).otherwise(0.0), F.coalesce(F.get(side, F.lit(k))["value"].cast("double"), F.lit(0.0))]

    return F.array(*(x for k in range(n) for x in pair(a, k) + pair(b, k)))


def moving_window(bids: Column, asks: Column, center: Column, tick: int, window: int = GRID_WINDOW) -> Column:
    """Ask less bid size at each grid price around the center, the center included."""
    grid = F.sequence(F.lit(-window), F.lit(window))
    zero = F.lit(0.0)
    return F.transform(grid, lambda o: F.coalesce(F.try_element_at(asks, center + o * tick), zero) - F.coalesce(F.try_element_at(bids, center + o * tick), zero))


def market_depth(bids: Column, asks: Column, center: Column, tick: int, window: int = GRID_WINDOW) -> Column:
    """Sizes accumulated outwards: asks above the center, minus bids below it, 0 at it."""
    zero = F.lit(0.0)

    def running(side: Column, sign: int) -> Column:
        steps = F.sequence(F.lit(1), F.lit(window))
        sizes = F.transform(steps, lambda s: F.coalesce(F.try_element_at(side, center + s * sign * tick), zero))
        return F.aggregate(sizes, F.array().cast("array<double>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), zero) + x)))

    below = F.reverse(F.transform(running(bids, -1), lambda x: -x))
    return F.concat(below, F.array(zero), running(asks, 1))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def add_microstructure(books: DataFrame, into: str = "features", n: int = 5) -> DataFrame:
    """``books`` (with bids and asks) and an array of the features named in ``OF_BOOK``; zeros if a side is empty.

    Each step is a projection of its own: what later steps use more than once is
    evaluated once a row.
    """
    columns = books.columns
    bids, asks, c = F.col("bids"), F.col("asks"), F.col
    rows = books.withColumns({"__b": F.slice(ordered(bids, "bid"), 1, n), "__a": F.slice(ordered(asks, "ask"), 1, n)})
    first = {"__bid": F.get("__b", F.lit(0)), "__ask": F.get("__a", F.lit(0))}
    rows = rows.withColumns(first | {"__vb": F.transform("__b", lambda x: x["value"]), "__va": F.transform("__a", lambda x: x["value"])})
    bid, ask, top_b, top_a = c("__bid.key"), c("__ask.key"), c("__bid.value"), c("__ask.value")
    weighted_b = _sum(F.transform("__b", lambda x: x["value"] / (1 + F.abs(bid - x["key"]))))
    weighted_a = _sum(F.transform("__a", lambda x: x["value"] / (1 + F.abs(x["key"] - ask))))
    rows = rows.withColumns({"__db": _sum(c("__vb")), "__da": _sum(c("__va")), "__wb": weighted_b, "__wa": weighted_a, "__v": F.concat("__vb", "__va"), "__mid": (bid + ask) / 2.0, "__top": top_b + top_a})
    rows = rows.withColumns({"__depth": c("__db") + c("__da"), "__mean": (c("__db") + c("__da")) / F.size("__v")})
    variance = _sum(F.transform("__v", lambda x: (x - c("__mean")) * (x - c("__mean")))) / F.size("__v")

    def ratio(x: Column, y: Column) -> Column:
        return F.when(y > 0, x / y).otherwise(0.0)

    def significant(sizes: str) -> Column:
        return F.size(F.filter(sizes, lambda x: x >= F.greatest(c("__depth") * 0.1, F.lit(0.0)))).cast("double")

    middle, top, depth, weighted = c("__mid"), c("__top"), c("__depth"), c("__wb") + c("__wa")
    micro = ratio(bid * top_a + ask * top_b, top)
    values = (
        F.log1p(F.greatest(ratio(ask - bid, middle), F.lit(0.0))),
        ratio(top_b - top_a, top),
        ratio(c("__db") - c("__da"), depth),
        ratio(c("__wb") - c("__wa"), weighted),
        F.log1p(F.greatest(weighted, F.lit(0.0))),
        ratio(top, depth),
        ratio(F.sqrt(variance), c("__mean")),
        F.when(top > 0, ratio(micro - middle, middle)).otherwise(0.0),
        significant("__vb"),
        significant("__va"),
    )
    zeros = F.array_repeat(F.lit(0.0), len(OF_BOOK))
    return rows.select(*columns, F.when(two_sided(bids, asks), F.array(*values)).otherwise(zeros).alias(into))


def queue_feature(ahead: Column) -> Column:
    return F.log1p(F.greatest(ahead, F.lit(0.0)))


def pad_left(rows: Column, length: int, width: int) -> Column:
    """The last ``length`` rows of a sequence, zero rows before them if there are fewer."""
    zero = F.array_repeat(F.lit(0.0), width)
    kept = F.slice(rows, F.greatest(F.size(rows) - length + 1, F.lit(1)), F.lit(length))
    return F.concat(F.array_repeat(zero, F.greatest(F.lit(length) - F.size(rows), F.lit(0))), kept)


def window_ending(rows: Column, end: Column, length: int, width: int) -> Column:
    """``length`` rows up to index ``end`` (from 0), zero rows before the first."""
    return pad_left(F.slice(rows, F.lit(1), end + 1), length, width)


def joined(*sequences: Column) -> Column:
    """Sequences of rows side by side."""
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, y)), sequences)


def checked(rows: Column, width: int) -> Column:
    """The sequence, or an error if a row has another width."""
    return F.when(F.forall(rows, lambda r: F.size(r) == width), rows).otherwise(F.raise_error(F.lit(f"a row is not {width} wide")))


def side_value(side: Column) -> Column:
    return F.when(side == "B", 1.0).when(side == "A", 0.0).otherwise(0.5)


#: How a book becomes a row of features: of a map of bids, one of asks, and a center where the form needs one.
FORMS = {
    "moving_window": lambda bids, asks, center, tick, window: moving_window(bids, asks, center, tick, window),
    "market_depth": lambda bids, asks, center, tick, window: market_depth(bids, asks, center, tick, window),
    "raw_top5": lambda bids, asks, center, tick, window: top_levels(bids, asks),
    "diff_top5": lambda bids, asks, center, tick, window: top_differences(bids, asks),
}


def on_one_grid(snapshots: Column, form: str, *, tick: int, window: int = GRID_WINDOW, length: int | None = None) -> Column:
    """Rows of features of a sequence of snapshots (structs with bids and asks), all on the grid of the last one.

    An empty sequence, or one whose last book lacks a side, has no rows. With a
    ``length`` there are as many: zero rows first where there are fewer, the
    last ones where there are more.
    """
    last = F.try_element_at(snapshots, F.lit(-1))
    center = anchor(mid(last["bids"], last["asks"]), tick)
    usable = (F.size(snapshots) > 0) & two_sided(last["bids"], last["asks"])
    width = 20 if form in ("raw_top5", "diff_top5") else 2 * window + 1
    rows = F.transform(snapshots, lambda s: FORMS[form](s["bids"], s["asks"], center, tick, window))
    rows = F.when(usable, rows).otherwise(F.array().cast("array<array<double>>"))
    return rows if length is None else pad_left(rows, length, width)


def with_queue(rows: Column, ahead: Column) -> Column:
    """Each row with the log of the size ahead of an order at that step."""
    return F.zip_with(rows, ahead, lambda r, a: F.concat(r, F.array(queue_feature(a))))


def with_gaps(rows: Column, times_ns: Column) -> Column:
    """Each row with log1p of the milliseconds since the one before, 0 for the first."""
    gap = F.transform(times_ns, lambda t, i: F.when(i == 0, 0.0).otherwise(F.log1p(F.greatest((t - F.get(times_ns, i - 1)) / 1_000_000.0, F.lit(0.0)))))
    return F.zip_with(rows, gap, lambda r, g: F.concat(r, F.array(g)))


def model_window(lob: Column, orders: Column, side: Column, end: Column, length: int, widths: tuple[int, int] = (20, 12)) -> Column:
    """The window up to index ``end`` that a model takes: book features, order features, side and a mask, zeros before the first step.

    Both sequences are cut to the shorter; an index beyond is its last. The side
    is 1, 0 or 0.5 where there is a step; the mask says where there is one. Rows
    of other widths, or no steps at all, are errors.
    """
    steps = F.least(F.size(lob), F.size(orders))
    last = F.least(F.greatest(end, F.lit(0)), steps - 1)
    both = joined(F.slice(checked(lob, widths[0]), F.lit(1), steps), F.slice(checked(orders, widths[1]), F.lit(1), steps))
    marked = F.transform(both, lambda r: F.concat(r, F.array(side_value(side), F.lit(1.0))))
    return F.when(steps > 0, window_ending(marked, last, length, sum(widths) + 2)).otherwise(F.raise_error(F.lit("a window needs a step")))


def shape(cells: Column) -> Column:
    """(rows, least, most, even) of a sequence of rows: their number, the least and the most width, and whether all are alike."""
    widths = F.transform(F.coalesce(cells, F.array().cast("array<array<double>>")), lambda r: F.coalesce(F.size(r), F.lit(0)))
    low, high = F.array_min(widths), F.array_max(widths)
    return F.struct(F.size(widths).alias("rows"), low.alias("least"), high.alias("most"), F.coalesce(low == high, F.lit(True)).alias("even"))
