"""Books, features, message streams and as-of joins over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import book
from tidemark.functions.names import OF_BOOK
from tidemark.operators import asof, flow
from tidemark.plans import adapters
from tidemark.plans.registry import query, rounded

_PX = "px AS (SELECT book_id, side, price, sum(size)::DOUBLE AS size, sum(count) AS count FROM v_levels GROUP BY ALL)"
_MAPS = f"""{_PX}, maps AS (SELECT book_id, list({{'p': price, 's': size}} ORDER BY price) FILTER (side = 'A') AS asks, list({{'p': price, 's': size}} ORDER BY price DESC) FILTER (side = 'B') AS bids FROM px GROUP BY book_id)"""
_HOUR = 3_600_000_000_000


def _maps(spark, sf_dir):
    return book.as_maps(adapters.levels(spark, sf_dir))


@query(f"""WITH {_PX} SELECT book_id, max(CASE WHEN side = 'B' THEN price END) AS best_bid, min(CASE WHEN side = 'A' THEN price END) AS best_ask FROM px GROUP BY book_id""")
def level_bbo(spark, sf_dir):
    bid, ask = F.when(F.col("side") == "B", F.col("price")), F.when(F.col("side") == "A", F.col("price"))
    return adapters.levels(spark, sf_dir).groupBy("book_id").agg(F.max(bid).alias("best_bid"), F.min(ask).alias("best_ask"))


@query("""SELECT book_id, side, price, CAST(sum(size) AS BIGINT) AS size, CAST(sum(count) AS BIGINT) AS count FROM v_levels l JOIN
 (SELECT book_id, side, CASE WHEN side = 'B' THEN max(price) ELSE min(price) END AS best FROM v_levels GROUP BY book_id, side) b USING (book_id, side) WHERE price = best GROUP BY ALL""")
def aggregated_bbo(spark, sf_dir):
    best = Window.partitionBy("book_id", "side")
    price = F.when(F.col("side") == "B", F.max("price").over(best)).otherwise(F.min("price").over(best))
    by_price = adapters.levels(spark, sf_dir).groupBy("book_id", "side", "price").agg(F.sum("size").alias("size"), F.sum("count").alias("count"))
    return by_price.withColumn("best", price).filter("price = best").drop("best")


@query(f"""WITH {_PX}, r AS (SELECT *, row_number() OVER (PARTITION BY book_id, side ORDER BY CASE WHEN side = 'B' THEN -price ELSE price END) AS level FROM px)
 SELECT book_id, level, max(CASE WHEN side = 'B' THEN price END) AS bid_px, max(CASE WHEN side = 'B' THEN size END) AS bid_sz, max(CASE WHEN side = 'A' THEN price END) AS ask_px,
 max(CASE WHEN side = 'A' THEN size END) AS ask_sz FROM r WHERE level <= 5 GROUP BY book_id, level""")
def depth_snapshot_5(spark, sf_dir):
    outward = Window.partitionBy("book_id", "side").orderBy(F.when(F.col("side") == "B", -F.col("price")).otherwise(F.col("price")))
    px = adapters.levels(spark, sf_dir).groupBy("book_id", "side", "price").agg(F.sum("size").cast("double").alias("size"))
    ranked = px.withColumn("level", F.row_number().over(outward)).filter("level <= 5")

    def of(side, column):
        return F.max(F.when(F.col("side") == side, F.col(column)))

    return ranked.groupBy("book_id", "level").agg(of("B", "price").alias("bid_px"), of("B", "size").alias("bid_sz"), of("A", "price").alias("ask_px"), of("A", "size").alias("ask_sz"))


@query("""SELECT book_id, publisher_id, price, side, size, CAST(coalesce(sum(size) OVER (PARTITION BY book_id, side, price ORDER BY publisher_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead FROM v_levels""")
def queue_ahead(spark, sf_dir):
    before = Window.partitionBy("book_id", "side", "price").orderBy("publisher_id").rowsBetween(Window.unboundedPreceding, -1)
    return adapters.levels(spark, sf_dir).select("book_id", "publisher_id", "price", "side", "size", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("ahead"))


_NAMES = [f"{s}{k}_{c}" for k in range(1, 6) for s in ("ask", "bid") for c in ("px", "sz")]


def _top_sql(price: str, missing: str) -> str:
    out = []
    for k in range(1, 6):
        for s in ("ask", "bid"):
            out.append(f"{price.format(s=s, k=k)} AS {s}{k}_px" if not missing else f"{missing.format(s=s, k=k)} AS {s}{k}_px")
            out.append(f"coalesce({s}s[{k}].s, 0.0) AS {s}{k}_sz")
    return ", ".join(out)


@query(f"WITH {_MAPS} SELECT book_id, {_top_sql('coalesce({s}s[{k}].p, 0)::DOUBLE', '')} FROM maps")
def raw_top5(spark, sf_dir):
    out = _maps(spark, sf_dir).select("book_id", book.top_levels(F.col("bids"), F.col("asks")).alias("f"))
    return out.select("book_id", *(F.col("f")[k].alias(n) for k, n in enumerate(_NAMES)))


@query(f"""WITH {_MAPS}, m AS (SELECT *, CASE WHEN len(bids) > 0 AND len(asks) > 0 THEN (bids[1].p + asks[1].p) / 2.0::DOUBLE ELSE 0.0::DOUBLE END AS mid FROM maps)
 SELECT book_id, {_top_sql('', 'coalesce({s}s[least({k}, len({s}s))].p - mid, 0.0)::DOUBLE')} FROM m""")
def diff_top5(spark, sf_dir):
    out = _maps(spark, sf_dir).select("book_id", book.top_differences(F.col("bids"), F.col("asks")).alias("f"))
    return out.select("book_id", *(F.col("f")[k].alias(n) for k, n in enumerate(_NAMES)))


_CENTER = f"""{_PX}, c AS (SELECT book_id, CAST(round_even((max(CASE WHEN side = 'B' THEN price END) + min(CASE WHEN side = 'A' THEN price END)) / 2.0::DOUBLE, 0) AS BIGINT) AS center FROM px GROUP BY book_id
 HAVING count(DISTINCT side) = 2)"""


def _centered(spark, sf_dir):
    bids, asks = F.col("bids"), F.col("asks")
    return _maps(spark, sf_dir).filter(book.two_sided(bids, asks)).withColumn("center", book.anchor(book.mid(bids, asks), 1)), bids, asks


@query(f"""WITH {_CENTER} SELECT book_id, CAST(price - center AS INTEGER) AS step, sum(CASE WHEN side = 'A' THEN size ELSE -size END) AS value FROM px JOIN c USING (book_id)
 WHERE abs(price - center) <= 20 GROUP BY ALL HAVING sum(CASE WHEN side = 'A' THEN size ELSE -size END) <> 0""")
def moving_window(spark, sf_dir):
    maps, bids, asks = _centered(spark, sf_dir)
    out = maps.select("book_id", F.posexplode(book.moving_window(bids, asks, F.col("center"), 1)).alias("p", "value"))
    return out.filter("value <> 0").select("book_id", (F.col("p") - 20).alias("step"), "value")


@query(f"""WITH {_CENTER}, s AS (SELECT CAST(unnest(range(-20, 21)) AS INTEGER) AS step) SELECT book_id, step, coalesce(sum(CASE WHEN step > 0 AND side = 'A' AND price > center AND price <= center + step THEN size
 WHEN step < 0 AND side = 'B' AND price < center AND price >= center + step THEN -size END), 0.0)::DOUBLE AS value FROM c CROSS JOIN s JOIN px USING (book_id) GROUP BY book_id, step""")
def market_depth(spark, sf_dir):
    maps, bids, asks = _centered(spark, sf_dir)
    out = maps.select("book_id", F.posexplode(book.market_depth(bids, asks, F.col("center"), 1)).alias("p", "value"))
    return out.select("book_id", (F.col("p") - 20).alias("step"), (F.col("value") + F.lit(0.0)).alias("value"))


_MS = f"""{_MAPS}, t AS (SELECT book_id, bids[1:5] AS b, asks[1:5] AS a, bids[1].p AS bb, asks[1].p AS ba, bids[1].s AS bt, asks[1].s AS at_ FROM maps WHERE len(bids) > 0 AND len(asks) > 0),
 u AS (SELECT *, (bb + ba) / 2.0::DOUBLE AS mid, list_sum(list_transform(b, lambda x: x.s)) AS db, list_sum(list_transform(a, lambda x: x.s)) AS da,
 list_sum(list_transform(b, lambda x: x.s / (1 + abs(bb - x.p)))) AS wb, list_sum(list_transform(a, lambda x: x.s / (1 + abs(x.p - ba)))) AS wa,
 list_concat(list_transform(b, lambda x: x.s), list_transform(a, lambda x: x.s)) AS v FROM t)"""


@query(f"""WITH {_MS} SELECT book_id, round(ln(1 + greatest((ba - bb) / mid, 0)), 6) AS spread_relative, round((bt - at_) / (bt + at_), 6) AS imbalance_tob, round((db - da) / (db + da), 6) AS depth_imbalance,
 round((wb - wa) / (wb + wa), 6) AS weighted_imbalance, round(ln(1 + wb + wa), 6) AS total_weighted_volume, round((bt + at_) / (db + da), 6) AS tob_concentration,
 round(sqrt(list_var_pop(v)) / list_avg(v), 6) AS volume_cv, round(((bb * at_ + ba * bt) / (bt + at_) - mid) / mid, 6) AS microprice_offset,
 len(list_filter(b, lambda x: x.s >= 0.1 * (db + da)))::DOUBLE AS significant_bid_levels, len(list_filter(a, lambda x: x.s >= 0.1 * (db + da)))::DOUBLE AS significant_ask_levels FROM u""")
def toxicity_features(spark, sf_dir):
    out = book.add_microstructure(_maps(spark, sf_dir).filter(book.two_sided(F.col("bids"), F.col("asks"))), "f")
    return out.select("book_id", *(rounded(F.col("f")[k]).alias(n) for k, n in enumerate(OF_BOOK)))


_GAPS = "g AS (SELECT *, coalesce(ts_event - lag(ts_event) OVER (PARTITION BY instrument_id ORDER BY ts_event, seq), 0) // 1000 AS gap_us FROM v_ticks)"


@query(f"WITH {_GAPS} SELECT seq, gap_us, round(ln(1 + gap_us / 1000.0::DOUBLE), 6) AS gap_log_ms FROM g")
def time_delta_log(spark, sf_dir):
    return flow.gaps(adapters.ticks(spark, sf_dir)).select("seq", "gap_us", rounded("gap_log_ms").alias("gap_log_ms"))


@query(f"WITH {_GAPS} SELECT instrument_id, count(*) AS n, round(avg(gap_us), 3) AS mean_us, max(gap_us) AS max_us FROM g GROUP BY instrument_id")
def inter_event_gaps(spark, sf_dir):
    return flow.gaps(adapters.ticks(spark, sf_dir)).groupBy("instrument_id").agg(F.count("*").alias("n"), rounded(F.avg("gap_us"), 3).alias("mean_us"), F.max("gap_us").alias("max_us"))


@query("""WITH n AS (SELECT *, (row_number() OVER (PARTITION BY instrument_id ORDER BY ts_event, seq) - 1) // 15 AS bucket FROM v_ticks)
 SELECT instrument_id, bucket, count(*) AS messages, max(ts_event) AS ts_event, arg_max(price, (ts_event, seq)) AS price, count(*) FILTER (action = 'T') AS trades, CAST(sum(size) AS BIGINT) AS volume
 FROM n GROUP BY instrument_id, bucket HAVING count(*) = 15""")
def count_bucket_snapshots(spark, sf_dir):
    return flow.count_buckets(adapters.ticks(spark, sf_dir), 15)


_REST = "rs AS (SELECT *, CAST(sum(CASE WHEN action = 'A' THEN size WHEN action = 'C' THEN -size ELSE 0 END) OVER (PARTITION BY instrument_id ORDER BY ts_event, seq) AS BIGINT) AS resting FROM v_ticks)"
_THIN = _REST.replace("WHEN action = 'C' THEN -size", "WHEN action = 'C' THEN -8 * size")


@query(f"WITH {_REST} SELECT seq, resting FROM rs")
def running_resting_size(spark, sf_dir):
    return flow.resting(adapters.ticks(spark, sf_dir)).select("seq", "resting")


def _thin(spark, sf_dir):
    """Messages whose cancels are eight times as large, so that books empty."""
    return adapters.ticks(spark, sf_dir).withColumn("size", F.when(F.col("action") == "C", F.col("size") * 8).otherwise(F.col("size")))


_EMPTY = f"{_THIN}, em AS (SELECT * FROM (SELECT *, lag(resting) OVER (PARTITION BY instrument_id ORDER BY ts_event, seq) AS before FROM rs) WHERE before > 0 AND resting <= 0)"


@query(f"WITH {_EMPTY} SELECT seq, instrument_id, ts_event, resting FROM em")
def empty_transitions(spark, sf_dir):
    return flow.empty_points(_thin(spark, sf_dir)).select("seq", "instrument_id", "ts_event", "resting")


_TARGETS = f"""{_EMPTY}, lim AS (SELECT min(ts_event) AS lo, max(ts_event) AS hi FROM em), tg AS (SELECT lo + i * (hi - lo) // 8 AS target FROM lim, (SELECT unnest(range(1, 8)) AS i)),
 pts AS (SELECT DISTINCT arg_min(ts_event, (abs(ts_event - target), ts_event)) AS split_point FROM tg CROSS JOIN em GROUP BY target)"""


def _points(spark, sf_dir) -> list[int]:
    """Split points among the first two thousand empty points of each stretch of the table: at most seven."""
    found = flow.empty_points(_thin(spark, sf_dir)).select("ts_event")
    low, high = found.agg(F.min("ts_event"), F.max("ts_event")).first()
    if low is None:
        return []
    targets = [low + k * (high - low) // 8 for k in range(1, 8)]
    nearest = found.agg(*(F.min_by("ts_event", F.struct(F.abs(F.col("ts_event") - t), "ts_event")) for t in targets)).first()
    return sorted(set(nearest))


@query(f"WITH {_TARGETS} SELECT split_point FROM pts")
def split_points_balanced(spark, sf_dir):
    return spark.createDataFrame([(p,) for p in _points(spark, sf_dir)], "split_point long")


@query(f"WITH {_TARGETS} SELECT segment, count(*) AS messages FROM (SELECT (SELECT count(*) FROM pts WHERE split_point <= ts_event) AS segment FROM v_ticks) GROUP BY segment")
def segment_counts(spark, sf_dir):
    return flow.segments(adapters.ticks(spark, sf_dir), _points(spark, sf_dir)).groupBy("segment").agg(F.count("*").alias("messages"))


@query(f"""WITH q AS (SELECT * FROM v_ticks WHERE action = 'A'), s AS (SELECT seq AS id, instrument_id, ts_event + {_HOUR} AS t FROM v_ticks WHERE action = 'T')
 SELECT id, arg_min(q.price, (q.ts_event, q.seq)) AS next_price, (min(q.ts_event) - t) // 1000 AS wait_us FROM s LEFT JOIN q ON q.instrument_id = s.instrument_id AND q.ts_event >= t GROUP BY id, t""")
def asof_forward_quote(spark, sf_dir):
    ticks = adapters.ticks(spark, sf_dir)
    due = ticks.filter("action = 'T'").select(F.col("seq").alias("id"), "instrument_id", (F.col("ts_event") + _HOUR).alias("t"))
    out = asof.forward(due, ticks.filter("action = 'A'"), by=["instrument_id"], at="t", time="ts_event", values=["price"], tie="seq", width=24 * _HOUR)
    return out.select("id", "next_price", F.floor((F.col("next_ts_event") - F.col("t")) / 1000).alias("wait_us"))


_SPANS = (1, 6, 24)


@query(f"""WITH q AS (SELECT * FROM v_ticks WHERE action = 'A'), s AS (SELECT seq AS id, instrument_id, ts_event + w * {_HOUR} AS t, w FROM v_ticks, (SELECT unnest({list(_SPANS)}) AS w) WHERE action = 'C'),
 f AS (SELECT id, w, arg_min(q.price, (q.ts_event, q.seq)) AS p FROM s LEFT JOIN q ON q.instrument_id = s.instrument_id AND q.ts_event >= t GROUP BY id, w)
 SELECT id, {', '.join(f'max(CASE WHEN w = {w} THEN p END) AS price_{w}h' for w in _SPANS)} FROM f GROUP BY id""")
def post_trade_windows(spark, sf_dir):
    ticks = adapters.ticks(spark, sf_dir)
    fills = ticks.filter("action = 'C'").select(F.col("seq").alias("id"), "instrument_id", "ts_event", F.explode(F.array(*map(F.lit, _SPANS))).alias("w"))
    due = fills.select("id", "instrument_id", "w", (F.col("ts_event") + F.col("w") * F.lit(_HOUR)).alias("t"))
    found = asof.forward(due, ticks.filter("action = 'A'"), by=["instrument_id"], at="t", time="ts_event", values=["price"], tie="seq", width=24 * _HOUR)
    return found.groupBy("id").agg(*(F.max(F.when(F.col("w") == w, F.col("next_price"))).alias(f"price_{w}h") for w in _SPANS))


@query(f"""WITH o AS (SELECT seq AS id, instrument_id, ts_event AS a, ts_event + {6 * _HOUR} AS b FROM v_ticks WHERE action = 'T'),
 s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts_event, seq) AS n FROM v_ticks) WHERE n % 5 = 0)
 SELECT id, count(*) AS snapshots, min(ts_event) AS first_ts FROM o JOIN s ON s.instrument_id = o.instrument_id AND ts_event > a AND ts_event <= b GROUP BY id""")
def interval_join_lifetime(spark, sf_dir):
    ticks = adapters.ticks(spark, sf_dir)
    orders = ticks.filter("action = 'T'").select(F.col("seq").alias("id"), "instrument_id", F.col("ts_event").alias("a"), (F.col("ts_event") + 6 * _HOUR).alias("b"))
    snaps = ticks.withColumn("n", F.row_number().over(flow.in_order(["instrument_id"], "ts_event", "seq"))).filter("n % 5 = 0").select("instrument_id", "ts_event")
    return asof.within(orders, snaps, by=["instrument_id"], start="a", end="b", time="ts_event", width=6 * _HOUR).groupBy("id").agg(F.count("*").alias("snapshots"), F.min("ts_event").alias("first_ts"))


@query("""WITH d AS (SELECT instrument_id, price, CAST(sum(size) FILTER (action = 'A') AS BIGINT) AS ahead, coalesce(CAST(sum(size) FILTER (action = 'C') AS BIGINT), 0) AS taken FROM v_ticks GROUP BY instrument_id, price)
 SELECT instrument_id, price, ahead, greatest(ahead - taken, 0) AS queue_left FROM d WHERE ahead IS NOT NULL""")
def queue_fold(spark, sf_dir):
    ticks = adapters.ticks(spark, sf_dir)
    cancels = F.collect_list(F.when(F.col("action") == "C", F.struct("ts_event", "seq", "action", "size")))
    levels = ticks.groupBy("instrument_id", "price").agg(F.sum(F.when(F.col("action") == "A", F.col("size"))).alias("ahead"), F.array_sort(cancels).alias("m")).filter("ahead is not null")
    return levels.select("instrument_id", "price", "ahead", flow.queue_left(F.col("ahead"), F.col("m")).alias("queue_left"))


@query("""WITH o AS (SELECT order_id, entry_time, entry_time + CAST(duration_s * 1000000 AS BIGINT) * 1000 AS e FROM v_orders)
 SELECT order_id, CASE WHEN e - entry_time > 10000000000 THEN entry_time + 10000000000 ELSE e END AS end_time, e - entry_time > 10000000000 AS censored FROM o""")
def time_censor(spark, sf_dir):
    orders = adapters.orders(spark, sf_dir).withColumn("e", F.col("entry_time") + (F.round(F.col("duration_s") * 1_000_000).cast("long")) * 1000)
    end, late = flow.time_censor(F.col("entry_time"), F.col("e"), 10_000_000_000)
    return orders.select("order_id", end.alias("end_time"), late.alias("censored"))


_SEQ_LAST = f"""{_PX}, sq AS (SELECT DISTINCT book_id, book_id // 4 AS seq FROM px), lb AS (SELECT seq, max(book_id) AS book_id FROM sq GROUP BY seq),
 ct AS (SELECT lb.seq, CAST(round_even((max(CASE WHEN side = 'B' THEN price END) + min(CASE WHEN side = 'A' THEN price END)) / 2.0::DOUBLE, 0) AS BIGINT) AS center FROM lb JOIN px USING (book_id) GROUP BY lb.seq
 HAVING count(*) FILTER (side = 'B') > 0 AND count(*) FILTER (side = 'A') > 0)"""


def _snapshot_sequences(spark, sf_dir):
    """Sequences of the books of four neighbouring keys, in order."""
    snapshots = _maps(spark, sf_dir).select(F.floor(F.col("book_id") / 4).alias("seq"), F.struct("book_id", "bids", "asks").alias("s"))
    return snapshots.groupBy("seq").agg(F.array_sort(F.collect_list("s"), lambda x, y: x["book_id"].cast("long").cast("int") - y["book_id"].cast("int")).alias("snapshots"))


@query(f"""WITH {_SEQ_LAST}, n AS (SELECT book_id, seq, CAST(row_number() OVER (PARTITION BY seq ORDER BY book_id) - 1 AS INTEGER) AS step FROM sq)
 SELECT seq, step, CAST(price - center AS INTEGER) AS offset, sum(CASE WHEN side = 'A' THEN size ELSE -size END) AS value FROM n JOIN ct USING (seq) JOIN px USING (book_id)
 WHERE abs(price - center) <= 20 GROUP BY ALL HAVING sum(CASE WHEN side = 'A' THEN size ELSE -size END) <> 0""")
def sequence_on_one_grid(spark, sf_dir):
    rows = _snapshot_sequences(spark, sf_dir).select("seq", F.posexplode(book.on_one_grid(F.col("snapshots"), "moving_window", tick=1)).alias("step", "cells"))
    return rows.select("seq", "step", F.posexplode("cells").alias("p", "value")).filter("value <> 0").select("seq", "step", (F.col("p") - 20).alias("offset"), "value")


@query(f"WITH {_SEQ_LAST}, n AS (SELECT seq, count(*) AS steps FROM sq GROUP BY seq) SELECT n.seq, 6 AS rows, 41 AS least, 41 AS most, TRUE AS even, CAST(CASE WHEN center IS NULL THEN 0 ELSE steps END AS INTEGER) AS filled FROM n LEFT JOIN ct USING (seq)")
def sequence_shape(spark, sf_dir):
    """Sequences padded to six rows, and how many of the rows come from books."""
    snapshots = F.col("snapshots")
    padded = book.on_one_grid(snapshots, "market_depth", tick=1, length=6)
    bare = book.on_one_grid(snapshots, "market_depth", tick=1)
    return _snapshot_sequences(spark, sf_dir).select("seq", book.shape(padded).alias("s"), F.size(bare).alias("filled")).select("seq", "s.*", "filled")
