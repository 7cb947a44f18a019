"""Rankings, rollups, tests and coercions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import book, coerce
from tidemark.functions.names import MICROSTRUCTURE, WINDOWS_MS, latency_grid, post_columns, suffix
from tidemark.operators import backtest, reports, samples, schedule
from tidemark.plans import adapters
from tidemark.plans.backtests import _A, _B, _COST, _DEC, _GRID, _LIFE, _OK, _RULE, WINDOW, _costs, _grid, _scored
from tidemark.plans.registry import query, rounded
from tidemark.plans.survival import _MAN, _SEQ, _LOOK, _sequences
from tidemark.storage import read

_WIDE = {
    "cost_type": ["toxic_cost", "opportunity_cost"],
    "failed": ["missing_reference_mid", "missing_entry_ask", "missing_entry_bid", "missing_reference_ask", "missing_reference_bid"],
    "adjusted_component": ["realized_toxic_cost", "flipped_counterfactual_toxic_cost", "unfilled_zero"],
}


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, '{n}')" for k, n in enumerate(MICROSTRUCTURE)) + ") t(position, name)")
def feature_names(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(MICROSTRUCTURE)), "position int, name string")


@query("SELECT * FROM (VALUES " + ", ".join(f"({w}, '{suffix(w)}')" for w in WINDOWS_MS) + ") t(ms, suffix)")
def window_suffixes(spark, sf_dir):
    return spark.createDataFrame([(w,) for w in WINDOWS_MS], "ms int").withColumn("suffix", coerce.window_suffix(F.col("ms")))


@query("SELECT 0.0::DOUBLE AS ms UNION SELECT DISTINCT round(0.01 * pow(5000.0::DOUBLE, k / 13.0::DOUBLE), 2) AS ms FROM (SELECT unnest(range(0, 14)) AS k)")
def latency_points(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in latency_grid()], "ms double")


@query("""SELECT order_id, strftime(day, '%Y%m%d') AS compact, CASE WHEN order_id % 5 = 0 THEN NULL ELSE trunc(price / 7.0::DOUBLE)::BIGINT END AS whole, price / 1e9::DOUBLE AS dollars,
 CASE WHEN order_id % 3 <> 0 THEN duration_s WHEN order_id % 5 <> 0 THEN price / 7.0::DOUBLE ELSE -1.0 END AS finite, strftime(make_timestamp(entry_time // 1000), '%Y-%m-%d %H:%M:%S') AS second FROM v_orders""")
def coerced_values(spark, sf_dir):
    k, price = F.col("order_id"), F.col("price")
    broken = F.when(k % 3 == 0, F.lit(float("nan"))).otherwise(F.col("duration_s"))
    text = F.when(k % 5 == 0, "none").otherwise((price / 7.0).cast("string"))
    return adapters.orders(spark, sf_dir).select(
        "order_id",
        coerce.compact_date(F.col("day")).alias("compact"),
        coerce.whole(text).alias("whole"),
        coerce.dollars(price).alias("dollars"),
        coerce.first_finite(broken, text, F.lit(-1.0)).alias("finite"),
        F.substring(coerce.ns_text(F.col("entry_time")), 1, 19).alias("second"),
    )


@query("""SELECT order_id, CASE WHEN order_id % 4 = 0 THEN status_reason = 'FILLED' WHEN order_id % 4 = 1 THEN order_id % 6 IN (1, 2) ELSE order_id % 2 = 0 END AS filled FROM v_orders""")
def labelled_fill(spark, sf_dir):
    k, none = F.col("order_id"), F.lit(None).cast("string")
    out = coerce.filled(F.when(k % 4 == 0, F.col("status_reason")).otherwise("nan"), none, F.when(k % 4 == 1, (k % 6).cast("string")), none, k % 2 == 0)
    return adapters.orders(spark, sf_dir).select("order_id", out.alias("filled"))


@query(f"""SELECT order_id, coalesce({', '.join(f'"{post_columns(w)[0]}"' for w in reversed(WINDOWS_MS[:4]))}) AS bid, coalesce({', '.join(f'"{post_columns(w)[1]}"' for w in reversed(WINDOWS_MS[:4]))}) AS ask FROM v_orders""")
def legacy_post_trade(spark, sf_dir):
    return adapters.orders(spark, sf_dir).select("order_id", *(backtest.legacy_post(side).alias(name) for side, name in ((0, "bid"), (1, "ask"))))


@query("""SELECT order_id, steps, least(2, steps - 1) AS entry, steps - 1 AS latest, least(4, steps - 1) AS fourth FROM (SELECT o_orderkey AS order_id, CAST(1 + o_orderkey % 9 AS INTEGER) AS steps FROM orders)""")
def snapshot_policy(spark, sf_dir):
    steps = F.size("gap_logs")
    return _sequences(spark, sf_dir).select("order_id", steps.alias("steps"), *(samples.end_index(p, steps, 3).alias(n) for p, n in (("entry", "entry"), ("latest", "latest"), ("index:4", "fourth"))))


@query("""SELECT seq, instrument_id, price, before FROM (SELECT *, lag(price) OVER (PARTITION BY instrument_id, side ORDER BY seq) AS before FROM v_ticks) WHERE price > before""")
def increases_within_groups(spark, sf_dir):
    return samples.increases(adapters.ticks(spark, sf_dir), ["instrument_id", "side"], "seq", "price").select("seq", "instrument_id", "price", "before")


@query(f"WITH {_MAN} SELECT count(*) AS samples, round(min(remaining_s), 6) AS least FROM man")
def remaining_time_falls(spark, sf_dir):
    rows = samples.require_falling(samples.manifest(_sequences(spark, sf_dir), lookback=_LOOK), ["order_id", "source_row"], "update_idx", "remaining_s")
    return rows.agg(F.count("*").alias("samples"), rounded(F.min("remaining_s")).alias("least"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts_event, seq) - 1 AS n FROM v_ticks), b AS (SELECT instrument_id, n // 15 AS bucket, count(*) AS m, arg_max(price, (ts_event, seq)) AS price FROM r GROUP BY ALL HAVING count(*) = 15)
 SELECT instrument_id, bucket, CAST(count(*) OVER w AS INTEGER) AS steps, CAST(sum(price) OVER w AS BIGINT) AS total, first_value(price) OVER w AS oldest FROM b WINDOW w AS (PARTITION BY instrument_id ORDER BY bucket ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def snapshot_lookback(spark, sf_dir):
    from tidemark.operators import flow

    snapshots = flow.lookback(flow.count_buckets(adapters.ticks(spark, sf_dir), 15), 5, "price")
    total = F.aggregate("history", F.lit(0).cast("long"), lambda a, x: a + x)
    return snapshots.select("instrument_id", "bucket", F.size("history").alias("steps"), total.alias("total"), F.get("history", F.lit(0)).alias("oldest"))


@query("""WITH e AS (SELECT unnest(range(0, 6)) AS feature, unnest(embedding[1:6])::DOUBLE AS x FROM embeddings), c AS (SELECT CAST(feature AS INTEGER) AS feature, CASE WHEN feature = 5 THEN 3.0 ELSE x END AS x FROM e)
 SELECT feature, round(avg(x), 6) AS mean, round(CASE WHEN stddev_pop(x) < 1e-6 THEN 1.0 ELSE stddev_pop(x) END, 6) AS std FROM c GROUP BY feature""")
def static_normalizer(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select(F.transform(F.slice("embedding", 1, 6), lambda x, i: F.when(i == 5, 3.0).otherwise(x.cast("double"))).alias("cells"))
    return samples.static_normalizer(rows, "cells").select("feature", rounded("mean").alias("mean"), rounded("std").alias("std"))


@query(f"WITH {_MAN} SELECT order_id, update_idx, round(remaining_s, 6) AS remaining_s FROM man WHERE order_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def manifest_of_orders(spark, sf_dir):
    wanted = read(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("order_id"))
    return samples.keep_orders(samples.manifest(_sequences(spark, sf_dir), lookback=_LOOK), wanted).select("order_id", "update_idx", rounded("remaining_s").alias("remaining_s"))


_GRID_S = [0.5, 1.0, 2.0, 5.0, 10.0]


@query(f"WITH {_SEQ} SELECT order_id, {_GRID_S}[least(steps - 2, 4) + 1]::DOUBLE AS seconds FROM sq WHERE steps >= 2 UNION ALL SELECT order_id, {_GRID_S}[1]::DOUBLE FROM sq WHERE steps < 2")
def horizon_seconds(spark, sf_dir):
    rows = _sequences(spark, sf_dir).select("order_id", (F.size("gap_logs") - 2).alias("bin"))
    return samples.bin_seconds(rows, "bin", _GRID_S).select("order_id", "seconds")


@query("""WITH d AS (SELECT o_orderkey AS order_id, (o_orderkey * 37 % 100000) / 1000.0::DOUBLE AS t FROM orders), m AS (SELECT min(t) AS lo, max(t) AS hi FROM d)
 SELECT order_id, CAST(least(ceil((t - lo) / ((hi - lo) / 8) - 1e-9) - 1, 7) AS INTEGER) AS bin FROM d, m""")
def histogram_bins(spark, sf_dir):
    rows = _sequences(spark, sf_dir).select("order_id", "duration_s")
    low, high = rows.agg(F.min("duration_s"), F.max("duration_s")).first()
    edges = samples.histogram_edges(low or 0.0, high or 0.0, 8)
    return rows.select("order_id", samples.digitized(F.col("duration_s"), edges).alias("bin"))


_LOB, _TOX = 3, 2


@query(f"""WITH {_SEQ}, c AS (SELECT order_id, steps, CAST(p AS INTEGER) AS p, steps - 1 - (3 - p) AS i FROM sq, (SELECT unnest(range(0, 4)) AS p)), f AS (SELECT *, CAST(unnest(range(0, 7)) AS INTEGER) AS feature FROM c)
 SELECT order_id, p, feature, CASE WHEN i < 0 THEN 0.0 WHEN feature < 3 THEN i * 10 + feature WHEN feature < 5 THEN -(i * 10 + feature - 3) WHEN feature = 5 THEN CASE WHEN order_id % 2 = 0 THEN 1.0 ELSE 0.0 END ELSE 1.0 END::DOUBLE AS x FROM f""")
def model_windows(spark, sf_dir):
    """Windows of four steps with three book features, two order features, side and mask."""

    def rows(width, sign):
        return F.transform("gap_logs", lambda _, i: F.array(*((i * 10 + k).cast("double") * sign for k in range(width))))

    side = F.when(F.col("order_id") % 2 == 0, "B").otherwise("A")
    window = book.model_window(rows(_LOB, 1.0), rows(_TOX, -1.0), side, F.lit(99), 4, (_LOB, _TOX))
    cells = _sequences(spark, sf_dir).select("order_id", F.posexplode(window).alias("p", "row"))
    return cells.select("order_id", "p", F.posexplode("row").alias("feature", "x")).withColumn("x", F.col("x") + F.lit(0.0))


@query(f"""WITH {_GRID} SELECT max_toxic, h, cost, rank() OVER (ORDER BY cost NULLS LAST) AS rank, coalesce(fills >= 100 AND cost <= 2.0, FALSE) AS feasible FROM g1""")
def feasible_settings(spark, sf_dir):
    grid = _grid(spark, sf_dir)
    limits = {"fills": (100, None), "cost": (None, 2.0), "not_there": (1, 1)}
    return reports.ranked_min(grid, "cost").select("max_toxic", "h", "cost", "rank", reports.feasible(limits, grid.columns).alias("feasible"))


@query(f"""WITH {_GRID} SELECT max_toxic, h, cost FROM g1 ORDER BY feasible DESC, cost NULLS LAST, max_toxic, h LIMIT 7""")
def grid_top(spark, sf_dir):
    rows = reports.ranked(_grid(spark, sf_dir), cost="cost", fills="fills", least_fills=400, band=0.3, keys=["max_toxic", "h"])
    return rows.orderBy(F.desc("feasible"), F.asc_nulls_last("cost"), "max_toxic", "h").limit(7).select("max_toxic", "h", "cost")


@query("""WITH t AS (SELECT ticker, (order_id % 4)::DOUBLE AS latency_ms, avg(duration_s) AS v FROM v_orders GROUP BY ALL) SELECT latency_ms, round(avg(v), 6) AS mean, count(v) AS groups FROM t GROUP BY latency_ms""")
def cross_ticker_mean(spark, sf_dir):
    rows = adapters.orders(spark, sf_dir).withColumn("latency_ms", (F.col("order_id") % 4).cast("double"))
    return reports.mean_over(rows, "ticker", "latency_ms", "duration_s").withColumn("mean", rounded("mean"))


@query("""SELECT ticker, side, round(avg(duration_s), 6) AS mean, round(median(duration_s), 6) AS median, round(stddev_samp(duration_s), 6) AS std, min(duration_s) AS low, max(duration_s) AS high, count(duration_s) AS n FROM v_orders GROUP BY ticker, side""")
def improvement_described(spark, sf_dir):
    out = reports.described(adapters.orders(spark, sf_dir), ["ticker", "side"], "duration_s")
    return out.select("ticker", "side", *(rounded(c).alias(c) for c in ("mean", "median", "std")), "low", "high", "n")


@query("""SELECT ticker, mean, n FROM (SELECT ticker, round(avg(duration_s), 6) AS mean, count(*) AS n FROM v_orders GROUP BY ticker) WHERE ticker IN ('T0', 'T1', 'T2')""")
def ticker_summary(spark, sf_dir):
    by = adapters.orders(spark, sf_dir).groupBy("ticker").agg(rounded(F.avg("duration_s")).alias("mean"), F.count("*").alias("n"))
    return reports.first_rows([by.filter(F.col("ticker") == t) for t in ("T2", "T0", "T1")], "ticker")


@query("""WITH g AS (SELECT ticker, CAST(order_id % 7 AS INTEGER) AS config, round(avg(duration_s), 6) AS mean, round(stddev_samp(duration_s), 6) AS std, count(duration_s) AS n, arg_min(side, order_id) AS side FROM v_orders WHERE order_id % 13 <> 0 GROUP BY ALL)
 SELECT * FROM g ORDER BY mean DESC, ticker, config LIMIT 20""")
def grid_rollup_top(spark, sf_dir):
    k = F.col("order_id")
    rows = adapters.orders(spark, sf_dir).withColumns({"config": (k % 7).cast("int"), "value": F.when(k % 13 == 0, F.lit(float("nan"))).otherwise(F.col("duration_s"))}).filter(k % 13 != 0)
    out = reports.rolled_up(rows, ["ticker", "config"], "value", ["side"], "order_id").withColumns({"mean": rounded("mean"), "std": rounded("std")})
    return out.orderBy(F.desc("mean"), "ticker", "config").limit(20)


@query("""WITH p AS (SELECT CAST(l_linenumber AS INTEGER) AS feature, round(avg(l_discount) FILTER (l_returnflag = 'A'), 8) AS "A", round(avg(l_discount) FILTER (l_returnflag = 'N'), 8) AS "N", round(avg(l_discount) FILTER (l_returnflag = 'R'), 8) AS "R",
 avg(l_discount) FILTER (l_returnflag = 'A') AS a, avg(l_discount) FILTER (l_returnflag = 'N') AS n, avg(l_discount) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
 SELECT feature, "A" AS m_a, "N" AS m_n, "R" AS m_r, round((a + n + r) / 3, 8) AS row_mean FROM p""")
def ablation_pivot(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("int").alias("feature"), "l_returnflag", F.col("l_discount").cast("double").alias("v"))
    out = reports.pivoted(rows, "feature", "l_returnflag", "v", ["A", "N", "R"])
    return out.select("feature", *(rounded(c, 8).alias(f"m_{c.lower()}") for c in ("A", "N", "R")), rounded("row_mean", 8).alias("row_mean"))


@query("""WITH s AS (SELECT ticker, side, arg_min(order_id, order_id) AS setting FROM v_orders GROUP BY ALL) SELECT order_id, setting FROM v_orders JOIN s USING (ticker, side)""")
def setting_lookup(spark, sf_dir):
    rows = adapters.orders(spark, sf_dir).select("order_id", "ticker", "side")
    settings = rows.withColumnRenamed("order_id", "setting")
    return reports.setting_of(rows, settings, ["ticker", "side"], "setting").select("order_id", "setting")


@query("SELECT order_id, CASE WHEN order_id % 4 = 0 THEN -1 ELSE order_id * 3 END AS prediction FROM (SELECT o_orderkey AS order_id FROM orders)")
def prediction_cache(spark, sf_dir):
    keys = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"))
    cache = keys.filter("order_id % 4 = 0").withColumn("prediction", F.lit(-1).cast("long"))
    return reports.cached(keys, cache, ["order_id"], lambda missing: missing.withColumn("prediction", F.col("order_id") * 3))


@query("""WITH n AS (SELECT order_id, ticker, duration_s + 0.001 AS w, price FROM v_orders WHERE order_id % 11 <> 0) SELECT ticker, round(sum(w) / sum(sum(w)) OVER (), 8) AS share, round(sum(w * price) / sum(w), 4) AS mean FROM n GROUP BY ticker""")
def weighted_means(spark, sf_dir):
    rows = adapters.orders(spark, sf_dir).withColumn("w", F.when(F.col("order_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("duration_s") + 0.001))
    held = reports.normalized_weights(rows.select("ticker", "w", "price"), "w")
    return held.groupBy("ticker").agg(rounded(F.sum("w"), 8).alias("share"), rounded(reports.weighted_mean(F.col("price"), F.col("w")), 4).alias("mean"))


_STEPS = "CAST(o_orderkey % 23 AS INTEGER)"


@query(f"""WITH s AS (SELECT o_orderkey AS order_id, 1 + {_STEPS} AS steps FROM orders), c AS (SELECT *, CASE WHEN steps <= 3 THEN 0 ELSE (steps - 4) // 2 + 1 END AS n FROM s),
 k AS (SELECT order_id, n, CAST(unnest(range(0, n)) AS INTEGER) AS i FROM c WHERE n <= 4 UNION ALL SELECT DISTINCT order_id, n, CAST(round_even(j * (n - 1) / 3.0::DOUBLE, 0) AS INTEGER) FROM c, (SELECT unnest(range(0, 4)) AS j) WHERE n > 4)
 SELECT order_id, 3 + 2 * i AS end_idx FROM k""")
def lifecycle_capped(spark, sf_dir):
    steps = (F.col("o_orderkey") % 23).cast("int") + 1
    looks = backtest.capped_steps(steps, F.lit(2), 2, 4)
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.explode(looks).alias("end_idx"))


@query("""WITH l AS (SELECT min(entry_time) AS a, max(entry_time) AS b FROM v_orders) SELECT CAST(CASE WHEN entry_time < a + (b - a) // 3 THEN 0 WHEN entry_time < a + 2 * ((b - a) // 3) THEN 1 ELSE 2 END AS INTEGER) AS chunk, count(*) AS orders FROM v_orders, l GROUP BY 1""")
def orders_by_chunk(spark, sf_dir):
    rows = adapters.orders(spark, sf_dir)
    low, high = rows.agg(F.min("entry_time"), F.max("entry_time")).first()
    third = (high - low) // 3
    chunks = [(None, low + third), (low + third, low + 2 * third), (low + 2 * third, None)]
    return backtest.orders_in_chunks(rows, chunks).groupBy("chunk").agg(F.count("*").alias("orders"))


@query("""SELECT event_id, strftime(timezone('America/New_York', ts::TIMESTAMP AT TIME ZONE 'UTC'), '%H:%M') BETWEEN '10:00' AND '15:59' AS within,
 epoch_us(((CAST(timezone('America/New_York', ts::TIMESTAMP AT TIME ZONE 'UTC') AS DATE) + CASE WHEN hour(timezone('America/New_York', ts::TIMESTAMP AT TIME ZONE 'UTC')) >= 16 THEN 1 ELSE 0 END)::TIMESTAMP + INTERVAL 16 HOUR) AT TIME ZONE 'America/New_York') * 1000 AS session_end FROM events""")
def session_deadlines(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("t"))
    return rows.select("event_id", schedule.in_session(F.col("t")).alias("within"), schedule.next_session_end(F.col("t")).alias("session_end"))


@query(f"""WITH {_COST}, o AS (SELECT *, missing_reason IS NULL AS ok FROM ks) SELECT ticker, count(*) FILTER (ok AND cost_type = 'toxic_cost') AS cost_type_toxic_cost_count, count(*) FILTER (ok AND cost_type = 'opportunity_cost') AS cost_type_opportunity_cost_count,
 {', '.join(f"count(*) FILTER (missing_reason = '{r}') AS failed_{r}_count" for r in _WIDE['failed'])}, {', '.join(f"count(*) FILTER (component = '{c}') AS adjusted_component_{c}_count" for c in _WIDE['adjusted_component'])} FROM o GROUP BY ticker""")
def report_counts(spark, sf_dir):
    return reports.wide(reports.cost_breakdown(_costs(spark, sf_dir), ["ticker"]), ["ticker"], _WIDE)


@query(f"""WITH {_COST}, s AS (SELECT CASE WHEN adj_bps IS NULL THEN 'missing' WHEN adj_bps > 0 THEN 'positive' WHEN adj_bps < 0 THEN 'negative' ELSE 'zero' END AS name, adj_bps AS v FROM ks)
 SELECT 'adjusted_sign' AS kind, name, count(*) AS rows, round(avg(v), 6) AS mean, round(sum(v), 4) AS total FROM s GROUP BY name UNION ALL
 SELECT 'cost_type', cost_type, count(*), round(avg(is_bps), 6), round(sum(is_bps), 4) FROM ks WHERE missing_reason IS NULL GROUP BY cost_type""")
def cost_breakdown(spark, sf_dir):
    rows = reports.cost_breakdown(_costs(spark, sf_dir)).filter(F.col("kind").isin("adjusted_sign", "cost_type"))
    return rows.withColumns({"mean": rounded("mean"), "total": rounded("total", 4)})


_U2 = "((order_id * 7919 + trial * 104729 + order_id * trial * 31) % 10007) / 10007.0"


@query(f"""WITH {_COST}, u AS (SELECT ks.*, trial, ({_U2})::DOUBLE AS u FROM ks, (SELECT unnest(range(0, 12)) AS trial)), w AS (SELECT *, {' + '.join(f'CASE WHEN u >= {p} THEN 1.0 ELSE 0.0 END' for p in reports.POISSON)} AS c, {_OK.format('is_bps')} AS x FROM u),
 t AS (SELECT trial, sum(x * c) / sum(CASE WHEN x IS NOT NULL THEN c END) AS mean_is, sum(x * c / greatest(duration_s * 1000, 0.001)) / sum(CASE WHEN x IS NOT NULL THEN c / greatest(duration_s * 1000, 0.001) END) AS tw,
 sum(CASE WHEN cost_type = 'toxic_cost' THEN x * c END) / sum(CASE WHEN cost_type = 'toxic_cost' AND x IS NOT NULL THEN c END) AS toxic, sum(adj_bps * c) / sum(CASE WHEN adj_bps IS NOT NULL THEN c END) AS adj FROM w WHERE c > 0 GROUP BY trial),
 e AS (SELECT trial, median(x) AS med FROM (SELECT trial, x, unnest(range(0, CAST(c AS BIGINT))) FROM w WHERE c > 0 AND x IS NOT NULL) GROUP BY trial)
 SELECT trial, round(mean_is, 5) AS mean_is_bps, round(med, 5) AS median_is_bps, round(tw, 5) AS time_weighted_mean_is_bps, round(toxic, 5) AS toxic_cost_mean_bps, round(adj, 5) AS fill_adjusted_toxic_cost_mean_bps FROM t JOIN e USING (trial)""")
def bootstrap_metrics(spark, sf_dir):
    out = reports.bootstrap_metrics(_costs(spark, sf_dir), F.expr(f"({_U2})"), 12, F.col("duration_s") * 1000)
    return out.select("trial", *(rounded(c, 5).alias(c) for c in out.columns if c != "trial"))


@query("""WITH r AS (SELECT ticker, CAST(order_id % 4 AS INTEGER) AS model, round(avg(duration_s), 6) AS v FROM v_orders GROUP BY ALL), d AS (SELECT a.model AS model_a, b.model AS model_b, a.v - b.v AS x FROM r a JOIN r b ON a.ticker = b.ticker AND a.model < b.model),
 n AS (SELECT *, row_number() OVER (PARTITION BY model_a, model_b ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY model_a, model_b) AS n FROM d), f AS (SELECT model_a, model_b, n, s, sum(CASE WHEN (s >> i) & 1 = 1 THEN -x ELSE x END) AS t, sum(x) AS t0 FROM n, (SELECT unnest(range(0, 32)) AS s) GROUP BY ALL),
 p AS (SELECT model_a, model_b, CAST(n AS INTEGER) AS n, t0 / n AS observed, (count(*) FILTER (abs(t) >= abs(t0) - 1e-12) + 1) / (count(*) + 1.0) AS p_value FROM f GROUP BY model_a, model_b, n, t0),
 h AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p_value, model_a, model_b) + 1) * p_value AS a, row_number() OVER (ORDER BY p_value, model_a, model_b) AS k FROM p)
 SELECT model_a, model_b, n, round(observed, 5) AS observed, round(p_value, 6) AS p_value, round(least(1.0, max(a) OVER (ORDER BY k)), 6) AS holm_p FROM h""")
def pairwise_tests(spark, sf_dir):
    rows = adapters.orders(spark, sf_dir).groupBy("ticker", (F.col("order_id") % 4).cast("int").alias("model")).agg(rounded(F.avg("duration_s")).alias("v"))
    out = reports.pairwise_tests(rows, "ticker", "model", "v")
    return out.select("model_a", "model_b", "n", rounded("observed", 5).alias("observed"), rounded("p_value").alias("p_value"), rounded("holm_p").alias("holm_p"))


@query(f"""WITH {_LIFE}, n AS (SELECT order_id, count(*) AS looks, max(end_idx) AS last_look FROM ev LEFT JOIN cx USING (order_id) WHERE cstep IS NULL OR end_idx <= cstep GROUP BY order_id)
 SELECT lf.order_id, decision_action, reference_end_idx, CASE WHEN decision_action = 'skip' THEN 0 ELSE coalesce(looks, 0) END AS looks, CASE WHEN decision_action <> 'skip' THEN last_look END AS last_look FROM lf LEFT JOIN n USING (order_id)""")
def lifecycle_looks(spark, sf_dir):
    k = F.col("order_id")
    scored = _scored(spark, sf_dir)
    looks = scored.select("order_id", F.explode(backtest.lifecycle_steps((k % 9 + 2).cast("int"), F.lit(0), 2)).alias("end_idx"))
    out = backtest.lifecycle_diagnostics(backtest.decide(scored, backtest.Threshold(0.5, 0.3)()), looks, (k * 53 + F.col("end_idx") * 17) % 100 <= 80)
    return out.select("order_id", "decision_action", "reference_end_idx", "looks", "last_look")


@query(f"""WITH {_DEC}, r AS (SELECT dc.*, s.strategy, CASE s.strategy WHEN 'always' THEN TRUE WHEN 'threshold' THEN {_RULE} ELSE toxic <= 0.4 END AS acts FROM dc, (SELECT unnest(['always', 'threshold', 'toxic']) AS strategy) s),
 c AS (SELECT *, acts AND status_reason = 'FILLED' AS filled, ({_B} + {_A}) / 2.0::DOUBLE AS post, CASE WHEN side = 'B' THEN best_ask_at_execution - best_ask_at_entry ELSE best_bid_at_entry - best_bid_at_execution END AS missed, CASE WHEN side = 'B' THEN best_ask_at_entry ELSE best_bid_at_entry END AS basis FROM r),
 x AS (SELECT *, CASE WHEN filled THEN CASE WHEN side = 'B' THEN price - post ELSE post - price END / post ELSE missed / basis::DOUBLE END * 10000 AS bps FROM c)
 SELECT strategy, count(*) AS orders, count(*) FILTER (acts) AS submitted, count(*) FILTER (filled) AS filled, round(avg(bps), 5) AS mean_bps FROM x GROUP BY strategy""")
def strategy_sweep(spark, sf_dir):
    rules = {"always": backtest.always(), "threshold": backtest.Threshold(0.5, 0.3)(), "toxic": backtest.ToxicCif(0.4)()}
    costs = backtest.strategies(_scored(spark, sf_dir), rules, WINDOW, later_bid="best_bid_at_execution", later_ask="best_ask_at_execution")
    out = reports.summary(costs, ["strategy"])
    return out.select("strategy", "orders", "submitted", "filled", rounded("mean_bps", 5).alias("mean_bps"))


@query("""WITH n AS (SELECT order_id, row_number() OVER (ORDER BY md5('7:' || order_id), order_id) AS n, count(*) OVER () AS c FROM v_orders) SELECT order_id FROM n WHERE n <= greatest(1, CAST(floor(c * 0.1) AS BIGINT))""")
def sampled_orders(spark, sf_dir):
    return samples.sample_orders(adapters.orders(spark, sf_dir).select("order_id"), 0.1, 7)


@query("""WITH m AS (SELECT event_id AS seq, epoch_us(ts) * 1000 AS ts_event, CASE WHEN event_id % 4 < 2 THEN event_id ELSE event_id - 2 END AS order_id, event_id % 4 AS k FROM events),
 v AS (SELECT order_id AS virtual, ts_event AS entry_time, ts_event + 36000000000000 AS end_time, unnest([order_id - 1, order_id]) AS ahead FROM m WHERE k = 1)
 SELECT virtual, order_id, seq FROM v JOIN m ON m.order_id = v.ahead AND m.ts_event > entry_time AND m.ts_event <= end_time""")
def messages_ahead(spark, sf_dir):
    from tidemark.operators import flow
    from tidemark.plans.replays import messages

    rows = messages(spark, sf_dir)
    virtual = rows.filter("action = 'A' AND order_id % 4 = 1").select("instrument_id", "publisher_id", F.col("order_id").alias("virtual"), F.col("ts_event").alias("entry_time"), (F.col("ts_event") + 36_000_000_000_000).alias("end_time"), F.array(F.col("order_id") - 1, F.col("order_id")).alias("ids_ahead"))
    return flow.reaching(virtual, rows, ["instrument_id", "publisher_id"]).select("virtual", "order_id", "seq")
