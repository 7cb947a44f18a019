"""Policies, costs, reports and tests over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.names import post_columns
from tidemark.operators import backtest, reports
from tidemark.plans import adapters
from tidemark.plans.registry import query, rounded
from tidemark.storage import read

WINDOW = 1000
_DEC = "dc AS (SELECT *, (order_id * 29 % 100) / 100.0::DOUBLE AS favorable, (order_id * 53 % 100) / 100.0::DOUBLE AS toxic FROM v_orders)"
_B, _A = (f'"{c}"' for c in post_columns(WINDOW))


def _scored(spark, sf_dir):
    k = F.col("order_id")
    return adapters.orders(spark, sf_dir).withColumns({"favorable": (k * 29 % 100) / 100.0, "toxic": (k * 53 % 100) / 100.0})


_RULE = "coalesce(toxic / nullif(favorable + toxic, 0), 0) <= 0.5 AND favorable + toxic >= 0.3"


@query(f"WITH {_DEC} SELECT order_id, CASE WHEN {_RULE} THEN 'submit' ELSE 'skip' END AS decision_action FROM dc")
def threshold_decision(spark, sf_dir):
    return backtest.decide(_scored(spark, sf_dir), backtest.Threshold(0.5, 0.3)()).select("order_id", "decision_action")


@query(f"WITH {_DEC} SELECT ticker, count(*) FILTER (toxic <= 0.4) AS submits, count(*) FILTER (toxic > 0.4) AS skips FROM dc GROUP BY ticker")
def toxic_cif_decision(spark, sf_dir):
    decided = backtest.decide(_scored(spark, sf_dir), backtest.ToxicCif(0.4)())
    return decided.groupBy("ticker").agg(F.count_if(F.col("decision_action") == "submit").alias("submits"), F.count_if(F.col("decision_action") == "skip").alias("skips"))


_LIFE = f"""{_DEC}, ev AS (SELECT order_id, CAST(unnest(range(2, 2 + order_id % 9, 2)) AS INTEGER) AS end_idx FROM dc), cx AS (SELECT order_id, min(end_idx) AS cstep FROM ev WHERE (order_id * 53 + end_idx * 17) % 100 > 80 GROUP BY order_id),
 lf AS (SELECT dc.*, CASE WHEN {_RULE} THEN CASE WHEN cstep IS NOT NULL THEN 'cancel' ELSE 'submit' END ELSE 'skip' END AS decision_action, CASE WHEN {_RULE} THEN cstep END AS reference_end_idx FROM dc LEFT JOIN cx USING (order_id))"""


def _lifecycle(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    steps = (F.col("order_id") % 9 + 2).cast("int")
    looks = scored.select("order_id", F.explode(backtest.lifecycle_steps(steps, F.lit(0), 2)).alias("end_idx"))
    toxic = (F.col("order_id") * 53 + F.col("end_idx") * 17) % 100
    return backtest.first_cancel(backtest.decide(scored, backtest.Threshold(0.5, 0.3)()), looks, toxic <= 80)


@query(f"WITH {_LIFE} SELECT order_id, decision_action, reference_end_idx FROM lf")
def lifecycle_first_cancel(spark, sf_dir):
    return _lifecycle(spark, sf_dir).select("order_id", "decision_action", "reference_end_idx")


_COST = f"""{_LIFE}, k0 AS (SELECT *, status_reason = 'FILLED' AS actual, decision_action <> 'skip' AS submitted, decision_action = 'cancel' AS canceled, decision_action = 'submit' AND status_reason = 'FILLED' AS filled,
 ({_B} + {_A}) / 2.0::DOUBLE AS post FROM lf), k1 AS (SELECT *, CASE WHEN side = 'B' THEN price - post ELSE post - price END AS toxic_raw,
 CASE WHEN side = 'B' THEN best_ask_at_execution - best_ask_at_entry ELSE best_bid_at_entry - best_bid_at_execution END AS missed, CASE WHEN side = 'B' THEN best_ask_at_entry ELSE best_bid_at_entry END AS basis FROM k0),
 ks AS (SELECT *, CASE WHEN filled THEN CASE WHEN post IS NULL THEN 'missing_reference_mid' END WHEN basis IS NULL THEN CASE WHEN side = 'B' THEN 'missing_entry_ask' ELSE 'missing_entry_bid' END
 WHEN missed IS NULL THEN CASE WHEN side = 'B' THEN 'missing_reference_ask' ELSE 'missing_reference_bid' END END AS missing_reason, CASE WHEN filled THEN 'toxic_cost' ELSE 'opportunity_cost' END AS cost_type,
 CASE WHEN filled THEN toxic_raw ELSE missed END AS is_raw, CASE WHEN filled THEN toxic_raw / post ELSE missed / basis::DOUBLE END * 10000 AS is_bps,
 CASE WHEN filled THEN 'realized_toxic_cost' WHEN actual THEN 'flipped_counterfactual_toxic_cost' ELSE 'unfilled_zero' END AS component,
 CASE WHEN filled THEN toxic_raw / post * 10000 WHEN actual THEN -(toxic_raw / post * 10000) ELSE 0 END AS adj_bps FROM k1)"""


def _costs(spark, sf_dir):
    return backtest.shortfall(_lifecycle(spark, sf_dir), WINDOW, later_bid="best_bid_at_execution", later_ask="best_ask_at_execution")


@query(f"WITH {_COST} SELECT order_id, cost_type, CASE WHEN missing_reason IS NULL THEN 'ok' ELSE 'failed' END AS metric_status, missing_reason, round(CASE WHEN missing_reason IS NULL THEN is_bps END, 6) AS implementation_shortfall_bps FROM ks")
def implementation_shortfall(spark, sf_dir):
    return _costs(spark, sf_dir).select("order_id", "cost_type", "metric_status", "missing_reason", rounded("implementation_shortfall_bps").alias("implementation_shortfall_bps"))


@query(f"WITH {_COST} SELECT missing_reason, side, count(*) AS rows, CAST(sum(CASE WHEN missing_reason IS NULL THEN is_raw END) AS DOUBLE) AS raw FROM ks WHERE cost_type = 'opportunity_cost' GROUP BY missing_reason, side")
def opportunity_cost(spark, sf_dir):
    rows = _costs(spark, sf_dir).filter("cost_type = 'opportunity_cost'")
    return rows.groupBy("missing_reason", "side").agg(F.count("*").alias("rows"), F.sum("implementation_shortfall_raw").alias("raw"))


@query(f"WITH {_COST} SELECT component, count(*) AS rows, round(avg(adj_bps), 6) AS mean_bps, count(*) FILTER (adj_bps > 0) AS costs, count(*) FILTER (adj_bps < 0) AS savings, count(*) FILTER (adj_bps IS NULL) AS unknown FROM ks GROUP BY component")
def fill_adjusted_cost(spark, sf_dir):
    bps = F.col("fill_adjusted_toxic_cost_bps")
    rows = _costs(spark, sf_dir).groupBy(F.col("fill_adjusted_toxic_cost_component").alias("component"))
    return rows.agg(F.count("*").alias("rows"), rounded(F.avg(bps)).alias("mean_bps"), F.count_if(bps > 0).alias("costs"), F.count_if(bps < 0).alias("savings"), F.count_if(bps.isNull()).alias("unknown"))


_OK = "CASE WHEN missing_reason IS NULL THEN {} END"


@query(f"""WITH {_COST} SELECT ticker, count(*) AS orders, count(*) FILTER (submitted) AS submitted, count(*) FILTER (filled) AS filled, count(*) FILTER (canceled) AS canceled, count(*) FILTER (missing_reason IS NOT NULL) AS failed,
 round(count(*) FILTER (filled) / count(*) FILTER (submitted), 6) AS fill_rate, round(avg({_OK.format('is_bps')}), 6) AS mean_bps, round(median({_OK.format('is_bps')}), 6) AS median_bps,
 CAST(sum({_OK.format('is_raw')}) AS DOUBLE) AS total_raw, round(avg(adj_bps), 6) AS adjusted_mean_bps, count(*) FILTER (adj_bps > 0) AS adjusted_costs, count(*) FILTER (adj_bps < 0) AS adjusted_savings FROM ks GROUP BY ticker""")
def backtest_summary(spark, sf_dir):
    out = reports.summary(_costs(spark, sf_dir), ["ticker"])
    return out.withColumns({c: rounded(c) for c in ("fill_rate", "mean_bps", "median_bps", "adjusted_mean_bps")})


@query(f"""WITH {_COST}, w AS (SELECT cost_type, 1.0 / greatest(duration_s * 1000, 0.001) AS w, is_bps AS x FROM ks WHERE missing_reason IS NULL AND is_bps IS NOT NULL)
 SELECT cost_type, round(sum(w) / (SELECT sum(w) FROM w), 6) AS weight, round(sum(w * x) / sum(w), 6) AS weighted_mean FROM w GROUP BY cost_type""")
def time_weighted_is(spark, sf_dir):
    out = reports.time_weighted(_costs(spark, sf_dir), F.col("duration_s") * 1000, by="cost_type")
    return out.select("cost_type", rounded("weight").alias("weight"), rounded("weighted_mean").alias("weighted_mean"))


_LIMITS, _HORIZONS = [k / 10 for k in range(1, 11)], [0, 1, 2]
_GRID = f"""{_DEC}, gr AS (SELECT max_toxic, h, count(*) FILTER (status_reason = 'FILLED') AS fills, avg(CASE WHEN status_reason = 'FILLED' THEN CASE WHEN side = 'B' THEN price - ({_B} + {_A}) / 2.0::DOUBLE ELSE ({_B} + {_A}) / 2.0::DOUBLE - price END END) AS cost
 FROM dc, (SELECT unnest({_LIMITS})::DOUBLE AS max_toxic), (SELECT unnest({_HORIZONS}) AS h) WHERE ((order_id * 53 + h * 7) % 100) / 100.0::DOUBLE <= max_toxic GROUP BY max_toxic, h),
 g1 AS (SELECT max_toxic, h, fills, round(cost, 6) AS cost, fills >= 400 AND cost IS NOT NULL AS feasible FROM gr), bt AS (SELECT min(cost) AS best FROM g1 WHERE feasible), g2 AS (SELECT g1.*, feasible AND cost <= best + 0.3 AS near_best FROM g1, bt)"""


def _grid(spark, sf_dir):
    """Every setting of the grid in one job: settings are broadcast, orders are read once."""
    settings = spark.createDataFrame([(t, h) for t in _LIMITS for h in _HORIZONS], "max_toxic double, h int")
    toxic = ((F.col("order_id") * 53 + F.col("h") * 7) % 100) / 100.0
    after = (F.col(f"`{post_columns(WINDOW)[0]}`") + F.col(f"`{post_columns(WINDOW)[1]}`")) / 2.0
    filled = F.col("status_reason") == "FILLED"
    rows = _scored(spark, sf_dir).select("order_id", filled.alias("filled"), F.when(filled, backtest.side_cost(F.col("side"), F.col("price"), after)).alias("cost"))
    taken = rows.join(F.broadcast(settings), toxic <= F.col("max_toxic"))
    return taken.groupBy("max_toxic", "h").agg(F.count_if("filled").alias("fills"), rounded(F.avg("cost")).alias("cost"))


def _ranked(spark, sf_dir):
    return reports.ranked(_grid(spark, sf_dir), cost="cost", fills="fills", least_fills=400, band=0.3, keys=["max_toxic", "h"])


@query(f"""WITH {_GRID} SELECT max_toxic, h, fills, cost, feasible, row_number() OVER (ORDER BY cost NULLS LAST, max_toxic, h) AS rank_all,
 CASE WHEN feasible THEN row_number() OVER (PARTITION BY feasible ORDER BY cost NULLS LAST, max_toxic, h) END AS rank_feasible,
 CASE WHEN near_best THEN row_number() OVER (PARTITION BY near_best ORDER BY fills DESC, cost NULLS LAST, max_toxic, h) END AS rank_near_best FROM g2""")
def grid_search_rank(spark, sf_dir):
    return _ranked(spark, sf_dir).drop("near_best")


@query(f"WITH {_GRID} SELECT h, max_toxic, cost FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY cost, max_toxic) AS n FROM g2 WHERE feasible) WHERE n = 1")
def best_by_horizon(spark, sf_dir):
    return reports.best_by(_ranked(spark, sf_dir).filter("feasible"), ["h"], [F.col("cost"), F.col("max_toxic")]).select("h", "max_toxic", "cost")


@query(f"""WITH {_GRID} SELECT threshold, round(min(cost), 6) AS best_cost, round((SELECT min(cost) FROM g2 WHERE max_toxic = 1.0) - min(cost), 6) AS improvement
 FROM g2 JOIN (SELECT unnest({[k / 10 for k in range(2, 10)]})::DOUBLE AS threshold) t ON max_toxic <= threshold WHERE feasible GROUP BY threshold""")
def improvement_curve(spark, sf_dir):
    out = reports.improvement(_ranked(spark, sf_dir), limit="max_toxic", cost="cost", thresholds=[k / 10 for k in range(2, 10)], baseline=1.0)
    return out.select("threshold", rounded("best_cost").alias("best_cost"), rounded("improvement").alias("improvement"))


@query("""WITH m AS (SELECT ticker, (order_id % 4)::DOUBLE AS latency_ms, avg(duration_s) AS v FROM v_orders GROUP BY ALL)
 SELECT m.ticker, m.latency_ms, round(m.v, 6) AS v, round(m.v - b.v, 6) AS delta FROM m JOIN m b ON b.ticker = m.ticker AND b.latency_ms = 0""")
def latency_delta(spark, sf_dir):
    metrics = adapters.orders(spark, sf_dir).groupBy("ticker", (F.col("order_id") % 4).cast("double").alias("latency_ms")).agg(F.avg("duration_s").alias("v"))
    return reports.against_baseline(metrics, ["ticker"], "latency_ms", "v").select("ticker", "latency_ms", rounded("v").alias("v"), rounded("delta").alias("delta"))


_U = "((order_id * 7919 + trial * 104729 + order_id * trial * 31) % 10007) / 10007.0"


@query(f"""WITH u AS (SELECT trial, duration_s AS x, {_U}::DOUBLE AS u FROM v_orders, (SELECT unnest(range(0, 40)) AS trial)),
 w AS (SELECT trial, x, {' + '.join(f'CASE WHEN u >= {p} THEN 1.0 ELSE 0.0 END' for p in reports.POISSON)} AS w FROM u), m AS (SELECT trial, sum(x * w) / sum(w) AS mean FROM w GROUP BY trial)
 SELECT round(avg(mean), 6) AS estimate, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m""")
def bootstrap_ci(spark, sf_dir):
    trials = reports.poisson_bootstrap(adapters.orders(spark, sf_dir), "duration_s", F.expr(f"({_U})"), 40)
    return reports.interval(trials).select(*(rounded(c).alias(c) for c in ("estimate", "low", "high")))


_DIFF = "df AS (SELECT ticker, avg(duration_s) FILTER (side = 'B') - avg(duration_s) FILTER (side = 'A') AS difference FROM v_orders GROUP BY ticker)"


def _differences(spark, sf_dir):
    side = F.col("side")
    by = adapters.orders(spark, sf_dir).groupBy("ticker")
    return by.agg((F.avg(F.when(side == "B", F.col("duration_s"))) - F.avg(F.when(side == "A", F.col("duration_s")))).alias("difference"))


@query(f"""WITH {_DIFF}, n AS (SELECT *, row_number() OVER (ORDER BY difference) - 1 AS i FROM df), s AS (SELECT unnest(range(0, 32)) AS s),
 f AS (SELECT s, sum(CASE WHEN (s >> i) & 1 = 1 THEN -difference ELSE difference END) AS t FROM s, n GROUP BY s), o AS (SELECT count(*) AS n, sum(difference) AS t0 FROM df)
 SELECT CAST(n AS INTEGER) AS n, round(t0 / n, 6) AS observed, round((count(*) FILTER (abs(t) >= abs(t0) - 1e-12) + 1) / (count(*) + 1.0), 6) AS p_value FROM f, o GROUP BY n, t0""")
def sign_flip_p(spark, sf_dir):
    return reports.sign_flip(_differences(spark, sf_dir)).select("n", rounded("observed").alias("observed"), rounded("p_value").alias("p_value"))


@query("""WITH t AS (SELECT ticker AS name, round(((sum(order_id) * 37) % 997) / 9970.0, 6) AS p_value FROM v_orders GROUP BY ticker), r AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p_value, name) + 1) * p_value AS a, row_number() OVER (ORDER BY p_value, name) AS k FROM t)
 SELECT name, p_value, round(least(1.0, max(a) OVER (ORDER BY k)), 6) AS holm_p FROM r""")
def holm_adjust(spark, sf_dir):
    tests = adapters.orders(spark, sf_dir).groupBy(F.col("ticker").alias("name")).agg(rounded(((F.sum("order_id") * 37) % 997) / 9970.0).alias("p_value"))
    return reports.holm(tests).withColumn("holm_p", rounded("holm_p"))


@query("""SELECT ticker, round(avg(duration_s) FILTER (status_reason = 'FILLED'), 6) AS "FILLED", round(avg(duration_s) FILTER (status_reason = 'CENSORED_TIME'), 6) AS "CENSORED_TIME",
 round(avg(duration_s) FILTER (status_reason = 'CENSORED_END'), 6) AS "CENSORED_END" FROM v_orders GROUP BY ticker""")
def pivot_matrix(spark, sf_dir):
    kinds = ["FILLED", "CENSORED_TIME", "CENSORED_END"]
    return adapters.orders(spark, sf_dir).groupBy("ticker").pivot("status_reason", kinds).agg(rounded(F.avg("duration_s")))


_KNOWN = "(best_bid_at_entry IS NOT NULL)::INT + (best_bid_at_execution IS NOT NULL)::INT"


@query(f"SELECT day, ticker, order_id FROM (SELECT CAST(day AS VARCHAR) AS day, ticker, order_id, row_number() OVER (PARTITION BY day, ticker ORDER BY {_KNOWN} DESC, order_id) AS n FROM v_orders) WHERE n = 1")
def dedup_best(spark, sf_dir):
    out = reports.most_complete(adapters.orders(spark, sf_dir), ["day", "ticker"], ["best_bid_at_entry", "best_bid_at_execution"], ["order_id"])
    return out.select(F.col("day").cast("string").alias("day"), "ticker", "order_id")


@query("SELECT side, count(*) AS rows, count(DISTINCT ticker) AS distinct_ticker, count(DISTINCT day) AS distinct_day, count(best_bid_at_execution) AS known_best_bid_at_execution FROM v_orders GROUP BY side")
def coverage_counts(spark, sf_dir):
    return reports.coverage(adapters.orders(spark, sf_dir), ["side"], ["ticker", "day"], ["best_bid_at_execution"])


@query("SELECT CAST(price // 5000000 AS BIGINT) AS bucket, count(*) AS rows, round(count(*) * 1.0 / sum(count(*)) OVER (), 8) AS ratio FROM v_orders GROUP BY 1")
def param_buckets(spark, sf_dir):
    counts = adapters.orders(spark, sf_dir).groupBy(F.floor(F.col("price") / 5_000_000).alias("bucket")).agg(F.count("*").alias("rows"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("rows").alias("t")))).select("bucket", "rows", rounded(F.col("rows") / F.col("t"), 8).alias("ratio"))


@query("WITH b AS (SELECT unnest([10000000, 20000000, 30000000]) AS budget) SELECT budget, arg_min(order_id, (abs(price - budget), order_id)) AS order_id FROM v_orders, b GROUP BY budget")
def closest_config(spark, sf_dir):
    budgets = spark.createDataFrame([(10_000_000,), (20_000_000,), (30_000_000,)], "budget long")
    rows = adapters.orders(spark, sf_dir).crossJoin(F.broadcast(budgets))
    return rows.groupBy("budget").agg(F.min_by("order_id", F.struct(F.abs(F.col("price") - F.col("budget")), "order_id")).alias("order_id"))


@query("""WITH b AS (SELECT ticker, day, arg_max(price, order_id)::DOUBLE AS close, min(price) AS low, max(price) AS high FROM v_orders GROUP BY ALL), r AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY day)) AS r FROM b)
 SELECT ticker, min(low) AS low, max(high) AS high, round(avg(close), 4) AS mean_close, round(stddev_samp(r) * sqrt(252.0), 6) AS volatility, round((max(high) / min(low) - 1) * 100, 4) AS range_pct FROM r GROUP BY ticker""")
def annualized_vol(spark, sf_dir):
    bars = adapters.orders(spark, sf_dir).groupBy("ticker", "day").agg(F.max_by("price", "order_id").cast("double").alias("close"), F.min("price").alias("low"), F.max("price").alias("high"))
    out = reports.annualized_volatility(bars)
    return out.select("ticker", "low", "high", rounded("mean_close", 4).alias("mean_close"), rounded("volatility").alias("volatility"), rounded("range_pct", 4).alias("range_pct"))


@query("""WITH g AS (SELECT ticker, side, CAST(order_id % 7 AS INTEGER) AS config, round(avg(duration_s), 6) AS mean, count(*) AS runs FROM v_orders GROUP BY ALL)
 SELECT ticker, side, config, mean, runs FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY mean DESC, side, config) AS n FROM g) WHERE n = 1""")
def grid_rollup_best(spark, sf_dir):
    rolled = adapters.orders(spark, sf_dir).groupBy("ticker", "side", (F.col("order_id") % 7).cast("int").alias("config")).agg(rounded(F.avg("duration_s")).alias("mean"), F.count("*").alias("runs"))
    return reports.best_by(rolled, ["ticker"], [F.desc("mean"), F.col("side"), F.col("config")])


@query("""WITH a AS (SELECT CAST(l_linenumber AS INTEGER) AS feature, round(avg(l_discount), 8) AS importance, count(DISTINCT l_returnflag) AS models FROM lineitem GROUP BY 1)
 SELECT feature, importance, models, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM a""")
def ablation_rollup(spark, sf_dir):
    from pyspark.sql import Window

    by = read(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("feature")).agg(rounded(F.avg("l_discount"), 8).alias("importance"), F.count_distinct("l_returnflag").alias("models"))
    return by.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))


@query("""SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90,
 round(avg(user_id % 8 + 1) * 1000 / avg(value), 4) AS samples_per_s FROM events GROUP BY event_type""")
def timing_summary(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("batch", F.col("user_id") % 8 + 1)
    out = reports.timing(rows, ["event_type"], "value")
    return out.select("event_type", *(rounded(c).alias(c) for c in ("mean", "std", "p50", "p90")), rounded("samples_per_s", 4).alias("samples_per_s"))


@query("""WITH m AS (SELECT ticker, avg(duration_s) AS mean, stddev_samp(duration_s) AS std, count(duration_s) AS n FROM v_orders GROUP BY ticker)
 SELECT ticker, round(mean, 6) AS mean, round(std, 6) AS std, n, round(std / sqrt(n), 6) AS sem, round(mean - 1.96 * std / sqrt(n), 6) AS low, round(mean + 1.96 * std / sqrt(n), 6) AS high FROM m""")
def strategy_interval(spark, sf_dir):
    return reports.mean_interval(adapters.orders(spark, sf_dir), ["ticker"], "duration_s").select("ticker", "n", *(rounded(c).alias(c) for c in ("mean", "std", "sem", "low", "high")))


@query("""WITH r AS (SELECT ticker, CAST(order_id % 4 AS INTEGER) AS model, round(avg(duration_s), 6) AS v FROM v_orders GROUP BY ALL)
 SELECT a.model AS model_a, b.model AS model_b, count(*) AS n, round(avg(a.v - b.v), 5) AS mean_difference, count(*) FILTER (a.v > b.v) AS wins FROM r a JOIN r b ON a.ticker = b.ticker AND a.model < b.model GROUP BY a.model, b.model""")
def pairwise_models(spark, sf_dir):
    rows = adapters.orders(spark, sf_dir).groupBy("ticker", (F.col("order_id") % 4).cast("int").alias("model")).agg(rounded(F.avg("duration_s")).alias("v"))
    return reports.pairwise(rows, "ticker", "model", "v").withColumn("mean_difference", rounded("mean_difference", 5))
