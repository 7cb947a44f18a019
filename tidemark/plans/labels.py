"""Scans, markouts, labels and splits over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.names import WINDOWS_MS, post_columns
from tidemark.operators import labels, markout
from tidemark.operators.running import quantiles
from tidemark.plans import adapters
from tidemark.plans.registry import query, rounded
from tidemark.sources import files
from tidemark.storage import read

_DROP = " AND ".join(f'"{c}" IS NOT NULL' for w in WINDOWS_MS for c in post_columns(w))
_LONG = f"""long AS (SELECT order_id, window_ms, move AS markout, 10000.0::DOUBLE * move / base AS markout_bps FROM (SELECT *, sign * (post - base) + 0.0::DOUBLE AS move FROM (
 {' UNION ALL '.join(f'''SELECT order_id, {w} AS window_ms, CASE WHEN side = 'B' THEN 1 ELSE -1 END AS sign, (best_bid_at_entry + best_ask_at_entry) / 2.0::DOUBLE AS base,
 ("{post_columns(w)[0]}" + "{post_columns(w)[1]}") / 2.0::DOUBLE AS post FROM v_orders WHERE status_reason = 'FILLED' AND {_DROP}''' for w in WINDOWS_MS)})))"""
_STATS = """SELECT window_ms, count(markout_bps) AS n, round(avg(markout_bps), 6) AS mean, round(stddev_samp(markout_bps), 6) AS std,
 round(stddev_samp(markout_bps) / sqrt(count(markout_bps)), 6) AS se, round(avg(markout_bps) / (stddev_samp(markout_bps) / sqrt(count(markout_bps))), 4) AS tstat,
 round(quantile_cont(markout_bps, 0.05), 6) AS p05, round(quantile_cont(markout_bps, 0.25), 6) AS p25, round(quantile_cont(markout_bps, 0.5), 6) AS median,
 round(quantile_cont(markout_bps, 0.75), 6) AS p75, round(quantile_cont(markout_bps, 0.95), 6) AS p95,
 round(avg(CASE WHEN markout_bps < 0 THEN 1.0 WHEN markout_bps >= 0 THEN 0.0 END), 6) AS toxic_rate FROM {0} GROUP BY window_ms"""
_WINSOR = """wins AS (SELECT l.window_ms, least(greatest(markout_bps, lo), hi) AS markout_bps FROM long l JOIN
 (SELECT window_ms, quantile_cont(markout_bps, 0.01) AS lo, quantile_cont(markout_bps, 0.99) AS hi FROM long GROUP BY window_ms) q USING (window_ms))"""


def _fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.orders(spark, sf_dir).filter("status_reason = 'FILLED'")


def _rounded_stats(stats: DataFrame) -> DataFrame:
    return stats.select("window_ms", "n", *(rounded(c, 4 if c == "tstat" else 6).alias(c) for c in stats.columns[2:]))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_quantity < 24")
def scan_project_filter(spark, sf_dir):
    wanted = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_shipdate", "l_quantity", "not_there"]
    lines = files.read_columns(spark, f"{sf_dir}/lineitem.parquet", wanted).filter((F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp")) & (F.col("l_quantity") < 24))
    return lines.select("l_orderkey", "l_linenumber", rounded(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("revenue"))


@query("""SELECT 'T0' AS part, order_id, duration_s, CAST(NULL AS BIGINT) AS price FROM v_orders WHERE ticker = 'T0'
 UNION ALL SELECT 'T1', order_id, NULL, price FROM v_orders WHERE ticker = 'T1'""")
def union_by_name(spark, sf_dir):
    orders = adapters.orders(spark, sf_dir)
    a = orders.filter("ticker = 'T0'").select(F.lit("T0").alias("part"), "order_id", "duration_s")
    b = orders.filter("ticker = 'T1'").select("price", "order_id", F.lit("T1").alias("part"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT * FROM region UNION ALL BY NAME SELECT * FROM nation")
def files_by_name(spark, sf_dir):
    return files.read_union(spark, [f"{sf_dir}/{t}.parquet" for t in ("region", "nation")])


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 700 OFFSET 150")
def orders_slice(spark, sf_dir):
    return files.row_slice(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", offset=150, limit=700)


@query("SELECT status_reason, count(*) AS rows, round(count(*) * 1.0 / sum(count(*)) OVER (), 8) AS share FROM v_orders GROUP BY status_reason")
def event_distribution(spark, sf_dir):
    counts = adapters.orders(spark, sf_dir).groupBy("status_reason").agg(F.count("*").alias("rows"))
    total = counts.agg(F.sum("rows").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("status_reason", "rows", rounded(F.col("rows") / F.col("total"), 8).alias("share"))


@query("""SELECT count(*) AS n, round(avg(duration_s), 6) AS mean, round(stddev_samp(duration_s), 6) AS std, min(duration_s) AS low, max(duration_s) AS high,
 round(quantile_cont(duration_s, 0.25), 6) AS p25, round(quantile_cont(duration_s, 0.5), 6) AS p50, round(quantile_cont(duration_s, 0.75), 6) AS p75, round(quantile_cont(duration_s, 0.99), 6) AS p99 FROM v_orders""")
def duration_describe(spark, sf_dir):
    d, rows = "duration_s", adapters.orders(spark, sf_dir)
    out = rows.agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("std"), F.min(d).alias("low"), F.max(d).alias("high"))
    out = out.crossJoin(F.broadcast(quantiles(rows, [], d, [0.25, 0.5, 0.75, 0.99]).select("q")))
    return out.select("n", rounded("mean").alias("mean"), rounded("std").alias("std"), "low", "high", *(rounded(F.col("q")[k]).alias(p) for k, p in enumerate(("p25", "p50", "p75", "p99"))))


@query("""SELECT ticker, count(*) AS rows, count(*) FILTER (status_reason = 'FILLED') AS fills, round(avg(CASE WHEN status_reason = 'FILLED' THEN 1.0 ELSE 0.0 END), 8) AS fill_rate,
 round(quantile_cont(duration_s, 0.5), 6) AS median_duration FROM v_orders GROUP BY ticker""")
def ticker_fill_rate(spark, sf_dir):
    filled, rows = F.col("status_reason") == "FILLED", adapters.orders(spark, sf_dir)
    counts = rows.groupBy("ticker").agg(F.count("*").alias("rows"), F.count_if(filled).alias("fills"), rounded(F.avg(filled.cast("double")), 8).alias("fill_rate"))
    middle = quantiles(rows, ["ticker"], "duration_s", [0.5]).select("ticker", rounded(F.col("q")[0]).alias("median_duration"))
    return counts.join(F.broadcast(middle), "ticker")


@query("""SELECT status_reason, count(*) AS rows, count(*) FILTER (best_bid_at_entry IS NULL) AS no_entry, count(*) FILTER (best_bid_at_execution IS NULL) AS no_execution,
 count(*) FILTER ("post_trade_best_bid_60s" IS NULL) AS no_post FROM v_orders GROUP BY status_reason""")
def null_audit(spark, sf_dir):
    missing = {"no_entry": "best_bid_at_entry", "no_execution": "best_bid_at_execution", "no_post": "post_trade_best_bid_60s"}
    return adapters.orders(spark, sf_dir).groupBy("status_reason").agg(F.count("*").alias("rows"), *(F.count_if(F.col(c).isNull()).alias(n) for n, c in missing.items()))


@query(f"WITH {_LONG} SELECT order_id, window_ms, round(markout, 6) AS markout, round(markout_bps, 6) AS markout_bps FROM long")
def markout_long(spark, sf_dir):
    long = markout.markouts(_fills(spark, sf_dir))
    return long.select("order_id", "window_ms", rounded("markout").alias("markout"), rounded("markout_bps").alias("markout_bps"))


@query(f"WITH {_LONG} {_STATS.format('long')}")
def markout_stats(spark, sf_dir):
    return _rounded_stats(markout.statistics(markout.markouts(_fills(spark, sf_dir))))


@query(f"WITH {_LONG}, {_WINSOR} {_STATS.format('wins')}")
def markout_winsor_stats(spark, sf_dir):
    return _rounded_stats(markout.statistics(markout.winsorize(markout.markouts(_fills(spark, sf_dir)))))


_SELECT = """stats AS (SELECT window_ms, avg(markout_bps) AS mean FROM wins GROUP BY window_ms), lr AS (SELECT arg_max(mean, window_ms) AS long_run_mean FROM stats),
 chosen AS (SELECT min(CASE WHEN abs(mean) >= abs(long_run_mean) * 0.9 AND sign(mean) = sign(long_run_mean) AND abs(long_run_mean) >= 1e-12 THEN window_ms END) AS selected_window_ms, first(long_run_mean) AS long_run_mean FROM stats, lr)"""


@query(f"WITH {_LONG}, {_WINSOR}, {_SELECT} SELECT selected_window_ms, round(long_run_mean, 6) AS long_run_mean FROM chosen")
def window_select(spark, sf_dir):
    chosen = markout.settled_window(markout.statistics(markout.winsorize(markout.markouts(_fills(spark, sf_dir)))))
    return chosen.select("selected_window_ms", rounded("long_run_mean").alias("long_run_mean"))


LABEL_WINDOW = 1000
_B, _A = (f'"{c}"' for c in post_columns(LABEL_WINDOW))
LABELLED_SQL = f"""lab0 AS (SELECT *, CASE WHEN status_reason <> 'FILLED' OR price IS NULL OR best_bid_at_entry IS NULL OR best_ask_at_entry IS NULL THEN NULL
 WHEN best_bid_at_execution IS NOT NULL AND best_ask_at_execution IS NOT NULL THEN 'execution' WHEN duration_s < 0.1 THEN 'entry' END AS spread_source, ({_B} + {_A}) / 2.0::DOUBLE AS post FROM v_orders),
 lab1 AS (SELECT *, CASE spread_source WHEN 'execution' THEN (best_bid_at_execution + best_ask_at_execution) / 2.0::DOUBLE WHEN 'entry' THEN (best_bid_at_entry + best_ask_at_entry) / 2.0::DOUBLE END AS base,
 CASE spread_source WHEN 'execution' THEN (best_ask_at_execution - best_bid_at_execution) / 2.0::DOUBLE WHEN 'entry' THEN (best_ask_at_entry - best_bid_at_entry) / 2.0::DOUBLE END AS half FROM lab0),
 lab2 AS (SELECT *, half / base * 10000 AS spread_threshold_bps, (CASE WHEN side = 'B' THEN 1 ELSE -1 END) * (price - post) / base * 10000 AS move FROM lab1),
 lab AS (SELECT *, CASE WHEN status_reason = 'FILLED' THEN coalesce(move IS NOT NULL AND spread_threshold_bps IS NOT NULL, FALSE) END AS labeling_valid,
 CASE WHEN status_reason = 'FILLED' AND move IS NOT NULL AND spread_threshold_bps IS NOT NULL THEN CASE WHEN move < spread_threshold_bps THEN 1 ELSE 2 END ELSE 0 END AS event_type FROM lab2)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label(adapters.orders(spark, sf_dir), LABEL_WINDOW)


@query(f"""WITH {LABELLED_SQL} SELECT order_id, event_type, labeling_valid, spread_source, round(spread_threshold_bps, 6) AS spread_threshold_bps,
 round(move, 6) AS post_trade_adverse_move_bps FROM lab""")
def label_competing_risks(spark, sf_dir):
    return labelled(spark, sf_dir).select("order_id", "event_type", "labeling_valid", "spread_source", rounded("spread_threshold_bps").alias("spread_threshold_bps"), rounded("post_trade_adverse_move_bps").alias("post_trade_adverse_move_bps"))


@query(f"WITH {LABELLED_SQL} SELECT event_type, labeling_valid, count(*) AS rows FROM lab GROUP BY event_type, labeling_valid")
def label_distribution(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy("event_type", "labeling_valid").agg(F.count("*").alias("rows"))


@query(f"WITH {LABELLED_SQL} SELECT ticker, count(*) FILTER (event_type > 0) AS fills, round(avg(CASE WHEN event_type = 2 THEN 1.0 WHEN event_type = 1 THEN 0.0 END), 8) AS toxic_share FROM lab GROUP BY ticker")
def toxic_share_by_ticker(spark, sf_dir):
    toxic = F.when(F.col("event_type") == 2, 1.0).when(F.col("event_type") == 1, 0.0)
    return labelled(spark, sf_dir).groupBy("ticker").agg(F.count_if(F.col("event_type") > 0).alias("fills"), rounded(F.avg(toxic), 8).alias("toxic_share"))


CUTS_SQL = """days AS (SELECT day, sum(count(*)) OVER (ORDER BY day) AS rows, row_number() OVER (ORDER BY day) AS number FROM v_orders GROUP BY day),
 tot AS (SELECT max(rows) AS total, max(number) AS days FROM days),
 pick AS (SELECT arg_min(number, (abs(rows - total * 0.70), number)) AS a, arg_min(number, (abs(rows - total * 0.85), number)) AS b, max(days) AS n FROM days, tot),
 fixed AS (SELECT least(greatest(a, 1), n - 2) AS a, b, n FROM pick), cutn AS (SELECT a, least(greatest(b, a + 1), n - 1) AS b FROM fixed WHERE n >= 3),
 cuts AS (SELECT max(CASE WHEN number = a THEN day END) AS train_last, max(CASE WHEN number = b THEN day END) AS validation_last FROM days, cutn)"""


@query(f"WITH {CUTS_SQL} SELECT CAST(train_last AS VARCHAR) AS train_last, CAST(validation_last AS VARCHAR) AS validation_last FROM cuts")
def day_split_cut(spark, sf_dir):
    return labels.day_cuts(adapters.orders(spark, sf_dir)).select(F.col("train_last").cast("string"), F.col("validation_last").cast("string"))


@query(f"""WITH {CUTS_SQL} SELECT CASE WHEN day <= train_last THEN 'train' WHEN day <= validation_last THEN 'val' ELSE 'test' END AS dataset_split, count(*) AS rows, count(DISTINCT day) AS days
 FROM v_orders, cuts GROUP BY 1""")
def day_split_counts(spark, sf_dir):
    orders = adapters.orders(spark, sf_dir)
    return labels.split_days(orders, labels.day_cuts(orders)).groupBy("dataset_split").agg(F.count("*").alias("rows"), F.count_distinct("day").alias("days"))


@query(f"WITH {CUTS_SQL} SELECT round(quantile_cont(duration_s, 0.95), 6) AS horizon_s FROM v_orders, cuts WHERE day <= train_last AND status_reason = 'FILLED'")
def horizon_p95(spark, sf_dir):
    orders = adapters.orders(spark, sf_dir)
    train = labels.split_days(orders, labels.day_cuts(orders)).filter("dataset_split = 'train' and status_reason = 'FILLED'")
    return labels.horizon(train).select(rounded("horizon_s").alias("horizon_s"))


@query(f"WITH {LABELLED_SQL} SELECT order_id, least(duration_s, 60.0) AS duration_s, CASE WHEN duration_s > 60 THEN 0 ELSE event_type END AS event_type FROM lab")
def recensor(spark, sf_dir):
    duration, event = labels.recensor(F.col("duration_s"), F.col("event_type"), F.lit(60.0))
    return labelled(spark, sf_dir).select("order_id", duration.alias("duration_s"), event.alias("event_type"))


@query("""SELECT CASE WHEN duration_s >= 0 AND duration_s <= 1 THEN '0-1' WHEN duration_s > 1 AND duration_s <= 5 THEN '1-5' WHEN duration_s > 5 AND duration_s <= 15 THEN '5-15'
 WHEN duration_s > 15 AND duration_s <= 60 THEN '15-60' END AS lead, count(*) AS rows FROM v_orders GROUP BY 1""")
def lead_time_bins(spark, sf_dir):
    return adapters.orders(spark, sf_dir).groupBy(labels.lead_time(F.col("duration_s")).alias("lead")).agg(F.count("*").alias("rows"))


_TRAIN = f"{CUTS_SQL}, tr AS (SELECT v_orders.* FROM v_orders, cuts WHERE day <= train_last)"
_CHOSEN = " ".join(f'WHEN {w} THEN ("{post_columns(w)[0]}" + "{post_columns(w)[1]}") / 2.0::DOUBLE' for w in WINDOWS_MS)


@query(f"""WITH {_TRAIN}, {_LONG.replace('v_orders', 'tr')}, {_WINSOR}, {_SELECT}, {LABELLED_SQL.replace(f'({_B} + {_A}) / 2.0::DOUBLE AS post FROM v_orders', f'CASE selected_window_ms {_CHOSEN} END AS post FROM v_orders, chosen')}
 SELECT order_id, event_type, labeling_valid, CASE WHEN day <= train_last THEN 'train' WHEN day <= validation_last THEN 'val' ELSE 'test' END AS dataset_split FROM lab, cuts""")
def label_calibrated(spark, sf_dir):
    orders = adapters.orders(spark, sf_dir).withColumns({c: F.lit(None).cast("long") for c in ("best_bid_at_post_trade", "best_ask_at_post_trade")})
    return labels.label_calibrated(orders).select("order_id", "event_type", "labeling_valid", "dataset_split")
