"""Samples, windows, losses and metrics over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import book
from tidemark.operators import backtest, samples, survival
from tidemark.plans import adapters
from tidemark.plans.registry import query, rounded

T = adapters.BINS
_SEQ = "sq AS (SELECT o_orderkey AS order_id, o_orderkey AS source_row, CAST(1 + o_orderkey % 9 AS INTEGER) AS steps, (o_orderkey * 37 % 100000) / 1000.0::DOUBLE AS duration_s, CAST(o_orderkey % 3 AS INTEGER) AS event_type FROM orders)"
_LOOK, _LIMIT, _MOST = 3, 60.0, 4


def _sequences(spark, sf_dir):
    """Orders with 1 to 9 steps, whose log gaps derive from key and step."""
    orders = adapters.read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    gaps = F.transform(F.sequence(F.lit(0), (k % 9).cast("int")), lambda i: F.log1p(((k + i * 13) % 500).cast("double")))
    return orders.select(k.alias("order_id"), k.alias("source_row"), ((k * 37 % 100_000) / 1000.0).alias("duration_s"), (k % 3).cast("int").alias("event_type"), gaps.alias("gap_logs"))


_MAN = f"""{_SEQ}, st AS (SELECT *, unnest(range(0, steps)) AS i FROM sq), el AS (SELECT *, sum(((order_id + i * 13) % 500) / 1000.0::DOUBLE) OVER (PARTITION BY order_id ORDER BY i) AS e, least({_LOOK}, steps) - 1 AS a FROM st),
 an AS (SELECT order_id, e AS e0 FROM el WHERE i = a),
 man AS (SELECT el.order_id, source_row, CAST(i - a AS INTEGER) AS update_idx, CAST(i AS INTEGER) AS end_idx, steps - a AS n, greatest(duration_s - (e - e0), 0.0) AS remaining_s, event_type FROM el JOIN an USING (order_id) WHERE i >= a)"""


@query(f"WITH {_MAN} SELECT order_id, update_idx, end_idx, round(remaining_s, 6) AS remaining_s, event_type FROM man")
def manifest_expand(spark, sf_dir):
    return samples.manifest(_sequences(spark, sf_dir), lookback=_LOOK).select("order_id", "update_idx", "end_idx", rounded("remaining_s").alias("remaining_s"), "event_type")


@query(f"WITH {_MAN} SELECT order_id, update_idx, round(least(remaining_s, {_LIMIT}), 6) AS remaining_s, CASE WHEN event_type > 0 AND remaining_s <= {_LIMIT} THEN event_type ELSE 0 END AS event_type FROM man")
def admin_censor(spark, sf_dir):
    return samples.manifest(_sequences(spark, sf_dir), lookback=_LOOK, censor_s=_LIMIT).select("order_id", "update_idx", rounded("remaining_s").alias("remaining_s"), "event_type")


@query(f"""WITH {_MAN}, w AS (SELECT DISTINCT order_id, n, CAST(round_even(j * (n - 1) / {_MOST - 1}.0::DOUBLE, 0) AS INTEGER) AS update_idx FROM man, (SELECT unnest(range(0, {_MOST})) AS j) WHERE n > {_MOST})
 SELECT order_id, update_idx FROM w UNION ALL SELECT order_id, update_idx FROM man WHERE n <= {_MOST}""")
def capped_indices(spark, sf_dir):
    return samples.manifest(_sequences(spark, sf_dir), lookback=_LOOK, most=_MOST).select("order_id", "update_idx")


@query(f"""WITH {_MAN} SELECT CAST(sum(c) AS BIGINT) AS samples, min(c) AS low, quantile_cont(c, 0.5) AS p50, quantile_cont(c, 0.9) AS p90, max(c) AS high
 FROM (SELECT order_id, count(*) AS c FROM man GROUP BY order_id)""")
def manifest_counts(spark, sf_dir):
    per = samples.manifest(_sequences(spark, sf_dir), lookback=_LOOK).groupBy("order_id").agg(F.count("*").alias("c"))
    return per.agg(F.sum("c").alias("samples"), F.min("c").alias("low"), F.percentile("c", 0.5).alias("p50"), F.percentile("c", 0.9).alias("p90"), F.max("c").alias("high"))


@query(f"WITH {_MAN} SELECT order_id, update_idx, round(1.0 / count(*) OVER (PARTITION BY order_id), 8) AS weight, round((1.0 / count(*) OVER (PARTITION BY order_id)) / (SELECT count(DISTINCT order_id) * 1.0 / count(*) FROM man), 8) AS weight_mean_one FROM man")
def order_weights(spark, sf_dir):
    out = samples.order_weights(samples.manifest(_sequences(spark, sf_dir), lookback=_LOOK).select("order_id", "update_idx"))
    return out.select("order_id", "update_idx", rounded("weight", 8).alias("weight"), rounded("weight_mean_one", 8).alias("weight_mean_one"))


def _windows(spark, sf_dir):
    """Windows of four rows with three features (step, log gap, mask), left-padded."""
    rows = F.transform("gap_logs", lambda x, i: F.array(i.cast("double"), x, F.lit(1.0)))
    return _sequences(spark, sf_dir).select("order_id", book.pad_left(rows, 4, 3).alias("window"))


_WIN = f"""{_SEQ}, cells AS (SELECT order_id, p, steps - 4 + p AS i, unnest([0, 1, 2]) AS feature FROM sq, (SELECT unnest(range(0, 4)) AS p)),
 win AS (SELECT order_id, CAST(p AS INTEGER) AS p, feature, CASE WHEN i < 0 THEN 0.0 WHEN feature = 0 THEN i WHEN feature = 1 THEN ln(1 + (order_id + i * 13) % 500) ELSE 1.0 END::DOUBLE AS x FROM cells),
 ns AS (SELECT feature, CASE WHEN feature = 2 THEN 0.0 ELSE avg(x) END AS mean, CASE WHEN feature = 2 THEN 1.0 ELSE stddev_pop(x) + 1e-8 END AS std FROM win GROUP BY feature)"""


def _cells(windows, places=6):
    rows = windows.select("order_id", F.posexplode("window").alias("p", "row"))
    return rows.select("order_id", "p", F.posexplode("row").alias("feature", "x")).withColumn("x", rounded("x", places))


@query(f"WITH {_WIN} SELECT order_id, p, feature, round(x, 6) AS x FROM win")
def seq_left_pad(spark, sf_dir):
    return _cells(_windows(spark, sf_dir))


@query(f"WITH {_WIN} SELECT feature, round(mean, 6) AS mean, round(std, 6) AS std FROM ns")
def normalizer_stats(spark, sf_dir):
    return samples.normalizer(_windows(spark, sf_dir), passthrough=[2]).select("feature", rounded("mean").alias("mean"), rounded("std").alias("std"))


@query(f"WITH {_WIN}, m AS (SELECT order_id, p, x AS mask FROM win WHERE feature = 2) SELECT order_id, p, feature, round(CASE WHEN mask = 0 THEN 0.0 ELSE (x - mean) / std END, 3) AS x FROM win JOIN ns USING (feature) JOIN m USING (order_id, p)")
def apply_normalizer(spark, sf_dir):
    windows = _windows(spark, sf_dir)
    return _cells(samples.normalize(windows, samples.normalizer(windows, passthrough=[2]), mask=2), 3)


@query(f"""WITH {_MAN}, c AS (SELECT least(remaining_s, {_LIMIT}) AS t, CASE WHEN event_type > 0 AND remaining_s <= {_LIMIT} THEN event_type ELSE 0 END AS e FROM man), m AS (SELECT min(t) AS lo, max(t) AS hi FROM c),
 u AS (SELECT t FROM c, m WHERE NOT (e = 0 AND t >= hi)) SELECT CAST(k AS INTEGER) AS cut, round(CASE WHEN k = 0 THEN (SELECT lo FROM m) WHEN k = 9 THEN (SELECT hi FROM m) ELSE v END, 5) AS seconds
 FROM (SELECT unnest(range(0, 10)) AS k, unnest(quantile_cont(t, [{', '.join(f'{k}/9.0' for k in range(10))}])) AS v FROM u)""")
def quantile_cuts(spark, sf_dir):
    cuts = samples.quantile_cuts(samples.manifest(_sequences(spark, sf_dir), lookback=_LOOK, censor_s=_LIMIT), 10)
    return spark.createDataFrame([(k, round(c, 5)) for k, c in enumerate(cuts)], "cut int, seconds double")


_PMF = f"""ex AS (SELECT sample, order_id, update_idx, y_bin, d, unnest(range(0, {2 * T})) AS j, unnest(logits) AS z FROM v_pred), mx AS (SELECT *, exp(z - max(z) OVER (PARTITION BY sample)) AS e FROM ex),
 pm AS (SELECT *, CAST(j // {T} AS INTEGER) + 1 AS event, CAST(j % {T} AS INTEGER) AS bin, e / sum(e) OVER (PARTITION BY sample) AS p FROM mx), cf AS (SELECT *, sum(p) OVER (PARTITION BY sample, event ORDER BY bin) AS cif FROM pm)"""


def _cifs(spark, sf_dir):
    return survival.with_cifs(adapters.predictions(spark, sf_dir), T)


@query(f"WITH {_PMF} SELECT sample, event, bin, round(p, 6) AS p FROM pm")
def pmf_softmax(spark, sf_dir):
    out = _cifs(spark, sf_dir).select("sample", F.posexplode("pmf").alias("j", "p"))
    return out.select("sample", (F.floor(F.col("j") / T) + 1).cast("int").alias("event"), (F.col("j") % T).alias("bin"), rounded("p").alias("p"))


@query(f"WITH {_PMF} SELECT sample, event, bin, round(cif, 6) AS cif FROM cf")
def cif_cumsum(spark, sf_dir):
    out = _cifs(spark, sf_dir)
    each = [out.select("sample", F.lit(k).alias("event"), F.posexplode(f"cif_{k}").alias("bin", "cif")) for k in (1, 2)]
    return each[0].unionByName(each[1]).withColumn("cif", rounded("cif"))


_NLL = f"""{_PMF}, nl AS (SELECT sample, any_value(order_id) AS order_id, -ln(greatest(CASE WHEN any_value(d) > 0 THEN sum(CASE WHEN event = d AND bin = y_bin THEN p ELSE 0 END) ELSE 1 - sum(CASE WHEN bin = y_bin THEN cif ELSE 0 END) END, 1e-7)) AS nll FROM cf GROUP BY sample)"""


@query(f"WITH {_NLL} SELECT round(avg(m), 6) AS nll FROM (SELECT avg(nll) AS m FROM nl GROUP BY order_id)")
def nll_order_avg(spark, sf_dir):
    return survival.order_mean(survival.nll(_cifs(spark, sf_dir), T), "nll").select(rounded("nll").alias("nll"))


_PAIRS = f"""{_PMF}, c1 AS (SELECT sample, order_id, update_idx, y_bin, d, list(cif ORDER BY bin) AS c FROM cf WHERE event = 2 GROUP BY ALL),
 pr AS (SELECT i.sample AS i, i.c[i.y_bin + 1] AS f_i, j.c[i.y_bin + 1] AS f_j FROM c1 i JOIN c1 j ON i.update_idx = j.update_idx AND i.d = 2 AND j.y_bin > i.y_bin AND i.order_id <> j.order_id)"""


@query(f"WITH {_PAIRS}, s AS (SELECT i, sum(exp(-(f_i - f_j) / 0.5)) AS loss FROM pr GROUP BY i) SELECT round(avg(m), 5) AS loss FROM (SELECT avg(coalesce(loss, 0)) AS m FROM c1 LEFT JOIN s ON s.i = c1.sample GROUP BY order_id)")
def rank_loss(spark, sf_dir):
    return survival.rank_loss(_cifs(spark, sf_dir), 2, 0.5, ["update_idx"]).select(rounded("loss", 5).alias("loss"))


@query(f"WITH {_PAIRS} SELECT round(avg(CASE WHEN f_i > f_j THEN 1.0 WHEN f_i = f_j THEN 0.5 ELSE 0.0 END), 6) AS concordance, count(*) AS pairs FROM pr")
def ctd_weighted(spark, sf_dir):
    return survival.concordance(_cifs(spark, sf_dir), 2, ["update_idx"]).select(rounded("concordance").alias("concordance"), "pairs")


_BRIER = f"{_PMF}, br AS (SELECT bin, avg(pow(CASE WHEN d = 1 AND y_bin <= bin THEN 1.0 ELSE 0.0 END - cif, 2)) AS brier FROM cf WHERE event = 1 GROUP BY bin)"


@query(f"WITH {_BRIER} SELECT bin, round(brier, 6) AS brier FROM br")
def brier_curve(spark, sf_dir):
    return survival.brier(_cifs(spark, sf_dir), 1).select("bin", rounded("brier").alias("brier"))


@query(f"WITH {_BRIER} SELECT round(sum((brier + lag0) / 2) / {T}, 6) AS ibs FROM (SELECT brier, coalesce(lag(brier) OVER (ORDER BY bin), 0) AS lag0 FROM br)")
def ibs(spark, sf_dir):
    curve = survival.brier(_cifs(spark, sf_dir), 1).withColumn("at", F.col("bin") + 1.0)
    return survival.integrated(curve, "at", "brier", float(T)).select(rounded("ibs").alias("ibs"))


@query(f"""WITH g AS (SELECT CAST(unnest(range(0, {T})) AS INTEGER) AS bin), y AS (SELECT bin, order_id % 2 = 0 AS train, CASE WHEN d = 1 AND y_bin <= bin THEN 1.0 ELSE 0.0 END AS y FROM v_pred, g),
 c AS (SELECT bin, avg(y) AS incidence FROM y WHERE train GROUP BY bin) SELECT bin, round(incidence, 6) AS incidence, round(avg(pow(y - incidence, 2)), 6) AS brier FROM y JOIN c USING (bin) WHERE NOT train GROUP BY bin, incidence""")
def uninformed_brier(spark, sf_dir):
    rows = adapters.predictions(spark, sf_dir)
    out = survival.uninformed_brier(rows.filter("order_id % 2 <> 0"), rows.filter("order_id % 2 = 0"), 1, T)
    return out.select("bin", rounded("incidence").alias("incidence"), rounded("brier").alias("brier"))


_RANK = """rk0 AS (SELECT {0} score, sum(positive)::DOUBLE AS p, sum(1 - positive)::DOUBLE AS n FROM sc GROUP BY ALL), rk AS (SELECT *, sum(p) OVER ({1} ORDER BY score DESC) AS tp, sum(n) OVER ({1} ORDER BY score DESC) AS fp, sum(p) OVER ({1}) AS ap, sum(n) OVER ({1}) AS an FROM rk0),
 cv AS (SELECT *, tp / ap AS r, tp / (tp + fp) AS pc, fp / an AS f FROM rk WHERE ap > 0 AND an > 0), st AS (SELECT *, r - coalesce(lag(r) OVER ({1} ORDER BY score DESC), 0) AS dr, coalesce(lag(pc) OVER ({1} ORDER BY score DESC), 1) AS pc0,
 f - coalesce(lag(f) OVER ({1} ORDER BY score DESC), 0) AS df, coalesce(lag(r) OVER ({1} ORDER BY score DESC), 0) AS r0 FROM cv)"""
_FINAL = f"{_PMF}, sc AS (SELECT sample, round(cif, 9) AS score, CASE WHEN d = 2 THEN 1 ELSE 0 END AS positive FROM cf WHERE event = 2 AND bin = {T - 1})"


def _toxic(spark, sf_dir, rows=None):
    rows = _cifs(spark, sf_dir) if rows is None else rows
    return rows.select(F.round(F.element_at("cif_2", -1), 9).alias("score"), (F.col("d") == 2).cast("int").alias("positive"))


@query(f"WITH {_FINAL}, {_RANK.format('', '')} SELECT round(sum(dr * (pc + pc0) / 2), 6) AS pr_auc FROM st")
def pr_auc(spark, sf_dir):
    return survival.precision_recall(_toxic(spark, sf_dir), "score", "positive").select(rounded("pr_auc").alias("pr_auc"))


@query(f"WITH {_FINAL}, {_RANK.format('', '')} SELECT round(sum(df * (r + r0) / 2), 6) AS roc_auc FROM st")
def roc_auc(spark, sf_dir):
    return survival.roc(_toxic(spark, sf_dir), "score", "positive").select(rounded("roc_auc").alias("roc_auc"))


_ENDS = f"""{_PMF}, fc AS (SELECT sample, any_value(d) AS d, sum(CASE WHEN event = 1 THEN cif END) AS c1, sum(CASE WHEN event = 2 THEN cif END) AS c2 FROM cf WHERE bin = {T - 1} GROUP BY sample)"""
_CLASSES = f"""{_ENDS}, sc AS (SELECT class, round(CASE class WHEN 0 THEN least(greatest(1 - c1 - c2, 0), 1) WHEN 1 THEN c1 ELSE c2 END, 9) AS score,
 CASE WHEN d = class THEN 1 ELSE 0 END AS positive FROM fc, (SELECT unnest([0, 1, 2]) AS class))"""


@query(f"WITH {_CLASSES}, {_RANK.format('class,', 'PARTITION BY class')} SELECT class, round(sum(dr * pc), 6) AS average_precision, round(sum(df * (r + r0) / 2), 6) AS roc_auc FROM st GROUP BY class")
def ovr_average_precision(spark, sf_dir):
    scores = survival.class_scores(_cifs(spark, sf_dir)).withColumn("score", F.round("score", 9))
    both = survival.precision_recall(scores, "score", "positive", by=["class"]).join(survival.roc(scores, "score", "positive", by=["class"]), "class")
    return both.select("class", rounded("average_precision").alias("average_precision"), rounded("roc_auc").alias("roc_auc"))


@query(f"WITH {_FINAL.replace('event = 2 AND', 'd > 0 AND event = 2 AND')}, {_RANK.format('', '')} SELECT round(sum(dr * pc), 6) AS average_precision FROM st")
def event_only_ap(spark, sf_dir):
    rows = _cifs(spark, sf_dir).filter("d > 0")
    return survival.precision_recall(_toxic(spark, sf_dir, rows), "score", "positive").select(rounded("average_precision").alias("average_precision"))


_KM = """ct AS (SELECT y_bin, count(*) AS n, count(*) FILTER (d = 0) AS censored FROM v_pred GROUP BY y_bin), rs AS (SELECT *, CAST(sum(n) OVER (ORDER BY y_bin DESC) AS BIGINT) AS at_risk FROM ct),
 km AS (SELECT y_bin, at_risk, censored, CASE WHEN min(1 - censored / at_risk) OVER (ORDER BY y_bin) <= 0 THEN 0 ELSE exp(sum(ln(greatest(1 - censored / at_risk, 1e-300))) OVER (ORDER BY y_bin)) END AS survival FROM rs)"""


@query(f"WITH {_KM} SELECT y_bin, at_risk, censored, round(survival, 6) AS survival FROM km")
def km_censoring(spark, sf_dir):
    return survival.censoring_survival(adapters.predictions(spark, sf_dir)).withColumn("survival", rounded("survival"))


@query(f"""WITH {_PMF}, {_KM} SELECT bin, round(avg(CASE WHEN cf.y_bin <= bin AND d > 0 AND gy.survival > 0 THEN pow((CASE WHEN d = 1 THEN 1.0 ELSE 0.0 END) - cif, 2) / gy.survival WHEN cf.y_bin > bin AND gt.survival > 0 THEN pow(cif, 2) / gt.survival ELSE 0 END), 6) AS brier
 FROM cf JOIN km gy ON gy.y_bin = cf.y_bin JOIN km gt ON gt.y_bin = cf.bin WHERE event = 1 GROUP BY bin""")
def ipcw_brier(spark, sf_dir):
    rows = _cifs(spark, sf_dir)
    return survival.ipcw_brier(rows, survival.censoring_survival(rows), 1).select("bin", rounded("brier").alias("brier"))


@query(f"WITH {_PMF} SELECT d, event, round(avg(cif), 6) AS mean_cif FROM cf WHERE bin = {T - 1} GROUP BY d, event")
def mean_cif_by_outcome(spark, sf_dir):
    ends = F.array(*(F.struct(F.lit(k).alias("event"), F.element_at(f"cif_{k}", -1).alias("cif")) for k in (1, 2)))
    return _cifs(spark, sf_dir).select("d", F.explode(ends).alias("e")).groupBy("d", F.col("e.event").alias("event")).agg(rounded(F.avg("e.cif")).alias("mean_cif"))


_STEPS = "st2 AS (SELECT event_id // 20 AS order_id, pow(value - 10, 2) AS squared_error, event_id % 3 <> 0 AS valid FROM events)"


@query(f"WITH {_STEPS} SELECT round(0.5 * avg(r), 5) AS loss FROM (SELECT sum(squared_error) / count(*) AS r FROM st2 WHERE valid GROUP BY order_id)")
def next_step_loss(spark, sf_dir):
    e = F.col("event_id")
    steps = adapters.read(spark, sf_dir, "events").select(F.floor(e / 20).alias("order_id"), F.pow(F.col("value") - 10, 2).alias("squared_error"), (e % 3 != 0).alias("valid"))
    return survival.next_step_loss(steps, beta=0.5).select(rounded("loss", 5).alias("loss"))


@query("SELECT round(avg((o_orderkey * 37 % 100) * exp((o_orderkey % 7) / 10.0 - 1) - CAST(o_orderkey % 2 AS DOUBLE) * ((o_orderkey % 7) / 10.0 - 1)), 6) AS nll FROM orders")
def exponential_nll(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = adapters.read(spark, sf_dir, "orders").select((k * 37 % 100).alias("t"), (k % 2).cast("double").alias("e"), ((k % 7) / 10.0 - 1).alias("h"))
    return survival.exponential_nll(rows, "t", "e", "h").select(rounded("nll").alias("nll"))


@query(f"WITH {_ENDS} SELECT d = 0 AS censored, count(*) AS n, round(avg(least(greatest(1 - c1 - c2, 0), 1)), 6) AS mean_survival, round(avg(CASE WHEN least(greatest(1 - c1 - c2, 0), 1) > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS share_over_half FROM fc GROUP BY 1")
def censoring_diagnostics(spark, sf_dir):
    out = survival.censoring_diagnostics(_cifs(spark, sf_dir))
    return out.select("censored", "n", rounded("mean_survival").alias("mean_survival"), rounded("share_over_half").alias("share_over_half"))


_BOTH = f"""{_PMF}, ca AS (SELECT sample, event, order_id, update_idx, y_bin, d, list(cif ORDER BY bin) AS c FROM cf GROUP BY ALL),
 pr AS (SELECT i.event, i.order_id, i.c[i.y_bin + 1] AS f_i, j.c[i.y_bin + 1] AS f_j FROM ca i JOIN ca j ON i.event = j.event AND i.update_idx = j.update_idx AND i.d = i.event AND j.y_bin > i.y_bin AND i.order_id <> j.order_id),
 cc AS (SELECT event, avg(CASE WHEN f_i > f_j THEN 1.0 WHEN f_i = f_j THEN 0.5 ELSE 0.0 END) AS concordance FROM pr GROUP BY event),
 bb AS (SELECT event, bin, avg(pow(CASE WHEN d = event AND y_bin <= bin THEN 1.0 ELSE 0.0 END - cif, 2)) AS brier FROM cf GROUP BY event, bin),
 ib AS (SELECT event, sum((brier + b0) / 2) / {T} AS ibs FROM (SELECT event, brier, coalesce(lag(brier) OVER (PARTITION BY event ORDER BY bin), 0) AS b0 FROM bb) GROUP BY event),
 sc AS (SELECT event AS class, round(cif, 9) AS score, CASE WHEN d = event THEN 1 ELSE 0 END AS positive FROM cf WHERE bin = {T - 1}), {_RANK.format('class,', 'PARTITION BY class')},
 ar AS (SELECT class AS event, sum(dr * (pc + pc0) / 2) AS pr_auc, sum(df * (r + r0) / 2) AS roc_auc FROM st GROUP BY class), ev AS (SELECT d AS event, count(*) AS events FROM v_pred WHERE d > 0 GROUP BY d),
 vb AS (SELECT ev.event, events, concordance, ibs, pr_auc, roc_auc FROM ev JOIN cc USING (event) JOIN ib USING (event) JOIN ar USING (event))"""
_METRICS = ("concordance", "ibs", "pr_auc", "roc_auc")


def _bundle(spark, sf_dir):
    rows = _cifs(spark, sf_dir)
    return survival.validation_metrics(rows, 1, T, ["update_idx"]).unionByName(survival.validation_metrics(rows, 2, T, ["update_idx"]))


@query(f"WITH {_BOTH} SELECT event, events, {', '.join(f'round({m}, 6) AS {m}' for m in _METRICS)} FROM vb")
def validation_bundle(spark, sf_dir):
    return _bundle(spark, sf_dir).select("event", "events", *(rounded(m).alias(m) for m in _METRICS))


@query(f"WITH {_BOTH} SELECT round(avg(concordance), 6) AS macro, round(sum(concordance * events) / sum(events), 6) AS weighted FROM vb")
def ctd_combined(spark, sf_dir):
    out = survival.weighted_over_events(_bundle(spark, sf_dir), "concordance")
    return out.select(rounded("macro").alias("macro"), rounded("weighted").alias("weighted"))


@query(f"""WITH {_CLASSES}, {_RANK.format('class,', 'PARTITION BY class')}, m AS (SELECT class, sum(dr * pc) AS ap, sum(df * (r + r0) / 2) AS roc FROM st GROUP BY class), w AS (SELECT d AS class, count(*) AS n FROM v_pred GROUP BY d)
 SELECT round(avg(ap), 6) AS macro_ap, round(sum(ap * n) / sum(n), 6) AS weighted_ap, round(avg(roc), 6) AS macro_roc, round(sum(roc * n) / sum(n), 6) AS weighted_roc FROM m JOIN w USING (class)""")
def ovr_means(spark, sf_dir):
    rows = _cifs(spark, sf_dir)
    scores = survival.class_scores(rows).withColumn("score", F.round("score", 9))
    out = survival.one_versus_rest(scores)
    return out.select(*(rounded(c).alias(c) for c in out.columns))


_WEIGHT = "(1.0 + sample % 3)"


@query(f"""WITH {_PMF} SELECT bin, round(sum({_WEIGHT} * pow(CASE WHEN d = 1 AND y_bin <= bin THEN 1.0 ELSE 0.0 END - cif, 2)) / sum({_WEIGHT}), 6) AS brier FROM cf WHERE event = 1 GROUP BY bin""")
def weighted_brier(spark, sf_dir):
    rows = _cifs(spark, sf_dir).withColumn("w", 1.0 + F.col("sample") % 3)
    return survival.brier(rows, 1, "w").select("bin", rounded("brier").alias("brier"))


@query(f"""WITH g AS (SELECT CAST(unnest(range(0, {T})) AS INTEGER) AS bin), y AS (SELECT bin, order_id % 2 = 0 AS train, {_WEIGHT} AS w, CASE WHEN d = 1 AND y_bin <= bin THEN 1.0 ELSE 0.0 END AS y FROM v_pred, g),
 c AS (SELECT bin, sum(w * y) / sum(w) AS incidence FROM y WHERE train GROUP BY bin) SELECT bin, round(incidence, 6) AS incidence, round(sum(w * pow(y - incidence, 2)) / sum(w), 6) AS brier FROM y JOIN c USING (bin) WHERE NOT train GROUP BY bin, incidence""")
def weighted_uninformed_brier(spark, sf_dir):
    rows = adapters.predictions(spark, sf_dir).withColumn("w", 1.0 + F.col("sample") % 3)
    out = survival.uninformed_brier(rows.filter("order_id % 2 <> 0"), rows.filter("order_id % 2 = 0"), 1, T, "w")
    return out.select("bin", rounded("incidence").alias("incidence"), rounded("brier").alias("brier"))


@query(f"WITH {_BRIER} SELECT round(sum((brier + b0) / 2) / {T - 1}, 6) AS ibs FROM (SELECT bin, brier, lag(brier) OVER (ORDER BY bin) AS b0 FROM br) WHERE b0 IS NOT NULL")
def ibs_static(spark, sf_dir):
    return survival.integrated_span(survival.brier(_cifs(spark, sf_dir), 1), "bin", "brier").select(rounded("ibs").alias("ibs"))


@query(f"WITH {_PAIRS.replace('i.update_idx = j.update_idx AND ', '')}, s AS (SELECT i, sum(exp(-(f_i - f_j) / 0.5)) AS loss FROM pr GROUP BY i) SELECT round(avg(m), 4) AS loss FROM (SELECT avg(coalesce(loss, 0)) AS m FROM c1 LEFT JOIN s ON s.i = c1.sample GROUP BY order_id)")
def rank_loss_static(spark, sf_dir):
    """All samples are comparable, whatever their update."""
    return survival.rank_loss(_cifs(spark, sf_dir).withColumn("whole", F.lit(0)), 2, 0.5, ["whole"]).select(rounded("loss", 4).alias("loss"))


@query(f"WITH {_PAIRS.replace('i.update_idx = j.update_idx AND ', '')} SELECT round(avg(CASE WHEN f_i > f_j THEN 1.0 WHEN f_i = f_j THEN 0.5 ELSE 0.0 END), 6) AS concordance, count(*) AS pairs FROM pr")
def ctd_static(spark, sf_dir):
    return survival.concordance(_cifs(spark, sf_dir).withColumn("whole", F.lit(0)), 2, ["whole"]).select(rounded("concordance").alias("concordance"), "pairs")


@query(f"""WITH {_PMF}, {_KM}, a AS (SELECT sample, y_bin, d, list(cif ORDER BY bin) AS c FROM cf WHERE event = 1 GROUP BY ALL), w AS (SELECT a.*, 1 / pow(survival, 2) AS w FROM a JOIN km USING (y_bin) WHERE d = 1 AND survival > 0),
 p AS (SELECT w.w, w.c[{T}] AS f_i, a.c[{T}] AS f_j FROM w JOIN a ON a.y_bin > w.y_bin) SELECT round(sum(w * CASE WHEN f_i > f_j THEN 1.0 WHEN f_i = f_j THEN 0.5 ELSE 0.0 END) / sum(w), 6) AS concordance FROM p""")
def uno_concordance(spark, sf_dir):
    rows = _cifs(spark, sf_dir)
    return survival.uno_concordance(rows, survival.censoring_survival(rows), 1).select(rounded("concordance").alias("concordance"))


@query(f"""WITH {_ENDS}, s AS (SELECT least(greatest(1 - c1 - c2, 0), 1) AS s, d FROM fc) SELECT CAST(least(floor(s * 5), 4) AS INTEGER) AS bucket, count(*) AS n, round(avg(CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END), 6) AS alive, round(avg(s), 6) AS mean_survival FROM s GROUP BY 1""")
def d_calibration(spark, sf_dir):
    out = survival.calibration(_cifs(spark, sf_dir), 5)
    return out.select("bucket", "n", rounded("alive").alias("alive"), rounded("mean_survival").alias("mean_survival"))


@query(f"""WITH {_PMF}, m AS (SELECT sample, any_value(y_bin) AS y_bin, any_value(d) AS d, least(sum(CASE WHEN all_cif < 0.5 THEN 1 ELSE 0 END), {T}) AS med FROM (SELECT sample, y_bin, d, bin, sum(cif) AS all_cif FROM cf GROUP BY ALL) GROUP BY sample)
 SELECT count(*) AS n, round(avg(abs(med - y_bin)), 6) AS mae FROM m WHERE d > 0""")
def median_absolute_error(spark, sf_dir):
    return survival.median_error(_cifs(spark, sf_dir)).select("n", rounded("mae").alias("mae"))


_SHUFFLED = "sh AS (SELECT a.sample, a.positive, b.score FROM (SELECT sample, positive, row_number() OVER (ORDER BY md5(sample::VARCHAR), sample) AS n FROM s0) a JOIN (SELECT score, row_number() OVER (ORDER BY md5('7:' || sample), sample) AS n FROM s0) b USING (n))"


@query(f"""WITH {_FINAL.replace('sc AS', 's0 AS')}, {_SHUFFLED}, sc AS (SELECT 0 AS class, score, positive FROM s0 UNION ALL SELECT 1, score, positive FROM sh), {_RANK.format('class,', 'PARTITION BY class')}, r AS (SELECT class, sum(df * (r + r0) / 2) AS a FROM st GROUP BY class)
 SELECT 'cif_2' AS feature, round(max(a) FILTER (class = 0) - max(a) FILTER (class = 1), 6) AS importance FROM r""")
def permutation_importance(spark, sf_dir):
    """The drop of the toxic ROC area when its scores are dealt anew."""
    scores = _cifs(spark, sf_dir).select("sample", F.round(F.element_at("cif_2", -1), 9).alias("score"), (F.col("d") == 2).cast("int").alias("positive"))
    base = survival.roc(scores, "score", "positive").withColumnRenamed("roc_auc", "base")
    mixed = survival.roc(survival.permuted(scores, "score", "sample", 7), "score", "positive").withColumnRenamed("roc_auc", "mixed")
    return base.crossJoin(F.broadcast(mixed)).select(F.lit("cif_2").alias("feature"), rounded(F.col("base") - F.col("mixed")).alias("importance"))


@query(f"""WITH {_WIN}, z AS (SELECT order_id, sum(x) * 0.01 AS z FROM win GROUP BY order_id), e AS (SELECT order_id, j, exp(z * (j % 3) - z * 2) AS e FROM z, (SELECT unnest(range(0, {2 * T})) AS j))
 SELECT order_id, round(sum(e) FILTER (j >= {T}) / sum(e), 6) AS toxic FROM e GROUP BY order_id""")
def model_scoring_hook(spark, sf_dir):
    """Windows scored by a model in Arrow batches, then turned into incidences."""
    windows = _windows(spark, sf_dir).withColumn("flat", F.flatten("window"))
    scored = backtest.score_with(windows, lambda rows: [[sum(r) * 0.01 * (k % 3) for k in range(2 * T)] for r in rows], "flat", T)
    return survival.with_cifs(scored, T).select("order_id", rounded(F.element_at("cif_2", -1)).alias("toxic"))
