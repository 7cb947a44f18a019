"""Competing-risk predictions: distributions, losses, and their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import running


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def softmax(logits: Column) -> Column:
    """Over the whole flat array: all events and all bins share one mass."""
    shifted = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(shifted, lambda x: x / total(shifted))


def event_pmf(pmf: Column, event: int, bins: int) -> Column:
    """The bins of an event, counted from 1."""
    return F.slice(pmf, (event - 1) * bins + 1, bins)


def cumulated(values: Column) -> Column:
    return F.aggregate(values, F.array().cast("array<double>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + x)))


def with_cifs(predictions: DataFrame, bins: int, events: int = 2) -> DataFrame:
    """``predictions`` with pmf and cif_1, cif_2, ..."""
    out = predictions.withColumn("pmf", softmax(F.col("logits")))
    return out.withColumns({f"cif_{k}": cumulated(event_pmf(F.col("pmf"), k, bins)) for k in range(1, events + 1)})


def order_mean(samples: DataFrame, value: str, by: str = "order_id") -> DataFrame:
    """One row: the mean of the orders' means."""
    return samples.groupBy(by).agg(F.avg(value).alias("__m")).agg(F.avg("__m").alias(value))


def nll(samples: DataFrame, bins: int, eps: float = 1e-7) -> DataFrame:
    """``samples`` with the negative log-likelihood: of the event's bin, or of surviving all events."""
    at_event = F.element_at("pmf", ((F.col("d") - 1) * bins + F.col("y_bin") + 1).cast("int"))
    alive = 1.0 - F.element_at("cif_1", F.col("y_bin") + 1) - F.element_at("cif_2", F.col("y_bin") + 1)
    return samples.withColumn("nll", -F.log(F.greatest(F.when(F.col("d") > 0, at_event).otherwise(alive), F.lit(eps))))


def _each_bin(samples: DataFrame, event: int, groups: list[str]) -> DataFrame:
    """(groups, order_id, bin, f): the incidence of a sample at each bin before its own."""
    rows = samples.select(*groups, "order_id", "y_bin", F.posexplode(f"cif_{event}").alias("bin", "f"))
    return rows.filter(F.col("bin") < F.col("y_bin")).drop("y_bin")


def _anchors(samples: DataFrame, event: int, groups: list[str]) -> DataFrame:
    return samples.filter(F.col("d") == event).select(*groups, F.col("sample").alias("i"), "order_id", F.col("y_bin").alias("bin"), F.element_at(f"cif_{event}", F.col("y_bin") + 1).alias("f"))


def _own_pairs(samples: DataFrame, event: int, groups: list[str]) -> DataFrame:
    """(i, f, __g) of the pairs within an order, which don't count: of an order's few samples of the same group only."""
    others = _each_bin(samples, event, groups).withColumnRenamed("f", "__g")
    return _anchors(samples, event, groups).join(others, [*groups, "order_id", "bin"]).select("i", "f", "__g")


def rank_loss(samples: DataFrame, event: int, sigma: float, groups: list[str]) -> DataFrame:
    """One row: for each sample the sum of exp(-(F_i - F_j) / sigma) over its pairs, as the mean of order means over all orders.

    A pair is an event of i and a j of another order and the same group that
    has nothing up to i's bin. The sum factorises: exp(-F_i / sigma) times the
    sum of exp(F_j / sigma) over all j of the bin, less those of the own order.
    """
    lifted = F.sum(F.exp(F.col("f") / sigma)).alias("s")
    whole = _each_bin(samples, event, groups).groupBy(*groups, "bin").agg(lifted)
    own = _own_pairs(samples, event, groups).groupBy("i").agg(F.sum(F.exp((F.col("__g") - F.col("f")) / sigma)).alias("own"))
    anchors = _anchors(samples, event, groups).join(F.broadcast(whole), [*groups, "bin"]).select("i", (F.exp(-F.col("f") / sigma) * F.col("s")).alias("all"))
    loss = anchors.join(own, "i", "left").select("i", (F.col("all") - F.coalesce("own", F.lit(0.0))).alias("loss"))
    every = samples.select(F.col("sample").alias("i"), "order_id").join(loss, "i", "left").fillna(0.0, ["loss"])
    return order_mean(every, "loss")


def concordance(samples: DataFrame, event: int, groups: list[str]) -> DataFrame:
    """One row: the share of pairs whose anchor has the higher incidence at its time, ties half.

    Of each group and bin the incidences are counted in order, so an anchor's
    number of lower and equal others is a difference of two running counts.
    """
    others = _each_bin(samples, event, groups).groupBy(*groups, "bin", "f").agg(F.count("*").alias("others"), F.lit(0).cast("long").alias("anchors"))
    anchors = _anchors(samples, event, groups).groupBy(*groups, "bin", "f").agg(F.lit(0).cast("long").alias("others"), F.count("*").alias("anchors"))
    both = others.unionByName(anchors).groupBy(*groups, "bin", "f").agg(F.sum("others").alias("others"), F.sum("anchors").alias("anchors"))
    ranked = running.running(both, [*groups, "bin"], ["f"], {"upto": F.col("others")})
    whole = others.groupBy(*groups, "bin").agg(F.sum("others").alias("__all"))
    found = ranked.filter("anchors > 0").join(F.broadcast(whole), [*groups, "bin"])
    right = F.col("anchors") * (F.col("upto") - F.col("others") + F.col("others") / 2.0)
    counted = found.agg(F.coalesce(F.sum(right), F.lit(0.0)).alias("right"), F.coalesce(F.sum(F.col("anchors") * F.col("__all")), F.lit(0)).alias("pairs"))
    own = _own_pairs(samples, event, groups).agg(
        F.coalesce(F.sum(F.when(F.col("f") > F.col("__g"), 1.0).when(F.col("f") == F.col("__g"), 0.5).otherwise(0.0)), F.lit(0.0)).alias("own_right"), F.count("*").alias("own_pairs")
    )
    pairs = F.col("pairs") - F.col("own_pairs")
    return counted.crossJoin(F.broadcast(own)).select(F.try_divide(F.col("right") - F.col("own_right"), pairs).alias("concordance"), pairs.alias("pairs"))


def brier(samples: DataFrame, event: int, weight: str | None = None) -> DataFrame:
    """(bin, brier): squared error, under weights if given, of the incidence against whether the event has come."""
    w = F.col(weight) if weight else F.lit(1.0)
    each = samples.select("d", "y_bin", w.alias("__w"), F.posexplode(f"cif_{event}").alias("bin", "p"))
    y = F.when((F.col("d") == event) & (F.col("y_bin") <= F.col("bin")), 1.0).otherwise(0.0)
    return each.groupBy("bin").agg((F.sum(F.pow(y - F.col("p"), 2) * F.col("__w")) / F.sum("__w")).alias("brier"))


def uninformed_brier(samples: DataFrame, train: DataFrame, event: int, bins: int, weight: str | None = None) -> DataFrame:
    """(bin, incidence, brier) of the incidence that the training part has at each bin, for everybody."""
    grid = train.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    come = F.when((F.col("d") == event) & (F.col("y_bin") <= F.col("bin")), 1.0).otherwise(0.0)
    w = F.col(weight) if weight else F.lit(1.0)

    def counted(rows: DataFrame) -> DataFrame:  # a row for each bin and outcome
        return rows.groupBy("y_bin", "d").agg(F.sum(w).alias("n")).crossJoin(F.broadcast(grid)).withColumn("y", come)

    curve = counted(train).groupBy("bin").agg((F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("incidence"))
    each = counted(samples).join(F.broadcast(curve), "bin")
    return each.groupBy("bin", "incidence").agg((F.sum(F.pow(F.col("y") - F.col("incidence"), 2) * F.col("n")) / F.sum("n")).alias("brier"))


def integrated_span(curve: DataFrame, at: str, value: str) -> DataFrame:
    """One row: the trapezoid of the curve between its first and last points, over what lies between them; null for one point."""
    before = Window.orderBy(at)  # a row for each bin
    area = (F.col(value) + F.lag(value).over(before)) / 2 * (F.col(at) - F.lag(at).over(before))
    return curve.withColumn("__a", area).agg(F.try_divide(F.sum("__a"), F.max(at) - F.min(at)).alias("ibs"))


def one_versus_rest(scores: DataFrame) -> DataFrame:
    """One row: average precision and ROC area over the classes of ``class_scores``, plain and by how often each class is true."""
    areas = precision_recall(scores, "score", "positive", by=["class"]).join(roc(scores, "score", "positive", by=["class"]), "class")
    true = scores.groupBy("class").agg(F.sum("positive").alias("n"))
    both = areas.join(true, "class").filter(F.col("roc_auc").isNotNull())  # a row for each class

    def under(value: str):
        return F.try_divide(F.sum(F.col(value) * F.col("n")), F.sum("n"))

    return both.agg(F.avg("average_precision").alias("macro_ap"), under("average_precision").alias("weighted_ap"), F.avg("roc_auc").alias("macro_roc"), under("roc_auc").alias("weighted_roc"))


def uno_concordance(samples: DataFrame, survival: DataFrame, event: int) -> DataFrame:
    """One row: concordance of the last incidence, each event weighted by the square of the inverse censoring survival at its bin.

    As in ``concordance``, others are counted in the order of their incidence for
    each bin that an event can have; bins are few, samples aren't paired.
    """
    last = F.element_at(f"cif_{event}", -1)
    rows = samples.select("d", "y_bin", last.alias("f"))
    weight = F.when(F.col("survival") > 0, 1 / F.pow("survival", 2))
    anchors = rows.filter(F.col("d") == event).join(F.broadcast(survival.select("y_bin", weight.alias("w"))), "y_bin").filter(F.col("w").isNotNull())
    anchors = anchors.groupBy(F.col("y_bin").alias("bin"), "f").agg(F.sum("w").alias("w"), F.lit(0).cast("long").alias("others"))
    others = rows.filter("y_bin > 0").select(F.explode(F.sequence(F.lit(0), F.col("y_bin") - 1)).alias("bin"), "f")
    others = others.groupBy("bin", "f").agg(F.lit(0.0).alias("w"), F.count("*").alias("others"))
    both = others.unionByName(anchors).groupBy("bin", "f").agg(F.sum("w").alias("w"), F.sum("others").alias("others"))
    ranked = running.running(both, ["bin"], ["f"], {"upto": F.col("others")}).filter("w > 0")
    whole = others.groupBy("bin").agg(F.sum("others").alias("__all"))
    found = ranked.join(F.broadcast(whole), "bin")
    return found.agg(F.try_divide(F.sum(F.col("w") * (F.col("upto") - F.col("others") / 2.0)), F.sum(F.col("w") * F.col("__all"))).alias("concordance"))


def calibration(samples: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n, alive, mean_survival): of samples by their predicted survival at the last bin, how many are without an event."""
    alive = F.least(F.greatest(1.0 - F.element_at("cif_1", -1) - F.element_at("cif_2", -1), F.lit(0.0)), F.lit(1.0))
    rows = samples.select((F.col("d") == 0).cast("double").alias("y"), alive.alias("s")).withColumn("bucket", F.least(F.floor(F.col("s") * buckets), F.lit(buckets - 1)).cast("int"))
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("y").alias("alive"), F.avg("s").alias("mean_survival"))


def median_error(samples: DataFrame) -> DataFrame:
    """(n, mae): over samples with an event, the bins between it and the first at which half of all events are due, or the end."""
    due = F.size(F.filter(F.zip_with("cif_1", "cif_2", lambda a, b: a + b), lambda x: x < 0.5))
    return samples.filter("d > 0").agg(F.count("*").alias("n"), F.avg(F.abs(due - F.col("y_bin"))).alias("mae"))


def integrated(curve: DataFrame, at: str, value: str, end: float) -> DataFrame:
    """One row: the trapezoid of the curve from (0, 0), over the end."""
    before = Window.orderBy(at)  # a row for each bin
    area = (F.col(value) + F.coalesce(F.lag(value).over(before), F.lit(0.0))) / 2 * (F.col(at) - F.coalesce(F.lag(at).over(before), F.lit(0.0)))
    return curve.withColumn("__a", area).agg((F.sum("__a") / end).alias("ibs"))


def _ranked(scores: DataFrame, score: str, positive: str, weight: str | None, by: list[str] = []) -> DataFrame:
    """Distinct scores, the highest first, with the weights of positives and negatives up to each and those of it alone."""
    w = F.col(weight) if weight else F.lit(1.0)
    each = scores.select(*by, (-F.col(score)).alias("__down"), F.when(F.col(positive) == 1, w).otherwise(0.0).alias("__p"), F.when(F.col(positive) == 1, 0.0).otherwise(w).alias("__n"))
    each = each.groupBy(*by, "__down").agg(F.sum("__p").alias("p"), F.sum("__n").alias("n"))
    out = running.running(each, by, ["__down"], {"tp": F.col("p"), "fp": F.col("n")})
    whole = scores.groupBy(*by).agg(F.sum(F.when(F.col(positive) == 1, w).otherwise(0.0)).alias("all_p"), F.sum(F.when(F.col(positive) == 1, 0.0).otherwise(w)).alias("all_n"))
    out = out.join(F.broadcast(whole), by) if by else out.crossJoin(F.broadcast(whole))
    return out.filter("all_p > 0 and all_n > 0")


def _one_row(areas: DataFrame, scores: DataFrame, by: list[str]) -> DataFrame:
    """A row for each group, null where it lacks a class."""
    return scores.select(*by).distinct().join(F.broadcast(areas), by, "left") if by else areas


def precision_recall(scores: DataFrame, score: str, positive: str, weight: str | None = None, by: list[str] = []) -> DataFrame:
    """One row (for each ``by``): the area under the precision-recall curve by trapezoids, from recall 0 and precision 1, and the step sum (average precision); null without both classes."""
    r = _ranked(scores, score, positive, weight, by)
    before = F.col("tp") - F.col("p") + F.col("fp") - F.col("n")
    precision, last = F.col("tp") / (F.col("tp") + F.col("fp")), F.when(before > 0, (F.col("tp") - F.col("p")) / before).otherwise(1.0)
    recalled = F.col("p") / F.col("all_p")
    return _one_row(r.groupBy(*by).agg(F.sum(recalled * (precision + last) / 2).alias("pr_auc"), F.sum(recalled * precision).alias("average_precision")), scores, by)


def roc(scores: DataFrame, score: str, positive: str, weight: str | None = None, by: list[str] = []) -> DataFrame:
    """One row (for each ``by``): the area under the ROC curve; null without both classes."""
    r = _ranked(scores, score, positive, weight, by)
    area = F.col("n") / F.col("all_n") * (2 * F.col("tp") - F.col("p")) / F.col("all_p") / 2
    return _one_row(r.groupBy(*by).agg(F.sum(area).alias("roc_auc")), scores, by)


def censoring_survival(samples: DataFrame) -> DataFrame:
    """(y_bin, at_risk, censored, survival): Kaplan-Meier of the censoring, a row for each bin that occurs."""
    counts = samples.groupBy("y_bin").agg(F.count("*").alias("n"), F.count_if(F.col("d") == 0).alias("censored"))
    up = Window.orderBy("y_bin")
    risk = F.sum("n").over(Window.orderBy(F.desc("y_bin")))
    out = counts.withColumn("at_risk", risk)
    left = 1.0 - F.col("censored") / F.col("at_risk")
    log = F.sum(F.when(left > 0, F.log(left)).otherwise(F.lit(float("-inf")))).over(up)
    return out.select("y_bin", "at_risk", "censored", F.exp(log).alias("survival"))


def ipcw_brier(samples: DataFrame, survival: DataFrame, event: int) -> DataFrame:
    """(bin, brier) with inverse-probability-of-censoring weights: known outcomes by 1 / G(y), those still at risk by 1 / G(bin); without weight where G is 0."""
    g = survival.select("y_bin", "survival")
    each = samples.join(F.broadcast(g), "y_bin").withColumnRenamed("survival", "g_y").select("d", "y_bin", "g_y", F.posexplode(f"cif_{event}").alias("bin", "p"))
    each = each.join(F.broadcast(g.select(F.col("y_bin").alias("bin"), F.col("survival").alias("g_t"))), "bin")  # a row for each bin
    known = (F.col("y_bin") <= F.col("bin")) & (F.col("d") > 0)
    y = F.when(F.col("d") == event, 1.0).otherwise(0.0)
    term = F.when(known & (F.col("g_y") > 0), F.pow(y - F.col("p"), 2) / F.col("g_y")).when((F.col("y_bin") > F.col("bin")) & (F.col("g_t") > 0), F.pow(F.col("p"), 2) / F.col("g_t")).otherwise(0.0)
    return each.groupBy("bin").agg(F.avg(term).alias("brier"))


def class_scores(samples: DataFrame) -> DataFrame:
    """(class, score, positive) at the last bin: censored is what no event takes, then the events."""
    last = [F.element_at(f"cif_{k}", -1) for k in (1, 2)]
    none = F.least(F.greatest(1.0 - last[0] - last[1], F.lit(0.0)), F.lit(1.0))
    classes = F.array(*(F.struct(F.lit(k).alias("class"), s.alias("score")) for k, s in enumerate((none, *last))))
    return samples.select("d", F.explode(classes).alias("c")).select("c.class", "c.score", (F.col("d") == F.col("c.class")).cast("int").alias("positive"))


def next_step_loss(steps: DataFrame, by: str = "order_id", error: str = "squared_error", valid: str = "valid", beta: float = 1.0) -> DataFrame:
    """One row: beta times the mean over orders of the sum of squared errors over valid pairs by their number; orders without pairs don't count."""
    per = steps.filter(F.col(valid)).groupBy(by).agg((F.sum(error) / F.count("*")).alias("__r"))
    return per.agg((F.lit(beta) * F.coalesce(F.avg("__r"), F.lit(0.0))).alias("loss"))


def total_loss(likelihood: float, ranking: float, auxiliary: float, *, alpha: float, sigma: float, beta: float) -> float:
    """Likelihood + alpha ranking + auxiliary (which has beta); the settings must be usable."""
    if alpha < 0 or beta < 0 or sigma <= 0:
        raise ValueError("alpha and beta can't be negative, sigma must be positive")
    return likelihood + alpha * ranking + auxiliary


def exponential_nll(rows: DataFrame, duration: str, event: str, log_hazard: str) -> DataFrame:
    """One row: the mean of duration * exp(h) - event * h."""
    return rows.agg(F.avg(F.col(duration) * F.exp(log_hazard) - F.col(event) * F.col(log_hazard)).alias("nll"))


def nearest_bins(grid: list[float], seconds: list[float]) -> list[int]:
    """For each time the index of the nearest grid point, the earlier of two."""
    return [min(range(len(grid)), key=lambda k: (abs(grid[k] - s), k)) for s in seconds]


def bounded_bin(index: int, bins: int) -> int:
    """An index into the bins: negative ones count from the end, all are held within."""
    return min(max(index + bins if index < 0 else index, 0), bins - 1)


def censoring_diagnostics(samples: DataFrame) -> DataFrame:
    """(outcome, n, mean_survival, share_over_half) of the predicted survival at the last bin, by whether the sample is censored."""
    alive = F.least(F.greatest(1.0 - F.element_at("cif_1", -1) - F.element_at("cif_2", -1), F.lit(0.0)), F.lit(1.0))
    rows = samples.select((F.col("d") == 0).alias("censored"), alive.alias("s"))
    return rows.groupBy("censored").agg(F.count("*").alias("n"), F.avg("s").alias("mean_survival"), F.avg((F.col("s") > 0.5).cast("double")).alias("share_over_half"))


def permuted(rows: DataFrame, column: str, key: str, seed: int) -> DataFrame:
    """``rows`` with one column's values dealt anew among all of them, by a seeded hash of a unique key."""
    text = F.col(key).cast("string")
    own = running.numbered(rows.withColumn("__h", F.md5(text.cast("binary"))), [], ["__h", key], "__n").drop("__h", column)
    dealt = rows.select(F.col(column), F.col(key).alias("__k"), F.md5(F.concat(F.lit(f"{seed}:"), text).cast("binary")).alias("__h"))
    other = running.numbered(dealt, [], ["__h", "__k"], "__n").drop("__h", "__k")
    return own.join(other, "__n").drop("__n")


def validation_metrics(samples: DataFrame, event: int, bins: int, groups: list[str]) -> DataFrame:
    """One row for an event: concordance, integrated Brier score, PR and ROC areas, and the number of its events."""
    curve = brier(samples, event).withColumn("at", F.col("bin") + 1.0)
    final = samples.select(F.round(F.element_at(f"cif_{event}", -1), 9).alias("score"), (F.col("d") == event).cast("int").alias("positive"))
    parts = (concordance(samples, event, groups).select("concordance"), integrated(curve, "at", "brier", float(bins)), precision_recall(final, "score", "positive").select("pr_auc"), roc(final, "score", "positive"))
    out = samples.agg(F.count_if(F.col("d") == event).alias("events")).withColumn("event", F.lit(event))
    for part in parts:  # one row each
        out = out.crossJoin(F.broadcast(part))
    return out


def weighted_over_events(metrics: DataFrame, value: str) -> DataFrame:
    """One row: the plain mean over events and the one weighted by their numbers; missing values don't count."""
    known = metrics.filter(F.col(value).isNotNull() & ~F.isnan(value))
    return known.agg(F.avg(value).alias("macro"), F.try_divide(F.sum(F.col(value) * F.col("events")), F.sum("events")).alias("weighted"))
