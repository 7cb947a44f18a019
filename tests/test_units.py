import pytest
from pyspark.sql import functions as F

from tidemark.functions import book
from tidemark.functions.names import suffix
from tidemark.operators import asof, backtest, labels, reports, samples
from tidemark.sources import files


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def maps(spark, bids, asks):
    kind = "map<bigint,double>"
    return spark.createDataFrame([(bids, asks)], f"bids {kind}, asks {kind}")


def test_suffixes():
    assert [suffix(w) for w in (1, 500, 1000, 30000, 60000)] == ["1ms", "500ms", "1.0s", "30.0s", "60s"]


def test_features_of_an_empty_side(spark):
    rows = maps(spark, {100: 5.0}, {})
    b, a = F.col("bids"), F.col("asks")
    assert book.add_microstructure(rows).first().features == [0.0] * 10
    assert rows.select(book.top_differences(b, a)).first()[0][2:4] == [100.0, 5.0]


def test_market_depth_has_zero_at_the_center(spark):
    rows = maps(spark, {100: 5.0, 99: 2.0}, {101: 3.0, 103: 4.0})
    got = rows.select(book.market_depth(F.col("bids"), F.col("asks"), F.lit(100), 1, 3)).first()[0]
    assert got == [-2.0, -2.0, -2.0, 0.0, 3.0, 3.0, 7.0]


def test_padding_keeps_the_last_rows(spark):
    rows = F.array(*(F.array(F.lit(float(k))) for k in range(3)))
    assert one(spark, book.pad_left(rows, 5, 1)) == [[0.0], [0.0], [0.0], [1.0], [2.0]]
    assert one(spark, book.pad_left(rows, 2, 1)) == [[1.0], [2.0]]
    assert one(spark, book.window_ending(rows, F.lit(1), 3, 1)) == [[0.0], [0.0], [1.0]]


def test_row_widths_are_checked(spark):
    with pytest.raises(Exception, match="wide"):
        one(spark, book.checked(F.array(F.array(F.lit(1.0))), 2))


def test_spaced_indices(spark):
    assert one(spark, samples.spaced(F.lit(4), 2)) == [0, 3]
    assert one(spark, samples.spaced(F.lit(3), 5)) == [0, 1, 2]


def test_manifest_golden(spark):
    log = [0.0] + [F.log1p(F.lit(1000.0))] * 5
    rows = spark.range(1).select(F.lit(1).alias("source_row"), F.lit(9).alias("order_id"), F.lit(10.0).alias("duration_s"), F.lit(1).alias("event_type"), F.array(*(F.lit(x) if isinstance(x, float) else x for x in log)).alias("gap_logs"))
    got = samples.manifest(rows, lookback=3, most=2).orderBy("update_idx").collect()
    assert [r.update_idx for r in got] == [0, 3] and [round(r.remaining_s, 6) for r in got] == [10.0, 7.0]


def test_gap_column():
    assert samples.gap_column(3) == 2 and samples.gap_column(12) == 10 and samples.gap_column(4, -1) == 3
    with pytest.raises(IndexError):
        samples.gap_column(3, 5)


def test_cuts_grow_strictly():
    assert samples.finish_cuts([0.0, 1.0, 1.0, 2.0], 0.0, 2.0)[2] > 1.0
    assert samples.finish_cuts([1.0, 1.0], 1.0, 1.0)[0] == 1.0


def test_discretize(spark):
    cuts = [0.0, 1.0, 2.0]
    rows = spark.createDataFrame([(0.5, 1), (0.5, 0), (3.0, 1), (2.0, 2)], "t double, e int")
    assert [tuple(r) for r in rows.select(*samples.discretize(F.col("t"), F.col("e"), cuts)).collect()] == [(1, 1), (0, 0), (2, 0), (2, 2)]


def test_three_days_split_one_each(spark):
    rows = spark.createDataFrame([(f"2025-01-0{d}",) for d in (1, 2, 3) for _ in range(3)], "day string")
    got = labels.split_days(rows, labels.day_cuts(rows)).groupBy("dataset_split").count().collect()
    assert sorted(r["count"] for r in got) == [3, 3, 3]
    two = rows.filter("day < '2025-01-03'")
    assert labels.day_cuts(two).first().train_last is None


def test_labels_without_quotes_are_censored(spark):
    schema = "order_id int, status_reason string, duration_s double, side string, price long, best_bid_at_entry long, best_ask_at_entry long, best_bid_at_execution long, best_ask_at_execution long, best_bid_at_post_trade long, best_ask_at_post_trade long"
    rows = [
        (1, "FILLED", 1.0, "B", 100, 99, 101, 99, 101, 98, 100),
        (2, "FILLED", 1.0, "B", 100, 99, 101, 99, 101, 100, 102),
        (3, "FILLED", 1.0, "B", 100, 99, 101, None, 101, 98, 100),
        (4, "FILLED", 0.05, "A", 100, 99, 101, None, 101, 98, 100),
        (5, "CENSORED_TIME", 1.0, "B", 100, 99, 101, 99, 101, 98, 100),
        (6, "FILLED", 1.0, "X", 100, 99, 101, 99, 101, 98, 100),
    ]
    got = {r.order_id: (r.event_type, r.labeling_valid) for r in labels.label(spark.createDataFrame(rows, schema), None).collect()}
    assert got == {1: (2, True), 2: (1, True), 3: (0, False), 4: (1, True), 5: (0, None), 6: (0, False)}


def test_forward_asof_over_stretches(spark):
    left = spark.createDataFrame([("a", 5), ("a", 95), ("a", 999), ("b", 1)], "k string, t long")
    right = spark.createDataFrame([("a", 5, 1, 10), ("a", 5, 0, 9), ("a", 500, 2, 11)], "k string, ts long, seq long, v long")
    got = {(r.k, r.t): r.next_v for r in asof.forward(left, right, by=["k"], at="t", time="ts", values=["v"], tie="seq", width=50).collect()}
    assert got == {("a", 5): 9, ("a", 95): 11, ("a", 999): None, ("b", 1): None}


def test_interval_join_is_open_at_the_start(spark):
    spans = spark.createDataFrame([(1, 0, 10)], "k int, a long, b long")
    points = spark.createDataFrame([(1, 0), (1, 1), (1, 10), (1, 11)], "k int, t long")
    assert sorted(r.t for r in asof.within(spans, points, by=["k"], start="a", end="b", time="t", width=4).collect()) == [1, 10]


def test_holm_and_sign_flip(spark):
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p_value double")
    got = {r.name: round(r.holm_p, 6) for r in reports.holm(tests).collect()}
    assert got == {"a": 0.03, "c": 0.06, "b": 0.06}
    flips = reports.sign_flip(spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "difference double")).first()
    assert flips.n == 3 and flips.p_value == pytest.approx(3 / 9)


def test_a_missing_baseline_raises(spark):
    rows = spark.createDataFrame([("x", 1.0, 2.0)], "k string, latency double, v double")
    with pytest.raises(Exception, match="baseline"):
        reports.against_baseline(rows, ["k"], "latency", "v").collect()


def test_latest_valid_quotes(spark):
    seq = F.array(*(F.array(*map(F.lit, r)) for r in ([101.0, 1.0, 99.0, 1.0], [0.0, 0.0, 98.0, 1.0])))
    assert one(spark, backtest.valid_quotes(seq))[:] == (101.0, 99.0)
    assert one(spark, backtest.valid_quotes(seq, F.lit(1))) is None


def test_sources(spark, tmp_path):
    assert files.companion("/data/x_test/y_test.parquet") == "/data/x_test/y_train.parquet"
    assert one(spark, files.latency_of(F.lit("a/latency_0p25ms.csv"))) == 0.25 and one(spark, files.latency_of(F.lit("none"))) is None
    spark.createDataFrame([(1, 2)], "a int, b int").write.parquet(str(tmp_path / "p"))
    spark.createDataFrame([(3, 4)], "c int, a int").write.parquet(str(tmp_path / "q"))
    assert files.read_columns(spark, str(tmp_path / "p"), ["b", "z"]).columns == ["b"]
    assert files.read_union(spark, [str(tmp_path / "p"), str(tmp_path / "q")]).columns == ["a", "b", "c"]
    rows = spark.range(100)
    assert [r.id for r in files.row_slice(rows, "id", offset=10, limit=3).collect()] == [10, 11, 12]
    (tmp_path / "c.jsonl").write_text('{"x": 1}\n{"x": 1}\n{"x": 2}\n')
    assert files.read_configs(spark, str(tmp_path / "c.jsonl"), "x int").count() == 2
    files.write_splits(spark.createDataFrame([("train", 1)], "dataset_split string, v int"), str(tmp_path / "s"))
    with pytest.raises(Exception):
        files.write_splits(spark.createDataFrame([("train", 1)], "dataset_split string, v int"), str(tmp_path / "s"))


def test_losses_and_bins(spark):
    from tidemark.operators import survival

    with pytest.raises(ValueError):
        survival.total_loss(1, 1, 1, alpha=1, sigma=0, beta=1)
    assert survival.total_loss(1, 2, 3, alpha=0.5, sigma=1, beta=1) == 5
    assert survival.nearest_bins([0, 1, 2], [0.5, 1.6, 9]) == [0, 2, 2] and [survival.bounded_bin(k, 5) for k in (-1, 9, -9, 2)] == [4, 4, 0, 2]
    pmf = spark.range(1).select(survival.softmax(F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0)))).alias("p"))
    p, c = pmf.select("p", survival.cumulated(survival.event_pmf(F.col("p"), 2, 2))).first()
    assert sum(p) == pytest.approx(1) and c == sorted(c)
    rows = spark.createDataFrame([(1, 0, 3.0, True), (1, 1, 5.0, True), (2, 2, 9.0, False)], "order_id int, i int, squared_error double, valid boolean")
    assert survival.next_step_loss(rows, beta=2.0).first()[0] == 8.0


def test_permuting_keeps_the_values(spark):
    from tidemark.operators import survival

    rows = spark.range(200).withColumn("v", F.col("id") * 3)
    got = survival.permuted(rows, "v", "id", 5).collect()
    assert sorted(r.v for r in got) == [3 * k for k in range(200)] and any(r.v != 3 * r.id for r in got)


def test_batches_hold_whole_orders(spark):
    rows = spark.createDataFrame([(k // 3, k) for k in range(90)], "order_id int, i int")
    got = samples.order_batches(rows, 5, 1)
    assert got.groupBy("order_id").agg(F.count_distinct("batch").alias("n")).filter("n > 1").count() == 0
    assert got.count() == 90


def test_prepared_parts_and_windows(spark):
    rows = [(k, k, 1.0 + k, k % 3, "train" if k < 8 else "val" if k < 10 else "test", [0.0, 1.0, 1.0], [[float(j)] for j in range(3)]) for k in range(12)]
    orders = spark.createDataFrame(rows, "source_row int, order_id int, duration_s double, event_type int, dataset_split string, gap_logs array<double>, rows array<array<double>>")
    made = samples.prepare(orders, lookback=2, bins=4, most=1)
    assert made["parts"]["train"].count() == 8 and made["parts"]["test"].count() == 4 and len(made["cuts"]) == 4
    windows = samples.materialize(made["parts"]["test"], orders, lookback=2, width=1).collect()
    assert {tuple(map(tuple, w.window)) for w in windows} == {((0.0,), (1.0,)), ((1.0,), (2.0,))}


def test_latency_deadlines_chunks_and_coverage(spark):
    at = F.lit(100).cast("long")
    assert one(spark, backtest.StaticLatency.microseconds(1.5).at(at)) == 1600 and one(spark, backtest.StaticLatency.milliseconds(1).at(at)) == 1_000_100
    row = spark.createDataFrame([(5,)], "m long")
    assert row.select(backtest.MeasuredLatency("m", 9).at(at)).first()[0] == 109
    assert one(spark, backtest.deadline(F.lit(0), F.lit(10**10), [None, 2.0])) == 2 * 10**9
    assert backtest.overlapping([(None, 10), (10, 20), (20, None)], 10, 20) == [1, 2]
    feed = spark.createDataFrame([(1,), (9,)], "ts_event long")
    orders = spark.createDataFrame([(1, 9)], "entry_time long, deadline long")
    backtest.check_coverage(feed, orders)
    with pytest.raises(ValueError):
        backtest.check_coverage(feed, orders.withColumn("deadline", F.lit(10)))


def test_decisions_are_flattened(spark):
    rows = spark.sql("select 1 as order_id, named_struct('action', 'submit', 'reason', 'x') as decision")
    assert reports.flattened(rows).columns == ["order_id", "decision_action", "decision_reason"]


def test_columns_shards_and_caches(spark, tmp_path):
    from tidemark.operators import flow

    assert one(spark, files.job_id(F.lit("results_job_12_shard3.parquet"))) == 12 and one(spark, files.job_id(F.lit("x"))) is None
    rows = spark.createDataFrame([(1, 2, 3)], "thr int, lob_sequence_raw_top5 int, lob_sequence_diff_top5 int")
    assert files.renamed(rows, {"threshold": ["t", "thr"]}, ["threshold"]).columns[0] == "threshold"
    with pytest.raises(ValueError):
        files.renamed(rows, {}, ["absent"])
    assert files.only_modes(rows, ["raw_top5"]).columns == ["thr", "lob_sequence_raw_top5"]
    made = {"split_points": [5], "messages_between_splits": [2, 3], "total_messages": 5}
    calls = []
    for _ in range(2):
        assert files.split_cache(spark, str(tmp_path / "cache"), lambda: calls.append(1) or made) == made
    assert len(calls) == 1
    assert flow.chunks([20, 30], [10, 20, 30, 40], [5, 35, 35, 20, 5]) == [(None, 20, 40), (20, 30, 35), (30, None, 25)]
    assert flow.chunks([], [], [7]) == [(None, None, 7)]
    assert spark.range(0).withColumn("size", F.lit(1)).agg(flow.market_is_empty()).first()[0]
