"""Sinks, listings, rankings and helpers: golden cases."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import book, coerce
from tidemark.functions.names import MICROSTRUCTURE, OF_BOOK, latency_grid
from tidemark.operators import backtest, reports, running, samples, survival
from tidemark.sources import files


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_results_are_listed_by_latency(spark, tmp_path):
    for name, v in (("latency_10ms", 1), ("latency_0p25ms", 2), ("latency_2ms", 3)):
        spark.createDataFrame([(v,)], "v int").coalesce(1).write.parquet(str(tmp_path / f"raw_{name}.parquet"))
    pattern = str(tmp_path / "raw_*")
    assert [ms for ms, _ in files.by_latency(spark, pattern)] == [0.25, 2.0, 10.0]
    assert {(r.latency_ms, r.v) for r in files.read_raw_results(spark, pattern).collect()} == {(0.25, 2), (2.0, 3), (10.0, 1)}
    with pytest.raises(FileNotFoundError):
        files.by_latency(spark, str(tmp_path / "none_*"))
    (tmp_path / "raw_other").mkdir()
    with pytest.raises(ValueError):
        files.by_latency(spark, pattern)


def test_summaries_need_a_latency(spark, tmp_path):
    (tmp_path / "s_latency_1p5ms.csv").write_text("a,b\n1,2\n")
    got = files.read_summaries(spark, str(tmp_path / "s_*"), "a int, b int").first()
    assert (got.a, got.b, got.latency_ms) == (1, 2, 1.5)
    (tmp_path / "s_plain.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        files.read_summaries(spark, str(tmp_path / "s_*"), "a int, b int")


def test_chunks_merge_in_order_and_go(spark, tmp_path):
    parts = [str(tmp_path / f"c{k}") for k in range(2)]
    spark.createDataFrame([(1, "a")], "k int, s string").write.parquet(parts[0])
    spark.createDataFrame([(2,)], "k int").write.parquet(parts[1])
    files.merge_chunks(spark, parts, str(tmp_path / "all"))
    assert [(r.chunk, r.k, r.s) for r in spark.read.parquet(str(tmp_path / "all")).orderBy("chunk").collect()] == [(0, 1, "a"), (1, 2, None)]
    assert not (tmp_path / "c0").exists() and not (tmp_path / "c1").exists()


def test_running_counts_of_a_merge(spark, tmp_path):
    paths = []
    for k, events in enumerate(([0, 1, 1], [2, 1])):
        paths.append(str(tmp_path / f"m{k}"))
        spark.createDataFrame([(e,) for e in events], "event_type int").write.parquet(paths[-1])
    assert files.merge_counted(spark, paths, str(tmp_path / "merged")) == [{0: 1, 1: 2}, {0: 1, 1: 3, 2: 1}]
    assert spark.read.parquet(str(tmp_path / "merged")).count() == 5


def test_flushed_files_settings_reports_and_samples(spark, tmp_path):
    files.write_flushed(spark.range(25).coalesce(1), str(tmp_path / "flushed"), 10)
    assert len(list((tmp_path / "flushed").glob("part-*"))) == 3
    done = spark.createDataFrame([("0.5|1", 1.0)], "key string, cost double")
    for _ in range(2):  # over the file that is there
        files.write_settings(done, str(tmp_path / "done.csv"))
    assert (tmp_path / "done.csv").read_text() == "key,cost\n0.5|1,1.0\n" and not list(tmp_path.glob("*.tmp"))
    settings = spark.createDataFrame([(0.5, 1), (0.25, 2)], "t double, h int").withColumn("key", files.setting_key(F.col("t"), F.col("h")))
    left = files.not_done(settings, spark.read.csv(str(tmp_path / "done.csv"), header=True))
    assert [r.h for r in left.collect()] == [2]
    keys = spark.createDataFrame([(0.1 + 0.2,), (100.0,), (0.0,), (1e-7,), (123456.75,)], "t double").select(files.setting_key(F.col("t"), F.lit(3)))
    assert [r[0] for r in keys.collect()] == [f"{x:.12g}|3" for x in (0.1 + 0.2, 100.0, 0.0, 1e-7, 123456.75)]
    files.write_report(done, done, str(tmp_path / "raw"), str(tmp_path / "summary.csv"))
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 1 and (tmp_path / "summary.csv").exists()
    files.write_samples({"train": spark.range(3), "val": spark.range(2)}, str(tmp_path / "set"), {"lookback": 5})
    assert json.loads((tmp_path / "set" / "metadata.json").read_text()) == {"lookback": 5, "rows": {"train": 3, "val": 2}}


def test_split_analysis_is_what_the_cache_keeps(spark):
    from tidemark.operators import flow

    rows = [(k, k * 10, 1, "A" if k % 4 == 0 else "C" if k % 4 == 2 else "T", 5) for k in range(16)]
    ticks = spark.createDataFrame(rows, "seq long, ts_event long, instrument_id int, action string, size long")
    got = flow.split_analysis(ticks, 3)
    assert got == {"split_points": [60, 100], "messages_between_splits": [6, 4, 6], "total_messages": 16}
    assert flow.split_analysis(ticks.limit(0), 3) == {"split_points": [], "messages_between_splits": [0], "total_messages": 0}


def test_days_without_fills_label_nothing(spark):
    from tidemark.functions.names import WINDOWS_MS, post_columns
    from tidemark.operators import labels

    base = "select id as order_id, date_add(date'2025-01-01', cast(id % 3 as int)) as day, if(id % 2 = 0, 'B', 'A') as side, 100L as price, 1.0D as duration_s, 99L as best_bid_at_entry, 101L as best_ask_at_entry, 99L as best_bid_at_execution, 101L as best_ask_at_execution"
    posts = ", ".join(f"98L as `{c}`" for w in WINDOWS_MS for c in post_columns(w))
    rows = spark.sql(f"{base}, {posts}, 98L as best_bid_at_post_trade, 100L as best_ask_at_post_trade, if(id < 9, 'FILLED', 'CENSORED_END') as status_reason from range(12)")
    assert labels.label_calibrated(rows.withColumn("status_reason", F.lit("CENSORED_END"))).count() == 0
    assert labels.label_calibrated(rows.filter("id is null" if "id" in rows.columns else "order_id < 0")).count() == 0
    done = labels.label_calibrated(rows)
    assert done.count() == 12 and {r.dataset_split for r in done.collect()} == {"train", "val", "test"}


def test_names_and_grids():
    assert len(MICROSTRUCTURE) == 12 and OF_BOOK[-1] == "significant_ask_levels" and MICROSTRUCTURE[10:] == ("time_delta_ms", "queue_position")
    grid = latency_grid()
    assert grid[:3] == [0.0, 0.01, 0.02] and grid[-1] == 50.0 and len(grid) == 15
    assert latency_grid("5, 1,1 ,0.25") == [0.25, 1.0, 5.0]


def test_coercion(spark):
    assert one(spark, coerce.whole(F.lit("-3.7"))) == -3 and one(spark, coerce.whole(F.lit("nan"))) is None and one(spark, coerce.whole(F.lit("x"))) is None
    assert one(spark, coerce.first_finite(F.lit(float("inf")), F.lit(None), F.lit("2.5"))) == 2.5
    assert one(spark, coerce.ns_text(F.lit(1_700_000_000_123_456_789))) == "2023-11-14 22:13:20.123456789+00:00"
    assert one(spark, coerce.ns_text(F.lit(-1_000_000_000))) == "1969-12-31 23:59:59+00:00"


def test_model_windows_check_widths_and_steps(spark):
    rows = F.array(F.array(F.lit(1.0)), F.array(F.lit(2.0)))
    got = one(spark, book.model_window(rows, rows, F.lit("A"), F.lit(0), 2, (1, 1)))
    assert got == [[0.0, 0.0, 0.0, 0.0], [1.0, 1.0, 0.0, 1.0]]
    with pytest.raises(Exception, match="wide"):
        one(spark, book.model_window(rows, rows, F.lit("A"), F.lit(0), 2, (2, 1)))
    none = F.array().cast("array<array<double>>")
    with pytest.raises(Exception, match="step"):
        one(spark, book.model_window(none, none, F.lit("A"), F.lit(0), 2, (1, 1)))
    s = one(spark, book.shape(F.array(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))))
    assert tuple(s) == (2, 1, 2, False)


def test_the_grid_of_a_sequence_is_that_of_its_last_book(spark):
    kind = "array<struct<bids:map<bigint,double>,asks:map<bigint,double>>>"
    rows = spark.createDataFrame([([({99: 1.0}, {101: 2.0}), ({9: 1.0}, {11: 4.0})],), ([({99: 1.0}, {101: 2.0}), ({9: 1.0}, {})],), ([],)], f"s {kind}")
    got = [r[0] for r in rows.select(book.on_one_grid(F.col("s"), "moving_window", tick=1, window=1)).collect()]
    assert got == [[[0.0, 0.0, 0.0], [-1.0, 0.0, 4.0]], [], []]
    padded = [r[0] for r in rows.select(book.on_one_grid(F.col("s"), "moving_window", tick=1, window=1, length=3)).collect()]
    assert [len(x) for x in padded] == [3, 3, 3] and padded[0][0] == [0.0, 0.0, 0.0]


def test_policies_of_snapshots(spark):
    assert [one(spark, samples.end_index(p, F.lit(7), 5)) for p in ("entry", "latest", "index:99", "index:-4")] == [4, 6, 6, 0]
    with pytest.raises(ValueError):
        samples.end_index("other", F.lit(7), 5)
    assert [one(spark, samples.clipped_length(F.lit(5), F.lit(x))) for x in ("3", "9", "0", "x")] == [3, 5, 5, 5]


def test_remaining_time_that_grows_raises(spark):
    rows = spark.createDataFrame([(1, 0, 5.0), (1, 1, 6.0)], "order_id int, update_idx int, remaining_s double")
    with pytest.raises(Exception, match="grows"):
        samples.require_falling(rows, ["order_id"], "update_idx", "remaining_s").collect()


def test_bins_and_padding(spark):
    assert samples.histogram_edges(2.0, 2.0, 2) == [1.5, 2.0, 2.5]
    edges = samples.histogram_edges(0.0, 10.0, 4)
    assert [one(spark, samples.digitized(F.lit(x), edges)) for x in (0.0, 2.5, 2.6, 10.0)] == [-1, 0, 1, 3]
    assert str(one(spark, samples.pad_right(F.array(F.lit(1.0)), 3))) == "[1.0, nan, nan]"
    rows = spark.createDataFrame([(-1,), (1,), (9,)], "b int")
    assert [r.seconds for r in samples.bin_seconds(rows, "b", [1.0, 2.0], clip=False).collect()] == [None, 2.0, None]


def test_a_missing_setting_raises_and_a_cache_computes_only_what_it_lacks(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "k string")
    settings = spark.createDataFrame([("a", 1, 5.0), ("a", 0, 7.0)], "k string, n int, v double")
    assert reports.setting_of(rows.filter("k = 'a'"), settings, ["k"], "n").first().v == 7.0
    with pytest.raises(Exception, match="no setting"):
        reports.setting_of(rows, settings, ["k"], "n").collect()
    asked = []
    cache = spark.createDataFrame([("a", 1)], "k string, p int")
    got = reports.cached(rows, cache, ["k"], lambda m: asked.append([r.k for r in m.collect()]) or m.withColumn("p", F.lit(2)))
    assert {(r.k, r.p) for r in got.collect()} == {("a", 1), ("b", 2)} and asked == [["b"]]


def test_limits_and_objectives(spark):
    rows = spark.createDataFrame([(1.0, None), (3.0, 1.0), (3.0, 9.0)], "a double, b double")
    held = reports.feasible({"a": (2.0, None), "b": (None, 5.0), "c": (1.0, None)}, rows.columns)
    assert [r[0] for r in rows.select(held).collect()] == [False, True, False]
    assert reports.objective(["x", "y"], ["q", "y"]) == "y"
    with pytest.raises(ValueError):
        reports.objective(["x"], ["q"])


def test_too_many_pairs_raise(spark):
    rows = spark.range(40).select(F.col("id").cast("double").alias("difference"))
    with pytest.raises(Exception, match="pairs"):
        reports.sign_flip(rows).collect()
    one_sided = reports.sign_flip(rows.filter("id between 1 and 5"), alternative="greater").first()
    assert one_sided.n == 5 and one_sided.p_value == pytest.approx(2 / 33)


def test_lifecycle_steps_and_chunk_ends(spark):
    assert one(spark, backtest.capped_steps(F.lit(12), F.lit(2), 2, None)) == [3, 5, 7, 9, 11]
    assert one(spark, backtest.capped_steps(F.lit(12), F.lit(2), 2, 2)) == [3, 11] and one(spark, backtest.capped_steps(F.lit(3), F.lit(2), 1, 2)) == []
    with pytest.raises(ValueError):
        backtest.capped_steps(F.lit(3), F.lit(2), 0, None)
    assert backtest.replay_end(100, 2.0, (1, 5)) == 100 + 2 * 10**9 + 5 * 10**6 and backtest.replay_end(None, 2.0, ()) is None


def test_running_sums_and_quantiles_over_ranges(spark):
    import numpy as np

    draw = np.random.default_rng(3)
    values = [(int(g), int(k), float(round(x, 1)), int(v)) for k, (g, x, v) in enumerate(zip(draw.integers(0, 3, 500), draw.normal(0, 3, 500), draw.integers(0, 9, 500)))]
    rows = spark.createDataFrame(values, "g int, k int, x double, v int").repartition(5)
    got = {r.k: (r.s, r.p) for r in running.lagged(running.running(rows, ["g"], ["x", "k"], {"s": F.col("v")}), ["g"], ["x", "k"], {"p": "v"}).collect()}
    for g in range(3):
        total, before = 0, None
        for _, k, _, v in sorted((r for r in values if r[0] == g), key=lambda r: (r[2], r[1])):
            total += v
            assert got[k] == (total, before)
            before = v
    back = {r.k: r.s for r in running.running(rows, ["g"], ["x", "k"], {"s": F.col("v")}, backwards=True).collect()}
    assert all(back[k] == sum(v for h, _, _, v in values if h == g) - got[k][0] for g, k, _, _ in values)
    q = {r.g: r.q for r in running.quantiles(rows, ["g"], "x", [0.0, 0.13, 0.5, 1.0]).collect()}
    for g in range(3):
        assert q[g] == pytest.approx(list(np.quantile([x for h, _, x, _ in values if h == g], [0.0, 0.13, 0.5, 1.0])))
    assert running.quantiles(rows.limit(0), [], "x", [0.5]).collect() == [] and running.numbered(rows.limit(0), ["g"], ["k"]).count() == 0


def test_losses_leave_pairs_of_one_order_out(spark):
    rows = [(0, 1, 0, 2, [0.1, 0.2, 0.3]), (1, 1, 2, 0, [0.0, 0.4, 0.5]), (2, 2, 2, 0, [0.2, 0.3, 0.3]), (3, 3, 1, 2, [0.1, 0.1, 0.2])]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "sample int, order_id int, y_bin int, d int, cif_2 array<double>, g int")
    pairs = [(a, b) for a in rows for b in rows if a[3] == 2 and b[2] > a[2] and a[1] != b[1]]
    got = survival.concordance(frame, 2, ["g"]).first()
    right = sum(1.0 if a[4][a[2]] > b[4][a[2]] else 0.5 if a[4][a[2]] == b[4][a[2]] else 0.0 for a, b in pairs)
    assert got.pairs == len(pairs) and got.concordance == pytest.approx(right / len(pairs))


def test_a_cluster_must_name_the_shared_folder(monkeypatch, spark):
    from tidemark import storage

    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.shared_dir(Session())
