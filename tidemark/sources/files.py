"""File sources and sinks: pruned scans, unions, shards, checkpoints of settings."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.running import numbered
from tidemark.storage import filesystem

MESSAGES = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("ts_event", T.LongType()),
        T.StructField("instrument_id", T.IntegerType()),
        T.StructField("publisher_id", T.IntegerType()),
        T.StructField("order_id", T.LongType()),
        T.StructField("action", T.StringType()),
        T.StructField("side", T.StringType()),
        T.StructField("price", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("flags", T.IntegerType()),
    ]
)


def read_messages(spark: SparkSession, path: str, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """Messages with start <= ts_event < end; the bounds reach the scan. Records without a time stay only without a start."""
    rows = spark.read.schema(MESSAGES).parquet(path)
    if start_ns is not None:
        rows = rows.filter(F.col("ts_event") >= start_ns)
    if end_ns is not None:
        rows = rows.filter((F.col("ts_event") < end_ns) | (F.col("ts_event").isNull() if start_ns is None else F.lit(False)))
    return rows


def read_columns(spark: SparkSession, path: str, wanted: Sequence[str]) -> DataFrame:
    """Those of the wanted columns that the files have."""
    rows = spark.read.parquet(path)
    return rows.select(*(c for c in wanted if c in rows.columns))


def read_union(spark: SparkSession, paths: Sequence[str], name: str | None = None) -> DataFrame:
    """Parquet files by column name, columns in alphabetical order if there are several, with the file's name where asked for."""
    parts = [spark.read.parquet(p) for p in paths]
    if name:
        parts = [p.withColumn(name, F.col("_metadata.file_name")) for p in parts]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.select(*sorted(out.columns)) if len(parts) > 1 else out


def latency_of(path: Column) -> Column:
    """Milliseconds in a file name such as ``latency_0p25ms``; null if there are none."""
    return F.replace(F.nullif(F.regexp_extract(path, r"latency_([0-9]+(?:p[0-9]+)?)ms", 1), F.lit("")), F.lit("p"), F.lit(".")).cast("double")


def read_summaries(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """CSV summaries with the latency of their file, which must be in its name."""
    paths = [path for _, path in by_latency(spark, pattern)]
    rows = spark.read.schema(schema).csv(paths, header=True)
    return rows.withColumn("latency_ms", latency_of(F.input_file_name()))


def by_latency(spark: SparkSession, pattern: str) -> list[tuple[float, str]]:
    """(milliseconds, path) of the files of a pattern, sorted by the latency in their names; none, or a name without one, is an error."""
    files, where = filesystem(spark, pattern)
    paths = sorted(x.getPath().toString() for x in files.globStatus(where) or [])
    if not paths:
        raise FileNotFoundError(pattern)
    found = []
    for path in paths:
        known = re.search(r"latency_([0-9]+(?:p[0-9]+)?)ms", path.rpartition("/")[2])
        if not known:
            raise ValueError(f"no latency in the name of {path}")
        found.append((float(known[1].replace("p", ".")), path))
    return sorted(found)


def read_raw_results(spark: SparkSession, pattern: str) -> DataFrame:
    """Raw results of each latency as one table, by column name, with ``latency_ms``."""
    parts = [spark.read.parquet(path).withColumn("latency_ms", F.lit(ms)) for ms, path in by_latency(spark, pattern)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_configs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a stable config_id, each setting once."""
    rows = spark.read.schema(schema).json(path)
    columns = sorted(rows.columns)
    return rows.withColumn("config_id", F.substring(F.md5(F.to_json(F.struct(*columns))), 1, 12)).dropDuplicates(["config_id"])


def companion(path: str) -> str:
    """The training file beside a test file."""
    head, slash, name = path.rpartition("/")
    return head + slash + name.replace("_test", "_train", 1)


def write_splits(rows: DataFrame, path: str, by: str = "dataset_split") -> None:
    """One folder for each split, zstd, never over existing data."""
    rows.write.mode("errorifexists").option("compression", "zstd").partitionBy(by).parquet(path)


def setting_key(threshold: Column, horizon: Column) -> Column:
    """Twelve digits of the threshold, without zeros at their end, and the horizon."""
    digits = F.regexp_replace(F.format_string("%.12g", threshold), r"\.?0+(e[+-][0-9]+)?$", "$1")
    return F.concat_ws("|", digits, horizon.cast("string"))


def not_done(settings: DataFrame, done: DataFrame, key: str = "key") -> DataFrame:
    """Settings without a result yet."""
    return settings.join(done.select(key).distinct(), key, "left_anti")


def row_slice(rows: DataFrame, order: str, *, offset: int = 0, limit: int | None = None, fraction: float = 1.0, seed: int = 0) -> DataFrame:
    """Rows after ``offset``, at most ``limit``, then a seeded sample, in order. ``order`` numbers rows uniquely."""
    out = numbered(rows, [], [order], "__number").filter(F.col("__number") >= offset)
    out = (out if limit is None else out.filter(F.col("__number") < offset + limit)).drop("__number")
    if fraction < 1:
        out = out.filter(F.pmod(F.xxhash64(F.lit(seed), order), F.lit(1_000_000)) < int(fraction * 1_000_000))
    return out.orderBy(order)


def job_id(path: Column) -> Column:
    """The job's number in a result file's name such as ``results_job_12_shard3``; null if there is none."""
    return F.nullif(F.regexp_extract(path, r"job_?([0-9]+)", 1), F.lit("")).cast("long")


def read_shards(spark: SparkSession, path: str, jobs: Sequence[int]) -> DataFrame:
    """Result shards of the given jobs only."""
    rows = spark.read.parquet(path)
    return rows.withColumn("job_id", job_id(F.col("_metadata.file_name"))).filter(F.col("job_id").isin(*jobs))


def renamed(rows: DataFrame, aliases: dict[str, Sequence[str]], required: Sequence[str] = ()) -> DataFrame:
    """``rows`` with the first present alias of each name under that name; what is required and missing raises."""
    for name, others in aliases.items():
        if name not in rows.columns:
            known = next((x for x in others if x in rows.columns), None)
            rows = rows.withColumnRenamed(known, name) if known else rows
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows


def only_modes(rows: DataFrame, modes: Sequence[str], known: Sequence[str] = ("moving_window", "market_depth", "raw_top5", "diff_top5")) -> DataFrame:
    """``rows`` without the representation columns of the modes that aren't wanted."""
    unwanted = [m for m in known if m not in modes]
    return rows.drop(*(c for c in rows.columns if any(c in (f"entry_representation_{m}", f"lob_sequence_{m}") for m in unwanted)))


def split_cache(spark: SparkSession, path: str, build) -> dict:
    """Split points of a feed: the table at ``path`` (split_points, messages_between_splits, total_messages) if it is whole, else what ``build`` returns, written there."""
    from pyspark.errors import AnalysisException

    schema = "split_points array<long>, messages_between_splits array<long>, total_messages long"
    try:
        row = spark.read.schema(schema).json(path).first()
    except AnalysisException:
        row = None
    if row and row.total_messages is not None and row.split_points is not None and len(row.messages_between_splits or []) == len(row.split_points) + 1:
        return row.asDict()
    made = build()
    spark.createDataFrame([(made["split_points"], made["messages_between_splits"], made["total_messages"])], schema).coalesce(1).write.mode("overwrite").json(path)
    return made


def write_flushed(rows: DataFrame, path: str, rows_each: int = 100_000) -> None:
    """Parquet files of at most ``rows_each`` rows, never over existing data."""
    rows.write.mode("errorifexists").option("maxRecordsPerFile", rows_each).parquet(path)


def merge_chunks(spark: SparkSession, paths: Sequence[str], target: str) -> None:
    """The chunks' files as one table, columns that some lack as null, in the order of the chunks; then the chunks go."""
    parts = [spark.read.parquet(p).withColumn("chunk", F.lit(k)) for k, p in enumerate(paths)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    out.write.mode("errorifexists").partitionBy("chunk").parquet(target)
    for path in paths:
        files, where = filesystem(spark, path)
        files.delete(where, True)


def merge_counted(spark: SparkSession, paths: Sequence[str], target: str, by: str = "event_type") -> list[dict[int, int]]:
    """Append files to one table one after the other; the counts of ``by`` in it after each of them."""
    running: dict = {}
    out = []
    for path in paths:
        rows = spark.read.parquet(path)
        rows.write.mode("append").parquet(target)
        for r in rows.groupBy(by).count().collect():  # a row for each kind
            running[r[by]] = running.get(r[by], 0) + r["count"]
        out.append(dict(running))
    return out


def replace_file(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place and move it there at once: it is never half written."""
    files, where = filesystem(spark, path)
    _, beside = filesystem(spark, f"{path}.tmp")
    stream = files.create(beside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    files.delete(where, False)
    if not files.rename(beside, where):
        raise OSError(f"can't move {beside.toString()} to {path}")


def write_settings(results: DataFrame, path: str) -> None:
    """A result row for each setting as CSV, at once: what ``not_done`` resumes from. Settings are few."""
    frame = results.toPandas()
    replace_file(results.sparkSession, path, frame.to_csv(index=False))


def write_samples(parts: dict[str, DataFrame], path: str, metadata: dict) -> None:
    """A folder for each part, and ``metadata.json`` with the numbers of their rows, written last: a folder without it isn't whole."""
    spark, counts = next(iter(parts.values())).sparkSession, {}
    for name, rows in parts.items():
        rows.write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/{name}")
        counts[name] = spark.read.parquet(f"{path}/{name}").count()
    replace_file(spark, f"{path}/metadata.json", json.dumps(metadata | {"rows": counts}, sort_keys=True))


def write_report(results: DataFrame, summary: DataFrame, raw_path: str, summary_path: str) -> None:
    """All results as Parquet and their summary, a few rows, as CSV."""
    results.write.mode("overwrite").parquet(raw_path)
    replace_file(results.sparkSession, summary_path, summary.toPandas().to_csv(index=False))
