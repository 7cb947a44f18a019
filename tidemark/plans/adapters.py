"""The driver's tables as order-book inputs, for Spark and as SQL.

All values derive from keys and are whole numbers where both engines must agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.names import WINDOWS_MS, post_columns
from tidemark.storage import read


def _quiet(spark: SparkSession) -> SparkSession:
    """A session beside the user's, with its settings, in which constraints aren't propagated; the user's where its folder can't be shared."""
    beside, folder = spark.newSession(), "spark.checkpoint.dir"
    if beside.conf.get(folder, None) != spark.conf.get(folder, None):
        return spark
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            beside.conf.set(key, value)
    beside.conf.set("spark.sql.constraintPropagation.enabled", "false")
    return beside


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled-order shape from ``orders``.

    Its 36 columns are expressions over the same few, and Catalyst would derive
    every combination of them as constraints; stored columns have no such cost.
    So the table is of a session of its own, and the user's stays as it is.
    """
    spark = _quiet(spark)
    k = F.col("o_orderkey")
    price = F.round(F.col("o_totalprice") * 100).cast("long") + 100_000

    def unless(gone: Column, value: Column) -> Column:
        return F.when(~gone, value)

    columns = {
        "order_id": k,
        "day": F.to_date("o_orderdate"),
        "entry_time": F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000 + k % 86_400,
        "duration_s": (k * 37 % 100_000) / 1000.0,
        "status_reason": F.when(k % 4 < 2, "FILLED").when(k % 4 == 2, "CENSORED_TIME").otherwise("CENSORED_END"),
        "side": F.when(k % 2 == 0, "B").otherwise("A"),
        "ticker": F.concat(F.lit("T"), (F.col("o_custkey") % 5).cast("string")),
        "price": price,
        "best_bid_at_entry": unless(k % 101 == 0, price - 5 - k % 7),
        "best_ask_at_entry": unless(k % 101 == 0, price + 4 + k % 5),
        "best_bid_at_execution": unless(k % 97 == 0, price - 3 - k % 4),
        "best_ask_at_execution": unless(k % 97 == 0, price + 1 + k % 6),
    }
    for i, w in enumerate(WINDOWS_MS):
        gone = (k % 89 == 0) if i >= 6 else F.lit(False)
        bid = price + (k * 31 + i * 17) % 21 - 14
        columns[post_columns(w)[0]] = unless(gone, bid)
        columns[post_columns(w)[1]] = unless(gone, bid + 2 + (k + i) % 4)
    return read(spark, sf_dir, "orders").select(*(c.alias(name) for name, c in columns.items()))


def _orders_sql() -> str:
    price = "(CAST(round(o_totalprice * 100) AS BIGINT) + 100000)"
    k = "o_orderkey"
    rows = [
        f"{k} AS order_id",
        "CAST(o_orderdate AS DATE) AS day",
        f"epoch_us(o_orderdate) * 1000 + {k} % 86400 AS entry_time",
        f"({k} * 37 % 100000) / 1000.0::DOUBLE AS duration_s",
        f"CASE WHEN {k} % 4 < 2 THEN 'FILLED' WHEN {k} % 4 = 2 THEN 'CENSORED_TIME' ELSE 'CENSORED_END' END AS status_reason",
        f"CASE WHEN {k} % 2 = 0 THEN 'B' ELSE 'A' END AS side",
        "'T' || (o_custkey % 5) AS ticker",
        f"{price} AS price",
        f"CASE WHEN {k} % 101 <> 0 THEN {price} - 5 - {k} % 7 END AS best_bid_at_entry",
        f"CASE WHEN {k} % 101 <> 0 THEN {price} + 4 + {k} % 5 END AS best_ask_at_entry",
        f"CASE WHEN {k} % 97 <> 0 THEN {price} - 3 - {k} % 4 END AS best_bid_at_execution",
        f"CASE WHEN {k} % 97 <> 0 THEN {price} + 1 + {k} % 6 END AS best_ask_at_execution",
    ]
    for i, w in enumerate(WINDOWS_MS):
        gone = f"{k} % 89 = 0" if i >= 6 else "FALSE"
        bid = f"{price} + ({k} * 31 + {i * 17}) % 21 - 14"
        rows.append(f'CASE WHEN NOT ({gone}) THEN {bid} END AS "{post_columns(w)[0]}"')
        rows.append(f'CASE WHEN NOT ({gone}) THEN {bid} + 2 + ({k} + {i}) % 4 END AS "{post_columns(w)[1]}"')
    return "SELECT " + ", ".join(rows) + " FROM orders"


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Book levels from ``lineitem``: a book for each order key, F lines bid and O lines ask."""
    price = F.when(F.col("l_linestatus") == "F", 1000 - F.col("l_partkey") % 15).otherwise(1001 + F.col("l_partkey") % 15)
    side = F.when(F.col("l_linestatus") == "F", "B").otherwise("A")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book_id"), side.alias("side"), price.cast("long").alias("price"), F.col("l_suppkey").alias("publisher_id"), F.col("l_quantity").cast("long").alias("size"))
    return rows.groupBy("book_id", "side", "price", "publisher_id").agg(F.sum("size").alias("size"), F.count("*").alias("count"))


LEVELS_SQL = """SELECT l_orderkey AS book_id, CASE WHEN l_linestatus = 'F' THEN 'B' ELSE 'A' END AS side,
 CASE WHEN l_linestatus = 'F' THEN 1000 - l_partkey % 15 ELSE 1001 + l_partkey % 15 END AS price, l_suppkey AS publisher_id,
 CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS size, count(*) AS count FROM lineitem GROUP BY ALL"""


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages from ``events``: five instruments, actions by type, sizes by value."""
    e = F.col("event_id")
    kind = F.col("event_type")
    action = F.when(kind.isin("click", "view"), "A").when(kind == "purchase", "C").when(kind == "error", "T").otherwise("N")
    return read(spark, sf_dir, "events").select(
        e.alias("seq"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_event"),
        (F.col("user_id") % 5).cast("int").alias("instrument_id"),
        action.alias("action"),
        F.when(e % 2 == 0, "B").otherwise("A").alias("side"),
        (10_000 + e % 50 + F.floor(F.col("value")).cast("long") % 7).alias("price"),
        (1 + F.floor(F.col("value")).cast("long") % 9).alias("size"),
    )


TICKS_SQL = """SELECT event_id AS seq, epoch_us(ts) * 1000 AS ts_event, CAST(user_id % 5 AS INTEGER) AS instrument_id,
 CASE WHEN event_type IN ('click', 'view') THEN 'A' WHEN event_type = 'purchase' THEN 'C' WHEN event_type = 'error' THEN 'T' ELSE 'N' END AS action,
 CASE WHEN event_id % 2 = 0 THEN 'B' ELSE 'A' END AS side, 10000 + event_id % 50 + CAST(floor(value) AS BIGINT) % 7 AS price,
 1 + CAST(floor(value) AS BIGINT) % 9 AS size FROM events"""

BINS = 8


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits of two events over ``BINS`` bins, with outcome, from ``embeddings``."""
    v = F.col("vec_id")
    logit = F.transform(F.slice("embedding", 1, 2 * BINS), lambda x: x.cast("double") * 8)
    return read(spark, sf_dir, "embeddings").select(
        v.alias("sample"),
        F.floor(v / 3).cast("long").alias("order_id"),
        (v % 3).cast("int").alias("update_idx"),
        (F.pmod(v * 7, F.lit(BINS))).cast("int").alias("y_bin"),
        (F.col("label") % 3).cast("int").alias("d"),
        logit.alias("logits"),
    )


PREDICTIONS_SQL = f"""SELECT vec_id AS sample, CAST(floor(vec_id / 3) AS BIGINT) AS order_id, CAST(vec_id % 3 AS INTEGER) AS update_idx,
 CAST((vec_id * 7) % {BINS} AS INTEGER) AS y_bin, CAST(label % 3 AS INTEGER) AS d,
 list_transform(embedding[1:{2 * BINS}], lambda x: CAST(x AS DOUBLE) * 8) AS logits FROM embeddings"""

ORDERS_SQL = _orders_sql()


def with_views(body: str) -> str:
    """SQL whose query may read v_orders, v_levels, v_ticks and v_pred."""
    views = {"v_orders": ORDERS_SQL, "v_levels": LEVELS_SQL, "v_ticks": TICKS_SQL, "v_pred": PREDICTIONS_SQL}
    used = [f"{name} AS ({sql})" for name, sql in views.items() if name in body]
    head = ", ".join(used)
    body = body.strip()
    if not used:
        return body
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
