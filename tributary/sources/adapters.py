"""Canonical transfers from driver tables.

``ledger``: line items joined to their orders, day granularity.  ``event_log``: events with
the counterparty in their JSON properties, second granularity.  Both give txn_id, sender_id,
receiver_id, amount_cents, ts (unix seconds), rail and event_type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["txn_id", "sender_id", "receiver_id", "amount_cents", "ts", "rail", "event_type"]


def epoch(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


def txn_id(ts: Column, sender: Column, receiver: Column, amount: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", ts, sender, receiver, amount), 256), 1, 40)


def distinct_transfers(df: DataFrame) -> DataFrame:
    """Canonical transfers once each.  Equal ids are equal accounts, times and amounts, so rows are compared by these and dealt
    out by the pair of accounts: flows grouped from them need no further shuffle, and ids are made for what is left."""
    rows = df.drop("txn_id").repartition("sender_id", "receiver_id").dropDuplicates(["sender_id", "receiver_id", "ts", "amount_cents"])
    return _canonical(rows)


def _canonical(df: DataFrame) -> DataFrame:
    return df.withColumn("txn_id", txn_id(*[F.col(c) for c in ("ts", "sender_id", "receiver_id", "amount_cents")])).select(*COLUMNS)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    return _canonical(
        items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).select(
            F.concat(F.lit("A"), "o_custkey").alias("sender_id"),
            F.concat(F.lit("A"), "l_suppkey").alias("receiver_id"),
            F.round(F.col("l_extendedprice") * 100).cast("long").alias("amount_cents"),
            epoch(F.col("l_shipdate")).alias("ts"),
            F.col("l_returnflag").alias("rail"),
            F.lit("SETTLEMENT").alias("event_type"),
        )
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return _canonical(
        events.select(
            F.concat(F.lit("A"), "user_id").alias("sender_id"),
            F.concat(F.lit("A"), F.get_json_object("props", "$.k")).alias("receiver_id"),
            F.round(F.col("value") * 100).cast("long").alias("amount_cents"),
            epoch(F.col("ts")).alias("ts"),
            F.col("event_type").alias("rail"),
            F.lit("SETTLEMENT").alias("event_type"),
        ).filter("amount_cents > 0")
    )


#: The same in DuckDB SQL, as common table expressions t and e.
SQL_T = """t AS (SELECT substr(sha256(ts || '|' || sender_id || '|' || receiver_id || '|' || amount_cents), 1, 40) AS txn_id, * FROM (
  SELECT 'A' || o_custkey AS sender_id, 'A' || l_suppkey AS receiver_id, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_cents,
  CAST(epoch(l_shipdate) AS BIGINT) AS ts, l_returnflag AS rail, 'SETTLEMENT' AS event_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey))"""
SQL_E = """e AS (SELECT substr(sha256(ts || '|' || sender_id || '|' || receiver_id || '|' || amount_cents), 1, 40) AS txn_id, * FROM (
  SELECT 'A' || user_id AS sender_id, 'A' || json_extract_string(props, '$.k') AS receiver_id, CAST(round(value * 100) AS BIGINT) AS amount_cents,
  CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_type AS rail, 'SETTLEMENT' AS event_type FROM events) WHERE amount_cents > 0)"""


def sql_flows(table: str, name: str) -> str:
    return f"""{name} AS (SELECT sender_id AS src, receiver_id AS dst, count(*) AS tx_count, CAST(sum(amount_cents) AS BIGINT) AS total_amount,
  min(ts) AS first_ts, max(ts) AS last_ts, min(amount_cents) AS min_amount, max(amount_cents) AS max_amount, arg_min(rail, (ts, txn_id)) AS rail
  FROM {table} GROUP BY ALL)"""


SQL_FT, SQL_FE = sql_flows("t", "ft"), sql_flows("e", "fe")
