"""Names, queries and their SQL twins; inputs that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators.flows import flows_of
from tributary.session import stage
from tributary.sources import adapters as ad

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def with_(body: str, *tables: str) -> str:
    """The statement after the common tables it needs."""
    return "WITH " + ",\n".join(tables) + "\n" + body


def T(spark: SparkSession, d: str) -> DataFrame:
    return ad.ledger(spark, d)


def E(spark: SparkSession, d: str) -> DataFrame:
    return ad.event_log(spark, d)


def FT(spark: SparkSession, d: str) -> DataFrame:
    return flows_of(ad.distinct_transfers(T(spark, d)))


def FE(spark: SparkSession, d: str) -> DataFrame:
    return flows_of(ad.distinct_transfers(E(spark, d)))


def staged_flows(spark: SparkSession, d: str) -> DataFrame:
    """Flows of the ledger as a table, for queries that read them several times."""
    return stage(FT(spark, d), "flows")


def accounts(spark: SparkSession, d: str) -> DataFrame:
    """Accounts with made-up properties that follow from the customer's number."""
    k = F.col("c_custkey")
    return spark.read.parquet(f"{d}/customer.parquet").select(
        F.concat(F.lit("A"), k).alias("account"),
        F.concat(F.lit("c"), k % 50).alias("community_id"),
        F.when(k % 3 != 0, (k * 37 % 1000) / 1000.0).alias("gnn_risk_score"),
        (k % 17 == 0).alias("in_cycle"),
        F.when(k % 5 == 0, (k * 13 % 100) / 100.0).alias("risk_score"),
        F.lit(None).cast("string").alias("risk_tier"),
        F.lit(None).cast("string").alias("gnn_risk_tier"),
        F.when(k % 4 != 0, F.element_at(F.array(*map(F.lit, ["low", "medium", "high", "critical"])), (k % 4 + 1).cast("int"))).alias("tier"),
        F.when(k % 6 == 0, F.element_at(F.array(*map(F.lit, TYPOLOGIES)), (k % 8 + 1).cast("int"))).alias("typology"),
        F.array(F.element_at(F.array(*map(F.lit, ["Account", "Merchant", "Bank", "Exchange"])), (k % 4 + 1).cast("int"))).alias("labels"),
    )


TYPOLOGIES = ["FAN-OUT", "FAN-IN", "GATHER-SCATTER", "SCATTER-GATHER", "CYCLE", "RANDOM", "BIPARTITE", "STACK"]
SQL_ACC = f"""acc AS (SELECT 'A' || c_custkey AS account, 'c' || (c_custkey % 50) AS community_id, CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey * 37 % 1000) / 1000.0::DOUBLE END AS gnn_risk_score,
  c_custkey % 17 = 0 AS in_cycle, CASE WHEN c_custkey % 5 = 0 THEN (c_custkey * 13 % 100) / 100.0::DOUBLE END AS risk_score,
  CASE WHEN c_custkey % 4 <> 0 THEN ['low', 'medium', 'high', 'critical'][c_custkey % 4 + 1] END AS tier,
  CASE WHEN c_custkey % 6 = 0 THEN {TYPOLOGIES}[c_custkey % 8 + 1] END AS typology,
  [['Account', 'Merchant', 'Bank', 'Exchange'][c_custkey % 4 + 1]] AS labels FROM customer)"""


def flags(spark: SparkSession, d: str) -> DataFrame:
    """A made-up flag of every customer."""
    k = F.col("c_custkey")
    pick = lambda xs, e: F.element_at(F.array(*map(F.lit, xs)), e.cast("int"))
    return spark.read.parquet(f"{d}/customer.parquet").select(
        F.sha2(F.concat(F.lit("f"), k), 256).alias("fingerprint"),
        pick(["CYCLE", "COMMUNITY", "AGGREGATE"], k % 3 + 1).alias("flag_type"),
        F.array(F.concat(F.lit("A"), k), F.concat(F.lit("A"), k + 1)).alias("account_ids"),
        pick(["low", "medium", "high", "critical"], k / 10 % 4 + 1).alias("risk_level"),
        (k % 100 / 100.0).alias("risk_score"),
        F.concat(F.lit("Flag of "), k).alias("explanation"),
        F.concat(F.lit('{"community_id": "c'), k % 50, F.lit('", "flagged_member_count": '), k % 9, F.lit("}")).alias("details"),
        F.when(k % 70 == 0, "closed").otherwise("open").alias("status"),
        (k * 1000).alias("first_detected_at"),
        (k * 1000).alias("last_detected_at"),
        F.lit(1).alias("detection_count"),
    )


SQL_FLAG = """flag AS (SELECT sha256('f' || c_custkey) AS fingerprint, ['CYCLE', 'COMMUNITY', 'AGGREGATE'][c_custkey % 3 + 1] AS flag_type, ['A' || c_custkey, 'A' || (c_custkey + 1)] AS account_ids,
  ['low', 'medium', 'high', 'critical'][c_custkey // 10 % 4 + 1] AS risk_level, (c_custkey % 100) / 100.0::DOUBLE AS risk_score, 'Flag of ' || c_custkey AS explanation,
  '{"community_id": "c' || (c_custkey % 50) || '", "flagged_member_count": ' || (c_custkey % 9) || '}' AS details, CASE WHEN c_custkey % 70 = 0 THEN 'closed' ELSE 'open' END AS status,
  c_custkey * 1000 AS first_detected_at, c_custkey * 1000 AS last_detected_at FROM customer)"""


def reference(df: DataFrame, column: str = "last_ts", p: float = 0.999) -> int:
    """T5: queries anchor to their data, never to the clock."""
    return df.select(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})").cast("long")).first()[0] or 0


SQL_REF_E = "ref AS (SELECT quantile_disc(last_ts, 0.999) AS r FROM fe)"
SQL_REF_T = "ref AS (SELECT quantile_disc(last_ts, 0.999) AS r FROM ft)"
