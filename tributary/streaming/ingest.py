"""Payment events: validation, dead letters, matching, and streams into the ledger and the flows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.scoring import MODEL_BANDS, band
from tributary.operators import features as fe
from tributary.operators.flows import flows_of, induced, merge_flows
from tributary.operators.graph import neighbourhood

EVENT_SCHEMA = (
    "event_id string, event_type string, sender_id string, receiver_id string, amount_cents long, currency string, timestamp_utc string, authorization_code string, "
    "approved boolean, terminal_id string, merchant_category_code string, merchant_name string, settlement_amount_cents long, settled_at_utc string, _corrupt string"
)
BTC = r"^[13][a-km-zA-HJ-NP-Z1-9]{25,33}$|^bc1[ac-hj-np-z02-9]{6,87}$"
ETH = r"^0x[0-9a-fA-F]{40}$"


def wallet_ok(chain: Column, address: Column) -> Column:
    """P3."""
    return F.when(chain == "BITCOIN", address.rlike(BTC)).when(chain == "ETHEREUM", address.rlike(ETH)).otherwise(F.lit(False))


def normalise(raw: DataFrame, value: str = "value") -> DataFrame:
    """JSON to event columns with ``errors``, the rules it breaks; a row without errors is valid."""
    e = F.from_json(F.col(value), EVENT_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = raw.select(F.col(value).alias("payload"), F.inline(F.array(e)))  # a filter is not pushed below it, where it would parse anew for each column
    kind = F.upper(F.trim("event_type"))
    size = lambda c, lo, hi: F.coalesce(F.length(c), F.lit(0)).between(lo, hi)
    offset = lambda c: F.col(c).rlike(r"(Z|[+-]\d\d:?\d\d)$")
    auth, settle = (F.coalesce(kind == k, F.lit(False)) for k in ("AUTH", "SETTLEMENT"))
    rules = {
        "not JSON": F.col("_corrupt").isNull(),
        "event_type": F.coalesce(kind.isin("AUTH", "SETTLEMENT"), F.lit(False)),
        "sender_id": size("sender_id", 1, 256),
        "receiver_id": size("receiver_id", 1, 256),
        "amount_cents": F.coalesce(F.col("amount_cents") > 0, F.lit(False)),
        "currency": size(F.trim("currency"), 3, 3),
        "timestamp_utc": F.coalesce(offset("timestamp_utc"), F.lit(False)),
        "authorization_code": size("authorization_code", 6, 6),
        "merchant_category_code": ~auth | F.coalesce(F.col("merchant_category_code").rlike(r"^\d{4}$"), F.lit(False)),
        "terminal_id": ~auth | size("terminal_id", 1, 64),
        "merchant_name": ~auth | size("merchant_name", 1, 128),
        "settlement_amount_cents": ~settle | F.coalesce(F.col("settlement_amount_cents") > 0, F.lit(False)),
    }
    errors = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    status = F.when(settle, "SETTLED").when(F.col("approved"), "PENDING").otherwise("DECLINED")
    return rows.select(
        "payload", "event_id", kind.alias("event_type"), status.alias("status"), "sender_id", "receiver_id", "amount_cents", F.upper(F.trim("currency")).alias("currency"),
        F.unix_timestamp(F.try_to_timestamp("timestamp_utc")).alias("ts"), F.upper("authorization_code").alias("authorization_code"), "settlement_amount_cents", errors.alias("errors"),
    )


def dead_letters(events: DataFrame, topic: str = "payments.raw.card") -> DataFrame:
    """K12."""
    return events.filter(F.size("errors") > 0).select(F.lit(f"{topic}.dlq").alias("topic"), "event_id", F.lit("CARD").alias("rail"), F.concat(F.lit("invalid: "), F.array_join("errors", ", ")).alias("reason"), "payload")


def match_settlements(auths: DataFrame, settlements: DataFrame) -> DataFrame:
    """Settlements with their authorisation and the first rule they break; ORPHANED without one."""
    a = auths.select("authorization_code", F.col("sender_id").alias("a_sender"), F.col("receiver_id").alias("a_receiver"), F.col("currency").alias("a_currency"), F.col("amount_cents").alias("a_amount"))
    j = settlements.join(a, "authorization_code", "left")
    reason = F.when(F.col("a_sender").isNull(), "no authorisation").when(F.col("sender_id") != F.col("a_sender"), "sender differs").when(F.col("receiver_id") != F.col("a_receiver"), "receiver differs")
    reason = reason.when(F.col("currency") != F.col("a_currency"), "currency differs").when(F.col("settlement_amount_cents") < F.col("a_amount"), "settled below authorised")
    return j.select("event_id", "authorization_code", reason.alias("reason"), F.when(F.col("a_sender").isNull(), "ORPHANED").when(reason.isNotNull(), "DECLINED").otherwise("SETTLED").alias("status"), (F.col("settlement_amount_cents") - F.col("a_amount")).alias("difference_cents"))


def usd_cents(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """P5: a currency without a rate counts at 1."""
    return rows.join(rates, "currency", "left").withColumn("amount_usd_cents", F.round(F.col("amount_cents") * F.coalesce("rate", F.lit(1.0))).cast("long")).drop("rate")


def read_topic(spark: SparkSession, servers: str, topic: str = "payments.raw.card") -> DataFrame:
    """Needs the Kafka connector on the class path."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load().selectExpr("CAST(key AS STRING) AS key", "CAST(value AS STRING) AS value")


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema("value string").text(path)


def transfers_of(events: DataFrame) -> DataFrame:
    return events.filter("size(errors) = 0 AND event_type = 'SETTLEMENT'").select(
        F.col("event_id").alias("txn_id"), "sender_id", "receiver_id", F.col("settlement_amount_cents").alias("amount_cents"), "ts", F.lit("CARD").alias("rail"), "event_type"
    )


def _drop(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def start_ingest(stream: DataFrame, root: str, once: bool = True, on_batch=None):
    """Each micro-batch goes to the ledger and the dead letters under its batch id, then into the flows.

    Folders are named by the batch, so a batch that runs again replaces what it wrote; the flows of a batch are written
    to the next generation of the flows table, from which the checkpoint continues. ``on_batch`` (R8) sees the batch's transfers.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        events = normalise(batch).persist()
        events.filter("size(errors) = 0").drop("payload", "errors").dropDuplicates(["event_id"]).write.mode("overwrite").parquet(f"{root}/ledger/batch={batch_id}")
        dead_letters(events).write.mode("overwrite").parquet(f"{root}/dead/batch={batch_id}")
        new = transfers_of(events).dropDuplicates(["txn_id"])
        if batch_id > 0:
            seen = spark.read.schema("event_id string").parquet(*[f"{root}/ledger/batch={k}" for k in range(batch_id)])
            new = new.join(seen.withColumnRenamed("event_id", "txn_id"), "txn_id", "left_anti")
            merged = merge_flows(spark.read.parquet(f"{root}/flows/{batch_id - 1}"), flows_of(new))
        else:
            merged = flows_of(new)
        merged.write.mode("overwrite").parquet(f"{root}/flows/{batch_id}")
        _drop(spark, f"{root}/flows/{batch_id - 2}")  # a batch that runs again needs the one before it
        if on_batch is not None:
            on_batch(new, batch_id)
        events.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def reset(spark: SparkSession, root: str) -> None:
    """K9: removes what ``start_ingest`` has written under ``root``, its checkpoint last, so a reset that is cut short can run again."""
    for name in ("flows", "dead", "scores", "flags", "live", "ledger", "checkpoint"):
        _drop(spark, f"{root}/{name}")


def live_scorer(root: str, model: Callable[[DataFrame], DataFrame], hops: int = 3, fanout: int = 10, most: int | None = None) -> Callable[[DataFrame, int], None]:
    """An ``on_batch`` of ``start_ingest`` that scores the accounts a batch touches and those around them.

    ``model`` gets the matrix of FEATURES (G23, F6), whose columns it may refuse, and gives (account, score).  Each batch writes
    scores (account, score, tier, distance) and, for touched accounts alone, flags (account, fingerprint, risk_level, risk_score)
    under its id, so one that runs again replaces them; without transfers both are empty.  Ages are taken from the flows' latest activity.
    ``most`` bounds the accounts around the touched ones; touched ones are always scored.
    """

    def score(new: DataFrame, batch_id: int) -> None:
        spark = new.sparkSession
        flows = spark.read.parquet(f"{root}/flows/{batch_id}")
        keep = lambda df, name: (df.write.mode("overwrite").parquet(f"{root}/live/{name}"), spark.read.schema(df.schema).parquet(f"{root}/live/{name}"))[1]
        touched = keep(new.select(F.explode(F.array("sender_id", "receiver_id")).alias("account")).filter("account <> ''").distinct(), "touched")
        cap = None if most is None else touched.count() + most
        near = neighbourhood(flows, touched, hops, fanout, cap)
        inner = keep(induced(flows, near), "flows")
        latest = flows.agg(F.max("last_ts")).first()[0] or 0
        matrix = fe.assemble(inner, near.select("account"), None, None, None, latest)
        scores = model(matrix).join(near, "account").select("account", "score", band(F.col("score"), MODEL_BANDS).alias("tier"), "distance")
        scores.write.mode("overwrite").parquet(f"{root}/scores/batch={batch_id}")
        saved = spark.read.schema("account string, score double, tier string, distance int").parquet(f"{root}/scores/batch={batch_id}")
        flags = saved.filter("distance = 0").select("account", F.concat(F.lit("live:"), "account").alias("fingerprint"), F.col("tier").alias("risk_level"), F.col("score").alias("risk_score"))
        flags.write.mode("overwrite").parquet(f"{root}/flags/batch={batch_id}")

    return score


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One event per id, with state bounded by the watermark."""
    return events.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", delay).dropDuplicatesWithinWatermark(["event_id"])


def matched_stream(auths: DataFrame, settlements: DataFrame, delay: str = "1 day") -> DataFrame:
    """Stream-stream join; a settlement waits a day for its authorisation."""
    a = auths.select(F.col("authorization_code").alias("code"), F.timestamp_seconds("ts").alias("a_at")).withWatermark("a_at", delay)
    s = settlements.select("event_id", "authorization_code", F.timestamp_seconds("ts").alias("at")).withWatermark("at", delay)
    return s.join(a, (F.col("authorization_code") == F.col("code")) & (F.col("a_at") <= F.col("at")) & (F.col("a_at") >= F.col("at") - F.expr("INTERVAL 1 DAY")), "left_outer").withColumn("status", F.when(F.col("code").isNull(), "ORPHANED").otherwise("SETTLED"))


def sliding_volumes(transfers: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Paid volume per account in windows of seven days that move by one."""
    return transfers.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", delay).groupBy("sender_id", F.window("at", "7 days", "1 day").alias("w")).agg(F.sum("amount_cents").alias("volume"), F.count("*").alias("n")).select("sender_id", F.col("w.start").alias("start"), "volume", "n")


def batch_metrics(progress: list[dict], pending: int, failed: int) -> dict:
    """Rows so far and the warnings that the numbers call for."""
    warn = ["more than 1000 rows wait"] * (pending > 1000) + ["more than 100 rows failed"] * (failed > 100)
    return {"batches": len(progress), "rows": sum(p.get("numInputRows", 0) for p in progress), "warnings": warn}
