"""Readers for transaction, pattern and feature files, and seeded generators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Positional columns of the transaction file (fixed values); its header names one column twice.
TRANSACTION_COLUMNS = ["timestamp", "from_bank", "from_account", "to_bank", "to_account", "amount_received", "receiving_currency", "amount_paid", "payment_currency", "payment_format", "is_laundering"]
TRANSACTION_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in TRANSACTION_COLUMNS])
TIME_FORMATS = ["yyyy/MM/dd HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss"]


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """The header is skipped and columns go by position."""
    return spark.read.schema(TRANSACTION_SCHEMA).option("header", True).option("enforceSchema", True).csv(path)


def parse_time(text: Column) -> Column:
    return F.coalesce(*[F.unix_timestamp(F.try_to_timestamp(text, F.lit(f))) for f in TIME_FORMATS])


def account_id(bank: Column, account: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", F.trim(bank), F.trim(account)), 256), 1, 32)


def to_transfers(rows: DataFrame) -> DataFrame:
    """S3: hashed ids, cents cut off below one (Q15), rail by currency; rows without a time or a positive amount go."""
    cents = (F.col("amount_paid").try_cast("double") * 100).try_cast("long")
    out = rows.select(
        account_id(F.col("from_bank"), F.col("from_account")).alias("sender_id"), account_id(F.col("to_bank"), F.col("to_account")).alias("receiver_id"),
        cents.alias("amount_cents"), parse_time(F.col("timestamp")).alias("ts"), F.concat(F.lit("IBM_AML_"), F.trim("payment_currency")).alias("rail"),
        F.lit("SETTLEMENT").alias("event_type"), (F.trim("is_laundering") == "1").alias("is_laundering"),
    ).filter("ts IS NOT NULL AND amount_cents > 0")
    return out.withColumn("txn_id", F.substring(F.sha2(F.concat_ws("|", "ts", "sender_id", "receiver_id", "amount_cents"), 256), 1, 40))


def preflight(rows: DataFrame, n: int = 5) -> DataFrame:
    """A file is fine if at least one and half of its first rows can be read."""
    head = rows.limit(n)
    ok = parse_time(F.col("timestamp")).isNotNull() & (F.col("amount_paid").try_cast("double") > 0)
    return head.agg(F.count("*").alias("checked"), F.coalesce(F.sum(F.coalesce(ok, F.lit(False)).cast("long")), F.lit(0)).alias("valid")).withColumn("ok", (F.col("valid") >= 1) & (2 * F.col("valid") >= F.col("checked")))


def read_patterns(spark: SparkSession, path: str, wanted: list[str] | None = None) -> DataFrame:
    """(block, typology, pos, columns) of rows between BEGIN and END lines; a block without END ends at the next BEGIN.

    A block never spans files, so lines are numbered within a file, by their place in it.
    """
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    begin = F.regexp_extract("line", r"^BEGIN LAUNDERING ATTEMPT - ([A-Z-]+)", 1)
    order = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("start", F.when(begin != "", F.struct(F.col("pos").alias("block"), begin.alias("typology")))).withColumn("end", F.when(F.col("line").startswith("END LAUNDERING"), F.col("pos")))
    lines = lines.withColumns({"in": F.last("start", ignorenulls=True).over(order), "ended": F.last("end", ignorenulls=True).over(order)})
    inside = lines.filter("in IS NOT NULL AND start IS NULL AND (ended IS NULL OR ended < in.block)")
    out = inside.withColumn("columns", F.split("line", ",")).filter(F.size("columns") >= 9).select("file", F.col("in.block").alias("block"), F.col("in.typology").alias("typology"), "pos", "columns")
    return out if wanted is None else out.filter(F.col("typology").isin(wanted))


def pattern_groups(rows: DataFrame) -> DataFrame:
    """Per block its accounts in order of appearance, hops, amounts, span and currencies. A block is a handful of rows."""
    c = lambda i: F.trim(F.col("columns")[i])
    r = rows.select("file", "block", "typology", "pos", account_id(c(1), c(2)).alias("a"), account_id(c(3), c(4)).alias("b"), F.round(c(7).try_cast("double") * 100).cast("long").alias("cents"), c(8).alias("currency"), parse_time(c(0)).alias("ts"))
    g = r.groupBy("file", "block", "typology").agg(
        F.array_sort(F.collect_list(F.struct("pos", "a", "b"))).alias("hops"), F.count("*").alias("n_hops"), F.min("cents").alias("min_cents"), F.max("cents").alias("max_cents"),
        (F.max("ts") - F.min("ts")).alias("span_seconds"), F.array_sort(F.collect_set("currency")).alias("currencies"),
    )
    accounts = F.array_distinct(F.flatten(F.transform("hops", lambda h: F.array(h["a"], h["b"]))))
    return g.select("file", "block", "typology", accounts.alias("accounts"), "n_hops", "min_cents", "max_cents", "span_seconds", "currencies", (F.size("currencies") > 1).alias("cross_currency")).filter("min_cents IS NOT NULL AND span_seconds IS NOT NULL")


def typology_members(groups: DataFrame) -> DataFrame:
    """The accounts of each typology, united over its blocks."""
    return groups.select("typology", F.explode("accounts").alias("account")).distinct()


def ingest_stats(rows: DataFrame, groups: DataFrame, budget: int) -> DataFrame:
    """One row of what a file holds: rows, bad ones, those that touch a pattern's account, others within and beyond the
    budget, pattern groups and their accounts, accounts counted by typology, and the span of time."""
    good = to_transfers(rows)
    members = typology_members(groups).select(F.col("account").alias("_a")).distinct()
    hit = good
    for c in ("sender_id", "receiver_id"):
        hit = hit.join(members.select(F.col("_a").alias(c), F.lit(True).alias(f"_{c}")), c, "left")
    counted = hit.agg(
        F.count("*").alias("good"), F.coalesce(F.sum(F.coalesce("_sender_id", "_receiver_id", F.lit(False)).cast("long")), F.lit(0)).alias("pattern_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    listed = groups.groupBy("typology").agg(F.sum(F.size("accounts")).alias("n"), F.count("*").alias("g"))
    known = listed.agg(F.coalesce(F.sum("g"), F.lit(0)).alias("groups"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("typology", "n")))).alias("typology_counts"))  # a handful of typologies
    one = rows.agg(F.count("*").alias("scanned")).crossJoin(counted).crossJoin(known).crossJoin(members.agg(F.count("*").alias("pattern_accounts")))  # one row each
    rest = F.col("good") - F.col("pattern_rows")
    return one.select(
        "scanned", (F.col("scanned") - F.col("good")).alias("bad_rows"), "pattern_rows", F.least(rest, F.lit(budget)).alias("background_rows"), F.greatest(rest - budget, F.lit(0)).alias("background_skipped"),
        "groups", "pattern_accounts", "typology_counts", "first_ts", "last_ts",
    )


def read_elliptic(spark: SparkSession, features: str, classes: str, edges: str, first_step: int = 1, last_step: int = 49) -> tuple[DataFrame, DataFrame]:
    """Nodes with label 3 (illicit), 0 (licit) or null, and the edges among them."""
    raw = spark.read.option("header", False).csv(features)
    names = raw.columns
    nodes = raw.select(F.col(names[0]).alias("node"), F.col(names[1]).cast("int").alias("time_step"), F.array(*[F.col(c).cast("double") for c in names[2:]]).alias("x")).filter(F.col("time_step").between(first_step, last_step))
    label = spark.read.schema("node string, class string").option("header", True).csv(classes)
    nodes = nodes.join(label, "node", "left").withColumn("y", F.when(F.col("class") == "1", 3).when(F.col("class") == "2", 0)).drop("class")
    e = spark.read.schema("src string, dst string").option("header", True).csv(edges)
    ids = nodes.select("node")
    return nodes, e.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")


def group_means(rows: DataFrame, value: str, keys: list[list[str]]) -> DataFrame:
    """The mean of a column over each list of keys, beside every row."""
    return rows.withColumns({"mean_" + "_".join(k): F.avg(value).over(Window.partitionBy(*k)) for k in keys})


def background_sample(rows: DataFrame, n: int, key: str = "txn_id", seed: int = 42) -> DataFrame:
    """N rows, uniform and the same however the table is partitioned."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def with_background(rows: DataFrame, members: DataFrame, budget: int, seed: int = 42) -> DataFrame:
    """Rows that touch labelled accounts, and the first ``budget`` others in order of time."""
    m = members.select(F.col("account").alias("_a"), F.lit(True).alias("_hit")).distinct()
    r = rows
    for c in ("sender_id", "receiver_id"):
        r = r.join(m.select(F.col("_a").alias(c), F.col("_hit").alias(f"_{c}")), c, "left")
    r = r.withColumn("is_pattern", F.coalesce("_sender_id", "_receiver_id", F.lit(False))).drop("_sender_id", "_receiver_id")
    return r.filter("is_pattern").unionByName(r.filter("NOT is_pattern").orderBy("ts", "txn_id").limit(budget))


def generate(spark: SparkSession, n: int, accounts: int = 500, per_minute: float = 30.0, start: int = 1_704_067_200, seed: int = 42, shards: int = 16) -> DataFrame:
    """Seeded transfers with exponential gaps; each shard is a stream of its own, so no window spans the table."""
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 40)) / float(1 << 40)
    gap = -F.ln(1 - u(0)) * 60.0 * shards / per_minute
    rows = spark.range(n).withColumn("shard", F.pmod("id", F.lit(shards)))
    at = F.sum(gap).over(Window.partitionBy("shard").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    pick = lambda k: F.concat(F.lit("A"), F.floor(u(k) * accounts))
    tier = F.when(u(3) < 0.7, 10_000).when(u(3) < 0.95, 200_000).otherwise(2_000_000)
    rail = F.element_at(F.array(*map(F.lit, ["CARD", "ACH", "WIRE", "CRYPTO"])), (F.floor(u(5) * 4) + 1).cast("int"))
    return rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), "id"), 256).alias("txn_id"), pick(1).alias("sender_id"), pick(2).alias("receiver_id"), (F.floor(u(4) * tier) + 1).cast("long").alias("amount_cents"), (start + F.floor(at)).cast("long").alias("ts"), rail.alias("rail"), F.lit("SETTLEMENT").alias("event_type"))
