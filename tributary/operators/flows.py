"""Flows: one row per directed account pair, and what is read off them by grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dedupe_transfers(transfers: DataFrame) -> DataFrame:
    """One row per txn_id over all batches, the earliest."""
    return transfers.groupBy("txn_id").agg(F.min_by(F.struct(*[c for c in transfers.columns if c != "txn_id"]), "ts").alias("r")).select("txn_id", "r.*")


def flows_of(transfers: DataFrame) -> DataFrame:
    """K1, A1: count, sum, first and last time, smallest and largest amount; the rail is that of the first transfer."""
    return transfers.groupBy(F.col("sender_id").alias("src"), F.col("receiver_id").alias("dst")).agg(
        F.count("*").alias("tx_count"),
        F.sum("amount_cents").alias("total_amount"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.min("amount_cents").alias("min_amount"),
        F.max("amount_cents").alias("max_amount"),
        F.min_by("rail", F.struct("ts", "txn_id")).alias("rail"),
    )


def merge_flows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Flows of a table and of a batch as flows of both; the rail of the older side stays where it has one (Q14)."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    return both.groupBy("src", "dst").agg(
        F.sum("tx_count").alias("tx_count"),
        F.sum("total_amount").alias("total_amount"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.min("min_amount").alias("min_amount"),
        F.max("max_amount").alias("max_amount"),
        F.min_by("rail", F.struct("_age", "first_ts")).alias("rail"),
    )


def without_self(flows: DataFrame) -> DataFrame:
    return flows.filter("src <> dst")


def out_aggregates(flows: DataFrame) -> DataFrame:
    """A2: distinct payees, amount and count of what an account pays, self-transfers apart. A flow is one payee."""
    return without_self(flows).groupBy(F.col("src").alias("account")).agg(F.count("*").alias("out_degree"), F.sum("total_amount").alias("total_out_amount"), F.sum("tx_count").alias("out_tx_count"))


def in_aggregates(flows: DataFrame) -> DataFrame:
    """A3."""
    return without_self(flows).groupBy(F.col("dst").alias("account")).agg(F.count("*").alias("in_degree"), F.sum("total_amount").alias("total_in_amount"), F.sum("tx_count").alias("in_tx_count"))


def self_loops(flows: DataFrame) -> DataFrame:
    """A4."""
    return flows.filter("src = dst").groupBy(F.col("src").alias("account")).agg(F.sum("tx_count").alias("self_loop_count"), F.sum("total_amount").alias("self_loop_amount"))


def endpoints(flows: DataFrame) -> DataFrame:
    """All accounts that pay or are paid; one pass over the flows."""
    return flows.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("account")).distinct()


def first_activity(flows: DataFrame) -> DataFrame:
    """A5: earliest positive time on either side, null where unknown."""
    return flows.select(F.explode(F.array("src", "dst")).alias("account"), "first_ts").groupBy("account").agg(F.min(F.when(F.col("first_ts") > 0, F.col("first_ts"))).alias("first_activity"))


def undirected(flows: DataFrame, weight: str = "log_amount") -> DataFrame:
    """Pairs in both directions merged; the weight of each direction by mode, then summed."""
    modes: dict[str, Column] = {
        "log_amount": F.log1p(F.greatest(F.col("total_amount"), F.lit(0)).cast("double")),
        "amount": F.greatest(F.col("total_amount"), F.lit(0)).cast("double"),
        "tx_count": F.col("tx_count").cast("double"),
        "unweighted": F.lit(1.0),
    }
    if weight not in modes:
        raise ValueError(f"unknown weight mode {weight!r}; one of {sorted(modes)}")
    return without_self(flows).groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        F.sum(modes[weight]).alias("weight"), F.sum("total_amount").alias("total_amount"), F.sum("tx_count").alias("tx_count")
    )


def strong_edges(pairs: DataFrame, least: int) -> DataFrame:
    """A10."""
    return pairs.filter(F.col("tx_count") >= least)


def export_flows(flows: DataFrame, reference_ts, days: int) -> DataFrame:
    """Flows with activity in the last ``days``."""
    return flows.filter(F.col("last_ts") >= F.lit(reference_ts) - days * 86400).select("src", "dst", "total_amount", "tx_count", "first_ts", "last_ts")


def reciprocal_pairs(flows: DataFrame) -> DataFrame:
    """Pairs that pay each other, each once."""
    back = flows.select(F.col("src").alias("b"), F.col("dst").alias("a"))
    return flows.filter("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).join(back, ["a", "b"])


def induced(flows: DataFrame, accounts: DataFrame, column: str = "account") -> DataFrame:
    """Flows with both ends in a set; Spark broadcasts the set if its size allows it."""
    ends = accounts.select(F.col(column).alias("_a"))
    return flows.join(ends, F.col("src") == F.col("_a"), "left_semi").join(ends, F.col("dst") == F.col("_a"), "left_semi")


def top_neighbours(flows: DataFrame, k: int, by: str = "src", other: str = "dst") -> DataFrame:
    """The k largest counterparties of each account."""
    from pyspark.sql import Window

    order = Window.partitionBy(by).orderBy(F.col("total_amount").desc(), F.col(other))
    return without_self(flows).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def time_quantile(flows: DataFrame, p: float | None = None) -> DataFrame:
    """Last activity of all flows, or its discrete quantile; null where there are none."""
    if p is None:
        return flows.agg(F.max("last_ts").alias("anchor"))
    if not 0 < p <= 1:
        raise ValueError("the quantile must lie in (0, 1]")
    return flows.select(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY last_ts)").cast("long").alias("anchor"))


def flow_between(transfers: DataFrame, a: str, b: str, since: int) -> DataFrame:
    """A16."""
    one = transfers.filter((F.col("sender_id") == a) & (F.col("receiver_id") == b) & (F.col("ts") >= since))
    return one.agg(F.count("*").alias("tx_count"), F.coalesce(F.sum("amount_cents"), F.lit(0)).alias("total"), F.avg("amount_cents").alias("mean"), F.max(F.lit(1)).alias("_any")).select(
        "tx_count", "total", "mean", F.coalesce("_any", F.lit(0)).alias("path_count")
    )


def graph_counts(transfers: DataFrame, flows: DataFrame, accounts: DataFrame) -> DataFrame:
    """Sizes of the graph and of what is known about its accounts, one row from three aggregates."""
    a = accounts.agg(F.count("*").alias("accounts"), F.count("gnn_risk_score").alias("scored"), F.countDistinct("community_id").alias("communities"), F.coalesce(F.sum(F.col("in_cycle").cast("long")), F.lit(0)).alias("in_cycle"))
    f = flows.agg(F.count("*").alias("flows"))
    return a.crossJoin(f).crossJoin(transfers.agg(F.count("*").alias("transactions")))  # one row each
