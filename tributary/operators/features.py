"""The account feature matrix: 47 columns in a fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.scoring import safe_ratio
from tributary.operators import flows as fl
from tributary.operators import graph as gr
from tributary.operators import series as se

NODE_TYPES = ["Account", "Merchant", "Bank", "Exchange"]
#: Column order is part of a model's contract (fixed values).
GRAPH = ["out_degree", "in_degree", "total_out_amount", "total_in_amount", "out_tx_count", "in_tx_count", "net_flow", "flow_ratio", "pagerank_score", "account_age_days"]
SELF_LOOP = ["self_loop_count", "self_loop_amount"]
DERIVED = ["avg_out_amount", "avg_in_amount", "degree_ratio", "tx_per_counterparty", "burst_1h_24h", "burst_24h_7d", "amount_per_degree"]
COMMUNITY = ["community_size", "community_risk_score", "community_flagged_members"]
WINDOWED = [f"{p}_{w}" for w in ("1h", "24h", "7d") for p in ("volume_out", "volume_in", "txn_out", "txn_in")]
NODE_TYPE = [f"is_{t.lower()}" for t in NODE_TYPES]
STRUCTURAL = ["reciprocity", "kcore", "log_triangles", "clustering", "log_nbr_out_deg"]
MOTIF = ["max_payee_in_deg", "max_payer_out_deg", "two_hop_out", "two_hop_in"]
FEATURES = GRAPH + SELF_LOOP + DERIVED + COMMUNITY + WINDOWED + NODE_TYPE + STRUCTURAL + MOTIF


def zero(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: F.coalesce(F.col(n), F.lit(0)).cast("double") for n in names})


def base(flows: DataFrame, accounts: DataFrame, reference_ts: int) -> DataFrame:
    """Degrees, amounts, net flow, ratio and age of every account of either side."""
    everyone = accounts.select("account").union(fl.endpoints(flows)).distinct()
    out = everyone.join(fl.out_aggregates(flows), "account", "left").join(fl.in_aggregates(flows), "account", "left").join(fl.self_loops(flows), "account", "left").join(fl.first_activity(flows), "account", "left")
    out = zero(out, ["out_degree", "in_degree", "total_out_amount", "total_in_amount", "out_tx_count", "in_tx_count", *SELF_LOOP])
    age = F.when(F.col("first_activity").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), (reference_ts - F.col("first_activity")) / 86400.0))
    return out.withColumns({
        "net_flow": F.col("total_in_amount") - F.col("total_out_amount"),
        "flow_ratio": safe_ratio(F.col("total_out_amount"), F.col("total_in_amount") + F.col("total_out_amount")),
        "account_age_days": age,
    })


def derived(df: DataFrame) -> DataFrame:
    """F3."""
    c = F.col
    degree = c("out_degree") + c("in_degree")
    both = lambda w: c(f"txn_out_{w}") + c(f"txn_in_{w}")
    return df.withColumns({
        "avg_out_amount": safe_ratio(c("total_out_amount"), c("out_tx_count")),
        "avg_in_amount": safe_ratio(c("total_in_amount"), c("in_tx_count")),
        "degree_ratio": safe_ratio(c("out_degree"), degree),
        "tx_per_counterparty": safe_ratio(c("out_tx_count") + c("in_tx_count"), degree),
        "burst_1h_24h": safe_ratio(both("1h"), both("24h")),
        "burst_24h_7d": safe_ratio(both("24h"), both("7d")),
        "amount_per_degree": safe_ratio(c("total_out_amount") + c("total_in_amount"), degree),
    })


def node_types(df: DataFrame) -> DataFrame:
    """F4."""
    return df.withColumns({f"is_{t.lower()}": F.coalesce(F.array_contains("labels", t), F.lit(False)).cast("double") for t in NODE_TYPES})


def structural(flows: DataFrame, accounts: DataFrame) -> DataFrame:
    """G14-G19 for every account, 0 where it has no counterparty."""
    pairs = fl.undirected(flows, "unweighted")
    tri = gr.triangles(flows).select("account", F.log1p(F.col("triangles").cast("double")).alias("log_triangles"), "clustering")
    core = gr.coreness(pairs).select("account", F.col("core").alias("kcore"))
    out = accounts.select("account")
    for part in (gr.reciprocity(flows), core, tri, gr.neighbour_degrees(flows), gr.two_hop(flows)):
        out = out.join(part, "account", "left")
    return zero(out, STRUCTURAL + MOTIF)


def community_stats(accounts: DataFrame, flags: DataFrame) -> DataFrame:
    """Size of an account's community, and risk score and flagged members of its oldest open flag (Q22)."""
    sizes = accounts.filter("community_id IS NOT NULL").groupBy("community_id").agg(F.count("*").alias("community_size"))
    details = F.get_json_object("details", "$.community_id"), F.get_json_object("details", "$.flagged_member_count").cast("double")
    known = flags.filter((F.col("flag_type") == "COMMUNITY") & (F.col("status") == "open")).select(details[0].alias("community_id"), "risk_score", details[1].alias("members"), "last_detected_at").filter("community_id IS NOT NULL")
    oldest = known.groupBy("community_id").agg(F.min_by("risk_score", "last_detected_at").alias("community_risk_score"), F.min_by("members", "last_detected_at").alias("community_flagged_members"))
    return accounts.select("account", "community_id").join(sizes, "community_id", "left").join(oldest, "community_id", "left").select("account", *COMMUNITY)


def weak_labels(flags: DataFrame) -> DataFrame:
    """Highest level of an account's open cycle flags, 0 to 3."""
    level = F.array_position(F.array(*map(F.lit, ["low", "medium", "high", "critical"])), F.col("risk_level")) - 1
    return flags.filter((F.col("flag_type") == "CYCLE") & (F.col("status") == "open")).select(F.explode("account_ids").alias("account"), level.alias("y")).groupBy("account").agg(F.max("y").cast("long").alias("y"))


def assemble(flows: DataFrame, accounts: DataFrame, volumes: DataFrame | None, communities: DataFrame | None, ranks: DataFrame | None, reference_ts: int) -> DataFrame:
    """all blocks joined on the account, in the order of FEATURES; blocks that are not given are 0."""
    out = base(flows, accounts, reference_ts)
    out = out.join(structural(flows, out), "account", "left")
    for part, names in ((volumes, WINDOWED), (communities, COMMUNITY), (ranks, ["pagerank_score"])):
        out = out.join(part, "account", "left") if part is not None else out.withColumns({n: F.lit(0.0) for n in names})
        out = zero(out, names)
    labels = accounts.select("account", "labels") if "labels" in accounts.columns else accounts.select("account", F.array(F.lit("Account")).alias("labels"))
    out = derived(node_types(out.join(labels, "account", "left")))
    return out.select("account", *[F.col(n).cast("double").alias(n) for n in FEATURES])


def volumes_of(transfers: DataFrame, reference_ts: int) -> DataFrame:
    return se.account_volumes(se.edge_series(transfers), reference_ts)


def save_features(matrix: DataFrame, path: str, names: list[str]) -> None:
    """A matrix with its columns in this order; the order is kept beside the rows."""
    matrix.select("account", *names).write.mode("overwrite").parquet(f"{path}/rows")
    matrix.sparkSession.createDataFrame([(names,)], "names array<string>").write.mode("overwrite").json(f"{path}/order")


def load_features(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The saved matrix, if its columns are ``names`` in that order."""
    saved = spark.read.schema("names array<string>").json(f"{path}/order").first()["names"]
    if saved != names:
        raise ValueError(f"saved features are {saved}, not {names}")
    return spark.read.parquet(f"{path}/rows").select("account", *names)
