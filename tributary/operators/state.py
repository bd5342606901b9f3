"""Stored state as tables: ledger, outbox, risk flags, account properties, read models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.scoring import DETECTOR_BANDS, band, max_tier, tier_rank


def save_transactions(old: DataFrame, new: DataFrame, arrival: str = "arrival") -> DataFrame:
    """K3: an id keeps its first row but for the status, which is the last one."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in ("id", "status", arrival)]
    merged = both.groupBy("id").agg(F.max_by("status", arrival).alias("status"), F.min_by(F.struct(*rest), arrival).alias("r"))
    return merged.select("id", "status", "r.*")


def insert_outbox(old: DataFrame, new: DataFrame) -> DataFrame:
    """K4: of equal idempotency keys the oldest row stays."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in both.columns if c not in ("idempotency_key", "_new")]
    return both.groupBy("idempotency_key").agg(F.min_by(F.struct(*rest), F.struct("_new", "created_at", "id")).alias("r")).select("idempotency_key", "r.*")


def upsert_flags(old: DataFrame, new: DataFrame) -> DataFrame:
    """K6: a flag seen again counts up and takes the new level, score, text and details; its first time, accounts and status stay."""
    if new.filter("explanation IS NULL OR explanation = ''").take(1):
        raise ValueError("a flag needs an explanation")
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in new.columns])
    j = old.join(n, F.col("fingerprint") == F.col("n_fingerprint"), "full_outer")
    seen, again = F.col("fingerprint").isNotNull(), F.col("n_fingerprint").isNotNull()
    keep = lambda c: F.coalesce(F.col(c), F.col(f"n_{c}")).alias(c)
    take = lambda c: F.coalesce(F.col(f"n_{c}"), F.col(c)).alias(c)
    return j.select(
        keep("fingerprint"), keep("flag_type"), keep("account_ids"), take("risk_level"), take("risk_score"), take("explanation"), take("details"),
        F.coalesce("status", F.lit("open")).alias("status"),
        F.when(seen, F.col("first_detected_at")).otherwise(F.col("n_detected_at")).alias("first_detected_at"),
        F.when(again, F.col("n_detected_at")).otherwise(F.col("last_detected_at")).alias("last_detected_at"),
        F.when(seen, F.col("detection_count") + again.cast("int")).otherwise(1).alias("detection_count"),
    )


def set_status(flags: DataFrame, fingerprint: str, status: str) -> DataFrame:
    return flags.withColumn("status", F.when(F.col("fingerprint") == fingerprint, status).otherwise(F.col("status")))


def write_properties(accounts: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """K7: new values where there are any; accounts that are not known are ignored."""
    v = values.select("account", *[F.col(c).alias(f"_{c}") for c in columns])
    others = [c for c in accounts.columns if c not in columns]
    return accounts.join(v, "account", "left").select(*others, *[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) for c in columns])


def write_cycle_members(accounts: DataFrame, members: DataFrame) -> DataFrame:
    """K7: membership is cleared and set."""
    m = members.select("account", F.lit(True).alias("_m")).distinct()
    return accounts.drop("in_cycle").join(m, "account", "left").withColumn("in_cycle", F.coalesce("_m", F.lit(False))).drop("_m")


def merge_nodes(accounts: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """Nodes of a type are created or touched; given properties win."""
    n = new.select("account", F.col("labels").alias("_labels"))
    j = accounts.join(n, "account", "full_outer")
    return j.select("account", F.coalesce("_labels", "labels").alias("labels"), F.coalesce("created_at", F.lit(now)).alias("created_at"), F.when(F.col("_labels").isNotNull(), now).otherwise(F.col("updated_at")).alias("updated_at"))


def put_meta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Key and value, the new value wins."""
    return old.join(new.select("key"), "key", "left_anti").unionByName(new)


def patch_run(runs: DataFrame, patch: DataFrame) -> DataFrame:
    """Only fields that are given change."""
    columns = [c for c in patch.columns if c != "run_id"]
    p = patch.select("run_id", *[F.col(c).alias(f"_{c}") for c in columns])
    return runs.join(p, "run_id", "left").select("run_id", *[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in runs.columns if c != "run_id"])


def latest_run(runs: DataFrame, active_only: bool = False) -> DataFrame:
    found = runs.filter(F.col("status").isin("queued", "running")) if active_only else runs
    return found.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(1)


def due_outbox(outbox: DataFrame, now: int, limit: int = 50, backoff: int = 10) -> DataFrame:
    """Pending rows whose linear backoff has passed, fewest tries first."""
    ready = F.col("last_retry_at").isNull() | (F.col("last_retry_at") + backoff * F.col("retry_count") <= now)
    return outbox.filter((F.col("status") == "pending") & ready).orderBy("retry_count", "created_at", "id").limit(limit)


def settle_outbox(outbox: DataFrame, results: DataFrame, now: int, most: int = 3) -> DataFrame:
    """R2: synced rows are done; a failure counts, and the row fails for good at ``most``."""
    j = outbox.join(results.select("id", F.col("ok").alias("_ok")), "id", "left")
    tries = F.col("retry_count") + (F.col("_ok") == F.lit(False)).cast("int")
    failed = F.col("_ok") == F.lit(False)
    return j.withColumns({
        "status": F.when(F.col("_ok"), "synced").when(failed & (F.col("retry_count") >= most), "failed").otherwise(F.col("status")),
        "last_retry_at": F.when(failed, F.lit(now)).otherwise(F.col("last_retry_at")),
        "retry_count": F.when(failed, tries).otherwise(F.col("retry_count")),
    }).drop("_ok")


def outbox_stats(outbox: DataFrame, now: int) -> DataFrame:
    """A20."""
    age = F.lit(now) - F.col("created_at")
    return outbox.groupBy("status").agg(F.count("*").alias("n"), F.max(age).alias("max_age"), F.avg(age).alias("mean_age"))


def filter_flags(flags: DataFrame, least_level: str | None = None, flag_type: str | None = None, status: str | None = None) -> DataFrame:
    """P10."""
    out = flags
    if least_level is not None:
        out = out.filter(tier_rank(F.col("risk_level")) >= tier_rank(F.lit(least_level)))
    if flag_type is not None:
        out = out.filter(F.col("flag_type") == flag_type)
    return out if status is None else out.filter(F.col("status") == status)


def flags_page(flags: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """L2: newest first, with the number of all."""
    total = flags.agg(F.count("*").alias("total"))
    return flags.orderBy(F.col("last_detected_at").desc(), F.col("fingerprint").desc()).offset(offset).limit(limit).crossJoin(total)  # total is one row


def flag_accounts(flags: DataFrame, not_type: str | None = None) -> DataFrame:
    """Accounts of open flags, of other types than one's own."""
    found = flags.filter(F.col("status") == "open")
    return (found if not_type is None else found.filter(F.col("flag_type") != not_type)).select(F.explode("account_ids").alias("account")).distinct()


def shape_alert(flags: DataFrame) -> DataFrame:
    """P12."""
    return flags.select("fingerprint", "flag_type", "risk_level", "risk_score", F.try_element_at("account_ids", F.lit(1)).alias("primary_account"), F.coalesce("detection_count", F.lit(1)).alias("detection_count"), F.get_json_object("details", "$.community_id").alias("community_id"))


def latest_transfers(transfers: DataFrame, n: int, rail: str | None = None, account: str | None = None) -> DataFrame:
    """L1."""
    out = transfers if rail is None else transfers.filter(F.col("rail") == rail)
    out = out if account is None else out.filter((F.col("sender_id") == account) | (F.col("receiver_id") == account))
    return out.orderBy(F.col("ts").desc(), "txn_id").limit(n)


def shape_transactions(transfers: DataFrame, accounts: DataFrame, flagged: DataFrame) -> DataFrame:
    """Transfers with the higher tier of both parties and whether either is flagged."""
    side = lambda c: accounts.select(F.col("account").alias(c), F.col("tier").alias(f"{c}_tier"))
    flag = lambda c: flagged.select(F.col("account").alias(c), F.lit(True).alias(f"{c}_flag")).distinct()
    out = transfers
    for c in ("sender_id", "receiver_id"):
        out = out.join(side(c), c, "left").join(flag(c), c, "left")
    return out.select(
        "txn_id", "sender_id", "receiver_id", F.coalesce("amount_cents", F.lit(0)).alias("amount_cents"), F.coalesce("ts", F.lit(0)).alias("ts"),
        F.regexp_replace("rail", "^IBM_AML_", "").alias("currency"), max_tier(F.col("sender_id_tier"), F.col("receiver_id_tier")).alias("risk_tier"),
        (F.coalesce("sender_id_flag", F.lit(False)) | F.coalesce("receiver_id_flag", F.lit(False))).alias("flagged"),
    )


def node_data(accounts: DataFrame) -> DataFrame:
    """Score, tier, label and mark of an account as shown."""
    score = F.coalesce("risk_score", "gnn_risk_score", F.lit(0.0))
    return accounts.select("account", score.alias("score"), F.coalesce("risk_tier", "gnn_risk_tier", band(score, DETECTOR_BANDS)).alias("tier"), F.substring("account", 1, 8).alias("label"))


def communities_list(accounts: DataFrame, cutoff: float = 0.5, by: str = "risk", limit: int = 50, offset: int = 0) -> DataFrame:
    """A15."""
    gnn = F.coalesce("gnn_risk_score", F.lit(0.0))
    per = accounts.filter("community_id IS NOT NULL").groupBy("community_id").agg(F.count("*").alias("size"), F.round(F.avg(gnn), 6).alias("risk"), F.sum((F.coalesce("in_cycle", F.lit(False)) | (gnn >= cutoff)).cast("long")).alias("flagged"))
    return per.withColumn("tier", band(F.col("risk"))).orderBy(F.col(by).desc(), "community_id").offset(offset).limit(limit)


def marked_page(accounts: DataFrame, marked: Column, limit: int, offset: int = 0) -> DataFrame:
    """L3, Q9: marked accounts by score, sorted before the page is cut."""
    return accounts.filter(marked).orderBy(F.col("score").desc(), "account").offset(offset).limit(limit)


def overview(flows: DataFrame, limit: int = 400, fanout: int = 8) -> tuple[DataFrame, DataFrame]:
    """Hubs that pay others, their largest payees, and the flows among them."""
    from tributary.operators.flows import induced, out_aggregates, top_neighbours, without_self

    seeds = max(30, min(limit // 4, 400))
    hubs = out_aggregates(flows).orderBy(F.col("total_out_amount").desc(), "account").limit(seeds).select("account")
    payees = top_neighbours(flows.join(hubs, F.col("src") == F.col("account"), "left_semi"), fanout)
    near = payees.groupBy(F.col("dst").alias("account")).agg(F.max("total_amount").alias("amount"))
    nodes = hubs.withColumn("amount", F.lit(None).cast("long")).unionByName(near.join(hubs, "account", "left_anti")).orderBy(F.col("amount").desc_nulls_first(), "account").limit(limit).select("account")
    return nodes, without_self(induced(flows, nodes))


def palette(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """Communities by size with their accounts' degrees, each pair counted at both ends."""
    degree = pairs.select(F.explode(F.array("a", "b")).alias("account")).groupBy("account").agg(F.count("*").alias("degree"))
    size = membership.groupBy("community").agg(F.count("*").alias("size"))
    order = size.withColumn("position", F.row_number().over(Window.orderBy(F.col("size").desc(), "community")))
    return membership.join(order, "community").join(degree, "account", "left").select("account", "community", "position", F.coalesce("degree", F.lit(0)).alias("degree"))


def sized_communities(membership: DataFrame, lo: int, hi: int, k: int) -> DataFrame:
    """The k largest communities of between lo and hi accounts."""
    return membership.groupBy("community").agg(F.count("*").alias("size")).filter(F.col("size").between(lo, hi)).orderBy(F.col("size").desc(), "community").limit(k)


def featured(marked: DataFrame, k: int) -> DataFrame:
    """The best account of each typology first, then by score."""
    best = F.row_number().over(Window.partitionBy("typology").orderBy(F.col("score").desc(), "account"))
    first = F.col("typology").isNotNull() & (F.col("r") == 1)
    return marked.withColumn("r", best).withColumn("first", first).orderBy(F.col("first").desc(), F.col("score").desc(), "account").limit(k).select("account", "typology", "score", "first")
