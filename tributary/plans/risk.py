"""Queries over stored state, scores, metrics, splits, files and streams."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tributary.functions import scoring as sc
from tributary.operators import features as fe
from tributary.operators import flows as fl
from tributary.operators import graph as gr
from tributary.operators import ml
from tributary.operators import series as se
from tributary.operators import state as st
from tributary.plans.core import BAND, FIRST, OUT
from tributary.plans.registry import E, FE, FT, SQL_ACC, SQL_FLAG, T, TYPOLOGIES, accounts, flags, query, with_
from tributary.session import shared_dir, stage
from tributary.sources import files as fs
from tributary.sources.adapters import SQL_E, SQL_FE, SQL_FT, SQL_T
from tributary.streaming import ingest as ing

# ---- stored state


def _outbox(s, d):
    k = F.col("o_orderkey")
    return s.read.parquet(f"{d}/orders.parquet").select(k.alias("id"), F.when(k % 7 == 0, "synced").when(k % 11 == 0, "failed").otherwise("pending").alias("status"), (k % 4).alias("retry_count"), F.when(k % 3 == 0, k % 1000).alias("last_retry_at"), (k * 3 % 10007).alias("created_at"), F.concat(F.lit("k"), k % 997).alias("idempotency_key"))


SQL_OUTBOX = "ob AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'synced' WHEN o_orderkey % 11 = 0 THEN 'failed' ELSE 'pending' END AS status, o_orderkey % 4 AS retry_count, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 1000 END AS last_retry_at, o_orderkey * 3 % 10007 AS created_at, 'k' || (o_orderkey % 997) AS idempotency_key FROM orders)"
query("q_l04_outbox_poll", with_("SELECT * FROM ob WHERE status = 'pending' AND (last_retry_at IS NULL OR last_retry_at + 10 * retry_count <= 500) ORDER BY retry_count, created_at, id LIMIT 50", SQL_OUTBOX))(lambda s, d: st.due_outbox(_outbox(s, d), 500))
query("q_a20_outbox_stats", with_("SELECT status, count(*) AS n, max(20000 - created_at) AS max_age, avg(20000 - created_at) AS mean_age FROM ob GROUP BY status", SQL_OUTBOX))(lambda s, d: st.outbox_stats(_outbox(s, d), 20000))
query("q_k04_insert_outbox", with_("SELECT idempotency_key, arg_min(id, (created_at, id)) AS id FROM ob GROUP BY ALL", SQL_OUTBOX))(lambda s, d: (lambda o: st.insert_outbox(o.limit(0), o).select("idempotency_key", "id"))(_outbox(s, d)))
query("q_r02_settle_outbox", with_("SELECT id, CASE WHEN id % 5 = 0 THEN 'synced' WHEN retry_count >= 3 THEN 'failed' ELSE status END AS status, retry_count + CASE WHEN id % 5 = 0 THEN 0 ELSE 1 END AS retry_count FROM ob WHERE status = 'pending'", SQL_OUTBOX))(
    lambda s, d: (lambda o: st.settle_outbox(o, o.select("id", (F.col("id") % 5 == 0).alias("ok")), 900).select("id", "status", F.col("retry_count").alias("retry_count")))(_outbox(s, d).filter("status = 'pending'"))
)


def _ledger_rows(s, d, hi):
    k = F.col("o_orderkey")
    return s.read.parquet(f"{d}/orders.parquet").select((k % 500).alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("sender"), k.alias("arrival")).filter(k <= hi if hi else F.lit(True))


query("q_k03_save_transactions", "SELECT o_orderkey % 500 AS id, arg_max(o_orderstatus, o_orderkey) AS status, arg_min(o_custkey, o_orderkey) AS sender FROM orders GROUP BY 1")(lambda s, d: (lambda r: st.save_transactions(r.filter("arrival <= 2000"), r.filter("arrival > 2000")))(_ledger_rows(s, d, 0)))


def _new_flags(s, d):
    f = flags(s, d).filter("detection_count = 1")
    again = f.filter("flag_type = 'CYCLE'").withColumns({"risk_score": F.round(F.col("risk_score") / 2, 4), "detected_at": F.col("last_detected_at") + 5})
    return again.select("fingerprint", "flag_type", "account_ids", "risk_level", "risk_score", "explanation", "details", "detected_at")


query("q_k06_upsert_flags", with_("SELECT fingerprint, flag_type, CASE WHEN flag_type = 'CYCLE' THEN round(risk_score / 2, 4) ELSE risk_score END AS risk_score, status, first_detected_at, last_detected_at + CASE WHEN flag_type = 'CYCLE' THEN 5 ELSE 0 END AS last_detected_at, CAST(detection_count AS INTEGER) AS detection_count FROM (SELECT *, CASE WHEN flag_type = 'CYCLE' THEN 2 ELSE 1 END AS detection_count FROM flag)", SQL_FLAG))(
    lambda s, d: st.upsert_flags(flags(s, d), _new_flags(s, d)).select("fingerprint", "flag_type", "risk_score", "status", "first_detected_at", "last_detected_at", "detection_count")
)
query("q_k07_write_scores", with_("SELECT account, CASE WHEN gnn_risk_score > 0.5 THEN 0.99::DOUBLE ELSE risk_score END AS risk_score FROM acc", SQL_ACC))(
    lambda s, d: (lambda a: st.write_properties(a.select("account", "risk_score"), a.filter("gnn_risk_score > 0.5").select("account", F.lit(0.99).alias("risk_score")).unionAll(s.createDataFrame([("nobody", 1.0)], "account string, risk_score double")), ["risk_score"]))(accounts(s, d))
)
query("q_k07_write_cycle", with_("SELECT account, account IN (SELECT unnest(account_ids) FROM flag WHERE flag_type = 'CYCLE') AS in_cycle FROM acc", SQL_ACC, SQL_FLAG))(lambda s, d: st.write_cycle_members(accounts(s, d).select("account", "in_cycle"), flags(s, d).filter("flag_type = 'CYCLE'").select(F.explode("account_ids").alias("account"))))
query("q_k14_merge_nodes", "SELECT 'A' || c_custkey AS account, CASE WHEN c_custkey % 2 = 0 THEN ['Bank'] ELSE ['Account'] END AS labels, 5::BIGINT AS created_at, CASE WHEN c_custkey % 2 = 0 THEN 9::BIGINT ELSE 5::BIGINT END AS updated_at FROM customer")(
    lambda s, d: (lambda a: st.merge_nodes(a.select("account", F.array(F.lit("Account")).alias("labels"), F.lit(5).cast("long").alias("created_at"), F.lit(5).cast("long").alias("updated_at")), a.filter("even").select("account", F.array(F.lit("Bank")).alias("labels")), 9))(s.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("A"), "c_custkey").alias("account"), (F.col("c_custkey") % 2 == 0).alias("even")))
)
query("q_k11_meta", "SELECT 'k' || r_regionkey AS key, CASE WHEN r_regionkey < 2 THEN 'new' ELSE r_name END AS value FROM region")(lambda s, d: (lambda r: st.put_meta(r, r.filter("key < 'k2'").select("key", F.lit("new").alias("value"))))(s.read.parquet(f"{d}/region.parquet").select(F.concat(F.lit("k"), "r_regionkey").alias("key"), F.col("r_name").alias("value"))))
query("q_k11_latest_run", "SELECT o_orderkey AS run_id, o_orderstatus AS status, o_custkey AS started_at FROM orders ORDER BY o_custkey DESC, o_orderkey DESC LIMIT 1")(lambda s, d: st.latest_run(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("started_at"))))
query("q_l01_latest", with_("SELECT * FROM e ORDER BY ts DESC, txn_id LIMIT 25", SQL_E))(lambda s, d: st.latest_transfers(E(s, d), 25))
query("q_l01_latest_of_account", with_("SELECT * FROM e WHERE rail = 'click' AND (sender_id = 'A7' OR receiver_id = 'A7') ORDER BY ts DESC, txn_id LIMIT 10", SQL_E))(lambda s, d: st.latest_transfers(E(s, d), 10, "click", "A7"))
query("q_l02_flags_page", with_("SELECT fingerprint, last_detected_at, (SELECT count(*) FROM flag) AS total FROM flag ORDER BY last_detected_at DESC, fingerprint DESC LIMIT 20 OFFSET 10", SQL_FLAG))(lambda s, d: st.flags_page(flags(s, d), 20, 10).select("fingerprint", "last_detected_at", "total"))
query("q_p10_filter_flags", with_("SELECT fingerprint FROM flag WHERE risk_level IN ('high', 'critical') AND flag_type = 'CYCLE' AND status = 'open'", SQL_FLAG))(lambda s, d: st.filter_flags(flags(s, d), "high", "CYCLE", "open").select("fingerprint"))
query("q_p12_shape_alert", with_("SELECT fingerprint, flag_type, risk_level, risk_score, account_ids[1] AS primary_account, 1 AS detection_count, json_extract_string(details, '$.community_id') AS community_id FROM flag", SQL_FLAG))(lambda s, d: st.shape_alert(flags(s, d)))
query("q_a14_open_flags", with_("SELECT flag_type, count(*) AS n FROM flag WHERE status = 'open' GROUP BY ALL", SQL_FLAG))(lambda s, d: flags(s, d).filter("status = 'open'").groupBy("flag_type").agg(F.count("*").alias("n")))
query("q_j09_flag_accounts", with_("SELECT DISTINCT unnest(account_ids) AS account FROM flag WHERE status = 'open'", SQL_FLAG))(lambda s, d: st.flag_accounts(flags(s, d)))
query("q_j10_other_flags", with_("SELECT DISTINCT unnest(account_ids) AS account FROM flag WHERE status = 'open' AND flag_type <> 'CYCLE'", SQL_FLAG))(lambda s, d: st.flag_accounts(flags(s, d), "CYCLE"))
RANK = "coalesce(list_position(['low', 'medium', 'high', 'critical'], {}.tier), 1)"
query("q_p13_transactions", with_(f"""SELECT txn_id, sender_id, receiver_id, amount_cents, ts, rail AS currency, CASE WHEN {RANK.format('x')} >= {RANK.format('y')} THEN coalesce(x.tier, 'low') ELSE coalesce(y.tier, 'low') END AS risk_tier,
sender_id IN (SELECT account FROM fa) OR receiver_id IN (SELECT account FROM fa) AS flagged FROM e LEFT JOIN acc x ON x.account = sender_id LEFT JOIN acc y ON y.account = receiver_id""", SQL_E, SQL_ACC, SQL_FLAG, "fa AS (SELECT DISTINCT unnest(account_ids) AS account FROM flag WHERE status = 'open' AND flag_type = 'AGGREGATE')"))(
    lambda s, d: st.shape_transactions(E(s, d), accounts(s, d), st.flag_accounts(flags(s, d).filter("flag_type = 'AGGREGATE'")))
)
query("q_p09_max_tier", with_(f"SELECT x.account, CASE WHEN {RANK.format('x')} >= {RANK.format('y')} THEN coalesce(x.tier, 'low') ELSE coalesce(y.tier, 'low') END AS tier FROM acc x JOIN acc y ON y.account = 'A' || (CAST(substr(x.account, 2) AS BIGINT) + 1)", SQL_ACC))(
    lambda s, d: (lambda a: a.join(a.select((F.substring("account", 2, 20).cast("long") - 1).alias("k"), F.col("tier").alias("t2")), F.substring("account", 2, 20).cast("long") == F.col("k")).select("account", sc.max_tier(F.col("tier"), F.col("t2")).alias("tier")))(accounts(s, d).select("account", "tier"))
)
SCORE = "coalesce(risk_score, gnn_risk_score, 0)"
query("q_p07_node_data", with_(f"SELECT account, {SCORE} AS score, {BAND.format(SCORE)} AS tier, substr(account, 1, 8) AS label FROM acc", SQL_ACC))(lambda s, d: st.node_data(accounts(s, d)))
query("q_a15_communities", with_(f"SELECT *, {BAND.format('risk')} AS tier FROM (SELECT community_id, count(*) AS size, round(avg(coalesce(gnn_risk_score, 0)), 6) AS risk, CAST(sum((in_cycle OR coalesce(gnn_risk_score, 0) >= 0.5)::INT) AS BIGINT) AS flagged FROM acc GROUP BY ALL) ORDER BY risk DESC, community_id LIMIT 20", SQL_ACC))(lambda s, d: st.communities_list(accounts(s, d), limit=20))
query("q_l03_marked_page", with_(f"SELECT account, {SCORE} AS score FROM acc WHERE in_cycle OR coalesce(gnn_risk_score, 0) >= 0.5 ORDER BY score DESC, account LIMIT 30 OFFSET 15", SQL_ACC))(lambda s, d: st.marked_page(accounts(s, d).withColumn("score", F.coalesce("risk_score", "gnn_risk_score", F.lit(0.0))), sc.is_marked(F.col("gnn_risk_score"), F.col("in_cycle")), 30, 15).select("account", "score"))
query("q_l05_overview")(lambda s, d: st.overview(FT(s, d), 200)[1].select("src", "dst", "total_amount"))
query("q_j07_paying_hubs", with_("SELECT account, total_out_amount FROM o ORDER BY total_out_amount DESC, account LIMIT 30", SQL_T, SQL_FT, OUT))(lambda s, d: fl.out_aggregates(FT(s, d)).orderBy(F.col("total_out_amount").desc(), "account").limit(30).select("account", "total_out_amount"))
query("q_a27_featured", with_("SELECT account, typology, score, f AS first FROM (SELECT account, typology, gnn_risk_score AS score, typology IS NOT NULL AND row_number() OVER (PARTITION BY typology ORDER BY gnn_risk_score DESC, account) = 1 AS f FROM acc WHERE gnn_risk_score >= 0.5) ORDER BY f DESC, score DESC, account LIMIT 12", SQL_ACC))(lambda s, d: st.featured(accounts(s, d).filter("gnn_risk_score >= 0.5").select("account", "typology", F.col("gnn_risk_score").alias("score")), 12))
query("q_a32_palette")(lambda s, d: st.palette(fl.undirected(FT(s, d)), accounts(s, d).select("account", F.col("community_id").alias("community"))))
query("q_p11_sized_communities", with_("SELECT community_id AS community, count(*) AS size FROM acc GROUP BY ALL HAVING count(*) BETWEEN 2 AND 500 ORDER BY size DESC, community LIMIT 10", SQL_ACC))(lambda s, d: st.sized_communities(accounts(s, d).select("account", F.col("community_id").alias("community")), 2, 500, 10))
query("q_p06_currency", "SELECT DISTINCT event_type AS rail, regexp_replace('IBM_AML_' || event_type, '^IBM_AML_', '') AS currency FROM events")(lambda s, d: E(s, d).select("rail", se.currency_code(F.concat(F.lit("IBM_AML_"), "rail")).alias("currency")).distinct())
query("q_p14_rail_for", with_("SELECT DISTINCT rail FROM e WHERE rail = 'view' OR regexp_replace(rail, '^IBM_AML_', '') = 'view'", SQL_E))(lambda s, d: E(s, d).filter((F.col("rail") == "view") | (se.currency_code(F.col("rail")) == "view")).select("rail").distinct())

# ---- scores and metrics

C3 = """SELECT account, CASE WHEN n = 0 THEN NULL WHEN n = 1 THEN coalesce(CASE WHEN g THEN gnn_risk_score END, 1.0) ELSE (CASE WHEN g THEN 0.6::DOUBLE * gnn_risk_score ELSE 0 END + CASE WHEN in_cycle THEN 0.25 ELSE 0 END + CASE WHEN h THEN 0.15 ELSE 0 END) / (CASE WHEN g THEN 0.6::DOUBLE ELSE 0 END + CASE WHEN in_cycle THEN 0.25 ELSE 0 END + CASE WHEN h THEN 0.15 ELSE 0 END) END AS mark
FROM (SELECT *, g::INT + in_cycle::INT + h::INT AS n FROM (SELECT *, coalesce(gnn_risk_score >= 0.5, false) AS g, coalesce(tier IN ('high', 'critical'), false) AS h FROM acc))"""
query("q_c03_marks", with_(C3, SQL_ACC))(lambda s, d: accounts(s, d).select("account", sc.mark(F.col("gnn_risk_score"), F.col("in_cycle"), F.col("tier")).alias("mark")))
query("q_c04_is_marked", with_("SELECT account, in_cycle OR coalesce(gnn_risk_score, 0) >= 0.738 AS marked FROM acc", SQL_ACC))(lambda s, d: accounts(s, d).select("account", sc.is_marked(F.col("gnn_risk_score"), F.col("in_cycle"), 0.738).alias("marked")))
query("q_c05_risk_level", with_("SELECT account, CASE WHEN gnn_risk_score >= 0.9 THEN 'critical' WHEN gnn_risk_score >= 0.7 THEN 'high' WHEN gnn_risk_score >= 0.4 THEN 'medium' ELSE 'low' END AS level FROM acc", SQL_ACC))(lambda s, d: accounts(s, d).select("account", sc.band(F.col("gnn_risk_score"), sc.MODEL_BANDS).alias("level")))
C6 = """SELECT account, CASE WHEN in_cycle THEN greatest(b, 0.92::DOUBLE) ELSE b END AS score, CASE WHEN in_cycle THEN 'critical' WHEN b >= 0.75 THEN 'critical' WHEN b >= 0.5 THEN 'high' WHEN b >= 0.25 THEN 'medium' ELSE 'low' END AS tier, CASE WHEN in_cycle THEN 0.95::DOUBLE ELSE c END AS confidence,
NOT in_cycle AND g BETWEEN 0.45::DOUBLE - 0.15::DOUBLE AND 0.45::DOUBLE + 0.15::DOUBLE AND c < 0.7 AS delegated FROM (SELECT account, in_cycle, g, 0.75::DOUBLE * g + 0.15::DOUBLE * r AS b, least(1, 0.5 + abs(g - 0.45::DOUBLE) / 0.45::DOUBLE * 0.5) AS c FROM (SELECT account, in_cycle, coalesce(gnn_risk_score, 0) AS g, coalesce(risk_score, 0) AS r FROM acc))"""
query("q_c06_verdicts", with_(C6, SQL_ACC))(
    lambda s, d: accounts(s, d).select("account", sc.verdict(F.coalesce("gnn_risk_score", F.lit(0.0)), F.col("in_cycle"), F.lit(3), F.coalesce("risk_score", F.lit(0.0)), F.lit(0.0)).alias("v")).select("account", "v.score", "v.tier", "v.confidence", "v.delegated")
)


@query("q_c07_explanations", with_("""SELECT account, CASE WHEN in_cycle THEN 'critical' ELSE coalesce(tier, CASE WHEN g >= 0.85 THEN 'critical' WHEN g >= 0.65 THEN 'high' WHEN g >= 0.4 THEN 'medium' ELSE 'low' END) END AS level,
CASE WHEN in_cycle THEN 'CYCLE' WHEN o >= 5 AND o > 2 * greatest(i, 1) THEN 'FAN-OUT' WHEN i >= 5 AND i > 2 * greatest(o, 1) THEN 'FAN-IN' END AS typology, CASE WHEN in_cycle THEN 0.95::DOUBLE ELSE round(least(0.9::DOUBLE, 0.5 + abs(g - 0.45::DOUBLE)) + 1e-9, 2) END AS confidence
FROM (SELECT acc.*, coalesce(gnn_risk_score, 0) AS g, coalesce(o, 0) AS o, coalesce(i, 0) AS i FROM acc LEFT JOIN (SELECT src, count(*) AS o FROM fe WHERE src <> dst GROUP BY src) x ON src = account LEFT JOIN (SELECT dst, count(*) AS i FROM fe WHERE src <> dst GROUP BY dst) y ON dst = account)""", SQL_E, SQL_FE, SQL_ACC))
def _(s, d):
    a = accounts(s, d).join(gr.degrees(FE(s, d)), "account", "left")
    x = sc.rule_explanation(F.col("gnn_risk_score"), F.col("tier"), F.col("in_cycle"), F.coalesce("in_deg", F.lit(0)), F.coalesce("out_deg", F.lit(0)), F.lit(0))
    return a.select("account", x.alias("x")).select("account", "x.level", "x.typology", "x.confidence")


query("q_c08_unusual_features", with_("""SELECT account, CAST(k AS INTEGER) AS k, feature, value, round(r, 6) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY r DESC, feature) AS k FROM (
SELECT account, feature, value, cume_dist() OVER (PARTITION BY feature ORDER BY value) AS r FROM (SELECT account, 'out_degree' AS feature, out_degree::DOUBLE AS value FROM o UNION ALL SELECT account, 'out_tx_count', out_tx_count FROM o)) WHERE r >= 0.9 AND value > 0) WHERE k <= 3""", SQL_T, SQL_FT, OUT))(
    lambda s, d: sc.unusual_features(fl.out_aggregates(FT(s, d)), ["out_degree", "out_tx_count"])
)


@query("q_c09_miss_reasons", with_("""SELECT grp, CASE WHEN oldest < 1704400000 THEN 'OUTSIDE_WINDOW' WHEN gap > 259200 THEN 'HOP_GAP' WHEN lo < 10000 THEN 'AMOUNT_FLOOR' WHEN ratio < 0.8 THEN 'CONSERVATION' WHEN cur > 1 THEN 'CROSS_CURRENCY' WHEN n > 6 THEN 'DEPTH_LIMIT' ELSE 'UNKNOWN' END AS reason FROM (
SELECT grp, min(ts) AS oldest, max(ts - pt) AS gap, min(amount_cents) AS lo, min(amount_cents / pa::DOUBLE) AS ratio, count(DISTINCT rail) AS cur, count(*) AS n FROM (
SELECT sender_id || '-' || (ts // 86400) AS grp, ts, amount_cents, rail, lag(ts) OVER (PARTITION BY sender_id || '-' || (ts // 86400) ORDER BY ts) AS pt, lag(amount_cents) OVER (PARTITION BY sender_id || '-' || (ts // 86400) ORDER BY amount_cents DESC) AS pa FROM e) GROUP BY grp)""", SQL_E))
def _(s, d):
    from pyspark.sql import Window

    e = E(s, d).withColumn("grp", F.concat("sender_id", F.lit("-"), F.floor(F.col("ts") / 86400)))
    e = e.withColumns({"pt": F.lag("ts").over(Window.partitionBy("grp").orderBy("ts")), "pa": F.lag("amount_cents").over(Window.partitionBy("grp").orderBy(F.col("amount_cents").desc()))})
    g = e.groupBy("grp").agg(F.min("ts").alias("oldest"), F.max(F.col("ts") - F.col("pt")).alias("gap"), F.min("amount_cents").alias("lo"), F.min(F.col("amount_cents") / F.col("pa")).alias("ratio"), F.countDistinct("rail").alias("cur"), F.count("*").alias("n"))
    return g.select("grp", sc.miss_reason(*[F.col(c) for c in ("oldest", "gap", "lo", "ratio", "cur", "n")], window_start=1704400000).alias("reason"))


query("q_c10_evidence", with_("SELECT * FROM (SELECT src AS account, dst AS payee, total_amount, CAST(row_number() OVER (PARTITION BY src ORDER BY total_amount DESC, dst) AS INTEGER) AS rank FROM fe WHERE src <> dst) WHERE rank <= 5", SQL_E, SQL_FE))(lambda s, d: fl.top_neighbours(FE(s, d), 5).select(F.col("src").alias("account"), F.col("dst").alias("payee"), "total_amount", "rank"))
SCORED = "sd AS (SELECT account, coalesce(gnn_risk_score, 0) AS score, in_cycle, typology IS NOT NULL AS truth FROM acc)"


def _scored(s, d):
    return accounts(s, d).select("account", F.coalesce("gnn_risk_score", F.lit(0.0)).alias("score"), "in_cycle", F.col("typology").isNotNull().alias("truth"), "typology")


query("q_c11_confusion_class", with_("SELECT account, CASE WHEN m AND truth THEN 'TP' WHEN m THEN 'FP' WHEN truth THEN 'FN' ELSE 'TN' END AS class FROM (SELECT *, in_cycle OR score >= 0.5 AS m FROM sd)", SQL_ACC, SCORED))(lambda s, d: _scored(s, d).select("account", sc.confusion_class(sc.is_marked(F.col("score"), F.col("in_cycle")), F.col("truth")).alias("class")))
CONF = "SELECT tp, fp, fn, tn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall FROM (SELECT count(*) FILTER (m AND truth) AS tp, count(*) FILTER (m AND NOT truth) AS fp, count(*) FILTER (NOT m AND truth) AS fn, count(*) FILTER (NOT m AND NOT truth) AS tn FROM (SELECT *, in_cycle OR score >= 0.75 AS m FROM sd))"
query("q_a21_confusion", with_(CONF, SQL_ACC, SCORED))(lambda s, d: ml.confusion(_scored(s, d), sc.is_marked(F.col("score"), F.col("in_cycle"), 0.75)))
query("q_a22_threshold_curve", with_("SELECT c AS cutoff, count(*) FILTER (m AND truth) AS tp, count(*) FILTER (m AND NOT truth) AS fp, count(*) FILTER (NOT m AND truth) AS fn FROM (SELECT c, truth, in_cycle OR score >= c AS m FROM sd, (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS c)) GROUP BY c", SQL_ACC, SCORED))(lambda s, d: ml.threshold_curve(_scored(s, d), [0.5, 0.6, 0.7, 0.8, 0.9]))
query("q_a23_typology_recall", with_("SELECT typology, count(*) AS members, count(*) FILTER (coalesce(gnn_risk_score, 0) >= 0.5) AS found, count(*) FILTER (coalesce(gnn_risk_score, 0) >= 0.5) / count(*)::DOUBLE AS recall FROM acc WHERE typology IS NOT NULL GROUP BY typology", SQL_ACC))(lambda s, d: ml.typology_recall(_scored(s, d).select("account", "score"), accounts(s, d).filter("typology IS NOT NULL").select("account", "typology"), 0.5))
query("q_a24_detectors", with_("SELECT count(*) FILTER (in_cycle) AS flagged, count(*) FILTER (in_cycle AND truth) AS correct, count(*) FILTER (in_cycle AND NOT m AND truth) AS detector_only, count(*) FILTER (NOT in_cycle AND m AND truth) AS model_only, count(*) FILTER (NOT in_cycle AND NOT m AND truth) AS missed_by_both FROM (SELECT *, score >= 0.5 AS m FROM sd)", SQL_ACC, SCORED))(lambda s, d: ml.detector_comparison(_scored(s, d).select(F.col("in_cycle").alias("detector"), (F.col("score") >= 0.5).alias("model"), "truth")))
query("q_a25_miss_breakdown", with_("SELECT CAST(i AS INTEGER) AS position, x.reason, count(tier) AS n FROM (SELECT unnest(['low', 'medium', 'high', 'critical', 'none']) AS reason, unnest([0, 1, 2, 3, 4]) AS i) x LEFT JOIN acc ON acc.tier = x.reason GROUP BY ALL", SQL_ACC))(lambda s, d: ml.miss_breakdown(accounts(s, d).filter("tier IS NOT NULL").select(F.col("tier").alias("reason")), [*sc.TIERS, "none"]))
query("q_l06_top_risk", with_("SELECT account, score, truth FROM sd ORDER BY score DESC, account LIMIT 20", SQL_ACC, SCORED))(lambda s, d: _scored(s, d).orderBy(F.col("score").desc(), "account").limit(20).select("account", "score", "truth"))
query("q_j12_overlap", with_("SELECT f.fingerprint, g.typology, count(*) AS shared, count(*) / 2.0::DOUBLE AS share FROM (SELECT fingerprint, unnest(account_ids) AS account FROM flag) f JOIN acc g ON g.account = f.account WHERE g.typology IS NOT NULL GROUP BY ALL HAVING count(*) >= 1", SQL_ACC, SQL_FLAG))(
    lambda s, d: flags(s, d).select("fingerprint", F.explode("account_ids").alias("account")).join(accounts(s, d).filter("typology IS NOT NULL").select("account", "typology"), "account").groupBy("fingerprint", "typology").agg(F.count("*").alias("shared"), (F.count("*") / 2.0).alias("share"))
)
query("q_j14_truth_labels", with_(f"SELECT account, typology, list_position({TYPOLOGIES}, typology) AS position FROM acc WHERE typology IS NOT NULL", SQL_ACC))(lambda s, d: accounts(s, d).filter("typology IS NOT NULL").select("account", "typology", F.array_position(F.array(*map(F.lit, TYPOLOGIES)), F.col("typology")).cast("int").alias("position")))
CURVE = "cv AS (SELECT cutoff, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM (SELECT score AS cutoff, count(*) FILTER (truth) AS p, count(*) FILTER (NOT truth) AS n FROM sd GROUP BY score) WINDOW w AS (ORDER BY cutoff DESC))"
query("q_m04_metrics", with_("SELECT sum(p * tp / (tp + fp)::DOUBLE) / max(pos) AS pr_auc, sum(n * (tp - p / 2.0::DOUBLE)) / (max(pos) * max(neg)) AS roc_auc, max(pos) / (max(pos) + max(neg))::DOUBLE AS prevalence FROM cv", SQL_ACC, SCORED, CURVE))(lambda s, d: ml.ranking_metrics(_scored(s, d)))
query("q_m05_best_threshold", with_("SELECT cutoff AS threshold, f1 FROM (SELECT cutoff, 2 * tp / (tp + fp + pos)::DOUBLE AS f1 FROM cv) ORDER BY round(f1, 12) DESC, cutoff DESC LIMIT 1", SQL_ACC, SCORED, CURVE))(lambda s, d: ml.best_threshold(_scored(s, d)))
SPLIT = f"SELECT account, first_activity, CASE WHEN first_activity IS NULL OR first_activity <= (SELECT quantile_cont(first_activity, 0.6) FROM fa) THEN 'train' WHEN first_activity <= (SELECT quantile_cont(first_activity, 0.75) FROM fa) THEN 'val' ELSE 'test' END AS split FROM fa"
query("q_m01_temporal_split", with_(SPLIT, SQL_T, SQL_FT, f"fa AS ({FIRST})"))(lambda s, d: ml.temporal_split(fl.first_activity(FT(s, d))))
query("q_m01_random_split")(lambda s, d: ml.random_split(accounts(s, d).select("account")))
query("q_m15_time_step_split", "SELECT o_orderkey AS node, CAST(o_orderkey % 49 + 1 AS INTEGER) AS time_step, CASE WHEN o_orderkey % 49 + 1 <= 34 THEN 'train' ELSE 'test' END AS split FROM orders WHERE o_orderkey % 3 <> 0")(lambda s, d: ml.time_step_split(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("node"), (F.col("o_orderkey") % 49 + 1).cast("int").alias("time_step"), F.when(F.col("o_orderkey") % 3 != 0, 1).alias("y"))).drop("y"))
LOGS = "lg AS (SELECT account, sign(c_acctbal) * ln(1 + abs(c_acctbal)) AS x FROM (SELECT 'A' || c_custkey AS account, c_acctbal FROM customer))"


def _balances(s, d):
    return s.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("A"), "c_custkey").alias("account"), F.col("c_acctbal").alias("bal"))


query("q_m02_scaler", with_("SELECT account, round((x - (SELECT avg(x) FROM lg)) / (SELECT stddev_pop(x) FROM lg), 6) AS bal FROM lg", LOGS))(lambda s, d: (lambda b: ml.scale(b, ml.fit_scaler(b, ["bal"]), ["bal"]).withColumn("bal", F.round("bal", 6)))(_balances(s, d)))
query("q_m03_quantile_normal")(lambda s, d: (lambda b: ml.quantile_normal(b, ml.fit_quantiles(b, ["bal"], 200), ["bal"]))(_balances(s, d)))
query("q_m06_class_alpha", "SELECT y, coalesce(a, 1) AS alpha FROM (SELECT unnest([0, 1, 2, 3, 4]::BIGINT[]) AS y) LEFT JOIN (SELECT k, 1.0::DOUBLE / n / avg(1.0::DOUBLE / n) OVER () AS a FROM (SELECT c_custkey % 4 AS k, count(*) AS n FROM customer GROUP BY ALL)) ON k = y")(lambda s, d: ml.class_alpha(s.read.parquet(f"{d}/customer.parquet").select((F.col("c_custkey") % 4).alias("y")), 5))
query("q_m07_focal_loss", with_("SELECT avg(-0.25::DOUBLE * pow(1 - greatest(score, 1e-12), 2) * ln(greatest(score, 1e-12))) AS loss FROM sd WHERE truth", SQL_ACC, SCORED))(lambda s, d: ml.focal_loss(_scored(s, d).select(F.col("score").alias("p"), F.lit(0.25).alias("alpha"), F.when(F.col("truth"), 1).otherwise(-100).alias("y"))))
def _vectors(s, d):
    e = s.read.parquet(f"{d}/embeddings.parquet")
    name = next(f.name for f in e.schema if f.dataType.typeName() == "array")
    return e.select("vec_id", F.col(name).alias("vec"), "label")


query("q_m08_oversample")(lambda s, d: ml.oversample(_vectors(s, d)))


query("q_m12_ensemble", with_("SELECT account, (coalesce(gnn_risk_score, 0) + coalesce(risk_score, 0)) / 2 AS score FROM acc", SQL_ACC))(lambda s, d: ml.ensemble(accounts(s, d).select("account", F.coalesce("gnn_risk_score", F.lit(0.0)).alias("a"), F.coalesce("risk_score", F.lit(0.0)).alias("b")), ["a", "b"]).select("account", "score"))
query("q_m14_class_scores", with_("SELECT account, 1 - exp(score) / (exp(score) + exp(2 * score) + exp(0.5::DOUBLE)) AS s FROM sd", SQL_ACC, SCORED))(lambda s, d: _scored(s, d).select("account", ml.class_score(F.array("score", 2 * F.col("score"), F.lit(0.5))).alias("s")))
query("q_a28_readiness", with_("SELECT f AS feature, count(*) FILTER (v <> 0) AS nonzero, count(*) FILTER (v <> 0) / count(*)::DOUBLE AS share, round(avg(v), 6) AS mean, min(v) AS min, max(v) AS max, 0::BIGINT AS non_finite, min(v) = max(v) AS constant FROM (SELECT 'out_degree' AS f, out_degree::DOUBLE AS v FROM o UNION ALL SELECT 'out_tx_count', out_tx_count FROM o) GROUP BY f", SQL_T, SQL_FT, OUT))(lambda s, d: ml.readiness(fl.out_aggregates(FT(s, d)), ["out_degree", "out_tx_count"]))


@query("q_m10_classifier")
def _(s, d):
    f = FE(s, d)
    base = fe.base(f, accounts(s, d).limit(0).select("account"), 1_706_700_000)
    names = ["out_degree", "in_degree", "net_flow", "flow_ratio"]
    rows = ml.propagate(f, base, names, 1)
    x = [c for c in rows.columns if c != "account"]
    known = fe.weak_labels(flags(s, d)).withColumnRenamed("y", "level")
    labelled = rows.join(known, "account", "left").withColumn("y", (F.coalesce("level", F.lit(0)) >= 2).cast("double"))
    parts = labelled.join(ml.random_split(labelled.select("account")), "account")
    return ml.predict(ml.train_classifier(parts.filter("split = 'train'"), x), parts)


# ---- files and streams


def _folder(s, name):
    return f"{shared_dir(s)}/{name}-{os.urandom(8).hex()}"


@query("q_s02_csv_scan", "SELECT count(*) AS n, CAST(sum(trunc(round(l_extendedprice, 2) * 100)) AS BIGINT) AS cents, min('IBM_AML_US Dollar') AS rail FROM lineitem WHERE trunc(round(l_extendedprice, 2) * 100) > 0")
def _(s, d):
    path = _folder(s, "csv")
    rows = s.read.parquet(f"{d}/lineitem.parquet")
    price = F.format_string("%.2f", F.col("l_extendedprice"))
    lit = lambda c: F.lit(c)
    rows.select(F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyy/MM/dd HH:mm").alias("Timestamp"), lit("1").alias("From Bank"), F.col("l_orderkey").cast("string").alias("Account"), lit("2").alias("To Bank"), F.col("l_suppkey").cast("string").alias("Account2"), price.alias("r"), lit("US Dollar").alias("rc"), price.alias("p"), lit("US Dollar").alias("pc"), lit("ACH").alias("f"), lit("0").alias("l")).write.option("header", True).csv(path)
    t = fs.to_transfers(fs.read_transactions(s, path))
    return t.agg(F.count("*").alias("n"), F.sum("amount_cents").alias("cents"), F.min("rail").alias("rail"))


query("q_s09_group_means", "SELECT event_id, avg(value) OVER (PARTITION BY event_type) AS mean_event_type, avg(value) OVER (PARTITION BY event_type, user_id) AS mean_event_type_user_id FROM events")(lambda s, d: fs.group_means(s.read.parquet(f"{d}/events.parquet"), "value", [["event_type"], ["event_type", "user_id"]]).select("event_id", "mean_event_type", "mean_event_type_user_id"))
query("q_s10_generated")(lambda s, d: fs.generate(s, 2000))
query("q_s12_background")(lambda s, d: fs.background_sample(E(s, d), 500))
query("q_j05_pattern_rows", with_("SELECT *, true AS is_pattern FROM e WHERE sender_id IN (SELECT account FROM acc WHERE typology = 'CYCLE') OR receiver_id IN (SELECT account FROM acc WHERE typology = 'CYCLE') UNION ALL (SELECT *, false FROM e WHERE NOT (sender_id IN (SELECT account FROM acc WHERE typology = 'CYCLE') OR receiver_id IN (SELECT account FROM acc WHERE typology = 'CYCLE')) ORDER BY ts, txn_id LIMIT 200)", SQL_E, SQL_ACC))(lambda s, d: fs.with_background(E(s, d), accounts(s, d).filter("typology = 'CYCLE'"), 200))



def _pattern_groups(s, d):
    """A pattern file with a block of two transfers for each nation, read back."""
    path, k = _folder(s, "patterns"), F.col("n_nationkey")
    typology = F.element_at(F.array(*map(F.lit, TYPOLOGIES)), (k % 8 + 1).cast("int"))
    hop = lambda a, b: F.concat(F.lit("2024/01/02 03:04,1,"), a.cast("string"), F.lit(",1,"), b.cast("string"), F.lit(",5.00,Euro,5.00,Euro,ACH,1\n"))
    block = F.concat(F.lit("BEGIN LAUNDERING ATTEMPT - "), typology, F.lit("\n"), hop(k, k + 1), hop(k + 1, k), F.lit("END LAUNDERING ATTEMPT\n"))
    s.read.parquet(f"{d}/nation.parquet").select(block.alias("value")).write.option("lineSep", "\n").text(path)
    return fs.pattern_groups(fs.read_patterns(s, path))


def _raw_transactions(s, d):
    """The event log as rows of a transaction file; every tenth row has no time."""
    k, price = F.col("event_id"), F.format_string("%.2f", F.col("value"))
    time = F.when(k % 10 == 0, "none").otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy/MM/dd HH:mm"))
    one, money = F.lit("1"), F.lit("Euro")
    values = [time, one, F.col("user_id").cast("string"), one, F.get_json_object("props", "$.k"), price, money, price, money, F.lit("ACH"), F.lit("0")]
    return s.read.parquet(f"{d}/events.parquet").select(*[v.alias(n) for n, v in zip(fs.TRANSACTION_COLUMNS, values)])


SQL_GROUP = f"gr AS (SELECT {TYPOLOGIES}[n_nationkey % 8 + 1] AS typology, n_nationkey AS k FROM nation), mem AS (SELECT DISTINCT substr(sha256('1:' || unnest([k, k + 1])), 1, 32) AS account, typology FROM gr)"
RAW = "raw AS (SELECT event_id, substr(sha256('1:' || user_id), 1, 32) AS a, substr(sha256('1:' || json_extract_string(props, '$.k')), 1, 32) AS b, epoch(date_trunc('minute', ts)) AS t FROM events WHERE event_id % 10 <> 0 AND trunc(round(value, 2) * 100) > 0)"
STATS = """SELECT (SELECT count(*) FROM events) AS scanned, (SELECT count(*) FROM events) - count(*) AS bad_rows, count(*) FILTER (hit) AS pattern_rows, least(count(*) FILTER (NOT hit), 200) AS background_rows, greatest(count(*) FILTER (NOT hit) - 200, 0) AS background_skipped,
(SELECT count(*) FROM gr) AS groups, (SELECT count(DISTINCT account) FROM mem) AS pattern_accounts, CAST(min(t) AS BIGINT) AS first_ts, CAST(max(t) AS BIGINT) AS last_ts FROM (SELECT *, a IN (SELECT account FROM mem) OR b IN (SELECT account FROM mem) AS hit FROM raw)"""
query("q_a30_ingest_stats", with_(STATS, SQL_GROUP, RAW))(lambda s, d: fs.ingest_stats(_raw_transactions(s, d), _pattern_groups(s, d), 200).drop("typology_counts"))
query("q_a30_typology_counts", with_("SELECT typology, CAST(2 * count(*) AS BIGINT) AS n FROM gr GROUP BY typology", SQL_GROUP))(lambda s, d: fs.ingest_stats(_raw_transactions(s, d), _pattern_groups(s, d), 200).select(F.explode("typology_counts").alias("typology", "n")))
query("q_s05_pattern_groups", with_("SELECT typology, [substr(sha256('1:' || k), 1, 32), substr(sha256('1:' || (k + 1)), 1, 32)] AS accounts, 2::BIGINT AS n_hops, 500::BIGINT AS min_cents, 0::BIGINT AS span_seconds, false AS cross_currency FROM gr", SQL_GROUP))(lambda s, d: _pattern_groups(s, d).select("typology", "accounts", "n_hops", "min_cents", "span_seconds", "cross_currency"))
query("q_u02_typology_members", with_("SELECT typology, account FROM mem", SQL_GROUP))(lambda s, d: fs.typology_members(_pattern_groups(s, d)))
query("q_k10_feature_cache", with_("SELECT account, " + ", ".join(f"list_contains(labels, '{t}')::INT::DOUBLE AS is_{t.lower()}" for t in fe.NODE_TYPES) + " FROM acc", SQL_ACC))(lambda s, d: _cached(s, d))


def _cached(s, d):
    path = _folder(s, "features")
    fe.save_features(fe.node_types(accounts(s, d)), path, list(fe.NODE_TYPE))
    return fe.load_features(s, path, list(fe.NODE_TYPE))



def _raw_events(s, d, parts=None):
    """Card events as JSON, some of them broken on purpose; dealt over ``parts`` partitions if given."""
    k = F.col("event_id")
    auth, n = k % 2 != 1, F.shiftright(k, 1)
    # six characters as the rule wants them, of 2048 kinds from U+4E00 on: 66 bits, so every number has a code of its own
    kind = lambda i: F.shiftrightunsigned(n, 11 * i).bitwiseAND(2047) + 0x4E00
    code = F.decode(F.unhex(F.concat(*[F.hex(kind(i + 1) * 65536 + kind(i)) for i in (4, 2, 0)])), "UTF-16BE")
    # the nearest second, as the SQL's cast of epoch() takes it
    at = F.timestamp_seconds(F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long"))
    e = F.struct(
        k.cast("string").alias("event_id"), F.when(k % 50 == 0, None).when(auth, "auth").otherwise("SETTLEMENT").alias("event_type"), F.concat(F.lit("A"), n % 100).alias("sender_id"), F.concat(F.lit("B"), n % 90).alias("receiver_id"),
        (F.when(k % 77 == 0, -5).otherwise(1000 + k % 10)).alias("amount_cents"), F.lit("usd").alias("currency"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp_utc"), code.alias("authorization_code"),
        F.lit(True).alias("approved"), F.lit("t1").alias("terminal_id"), F.lit("1234").alias("merchant_category_code"), F.lit("shop").alias("merchant_name"), F.when(~auth, 1000 + (k - 1) % 10 + F.when(k % 9 == 0, -50).otherwise(0)).alias("settlement_amount_cents"),
    )
    rows = s.read.parquet(f"{d}/events.parquet").select("event_id", "ts")
    return (rows.repartition(parts) if parts else rows).select(F.to_json(e).alias("value"))


query("q_p01_normalise", "SELECT count(*) AS n, count(*) FILTER (event_id % 50 <> 0 AND event_id % 77 <> 0) AS valid FROM events")(lambda s, d: ing.normalise(_raw_events(s, d)).agg(F.count("*").alias("n"), F.sum((F.size("errors") == 0).cast("long")).alias("valid")))
query("q_k12_dead_letters", "SELECT CAST(event_id AS VARCHAR) AS event_id, 'invalid: ' || concat_ws(', ', CASE WHEN event_id % 50 = 0 THEN 'event_type' END, CASE WHEN event_id % 77 = 0 THEN 'amount_cents' END) AS reason FROM events WHERE event_id % 50 = 0 OR event_id % 77 = 0")(lambda s, d: ing.dead_letters(ing.normalise(_raw_events(s, d))).select("event_id", "reason"))
query("q_j06_settlements", """SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN (event_id - 1) % 50 = 0 OR (event_id - 1) % 77 = 0 OR event_id - 1 < (SELECT min(event_id) FROM events) THEN 'ORPHANED' WHEN event_id % 9 = 0 THEN 'DECLINED' ELSE 'SETTLED' END AS status FROM events WHERE event_id % 2 = 1 AND event_id % 50 <> 0 AND event_id % 77 <> 0""")(
    lambda s, d: (lambda n: ing.match_settlements(n.filter("event_type = 'AUTH'"), n.filter("event_type = 'SETTLEMENT'")).select("event_id", "status"))(ing.normalise(_raw_events(s, d)).filter("size(errors) = 0"))
)
BROKEN = "SELECT event_id, 'event_type' AS rule FROM events WHERE event_id % 50 = 0 UNION ALL SELECT event_id, 'amount_cents' FROM events WHERE event_id % 77 = 0"
query("q_p02_constraints", f"SELECT CAST(event_id AS VARCHAR) AS event_id, rule FROM ({BROKEN})")(lambda s, d: ing.normalise(_raw_events(s, d)).select("event_id", F.explode("errors").alias("rule")))
query("q_p03_wallets", "SELECT c_custkey, regexp_matches('0x' || substr(sha256('w' || c_custkey), 1, 38 + c_custkey % 4), '^0x[0-9a-fA-F]{40}$') AS ok FROM customer")(lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", ing.wallet_ok(F.lit("ETHEREUM"), F.concat(F.lit("0x"), F.substr(F.sha2(F.concat(F.lit("w"), "c_custkey"), 256), F.lit(1), (38 + F.col("c_custkey") % 4).cast("int")))).alias("ok")))
query("q_p05_usd", with_("SELECT txn_id, CAST(round(amount_cents * CASE rail WHEN 'click' THEN 0.75::DOUBLE ELSE 1 END) AS BIGINT) AS amount_usd_cents FROM e", SQL_E))(lambda s, d: ing.usd_cents(E(s, d).withColumnRenamed("rail", "currency"), s.createDataFrame([("click", 0.75)], "currency string, rate double")).select("txn_id", "amount_usd_cents"))
query("q_p04_preflight", "SELECT count(*) AS checked, count(*) FILTER (r_regionkey IN (1, 2)) AS valid, 2 * count(*) FILTER (r_regionkey IN (1, 2)) >= count(*) AS ok FROM region")(
    lambda s, d: fs.preflight(s.read.parquet(f"{d}/region.parquet").select(F.when(F.col("r_regionkey") < 3, "2024/01/02 03:04").otherwise(F.col("r_name")).alias("timestamp"), F.col("r_regionkey").cast("string").alias("amount_paid")))
)


@query("q_r01_stream_flows", "SELECT sender AS src, receiver AS dst, count(*) AS tx_count, CAST(sum(c) AS BIGINT) AS total_amount FROM (SELECT 'A' || (event_id // 2 % 100) AS sender, 'B' || (event_id // 2 % 90) AS receiver, 1000 + (event_id - 1) % 10 + CASE WHEN event_id % 9 = 0 THEN -50 ELSE 0 END AS c FROM events WHERE event_id % 2 = 1 AND event_id % 50 <> 0 AND event_id % 77 <> 0) GROUP BY ALL")
def _(s, d):
    """The same events through a stream of files, in several batches."""
    root = _folder(s, "stream")
    _raw_events(s, d).repartition(3).write.text(f"{root}/in")
    stream = s.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(f"{root}/in")
    ing.start_ingest(stream, root).awaitTermination()
    last = max(int(f.getPath().getName()) for f in _list(s, f"{root}/flows"))
    return s.read.parquet(f"{root}/flows/{last}").select("src", "dst", "tx_count", "total_amount")


@query("q_m13_live_scores", "SELECT DISTINCT account FROM (SELECT unnest(['A' || (event_id // 2 % 100), 'B' || (event_id // 2 % 90)]) AS account FROM events WHERE event_id % 2 = 1 AND event_id % 50 <> 0 AND event_id % 77 <> 0)")
def _(s, d):
    """Accounts that a stream of the events touches, each flagged by the batch that touched it."""
    root = _folder(s, "live")
    _raw_events(s, d).repartition(2).write.text(f"{root}/in")
    stream = s.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(f"{root}/in")
    model = lambda m: m.select("account", (1 / (1 + F.exp(-F.col("flow_ratio")))).alias("score"))
    ing.start_ingest(stream, root, on_batch=ing.live_scorer(root, model, hops=1)).awaitTermination()
    return s.read.schema("account string, fingerprint string, risk_level string, risk_score double").parquet(f"{root}/flags/*").select("account").distinct()


@query("q_m09_layered_scores")
def _(s, d):
    """Two layers both ways with weights from a rule, over every account of the flows."""
    f = stage(FE(s, d), "flows")
    names = ["out_degree", "in_degree", "flow_ratio"]
    weight = lambda n, m: [[((3 * i + 5 * j) % 7 - 3) / 10 for j in range(m)] for i in range(n)]
    layer = lambda n, m: {k + t: weight(n, m) for k in ("own", "near") for t in ("", "_rev")} | {"bias": [0.1] * m, "bias_rev": [0.0] * m}
    rows = fe.base(f, fl.endpoints(f), 0).withColumns({n: F.log1p(n) for n in names[:2]})
    return ml.layered_scores(f, rows, names, [layer(3, 4), layer(8, 4)], {"weight": weight(8, 2), "bias": [0.0, 0.2]}, both_ways=True)


def _list(s, path):
    p = s._jvm.org.apache.hadoop.fs.Path(path)
    return list(p.getFileSystem(s._jsc.hadoopConfiguration()).listStatus(p))


query("q_r06_sliding", with_("SELECT sender_id, w * 86400 AS start, CAST(sum(amount_cents) AS BIGINT) AS volume, count(*) AS n FROM (SELECT sender_id, amount_cents, unnest(range(ts // 86400 - 6, ts // 86400 + 1)) AS w FROM e) GROUP BY ALL", SQL_E))(lambda s, d: ing.sliding_volumes(E(s, d)).select("sender_id", F.unix_timestamp("start").alias("start"), "volume", "n"))
VALID = "SELECT event_id, ts FROM events WHERE event_id % 50 <> 0 AND event_id % 77 <> 0"


def _streamed(s, d, times, run):
    """The rows that a streaming query writes over the events, which come ``times`` times, a batch each."""
    root = _folder(s, "events")
    for _ in range(times):
        _raw_events(s, d, int(s.conf.get("spark.sql.shuffle.partitions"))).write.mode("append").option("compression", "gzip").text(f"{root}/in")
    files = max(1, sum(f.getPath().getName().startswith("part-") for f in _list(s, f"{root}/in")) // times)
    stream = s.readStream.schema("value string").option("maxFilesPerTrigger", files).text(f"{root}/in")
    out = run(ing.normalise(stream).filter("size(errors) = 0"))
    out.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{root}/out").awaitTermination()
    return s.read.schema(out.schema).parquet(f"{root}/out")


query("q_r04_dedupe", f"SELECT CAST(event_id AS VARCHAR) AS event_id FROM ({VALID})")(lambda s, d: _streamed(s, d, 2, lambda e: ing.deduplicated(e).select("event_id")))
query("q_r07_matched_stream", f"SELECT CAST(s.event_id AS VARCHAR) AS event_id FROM ({VALID}) s JOIN ({VALID}) a ON s.event_id = a.event_id + 1 WHERE s.event_id % 2 = 1 AND epoch(a.ts)::BIGINT <= epoch(s.ts)::BIGINT AND epoch(a.ts)::BIGINT >= epoch(s.ts)::BIGINT - 86400")(
    lambda s, d: _streamed(s, d, 1, lambda e: ing.matched_stream(e.filter("event_type = 'AUTH'"), e.filter("event_type = 'SETTLEMENT'")).select("event_id", "status")).filter("status = 'SETTLED'").select("event_id")
)
query("q_t02_window_labels", "SELECT unnest([1, 24, 47, 48, 168, 720]) AS hours, unnest(['1h', '24h', '47h', '2d', '7d', '30d']) AS label")(lambda s, d: s.createDataFrame([(h, se.window_label(h)) for h in (1, 24, 47, 48, 168, 720)], "hours int, label string"))
