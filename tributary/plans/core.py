"""Queries over flows, series and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary.functions import scoring as sc
from tributary.operators import flows as fl
from tributary.operators import series as se
from tributary.plans.registry import E, FE, FT, SQL_ACC, SQL_REF_E, SQL_REF_T, T, accounts, query, reference, with_
from tributary.sources.adapters import SQL_E, SQL_FE, SQL_FT, SQL_T

BAND = "CASE WHEN {0} >= 0.85 THEN 'critical' WHEN {0} >= 0.65 THEN 'high' WHEN {0} >= 0.40 THEN 'medium' ELSE 'low' END"
DAY = "%d" % 86400


def flagship(spark, d):
    """The 20 largest account pairs of the last week of activity, with their number of transfers and a tier by weight."""
    edges = E(spark, d)
    end = edges.agg(F.max("ts")).first()[0] or 0
    recent = fl.flows_of(edges.filter(F.col("ts") >= end - 7 * 86400))
    tier = F.when(F.col("total_amount") >= 100_000, "high").when(F.col("total_amount") >= 20_000, "medium").otherwise("low")
    return recent.orderBy(F.col("total_amount").desc(), "src", "dst").limit(20).select("src", "dst", "tx_count", "total_amount", tier.alias("tier"))


query("q_min_top_pairs", with_("""SELECT src, dst, tx_count, total_amount, CASE WHEN total_amount >= 100000 THEN 'high' WHEN total_amount >= 20000 THEN 'medium' ELSE 'low' END AS tier
FROM (SELECT sender_id AS src, receiver_id AS dst, count(*) AS tx_count, CAST(sum(amount_cents) AS BIGINT) AS total_amount FROM e WHERE ts >= (SELECT max(ts) FROM e) - 604800 GROUP BY ALL)
ORDER BY total_amount DESC, src, dst LIMIT 20""", SQL_E))(flagship)


@query("q_s03_transfers", with_("SELECT * FROM t", SQL_T))
def _(spark, d):
    return T(spark, d)


@query("q_a01_flow_aggregate", with_("SELECT * FROM ft", SQL_T, SQL_FT))
def _(spark, d):
    return FT(spark, d)


@query("q_k01_flow_upsert", with_("SELECT * FROM fe", SQL_E, SQL_FE))
def _(spark, d):
    e = fl.dedupe_transfers(E(spark, d))
    half = F.col("ts") < F.lit(1705276800)
    return fl.merge_flows(fl.flows_of(e.filter(half)), fl.flows_of(e.filter(~half)))


@query("q_k02_bulk_dedupe", with_("SELECT * FROM e", SQL_E))
def _(spark, d):
    e = E(spark, d)
    return fl.dedupe_transfers(e.unionAll(e)).select(e.columns)


OUT = "o AS (SELECT src AS account, count(*) AS out_degree, CAST(sum(total_amount) AS BIGINT) AS total_out_amount, CAST(sum(tx_count) AS BIGINT) AS out_tx_count FROM ft WHERE src <> dst GROUP BY src)"
IN = "i AS (SELECT dst AS account, count(*) AS in_degree, CAST(sum(total_amount) AS BIGINT) AS total_in_amount, CAST(sum(tx_count) AS BIGINT) AS in_tx_count FROM ft WHERE src <> dst GROUP BY dst)"
query("q_a02_out_aggregates", with_("SELECT * FROM o", SQL_T, SQL_FT, OUT))(lambda s, d: fl.out_aggregates(FT(s, d)))
query("q_a03_in_aggregates", with_("SELECT * FROM i", SQL_T, SQL_FT, IN))(lambda s, d: fl.in_aggregates(FT(s, d)))
LOOPS = "SELECT src AS account, CAST(sum(tx_count) AS BIGINT) AS self_loop_count, CAST(sum(total_amount) AS BIGINT) AS self_loop_amount FROM fe WHERE src = dst GROUP BY src"
query("q_a04_self_loops", with_(LOOPS, SQL_E, SQL_FE))(lambda s, d: fl.self_loops(FE(s, d)))
FIRST = "SELECT account, min(CASE WHEN first_ts > 0 THEN first_ts END) AS first_activity FROM (SELECT src AS account, first_ts FROM ft UNION ALL SELECT dst, first_ts FROM ft) GROUP BY account"
query("q_a05_first_activity", with_(FIRST, SQL_T, SQL_FT))(lambda s, d: fl.first_activity(FT(s, d)))
query("q_u01_endpoints", with_("SELECT src AS account FROM ft UNION SELECT dst FROM ft", SQL_T, SQL_FT))(lambda s, d: fl.endpoints(FT(s, d)))
UND = "SELECT least(src, dst) AS a, greatest(src, dst) AS b, round(sum(ln(1 + greatest(total_amount, 0))), 6) AS weight, CAST(sum(total_amount) AS BIGINT) AS total_amount, CAST(sum(tx_count) AS BIGINT) AS tx_count FROM ft WHERE src <> dst GROUP BY ALL"
query("q_a09_undirected", with_(UND, SQL_T, SQL_FT))(lambda s, d: fl.undirected(FT(s, d)).withColumn("weight", F.round("weight", 6)))
query("q_g08_weight_modes", with_("SELECT least(src, dst) AS a, greatest(src, dst) AS b, CAST(sum(greatest(total_amount, 0)) AS DOUBLE) AS amount, CAST(sum(tx_count) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS one FROM fe WHERE src <> dst GROUP BY ALL", SQL_E, SQL_FE))(
    lambda s, d: (lambda f: fl.undirected(f, "amount").select("a", "b", F.col("weight").alias("amount")).join(fl.undirected(f, "tx_count").select("a", "b", F.col("weight").alias("n")), ["a", "b"]).join(fl.undirected(f, "unweighted").select("a", "b", F.col("weight").alias("one")), ["a", "b"]))(FE(s, d))
)
query("q_a10_strong_edges", with_(f"SELECT * FROM ({UND}) WHERE tx_count >= 3", SQL_T, SQL_FT))(lambda s, d: fl.strong_edges(fl.undirected(FT(s, d)), 3).withColumn("weight", F.round("weight", 6)))
query("q_s07_export_flows", with_("SELECT src, dst, total_amount, tx_count, first_ts, last_ts FROM fe, ref WHERE last_ts >= r - 7 * 86400", SQL_E, SQL_FE, SQL_REF_E))(lambda s, d: (lambda f: fl.export_flows(f, reference(f), 7))(FE(s, d)))
query("q_s08_export_nodes", with_("SELECT account, labels, gnn_risk_score FROM acc WHERE account IS NOT NULL", SQL_ACC))(lambda s, d: accounts(s, d).filter("account IS NOT NULL").select("account", "labels", "gnn_risk_score"))
query("q_j03_reciprocal_pairs", with_("SELECT x.src AS a, x.dst AS b FROM fe x JOIN fe y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst", SQL_E, SQL_FE))(lambda s, d: fl.reciprocal_pairs(FE(s, d)))
query("q_j04_induced_subgraph", with_("SELECT ft.* FROM ft WHERE src IN (SELECT account FROM acc WHERE community_id = 'c7') AND dst IN (SELECT account FROM acc WHERE community_id = 'c7')", SQL_T, SQL_FT, SQL_ACC))(lambda s, d: fl.induced(FT(s, d), accounts(s, d).filter("community_id = 'c7'")))
query("q_j08_top_payees", with_("SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY src ORDER BY total_amount DESC, dst) AS INTEGER) AS rank FROM ft WHERE src <> dst) WHERE rank <= 5", SQL_T, SQL_FT))(lambda s, d: fl.top_neighbours(FT(s, d), 5))
query("q_a16_flow_between", with_("SELECT count(*) AS tx_count, CAST(coalesce(sum(amount_cents), 0) AS BIGINT) AS total, avg(amount_cents) AS mean, CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS path_count FROM e, ref WHERE sender_id = 'A7' AND receiver_id = 'A9' AND ts >= r - 2592000", SQL_E, SQL_FE, SQL_REF_E))(
    lambda s, d: fl.flow_between(E(s, d), "A7", "A9", reference(FE(s, d)) - 30 * 86400)
)
query("q_a26_time_quantile", with_("SELECT r AS anchor FROM ref", SQL_T, SQL_FT, SQL_REF_T))(lambda s, d: fl.time_quantile(FT(s, d), 0.999))
query("q_a13_graph_counts", with_("SELECT (SELECT count(*) FROM acc) AS accounts, (SELECT count(gnn_risk_score) FROM acc) AS scored, (SELECT count(DISTINCT community_id) FROM acc) AS communities, (SELECT CAST(sum(in_cycle::INT) AS BIGINT) FROM acc) AS in_cycle, (SELECT count(*) FROM ft) AS flows, (SELECT count(*) FROM t) AS transactions", SQL_T, SQL_FT, SQL_ACC))(
    lambda s, d: fl.graph_counts(T(s, d), FT(s, d), accounts(s, d))
)
query("q_u04_orphans", with_("SELECT src AS account FROM ft UNION SELECT dst FROM ft EXCEPT SELECT account FROM acc WHERE community_id <> 'c3'", SQL_T, SQL_FT, SQL_ACC))(lambda s, d: fl.endpoints(FT(s, d)).join(accounts(s, d).filter("community_id <> 'c3'"), "account", "left_anti"))
query("q_u03_flagged_members", with_("SELECT account FROM acc WHERE in_cycle INTERSECT SELECT src FROM ft", SQL_T, SQL_FT, SQL_ACC))(lambda s, d: accounts(s, d).filter("in_cycle").select("account").intersect(FT(s, d).select(F.col("src").alias("account"))))

# ---- series and windows

HIST = "h AS (SELECT coalesce(rail, 'UNKNOWN') AS rail, ts // 1800 AS bucket, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS cents FROM e GROUP BY ALL)"
BOUNDS = "b AS (SELECT coalesce(min(bucket) * 1800, 0) AS s, coalesce((max(bucket) + 1) * 1800, 0) AS x FROM h)"
query("q_a11_histogram", with_("SELECT * FROM h", SQL_E, HIST))(lambda s, d: se.histogram(E(s, d)))
query("q_a12_currency_totals", with_("SELECT regexp_replace(rail, '^IBM_AML_', '') AS currency, CAST(sum(n) AS BIGINT) AS count, sum(cents) / 100.0::DOUBLE AS volume FROM h GROUP BY ALL", SQL_E, HIST))(lambda s, d: se.currency_totals(se.histogram(E(s, d))))
query("q_a31_bounds", with_("SELECT s AS start, x AS \"end\" FROM b", SQL_E, HIST, BOUNDS))(lambda s, d: se.bounds(se.histogram(E(s, d))))


def _series(period):
    def run(spark, d):
        hist = se.histogram(E(spark, d).filter("rail = 'click'"))
        start, end = se.bounds(se.histogram(E(spark, d))).first()
        return se.series(hist, *se.period_window(period, start, end))

    return run


def _series_sql(bucket, span):
    start = "s" if span is None else f"greatest(s, x - {span})"
    return with_(f"""SELECT least(p.st + i * {bucket}, p.en) AS t, sum(coalesce(c, 0)) OVER w / 100.0::DOUBLE AS volume, CAST(sum(coalesce(k, 0)) OVER w AS BIGINT) AS txns,
coalesce((SELECT sum(cents) FROM h, p WHERE rail = 'click' AND bucket * 1800 >= p.st AND bucket * 1800 < p.en), 0) / 100.0::DOUBLE * i / g.m AS baseline
FROM g LEFT JOIN a USING (i), p WINDOW w AS (ORDER BY i)""", SQL_E, HIST, BOUNDS, f"p AS (SELECT {start} AS st, x AS en FROM b)",
        f"a AS (SELECT (bucket * 1800 - p.st) // {bucket} + 1 AS i, sum(n) AS k, sum(cents) AS c FROM h, p WHERE rail = 'click' AND bucket * 1800 >= p.st AND bucket * 1800 < p.en GROUP BY ALL)",
        f"g AS (SELECT unnest(range(0, CAST(ceil((en - st) / {bucket}) AS BIGINT) + 1)) AS i, CAST(ceil((en - st) / {bucket}) AS BIGINT) AS m FROM p)")


query("q_w01_series_24h", _series_sql(1800, 86400))(_series("24h"))
query("q_w02_series_7d", _series_sql(21600, 604800))(_series("7d"))
query("q_t04_series_all", _series_sql(86400, None))(_series("all"))
query("q_w03_activity_end", with_("SELECT min(least((SELECT x FROM b), (bucket + 1) * 1800)) AS activity_end FROM (SELECT bucket, sum(sum(n)) OVER (ORDER BY bucket) AS u, sum(sum(n)) OVER () AS a FROM h GROUP BY bucket) WHERE u >= 0.999 * a", SQL_E, HIST, BOUNDS))(
    lambda s, d: (lambda h: se.activity_end(h, 0.999, se.bounds(h).first()[1]))(se.histogram(E(s, d)))
)
MEMBERS = "m AS (SELECT DISTINCT sender_id AS src, receiver_id AS dst, amount_cents, ts FROM e)"
query("q_k08_edge_series", with_("SELECT * FROM m", SQL_E, MEMBERS))(lambda s, d: se.edge_series(E(s, d)))
_VOL = ", ".join(f"CAST(sum(CASE WHEN ts >= r - {h} * 3600 AND {c} THEN {v} ELSE 0 END) AS BIGINT) AS {p}_{s}_{w}" for h, w in ((1, "1h"), (24, "24h"), (168, "7d")) for s, c in (("out", "o"), ("in", "NOT o")) for p, v in (("volume", "amount_cents"), ("txn", "1")))
VOLUMES = f"vol AS (SELECT account, {_VOL} FROM (SELECT src AS account, true AS o, amount_cents, ts FROM m UNION ALL SELECT dst, false, amount_cents, ts FROM m), ref WHERE ts BETWEEN r - 604800 AND r GROUP BY account)"
query("q_t01_account_volumes", with_("SELECT * FROM vol", SQL_E, SQL_FE, SQL_REF_E, MEMBERS, VOLUMES))(lambda s, d: se.account_volumes(se.edge_series(E(s, d)), reference(FE(s, d))))
query("q_a17_edge_volume", with_("SELECT CAST(coalesce(sum(amount_cents), 0) AS BIGINT) AS volume, count(*) AS tx_count, min(ts) AS earliest, max(ts) AS latest FROM m, ref WHERE src = 'A7' AND dst = 'A9' AND ts BETWEEN r - 720 * 3600 AND r", SQL_E, SQL_FE, SQL_REF_E, MEMBERS))(
    lambda s, d: se.edge_volume(se.edge_series(E(s, d)), "A7", "A9", reference(FE(s, d)), 720)
)
query("q_a18_busy_edges", with_("SELECT src, dst, CAST(sum(amount_cents) AS BIGINT) AS volume, count(*) AS tx_count FROM m, ref WHERE ts BETWEEN r - 168 * 3600 AND r GROUP BY ALL HAVING sum(amount_cents) >= 10000 ORDER BY volume DESC, src, dst LIMIT 50", SQL_E, SQL_FE, SQL_REF_E, MEMBERS))(
    lambda s, d: se.busy_edges(se.edge_series(E(s, d)), reference(FE(s, d)), 168, 10_000, 50)
)
query("q_a19_account_inflow", with_("SELECT dst AS account, CAST(sum(CASE WHEN ts BETWEEN r - 86400 AND r THEN amount_cents ELSE 0 END) AS BIGINT) AS inflow, CAST(sum(CASE WHEN ts BETWEEN r - 86400 AND r THEN 1 ELSE 0 END) AS BIGINT) AS tx_count, count(DISTINCT src) AS source_count FROM m, ref GROUP BY dst", SQL_E, SQL_FE, SQL_REF_E, MEMBERS))(
    lambda s, d: se.account_inflow(se.edge_series(E(s, d)), reference(FE(s, d)), 24)
)
query("q_w04_hop_gaps", with_("SELECT sender_id, max(g) AS max_gap, coalesce(max(g) > 259200, false) AS too_wide FROM (SELECT sender_id, ts - lag(ts) OVER (PARTITION BY sender_id ORDER BY ts) AS g FROM e) GROUP BY sender_id", SQL_E))(lambda s, d: se.hop_gaps(E(s, d), "sender_id", 72 * 3600))
query("q_p08_edge_weight", with_("SELECT src, dst, greatest(1.0::DOUBLE, least(10.0::DOUBLE, total_amount / 100000.0::DOUBLE)) AS weight FROM ft", SQL_T, SQL_FT))(lambda s, d: FT(s, d).select("src", "dst", sc.edge_weight(F.col("total_amount")).alias("weight")))
