"""Queries over the graph: rings, ranks, labels, motifs, searches, communities, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary.functions import scoring as sc
from tributary.operators import features as fe
from tributary.operators import flows as fl
from tributary.operators import graph as gr
from tributary.operators import state as st
from tributary.plans.core import FIRST, IN, LOOPS, MEMBERS, OUT, VOLUMES
from tributary.plans.registry import E, FE, FT, SQL_ACC, SQL_FLAG, SQL_REF_E, SQL_REF_T, T, accounts, flags, query, reference, staged_flows, with_
from tributary.session import stage
from tributary.sources.adapters import SQL_E, SQL_FE, SQL_FT, SQL_T

ET, TT = (SQL_E, SQL_FE), (SQL_T, SQL_FT)


def ring_sql(depth: int, gap: int, mode: str = "hop", floor: int = 10_000) -> str:
    """All simple rings to ``depth`` by recursion, then the rules over whole rings."""
    edges = f"g AS (SELECT src, dst, {{'mi': min_amount, 'ma': max_amount, 'f': first_ts, 'r': rail}} AS h FROM fe WHERE src <> dst AND max_amount >= {floor})"
    paths = f"""r AS (SELECT src AS s, dst AS l, [src, dst] AS nodes, [h] AS hops FROM g WHERE dst > src
  UNION ALL SELECT s, dst, list_append(nodes, dst), list_append(hops, h) FROM r JOIN g ON src = l WHERE len(nodes) < {depth} AND dst > s AND NOT list_contains(nodes, dst)
  AND NOT (h.f >= hops[-1].f AND h.f - hops[-1].f > {gap}))"""
    closed = "c AS (SELECT nodes, list_append(hops, h) AS hops FROM r JOIN g ON src = l AND dst = s)"
    pairs = "q AS (SELECT nodes, hops, list_transform(range(1, len(hops) + 1), lambda i: {'a': hops[i], 'b': hops[CASE WHEN i = len(hops) THEN 1 ELSE i + 1 END]}) AS ps FROM c)"
    hop = "AND len(list_filter(ps, lambda p: p.a.r = p.b.r AND NOT (p.b.mi <= p.a.ma AND p.b.ma >= floor(p.a.mi * (1 - 0.2::DOUBLE))))) <= 1" if mode == "hop" else ""
    hop = hop if mode != "cycle" else "AND list_max(list_transform(hops, lambda x: x.ma)) * (1 - 0.6::DOUBLE) <= list_min(list_transform(hops, lambda x: x.ma))"
    body = f"""SELECT sha256(array_to_string(nodes, '→')) AS fingerprint, nodes AS ring, CAST(len(nodes) AS INTEGER) AS n_hops FROM q
WHERE len(list_filter(ps, lambda p: p.b.f < p.a.f)) <= 1 AND len(list_filter(ps, lambda p: p.b.f >= p.a.f AND p.b.f - p.a.f > {gap})) = 0 {hop}"""
    return "WITH RECURSIVE " + ",\n".join([*ET, edges, paths, closed, pairs]) + "\n" + body


RULES = gr.RingRules()


def _rings(mode):
    return lambda s, d: gr.find_rings(FE(s, d), gr.RingRules(conservation=mode)).select("fingerprint", "ring", "n_hops")


for _mode in ("hop", "cycle", "off"):
    query(f"q_g01_rings_{_mode}", ring_sql(RULES.depth, RULES.gap_seconds, _mode, RULES.floor_cents))(_rings(_mode))


@query("q_g04_ring_sweep", "SELECT DISTINCT unnest(ring) AS account FROM (" + ring_sql(RULES.depth, RULES.gap_seconds) + ")")
def _(s, d):
    return gr.ring_members(gr.find_rings(FE(s, d)))


@query("q_l07_capped_rings", "SELECT fingerprint, ring, n_hops FROM (SELECT *, row_number() OVER (PARTITION BY ring[1] ORDER BY n_hops, fingerprint) AS k FROM (" + ring_sql(RULES.depth, RULES.gap_seconds) + ")) WHERE k <= 1")
def _(s, d):
    return gr.find_rings(FE(s, d), gr.RingRules(most=1)).select("fingerprint", "ring", "n_hops")


@query("q_g01_rings_from_pairs")
def _(s, d):
    f = FE(s, d)
    pairs = fl.reciprocal_pairs(f).orderBy("a", "b").limit(500)  # the feature takes its first 500 pairs as seeds
    return gr.find_rings(f, RULES, pairs.select(F.explode(F.array("a", "b")).alias("account"))).select("fingerprint", "ring", "n_hops")


RINGS2 = "p2 AS (SELECT x.src AS a, x.dst AS b, [x.max_amount, y.max_amount] AS am, [x.last_ts, y.last_ts] AS tm FROM fe x JOIN fe y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst)"
LN1 = "ln(1 + {})"
C1 = """SELECT a, b, round(vs, 4) AS value_score, round(ve, 4) AS velocity_score, round(co, 4) AS consistency_score, round(0.3 * vs + 0.35 * ve + 0.25 * co + 0.05, 4) AS risk_score FROM (
SELECT a, b, least(1.0::DOUBLE, ln(1 + greatest(list_min(am), 10000) / 10000.0::DOUBLE) / ln(1 + 10000.0::DOUBLE)) AS vs,
CASE WHEN tm[1] = tm[2] THEN 1.0::DOUBLE ELSE greatest(0, 1 - abs(tm[1] - tm[2]) / 259200.0::DOUBLE) END AS ve,
greatest(0, 1 - abs(am[1] - am[2]) / 2.0::DOUBLE / ((am[1] + am[2]) / 2.0::DOUBLE)) AS co FROM p2)"""


@query("q_c01_score_ring", with_(C1, *ET, RINGS2))
def _(s, d):
    f = FE(s, d).select("src", "dst", "max_amount", "last_ts")
    back = f.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("max_amount").alias("m2"), F.col("last_ts").alias("t2"))
    pair = f.filter("src < dst").join(back, ["src", "dst"])
    scored = pair.select(F.col("src").alias("a"), F.col("dst").alias("b"), sc.score_ring(F.array("max_amount", "m2"), F.array("last_ts", "t2")).alias("x"))
    return scored.select("a", "b", "x.value_score", "x.velocity_score", "x.consistency_score", "x.risk_score")


PATHS = "tri AS (SELECT x.src AS a, x.dst AS b, y.dst AS c, z.dst AS e FROM fe x JOIN fe y ON x.dst = y.src JOIN fe z ON y.dst = z.src WHERE x.src IN ('A1', 'A2'))"
query("q_g02_simple_paths", with_("SELECT a, b, c, e, b <> c AS simple FROM tri", *ET, PATHS))(
    lambda s, d: (lambda f: f.filter("src IN ('A1', 'A2')").select(F.col("src").alias("a"), F.col("dst").alias("b")).join(f.select(F.col("src").alias("b"), F.col("dst").alias("c")), "b").join(f.select(F.col("src").alias("c"), F.col("dst").alias("e")), "c").select("a", "b", "c", "e", gr.is_simple(F.array("a", "b", "c", "e")).alias("simple")))(FE(s, d))
)
query("q_g03_fingerprints", with_("SELECT src, dst, sha256(least(src, dst) || '→' || greatest(src, dst)) AS fingerprint FROM fe WHERE src <> dst", *ET))(lambda s, d: FE(s, d).filter("src <> dst").select("src", "dst", gr.fingerprint(F.array("src", "dst", "src")).alias("fingerprint")))


def rank_sql(rounds: int) -> str:
    base = ["w AS (SELECT src, dst, total_amount / sum(total_amount) OVER (PARTITION BY src)::DOUBLE AS p FROM fe)", "n AS (SELECT src AS account FROM fe UNION SELECT dst FROM fe)", "k AS (SELECT count(*) AS k FROM n)", "r0 AS (SELECT account, 1.0::DOUBLE / k AS s FROM n, k)"]
    for i in range(rounds):
        base.append(f"""r{i + 1} AS MATERIALIZED (SELECT n.account, (0.15::DOUBLE + 0.85::DOUBLE * (SELECT coalesce(sum(s), 0) FROM r{i} WHERE account NOT IN (SELECT src FROM w))) / k + 0.85::DOUBLE * coalesce(g, 0) AS s
  FROM n CROSS JOIN k LEFT JOIN (SELECT dst, sum(p * s) AS g FROM w JOIN r{i} ON src = account GROUP BY dst) x ON x.dst = n.account)""")
    return with_(f"SELECT account, round(s, 8) AS pagerank_score FROM r{rounds}", *ET, *base)


query("q_g05_pagerank")(lambda s, d: gr.pagerank(FE(s, d)))
query("q_g05_pagerank_five_rounds", rank_sql(5))(lambda s, d: gr.pagerank(FE(s, d), iterations=5, tolerance=0.0, places=8))
query("q_g06_pagerank_small")(lambda s, d: gr.pagerank(fl.induced(FE(s, d), accounts(s, d).filter("community_id IN ('c1', 'c2', 'c3', 'c4')")), iterations=30))
query("q_g07_local_pagerank")(lambda s, d: gr.local_pagerank(FE(s, d), s.createDataFrame([("A7",), ("A9",)], "account string")))

E1 = "u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM fe WHERE src <> dst)"
BOTH = "v AS (SELECT a, b FROM u UNION ALL SELECT b, a FROM u)"
query("q_g10_split_disconnected", "WITH RECURSIVE " + ",\n".join([*TT, SQL_ACC, "e2 AS (SELECT src AS a, dst AS b FROM ft JOIN acc x ON x.account = src JOIN acc y ON y.account = dst WHERE x.community_id = y.community_id AND src <> dst)", "v AS (SELECT a, b FROM e2 UNION SELECT b, a FROM e2)", "r AS (SELECT account, account AS part FROM acc UNION SELECT b, part FROM r JOIN v ON a = account)"]) + "\nSELECT account, min(part) AS part FROM r GROUP BY account")(
    lambda s, d: gr.split_disconnected(fl.undirected(FT(s, d)), accounts(s, d).select("account", F.col("community_id").alias("community")))
)
query("q_g14_kcore")(lambda s, d: gr.coreness(fl.undirected(FE(s, d), "unweighted")))
query("q_g20_strong_components", "WITH RECURSIVE " + ",\n".join([*ET, "g AS (SELECT DISTINCT src, dst FROM fe WHERE src <> dst)", "r AS (SELECT src AS a, src AS b FROM g UNION SELECT dst, dst FROM g UNION SELECT a, dst FROM r JOIN g ON b = src)"]) + "\nSELECT x.a AS account, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a")(
    lambda s, d: gr.strong_components(FE(s, d))
)
TRI = "tr AS (SELECT x.a, x.b, y.b AS c FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b)"
DEG = "dg AS (SELECT a AS account, count(*) AS k FROM v GROUP BY a)"
TRIS = "SELECT dg.account, coalesce(n, 0) AS triangles, CASE WHEN k > 1 THEN coalesce(n, 0) / (k * (k - 1) / 2.0::DOUBLE) ELSE 0 END AS clustering FROM dg LEFT JOIN (SELECT account, count(*) AS n FROM (SELECT unnest([a, b, c]) AS account FROM tr) GROUP BY account) q ON q.account = dg.account"
query("q_g15_triangles", with_(TRIS, *ET, E1, BOTH, DEG, TRI))(lambda s, d: gr.triangles(FE(s, d)))
RECIP = "SELECT a AS account, avg(CASE WHEN EXISTS (SELECT 1 FROM fe f WHERE f.src = v.a AND f.dst = v.b) AND EXISTS (SELECT 1 FROM fe f WHERE f.src = v.b AND f.dst = v.a) THEN 1.0::DOUBLE ELSE 0 END) AS reciprocity FROM v GROUP BY a"
query("q_g16_reciprocity", with_(RECIP, *ET, E1, BOTH))(lambda s, d: gr.reciprocity(FE(s, d)))
NS = "ns AS (SELECT src, dst FROM ft WHERE src <> dst), od AS (SELECT src AS account, count(*) AS o FROM ns GROUP BY src), idg AS (SELECT dst AS account, count(*) AS i FROM ns GROUP BY dst), nn AS (SELECT src AS account FROM ns UNION SELECT dst FROM ns)"
NBR = """SELECT nn.account, ln(1 + coalesce(m, 0)::DOUBLE) AS log_nbr_out_deg, ln(1 + coalesce(hi, 0)::DOUBLE) AS max_payee_in_deg, ln(1 + coalesce(ho, 0)::DOUBLE) AS max_payer_out_deg FROM nn
LEFT JOIN (SELECT dst AS account, avg(o) AS m, max(o) AS ho FROM ns JOIN od ON od.account = src GROUP BY dst) x ON x.account = nn.account
LEFT JOIN (SELECT src AS account, max(i) AS hi FROM ns JOIN idg ON idg.account = dst GROUP BY src) y ON y.account = nn.account"""
query("q_g17_neighbour_degrees", with_(NBR, *TT, NS))(lambda s, d: gr.neighbour_degrees(staged_flows(s, d)))
HOP2 = """SELECT nn.account, ln(1 + coalesce(o, 0)::DOUBLE) AS two_hop_out, ln(1 + coalesce(i, 0)::DOUBLE) AS two_hop_in FROM nn
LEFT JOIN (SELECT x.src AS account, count(DISTINCT y.dst) AS o FROM ns x JOIN ns y ON x.dst = y.src GROUP BY x.src) p ON p.account = nn.account
LEFT JOIN (SELECT y.dst AS account, count(DISTINCT x.src) AS i FROM ns x JOIN ns y ON x.dst = y.src GROUP BY y.dst) q ON q.account = nn.account"""
query("q_g19_two_hop", with_(HOP2, *TT, NS))(lambda s, d: gr.two_hop(T(s, d).select(F.col("sender_id").alias("src"), F.col("receiver_id").alias("dst"))))


def _one(s, *names):
    return s.createDataFrame([(n,) for n in names], "account string")


BFS = "WITH RECURSIVE " + ",\n".join([*ET, "r AS (SELECT 'A7' AS account, 0 AS distance UNION SELECT dst, distance + 1 FROM r JOIN fe ON src = account WHERE src <> dst AND distance < {0})"])
query("q_g21_subgraph", BFS.format(1) + "\nSELECT src, dst, total_amount, tx_count FROM fe WHERE src <> dst AND src IN (SELECT account FROM r) AND dst IN (SELECT account FROM r)")(lambda s, d: gr.subgraph(FE(s, d), _one(s, "A7"), 1))
query("q_g22_shortest_path", "WITH RECURSIVE " + ",\n".join([*ET, "r AS (SELECT ['A7'] AS path, 'A7' AS l UNION ALL SELECT list_append(path, dst), dst FROM r JOIN fe ON src = l WHERE len(path) <= 3 AND src <> dst AND NOT list_contains(path, dst))"]) + "\nSELECT path, CAST(len(path) - 1 AS INTEGER) AS hops FROM r WHERE l = 'A42' ORDER BY len(path), path LIMIT 1")(lambda s, d: gr.shortest_path(FE(s, d), "A7", "A42", 3))
query("q_g23_neighbourhood")(lambda s, d: gr.neighbourhood(FE(s, d), _one(s, "A7", "A9"), 2, 5, 60))
query("q_g25_farthest", BFS.format(4) + "\nSELECT account, min(distance) AS distance FROM r GROUP BY account ORDER BY distance DESC, account LIMIT 1")(lambda s, d: gr.farthest(FE(s, d), "A7", 4))
query("q_g24_community_subgraph", with_("SELECT src, dst, total_amount FROM ft WHERE src <> dst AND src IN (SELECT account FROM acc WHERE community_id = 'c9') AND dst IN (SELECT account FROM acc WHERE community_id = 'c9')", *TT, SQL_ACC))(lambda s, d: fl.without_self(fl.induced(FT(s, d), accounts(s, d).filter("community_id = 'c9'"))).select("src", "dst", "total_amount"))
query("q_g26_sample")(lambda s, d: gr.sample_neighbours(FE(s, d), _one(s, "A7", "A9"), 5, 2))

# ---- communities


def _pairs(s, d):
    return stage(fl.undirected(FT(s, d), "tx_count"), "pairs")


def _members(s, d):
    return accounts(s, d).select("account", F.col("community_id").alias("community"))


UT = "up AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, CAST(sum(tx_count) AS DOUBLE) AS weight, CAST(sum(total_amount) AS BIGINT) AS total_amount FROM ft WHERE src <> dst GROUP BY ALL)"
ENDS = "en AS (SELECT up.*, x.community_id AS ca, y.community_id AS cb FROM up JOIN acc x ON x.account = a JOIN acc y ON y.account = b)"
SHAPE = """sh AS (SELECT z.community, n, coalesce(m, 0) AS m, coalesce(cents, 0) AS cents, CASE WHEN least(vol, tot - vol) > 1e-9 THEN greatest(0, least(1, (vol - 2 * coalesce(w, 0)) / least(vol, tot - vol))) ELSE 0 END AS conductance FROM
(SELECT community_id AS community, count(*) AS n FROM acc GROUP BY ALL) z LEFT JOIN (SELECT c, sum(weight) AS vol FROM (SELECT unnest([ca, cb]) AS c, weight FROM en) GROUP BY c) v ON v.c = z.community
LEFT JOIN (SELECT ca, count(*) AS m, CAST(sum(total_amount) AS BIGINT) AS cents, sum(weight) AS w FROM en WHERE ca = cb GROUP BY ca) i ON i.ca = z.community, (SELECT 2 * sum(weight) AS tot FROM en) t)"""
query("q_g12_conductance", with_("SELECT * FROM sh", *TT, SQL_ACC, UT, ENDS, SHAPE))(lambda s, d: gr.community_shape(_pairs(s, d), _members(s, d)))
FLAGGED = "fm AS (SELECT community_id AS community, count(*) AS f FROM acc WHERE account IN (SELECT unnest(account_ids) FROM flag WHERE status = 'open' AND flag_type <> 'COMMUNITY') GROUP BY ALL)"
C2 = """SELECT community, round(sz, 4) AS size_score, round(de, 4) AS density_score, round(vo, 4) AS volume_score, round(ov, 4) AS overlap_score, round(least(1, 0.1 * sz + 0.15 * de + 0.25 * vo + 0.15 * (1 - conductance) + 0.35 * ov), 4) AS risk_score FROM (
SELECT sh.community, conductance, CASE WHEN n <= 3 THEN 0.2::DOUBLE WHEN n <= 7 THEN 0.7 WHEN n <= 50 THEN 1 WHEN n <= 150 THEN 0.5 ELSE 0.1 END AS sz, least(1, greatest(0, m - (n - 1)) / (n - 1)::DOUBLE / 0.6::DOUBLE) AS de,
least(1, ln(greatest(cents, 1000000) / 1000000.0::DOUBLE + 1) / ln(1001.0::DOUBLE)) AS vo, least(1, coalesce(f, 0) / n::DOUBLE / 0.25::DOUBLE) AS ov FROM sh LEFT JOIN fm ON fm.community = sh.community)"""


@query("q_c02_score_community", with_(C2, *TT, SQL_ACC, SQL_FLAG, UT, ENDS, SHAPE, FLAGGED))
def _(s, d):
    shape = gr.community_shape(_pairs(s, d), _members(s, d))
    hit = _members(s, d).join(st.flag_accounts(flags(s, d), "COMMUNITY"), "account", "left_semi").groupBy("community").agg(F.count("*").alias("f"))
    scored = shape.join(hit, "community", "left").select("community", sc.score_community(F.col("n"), F.col("m"), F.col("cents"), F.coalesce("f", F.lit(0)), F.col("conductance")).alias("x"))
    return scored.select("community", "x.size_score", "x.density_score", "x.volume_score", "x.overlap_score", "x.risk_score")


CORE = """SELECT community_id AS community, sha256(string_agg(account, '|' ORDER BY account)) AS fingerprint, substr(sha256(string_agg(account, '|' ORDER BY account)), 1, 12) AS community_id FROM (
SELECT acc.account, community_id, row_number() OVER (PARTITION BY community_id ORDER BY coalesce(w, 0) DESC, acc.account) AS k FROM acc LEFT JOIN (SELECT account, sum(weight) AS w FROM (SELECT unnest([a, b]) AS account, weight FROM en WHERE ca = cb) GROUP BY account) q ON q.account = acc.account) WHERE k <= 10 GROUP BY acc_community"""
CORE = CORE.replace("GROUP BY acc_community", "GROUP BY 1").replace("SELECT community_id AS community, sha256", "SELECT community_id AS community, sha256")
query("q_g11_community_names", with_(CORE, *TT, SQL_ACC, UT, ENDS))(lambda s, d: gr.community_names(_pairs(s, d), _members(s, d)))
query("q_g09_communities")(lambda s, d: gr.communities(fl.undirected(FE(s, d))))


@query("q_g13_community_batch")
def _(s, d):
    f = FE(s, d)
    pairs = fl.strong_edges(fl.undirected(fl.export_flows(f, reference(f), 30)), 1)
    return gr_batch(pairs, st.flag_accounts(flags(s, d), "COMMUNITY"))


def gr_batch(pairs, flagged, rounds: int = 20):
    """Partition, connected parts of three accounts or more, their shape, name and score; those of medium level or above are flags."""
    found = gr.communities(pairs, rounds)
    parts = gr.split_disconnected(pairs, found).withColumnRenamed("part", "community")
    big = parts.groupBy("community").agg(F.count("*").alias("n")).filter("n >= 3").select("community")
    kept = parts.join(big, "community", "left_semi")
    hit = kept.join(flagged, "account", "left_semi").groupBy("community").agg(F.count("*").alias("f"))
    shape = gr.community_shape(pairs, kept).join(hit, "community", "left").join(gr.community_names(pairs, kept), "community")
    x = sc.score_community(F.col("n"), F.col("m"), F.col("cents"), F.coalesce("f", F.lit(0)), F.col("conductance"))
    return shape.withColumn("x", x).select("fingerprint", "community_id", "n", "m", "cents", F.round("conductance", 6).alias("conductance"), "x.risk_score", "x.risk_level", (F.col("x.risk_level") != "low").alias("flag"))


# ---- features

BASE = f"""SELECT n.account, coalesce(out_degree, 0)::DOUBLE AS out_degree, coalesce(in_degree, 0)::DOUBLE AS in_degree, coalesce(total_in_amount, 0)::DOUBLE - coalesce(total_out_amount, 0) AS net_flow,
CASE WHEN coalesce(total_in_amount, 0) + coalesce(total_out_amount, 0) > 0 THEN coalesce(total_out_amount, 0)::DOUBLE / (coalesce(total_in_amount, 0) + coalesce(total_out_amount, 0)) ELSE 0 END AS flow_ratio,
coalesce(greatest(0, (r - first_activity) / 86400.0::DOUBLE), 0) AS account_age_days FROM (SELECT account FROM acc UNION SELECT src FROM ft UNION SELECT dst FROM ft) n LEFT JOIN o USING (account) LEFT JOIN i USING (account) LEFT JOIN ({FIRST}) fa USING (account), ref"""
query("q_f01_feature_base", with_(BASE, *TT, SQL_ACC, SQL_REF_T, OUT, IN))(lambda s, d: (lambda f: fe.base(f, accounts(s, d), reference(f)).select("account", "out_degree", "in_degree", "net_flow", "flow_ratio", "account_age_days"))(staged_flows(s, d)))
query("q_f02_account_age", with_(f"SELECT account, greatest(0, (r - first_activity) / 86400.0::DOUBLE) AS account_age_days FROM ({FIRST}), ref", *TT, SQL_REF_T))(lambda s, d: (lambda f: fl.first_activity(f).select("account", F.greatest(F.lit(0.0), (reference(f) - F.col("first_activity")) / 86400.0).alias("account_age_days")))(staged_flows(s, d)))
query("q_f04_node_types", with_("SELECT account, " + ", ".join(f"list_contains(labels, '{t}')::INT::DOUBLE AS is_{t.lower()}" for t in fe.NODE_TYPES) + " FROM acc", SQL_ACC))(lambda s, d: fe.node_types(accounts(s, d)).select("account", *fe.NODE_TYPE))
RATIO = lambda a, b, n: f"CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0 END AS {n}"
query("q_f03_derived", with_("SELECT account, " + ", ".join([RATIO("total_out_amount", "out_tx_count", "avg_out_amount"), RATIO("total_in_amount", "in_tx_count", "avg_in_amount"), RATIO("out_degree", "out_degree + in_degree", "degree_ratio"), RATIO("out_tx_count + in_tx_count", "out_degree + in_degree", "tx_per_counterparty"), RATIO("txn_out_1h + txn_in_1h", "txn_out_24h + txn_in_24h", "burst_1h_24h"), RATIO("txn_out_24h + txn_in_24h", "txn_out_7d + txn_in_7d", "burst_24h_7d"), RATIO("total_out_amount + total_in_amount", "out_degree + in_degree", "amount_per_degree")]) + " FROM o JOIN i USING (account) JOIN vol USING (account)", *ET, SQL_REF_E, MEMBERS, VOLUMES, OUT.replace("ft", "fe"), IN.replace("ft", "fe")))(
    lambda s, d: (lambda f: fe.derived(fl.out_aggregates(f).join(fl.in_aggregates(f), "account").join(fe.volumes_of(E(s, d), reference(f)), "account")).select("account", *fe.DERIVED))(FE(s, d))
)


@query("q_f05_feature_matrix")
def _(s, d):
    f = stage(FE(s, d), "flows")
    ref = reference(f)
    a = accounts(s, d)
    return fe.assemble(f, a, fe.volumes_of(E(s, d), ref), fe.community_stats(a, flags(s, d)), gr.pagerank(f), ref)


@query("q_f06_incremental_features")
def _(s, d):
    f = stage(FE(s, d), "flows")
    near = gr.neighbourhood(f, _one(s, "A7", "A9"), 3, 10, 300)
    return fe.assemble(fl.induced(f, near), near.select("account"), None, None, None, reference(f))


COMM = """SELECT acc.account, CAST(z.n AS BIGINT) AS community_size, q.rs AS community_risk_score, q.fm AS community_flagged_members FROM acc LEFT JOIN (SELECT community_id, count(*) AS n FROM acc GROUP BY ALL) z ON z.community_id = acc.community_id
LEFT JOIN (SELECT json_extract_string(details, '$.community_id') AS c, arg_min(risk_score, last_detected_at) AS rs, arg_min(CAST(json_extract_string(details, '$.flagged_member_count') AS DOUBLE), last_detected_at) AS fm FROM flag WHERE flag_type = 'COMMUNITY' AND status = 'open' GROUP BY ALL) q ON q.c = acc.community_id"""
query("q_a07_community_stats", with_(COMM, SQL_ACC, SQL_FLAG))(lambda s, d: fe.community_stats(accounts(s, d), flags(s, d)))
query("q_a08_weak_labels", with_("SELECT account, CAST(max(y) AS BIGINT) AS y FROM (SELECT unnest(account_ids) AS account, list_position(['low', 'medium', 'high', 'critical'], risk_level) - 1 AS y FROM flag WHERE flag_type = 'CYCLE' AND status = 'open') GROUP BY account", SQL_FLAG))(lambda s, d: fe.weak_labels(flags(s, d)))
query("q_a06_community_size", with_("SELECT account, count(*) OVER (PARTITION BY community_id) AS size FROM acc", SQL_ACC))(lambda s, d: (lambda a: a.join(a.groupBy("community_id").agg(F.count("*").alias("size")), "community_id").select("account", "size"))(accounts(s, d)))
