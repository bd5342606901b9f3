"""Hand-computed fixtures for flows, rings, series, scores, metrics and state."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.functions import scoring as sc
from tributary.operators import features as fe
from tributary.operators import flows as fl
from tributary.operators import graph as gr
from tributary.operators import ml
from tributary.operators import series as se
from tributary.operators import state as st

COLS = "txn_id string, sender_id string, receiver_id string, amount_cents long, ts long, rail string, event_type string"


def transfers(spark, rows):
    return spark.createDataFrame([(f"t{i}", a, b, c, t, r, "SETTLEMENT") for i, (a, b, c, t, r) in enumerate(rows)], COLS)


def flows(spark, rows):
    return fl.flows_of(transfers(spark, [(*r, "USD")[:5] if len(r) == 4 else r for r in rows]))


RING = [("A", "B", 100_000, 0), ("B", "C", 95_000, 600), ("C", "A", 92_000, 1200)]


def rings(spark, rows, **rules):
    return gr.find_rings(flows(spark, rows), gr.RingRules(**rules)).collect()


def test_ring_is_found_once(spark):
    found = rings(spark, RING)
    assert [r["ring"] for r in found] == [["A", "B", "C"]]


def test_chain_and_floor_and_gap(spark):
    assert not rings(spark, RING[:2])
    assert not rings(spark, [("A", "B", 400, 0), *RING[1:]])
    assert not rings(spark, [*RING[:2], ("C", "A", 92_000, 864_000)], gap_seconds=86_400)
    assert not rings(spark, RING, window_seconds=48 * 3600, reference_ts=100 * 86400)


def test_conservation(spark):
    grows = [("A", "B", 100_000, 0), ("B", "C", 200_000, 600), ("C", "A", 300_000, 1200)]
    assert not rings(spark, grows, conservation="hop") and rings(spark, grows, conservation="off")
    mixed = [("A", "B", 100_000, 0, "USD"), ("B", "C", 700_000, 600, "CNY"), ("C", "A", 90_000, 1200, "USD")]
    assert rings(spark, mixed)
    with pytest.raises(ValueError):
        rings(spark, RING, conservation="other")


def test_parallel_transfers_are_one_flow(spark):
    f = flows(spark, [RING[0], *RING]).filter("src = 'A'").first()
    assert (f["tx_count"], f["total_amount"], f["rail"]) == (2, 200_000, "USD")


def test_triangle_path_and_core(spark):
    tri = flows(spark, [("0", "1", 1, 1), ("1", "2", 1, 1), ("2", "0", 1, 1)])
    assert {r["core"] for r in gr.coreness(fl.undirected(tri)).collect()} == {2}
    assert all(r["triangles"] == 1 and r["clustering"] == 1.0 for r in gr.triangles(tri).collect())
    path = flows(spark, [("0", "1", 1, 1), ("1", "2", 1, 1), ("2", "3", 1, 1)])
    assert {r["core"] for r in gr.coreness(fl.undirected(path)).collect()} == {1}
    assert all(r["triangles"] == 0 for r in gr.triangles(path).collect())


def test_reciprocity(spark):
    got = {r["account"]: r["reciprocity"] for r in gr.reciprocity(flows(spark, [("0", "1", 1, 1), ("1", "0", 1, 1), ("1", "2", 1, 1)])).collect()}
    assert got == {"0": 1.0, "1": 0.5, "2": 0.0}


def test_pagerank_sums_to_one_and_rejects(spark):
    f = flows(spark, [("A", "B", 1, 1), ("B", "C", 1, 1), ("C", "A", 1, 1)])
    scores = [r["pagerank_score"] for r in gr.pagerank(f).collect()]
    assert math.isclose(sum(scores), 1, abs_tol=1e-6) and max(scores) - min(scores) < 1e-6
    dangling = gr.pagerank(flows(spark, [("A", "B", 1, 1)]))
    assert math.isclose(sum(r["pagerank_score"] for r in dangling.collect()), 1, abs_tol=1e-5)
    with pytest.raises(ValueError):
        gr.pagerank(f, damping=1.5)
    with pytest.raises(ValueError):
        gr.pagerank(f.withColumn("total_amount", F.lit(-1)))


def test_two_communities_and_batch(spark):
    rows = [(f"S{i}", f"S{j}", 5_000_000, 1) for i in range(8) for j in range(i + 1, 8) for _ in range(3)] + [("B0", "B1", 20_000, 1), ("B1", "B2", 20_000, 1)]
    pairs = fl.undirected(flows(spark, rows))
    found = gr.communities(pairs)
    groups = {}
    for r in found.collect():
        groups.setdefault(r["community"], set()).add(r["account"][0])
    assert all(len(g) == 1 for g in groups.values())
    split = gr.split_disconnected(pairs, found)
    assert split.count() == found.count() == 11
    assert gr.modularity(pairs, found).first()["modularity"] >= 0


def test_strong_components(spark):
    f = flows(spark, [("A", "B", 1, 1), ("B", "C", 1, 1), ("C", "A", 1, 1), ("C", "D", 1, 1), ("D", "E", 1, 1), ("E", "D", 1, 1)])
    got = {r["account"]: r["component"] for r in gr.strong_components(f).collect()}
    assert got == {"A": "A", "B": "A", "C": "A", "D": "D", "E": "D"}


def test_neighbourhood_and_paths(spark):
    f = flows(spark, [("A", "B", 1, 1), ("B", "C", 1, 1), ("C", "D", 1, 1)])
    one = spark.createDataFrame([("A",)], "account string")
    assert {r["account"] for r in gr.neighbourhood(f, one, 2).collect()} == {"A", "B", "C"}
    assert gr.shortest_path(f, "A", "D").first()["path"] == ["A", "B", "C", "D"]
    assert not gr.shortest_path(f, "D", "A").collect()
    star = flows(spark, [("A", x, 1, 1) for x in "BCDEFG"])
    near = gr.neighbourhood(star, one, 1, 10, 3).collect()
    assert len(near) == 3 and "A" in {r["account"] for r in near}


def test_series(spark):
    hist = spark.createDataFrame([("r", 0, 2, 10000), ("r", 1, 3, 20000)], "rail string, bucket long, n long, cents long")
    got = [(r["t"], r["volume"], r["txns"], r["baseline"]) for r in se.series(hist, 0, 3600, 1800).orderBy("t").collect()]
    assert got == [(0, 0.0, 0, 0.0), (1800, 100.0, 2, 150.0), (3600, 300.0, 5, 300.0)]
    assert se.period_window("24h", 1000, 100000) == (13600, 100000, 1800)
    with pytest.raises(ValueError):
        se.account_volumes(hist, 0, ())


def test_scores(spark):
    one = spark.range(1)
    clique = one.select(sc.score_community(F.lit(8), F.lit(28), F.lit(140_000_000), F.lit(2), F.lit(0.0)).alias("x")).first()["x"]
    assert clique["risk_level"] == "critical" and clique["tree_excess_ratio"] == 3.0
    chain = one.select(sc.score_community(F.lit(3), F.lit(2), F.lit(40_000), F.lit(0), F.lit(0.0)).alias("x")).first()["x"]
    assert chain["risk_level"] == "low"
    mark = lambda g, c, t: one.select(sc.mark(F.lit(g).cast("double"), F.lit(c), F.lit(t).cast("string")).alias("m")).first()["m"]
    assert mark(0.92, False, None) == 0.92 and mark(None, True, None) == 1.0 and mark(0.1, False, "low") is None
    assert math.isclose(mark(0.8, True, "critical"), 0.88)


def test_confusion_and_threshold(spark):
    rows = spark.createDataFrame([(0.9, False, False), (0.6, True, False), (0.8, True, False), (0.2, False, False)], "score double, truth boolean, in_cycle boolean")
    c = ml.confusion(rows, sc.is_marked(F.col("score"), F.col("in_cycle"), 0.75)).first()
    assert (c["tp"], c["fp"], c["fn"], c["tn"], c["precision"], c["recall"]) == (1, 1, 1, 1, 0.5, 0.5)
    assert ml.best_threshold(rows.filter("NOT truth")).first()["threshold"] == 0.5


def test_quantile_normal_is_monotone(spark):
    rows = spark.createDataFrame([(float(i * i),) for i in range(200)], "v double")
    got = [r["v"] for r in ml.quantile_normal(rows, ml.fit_quantiles(rows, ["v"], 50), ["v"]).collect()]
    assert got == sorted(got) and abs(sum(got) / len(got)) < 0.05  # 50 quantiles, lines between them


def test_feature_matrix(spark):
    f = flows(spark, [("A", "A", 500, 5), ("B", "C", 100, 5), ("C", "B", 100, 6)])
    accounts = spark.createDataFrame([("A",), ("B",), ("Z",)], "account string")
    rows = {r["account"]: r for r in fe.assemble(f, accounts, None, None, None, 86400).collect()}
    assert list(rows["A"].asDict())[1:] == fe.FEATURES and len(fe.FEATURES) == 47
    assert rows["A"]["self_loop_count"] == 1 and rows["A"]["out_degree"] == 0
    assert rows["B"]["flow_ratio"] == 0.5 and rows["B"]["reciprocity"] == 1.0
    assert all(v == 0 for k, v in rows["Z"].asDict().items() if k not in ("account", "is_account"))


def test_layered_scores_equal_dense_ones(spark):
    rng = np.random.default_rng(1)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 12, (30, 2))})
    f = flows(spark, [(f"n{a}", f"n{b}", 1, 1) for a, b in pairs])
    x = rng.normal(size=(13, 3))  # the last one has no neighbours
    rows = spark.createDataFrame([(f"n{i}", *map(float, v)) for i, v in enumerate(x)], "account string, a double, b double, c double")
    layer = lambda n, m: {k + t: rng.normal(size=(n, m)) for k in ("own", "near") for t in ("", "_rev")} | {"bias" + t: rng.normal(size=m) for t in ("", "_rev")}
    layers, head = [layer(3, 4), layer(8, 2)], {"weight": rng.normal(size=(4, 2)), "bias": rng.normal(size=2)}
    into = np.zeros((13, 13))
    for a, b in pairs:
        if a != b:
            into[b, a] = 1
    mean = lambda m: m / np.maximum(m.sum(axis=1, keepdims=True), 1)
    h = x
    for w in layers:
        h = np.maximum(np.concatenate([h @ w["own" + t] + mean(m) @ h @ w["near" + t] + w["bias" + t] for t, m in (("", into), ("_rev", into.T))], axis=1), 0)
    z = np.exp(h @ head["weight"] + head["bias"])
    got = {r["account"]: r["score"] for r in ml.layered_scores(f, rows, ["a", "b", "c"], layers, head, both_ways=True).collect()}
    assert len(got) == 13 and all(math.isclose(got[f"n{i}"], z[i, 1] / z[i].sum(), rel_tol=1e-9) for i in range(13))


def test_flag_upsert_keeps_status(spark):
    cols = "fingerprint string, flag_type string, account_ids array<string>, risk_level string, risk_score double, explanation string, details string"
    old = spark.createDataFrame([("f", "CYCLE", ["A"], "low", 0.1, "x", None, "closed", 1, 1, 1)], cols + ", status string, first_detected_at long, last_detected_at long, detection_count int")
    new = spark.createDataFrame([("f", "CYCLE", ["B"], "high", 0.7, "y", None, 9), ("g", "CYCLE", ["C"], "low", 0.2, "z", None, 9)], cols + ", detected_at long")
    got = {r["fingerprint"]: r for r in st.upsert_flags(old, new).collect()}
    f = got["f"]
    assert (f["status"], f["detection_count"], f["account_ids"], f["risk_score"], f["first_detected_at"], f["last_detected_at"]) == ("closed", 2, ["A"], 0.7, 1, 9)
    assert got["g"]["status"] == "open" and got["g"]["detection_count"] == 1
    with pytest.raises(ValueError):
        st.upsert_flags(old, new.withColumn("explanation", F.lit("")))


def test_same_result_however_partitioned(spark):
    rows = [(f"A{i % 7}", f"A{i % 5}", 100 + i, i) for i in range(200)]
    t = transfers(spark, [(*r, "USD") for r in rows])
    assert sorted(fl.flows_of(t.repartition(1)).collect()) == sorted(fl.flows_of(t.repartition(8)).collect())


def test_two_hop_over_several_blocks_as_brute_force(spark):
    import math
    import random

    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(400)] + [("hub", f"n{k}") for k in range(60)] + [(f"n{k}", "hub") for k in range(60)]
    edges = {(a, b) for a, b in pairs if a != b}
    out = {a: {b for x, b in edges if x == a} for a in {v for e in edges for v in e}}
    ahead = {a: {c for b in out[a] for c in out[b]} for a in out}
    want = {a: (round(math.log1p(len(ahead[a])), 9), round(math.log1p(sum(a in z for z in ahead.values())), 9)) for a in out}
    got = gr.two_hop(spark.createDataFrame(pairs + pairs[:9], "src string, dst string"), payers=7, payees=5).collect()
    assert {r["account"]: (round(r["two_hop_out"], 9), round(r["two_hop_in"], 9)) for r in got} == want and len(got) == len(want)


def test_oversampled_points_lie_on_the_way_to_the_nearest_row(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    v, y = rng.normal(size=(120, 8)), np.arange(120) % 2
    rows = [(int(i), v[i].tolist(), int(y[i])) for i in range(120)] + [(500, [0.0] * 8, 7)]  # the last class has one row
    got = ml.oversample(spark.createDataFrame(rows, "vec_id long, vec array<double>, label int"), k=1, block=20).collect()
    ways = {0: [], 1: []}
    for i in range(120):
        d = np.where((y == y[i]) & (np.arange(120) != i), ((v - v[i]) ** 2).sum(axis=1), np.inf)
        ways[y[i]].append((v[i], v[d.argmin()]))
    assert len(got) == 120
    for r in got:
        p = np.array(r["vec"])
        assert min(np.linalg.norm(p - a) + np.linalg.norm(p - b) - np.linalg.norm(a - b) for a, b in ways[r["label"]]) < 1e-9
