"""Graph algorithms over flows: rings, ranks, components, cores, motifs, neighbourhoods, communities.

Iterations write each round's table to the shared folder, so no plan grows with the rounds
and a lost executor costs one round.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.operators.flows import undirected, without_self
from tributary.session import Rounds, stage

# ---- G1-G4 rings


@dataclass(frozen=True)
class RingRules:
    depth: int = 6
    window_seconds: int | None = None
    reference_ts: int | None = None
    gap_seconds: int = 72 * 3600
    #: Rings kept of each first account, or of each seed, after all rules; None keeps all.
    most: int | None = None
    conservation: str = "hop"
    leak: float = 0.20
    cycle_leak: float = 0.60
    floor_cents: int = 10_000


def find_rings(flows: DataFrame, rules: RingRules = RingRules(), seeds: DataFrame | None = None) -> DataFrame:
    """G1: simple rings of 2 to ``depth`` accounts, each once, from its smallest account.

    A path grows by a join on its last account and is dropped as soon as a rule fails for good: an edge outside the window
    or under the floor never enters; a path carries how often time went back (a ring may do so once), and in hop mode how
    many neighbouring pairs break conservation (one may, as the pair over the start of some rotation).
    """
    if rules.conservation not in ("hop", "cycle", "off"):
        raise ValueError(f"unknown conservation mode {rules.conservation!r}")
    e = without_self(flows).filter(F.col("max_amount") >= rules.floor_cents)
    if rules.window_seconds is not None:
        e = e.filter(F.col("last_ts") >= rules.reference_ts - rules.window_seconds)
    # only accounts that pay and are paid can be on a ring
    e = e.join(e.select(F.col("dst").alias("_d")).distinct(), F.col("src") == F.col("_d"), "left_semi").join(e.select(F.col("src").alias("_s")).distinct(), F.col("dst") == F.col("_s"), "left_semi")
    e = stage(e.select("src", "dst", F.struct("min_amount", "max_amount", "first_ts", "last_ts", "tx_count", "rail").alias("hop")), "ring-edges")

    def late(a: Column, b: Column) -> Column:
        return (b["first_ts"] >= a["first_ts"]) & (b["first_ts"] - a["first_ts"] > rules.gap_seconds)

    def back(a: Column, b: Column) -> Column:
        return (b["first_ts"] < a["first_ts"]).cast("int")

    def breaks(a: Column, b: Column) -> Column:
        if rules.conservation != "hop":
            return F.lit(0)
        kept = (b["min_amount"] <= a["max_amount"]) & (b["max_amount"] >= F.floor(a["min_amount"] * (1 - rules.leak)))
        return ((a["rail"] == b["rail"]) & ~kept).cast("int")

    start = e if seeds is None else e.join(seeds.select(F.col("account").alias("_a")).distinct(), F.col("src") == F.col("_a"), "left_semi")
    # without seeds a ring is found from its smallest account only
    canonical = (lambda c: F.col("dst") > c) if seeds is None else (lambda c: F.lit(True))
    paths = start.filter(canonical(F.col("src"))).select(F.col("src").alias("start"), F.col("dst").alias("last"), F.array("src", "dst").alias("nodes"), F.array("hop").alias("hops"), F.lit(0).alias("backs"), F.lit(0).alias("broken"))
    step = e.select(F.col("src").alias("last"), F.col("dst").alias("next"), F.col("hop").alias("new"))
    found = []
    for depth in range(2, rules.depth + 1):
        tail = F.element_at("hops", -1)
        grown = paths.join(step, "last").filter(~late(tail, F.col("new")))
        grown = grown.withColumns({"backs": F.col("backs") + back(tail, F.col("new")), "broken": F.col("broken") + breaks(tail, F.col("new"))}).filter("backs <= 1 AND broken <= 1")
        if depth < rules.depth:  # paths of a length are made once, for the rings they close and for longer paths
            grown = stage(grown, "ring-paths")
        head = F.col("hops")[0]
        closed = grown.filter((F.col("next") == F.col("start")) & ~late(F.col("new"), head)).withColumns({"backs": F.col("backs") + back(F.col("new"), head), "broken": F.col("broken") + breaks(F.col("new"), head), "hops": F.concat("hops", F.array("new"))})
        found.append(closed.filter("backs <= 1 AND broken <= 1").select("nodes", "hops"))
        if depth < rules.depth:
            ahead = F.col("next") > F.col("start") if seeds is None else F.col("next") != F.col("start")
            grown = grown.filter(ahead & ~F.array_contains("nodes", F.col("next")))
            paths = grown.select("start", F.col("next").alias("last"), F.concat("nodes", F.array("next")).alias("nodes"), F.concat("hops", F.array("new")).alias("hops"), "backs", "broken")
    rings = found[0]
    for more in found[1:]:
        rings = rings.unionAll(more)
    if rules.conservation == "cycle":
        most = F.transform("hops", lambda h: h["max_amount"])
        rings = rings.filter(F.array_max(most) * (1 - rules.cycle_leak) <= F.array_min(most))
    rings = rings.withColumn("fingerprint", fingerprint(F.col("nodes")))
    if rules.most is not None:  # L7
        first = Window.partitionBy(F.col("nodes")[0]).orderBy(F.size("nodes"), "fingerprint")
        rings = rings.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= rules.most).drop("_k")
    if seeds is not None:
        rings = rings.dropDuplicates(["fingerprint"])
    part = lambda c: F.transform("hops", lambda h: h[c]).alias(c)
    return rings.select("fingerprint", rotated(F.col("nodes")).alias("ring"), F.size("nodes").alias("n_hops"), "nodes", part("max_amount"), part("last_ts"), part("first_ts"), part("tx_count"))


def is_simple(path: Column) -> Column:
    """The accounts between first and last of a closed path differ from one another (Q6)."""
    inner = F.slice(path, 2, F.greatest(F.size(path) - 2, F.lit(0)))
    return F.size(F.array_distinct(inner)) == F.size(inner)


def rotated(ring: Column) -> Column:
    """A ring from its smallest account on; a repeated last account is dropped."""
    n = F.size(ring)
    ring = F.when((n > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1)), F.slice(ring, 1, F.greatest(n - 1, F.lit(1)))).otherwise(ring)
    at = F.array_position(ring, F.array_min(ring)).cast("int")
    return F.concat(F.slice(ring, at, F.size(ring)), F.slice(ring, 1, at - 1))


def fingerprint(ring: Column) -> Column:
    """G3."""
    return F.sha2(F.array_join(rotated(ring), "→"), 256)


def ring_members(rings: DataFrame) -> DataFrame:
    return rings.select(F.explode("nodes").alias("account")).distinct()


# ---- G5-G7 ranks


def pagerank(flows: DataFrame, iterations: int = 100, damping: float = 0.85, tolerance: float = 1e-6, places: int | None = 10) -> DataFrame:
    """Weighted PageRank with dangling mass spread evenly; self-loops count. Stops when no score moves more than the tolerance."""
    if not 0 <= damping <= 1:
        raise ValueError("damping must lie in [0, 1]")
    pairs = flows.groupBy("src", "dst").agg(F.sum("total_amount").cast("double").alias("w"))
    if pairs.filter("w < 0").take(1):
        raise ValueError("weights must not be negative")
    total = pairs.groupBy("src").agg(F.sum("w").alias("all"))
    edges = stage(pairs.join(total, "src").filter("all > 0").select("src", "dst", (F.col("w") / F.col("all")).alias("p")), "rank-edges")
    nodes = flows.select(F.explode(F.array("src", "dst")).alias("account")).distinct()
    nodes = stage(nodes.join(edges.select(F.col("src").alias("account")).distinct().withColumn("pays", F.lit(True)), "account", "left"), "rank-nodes")
    n = nodes.count()
    scores = nodes.select("account", "pays", F.lit(1.0 / max(n, 1)).alias("score"))
    rounds, kept = Rounds(flows.sparkSession, "rank"), F.sum(F.when(F.col("pays").isNull(), F.col("score")))
    lost = scores.agg(kept).first()[0] or 0.0
    for _ in range(iterations if n else 0):
        got = edges.join(scores.select(F.col("account").alias("src"), "score"), "src").groupBy(F.col("dst").alias("account")).agg(F.sum(F.col("p") * F.col("score")).alias("got"))
        base = (1.0 - damping) / n + damping * lost / n
        new = rounds.put(scores.join(got, "account", "left").select("account", "pays", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("score"), F.col("score").alias("old")))
        moved, lost = new.agg(F.max(F.abs(F.col("score") - F.col("old"))), F.coalesce(kept, F.lit(0.0))).first()
        scores = new.drop("old")
        if moved < tolerance:
            break
    value = F.col("score") if places is None else F.round("score", places)
    return scores.select("account", value.alias("pagerank_score"))


def local_pagerank(flows: DataFrame, accounts: DataFrame) -> DataFrame:
    """PageRank over the flows among the given accounts, as after one payment."""
    from tributary.operators.flows import induced

    return pagerank(induced(flows, accounts), iterations=30, places=8)


# ---- G10, G14, G20 fixed points of labels


def min_labels(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Smallest node reachable over undirected ``pairs`` (a, b); labels jump to their label's label each round."""
    both = stage(pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "label-pairs")
    rounds = Rounds(pairs.sparkSession, "label")
    labels = rounds.put(nodes.select("node", F.col("node").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("l"))
        new = labels.join(near, "node", "left").select("node", "label", F.least("label", F.coalesce("l", "label")).alias("new"))
        jump = new.select(F.col("node").alias("new"), F.col("new").alias("further"))
        new = rounds.put(new.join(jump, "new", "left").select("node", F.col("label").alias("old"), F.least("new", F.coalesce("further", "new")).alias("label")))
        changed = new.filter("old <> label").take(1)
        labels = new.select("node", "label")
        if not changed:
            return labels


def split_disconnected(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """Communities into the connected parts of their inner edges; (account, part) with part the smallest account."""
    m = membership.select(F.col("account").alias("x"), "community")
    inner = pairs.join(m.select(F.col("x").alias("a"), F.col("community").alias("ca")), "a").join(m.select(F.col("x").alias("b"), F.col("community").alias("cb")), "b").filter("ca = cb")
    return min_labels(inner, membership.select(F.col("account").alias("node"))).select(F.col("node").alias("account"), F.col("label").alias("part"))


def coreness(pairs: DataFrame) -> DataFrame:
    """K-core numbers. Estimates start at the degree and become the h-index of the neighbours' until nothing changes, which is exact."""
    both = stage(pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "core-pairs")
    rounds = Rounds(pairs.sparkSession, "core")
    core = rounds.put(both.groupBy(F.col("a").alias("account")).agg(F.count("*").alias("core")))
    while True:
        # h-index by counts: how many neighbours have at least each estimate; grouped, so a hub's neighbours are never one list
        near = both.join(core.select(F.col("account").alias("b"), F.col("core").alias("c")), "b").join(core.select(F.col("account").alias("a"), "core"), "a").groupBy("a", F.least("c", "core").alias("c")).agg(F.count("*").alias("n"))
        over = F.sum("n").over(Window.partitionBy("a").orderBy(F.col("c").desc()))
        h = near.select("a", F.least("c", over).alias("h")).groupBy(F.col("a").alias("account")).agg(F.max("h").alias("h"))
        new = rounds.put(core.join(h, "account").select("account", F.col("h").alias("core"), F.col("core").alias("old")))
        changed = new.filter("core <> old").take(1)
        core = new.select("account", "core")
        if not changed:
            return core


def reach_labels(edges: DataFrame, nodes: DataFrame, forward: bool) -> DataFrame:
    """Smallest node that reaches a node (forward), or that it reaches."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    labels, rounds = nodes.select("node", F.col("node").alias("label")), Rounds(edges.sparkSession, "reach")
    while True:
        near = edges.join(labels.select(F.col("node").alias(a), F.col("label").alias("l")), a).groupBy(F.col(b).alias("node")).agg(F.min("l").alias("l"))
        new = rounds.put(labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("l", "label")).alias("label")))
        changed = new.filter("old <> label").take(1)
        labels = new.select("node", "label")
        if not changed:
            return labels


def strong_components(edges: DataFrame) -> DataFrame:
    """(account, component), component the smallest account of it.

    Each round colours accounts by the smallest account that reaches them and by the smallest they reach within their colour;
    an account whose two labels are its colour is in that colour's component; the rest go on without them.
    """
    left = stage(edges.select("src", "dst").filter("src <> dst").distinct(), "scc-edges")
    nodes = stage(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "scc-nodes")
    done = None
    while nodes.take(1):
        colour = stage(reach_labels(left, nodes, True).select("node", F.col("label").alias("colour")), "colour")
        ends = left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("cd")), "dst")
        inner = stage(ends.filter("cs = cd").select("src", "dst"), "scc-inner")
        both = reach_labels(inner, nodes, False).join(colour, "node")
        now = stage(both.filter("label = colour").select(F.col("node").alias("account"), F.col("colour").alias("component")), "scc")
        done = now if done is None else done.unionAll(now)
        gone = now.select(F.col("account").alias("node"))
        nodes = stage(nodes.join(gone, "node", "left_anti"), "scc-nodes")
        left = stage(inner.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"), "scc-edges")
    return done if done is not None else nodes.select(F.col("node").alias("account"), F.col("node").alias("component"))


# ---- G15-G19 structure of a neighbourhood


def degrees(flows: DataFrame) -> DataFrame:
    """(account, out_deg, in_deg) over distinct counterparties, self-transfers apart."""
    sides = without_self(flows).select(F.explode(F.array(F.struct(F.col("src").alias("account"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("account"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("s")).select("s.*")
    return sides.groupBy("account").agg(F.sum("o").alias("out_deg"), F.sum("i").alias("in_deg"))


def triangles(flows: DataFrame, hub_cap: int | None = None) -> DataFrame:
    """Triangles and clustering. Edges point from the smaller degree to the larger, so a hub's wedges are never enumerated.

    With ``hub_cap``, accounts with more neighbours count none, as middle or as end.
    """
    pairs = undirected(flows, "unweighted").select("a", "b")
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy(F.col("a").alias("account")).agg(F.count("*").alias("degree"))
    d = degree if hub_cap is None else degree.filter(F.col("degree") <= hub_cap)
    ranked = pairs.join(d.select(F.col("account").alias("a"), F.col("degree").alias("da")), "a").join(d.select(F.col("account").alias("b"), F.col("degree").alias("db")), "b")
    x, y = F.struct("da", "a"), F.struct("db", "b")
    arcs = ranked.select(F.when(x < y, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(x < y, F.col("b")).otherwise(F.col("a")).alias("v"))
    wedges = arcs.alias("p").join(arcs.alias("q"), F.col("p.u") == F.col("q.u")).filter("p.v < q.v").select(F.col("p.u").alias("u"), F.col("p.v").alias("a"), F.col("q.v").alias("b"))
    closed = wedges.join(pairs, ["a", "b"]).select(F.explode(F.array("u", "a", "b")).alias("account"))
    count = closed.groupBy("account").agg(F.count("*").alias("triangles"))
    k = F.col("degree")
    t = F.coalesce("triangles", F.lit(0))
    return degree.join(count, "account", "left").select("account", t.alias("triangles"), F.when(k > 1, t / (k * (k - 1) / 2.0)).otherwise(0.0).alias("clustering"))


def reciprocity(flows: DataFrame) -> DataFrame:
    """Share of an account's counterparties that it pays and is paid by."""
    e = without_self(flows).select("src", "dst").distinct()
    pair = e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg((F.count("*") - 1).alias("mutual"))
    return pair.select(F.explode(F.array("a", "b")).alias("account"), "mutual").groupBy("account").agg((F.sum("mutual") / F.count("*")).alias("reciprocity"))


def neighbour_degrees(flows: DataFrame) -> DataFrame:
    """Mean out-degree of payers, largest in-degree of payees, largest out-degree of payers, all log1p."""
    e, d = without_self(flows).select("src", "dst"), degrees(flows)
    as_payee = e.join(d.select(F.col("account").alias("src"), "out_deg"), "src").groupBy(F.col("dst").alias("account")).agg(F.avg("out_deg").alias("m"), F.max("out_deg").alias("hub_in"))
    as_payer = e.join(d.select(F.col("account").alias("dst"), "in_deg"), "dst").groupBy(F.col("src").alias("account")).agg(F.max("in_deg").alias("hub_out"))
    zero = lambda c: F.log1p(F.coalesce(c, F.lit(0)).cast("double"))
    return d.select("account").join(as_payee, "account", "left").join(as_payer, "account", "left").select("account", zero("m").alias("log_nbr_out_deg"), zero("hub_out").alias("max_payee_in_deg"), zero("hub_in").alias("max_payer_out_deg"))


def two_hop(flows: DataFrame, payers: int = 13_000, payees: int = 6_500) -> DataFrame:
    """Accounts two steps ahead and behind, oneself and neighbours included; repeated pairs count once.

    Walks are never rows. Accounts that start walks and those that end them are dealt into blocks of about ``payers`` and ``payees``
    by hash and numbered there; each middle account sends, to each pair of blocks that it joins, its numbers on both sides, and a
    task marks them in a bitmap of its pair of blocks and counts the marks. Pairs of blocks share no walk, so counts add up.
    """
    import numpy as np
    import pyarrow as pa

    e = stage(without_self(flows).select("src", "dst").distinct(), "two-hop")
    middle = stage(e.select(F.col("dst").alias("m")).distinct().join(e.select(F.col("src").alias("m")).distinct(), "m"), "two-hop-middles")

    def dealt(rows: DataFrame, size: int, tag: str) -> tuple[DataFrame, DataFrame]:
        """(block, number, account), and per middle account and block its numbers. ``rows``: account, m."""
        rows = rows.join(middle, "m", "left_semi")
        ends = stage(rows.select("account").distinct(), f"two-hop-ends{tag}")
        blocks = max(1, -(-ends.count() // size))
        block = F.pmod(F.xxhash64("account"), F.lit(blocks)).cast("int").alias("b")
        by = Window.partitionBy("b").orderBy("account")
        names = stage(ends.select("account", block).select("b", (F.row_number().over(by) - 1).alias("i"), "account"), f"two-hop-names{tag}")
        # the same numbers by rank, so that rows are dealt out once
        numbered = rows.select("m", "account", block).repartition("b").select("m", "b", (F.dense_rank().over(by) - 1).alias("i"))
        return names, stage(numbered.groupBy("m", "b").agg(F.collect_list("i").alias("n")), f"two-hop-sides{tag}")

    before, left = dealt(e.select(F.col("src").alias("account"), F.col("dst").alias("m")), payers, "-x")
    after, right = dealt(e.select(F.col("dst").alias("account"), F.col("src").alias("m")), payees, "-z")

    def run(batches):
        at, seen = None, np.zeros((0, 0), bool)

        def found():
            for side, b, n in (("o", 0, np.count_nonzero(seen, axis=1)), ("i", 1, np.count_nonzero(seen, axis=0))):
                k = np.flatnonzero(n)
                if len(k):
                    yield pa.RecordBatch.from_arrays([pa.array([side] * len(k)), pa.array(np.full(len(k), at[b]), pa.int32()), pa.array(k, pa.int32()), pa.array(n[k], pa.int64())], names=["side", "b", "i", "n"])

        for batch in batches:
            pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            (x, xo), (z, zo) = ((c.values.to_numpy(zero_copy_only=False), c.offsets.to_pylist()) for c in (batch.column(2), batch.column(3)))
            for r, pair in enumerate(pairs):
                if pair != at:
                    yield from found()
                    at, seen = pair, np.zeros(seen.shape, bool)
                xs, zs = x[xo[r] : xo[r + 1]], z[zo[r] : zo[r + 1]]
                need = (max(seen.shape[0], int(xs.max()) + 1), max(seen.shape[1], int(zs.max()) + 1))
                if need != seen.shape:  # grows by steps of an eighth
                    wider = np.zeros(tuple(n if n == o else n + n // 8 for n, o in zip(need, seen.shape)), bool)
                    wider[: seen.shape[0], : seen.shape[1]] = seen
                    seen = wider
                seen[xs[:, None], zs] = True
        yield from found()

    joined = left.select("m", F.col("b").alias("xb"), F.col("n").alias("x")).join(right.select("m", F.col("b").alias("zb"), F.col("n").alias("z")), "m")
    # as short integers: a block has fewer than 32,768 accounts
    short = lambda c: F.col(c).cast("array<smallint>").alias(c)
    dealt_out = joined.select("xb", "zb", short("x"), short("z")).repartition("xb", "zb").sortWithinPartitions("xb", "zb")
    counts = stage(dealt_out.mapInArrow(run, "side string, b int, i int, n long").groupBy("side", "b", "i").agg(F.sum("n").alias("n")), "two-hop-counts")
    of = lambda side, names: counts.filter(F.col("side") == side).join(names, ["b", "i"]).select("account", F.col("n").alias(side))
    accounts = e.select(F.col("src").alias("account")).unionAll(e.select(F.col("dst").alias("account"))).distinct()
    rows = accounts.join(of("o", before), "account", "left").join(of("i", after), "account", "left")
    return rows.select("account", F.log1p(F.coalesce("o", F.lit(0)).cast("double")).alias("two_hop_out"), F.log1p(F.coalesce("i", F.lit(0)).cast("double")).alias("two_hop_in"))


# ---- G21-G25 searches


def reachable(flows: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(account, distance) of accounts within ``depth`` outgoing steps of the seeds; each account is expanded once."""
    e = without_self(flows).select("src", "dst")
    rounds = Rounds(flows.sparkSession, "seen")
    seen = rounds.put(seeds.select("account", F.lit(0).alias("distance")).distinct())
    for k in range(1, depth + 1):
        edge = seen.filter(F.col("distance") == k - 1).select(F.col("account").alias("src"))
        new = e.join(edge, "src").select(F.col("dst").alias("account")).distinct().join(seen, "account", "left_anti")
        seen = rounds.put(seen.unionAll(new.select("account", F.lit(k).alias("distance"))))
    return seen


def subgraph(flows: DataFrame, seeds: DataFrame, depth: int = 2, limit: int | None = None) -> DataFrame:
    """Flows among the accounts reached; with a limit only the nearest accounts, ties by id."""
    from tributary.operators.flows import induced

    near = reachable(flows, seeds, depth)
    if limit is not None:
        near = near.orderBy("distance", "account").limit(limit)
    return without_self(induced(flows, near)).select("src", "dst", "total_amount", "tx_count")


def shortest_path(flows: DataFrame, a: str, b: str, most: int = 10) -> DataFrame:
    """One directed path with the fewest hops, of several the first in order of account ids; empty if there is none.

    Each account keeps the smallest path of the first round that reaches it.
    """
    spark = flows.sparkSession
    e = stage(without_self(flows).select("src", "dst").distinct(), "path-edges")
    found = spark.createDataFrame([(a, [a])], "account string, path array<string>")
    front = found
    for _ in range(most):
        if found.filter(F.col("account") == b).take(1) or not front.take(1):
            break
        new = e.join(front, F.col("src") == F.col("account")).select(F.col("dst").alias("account"), F.concat("path", F.array("dst")).alias("path"))
        front = stage(new.join(found.select("account"), "account", "left_anti").groupBy("account").agg(F.min("path").alias("path")), "path-front")
        found = stage(found.unionAll(front), "path-found")
    return found.filter(F.col("account") == b).select("path", (F.size("path") - 1).alias("hops"))


def neighbourhood(flows: DataFrame, seeds: DataFrame, hops: int = 2, fanout: int = 10, cap: int | None = 300) -> DataFrame:
    """Accounts around seeds, each frontier account adding its ``fanout`` largest counterparties in either direction, at most ``cap``, nearest first."""
    e = without_self(flows).select("src", "dst", "total_amount")
    both = e.select(F.col("src").alias("x"), F.col("dst").alias("y"), "total_amount").unionAll(e.select(F.col("dst").alias("x"), F.col("src").alias("y"), "total_amount")).groupBy("x", "y").agg(F.sum("total_amount").alias("amount"))
    largest, rounds = Window.partitionBy("x").orderBy(F.col("amount").desc(), "y"), Rounds(flows.sparkSession, "around")
    pairs = Rounds(flows.sparkSession, "around-pairs")
    both = pairs.put(both)
    seen = rounds.put(seeds.select("account", F.lit(0).alias("distance")).distinct())
    for k in range(1, hops + 1):
        front = seen.filter(F.col("distance") == k - 1).select(F.col("account").alias("x"))
        best = both.join(front, "x").withColumn("k", F.row_number().over(largest)).filter(F.col("k") <= fanout)
        new = best.select(F.col("y").alias("account")).distinct().join(seen, "account", "left_anti")
        grown = seen.unionAll(new.select("account", F.lit(k).alias("distance")))
        seen = rounds.put(grown if cap is None else grown.orderBy("distance", "account").limit(cap))
    pairs.clear()
    return seen


def farthest(flows: DataFrame, start: str, most: int = 10) -> DataFrame:
    """The account most steps away, ties by id."""
    one = flows.sparkSession.createDataFrame([(start,)], "account string")
    return reachable(flows, one, most).orderBy(F.col("distance").desc(), "account").limit(1)


def sample_neighbours(flows: DataFrame, seeds: DataFrame, k: int, hops: int, seed: int = 42) -> DataFrame:
    """Per hop and direction up to k draws with replacement from each frontier account's neighbours; (src, dst) of the draws."""
    e = without_self(flows).select("src", "dst").distinct()
    front, out = seeds.select("account").distinct(), None
    for hop in range(hops):
        for a, b in (("src", "dst"), ("dst", "src")):
            ranked = e.join(front, F.col(a) == F.col("account")).withColumns({"i": F.row_number().over(Window.partitionBy(a).orderBy(b)), "n": F.count("*").over(Window.partitionBy(a))})
            draws = front.select(F.col("account").alias(a), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("draw")).withColumn("u", F.pmod(F.xxhash64(a, "draw", F.lit(seed), F.lit(hop), F.lit(b)), F.lit(1 << 30)))
            picked = draws.join(ranked, a).filter(F.col("i") == F.pmod("u", "n") + 1).select("src", "dst")
            out = picked if out is None else out.unionAll(picked)
        out = stage(out.distinct(), "draws")
        front = out.select(F.explode(F.array("src", "dst")).alias("account")).distinct()
    return out


# ---- G8-G13 communities


def communities(pairs: DataFrame, rounds: int = 20) -> DataFrame:
    """(account, community) by distributed modularity optimisation.

    Every account looks at the communities around it and moves where modularity gains most, ties to the smallest name. So
    that two neighbours do not swap for ever, in each round only accounts of one half (by hash and round) may move.
    Deterministic; stops when two rounds move nothing. Result sets are connected after ``split_disconnected``.
    """
    both = pairs.select("a", "b", "weight").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    both = stage(both, "community-edges")
    strength = stage(both.groupBy(F.col("a").alias("account")).agg(F.sum("weight").alias("k")), "strength")
    total = strength.agg(F.sum("k")).first()[0] or 0.0
    table = Rounds(pairs.sparkSession, "community")
    now = table.put(strength.select("account", "k", F.col("account").alias("community")))
    still = 0
    for r in range(rounds if total else 0):
        volume = now.groupBy("community").agg(F.sum("k").alias("volume"))
        links = both.join(now.select(F.col("account").alias("b"), "community"), "b").groupBy(F.col("a").alias("account"), "community").agg(F.sum("weight").alias("inside"))
        own = now.select("account", "k", F.col("community").alias("own"))
        gain = links.join(volume, "community").join(own, "account").select("account", "community", "own", (F.col("inside") - F.col("k") * (F.col("volume") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)) / total).alias("gain"))
        best = gain.groupBy("account").agg(F.max_by(F.struct("community", "gain"), F.struct(F.round("gain", 9), (F.col("community") == F.col("own")).cast("int"), -F.xxhash64("community").cast("decimal(20,0)"))).alias("best"), F.max(F.when(F.col("community") == F.col("own"), F.col("gain"))).alias("stay"))
        turn = F.pmod(F.xxhash64("account", F.lit(r // 2)) + r % 2, F.lit(2)) == 0
        better = turn & (F.col("best.gain") > F.coalesce("stay", F.lit(0.0)) + 1e-9)
        new = table.put(now.join(best, "account", "left").select("account", "k", F.col("community").alias("old"), F.when(better, F.col("best.community")).otherwise(F.col("community")).alias("community")))
        still = 0 if new.filter("old <> community").take(1) else still + 1
        now = new.select("account", "k", "community")
        if still == 2:
            break
    return now.select("account", "community")


def modularity(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    m = membership.select(F.col("account").alias("x"), "community")
    ends = pairs.join(m.select(F.col("x").alias("a"), F.col("community").alias("ca")), "a").join(m.select(F.col("x").alias("b"), F.col("community").alias("cb")), "b")
    inner = ends.agg((2 * F.sum("weight")).alias("all"), (2 * F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0))).alias("inner"))
    volume = ends.select(F.explode(F.array("ca", "cb")).alias("c"), "weight").groupBy("c").agg(F.sum("weight").alias("v")).agg(F.sum(F.col("v") * F.col("v")).alias("squares"))
    return inner.crossJoin(volume).select((F.col("inner") / F.col("all") - F.col("squares") / (F.col("all") * F.col("all"))).alias("modularity"))  # one row each


def community_shape(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """Size, inner edges, inner amount and conductance of each community."""
    m = membership.select(F.col("account").alias("x"), "community")
    ends = pairs.join(m.select(F.col("x").alias("a"), F.col("community").alias("ca")), "a").join(m.select(F.col("x").alias("b"), F.col("community").alias("cb")), "b")
    volume = ends.select(F.explode(F.array("ca", "cb")).alias("community"), "weight").groupBy("community").agg(F.sum("weight").alias("vol"))
    inner = ends.filter("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("m"), F.sum("total_amount").alias("cents"), F.sum("weight").alias("w"))
    total = volume.agg(F.sum("vol").alias("total"))
    size = m.groupBy("community").agg(F.count("*").alias("n"))
    w, vol = F.coalesce("w", F.lit(0.0)), F.coalesce("vol", F.lit(0.0))
    rest = F.least(vol, F.col("total") - vol)
    cond = F.when(rest > 1e-9, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (vol - 2 * w) / rest))).otherwise(0.0)
    joined = size.join(volume, "community", "left").join(inner, "community", "left").crossJoin(total)  # total is one row
    return joined.select("community", "n", F.coalesce("m", F.lit(0)).alias("m"), F.coalesce("cents", F.lit(0)).alias("cents"), cond.alias("conductance"))


def community_names(pairs: DataFrame, membership: DataFrame, core: int = 10) -> DataFrame:
    """Fingerprint of the ``core`` accounts with the most inner weight, and its first 12 signs as the id."""
    m = membership.select(F.col("account").alias("x"), "community")
    ends = pairs.join(m.select(F.col("x").alias("a"), F.col("community").alias("ca")), "a").join(m.select(F.col("x").alias("b"), F.col("community").alias("cb")), "b").filter("ca = cb")
    inner = ends.select(F.explode(F.array("a", "b")).alias("account"), "weight").groupBy("account").agg(F.round(F.sum("weight"), 6).alias("d"))
    ranked = membership.join(inner, "account", "left").withColumn("k", F.row_number().over(Window.partitionBy("community").orderBy(F.coalesce("d", F.lit(0.0)).desc(), "account")))
    # at most ``core`` accounts are gathered for each community
    best = ranked.filter(F.col("k") <= core).groupBy("community").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("account")), "|"), 256).alias("fingerprint"))
    return best.withColumn("community_id", F.substring("fingerprint", 1, 12))
