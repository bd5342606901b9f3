"""Splits, scalers, metrics, sampling and a propagation classifier over account features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.session import Rounds, running, stage


def temporal_split(accounts: DataFrame, by: str = "first_activity", train: float = 0.6, val: float = 0.15) -> DataFrame:
    """Train, val and test by exact quantiles of first activity; unknown goes to train."""
    cuts = accounts.select(F.expr(f"percentile({by}, array({train}, {train + val}))").alias("c"))
    t = F.col(by)
    return accounts.crossJoin(cuts).withColumn("split", F.when(t.isNull() | (t <= F.col("c")[0]), "train").when(t <= F.col("c")[1], "val").otherwise("test")).drop("c")  # cuts is one row


def random_split(accounts: DataFrame, key: str = "account", train: float = 0.6, val: float = 0.15, seed: int = 42) -> DataFrame:
    """M1: the same account is always in the same part, whatever else is in the table."""
    u = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return accounts.withColumn("split", F.when(u < train, "train").when(u < train + val, "val").otherwise("test"))


def time_step_split(rows: DataFrame, last_train: int = 34) -> DataFrame:
    """M15."""
    return rows.filter("y IS NOT NULL").withColumn("split", F.when(F.col("time_step") <= last_train, "train").otherwise("test"))


def signed_log(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def fit_scaler(train: DataFrame, names: list[str]) -> DataFrame:
    """M2: one row of mean and deviation (population, 0 becomes 1) of each signed logarithm."""
    aggs = []
    for n in names:
        x = signed_log(F.col(n).cast("double"))
        sd = F.stddev_pop(x)
        aggs += [F.avg(x).alias(f"{n}_mean"), F.when(sd > 0, sd).otherwise(1.0).alias(f"{n}_std")]
    return train.agg(*aggs)


def scale(df: DataFrame, scaler: DataFrame, names: list[str]) -> DataFrame:
    out = df.crossJoin(scaler)  # one row
    return out.withColumns({n: (signed_log(F.col(n).cast("double")) - F.col(f"{n}_mean")) / F.col(f"{n}_std") for n in names}).drop(*[f"{n}_{k}" for n in names for k in ("mean", "std")])


def fit_quantiles(train: DataFrame, names: list[str], n: int = 1000) -> DataFrame:
    """M3: one row with ``n`` exact quantiles of each column."""
    points = ", ".join(str(i / (n - 1)) for i in range(n))
    return train.agg(*[F.expr(f"percentile({c}, array({points}))").alias(c) for c in names])


#: Coefficients of the rational approximation of the inverse normal distribution by P. Acklam (fixed values).
INVERSE_NORMAL = {
    "a": [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239],
    "b": [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572],
    "c": [-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783],
    "d": [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416],
}


def _poly(names: list[float], x: Column) -> Column:
    out = F.lit(names[0])
    for k in names[1:]:
        out = out * x + k
    return out


def inverse_normal(p: Column) -> Column:
    a, b, c, d = (INVERSE_NORMAL[k] for k in "abcd")
    q, tail = p - 0.5, F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    r = q * q
    middle = _poly(a, r) * q / _poly([*b, 1.0], r)
    low = _poly(c, tail) / _poly([*d, 1.0], tail)
    return F.when(p < 0.02425, low).when(p > 1 - 0.02425, -low).otherwise(middle)


def quantile_normal(df: DataFrame, quantiles: DataFrame, names: list[str], clip: float = 1e-7) -> DataFrame:
    """M3: each value's place among the quantiles, as a normal deviate. Ties take the middle of their places; tails are clipped."""
    q = quantiles.select(*[F.col(n).alias(f"_{n}") for n in names])
    out = df.crossJoin(q)  # one row

    def place(x: Column, ps: Column) -> Column:
        n = F.size(ps)
        below, upto = F.size(F.filter(ps, lambda v: v < x)), F.size(F.filter(ps, lambda v: v <= x))
        lo, hi = F.get(ps, below - 1), F.get(ps, below)
        between = (below - 1 + (x - lo) / (hi - lo)) / (n - 1)
        tied = (below + upto - 1) / 2.0 / (n - 1)
        return F.when(below == 0, F.when(upto > 0, tied).otherwise(0.0)).when(below == n, 1.0).when(upto > below, tied).otherwise(between)

    return out.withColumns({n: inverse_normal(F.greatest(F.lit(clip), F.least(F.lit(1 - clip), place(F.col(n).cast("double"), F.col(f"_{n}"))))) for n in names}).drop(*[f"_{n}" for n in names])


def curve(scored: DataFrame, score: str = "score", truth: str = "truth") -> DataFrame:
    """Per distinct score: positives and negatives there and so far, from the top. Sums run over ranges of distinct scores."""
    per = scored.groupBy(F.col(score).alias("cutoff")).agg(F.sum(F.col(truth).cast("long")).alias("p"), F.sum((~F.col(truth)).cast("long")).alias("n"))
    upto = stage(running(per, F.col("cutoff").desc_nulls_last(), {"tp": "p", "fp": "n"}), "curve")
    return upto.crossJoin(upto.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("pos"), F.coalesce(F.sum("n"), F.lit(0)).alias("neg")))


def ranking_metrics(scored: DataFrame) -> DataFrame:
    """M4: PR-AUC as step average precision, ROC-AUC with ties halved, and prevalence."""
    c = curve(scored)
    return c.agg(
        (F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.max("pos")).alias("pr_auc"),
        (F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2.0)) / (F.max("pos") * F.max("neg"))).alias("roc_auc"),
        (F.max("pos") / (F.max("pos") + F.max("neg"))).alias("prevalence"),
    )


def best_threshold(scored: DataFrame) -> DataFrame:
    """M5: the cutoff of best F1, the highest of several; 0.5 where there are no positives."""
    c = curve(scored).withColumn("f1", 2.0 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("pos"))).filter("pos > 0")
    return c.agg(F.coalesce(F.max_by("cutoff", F.struct(F.round("f1", 12), "cutoff")), F.lit(0.5)).alias("threshold"), F.max("f1").alias("f1"))


def confusion(scored: DataFrame, marked: Column, truth: str = "truth") -> DataFrame:
    """Counts, precision and recall."""
    t = F.col(truth)
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    out = scored.agg(n(marked & t).alias("tp"), n(marked & ~t).alias("fp"), n(~marked & t).alias("fn"), n(~marked & ~t).alias("tn"))
    ratio = lambda a, b: F.when(F.col(b) + F.col(a) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(0.0)
    return out.withColumns({"precision": ratio("tp", "fp"), "recall": ratio("tp", "fn")})


def threshold_curve(scored: DataFrame, cutoffs: list[float], in_cycle: str = "in_cycle") -> DataFrame:
    """The confusion at each cutoff in one pass; accounts on rings are marked at any."""
    marks = F.array(*[F.struct(F.lit(c).alias("cutoff"), (F.col(in_cycle) | (F.col("score") >= c)).alias("m")) for c in cutoffs])
    e = scored.select(F.explode(marks).alias("x"), "truth").select("x.cutoff", "x.m", "truth")
    n = lambda c: F.sum(c.cast("long"))
    return e.groupBy("cutoff").agg(n(F.col("m") & F.col("truth")).alias("tp"), n(F.col("m") & ~F.col("truth")).alias("fp"), n(~F.col("m") & F.col("truth")).alias("fn"))


def typology_recall(scored: DataFrame, truth: DataFrame, cutoff: float) -> DataFrame:
    """Members and those found of each typology."""
    j = truth.join(scored, "account", "left")
    hit = F.coalesce(F.col("score") >= cutoff, F.lit(False))
    return j.groupBy("typology").agg(F.count("*").alias("members"), F.sum(hit.cast("long")).alias("found")).withColumn("recall", F.col("found") / F.col("members"))


def detector_comparison(df: DataFrame) -> DataFrame:
    """What a detector and the model flag, alone and together. Columns: detector, model, truth."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    d, m, t = F.col("detector"), F.col("model"), F.col("truth")
    return df.agg(n(d).alias("flagged"), n(d & t).alias("correct"), n(d & ~m & t).alias("detector_only"), n(~d & m & t).alias("model_only"), n(~d & ~m & t).alias("missed_by_both"))


def miss_breakdown(misses: DataFrame, reasons: list[str]) -> DataFrame:
    """Misses by reason, 0 where there is none."""
    every = misses.sparkSession.createDataFrame([(i, r) for i, r in enumerate(reasons)], "position int, reason string")
    return every.join(misses.groupBy("reason").agg(F.count("*").alias("n")), "reason", "left").select("position", "reason", F.coalesce("n", F.lit(0)).alias("n"))


def class_alpha(labels: DataFrame, n_classes: int, beta: float | None = None) -> DataFrame:
    """M6: inverse frequency or effective number of each class, scaled to a mean of 1 over the classes there are; absent ones get 1."""
    raw = 1.0 / F.col("n") if beta is None else (1 - beta) / (1 - F.pow(F.lit(beta), F.col("n")))
    per = labels.groupBy("y").agg(F.count("*").alias("n")).withColumn("raw", raw)
    per = per.withColumn("alpha", F.col("raw") / F.avg("raw").over(Window.partitionBy()))
    every = labels.sparkSession.range(n_classes).withColumnRenamed("id", "y")
    return every.join(per, "y", "left").select("y", F.coalesce("alpha", F.lit(1.0)).alias("alpha"))


def focal_loss(rows: DataFrame, gamma: float = 2.0, ignore: int = -100) -> DataFrame:
    """M7: mean of -alpha (1 - p)^gamma ln p over rows with a label; p is the probability of the true class."""
    p = F.greatest(F.col("p"), F.lit(1e-12))
    return rows.filter(F.col("y") != ignore).agg(F.coalesce(F.avg(-F.col("alpha") * F.pow(1 - p, F.lit(gamma)) * F.ln(p)), F.lit(0.0)).alias("loss"))


def class_score(logits: Column) -> Column:
    """One less the softmax probability of the first class."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return 1 - F.get(e, 0) / F.aggregate(e, F.lit(0.0), lambda t, x: t + x)


def ensemble(members: DataFrame, columns: list[str]) -> DataFrame:
    """M12."""
    return members.withColumn("score", sum((F.col(c) for c in columns), F.lit(0.0)) / len(columns))


def oversample(rows: DataFrame, vector: str = "vec", label: str = "label", k: int = 5, per_row: int = 1, seed: int = 42, block: int = 8192) -> DataFrame:
    """M8: points between a row of a class and ``per_row`` of its k nearest in the class, from every row; classes of one row give none.

    The search is exact: each block of rows of a class meets all rows of the class, which a task reads as a stream and multiplies with
    its block; it holds the block and k neighbours a row, and pairs are never rows. Work grows with the square of a class, and a row is
    sent to every block of its class. Rows without a vector or a class are left out.
    """
    import numpy as np
    import pyarrow as pa
    import xxhash

    kind = rows.schema[label].dataType.simpleString()
    of = rows.select(F.xxhash64("vec_id").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("label")).filter("v IS NOT NULL AND label IS NOT NULL")
    blocks = of.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    of = of.join(blocks, "label")
    own = of.select("label", F.pmod("id", "n").cast("int").alias("block"), F.lit(0).alias("side"), "id", "v")
    every = of.select("label", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"), F.lit(1).alias("side"), "id", "v")

    def run(batches):
        at, ids, own, gap, near_id, near = None, [], [], None, None, None

        def made():
            out = []
            for q in range(len(near_id) if near_id is not None else 0):
                found = [(xxhash.xxh64_intdigest(np.array([ids[q], n]).tobytes(), seed), x) for n, x, g in zip(near_id[q], near[q], gap[q]) if g < np.inf]
                for u, x in sorted(found, key=lambda f: f[0])[:per_row]:
                    out.append(own[q] + (x - own[q]) * (u % (1 << 20) / float(1 << 20)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([at[0]] * len(out), like), pa.array(out, pa.list_(pa.float64()))], names=["label", vector])

        for batch in batches:
            if not batch.num_rows:
                continue
            like = batch.column(0).type
            keys = list(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2))))
            id_, v = batch.column(3).to_numpy(), np.array(batch.column(4).flatten()).reshape(batch.num_rows, -1)
            cuts = [0, *[r for r in range(1, len(keys)) if keys[r] != keys[r - 1]], len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if keys[lo][:2] != at:
                    yield from made()
                    at, ids, own, gap, near_id, near = keys[lo][:2], id_[:0], v[:0], None, None, None
                if keys[lo][2] == 0:
                    ids, own = np.concatenate([ids, id_[lo:hi]]), np.concatenate([own, v[lo:hi]])
                    continue
                if not len(ids):  # a block without rows of its own
                    continue
                if gap is None:
                    gap, near_id, near = np.full((len(ids), k), np.inf), np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k, v.shape[1]))
                for a in range(lo, hi, 256):
                    o, n = v[a : min(hi, a + 256)], id_[a : min(hi, a + 256)]
                    d = (own * own).sum(axis=1)[:, None] + (o * o).sum(axis=1) - 2 * own @ o.T
                    d[ids[:, None] == n] = np.inf
                    # rows that have a nearer one than their last so far
                    for q in np.flatnonzero(d.min(axis=1) < gap[:, -1]):
                        c = np.flatnonzero(d[q] < gap[q, -1])
                        all_ = np.concatenate([gap[q], np.maximum(d[q, c], 0)])
                        best = np.argsort(all_, kind="stable")[:k]
                        gap[q], near_id[q], near[q] = all_[best], np.concatenate([near_id[q], n[c]])[best], np.concatenate([near[q], o[c]])[best]
        yield from made()

    dealt = own.unionAll(every).repartition("label", "block").sortWithinPartitions("label", "block", "side", "id")
    return dealt.mapInArrow(run, f"label {kind}, {vector} array<double>")


def propagate(flows: DataFrame, features: DataFrame, names: list[str], hops: int = 2) -> DataFrame:
    """M9: means of neighbours' features in both directions, layer by layer, beside an account's own."""
    from tributary.operators.flows import without_self

    e, rounds = stage(without_self(flows).select("src", "dst").distinct(), "propagate"), Rounds(flows.sparkSession, "propagate")
    out, last = features.select("account", *names), names
    for h in range(1, hops + 1):
        layer = out.select("account", *last)
        sides = []
        for a, b, tag in (("src", "dst", "in"), ("dst", "src", "out")):
            means = e.join(layer.withColumnRenamed("account", a), a).groupBy(F.col(b).alias("account")).agg(*[F.avg(n).alias(f"{tag}{h}_{n}") for n in last])
            sides.append(means)
        new = [f"{tag}{h}_{n}" for tag in ("in", "out") for n in last]
        out = rounds.put(out.join(sides[0], "account", "left").join(sides[1], "account", "left").na.fill(0.0, new))
        last = new
    return out


def layered_scores(flows: DataFrame, features: DataFrame, names: list[str], layers: list[dict], head: dict, both_ways: bool = False) -> DataFrame:
    """M9: (account, score) of a network with given weights over means of neighbours' vectors.

    A layer is {"own": rows by width, "near": rows by width, "bias": width} for an account's vector and the mean over its distinct
    payers; with ``both_ways`` also "own_rev", "near_rev" and "bias_rev" for payees, set beside the first.  Negative numbers count as 0
    between layers and before the head {"weight": rows by classes, "bias": classes}; the score is the softmax of the second class.
    Accounts without neighbours have a mean of 0.  Means are aggregates that combine before the shuffle; products run over Arrow batches.
    """
    import numpy as np
    import pandas as pd

    from tributary.operators.flows import without_self

    edges, rounds = stage(without_self(flows).select("src", "dst").distinct(), "layers"), Rounds(flows.sparkSession, "layers")
    width = len(names)
    last = features.select("account", F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names]).alias("v"))

    def mean(h: DataFrame, at: str, to: str, n: int, name: str) -> DataFrame:
        near = edges.join(h.withColumnRenamed("account", at), at).groupBy(F.col(to).alias("account"))
        return near.agg(F.array(*[F.avg(F.get("v", F.lit(i))) for i in range(n)]).alias(name))

    def product(layer: dict, sides: list[tuple[str, str]], final: bool):
        weights = [[np.array(layer[k + tag], dtype=float) for k in ("own", "near", "bias")] for _, tag in sides]

        def run(batches):
            for batch in batches:
                own = np.stack(batch["v"]) if len(batch) else np.zeros((0, len(weights[0][0])))
                parts = [own @ w + np.stack(batch[side]) @ u + b if len(batch) else np.zeros((0, len(b))) for (side, _), (w, u, b) in zip(sides, weights)]
                x = np.maximum(np.concatenate(parts, axis=1), 0.0)
                if not final:
                    yield pd.DataFrame({"account": batch["account"], "v": list(x)})
                else:
                    z = x @ np.array(head["weight"], dtype=float) + np.array(head["bias"], dtype=float)
                    e = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
                    yield pd.DataFrame({"account": batch["account"], "score": e[:, 1] / e.sum(axis=1) if len(z) else np.zeros(0)})

        return run

    sides = [("payers", "")] + ([("payees", "_rev")] if both_ways else [])
    for k, layer in enumerate(layers):
        none = F.array_repeat(F.lit(0.0), width)
        rows = last
        for side, _ in sides:
            at, to = ("src", "dst") if side == "payers" else ("dst", "src")
            rows = rows.join(mean(last, at, to, width, side), "account", "left").withColumn(side, F.coalesce(side, none))
        final = k == len(layers) - 1
        last = rows.mapInPandas(product(layer, sides, final), "account string, score double" if final else "account string, v array<double>")
        if not final:
            last, width = rounds.put(last), sum(len(layer["bias" + tag]) for _, tag in sides)
    return last


def train_classifier(rows: DataFrame, names: list[str], weight: str | None = None, seed: int = 42):
    """Gradient-boosted trees on propagated features with class weights, in place of a neural network (no such library here)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    trees = GBTClassifier(featuresCol="x", labelCol="y", maxIter=20, maxDepth=4, seed=seed, **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="x"), trees]).fit(rows)


def predict(model, rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).select("account", vector_to_array("probability")[1].alias("score"))


#: Settings to try, by name.
SWEEPS = {"depth": [{"hops": h} for h in (1, 2, 3)], "capacity": [{"trees": n} for n in (10, 20, 40)], "imbalance": [{"beta": b} for b in (None, 0.99, 0.999)]}


def readiness(features: DataFrame, names: list[str]) -> DataFrame:
    """Per column its share and number of nonzero cells, mean, range, deviation, non-finite cells and whether it is constant."""
    long = features.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("v")) for n in names])).alias("f")).select("f.*")
    bad = F.col("v").isNull() | F.isnan("v") | (F.abs("v") == float("inf"))
    return long.groupBy("feature").agg(
        F.sum((F.col("v") != 0).cast("long")).alias("nonzero"), (F.sum((F.col("v") != 0).cast("long")) / F.count("*")).alias("share"), F.round(F.avg("v"), 6).alias("mean"),
        F.min("v").alias("min"), F.max("v").alias("max"), F.sum(bad.cast("long")).alias("non_finite"), (F.min("v") == F.max("v")).alias("constant"),
    )
