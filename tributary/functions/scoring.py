"""Scoring rules as column expressions: bands, rings, communities, marks, verdicts, explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIERS = ["low", "medium", "high", "critical"]
#: Lower bounds of medium, high and critical (fixed values): detectors, model scores, verdicts.
DETECTOR_BANDS, MODEL_BANDS, VERDICT_BANDS = (0.40, 0.65, 0.85), (0.40, 0.70, 0.90), (0.25, 0.50, 0.75)


def band(score: Column, bounds: tuple[float, float, float] = DETECTOR_BANDS) -> Column:
    """Name of the band a score lies in."""
    medium, high, critical = bounds
    return F.when(score >= critical, "critical").when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def tier_rank(tier: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, TIERS)), tier), F.lit(1))


def max_tier(a: Column, b: Column) -> Column:
    """The higher tier; null is low, of equal ones the first."""
    low = lambda c: F.coalesce(c, F.lit("low"))
    return F.when(tier_rank(low(a)) >= tier_rank(low(b)), low(a)).otherwise(low(b))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def edge_weight(total_cents: Column) -> Column:
    """P8."""
    return F.greatest(F.lit(1.0), F.least(F.lit(10.0), total_cents / 100000.0))


def score_ring(amounts: Column, timestamps: Column, floor_cents: int = 10_000, fast_hours: float = 24.0) -> Column:
    """Struct of value, velocity, consistency and hop scores, risk_score and risk_level."""
    n = F.size(amounts)
    real = F.transform(amounts, lambda x: x.cast("double"))
    total = F.aggregate(real, F.lit(0.0), lambda t, x: t + x)
    mean = total / n
    spread = F.sqrt(F.aggregate(F.transform(real, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda t, x: t + x) / n)
    floor = float(max(floor_cents, 1))
    value = F.least(F.lit(1.0), F.log1p(F.greatest(F.array_min(real), F.lit(floor)) / floor) / F.log1p(F.lit(1e8 / floor)))
    span = F.array_max(timestamps) - F.array_min(timestamps)
    velocity = F.when(span <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - span / (fast_hours * 3600 * 3)))
    consistency = F.when((n == 1) | (mean == 0), 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - spread / mean))
    hops = F.when(n == 2, 0.5).when(n == 3, 0.8).when(n == 4, 0.9).when(n == 5, 0.75).when(n == 6, 0.6).otherwise(0.7)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.30 * value + 0.35 * velocity + 0.25 * consistency + 0.10 * hops))
    return F.struct(
        F.round(value, 4).alias("value_score"), F.round(velocity, 4).alias("velocity_score"), F.round(consistency, 4).alias("consistency_score"),
        hops.alias("hop_score"), F.round(score, 4).alias("risk_score"), band(score).alias("risk_level"), span.alias("span_seconds"), total.cast("long").alias("total_cents"),
    )


def score_community(n: Column, edges: Column, cents: Column, flagged: Column, conductance: Column, density_ref: float = 0.6, floor_cents: int = 1_000_000, cap_cents: int = 1_000_000_000, overlap_ref: float = 0.25) -> Column:
    """Struct of the five scores, risk_score and risk_level, for communities of two accounts or more."""
    size = F.when(n <= 3, 0.2).when(n <= 7, 0.7).when(n <= 50, 1.0).when(n <= 150, 0.5).otherwise(0.1)
    tree = F.greatest(n - 1, F.lit(1))
    excess = F.greatest(F.lit(0), edges - tree) / tree
    density = F.least(F.lit(1.0), excess / density_ref)
    floor = float(max(floor_cents, 1))
    volume = F.least(F.lit(1.0), F.ln(F.greatest(cents.cast("double"), F.lit(floor)) / floor + 1) / F.ln(F.lit(cap_cents / floor + 1)))
    cohesion = F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), conductance))
    overlap = F.least(F.lit(1.0), (flagged / n) / overlap_ref)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.10 * size + 0.15 * density + 0.25 * volume + 0.15 * cohesion + 0.35 * overlap))
    return F.struct(
        size.alias("size_score"), F.round(density, 4).alias("density_score"), F.round(volume, 4).alias("volume_score"), F.round(cohesion, 4).alias("cohesion_score"),
        F.round(overlap, 4).alias("overlap_score"), F.round(excess, 4).alias("tree_excess_ratio"), F.round(score, 4).alias("risk_score"), band(score).alias("risk_level"),
    )


def mark(gnn: Column, in_cycle: Column, tier: Column, cutoff: float = 0.5) -> Column:
    """Mean of the signals that fire by their weights, null where none does; a lone signal is its own value."""
    fired = [(0.6, F.coalesce(gnn >= cutoff, F.lit(False)), gnn), (0.25, F.coalesce(in_cycle, F.lit(False)), F.lit(1.0)), (0.15, F.coalesce(tier.isin("high", "critical"), F.lit(False)), F.lit(1.0))]
    weight = sum((F.when(f, w).otherwise(0.0) for w, f, _ in fired), F.lit(0.0))
    value = sum((F.when(f, w * v).otherwise(0.0) for w, f, v in fired), F.lit(0.0))
    count = sum((f.cast("int") for _, f, _ in fired), F.lit(0))
    lone = F.coalesce(*[F.when(f, v) for _, f, v in fired])
    return F.when(count == 1, lone).when(count > 1, value / weight)


def clamp_cutoff(cutoff: float | None) -> float:
    """C4: between 0.50 and 0.95, 0.5 where none is set."""
    return 0.5 if cutoff is None else min(0.95, max(0.50, cutoff))


def is_marked(gnn: Column, in_cycle: Column, cutoff: float | None = None) -> Column:
    return F.coalesce(in_cycle, F.lit(False)) | (F.coalesce(gnn, F.lit(0.0)) >= clamp_cutoff(cutoff))


def verdict(gnn: Column, has_cycle: Column, hops: Column, community: Column, rank: Column) -> Column:
    """Struct of score, tier, confidence and whether the case goes to the explanation service."""
    blended = 0.75 * gnn + 0.15 * community + 0.10 * rank
    base = F.least(F.lit(1.0), 0.5 + F.abs(gnn - 0.45) / 0.45 * 0.5)
    unsure = ~has_cycle & gnn.between(0.45 - 0.15, 0.45 + 0.15) & (base < 0.70)
    return F.struct(
        F.when(has_cycle, F.greatest(blended, F.lit(0.92))).otherwise(blended).alias("score"),
        F.when(has_cycle, F.when((hops > 0) & (hops <= 4), "critical").otherwise("high")).otherwise(band(blended, VERDICT_BANDS)).alias("tier"),
        F.when(has_cycle, 0.95).otherwise(base).alias("confidence"),
        unsure.alias("delegated"),
    )


def rule_explanation(score: Column, tier: Column, in_cycle: Column, n_in: Column, n_out: Column, n_risky: Column) -> Column:
    """Struct of level, typology, confidence and text."""
    value = F.coalesce(score, F.lit(0.0))
    level = F.when(in_cycle, "critical").otherwise(F.coalesce(tier, band(value)))
    fan_out = ~in_cycle & (n_out >= 5) & (n_out > 2 * F.greatest(n_in, F.lit(1)))
    fan_in = ~in_cycle & ~fan_out & (n_in >= 5) & (n_in > 2 * F.greatest(n_out, F.lit(1)))
    parts = F.concat_ws(
        " ",
        F.when(in_cycle, "Funds return to the account in a circle."),
        F.format_string("Model score %.2f, %s risk.", value, level),
        F.when(fan_out, F.format_string("Pays %d counterparties.", n_out)),
        F.when(fan_in, F.format_string("Is paid by %d counterparties.", n_in)),
        F.when(n_risky > 0, F.format_string("%d of its counterparties are of high risk.", n_risky)),
    )
    return F.struct(
        level.alias("level"), F.when(in_cycle, "CYCLE").when(fan_out, "FAN-OUT").when(fan_in, "FAN-IN").alias("typology"),
        F.round(F.when(in_cycle, 0.95).otherwise(F.least(F.lit(0.9), 0.5 + F.abs(value - 0.45))) + 1e-9, 2).alias("confidence"), F.substring(parts, 1, 1200).alias("text"),
    )


def unusual_features(features: DataFrame, names: list[str], key: str = "account", top: int = 3, least: float = 0.90) -> DataFrame:
    """Per account its positive features of highest rank in the population, best first.

    Ranks come from counts per distinct value, so ordering touches distinct values and not accounts.
    """
    long = features.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])).alias("f")).select(key, "f.*")
    per = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("feature").orderBy("value").rangeBetween(Window.unboundedPreceding, 0))
    ranks = per.select("feature", "value", (upto / F.sum("n").over(Window.partitionBy("feature"))).alias("rank")).filter((F.col("rank") >= least) & (F.col("value") > 0))
    hit = long.join(ranks, ["feature", "value"])
    order = F.row_number().over(Window.partitionBy(key).orderBy(F.col("rank").desc(), "feature"))
    return hit.withColumn("k", order).filter(F.col("k") <= top).select(key, "k", "feature", "value", F.round("rank", 6).alias("rank"))


#: Reasons for a missed ring, in the order in which they are tried (fixed values).
REASONS = ["OUTSIDE_WINDOW", "HOP_GAP", "AMOUNT_FLOOR", "CONSERVATION", "CROSS_CURRENCY", "DEPTH_LIMIT", "UNKNOWN"]


def miss_reason(oldest: Column, widest_gap: Column, least: Column, worst_ratio: Column, currencies: Column, hops: Column, window_start: int, gap: int = 72 * 3600, floor: int = 10_000, leak: float = 0.20, depth: int = 6) -> Column:
    """The first rule that a group breaks; ``worst_ratio`` is the smallest quotient of neighbours in descending amounts."""
    checks = [oldest < window_start, widest_gap > gap, least < floor, worst_ratio < 1 - leak, currencies > 1, hops > depth]
    return F.coalesce(*[F.when(c, r) for c, r in zip(checks, REASONS)], F.lit(REASONS[-1]))


def confusion_class(marked: Column, truth: Column) -> Column:
    """C11."""
    return F.when(marked & truth, "TP").when(marked, "FP").when(truth, "FN").otherwise("TN")
