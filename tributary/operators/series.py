"""Histograms, cumulative series and windowed volumes over transfers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 1800
#: Seconds a bucket of each period covers, and seconds of the period.
PERIODS = {"24h": (1800, 86400), "7d": (21600, 7 * 86400), "all": (86400, None)}


def histogram(transfers: DataFrame) -> DataFrame:
    """Count and cents per rail and half hour; a null rail is UNKNOWN."""
    return transfers.groupBy(F.coalesce("rail", F.lit("UNKNOWN")).alias("rail"), F.floor(F.col("ts") / BUCKET).alias("bucket")).agg(F.count("*").alias("n"), F.sum("amount_cents").alias("cents"))


def currency_code(rail: Column) -> Column:
    """P6."""
    return F.regexp_replace(rail, "^IBM_AML_", "")


def currency_totals(hist: DataFrame) -> DataFrame:
    """A12, in major units."""
    return hist.groupBy(currency_code(F.col("rail")).alias("currency")).agg(F.sum("n").alias("count"), (F.sum("cents") / 100.0).alias("volume"))


def bounds(hist: DataFrame) -> DataFrame:
    """Start of the first and end of the last half hour, 0 without any."""
    return hist.agg(F.coalesce(F.min("bucket") * BUCKET, F.lit(0)).alias("start"), F.coalesce((F.max("bucket") + 1) * BUCKET, F.lit(0)).alias("end"))


def period_window(period: str, start: int, end: int) -> tuple[int, int, int]:
    """T4: (start, end, bucket) of a period that ends with the data."""
    bucket, span = PERIODS[period]
    return (start if span is None else max(start, end - span), end, bucket)


def series(hist: DataFrame, start: int, end: int, bucket: int) -> DataFrame:
    """Cumulative volume and count at every bucket's end, 0 at the start, beside a uniform pace.

    The grid is as long as the period has buckets; the histogram is aggregated onto it before anything is ordered.
    """
    n = max(1, -(-(end - start) // bucket))
    inside = hist.filter((F.col("bucket") * BUCKET >= start) & (F.col("bucket") * BUCKET < end))
    per = inside.groupBy((F.floor((F.col("bucket") * BUCKET - start) / bucket) + 1).alias("i")).agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))
    grid = hist.sparkSession.range(n + 1).withColumnRenamed("id", "i")
    upto = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dense = grid.join(per, "i", "left").select("i", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("cents", F.lit(0)).alias("cents"))
    run = dense.select("i", F.sum("cents").over(upto).alias("cents"), F.sum("n").over(upto).alias("txns"))
    total = per.agg(F.coalesce(F.sum("cents"), F.lit(0)).alias("total"))
    return run.crossJoin(total).select(
        F.least(F.lit(start) + F.col("i") * bucket, F.lit(end)).alias("t"), (F.col("cents") / 100.0).alias("volume"), "txns", (F.col("total") / 100.0 * F.col("i") / n).alias("baseline")
    )


def activity_end(hist: DataFrame, q: float, dataset_end: int) -> DataFrame:
    """End of the first half hour by which a share q of all transfers has passed."""
    per = hist.groupBy("bucket").agg(F.sum("n").alias("n"))
    run = per.select("bucket", F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return run.filter(F.col("upto") >= q * F.col("total")).agg(F.least(F.lit(dataset_end), (F.min("bucket") + 1) * BUCKET).alias("activity_end"))


def window_label(hours: int) -> str:
    """T2."""
    return f"{hours // 24}d" if hours >= 48 and hours % 24 == 0 else f"{hours}h"


def edge_series(transfers: DataFrame) -> DataFrame:
    """K8: distinct (src, dst, amount, ts), as the members of an edge's time series (Q5)."""
    return transfers.select(F.col("sender_id").alias("src"), F.col("receiver_id").alias("dst"), "amount_cents", "ts").distinct()


def account_volumes(edges: DataFrame, reference: int, hours: tuple[int, ...] = (1, 24, 168)) -> DataFrame:
    """Volumes and counts paid and received within each window, bounds included, from one scan of the widest one."""
    if not hours:
        raise ValueError("at least one window is needed")
    recent = edges.filter(F.col("ts").between(reference - max(hours) * 3600, reference))
    sides = recent.select(F.explode(F.array(F.struct(F.col("src").alias("account"), F.lit(True).alias("out")), F.struct(F.col("dst").alias("account"), F.lit(False).alias("out")))).alias("s"), "amount_cents", "ts").select("s.*", "amount_cents", "ts")
    columns = []
    for h in hours:
        inside, label = F.col("ts") >= reference - h * 3600, window_label(h)
        for side, is_out in (("out", F.col("out")), ("in", ~F.col("out"))):
            columns += [F.sum(F.when(inside & is_out, F.col("amount_cents")).otherwise(0)).alias(f"volume_{side}_{label}"), F.sum(F.when(inside & is_out, 1).otherwise(0)).alias(f"txn_{side}_{label}")]
    return sides.groupBy("account").agg(*columns)


def edge_volume(edges: DataFrame, src: str, dst: str, now: int, hours: int) -> DataFrame:
    """A17."""
    return edges.filter((F.col("src") == src) & (F.col("dst") == dst) & F.col("ts").between(now - hours * 3600, now)).agg(
        F.coalesce(F.sum("amount_cents"), F.lit(0)).alias("volume"), F.count("*").alias("tx_count"), F.min("ts").alias("earliest"), F.max("ts").alias("latest")
    )


def busy_edges(edges: DataFrame, now: int, hours: int, least: int, limit: int) -> DataFrame:
    """Edges whose volume in the window reaches a bound, largest first."""
    per = edges.filter(F.col("ts").between(now - hours * 3600, now)).groupBy("src", "dst").agg(F.sum("amount_cents").alias("volume"), F.count("*").alias("tx_count"))
    return per.filter(F.col("volume") >= least).orderBy(F.col("volume").desc(), "src", "dst").limit(limit)


def account_inflow(edges: DataFrame, now: int, hours: int) -> DataFrame:
    """Inflow within the window; sources are counted over all time."""
    inside = F.col("ts").between(now - hours * 3600, now)
    return edges.groupBy(F.col("dst").alias("account")).agg(F.sum(F.when(inside, F.col("amount_cents")).otherwise(0)).alias("inflow"), F.sum(F.when(inside, 1).otherwise(0)).alias("tx_count"), F.countDistinct("src").alias("source_count"))


def hop_gaps(transfers: DataFrame, by: str, limit_seconds: int) -> DataFrame:
    """The largest gap between consecutive transfers of a group, and whether it is over the limit."""
    gap = F.col("ts") - F.lag("ts").over(Window.partitionBy(by).orderBy("ts"))
    return transfers.withColumn("gap", gap).groupBy(by).agg(F.max("gap").alias("max_gap"), F.coalesce(F.max("gap") > limit_seconds, F.lit(False)).alias("too_wide"))
