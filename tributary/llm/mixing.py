"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target number of words; the target over the source's size is how often
each of its documents should be taken, a whole part and a fraction.  Fractions are rounded
in pairs: words move from one document of a pair to the other, by chance so that no
document's expectation changes, until one fraction is 0 or 1.  The words of a source are
thereby kept to the last pair, which leaves one document with a fraction.  Pairs form a
reduction tree: documents meet within buckets, the buckets' last documents meet in the
next level, until a source has one document left, whose fraction is drawn.

A bucket holds about ``bucket_rows`` documents, so a source with a third of all rows is
many buckets.  Chance comes from hashes of doc_id, bucket and level: reruns agree.  Rows without a doc_id are dealt by their
number in the input instead, so that many of them do not share a bucket; of them reruns agree while the input's files are the same.

Defined results: null text has size 0; null sources are one source, the last; documents of
size 0 are taken like others but count no words; repeated rows are documents of their own
that may share one draw; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.common import WORD, Scratch


def source_order(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """``sizes`` (source, source_size) with ``rank`` from 0 in code point order, null last, without one task for all sources."""
    spark = sizes.sparkSession
    ranged = sizes.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("source").asc_nulls_last())
    ranged = scratch.write(ranged.withColumn("part", F.spark_partition_id()), "sources")
    within = ranged.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1)
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    # one row a partition: bounded by the number of shuffle partitions
    offset = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return within.join(offset.select("part", "before"), "part").select("source", "source_size", (F.col("k") + F.col("before")).alias("rank"))


def targets(sizes: DataFrame, scratch: Scratch, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target): shares by weight of ``share`` times all words, none above ``cap`` times its source.

    What is above a cap is shared anew among the others until none is above; each round is one aggregate of two numbers.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = scratch.write(source_order(sizes, scratch).withColumns({"weight": weight, "limit": cap * F.col("source_size")}), "weights")
    goal = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = F.col("limit") <= F.lit(level) * F.col("weight")
        capped, open_weight = ranked.agg(F.sum(F.when(full, F.col("limit")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not open_weight:
            break
        raised = (goal - capped) / open_weight
        if raised <= level:
            break
        level = raised
    return ranked.withColumn("target", F.least("limit", F.lit(level) * F.col("weight"))).select("source", "source_size", "target")


def pair_up(size: np.ndarray, fraction: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Fractions after pairing in order: 0 or 1 but for one at most, with the sum of size times fraction unchanged."""
    out = fraction.copy()
    last = -1
    for i in range(len(out)):
        p = out[i]
        if p <= 0.0 or p >= 1.0:
            continue
        s = size[i]
        if s == 0:
            out[i] = 1.0 if draw[i] < p else 0.0
            continue
        if last < 0:
            last = i
            continue
        q, r = out[last], size[last]
        up = min((1.0 - q) * r, p * s)  # words that may move to the waiting document
        down = min(q * r, (1.0 - p) * s)  # and from it
        if draw[i] * (up + down) < down:
            moved, full, empty = up, up == (1.0 - q) * r, up == p * s
            out[last] = 1.0 if full else q + moved / r
            out[i] = 0.0 if empty else p - moved / s
        else:
            moved, empty, full = down, down == q * r, down == (1.0 - p) * s
            out[last] = 0.0 if empty else q - moved / r
            out[i] = 1.0 if full else p + moved / s
        if not 0.0 < out[last] < 1.0:
            last = i if 0.0 < out[i] < 1.0 else -1
    return out


def round_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["place", "row"], kind="stable").reset_index(drop=True)
    draw = rows["draw"].to_numpy(np.float64)
    rows["fraction"] = pair_up(rows["size"].to_numpy(np.float64), rows["fraction"].to_numpy(np.float64), draw)
    return rows[["source", "row", "place", "size", "fraction"]]


ROUNDED = "source string, row long, place long, size long, fraction double"


def chance(seed: int, level: int):
    """A number in [0, 1) from the document's place in the order and the level."""
    return (F.pmod(F.xxhash64("place", F.lit(seed), F.lit(level)), F.lit(1 << 52)) / float(1 << 52)).alias("draw")


def word_count(text_col: str):
    text = F.col(f"`{text_col}`")
    return F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long").alias("size")


def copies(rows: DataFrame, scratch: Scratch, seed: int = 7, bucket_rows: int = 4096, fan_in: int = 512, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``rows`` (a written table of row, doc_id, source, size) with source_size, target and copies, how often the mix takes the row."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    goals = scratch.write(targets(sums.select("source", "source_size"), scratch, weights, share, cap).join(sums.select(F.col("source").alias("s"), "n_rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "targets")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    known = goals.select(F.col("source").alias("s"), "source_size", "target", each.alias("rate"), F.ceil(F.col("n_rows") / bucket_rows).alias("buckets"))
    # rows meet their source's one row; a hot source's side is split by adaptive execution, its other side is that row
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = scratch.write(rows.withColumns({"place": F.when(F.col("doc_id").isNull(), F.xxhash64("row", F.lit(seed))).otherwise(F.xxhash64("doc_id", F.lit(seed))), "fraction": F.col("rate") - F.floor("rate")}), "rates")
    left = rows.filter((F.col("fraction") > 0) & (F.col("fraction") < 1))
    most = goals.agg(F.max("n_rows")).first()[0] or 0
    buckets = math.ceil(most / bucket_rows)
    live = left.select("source", "row", "place", "size", "fraction", F.pmod("place", "buckets").alias("bucket"), chance(seed, 0))
    done, level = [], 0
    while True:
        rounded = scratch.write(live.groupBy("source", "bucket").applyInPandas(lambda pdf: round_bucket(pdf).assign(bucket=pdf["bucket"].iloc[0]), f"{ROUNDED}, bucket long"), f"level{level}")
        whole = (F.col("fraction") <= 0) | (F.col("fraction") >= 1)
        done.append(rounded.filter(whole).select("row", "fraction"))
        level += 1
        if buckets <= 1:
            end = rounded.filter(~whole).withColumn("draw", chance(seed, level))
            done.append(end.select("row", F.when(F.col("draw") < F.col("fraction"), 1.0).otherwise(0.0).alias("fraction")))
            break
        buckets = math.ceil(buckets / fan_in)
        live = rounded.filter(~whole).select("source", "row", "place", "size", "fraction", F.floor(F.col("bucket") / fan_in).alias("bucket"), chance(seed, level))
    drawn = done[0]
    for more in done[1:]:
        drawn = drawn.unionAll(more)
    drawn = drawn.withColumnRenamed("fraction", "drawn")
    taken = F.floor("rate") + F.coalesce("drawn", F.lit(0.0))
    return rows.join(drawn, "row", "left").select("row", "doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The rows of the mix: each as often as it is taken, with its own columns."""
    scratch = Scratch(docs.sparkSession, "mix")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    kept = docs.select(own, F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(text_col))
    kept = scratch.write(kept.withColumn("row", F.monotonically_increasing_id()), "rows")
    plan = copies(kept.select("row", "doc_id", "source", "size"), scratch, **settings).select("row", "copies").filter("copies > 0")
    return kept.select("row", "own").join(plan, "row").select(F.explode(F.array_repeat("own", F.col("copies").cast("int"))).alias("own")).select("own.*")


def digest(docs: DataFrame) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count("text")).withColumn("row", F.monotonically_increasing_id())
    return copies(scratch.write(rows, "rows"), scratch).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
