"""Exact order statistics, quintile buckets and global ranks without a single-task window."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rank error of the first, approximate pass is one in ACCURACY; what lies within is then counted exactly.
ACCURACY = 10_000


def persisted(df: DataFrame) -> DataFrame:
    """df as written to the session's checkpoint folder (a temporary one only where none is set)."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="quarrylight-"))
    return df.checkpoint(eager=True)


def order_statistics(df: DataFrame, column: str, ranks: list[int], n: int) -> list[float]:
    """The values at the 0-based `ranks` among the n non-null values of `column` in ascending order, exactly.

    An approximate sketch brackets each rank; one aggregation counts what lies below the brackets, and only distinct values
    inside them (a few in ACCURACY of all rows) reach the driver.
    """
    if not n or not ranks:
        return []
    share = [(max(0.0, (k - 2 * n / ACCURACY) / n), min(1.0, (k + 1 + 2 * n / ACCURACY) / n)) for k in ranks]
    points = [p for pair in share for p in pair]
    found = df.agg(F.percentile_approx(column, points, ACCURACY).alias("p")).first().p
    brackets = list(zip(found[::2], found[1::2], strict=True))
    below = df.agg(*[F.count_if(F.col(column) < lo).alias(f"b{i}") for i, (lo, _) in enumerate(brackets)]).first()
    inside = F.lit(False)
    for lo, hi in brackets:
        inside = inside | F.col(column).between(lo, hi)
    counts = sorted((r[0], r[1]) for r in df.filter(inside).groupBy(column).count().collect())
    out = []
    for i, (k, (lo, hi)) in enumerate(zip(ranks, brackets, strict=True)):
        seen = below[f"b{i}"]
        for v, c in counts:
            if lo <= v <= hi:
                seen += c
                if seen > k:
                    out.append(v)
                    break
    return out


def quintile_above(df: DataFrame, column: str) -> Column:
    """1 plus the number of thresholds that the value exceeds; thresholds are sorted values at int(n q), q = .2 .4 .6 .8."""
    n = df.filter(F.col(column).isNotNull()).count()
    cuts = order_statistics(df, column, [int(n * q) for q in (0.2, 0.4, 0.6, 0.8)], n)
    bucket = F.lit(1)
    for t in cuts:
        bucket = bucket + F.when(F.col(column) > t, 1).otherwise(0)
    return bucket.cast("int")


def quintile_share(df: DataFrame, column: str) -> Column:
    """1 for values up to 0, else min(5, 1 + floor(5 times the share of values up to this one))."""
    n = df.filter(F.col(column).isNotNull()).count()
    cuts = order_statistics(df, column, [-(-b * n // 5) - 1 for b in range(1, 5)], n)
    bucket = F.lit(1)
    for t in cuts:
        bucket = bucket + F.when(F.col(column) >= t, 1).otherwise(0)
    return F.when(F.col(column) > 0, bucket).otherwise(1).cast("int")


def global_rank(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """df with its 1-based position in `order` over all rows.

    Range partitions are sorted and written once; the driver sees a row count for each, and numbering is local. Order
    columns should make rows distinct; rows that tie get an arbitrary but fixed order.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = persisted(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    base, total = F.lit(0), 0
    for part, count in sorted((r[0], r[1]) for r in parts.groupBy("__part").count().collect()):
        base = F.when(F.col("__part") == part, total).otherwise(base)
        total += count
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parts.withColumn(out, (base + local).cast("long")).drop("__part")


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: Column | int) -> DataFrame:
    """The first n rows of each key in `order`, with their `position`; Spark filters ranks before the shuffle where n is constant."""
    ranked = df.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("position") <= n)
