"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import cut, shuffle_partitions

ROUNDS = 60
#: Edges of a partition, as far as there are fewer partitions than the session's.
EDGES = 1 << 18


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long) -> node, root: the smallest node that each node of an edge reaches.

    Large-star and small-star steps alternate until nothing changes; each is a minimum per node and a join back,
    so no task holds a node's neighbours together and a node with a third of all edges is pre-aggregated and split
    by Spark's skew join. Every round is cut to the shared folder, in as few partitions as its edges fill. The number of rounds
    grows with the logarithm of the longest path. Null ends and loops are ignored.
    """
    links = cut(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _digest(links)
    parts = 1 + seen[0] // EDGES
    narrow = lambda df: cut(df.coalesce(parts) if parts < shuffle_partitions(df.sparkSession) else df)
    links = links.coalesce(parts)
    for _ in range(ROUNDS):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(parts)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = narrow(large.filter("a <> b").coalesce(parts).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = narrow(small.union(least.select("a", F.col("m").alias("b"))).coalesce(parts).distinct())
        before, seen = seen, _digest(links)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = links.groupBy("b").agg(F.lit(1)).select(F.col("b").alias("node"), F.col("b").alias("root"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _digest(links: DataFrame) -> tuple[int, int]:
    """Number and order-free 64-bit digest of distinct edges."""
    return tuple(links.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())
