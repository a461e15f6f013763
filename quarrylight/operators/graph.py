"""Components, strongly connected components and bounded closures of edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.operators.ordering import persisted

#: Graphs of at most so many edges are solved in one task; larger ones by rounds of joins.
SMALL = 200_000


def connected_components(pairs: DataFrame) -> DataFrame:
    """pairs (a, b) -> node, component: the least node reachable, links taken both ways.

    Every round each node takes the least label around it and then its label's label; the number of rounds grows with
    the logarithm of a component's diameter in practice. Rounds are written to the checkpoint folder.
    """
    links = persisted(pairs.select("a", "b").union(pairs.select("b", "a")).filter("a <> b").distinct())
    labels = persisted(links.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        around = links.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        nearer = labels.join(around, "node").select("node", "component", F.least("component", "near").alias("least"))
        up = nearer.select(F.col("node").alias("least"), F.col("least").alias("jump"))
        after = nearer.join(up, "least").select("node", F.col("component").alias("before"), F.least("least", "jump").alias("component"))
        after = persisted(after)
        labels = after.select("node", "component")
        if not after.filter("component <> before").limit(1).count():
            return labels


def _tarjan(graph: dict) -> list[list]:
    """Strongly connected components of more than one node, without recursion."""
    number: dict = {}
    lowest: dict = {}
    open_: list = []
    waiting: set = set()
    out = []
    for root in sorted(graph):
        if root in number:
            continue
        path = [(root, iter(sorted(graph.get(root, ()))))]
        number[root] = lowest[root] = len(number)
        open_.append(root)
        waiting.add(root)
        while path:
            node, ahead = path[-1]
            step = next((x for x in ahead if x not in number or x in waiting), None)
            if step is None:
                path.pop()
                if path:
                    lowest[path[-1][0]] = min(lowest[path[-1][0]], lowest[node])
                if lowest[node] == number[node]:
                    group = [open_.pop()]
                    while group[-1] != node:
                        group.append(open_.pop())
                    waiting.difference_update(group)
                    if len(group) > 1:
                        out.append(sorted(group))
            elif step in number:
                lowest[node] = min(lowest[node], number[step])
            else:
                number[step] = lowest[step] = len(number)
                open_.append(step)
                waiting.add(step)
                path.append((step, iter(sorted(graph.get(step, ())))))
    return out


def _reach(edges: DataFrame, starts: DataFrame, forward: bool) -> DataFrame:
    """Pairs (pivot, node): nodes that a pivot reaches within its own colour."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    step = edges.select(F.col(a).alias("node"), F.col(b).alias("next"), "colour")
    seen = persisted(starts)
    fresh = seen
    while True:
        found = fresh.join(step, ["node", "colour"]).select("colour", F.col("next").alias("node")).distinct()
        fresh = persisted(found.join(seen, ["colour", "node"], "left_anti"))
        if not fresh.limit(1).count():
            return seen
        seen = persisted(seen.unionByName(fresh))


def strongly_connected(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """edges (src, dst) -> node, scc (its least member), size; components of more than one node only.

    Graphs of up to `small` edges are solved by one task of an executor, in memory that this number bounds. Larger ones are trimmed of
    nodes without way in or out, split by forward-backward reachability from one pivot a colour, round by round; colours are
    solved side by side. Both give the same rows.
    """
    spark = edges.sparkSession
    edges = persisted(edges.select("src", "dst").filter("src <> dst").distinct())
    schema = "node string, scc string, size int"
    kind = edges.schema["src"].dataType
    if edges.count() <= small:

        def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            graph: dict = {}
            for b in batches:
                for src, dst in zip(b["src"], b["dst"], strict=True):
                    graph.setdefault(src, []).append(dst)
            yield pd.DataFrame([(n, g[0], len(g)) for g in _tarjan(graph) for n in g], columns=["node", "scc", "size"])

        return edges.coalesce(1).mapInPandas(solve, schema.replace("string", kind.simpleString()))
    rest, done = edges.withColumn("colour", F.lit("")), None
    while True:
        while True:  # a node without an edge in or out is no part of a cycle
            inner = rest.select("src", "colour").distinct().join(rest.select(F.col("dst").alias("src"), "colour").distinct(), ["src", "colour"])
            kept = rest.join(inner, ["src", "colour"], "left_semi").join(inner.withColumnRenamed("src", "dst"), ["dst", "colour"], "left_semi")
            kept = persisted(kept.select("src", "dst", "colour"))
            before, after = rest.count(), kept.count()
            rest = kept
            if before == after:
                break
        if not rest.limit(1).count():
            break
        pivots = rest.groupBy("colour").agg(F.min("src").alias("node"))
        ahead, behind = _reach(rest, pivots, True), _reach(rest, pivots, False)
        both = persisted(ahead.join(behind, ["colour", "node"]))
        group = both.join(both.groupBy("colour").agg(F.min("node").alias("scc"), F.count(F.lit(1)).cast("int").alias("size")), "colour").select("node", "scc", "size")
        done = group if done is None else persisted(done.union(group))
        nodes = rest.select("colour", F.col("src").alias("node")).union(rest.select("colour", F.col("dst").alias("node"))).distinct()
        tag = lambda df, name: df.select("colour", "node", F.lit(True).alias(name))
        split = nodes.join(tag(ahead, "f"), ["colour", "node"], "left").join(tag(behind, "b"), ["colour", "node"], "left").join(both, ["colour", "node"], "left_anti")
        colour = persisted(split.select("node", "colour", F.md5(F.concat_ws("|", "colour", F.coalesce("f", F.lit(False)).cast("string"), F.coalesce("b", F.lit(False)).cast("string"))).alias("new")))
        left, right = colour.select(F.col("node").alias("src"), "colour", "new"), colour.select(F.col("node").alias("dst"), "colour", F.col("new").alias("other"))
        rest = persisted(rest.join(left, ["src", "colour"]).join(right, ["dst", "colour"]).filter("new = other").select("src", "dst", F.col("new").alias("colour")))
    return (done if done is not None else spark.createDataFrame([], schema.replace("string", kind.simpleString()))).filter("size > 1")


def closure(seed: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """Nodes (node, round) reached from `seed` along edges in at most `rounds` steps, with the first round that does; stops when nothing is new."""
    known = persisted(seed.select("node").distinct().withColumn("round", F.lit(0)))
    fresh = known
    for k in range(1, rounds + 1):
        found = edges.join(fresh.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        fresh = persisted(found.join(known, "node", "left_anti").withColumn("round", F.lit(k)))
        if not fresh.limit(1).count():
            break
        known = persisted(known.unionByName(fresh))
    return known
