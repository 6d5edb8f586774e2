"""Strongly connected components by contraction.

A graph of few edges is worked out in one task. A larger one is first contracted by ranges of its nodes, each range's own edges in one task,
as long as that helps; then edges in opposite directions are. What then is in weak components of few edges is worked out in tasks, many
components in each; the rest goes on in rounds over the whole graph, until few edges are left. Each round makes the graph smaller, and writes
down how: nodes that a label reaches in a few steps both along and against the edges are one, as are those of two edges in opposite directions; a node with one edge
in and one out goes, with all its like in a row, by doubling, so that a chain or a cycle of any length takes logarithmically many
steps; edges from nodes that none leads to, or to nodes that lead nowhere, go. What none of this touches is parted by the
smallest node that reaches each, and that node's own component is merged. In the end the rounds are read backwards: a merged
node is where its mate is, and a node of a chain is where both ends are, if they are together, else alone.

Joins of tables that grow with the graph are merged, not broadcast: there are many of them, and all that is broadcast goes through
the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidegrid.operators.graph import components, without_loops, written

#: Edges that a task works out by itself, at most, and of all weak components of a task, on average; steps of labels that needn't come to an end.
SMALL, BLOCK, NEAR = 1_000_000, 100_000, 8


def strong_of(u: Sequence[int], v: Sequence[int], n: int) -> np.ndarray:
    """The smallest node of the strong component of each node 0 to n - 1, by one walk in depth that keeps its own stack."""
    order = np.argsort(u, kind="stable")
    to, start = np.asarray(v)[order].tolist(), np.searchsorted(np.asarray(u)[order], np.arange(n + 1)).tolist()
    seen, low, at, out = [0] * n, [0] * n, start[:n], [-1] * n
    open_: list[int] = []
    count = 0
    for root in range(n):
        walk = [] if seen[root] else [root]
        while walk:
            x = walk[-1]
            if not seen[x]:
                count += 1
                seen[x] = low[x] = count
                open_.append(x)
            while at[x] < start[x + 1]:
                y = to[at[x]]
                if not seen[y]:
                    walk.append(y)
                    break
                if out[y] < 0:
                    low[x] = min(low[x], low[y])
                at[x] += 1
            else:
                walk.pop()
                if low[x] == seen[x]:
                    k = len(open_) - 1
                    while open_[k] != x:
                        k -= 1
                    least = min(open_[k:])
                    for y in open_[k:]:
                        out[y] = least
                    del open_[k:]
    return np.array(out, np.int64)


def _in_tasks(edges: DataFrame, by: Column) -> DataFrame:
    """node and to of the nodes that aren't the smallest of their strong component in the edges of one value of ``by``."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        nodes, places = np.unique(block[["u", "v"]].to_numpy().ravel(), return_inverse=True)
        ends = places.reshape(-1, 2)
        to = nodes[strong_of(ends[:, 0], ends[:, 1], len(nodes))]
        return pd.DataFrame({"node": nodes, "to": to})[to != nodes]

    kind = edges.schema["u"].dataType.simpleString()
    own = edges.select("u", "v", by.alias("b"))
    return written(own.groupBy("b").applyInPandas(lambda block: run(block), f"node {kind}, to {kind}"), "into")


def _ranges(live: DataFrame, n: int) -> DataFrame:
    """node and to, by the edges within ranges of nodes with about as many edges each as a task works out; where one node has most edges of
    a range, so that it has more than twice as many, it is left out."""
    from pyspark.ml.feature import Bucketizer

    parts = ceil(n / SMALL)
    ranks = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    cuts = sorted({float(x) for x in live.agg(F.percentile_approx("u", ranks, 10_000)).first()[0] or ()})
    of = Bucketizer(splitsArray=[[-np.inf, *cuts, np.inf]] * 2, inputCols=["_u", "_v"], outputCols=["b", "_b"])
    own = of.transform(live.withColumns({"_u": F.col("u").cast("double"), "_v": F.col("v").cast("double")})).filter("b = _b") if cuts else live.withColumn("b", F.lit(0.0))
    wide = [r.b for r in own.groupBy("b").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * SMALL).collect()]  # a row for each range at most
    return _in_tasks(own.filter(~F.col("b").isin(wide)) if wide else own, F.col("b"))


def _near(live: DataFrame) -> DataFrame:
    """node and to, by the smallest label that reaches a node in a few steps, if it is also the smallest that the node reaches: whose label
    that is, is in one strong component with all such nodes. Labels are hashes (different ones for different whole numbers)."""
    start = live.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("label", F.xxhash64("node"))
    both = _spread(start, live, NEAR).join(_spread(start, live.select(F.col("v").alias("u"), F.col("u").alias("v")), NEAR).hint("merge"), ["node", "label"])
    both = written(both, "near")
    least = both.groupBy("label").agg(F.min("node").alias("to"))
    return written(both.join(least.hint("merge"), "label").select("node", "to").filter("node <> to"), "into")


def _small(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node and to of the nodes that aren't their strong component's smallest, in all weak components of few edges; and the edges of
    the others."""
    weak = written(components(live, gathered=False), "weak")
    whole = written(live.join(weak.withColumnRenamed("node", "u").hint("merge"), "u"), "whole")
    sizes = whole.groupBy("component").agg(F.count("*").alias("n"))
    large = written(sizes.filter(F.col("n") > SMALL).select("component"), "large")
    few = written(whole.join(large, "component", "left_anti"), "few")
    bucket = F.pmod(F.xxhash64("component"), F.lit(ceil(few.count() / BLOCK) or 1))
    return _in_tasks(few, bucket), written(whole.join(large, "component", "left_semi").select("u", "v"), "live")


def _moved(edges: DataFrame, into: DataFrame) -> DataFrame:
    """Edges with nodes replaced where ``into`` (node, to) has them; loops and repeated edges go."""
    to = {x: into.select(F.col("node").alias(x), F.col("to").alias(f"_{x}")) for x in "uv"}
    both = edges.join(to["u"].hint("merge"), "u", "left").join(to["v"].hint("merge"), "v", "left")
    return without_loops(both.select(F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v"))).distinct()


def _chains(links: DataFrame) -> DataFrame:
    """node, p, n, least of links (node, p: the node before, n: the one after), all with one edge in and one out: p and n the ends of
    its chain, outside of links; on a cycle of links alone they stay within, and least is its smallest node."""
    now, seen = written(links.withColumn("least", F.col("node")), "chains"), None
    for _ in range(ceil(log2(now.count() + 1)) + 1):
        ends = now.agg(F.sum(F.xxhash64("node", "p", "n").cast("decimal(38,0)"))).first()[0]
        if ends == seen:  # no chain grows, and on a cycle some pointer always moves
            break
        seen = ends
        before = now.select(F.col("node").alias("p"), F.col("p").alias("_p"), F.col("least").alias("_l"))
        after = now.select(F.col("node").alias("n"), F.col("n").alias("_n"))
        least = F.least("least", F.coalesce("_l", "least")).alias("least")
        now = written(now.join(before, "p", "left").join(after, "n", "left").select("node", F.coalesce("_p", "p").alias("p"), F.coalesce("_n", "n").alias("n"), least), "chains")
    return now


def _spread(start: DataFrame, edges: DataFrame, hops: int | None = None) -> DataFrame:
    """node and label: the smallest label of start (node, label) that reaches the node along the edges, in ``hops`` steps if given."""
    best = front = written(start, "labels")
    hop = 0
    while hop != hops and not front.isEmpty():
        along = edges.join(front.select(F.col("node").alias("u"), "label"), "u").groupBy(F.col("v").alias("node")).agg(F.min("label").alias("_new"))
        front = written(along.join(best, "node", "left").filter(F.col("label").isNull() | (F.col("_new") < F.col("label"))).select("node", F.col("_new").alias("label")), "front")
        hop += 1
        best = best.unionByName(front).groupBy("node").agg(F.min("label").alias("label"))
        best = written(best, "labels") if hop % 8 == 0 else best
    return best


def strong_components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node with an edge (u, v), an edge to itself too. Rows with a null end don't count."""
    edges = edges.select("u", "v").filter("u IS NOT NULL AND v IS NOT NULL")
    nodes = written(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "nodes")
    live, log, parted = written(without_loops(edges).distinct(), "live"), [], False
    whole = isinstance(edges.schema["u"].dataType, IntegralType)
    ranged = near = SMALL > 0 and whole  # whether these still help
    while n := live.count():
        if n <= SMALL:
            log.append(("merge", _in_tasks(live, F.lit(0))))
            break
        if ranged:
            into = _ranges(live, n)
            log.append(("merge", into))
            live = written(_moved(live, into), "live")
            ranged = live.count() < 0.9 * n
            continue
        mutual = written(live.join(live.select(F.col("u").alias("v"), F.col("v").alias("u")).hint("merge"), ["u", "v"], "left_semi").filter("u < v"), "mutual")
        if not mutual.isEmpty():
            into = written(components(mutual, gathered=False).select("node", F.col("component").alias("to")).filter("node <> to"), "into")
            log.append(("merge", into))
            live = written(_moved(live, into), "live")
            continue
        if not parted:
            into, live = _small(live)
            log.append(("merge", into))
            parted = True
            continue
        ins = live.groupBy(F.col("v").alias("node")).agg(F.count("*").alias("i"), F.min("u").alias("p"))
        outs = live.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("o"), F.min("v").alias("n"))
        at = written(ins.join(outs, "node", "full_outer"), "degrees")
        single = at.filter("i = 1 AND o = 1").select("node", "p", "n")
        if not single.isEmpty():
            found = _chains(single)
            inner = found.select(F.col("node").alias("p"))
            cycles = found.join(inner, "p", "left_semi")
            chains = written(found.join(inner, "p", "left_anti").select("node", "p", "n"), "chains")
            log += [("merge", written(cycles.select("node", F.col("least").alias("to")).filter("node <> to"), "into")), ("chain", chains)]
            gone = single.select("node")
            rest = live.join(gone.withColumnRenamed("node", "u"), "u", "left_anti").join(gone.withColumnRenamed("node", "v"), "v", "left_anti")
            live = written(without_loops(rest.select("u", "v").unionByName(chains.select(F.col("p").alias("u"), F.col("n").alias("v")))).distinct(), "live")
            continue
        through = at.filter("i IS NOT NULL AND o IS NOT NULL").select("node")
        kept = written(live.join(through.withColumnRenamed("node", "u"), "u", "left_semi").join(through.withColumnRenamed("node", "v"), "v", "left_semi").select("u", "v"), "live")
        if kept.count() < live.count():
            live = kept
            continue
        if near:
            into = _near(live)
            log.append(("merge", into))
            live = written(_moved(live, into), "live")
            near = live.count() < 0.9 * n
            continue
        colour = _spread(through.withColumn("label", F.col("node")), live)
        c = {x: colour.select(F.col("node").alias(x), F.col("label").alias(f"_{x}")) for x in "uv"}
        own = written(live.join(c["u"], "u").join(c["v"], "v").filter("_u = _v").select("u", "v"), "within")
        back = _spread(colour.filter("node = label"), own.select(F.col("v").alias("u"), F.col("u").alias("v")))
        into = written(back.filter("node <> label").select("node", F.col("label").alias("to")), "into")
        log.append(("merge", into))
        live = written(_moved(own, into), "live")
    found = nodes.withColumn("at", F.col("node"))
    of = lambda x: found.select(F.col("node").alias(x), F.col("at").alias(f"_{x}"))
    for kind, table in reversed(log):
        if kind == "merge":
            new = table.join(of("to").hint("merge"), "to").select("node", F.col("_to").alias("_new"))
        else:
            new = table.join(of("p").hint("merge"), "p").join(of("n").hint("merge"), "n").select("node", F.when(F.col("_p") == F.col("_n"), F.col("_p")).otherwise(F.col("node")).alias("_new"))
        found = written(found.join(new.hint("merge"), "node", "left").select("node", F.coalesce("_new", "at").alias("at")), "found")
    least = found.groupBy("at").agg(F.min("node").alias("component"))
    return found.join(least.hint("merge"), "at").select("node", "component")
