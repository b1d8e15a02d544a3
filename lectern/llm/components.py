"""Connected components of an edge table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Scratch, in_batches

#: At most so many edges (two ids each) are joined up in one task; more by rounds over the cluster.
SMALL_EDGES = 100_000


def components(s: Scratch, edges: DataFrame, small: int = SMALL_EDGES) -> DataFrame:
    """(a, b) links -> a table (node, component) of s: component is the smallest id reachable; only ids with a link appear."""
    edges = s.keep(edges.select("a", "b").where("a <> b").distinct())
    out = s.keep(_in_one_task(edges)) if edges.count() <= small else _by_rounds(s, edges)
    s.drop(edges)
    return out


def _in_one_task(edges: DataFrame) -> DataFrame:
    """Union-find over a counted, small number of edges."""
    kind = dict(edges.dtypes)["a"]

    def run(batches):
        parent: dict = {}

        def find(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                p, q = find(a), find(b)
                if p != q:
                    parent[max(p, q)] = min(p, q)
        nodes = list(parent)
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([find(x) for x in nodes])], ["node", "component"])

    return in_batches(edges.coalesce(1), run, f"node {kind}, component {kind}")


def _by_rounds(s: Scratch, edges: DataFrame) -> DataFrame:
    """Repeated contraction towards smaller ids.

    Each round every node points to its smallest neighbour, pointers are followed a second and a third step,
    and the edges are renamed to what their ends point to. Rounds end when no edge is left.
    """
    both = s.keep(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    names = None
    while not both.isEmpty():
        first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
        first = step = s.keep(first.select("node", F.least("node", "to").alias("to")))
        for _ in range(2):
            ahead = step.select(F.col("node").alias("to"), F.col("to").alias("__next"))
            step = step.join(ahead, "to").select("node", F.col("__next").alias("to"))
        step = s.keep(step)
        s.drop(first)
        if names is None:
            fresh = s.keep(step.select("node", F.col("to").alias("component")))
        else:
            later = step.select(F.col("node").alias("component"), "to")
            fresh = s.keep(names.join(later, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
            s.drop(names)
        names = fresh
        to_a = step.select(F.col("node").alias("a"), F.col("to").alias("__a"))
        to_b = step.select(F.col("node").alias("b"), F.col("to").alias("__b"))
        left = both.join(to_a, "a").join(to_b, "b").where("__a <> __b").select(F.col("__a").alias("a"), F.col("__b").alias("b"))
        left = s.keep(left.distinct())
        s.drop(step, both)
        both = left
    s.drop(both)
    return names
