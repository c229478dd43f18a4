"""Temporal motifs: the instances within a duration, as a chain of joins on nodes and time buckets.

An instance takes one temporal edge for each motif edge, with strictly rising times, a span of at most delta and different
nodes for different motif nodes. An instance belongs to the bucket floor(t1 / delta) of its first edge, and every later
edge is in that bucket or the next, so an edge offered to both is found exactly once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Motif:
    """Directed edges in the order of their times, over nodes 0..k-1."""

    edges: tuple[tuple[int, int], ...]

    def __post_init__(self):
        if not self.edges or any(u == v for u, v in self.edges):
            raise ValueError("a motif needs edges, none of them a self-loop")
        if {x for e in self.edges for x in e} != set(range(self.k)):
            raise ValueError("the nodes have to be 0..k-1")

    @property
    def k(self) -> int:
        return 1 + max(x for e in self.edges for x in e)

    @staticmethod
    def parse(lines: str) -> Motif:
        """From lines `u v order`; the order of the lines counts."""
        return Motif(tuple((int(a), int(b)) for a, b, *_ in (x.split() for x in lines.splitlines() if x.strip())))


def _m(text: str) -> Motif:
    return Motif(tuple((int(x[0]), int(x[2])) for x in text.split()))


#: The workload's motifs; fixed values.
MOTIFS = {
    "m1": _m("0>1 1>2"),
    "m2": _m("0>1 1>2 2>3"),
    "m3": _m("0>1 1>2 2>0"),
    "m4": _m("0>1 1>2 2>3 3>0"),
    "m5": _m("0>1 0>2 0>3 0>4"),
    "m6": _m("0>1 0>1 2>1 2>1"),
    "m7": _m("0>1 2>1 1>3 3>0 3>2"),
    "m8": _m("0>1 1>2 2>0 0>3 3>0"),
    "m9": _m("0>1 0>2 0>3 4>1 4>2 4>3"),
    "m10": _m("0>1 0>2 1>3 2>4 3>0 4>0"),
}


def matching_order(motif: Motif) -> list[int]:
    """Motif edges from the first one on, each time one that shares most endpoints with those before; ties by time."""
    order, bound = [0], set(motif.edges[0])
    while len(order) < len(motif.edges):
        left = [i for i in range(len(motif.edges)) if i not in order]
        best = max(left, key=lambda i: (len(bound & set(motif.edges[i])), -i))
        order.append(best)
        bound |= set(motif.edges[best])
    return order


def time_bounds(order: list[int]) -> list[tuple[int | None, int | None]]:
    """For each edge of an order: the latest earlier and the earliest later edge among those placed before it."""
    out = []
    for n, i in enumerate(order):
        placed = order[:n]
        out.append((max((j for j in placed if j < i), default=None), min((j for j in placed if j > i), default=None)))
    return out


def instances(edges: DataFrame, motif: Motif, delta: int, by: str | None = None, strategy: str = "join") -> DataFrame:
    """e1..el, n0..n(k-1), t1..tl of each instance in edges (eid, src, dst, t), and by, a column that must agree."""
    if strategy == "slab":
        return _slabs(edges, motif, delta)
    if delta < 1:
        return instances(edges.where("false"), motif, 1, by)
    same = [by] if by else []
    rows = edges.where("src != dst").select("eid", "src", "dst", "t", *same).withColumn("bk", F.floor(F.col("t") / delta).cast("long"))
    found, order = None, matching_order(motif)
    nodes: list[int] = []
    for n, (i, (low, high)) in enumerate(zip(order, time_bounds(order), strict=True)):
        u, v = motif.edges[i]
        cols = [F.col("eid").alias(f"e{i + 1}"), F.col("src").alias("_u"), F.col("dst").alias("_v"), F.col("t").alias(f"t{i + 1}")]
        if n == 0:
            found = rows.select(*same, F.col("bk").alias("b0"), *cols).withColumnsRenamed({"_u": f"n{u}", "_v": f"n{v}"})
            nodes = [u, v]
            continue
        right = rows.select(*[F.col(x).alias(f"_{x}") for x in same], *cols, F.explode(F.array("bk", F.col("bk") - 1)).alias("_b"))
        keys = [F.col("b0") == F.col("_b"), *[F.col(x) == F.col(f"_{x}") for x in same]]
        rest = [F.col(f"t{i + 1}") > F.col(f"t{low + 1}"), F.col(f"t{i + 1}") <= F.col("t1") + delta]
        if high is not None:
            rest.append(F.col(f"t{i + 1}") < F.col(f"t{high + 1}"))
        for node, column in ((u, "_u"), (v, "_v")):
            if node in nodes:
                keys.append(F.col(f"n{node}") == F.col(column))
            else:
                rest += [F.col(f"n{x}") != F.col(column) for x in nodes]
        found = found.join(right, reduce(Column.__and__, keys + rest)).drop("_b", *[f"_{x}" for x in same])
        for node, column in ((u, "_u"), (v, "_v")):
            if node in nodes:
                found = found.drop(column)
            else:
                found = found.withColumnRenamed(column, f"n{node}")
                nodes.append(node)
    names = [f"e{i + 1}" for i in range(len(order))] + [f"n{i}" for i in range(motif.k)] + [f"t{i + 1}" for i in range(len(order))]
    return found.select(*same, *names)


def _slabs(edges: DataFrame, motif: Motif, delta: int, slab: int | None = None) -> DataFrame:
    """The same by backtracking in time slabs; for hubs whose partial paths are far more than the instances.

    A slab also gets the edges up to delta after it; only instances whose first edge is in the slab count.
    """
    width = max(slab or 0, 4 * max(delta, 1))
    size = len(motif.edges)
    names = [f"e{i + 1}" for i in range(size)] + [f"n{i}" for i in range(motif.k)] + [f"t{i + 1}" for i in range(size)]
    own = F.floor(F.col("t") / width).cast("long")
    rows = edges.where("src != dst").withColumn("slab", F.explode(F.when(F.col("t") <= own * width + delta, F.array(own, own - 1)).otherwise(F.array(own))))

    def search(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["t", "eid"])
        e, out = list(part[["eid", "src", "dst", "t"]].itertuples(index=False, name=None)), []
        starting: dict[int, list[int]] = {}
        for at, x in enumerate(e):
            starting.setdefault(x[1], []).append(at)

        def extend(chosen: list[int], where: dict[int, int]) -> None:
            if len(chosen) == size:
                out.append([e[x][0] for x in chosen] + [where[x] for x in range(motif.k)] + [e[x][3] for x in chosen])
                return
            u, v = motif.edges[len(chosen)]
            last, first = e[chosen[-1]][3], e[chosen[0]][3]
            for at in starting.get(where[u], ()) if u in where else range(chosen[-1] + 1, len(e)):
                if at <= chosen[-1] or e[at][3] <= last:
                    continue
                if e[at][3] > first + delta:
                    break
                new = {u: e[at][1], v: e[at][2]}
                if all(where.get(a, b) == b for a, b in new.items()) and not any(b in where.values() for a, b in new.items() if a not in where):
                    extend([*chosen, at], where | new)

        for at, x in enumerate(e):
            if x[3] // width == key[0]:
                extend([at], {motif.edges[0][0]: x[1], motif.edges[0][1]: x[2]})
        return pd.DataFrame(out, columns=names)

    return rows.groupBy("slab").applyInPandas(search, ", ".join(f"{n} long" for n in names))


def weight(motif: Motif, decay: float | None = None) -> Column:
    """1, or the mean of exp(-decay * gap) over the gaps between successive edges."""
    n = len(motif.edges)
    if decay is None or n == 1:
        return F.lit(1.0)
    return sum((F.exp(-decay * (F.col(f"t{i + 1}") - F.col(f"t{i}"))) for i in range(1, n)), F.lit(0.0)) / (n - 1)


def hyperedges(found: DataFrame, motif: Motif, decay: float | None = None) -> DataFrame:
    """nodes (sorted), w and cnt: the instances of each node set."""
    nodes = F.array_sort(F.array(*[F.col(f"n{i}") for i in range(motif.k)]))
    return found.groupBy(nodes.alias("nodes")).agg(F.sum(weight(motif, decay)).alias("w"), F.count(F.lit(1)).alias("cnt"))


def node_degrees(hyper: DataFrame) -> DataFrame:
    """node, w, cnt: the weight and number of instances each node is in."""
    return hyper.select(F.explode("nodes").alias("node"), "w", "cnt").groupBy("node").agg(F.sum("w").alias("w"), F.sum("cnt").alias("cnt"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends in nodes (node)."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select(*edges.columns)


def evaluate(edges: DataFrame, nodes: DataFrame, motif: Motif, delta: int, decay: float | None = None) -> DataFrame:
    """One row: instances, tau, n_nodes, density of the node set."""
    total = instances(induced(edges, nodes), motif, delta).agg(F.count(F.lit(1)).alias("instances"), F.coalesce(F.sum(weight(motif, decay)), F.lit(0.0)).alias("tau"))
    return total.crossJoin(nodes.agg(F.countDistinct("node").alias("n_nodes"))).withColumn("density", F.col("tau") / F.greatest("n_nodes", F.lit(1)))


def projection(edges: DataFrame) -> DataFrame:
    """src, dst, times: the static edges with their sorted times."""
    return edges.groupBy("src", "dst").agg(F.sort_array(F.collect_list("t")).alias("times"))


def degree_profile(edges: DataFrame) -> DataFrame:
    """node, temporal and static in, out and undirected degrees."""
    ends = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(1).alias("out")).union(edges.select("dst", "src", F.lit(0)))
    once = ends.groupBy("node", "other").agg(F.sum("out").alias("o"), F.sum(1 - F.col("out")).alias("i"))
    has = lambda c: F.sum((F.col(c) > 0).cast("long"))
    return once.groupBy("node").agg(F.sum("o").alias("t_out"), F.sum("i").alias("t_in"), has("o").alias("s_out"), has("i").alias("s_in"), F.count(F.lit(1)).alias("s_any"))


def literal_graph(spark: SparkSession, rows: list[tuple[int, int, int]]) -> DataFrame:
    """A small temporal graph; eid is the place in the list."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "eid long, src long, dst long, t long")
