"""The node set with the most motif weight per node: batch and greedy peeling, exact cuts, and sampled estimates."""

from __future__ import annotations

import heapq
import json
import tempfile
from collections import deque
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.motifs import Motif, hyperedges, instances, weight

#: Node sets that may be gathered for the sequential algorithms; more is an error, with batch peeling the way out.
MAX_HYPEREDGES = 2_000_000


def cut_lineage(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder the session names. Where it names none, a temporary folder with a local
    master, and an error with any other."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir is unset; executors need a folder they all share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="weftline-"))
    return df.checkpoint(eager=True)


def batch_peel(hyper: DataFrame, k: int, xi: float = 0.01) -> tuple[DataFrame, float]:
    """The nodes of the densest round and its density. hyper: nodes, w.

    Each round drops all nodes whose weight is at most k (1 + xi) times the density, and the node sets with one of them.
    """
    state = cut_lineage(hyper.select(F.monotonically_increasing_id().alias("h"), "nodes", "w"))
    alive = state.select(F.explode("nodes").alias("node")).distinct()
    best, best_nodes, size = -1.0, alive, alive.count()
    while size >= k:
        degree = state.select(F.explode("nodes").alias("node"), "w").groupBy("node").agg(F.sum("w").alias("c"))
        tau = state.agg(F.sum("w")).first()[0] or 0.0
        if tau / size > best:
            best, best_nodes = tau / size, alive
        if size <= k or not tau:
            break
        limit = k * (1 + xi) * tau / size
        kept = cut_lineage(alive.join(degree.where(F.col("c") > limit), "node", "left_semi"))
        dead = state.select("h", F.explode("nodes").alias("node")).join(kept, "node", "left_anti").select("h").distinct()
        state = cut_lineage(state.join(dead, "h", "left_anti"))
        alive, size = kept, kept.count()
    return best_nodes, max(best, 0.0)


def collect_hyperedges(hyper: DataFrame, limit: int = MAX_HYPEREDGES) -> list[tuple[tuple[int, ...], float]]:
    rows = hyper.select("nodes", "w").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} node sets: use batch_peel, or prune first")
    return [(tuple(r["nodes"]), r["w"]) for r in rows]


def greedy_peel(sets: list[tuple[tuple[int, ...], float]], k: int) -> tuple[list[int], float]:
    """Remove the node of least weight (the smaller id among equals) again and again; the densest set on the way."""
    of: dict[int, list[int]] = {}
    for i, (nodes, _) in enumerate(sets):
        for x in nodes:
            of.setdefault(x, []).append(i)
    weight_of = {x: sum(sets[i][1] for i in ids) for x, ids in of.items()}
    heap = [(w, x) for x, w in weight_of.items()]
    heapq.heapify(heap)
    alive, gone, order = set(of), [False] * len(sets), []
    tau = sum(w for _, w in sets)
    best, cut = (tau / len(alive), 0) if alive else (0.0, 0)
    while len(alive) > k:
        w, x = heapq.heappop(heap)
        if x not in alive or w != weight_of[x]:
            continue
        alive.discard(x)
        order.append(x)
        for i in of[x]:
            if not gone[i]:
                gone[i] = True
                tau -= sets[i][1]
                for y in sets[i][0]:
                    if y in alive:
                        weight_of[y] -= sets[i][1]
                        heapq.heappush(heap, (weight_of[y], y))
        if tau / len(alive) > best:
            best, cut = tau / len(alive), len(order)
    return sorted(set(of) - set(order[:cut])), float(best)


class Flow:
    """Maximum flow by shortest augmenting levels, with exact capacities (int or Fraction)."""

    def __init__(self, n: int):
        self.to: list[int] = []
        self.cap: list = []
        self.at: list[list[int]] = [[] for _ in range(n)]

    def edge(self, u: int, v: int, capacity, back=0) -> None:
        for a, b, c in ((u, v, capacity), (v, u, back)):
            self.at[a].append(len(self.to))
            self.to.append(b)
            self.cap.append(c)

    def _levels(self, s: int) -> list[int]:
        level = [-1] * len(self.at)
        level[s], queue = 0, deque([s])
        while queue:
            u = queue.popleft()
            for e in self.at[u]:
                if self.cap[e] > 0 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[u] + 1
                    queue.append(self.to[e])
        return level

    def run(self, s: int, t: int):
        total = 0
        while (level := self._levels(s))[t] >= 0:
            pointer = [0] * len(self.at)
            while True:
                path, u = [], s
                while u != t:
                    while pointer[u] < len(self.at[u]):
                        e = self.at[u][pointer[u]]
                        if self.cap[e] > 0 and level[self.to[e]] == level[u] + 1:
                            break
                        pointer[u] += 1
                    if pointer[u] < len(self.at[u]):
                        path.append(self.at[u][pointer[u]])
                        u = self.to[path[-1]]
                    elif path:
                        u = self.to[path.pop() ^ 1]
                        pointer[u] += 1
                    else:
                        break
                if u != t:
                    break
                push = min(self.cap[e] for e in path)
                for e in path:
                    self.cap[e] -= push
                    self.cap[e ^ 1] += push
                total += push
        return total

    def sink_side(self, t: int) -> set[int]:
        """The nodes that still reach t; the others are the largest source side of a minimum cut."""
        seen, queue = {t}, deque([t])
        while queue:
            u = queue.popleft()
            for e in self.at[u]:
                if self.cap[e ^ 1] > 0 and self.to[e] not in seen:
                    seen.add(self.to[e])
                    queue.append(self.to[e])
        return seen


def exact_densest(sets: list[tuple[tuple[int, ...], float]], k: int) -> tuple[list[int], float]:
    """The densest node set by minimum cuts: raise the density to that of the best cut until none is better."""
    if not sets:
        return [], 0.0
    nodes, rho = greedy_peel(sets, k)
    density = Fraction(sum(Fraction(w) for s, w in sets if set(s) <= set(nodes))) / len(nodes)
    while True:
        # Every node of a denser set is in instances of at least that density.
        live = [(s, Fraction(w)) for s, w in sets]
        while True:
            c: dict[int, Fraction] = {}
            for s, w in live:
                for x in s:
                    c[x] = c.get(x, Fraction(0)) + w
            fewer = [(s, w) for s, w in live if all(c[x] >= density for x in s)]
            if len(fewer) == len(live):
                break
            live = fewer
        if not live:
            return sorted(nodes), float(density)
        ids = {x: i for i, x in enumerate(sorted({x for s, _ in live for x in s}))}
        flow = Flow(2 + len(live) + len(ids))
        infinite = sum(w for _, w in live) + 1
        for i, (s, w) in enumerate(live):
            flow.edge(0, 2 + i, w)
            for x in s:
                flow.edge(2 + i, 2 + len(live) + ids[x], infinite)
        for i in ids.values():
            flow.edge(2 + len(live) + i, 1, density)
        flow.run(0, 1)
        sink = flow.sink_side(1)
        chosen = {x for x, i in ids.items() if 2 + len(live) + i not in sink}
        value = sum(w for s, w in live if set(s) <= chosen)
        if not chosen or value / len(chosen) <= density:
            return sorted(nodes), float(density)
        nodes, density = sorted(chosen), value / len(chosen)


def sampled_hyperedges(edges: DataFrame, motif: Motif, delta: int, samples: int = 100, seed: int = 0, decay: float | None = None, c: float = 1.25) -> DataFrame:
    """nodes, w: unbiased estimates of the motif weight of node sets, from windows of c * delta at random starts.

    The starts are uniform over every second at which a window can hold an instance; an instance counts by the share of
    starts whose window holds it.
    """
    lo, hi = edges.agg(F.min("t"), F.max("t")).first()
    width = int(np.ceil(c * delta))
    if lo is None:
        return hyperedges(instances(edges, motif, delta), motif).select("nodes", "w")
    first, last = lo - width + 1, hi
    starts = np.random.default_rng(seed).integers(first, last + 1, samples)
    windows = edges.sparkSession.createDataFrame([(i, int(s)) for i, s in enumerate(starts)], "sample long, lo long").withColumn("b", F.explode(F.array(F.floor(F.col("lo") / width), F.floor(F.col("lo") / width) + 1)))
    rows = edges.withColumn("b", F.floor(F.col("t") / width)).join(F.broadcast(windows), "b").where(f"t >= lo and t < lo + {width}").select("eid", "src", "dst", "t", "sample")
    found = instances(rows, motif, delta, by="sample")
    share = weight(motif, decay) * (last - first + 1) / (width - (F.col(f"t{len(motif.edges)}") - F.col("t1"))) / samples
    nodes = F.array_sort(F.array(*[F.col(f"n{i}") for i in range(motif.k)]))
    return found.groupBy(nodes.alias("nodes")).agg(F.sum(share).alias("w"))


def estimate_spread(edges: DataFrame, motif: Motif, delta: int, runs: int = 5, samples: int = 100) -> DataFrame:
    """node, mean and deviation of its estimated weight over independent runs."""
    all_runs = None
    for r in range(runs):
        one = sampled_hyperedges(edges, motif, delta, samples, r).select(F.explode("nodes").alias("node"), "w").groupBy("node").agg(F.sum("w").alias("w"))
        all_runs = one if all_runs is None else all_runs.unionByName(one)
    total = all_runs.groupBy("node").agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q"))
    return total.select("node", (F.col("s") / runs).alias("mean"), F.sqrt(F.greatest(F.col("q") / runs - F.pow(F.col("s") / runs, 2), F.lit(0.0))).alias("deviation"))


def prob_peel(edges: DataFrame, motif: Motif, delta: int, samples: int = 100, xi: float = 0.01, seed: int = 0, rounds: int | None = None, decay: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Batch peeling on estimates drawn anew each round. Returns the best set's nodes and the edges left at the end."""
    from weftline.plans.motifs import induced

    left, best, best_nodes, n = edges, -1.0, None, 0
    while rounds is None or n < rounds:
        hyper = cut_lineage(sampled_hyperedges(left, motif, delta, samples, seed + n, decay))
        alive = cut_lineage(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct())
        size, tau = alive.count(), hyper.agg(F.sum("w")).first()[0] or 0.0
        if size < motif.k or not tau:
            break
        if tau / size > best:
            best, best_nodes = tau / size, alive
        degree = hyper.select(F.explode("nodes").alias("node"), "w").groupBy("node").agg(F.sum("w").alias("c"))
        kept = cut_lineage(degree.where(F.col("c") > motif.k * (1 + xi) * tau / size).select("node"))
        left = cut_lineage(induced(left, kept))
        n += 1
    nodes = best_nodes if best_nodes is not None else edges.select(F.col("src").alias("node")).where("false")
    return nodes, left


def hybrid_peel(edges: DataFrame, motif: Motif, delta: int, samples: int = 100, xi: float = 0.01, seed: int = 0, rounds: int = 2, decay: float | None = None) -> tuple[list[int], float]:
    """Some rounds on estimates, then greedy peeling on the exact instances of what is left."""
    _, left = prob_peel(edges, motif, delta, samples, xi, seed, rounds, decay)
    return greedy_peel(collect_hyperedges(hyperedges(instances(left, motif, delta), motif, decay)), motif.k)


def densest(edges: DataFrame, motif: Motif, delta: int, algorithm: str = "batch", decay: float | None = None, xi: float = 0.01, samples: int = 100, rounds: int = 2, seed: int = 0) -> DataFrame:
    """algorithm, node, density: one of greedy, batch, probpeel, exact and hybrid."""
    spark = edges.sparkSession
    if algorithm == "batch":
        nodes, density = batch_peel(hyperedges(instances(edges, motif, delta), motif, decay), motif.k, xi)
    elif algorithm in ("greedy", "exact"):
        sets = collect_hyperedges(hyperedges(instances(edges, motif, delta), motif, decay))
        found, density = (greedy_peel if algorithm == "greedy" else exact_densest)(sets, motif.k)
        nodes = spark.createDataFrame([(x,) for x in found], "node long")
    elif algorithm == "hybrid":
        found, density = hybrid_peel(edges, motif, delta, samples, xi, seed, rounds, decay)
        nodes = spark.createDataFrame([(x,) for x in found], "node long")
    elif algorithm == "probpeel":
        from weftline.plans.motifs import evaluate

        nodes, _ = prob_peel(edges, motif, delta, samples, xi, seed, decay=decay)
        density = evaluate(edges, nodes, motif, delta, decay).first()["density"]
    else:
        raise ValueError(f"unknown algorithm {algorithm}")
    return nodes.select(F.lit(algorithm).alias("algorithm"), "node", F.lit(float(density)).alias("density"))


def solution_json(nodes: list[int]) -> str:
    return json.dumps({"Nodes": nodes})


def sweep(spark: SparkSession, edges: DataFrame, motif: Motif, delta: int, samples: list[int] = (), xis: list[float] = ()) -> DataFrame:
    """parameter, value, result: estimated totals for numbers of samples, and batch densities for values of xi."""
    rows = [("samples", float(s), float(sampled_hyperedges(edges, motif, delta, s).agg(F.sum("w")).first()[0] or 0.0)) for s in samples]
    if xis:
        hyper = cut_lineage(hyperedges(instances(edges, motif, delta), motif))
        rows += [("xi", float(x), batch_peel(hyper, motif.k, x)[1]) for x in xis]
    return spark.createDataFrame(rows, "parameter string, value double, result double")
