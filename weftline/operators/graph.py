"""Graphs as tables: edges (src, dst[, eid, ...]) and nodes (id[, ...]); construction, degrees, patterns and paths.

Undirected operators use the symmetric set of distinct edges without self-loops. Iterative ones are driver loops over
DataFrames whose lineage is cut at each round in the shared checkpoint folder; only counts reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.order import numbered, prefix
from weftline.operators.pair_sums import blocks_for, in_blocks, listed, met
from weftline.operators.shared_graph import constraints, hop_counts, shared
from weftline.plans.densest import cut_lineage

# Construction


def from_table(df: DataFrame, src: str, dst: str) -> DataFrame:
    return df.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct()


def network_from_table(df: DataFrame, src: str, dst: str, attributes: list[str], nodes: DataFrame | None = None, node_key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes, with the columns of the node table where given, and edges (eid, src, dst, attributes)."""
    edges = df.select(F.monotonically_increasing_id().alias("eid"), F.col(src).alias("src"), F.col(dst).alias("dst"), *attributes)
    ids = nodes_of(edges)
    return (ids.join(nodes, ids["id"] == nodes[node_key], "left").drop(node_key) if nodes is not None else ids), edges


def node_attributes(df: DataFrame, node: str, policies: dict[str, str]) -> DataFrame:
    """node and one aggregate (min, max, sum, avg, count, first, last) for each column."""
    return df.groupBy(F.col(node).alias("id")).agg(*[F.expr(f"{how}({column})").alias(column) for column, how in policies.items()])


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst").where("src != dst")
    return e.union(e.select("dst", "src")).distinct()


def canonical(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, a < b."""
    return edges.where("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns])


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in nodes (id)."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)


def edge_subgraph(edges: DataFrame, condition) -> DataFrame:
    return edges.where(condition)


def egonet(edges: DataFrame, center: int) -> tuple[DataFrame, DataFrame]:
    """The edges among a node and its neighbours, and a row with the numbers of edges that leave that set and enter it."""
    near = edges.where(F.col("src") == center).select(F.col("dst").alias("id")).union(edges.where(F.col("dst") == center).select("src")).union(edges.sparkSession.createDataFrame([(center,)], "id long")).distinct()
    inside = induced(edges, near)
    src, dst = (near.select(F.col("id").alias(c)) for c in ("src", "dst"))
    out = edges.join(src, "src", "left_semi").join(dst, "dst", "left_anti").agg(F.count(F.lit(1)).alias("leaving"))
    into = edges.join(dst, "dst", "left_semi").join(src, "src", "left_anti").agg(F.count(F.lit(1)).alias("entering"))
    return inside, out.crossJoin(into)


def random_nodes(edges: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n nodes by the smallest hash with the seed: the same whatever the partitioning."""
    return nodes_of(edges).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n)


def random_edges(edges: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n edges by the smallest hash with the seed. They are numbered in ranges, so n may be large."""
    ranked = numbered(edges.withColumn("_h", F.xxhash64(F.lit(seed), "src", "dst")), ["_h", "src", "dst"], "_rank")
    return ranked.where(F.col("_rank") < n).select(*edges.columns)


def delete_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_anti").join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti").select(*edges.columns)


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select(*edges.columns)


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    return edges.unionByName(new, allowMissingColumns=True)


def add_self_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(nodes_of(edges).select("id", "id")).distinct()


def drop_self_edges(edges: DataFrame) -> DataFrame:
    return edges.where("src != dst")


def flatten_modes(modes: dict[str, DataFrame], crosses: dict[str, tuple[str, str, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Typed node tables (id) and edge tables (from mode, to mode, src, dst) as one network: ids are structs (mode, id)."""
    nodes = edges = None
    for name, df in modes.items():
        own = df.select(F.struct(F.lit(name).alias("mode"), F.col("id")).alias("id"), *[c for c in df.columns if c != "id"])
        nodes = own if nodes is None else nodes.unionByName(own, allowMissingColumns=True)
    for name, (a, b, df) in crosses.items():
        rest = [c for c in df.columns if c not in ("src", "dst")]
        own = df.select(F.lit(name).alias("cross"), F.struct(F.lit(a).alias("mode"), F.col("src").alias("id")).alias("src"), F.struct(F.lit(b).alias("mode"), F.col("dst").alias("id")).alias("dst"), *rest)
        edges = own if edges is None else edges.unionByName(own, allowMissingColumns=True)
    return nodes, edges


@dataclass(frozen=True)
class ModeNet:
    """A network of several kinds of nodes: tables (id, ...) by mode, and edge tables (src, dst, ...) between two modes by
    cross-net. Every change gives a new one."""

    modes: dict[str, DataFrame]
    crosses: dict[str, tuple[str, str, DataFrame]] = field(default_factory=dict)

    def with_mode(self, name: str, nodes: DataFrame) -> ModeNet:
        return ModeNet(self.modes | {name: nodes}, self.crosses)

    def with_cross(self, name: str, source: str, target: str, edges: DataFrame) -> ModeNet:
        if source not in self.modes or target not in self.modes:
            raise ValueError("a cross-net joins two modes of the network")
        return ModeNet(self.modes, self.crosses | {name: (source, target, edges)})

    def without_mode(self, name: str) -> ModeNet:
        """Its cross-nets go too."""
        return ModeNet({k: v for k, v in self.modes.items() if k != name}, {k: v for k, v in self.crosses.items() if name not in v[:2]})

    def without_cross(self, name: str) -> ModeNet:
        return ModeNet(self.modes, {k: v for k, v in self.crosses.items() if k != name})

    def neighbours(self, cross: str) -> DataFrame:
        """src, dst of a cross-net."""
        return self.crosses[cross][2].select("src", "dst")

    def sub_modes(self, conditions: dict) -> ModeNet:
        """The modes given, with the nodes their conditions hold for, and the edges among them."""
        modes = {k: self.modes[k].where(c) for k, c in conditions.items()}
        crosses = {}
        for name, (a, b, e) in self.crosses.items():
            if a in modes and b in modes:
                kept = e.join(modes[a].select(F.col("id").alias("src")), "src", "left_semi").join(modes[b].select(F.col("id").alias("dst")), "dst", "left_semi")
                crosses[name] = (a, b, kept.select(*e.columns))
        return ModeNet(modes, crosses)

    def sub_crosses(self, names: list[str]) -> ModeNet:
        """The cross-nets given and the modes they join."""
        crosses = {k: self.crosses[k] for k in names}
        used = {m for a, b, _ in crosses.values() for m in (a, b)}
        return ModeNet({k: v for k, v in self.modes.items() if k in used}, crosses)

    def flat(self) -> tuple[DataFrame, DataFrame]:
        return flatten_modes(self.modes, self.crosses)


def set_attribute(df: DataFrame, key: str, values: DataFrame, name: str) -> DataFrame:
    """df (nodes or edges) with the attribute name taken from values (key, name), in place of one it has; null where missing."""
    return df.drop(name).join(values.select(key, name), key, "left")


def delete_attribute(df: DataFrame, name: str) -> DataFrame:
    return df.drop(name)


# Degrees


def degrees(edges: DataFrame) -> DataFrame:
    """id, out_deg, in_deg, deg."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("o").alias("out_deg"), F.sum("i").alias("in_deg")).withColumn("deg", F.col("out_deg") + F.col("in_deg"))


def degree_distribution(edges: DataFrame, kind: str = "deg") -> DataFrame:
    return degrees(edges).groupBy(F.col(kind).alias("degree")).agg(F.count(F.lit(1)).alias("n"))


def max_degree_node(edges: DataFrame, kind: str = "deg") -> DataFrame:
    return degrees(edges).select("id", kind).orderBy(F.desc(kind), "id").limit(1)


def edge_counts(edges: DataFrame) -> DataFrame:
    """One row: directed, undirected and mutual pairs and self-edges, each distinct."""
    e = edges.select("src", "dst").distinct()
    pairs = e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    loops = F.col("a") == F.col("b")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return pairs.agg(F.coalesce(F.sum(F.when(~loops, F.col("n"))), F.lit(0)).alias("directed"), count(~loops).alias("undirected"), count(~loops & (F.col("n") == 2)).alias("mutual"), count(loops).alias("self_edges"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    d = symmetric(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
    n = nodes_of(edges).agg(F.count(F.lit(1)).alias("n"))
    return d.crossJoin(F.broadcast(n)).select("id", (F.col("deg") / F.greatest(F.col("n") - 1, F.lit(1))).alias("centrality"))


# Triads


def forward(edges: DataFrame) -> DataFrame:
    """Each undirected edge from the end of smaller degree, so that a hub has few out-edges and wedges stay near linear."""
    e = canonical(edges)
    d = e.select(F.col("a").alias("x")).union(e.select("b")).groupBy("x").agg(F.count(F.lit(1)).alias("d"))
    both = e.join(d.select(F.col("x").alias("a"), F.col("d").alias("da")), "a").join(d.select(F.col("x").alias("b"), F.col("d").alias("db")), "b")
    first = F.struct("da", "a") < F.struct("db", "b")
    return both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v"))


def triangles(edges: DataFrame) -> DataFrame:
    """a < b < c of each triangle."""
    f = forward(edges)
    wedge = f.select("u", F.col("v").alias("x")).join(f.select("u", F.col("v").alias("y")), "u").where("x < y")
    e = canonical(edges)
    found = wedge.join(e, (F.col("x") == F.col("a")) & (F.col("y") == F.col("b")), "left_semi")
    t = F.array_sort(F.array("u", "x", "y"))
    return found.select(t[0].alias("a"), t[1].alias("b"), t[2].alias("c"))


def triangle_count(edges: DataFrame) -> DataFrame:
    return triangles(edges).agg(F.count(F.lit(1)).alias("triangles"))


def node_triads(edges: DataFrame) -> DataFrame:
    """id, closed, open: connected pairs of neighbours and the others."""
    deg = symmetric(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    closed = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("closed"))
    both = deg.join(closed, "id", "left").withColumn("closed", F.coalesce("closed", F.lit(0)))
    return both.select("id", "closed", (F.col("d") * (F.col("d") - 1) / 2 - F.col("closed")).cast("long").alias("open"))


def clustering(edges: DataFrame) -> DataFrame:
    """id and its clustering coefficient, 0 where undefined."""
    return node_triads(edges).select("id", F.coalesce(F.try_divide("closed", F.col("closed") + F.col("open")), F.lit(0.0)).alias("cc"))


def clustering_by_degree(edges: DataFrame) -> DataFrame:
    deg = symmetric(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return clustering(edges).join(deg, "id").groupBy("degree").agg(F.avg("cc").alias("cc"))


def triad_edges(edges: DataFrame) -> DataFrame:
    t = triangles(edges)
    return t.select("a", "b").union(t.select("b", "c")).union(t.select("a", "c")).distinct()


def triad_participation(edges: DataFrame) -> DataFrame:
    n = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triads"))
    return n.groupBy("triads").agg(F.count(F.lit(1)).alias("n"))


def common_neighbors(edges: DataFrame) -> DataFrame:
    """a < b and the number of their common neighbours, where there are some."""
    s = symmetric(edges)
    return s.select("src", F.col("dst").alias("a")).join(s.select("src", F.col("dst").alias("b")), "src").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))


def length2_paths(edges: DataFrame, src: int, dst: int) -> DataFrame:
    s = symmetric(edges)
    return s.where(F.col("src") == src).select(F.col("dst").alias("mid")).join(s.where(F.col("dst") == dst).select(F.col("src").alias("mid")), "mid")


def network_constraint(edges: DataFrame) -> DataFrame:
    """id and Burt's constraint with equal shares: over neighbours j, (p_ij + sum over q of p_iq p_qj) squared.
    Tasks share a graph that fits their memory; over a larger one all paths of two edges are joined."""
    g = shared(edges, False)
    if g is not None:
        return constraints(g, edges)
    s = symmetric(edges)
    share = s.join(s.groupBy("src").agg(F.count(F.lit(1)).alias("d")), "src").select("src", "dst", (1 / F.col("d")).alias("p"))
    two = share.select("src", F.col("dst").alias("q"), F.col("p").alias("p1")).join(share.select(F.col("src").alias("q"), "dst", F.col("p").alias("p2")), "q").where("src != dst").groupBy("src", "dst").agg(F.sum(F.col("p1") * F.col("p2")).alias("i"))
    return share.join(two, ["src", "dst"], "left").groupBy(F.col("src").alias("id")).agg(F.sum(F.pow(F.col("p") + F.coalesce("i", F.lit(0.0)), 2)).alias("constraint"))


def knn_jaccard(edges: DataFrame, k: int) -> DataFrame:
    """a, b, similarity, rank: the k sources with the most similar out-neighbours, for sources without in-edges. Blocks of
    sources meet in tasks, which give the k best of each source."""
    e = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    e = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_anti")
    keys = cut_lineage(listed(e, "src", "dst", F.lit(1), F.count(F.lit(1))))
    dealt, ends = in_blocks(keys, "key", blocks_for(keys.agg(F.sum("size")).first()[0] or 0))
    kind = edges.schema["src"].dataType.simpleString()

    def pick(keys1, keys2, size1, size2, i, j, common):
        a, b = keys1.to_numpy(), keys2.to_numpy()
        other = a[i] != b[j]
        i, j, common = i[other], j[other], common[other]
        similarity = common / (size1[i] + size2[j] - common)
        # Sums come by a. The least of the largest ones of k parts of a source is no more than its k-th best, so few are sorted;
        # among equals the smaller b is first.
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
        n = np.diff(np.r_[first, len(i)])
        parts = np.where(n >= k, k, 1)
        head = np.cumsum(parts) - parts
        part = np.arange(int(parts.sum())) - np.repeat(head, parts)
        if len(i):
            top = np.maximum.reduceat(similarity, np.repeat(first, parts) + np.repeat(n, parts) * part // np.repeat(parts, parts))
            bound = np.where(n >= k, np.minimum.reduceat(top, head), 0.0)
            near = similarity >= np.repeat(bound, n)
            i, j, similarity = i[near], j[near], similarity[near]
        order = np.lexsort((b[j], -similarity, i))
        i, j, similarity = i[order], j[order], similarity[order]
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
        best = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)])) < k
        return [pa.array(a[i[best]]), pa.array(b[j[best]]), pa.array(similarity[best])]

    scored = met(dealt, dealt, [(i, j) for i in ends for j in ends], pick, None, f"a {kind}, b {kind}, similarity double")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))).where(F.col("rank") <= k)


def squares(edges: DataFrame) -> DataFrame:
    """Undirected 4-cycles a-b-c-d, each once, with a the smallest and b < d."""
    s = symmetric(edges)
    w = s.select(F.col("src").alias("b"), F.col("dst").alias("a")).join(s.select(F.col("src").alias("b"), F.col("dst").alias("c")), "b").where("a < c and a < b")
    return w.join(w.select("a", "c", F.col("b").alias("d")), ["a", "c"]).where("b < d").select("a", "b", "c", "d")


def directed_triangles(edges: DataFrame) -> DataFrame:
    """Cycles a>b>c>a, each once, with a the smallest."""
    e = edges.select("src", "dst").where("src != dst").distinct()
    two = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(e.select(F.col("src").alias("b"), F.col("dst").alias("c")), "b").where("a < b and a < c")
    return two.join(e.select(F.col("src").alias("c"), F.col("dst").alias("a")), ["c", "a"], "left_semi").select("a", "b", "c")


# Paths


def _unfinished(what: str, most: int) -> RuntimeError:
    return RuntimeError(f"{what} did not end within {most} rounds")


def bfs(edges: DataFrame, sources: DataFrame, directed: bool = True, hops: int | None = None, most: int = 100_000) -> DataFrame:
    """source, id, dist, parent for each source (id) and each node it reaches, within hops where given; the parent is the
    smallest possible. An error is raised if nodes are left after most rounds."""
    e = edges.select("src", "dst").where("src != dst").distinct() if directed else symmetric(edges)
    e = cut_lineage(e)
    front = cut_lineage(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("dist"), F.lit(None).cast("long").alias("parent")))
    seen = front
    for d in range(1, (most if hops is None else hops) + 1):
        new = front.select("source", F.col("id").alias("src")).join(e, "src").groupBy("source", F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        front = cut_lineage(new.join(seen, ["source", "id"], "left_anti").select("source", "id", F.lit(d).alias("dist"), "parent"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    else:
        if hops is None:
            raise _unfinished("bfs", most)
    return seen


def shortest_path(edges: DataFrame, src: int, dst: int, directed: bool = True) -> list[int]:
    """One shortest path, through the smallest parents; empty if there is none."""
    tree = cut_lineage(bfs(edges, edges.sparkSession.createDataFrame([(src,)], "id long"), directed))
    path = [dst]
    while path[-1] != src:
        row = tree.where(F.col("id") == path[-1]).select("parent").first()
        if row is None:
            return []
        path.append(row["parent"])
    return path[::-1]


def nodes_at(edges: DataFrame, src: int, hops: int, directed: bool = True) -> DataFrame:
    return bfs(edges, edges.sparkSession.createDataFrame([(src,)], "id long"), directed, hops).where(F.col("dist") == hops).select("id")


def distance_counts(edges: DataFrame, directed: bool = False, sample: int | None = None) -> DataFrame:
    """source, dist, n: how many nodes each source (all nodes or a seeded sample) has at each distance, itself at 0.
    Tasks share a graph that fits their memory; a larger one is searched by joins, which hold all pairs."""
    g = shared(edges, directed)
    if g is None:
        sources = nodes_of(edges) if sample is None else random_nodes(edges, sample)
        return bfs(edges, sources, directed).groupBy("source", "dist").agg(F.count(F.lit(1)).alias("n"))
    return hop_counts(g, edges, None if sample is None else [r["id"] for r in random_nodes(edges, sample).collect()])


def eccentricity(edges: DataFrame, directed: bool = False) -> DataFrame:
    return distance_counts(edges, directed).groupBy(F.col("source").alias("id")).agg(F.max("dist").alias("eccentricity"))


def _farness(counts: DataFrame, edges: DataFrame) -> DataFrame:
    """id, farness from distance counts, corrected by the share of nodes that are reached."""
    n = nodes_of(edges).agg(F.count(F.lit(1)).alias("n"))
    d = counts.groupBy(F.col("source").alias("id")).agg(F.sum(F.col("dist") * F.col("n")).alias("total"), F.sum("n").alias("reached"))
    far = F.col("total") / (F.col("reached") - 1) * (F.col("n") - 1) / (F.col("reached") - 1)
    return d.crossJoin(F.broadcast(n)).select("id", F.when(F.col("reached") > 1, far).otherwise(0.0).alias("farness"))


def closeness(edges: DataFrame, directed: bool = False) -> DataFrame:
    """id, farness, closeness, both corrected by the share of nodes that are reached."""
    return _farness(distance_counts(edges, directed), edges).withColumn("closeness", F.when(F.col("farness") > 0, 1 / F.col("farness")).otherwise(0.0))


def distance_distribution(edges: DataFrame, sample: int | None = None, directed: bool = False) -> DataFrame:
    """dist and the number of (source, node) pairs at it, from all nodes or a seeded sample."""
    return distance_counts(edges, directed, sample).groupBy("dist").agg(F.sum("n").alias("n"))


def effective_diameter(edges: DataFrame, share: float = 0.9, sample: int | None = None) -> float:
    """The distance, interpolated, within which that share of reachable pairs lies."""
    rows = [(r["dist"], r["n"]) for r in distance_distribution(edges, sample).where("dist > 0").orderBy("dist").collect()]
    goal, below = share * sum(n for _, n in rows), 0
    for d, n in rows:
        if below + n >= goal:
            return d - 1 + (goal - below) / n
        below += n
    return 0.0


def weighted_distances(edges: DataFrame, source: int, weight: str, most: int = 100_000) -> DataFrame:
    """id and the least total weight from the source over directed edges, by relaxation."""
    dist = cut_lineage(edges.sparkSession.createDataFrame([(source, 0.0)], "id long, dist double"))
    front = dist
    for _ in range(most):
        new = front.join(edges.select(F.col("src").alias("id"), "dst", F.col(weight).alias("w")), "id").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("dist") + F.col("w")).alias("new"))
        front = cut_lineage(new.join(dist, "id", "left").where("dist is null or new < dist").select("id", F.col("new").alias("dist")))
        if front.isEmpty():
            break
        dist = cut_lineage(dist.join(front.select("id"), "id", "left_anti").unionByName(front))
    else:
        raise _unfinished("weighted_distances", most)
    return dist


# Components and cores


def weak_components(edges: DataFrame, most: int = 100_000) -> DataFrame:
    """id and the smallest id of its component: labels fall along edges and jump to the label's label."""
    e = cut_lineage(symmetric(edges))
    label = cut_lineage(nodes_of(edges).select("id", F.col("id").alias("root")))
    for _ in range(most):
        near = e.join(label.select(F.col("id").alias("dst"), "root"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("root").alias("near"))
        low = label.join(near, "id", "left").select("id", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root"))
        low = cut_lineage(low)
        jump = low.join(low.select(F.col("id").alias("root"), F.col("root").alias("up")), "root").select("id", F.least("root", "up").alias("root"), "old")
        jump = cut_lineage(jump)
        label = jump.select("id", "root")
        if jump.where("root != old").isEmpty():
            break
    else:
        raise _unfinished("weak_components", most)
    return label


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("root").agg(F.count(F.lit(1)).alias("size"))


def _reach_low(e: DataFrame, label: DataFrame, frm: str, to: str, same: DataFrame | None, most: int) -> DataFrame:
    """The smallest label that reaches each node along frm -> to, inside groups (id, g) where given."""
    if same is not None:
        e = cut_lineage(e.join(same.select(F.col("id").alias("src"), F.col("g").alias("gs")), "src").join(same.select(F.col("id").alias("dst"), F.col("g").alias("gd")), "dst").where("gs = gd").select("src", "dst"))
    for _ in range(most):
        near = e.join(label.select(F.col("id").alias(frm), "l"), frm).groupBy(F.col(to).alias("id")).agg(F.min("l").alias("near"))
        new = cut_lineage(label.join(near, "id", "left").select("id", F.least("l", F.coalesce("near", "l")).alias("l"), (F.coalesce("near", "l") < F.col("l")).alias("moved")))
        label = new.select("id", "l")
        if new.where("moved").isEmpty():
            break
    else:
        raise _unfinished("strong_components", most)
    return label


def strong_components(edges: DataFrame, most: int = 100_000) -> DataFrame:
    """id and root: nodes that reach each other. In each round the smallest id that reaches a node colours it, and of a
    colour those that also reach its origin are a component and go."""
    e = cut_lineage(edges.select("src", "dst").where("src != dst").distinct())
    left = cut_lineage(nodes_of(edges))
    done = None
    while not left.isEmpty():
        colour = _reach_low(e, left.select("id", F.col("id").alias("l")), "src", "dst", None, most)
        same = cut_lineage(colour.select("id", F.col("l").alias("g")))
        back = cut_lineage(_reach_low(e, same.select("id", F.when(F.col("id") == F.col("g"), F.lit(0)).otherwise(F.lit(1)).alias("l")), "dst", "src", same, most).where("l = 0").select("id"))
        found = cut_lineage(same.join(back, "id", "left_semi").select("id", F.col("g").alias("root")))
        roots = found.groupBy("root").agg(F.min("id").alias("low"))
        found = found.join(roots, "root").select("id", F.col("low").alias("root"))
        done = found if done is None else done.unionByName(found)
        left = cut_lineage(left.join(back, "id", "left_anti"))
        e = cut_lineage(delete_nodes(e, back))
    return done if done is not None else nodes_of(edges).withColumn("root", F.col("id"))


def k_core(edges: DataFrame, k: int) -> DataFrame:
    """The undirected edges (a < b) of the k-core."""
    e = cut_lineage(canonical(edges))
    while True:
        weak = e.select(F.col("a").alias("id")).union(e.select("b")).groupBy("id").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") < k).select("id")
        weak = cut_lineage(weak)
        if weak.isEmpty():
            return e
        e = cut_lineage(e.join(weak.select(F.col("id").alias("a")), "a", "left_anti").join(weak.select(F.col("id").alias("b")), "b", "left_anti").select("a", "b"))


# Ranks


def pagerank(edges: DataFrame, iterations: int = 100, damping: float = 0.85, tolerance: float = 1e-4, weight: str | None = None, reset: int | None = None) -> DataFrame:
    """id, rank. Edges share a node's rank (by weight where given); what is lost goes evenly to all nodes, or, with
    reset, to that node (personalised)."""
    e = edges.select("src", "dst", (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    e = e.groupBy("src", "dst").agg(F.sum("w").alias("w")) if weight else e.distinct()
    e = cut_lineage(e.join(e.groupBy("src").agg(F.sum("w").alias("total")), "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")))
    nodes = cut_lineage(nodes_of(edges).join(e.select(F.col("src").alias("id"), F.lit(True).alias("passes")).distinct(), "id", "left").na.fill(False, ["passes"]))
    n = nodes.count()
    start = F.when(F.col("id") == reset, 1.0).otherwise(0.0) if reset is not None else F.lit(1.0 / max(n, 1))
    rank = cut_lineage(nodes.select("id", start.alias("rank"), "passes"))
    for _ in range(iterations):
        got = e.join(rank.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg((damping * F.sum(F.col("rank") * F.col("share"))).alias("got"))
        # What dangling nodes hold and the damping takes is known from the old ranks, so a round is one job.
        new = rank.join(got, "id", "left").select("id", F.col("rank").alias("old"), F.coalesce("got", F.lit(0.0)).alias("got"), "passes")
        lost = rank.agg((1 - damping * F.sum(F.when(F.col("passes"), F.col("rank")).otherwise(0.0))).alias("leak"))
        add = F.when(F.col("id") == reset, F.col("leak")).otherwise(0.0) if reset is not None else F.col("leak") / max(n, 1)
        moved = cut_lineage(new.crossJoin(F.broadcast(lost)).select("id", (F.col("got") + add).alias("rank"), "passes", "old"))
        rank = moved.drop("old")
        if tolerance and (moved.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0) < tolerance:
            break
    return rank.select("id", "rank")


def hits(edges: DataFrame, iterations: int = 20) -> DataFrame:
    """id, hub, authority, each of length 1."""
    e = cut_lineage(edges.select("src", "dst").distinct())
    score = cut_lineage(nodes_of(edges).select("id", F.lit(1.0).alias("hub"), F.lit(1.0).alias("authority")))

    def unit(df: DataFrame, c: str) -> DataFrame:
        norm = df.agg(F.sqrt(F.sum(F.col(c) * F.col(c)))).first()[0] or 1.0
        return df.withColumn(c, F.col(c) / (norm or 1.0))

    for _ in range(iterations):
        a = e.join(score.select(F.col("id").alias("src"), "hub"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("hub").alias("authority"))
        score = unit(cut_lineage(score.select("id", "hub").join(a, "id", "left").na.fill(0.0)), "authority")
        h = e.join(score.select(F.col("id").alias("dst"), "authority"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("authority").alias("hub"))
        score = cut_lineage(unit(cut_lineage(score.select("id", "authority").join(h, "id", "left").na.fill(0.0)), "hub"))
    return score.select("id", "hub", "authority")


def eigenvector(edges: DataFrame, iterations: int = 100, tolerance: float = 1e-4) -> DataFrame:
    """id, score: the main eigenvector of the undirected graph, of length 1."""
    s = cut_lineage(symmetric(edges))
    nodes = nodes_of(edges)
    score = cut_lineage(nodes.select("id", F.lit(1.0).alias("score")))
    for _ in range(iterations):
        new = s.join(score.select(F.col("id").alias("dst"), "score"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("score").alias("new"))
        new = cut_lineage(score.join(new, "id", "left").na.fill(0.0, ["new"]))
        norm = new.agg(F.sqrt(F.sum(F.col("new") * F.col("new")))).first()[0] or 1.0
        moved = new.select("id", (F.col("new") / norm).alias("new"), "score")
        diff = moved.agg(F.sum(F.abs(F.col("new") - F.col("score")))).first()[0] or 0.0
        score = cut_lineage(moved.select("id", F.col("new").alias("score")))
        if diff < tolerance:
            break
    return score


# Communities, core and periphery, cascades


def neighbourhood_function(edges: DataFrame, directed: bool = True, hops: int = 32, lg_k: int = 12, growth: float = 0.001) -> DataFrame:
    """hop and the number of (node, reached node) pairs within it, each node counting itself at hop 0.

    Over a graph that tasks can share the numbers are exact. They are estimates over a larger one: every node holds a HyperLogLog sketch of the nodes it reaches and takes the union with its neighbours' in each round,
    so the state is one sketch of fixed size a node. It ends when the sum grows by less than the share given.
    """
    g = shared(edges, directed)
    if g is not None:
        at = {int(r["dist"]): r["n"] for r in hop_counts(g, edges).groupBy("dist").agg(F.sum("n").alias("n")).collect()}
        rows = [(0, float(at.get(0, 0)))]
        for h in range(1, hops + 1):
            rows.append((h, rows[-1][1] + at.get(h, 0)))
            if rows[-1][1] <= rows[-2][1] * (1 + growth):
                break
        return edges.sparkSession.createDataFrame(rows, "hop int, pairs double")
    e = cut_lineage(edges.select("src", "dst").distinct() if directed else symmetric(edges))
    # Each sketch grows from those of the nodes its edges lead to.
    state = cut_lineage(nodes_of(edges).groupBy("id").agg(F.hll_sketch_agg(F.col("id"), F.lit(lg_k)).alias("s")))
    rows = [(0, float(state.count()))]
    for h in range(1, hops + 1):
        reached = e.join(state.select(F.col("id").alias("dst"), "s"), "dst").select(F.col("src").alias("id"), "s")
        state = cut_lineage(state.unionByName(reached).groupBy("id").agg(F.hll_union_agg("s").alias("s")))
        rows.append((h, float(state.agg(F.sum(F.hll_sketch_estimate("s"))).first()[0] or 0.0)))
        if rows[-1][1] <= rows[-2][1] * (1 + growth):
            break
    return edges.sparkSession.createDataFrame(rows, "hop int, pairs double")


def weighted_closeness(edges: DataFrame, weight: str) -> DataFrame:
    """id, farness by least total weights over directed edges, corrected by the share of nodes reached. Tasks share a graph
    that fits their memory and has few different weights; others are relaxed by joins, which hold all pairs."""
    g = shared(edges, True, weight)
    if g is not None:
        return _farness(hop_counts(g, edges), edges)
    e = cut_lineage(edges.groupBy("src", "dst").agg(F.min(weight).alias("w")))
    dist = cut_lineage(nodes_of(edges).select(F.col("id").alias("source"), "id", F.lit(0.0).alias("dist")))
    front = dist
    while not front.isEmpty():
        new = front.join(e.select(F.col("src").alias("id"), "dst", "w"), "id").groupBy("source", F.col("dst").alias("id")).agg(F.min(F.col("dist") + F.col("w")).alias("new"))
        front = cut_lineage(new.join(dist, ["source", "id"], "left").where("dist is null or new < dist").select("source", "id", F.col("new").alias("dist")))
        dist = cut_lineage(dist.join(front.select("source", "id"), ["source", "id"], "left_anti").unionByName(front))
    return _farness(dist.withColumn("n", F.lit(1)), edges)


def subtree_sizes(tree: DataFrame) -> DataFrame:
    """id and the number of nodes below it (itself too) in a tree (id, parent): each node adds one to all its ancestors,
    which are found level by level."""
    step = cut_lineage(tree.select("id", "parent"))
    here = cut_lineage(step.select("id", F.lit(1).cast("long").alias("n")))
    total, up = here, step.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    up = cut_lineage(up)
    while not up.isEmpty():
        total = cut_lineage(total.unionByName(up).groupBy("id").agg(F.sum("n").alias("n")))
        up = cut_lineage(up.join(step.where("parent is not null"), "id").groupBy(F.col("parent").alias("id")).agg(F.sum("n").alias("n")))
    return total.select("id", F.col("n").alias("size"))


def static_matches(edges: DataFrame, pattern: list[tuple[int, int]]) -> DataFrame:
    """n0, n1, ...: the subgraphs that match a connected directed pattern with different nodes, each set of edges once."""
    e = edges.select("src", "dst").where("src != dst").distinct()
    found, bound, left = None, [], list(pattern)
    while left:
        u, v = left.pop(0) if found is None else left.pop(next(i for i, p in enumerate(left) if set(p) & set(bound)))
        step = e.select(F.col("src").alias(f"n{u}"), F.col("dst").alias(f"n{v}"))
        keys = [f"n{x}" for x in dict.fromkeys((u, v)) if x in bound]
        fresh = [x for x in (u, v) if x not in bound]
        found = step if found is None else found.join(step, keys)
        for x in fresh:
            for y in bound:
                found = found.where(F.col(f"n{x}") != F.col(f"n{y}"))
        bound += [x for x in fresh if x not in bound]
    names = [f"n{x}" for x in sorted(bound)]
    edge_set = F.array_sort(F.array(*[F.struct(F.col(f"n{u}").alias("a"), F.col(f"n{v}").alias("b")) for u, v in pattern]))
    return found.withColumn("_e", edge_set).groupBy("_e").agg(F.min(F.struct(*names)).alias("m")).select("m.*")


def matches_of_edges(edges: DataFrame, anchors: DataFrame, pattern: list[tuple[int, int]]) -> DataFrame:
    """The matches of a pattern that use one of the edges in anchors (src, dst)."""
    m = static_matches(edges, pattern)
    ends = F.explode(F.array(*[F.struct(F.col(f"n{u}").alias("src"), F.col(f"n{v}").alias("dst")) for u, v in pattern]))
    used = m.select("*", ends.alias("e")).select(*m.columns, "e.src", "e.dst")
    return used.join(anchors.select("src", "dst").distinct(), ["src", "dst"], "left_semi").select(*m.columns).distinct()


def paws_of_edges(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """src, dst, third, at, pendant: the triangles over the edges in anchors (src, dst) with one more edge, from the corner
    at to a node outside the triangle. Edges are undirected; an anchor may be given in either direction."""
    s = cut_lineage(symmetric(edges))
    a = anchors.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src != dst").distinct().join(s, ["src", "dst"], "left_semi")
    thirds = a.join(s.select("src", F.col("dst").alias("third")), "src").join(s.select("dst", F.col("src").alias("third")), ["dst", "third"], "left_semi")
    corners = thirds.select("src", "dst", "third", F.explode(F.array("src", "dst", "third")).alias("at"))
    ends = s.select(F.col("src").alias("at"), F.col("dst").alias("pendant"))
    return corners.join(ends, "at").where("pendant not in (src, dst, third)").select("src", "dst", "third", "at", "pendant")


def squares_estimate(edges: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """One row: squares, estimated from wedges sampled by a hash: a square has two wedges over each of its diagonals, and
    both of a pair are in the sample with the square of the share."""
    s = symmetric(edges)
    w = s.select(F.col("src").alias("b"), F.col("dst").alias("a")).join(s.select(F.col("src").alias("b"), F.col("dst").alias("c")), "b").where("a < c")
    drawn = w.where(F.pmod(F.xxhash64(F.lit(seed), "a", "b", "c"), F.lit(1 << 30)) < share * (1 << 30))
    return drawn.groupBy("a", "c").agg(F.count(F.lit(1)).alias("n")).agg((F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)) / 2 / (share * share)).alias("squares"))


def group_triads(edges: DataFrame, group: DataFrame) -> DataFrame:
    """inside and outside: triangles of group members (id) with two other members, and with none, summed over the members."""
    t = triangles(edges).select("a", "b", "c", F.explode(F.array("a", "b", "c")).alias("id")).join(group.select("id", F.lit(1).alias("m")).distinct(), "id", "left").na.fill(0, ["m"])
    per = t.groupBy("a", "b", "c").agg(F.sum("m").alias("m"))
    return per.agg(F.coalesce(F.sum(F.when(F.col("m") == 3, 3)), F.lit(0)).alias("inside"), F.coalesce(F.sum(F.when(F.col("m") == 1, 1)), F.lit(0)).alias("outside"))


def modularity(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """part, inside (edge ends), degree, modularity of each part of a partition (id, part)."""
    s = symmetric(edges)
    both = s.join(parts.select(F.col("id").alias("src"), F.col("part").alias("ps")), "src").join(parts.select(F.col("id").alias("dst"), F.col("part").alias("pd")), "dst")
    sums = both.groupBy(F.col("ps").alias("part")).agg(F.sum((F.col("ps") == F.col("pd")).cast("long")).alias("inside"), F.count(F.lit(1)).alias("degree"))
    m2 = s.agg(F.count(F.lit(1)).alias("m2"))
    return sums.crossJoin(F.broadcast(m2)).select("part", "inside", "degree", ((F.col("inside") - F.col("degree") * F.col("degree") / F.col("m2")) / F.col("m2")).alias("modularity"))


def core_periphery(edges: DataFrame) -> DataFrame:
    """id, rank, core: the prefix of the nodes by falling degree that misses least of an ideal core.

    For a prefix of s nodes: edges absent inside it plus edges among the others; both follow from running sums.
    """
    e = cut_lineage(canonical(edges))
    d = e.select(F.col("a").alias("id")).union(e.select("b")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    ranked = cut_lineage(numbered(d, [F.desc("d"), F.asc("id")], "rank").withColumn("rank", F.col("rank") + 1))
    pos = e.join(ranked.select(F.col("id").alias("a"), F.col("rank").alias("ra")), "a").join(ranked.select(F.col("id").alias("b"), F.col("rank").alias("rb")), "b")
    later = pos.groupBy(F.greatest("ra", "rb").alias("rank")).agg(F.count(F.lit(1)).alias("n"))
    upto = prefix(ranked.join(later, "rank", "left").na.fill(0, ["n"]), ["rank"], {"inside": F.col("n"), "ends": F.col("d")})
    m = e.agg(F.count(F.lit(1)).alias("m"))
    # Edges outside: all, less those with an end in the prefix.
    cost = F.col("rank") * (F.col("rank") - 1) / 2 - F.col("inside") + F.col("m") - F.col("ends") + F.col("inside")
    scored = cut_lineage(upto.crossJoin(F.broadcast(m)).withColumn("cost", cost))
    cut = scored.orderBy("cost", "rank").limit(1).select(F.col("rank").alias("cut"))
    return scored.crossJoin(F.broadcast(cut)).select("id", "rank", (F.col("rank") <= F.col("cut")).alias("core"))


def core_measures(edges: DataFrame, core: DataFrame) -> DataFrame:
    """One row on a set of core nodes (id): touched and inside, the undirected edges with an end in the core and with both, over
    the pairs of core nodes; quality, the share of core pairs that are edges and of the other nodes' pairs that are none.
    A share over no pairs is null."""
    e = canonical(edges)
    c = core.select("id", F.lit(1).alias("c")).distinct()
    flags = e.join(c.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a", "left").join(c.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b", "left").select((F.coalesce("ca", F.lit(0)) + F.coalesce("cb", F.lit(0))).alias("ends"))
    count = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0))
    sums = flags.agg(count(F.col("ends") > 0).alias("some"), count(F.col("ends") == 2).alias("both"), count(F.col("ends") == 0).alias("outer"))
    sizes = nodes_of(edges).join(c, "id", "left").agg(F.count("c").alias("k"), F.count(F.lit(1)).alias("n"))
    pairs = lambda x: F.nullif(x * (x - 1) / 2, F.lit(0.0))
    inner, outer = pairs(F.col("k")), pairs(F.col("n") - F.col("k"))
    return sums.crossJoin(F.broadcast(sizes)).select((F.col("some") / inner).alias("touched"), (F.col("both") / inner).alias("inside"), (F.col("both") / inner + (outer - F.col("outer")) / outer).alias("quality"))


def top_cascades(links: DataFrame) -> DataFrame:
    """root and the number of events it reaches (itself too), for events of links (a, b) that nothing leads to."""
    e = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    roots = e.select(F.col("src").alias("id")).distinct().join(e.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    return bfs(e, roots).groupBy(F.col("source").alias("root")).agg(F.count(F.lit(1)).alias("size"))


def event_importance(edges: DataFrame, damping: float = 0.5) -> DataFrame:
    """id, importance: out-degree and, damped, the out-degrees of the nodes that lead here."""
    d = degrees(edges.select("src", "dst").distinct()).select("id", "out_deg")
    back = edges.select("src", "dst").distinct().join(d.select(F.col("id").alias("src"), F.col("out_deg").alias("o")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("o").alias("s"))
    return d.join(back, "id", "left").select("id", (F.col("out_deg") + damping * F.coalesce("s", F.lit(0))).alias("importance"))


def community_overlap(before: DataFrame, after: DataFrame) -> DataFrame:
    """part_1, part_2, overlap: Jaccard similarity of the communities (id, part) of two snapshots."""
    size = lambda df, i: df.groupBy(F.col("part").alias(f"part_{i}")).agg(F.count(F.lit(1)).alias(f"n{i}"))
    common = before.select("id", F.col("part").alias("part_1")).join(after.select("id", F.col("part").alias("part_2")), "id").groupBy("part_1", "part_2").agg(F.count(F.lit(1)).alias("c"))
    return common.join(size(before, 1), "part_1").join(size(after, 2), "part_2").select("part_1", "part_2", (F.col("c") / (F.col("n1") + F.col("n2") - F.col("c"))).alias("overlap"))


def statistics(edges: DataFrame) -> DataFrame:
    """statistic, value: sizes, degrees, mutual pairs, triangles, clustering and components."""
    d = degrees(edges).agg(F.count(F.lit(1)).alias("nodes"), F.sum((F.col("in_deg") == 0).cast("long")).alias("no_in"), F.sum((F.col("out_deg") == 0).cast("long")).alias("no_out"), F.max("deg").alias("max_degree"), F.avg("deg").alias("mean_degree"))
    c = clustering(edges).agg(F.avg("cc").alias("clustering"))
    s = component_sizes(weak_components(edges)).agg(F.count(F.lit(1)).alias("components"), F.max("size").alias("largest_component"))
    row = d.crossJoin(edge_counts(edges)).crossJoin(triangle_count(edges)).crossJoin(c).crossJoin(s)
    return _tall(row)


def _tall(row: DataFrame) -> DataFrame:
    """statistic, value of a table with one row."""
    return row.select(F.explode(F.map_from_arrays(F.array(*[F.lit(x) for x in row.columns]), F.array(*[F.col(x).cast("double") for x in row.columns]))).alias("statistic", "value"))


def component_statistics(edges: DataFrame) -> DataFrame:
    """statistic, value: nodes with edges out and in, unique and mutual edges, of the whole graph and of its largest weak
    component (wcc_), nodes and edges of the largest strong one (scc_), their shares of all nodes, open and closed triads.
    Of components of the same size the one with the smallest label counts. Edges are directed, distinct and without loops."""
    e = cut_lineage(edges.select("src", "dst").where("src != dst").distinct())
    n = nodes_of(e).agg(F.count(F.lit(1)).alias("n"))

    def basic(part: DataFrame, prefix: str) -> DataFrame:
        d = degrees(part).agg(F.count(F.lit(1)).alias("nodes"), F.sum((F.col("out_deg") > 0).cast("long")).alias("src_nodes"), F.sum((F.col("in_deg") > 0).cast("long")).alias("dst_nodes"))
        counts = edge_counts(part).select(F.col("directed").alias("edges"), F.col("undirected").alias("unique_edges"), F.col("mutual").alias("mutual_edges"))
        both = d.crossJoin(counts)
        return both.select(*[F.coalesce(F.col(c), F.lit(0)).alias(prefix + c) for c in both.columns])

    def largest(labels: DataFrame) -> DataFrame:
        top = component_sizes(labels).orderBy(F.desc("size"), "root").limit(1)
        return cut_lineage(induced(e, labels.join(F.broadcast(top.select("root")), "root", "left_semi").select("id")))

    wcc, strong = basic(largest(weak_components(e)), "wcc_"), strong_components(e)
    # A strong component of one node has no edges, so its size comes from the labels.
    size = component_sizes(strong).agg(F.coalesce(F.max("size"), F.lit(0)).alias("scc_nodes"))
    scc = largest(strong).agg(F.count(F.lit(1)).alias("scc_edges"))
    d = symmetric(e).groupBy("src").agg(F.count(F.lit(1)).alias("d")).agg(F.coalesce(F.sum(F.col("d") * (F.col("d") - 1) / 2), F.lit(0.0)).alias("wedges"))
    triads = d.crossJoin(triangle_count(e).select(F.col("triangles").alias("closed_triads"))).select("closed_triads", (F.col("wedges") - 3 * F.col("closed_triads")).alias("open_triads"))
    row = basic(e, "").crossJoin(wcc).crossJoin(size).crossJoin(scc).crossJoin(triads).crossJoin(n)
    shares = [(F.col(f"{x}_nodes") / F.nullif(F.col("n"), F.lit(0))).alias(f"{x}_share") for x in ("wcc", "scc")]
    return _tall(row.select("*", *shares).drop("n"))
