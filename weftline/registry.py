"""The queries over the driver's tables and the SQL they are compared with. Doubles are rounded alike on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import columns as C
from weftline.functions.times import micros
from weftline.operators import buckets as B
from weftline.operators import graph as G
from weftline.operators import relational as R
from weftline.operators import small_graphs as S
from weftline.plans import densest as D
from weftline.plans import motifs as M
from weftline.sources.edges import dense_ids, event_graph, order_graph, temporal_lines

DAY = 86400
DECAY = 1e-4
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        _queries[key] = f
        if sql:
            _sql[key] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


#: The event graph in SQL: tables e and g, and u, its distinct symmetric edges.
_G = """with recursive e as materialized (select user_id as src, lead(user_id) over (order by ts, event_id) as dst, epoch_us(ts) // 1000000 as t,
        row_number() over (order by ts, event_id) - 1 as eid from events),
    g as materialized (select eid, src, dst, t from e where dst is not null and src <> dst),
    u as materialized (select src, dst from g union select dst, src from g)"""


# Motifs


def _motif_sql(m: str, delta: int, select: str, more: str = "") -> str:
    motif = M.MOTIFS[m]
    tables, where, at = [], [], {}
    for i, (u, v) in enumerate(motif.edges, 1):
        tables.append(f"g g{i}")
        for node, end in ((u, "src"), (v, "dst")):
            if node in at:
                where.append(f"g{i}.{end} = {at[node]}")
            else:
                where += [f"g{i}.{end} <> {x}" for x in at.values()]
                at[node] = f"g{i}.{end}"
        if i > 1:
            where.append(f"g{i}.t > g{i - 1}.t and g{i}.t <= g1.t + {delta}")
    n = len(motif.edges)
    decay = " + ".join(f"exp(-{DECAY} * (g{i + 1}.t - g{i}.t))" for i in range(1, n))
    cols = ", ".join([f"g{i}.eid as e{i}" for i in range(1, n + 1)] + [f"{at[i]} as n{i}" for i in range(motif.k)] + [f"g{i}.t as t{i}" for i in range(1, n + 1)])
    return f"{_G}, m as materialized (select {cols}, ({decay}) / {n - 1} as w from {', '.join(tables)} where {' and '.join(where)}){more} {select}"


for _m, _delta in (("m1", DAY), ("m2", DAY), ("m3", DAY), ("m4", DAY), ("m5", DAY), ("m6", DAY), ("m7", DAY), ("m8", DAY), ("m9", DAY), ("m10", DAY)):

    @_query(_motif_sql(_m, _delta, "select count(*)::bigint as instances from m"), f"motif_{_m}_count")
    def _count(spark, sf_dir, m=_m, delta=_delta):
        return M.instances(event_graph(spark, sf_dir), M.MOTIFS[m], delta).agg(F.count(F.lit(1)).alias("instances"))


@_query(_motif_sql("m3", DAY, "select e1, e2, e3, n0, n1, n2 from m"))
def motif_m3_instances(spark, sf_dir):
    return M.instances(event_graph(spark, sf_dir), M.MOTIFS["m3"], DAY).select("e1", "e2", "e3", "n0", "n1", "n2")


@_query(_motif_sql("m3", DAY, "select e1, e2, e3, n0, n1, n2 from m"))
def motif_m3_instances_slabs(spark, sf_dir):
    return M.instances(event_graph(spark, sf_dir), M.MOTIFS["m3"], DAY, strategy="slab").select("e1", "e2", "e3", "n0", "n1", "n2")


def _hyper(spark, sf_dir, m="m3", decay=None):
    return M.hyperedges(M.instances(event_graph(spark, sf_dir), M.MOTIFS[m], DAY), M.MOTIFS[m], decay)


_H = ", h as materialized (select list_sort([n0, n1, n2]) as nodes, count(*) as c, sum(w) as w from m group by 1)"


@_query(_motif_sql("m3", DAY, "select nodes[1] as a, nodes[2] as b, nodes[3] as c, c as cnt from h", _H))
def motif_m3_hyperedges(spark, sf_dir):
    return _hyper(spark, sf_dir).select(F.col("nodes")[0].alias("a"), F.col("nodes")[1].alias("b"), F.col("nodes")[2].alias("c"), "cnt")


@_query(_motif_sql("m3", DAY, "select node, sum(c)::bigint as cnt from (select unnest(nodes) as node, c from h) group by 1", _H))
def motif_m3_node_degree(spark, sf_dir):
    return M.node_degrees(_hyper(spark, sf_dir)).select("node", "cnt")


@_query(_motif_sql("m3", DAY, "select node, round(sum(w), 6) as w from (select unnest(nodes) as node, w from h) group by 1", _H))
def motif_m3_decay_weight(spark, sf_dir):
    return M.node_degrees(_hyper(spark, sf_dir, decay=DECAY)).select("node", r6("w").alias("w"))


@_query(_motif_sql("m3", DAY, "select count(*)::bigint as instances, round(count(*) / 20.0, 6) as density from m where n0 < 20 and n1 < 20 and n2 < 20"))
def motif_induced_eval(spark, sf_dir):
    nodes = spark.range(20).select(F.col("id").alias("node"))
    return M.evaluate(event_graph(spark, sf_dir), nodes, M.MOTIFS["m3"], DAY).select("instances", r6("density").alias("density"))


def _batch_sql(k: int, xi: float, rounds: int) -> str:
    """Rounds of batch peeling unrolled; those after the last have no nodes."""
    text = f"{_H}, h1 as materialized (select nodes, c::double as w from h)"
    for i in range(1, rounds + 1):
        alive = f"select distinct unnest(nodes) as node from h{i}" if i == 1 else f"select node from d{i - 1}, s{i - 1} where c > {k * (1 + xi)} * tau / n and n > {k}"
        text += f", a{i} as materialized ({alive})"
        if i > 1:
            text += f", h{i} as materialized (select nodes, w from h{i - 1} where list_has_all((select list(node) from a{i}), nodes))"
        text += f", d{i} as materialized (select node, sum(w) as c from (select unnest(nodes) as node, w from h{i}) group by 1), s{i} as materialized (select coalesce((select sum(w) from h{i}), 0) as tau, (select count(*) from a{i}) as n)"
    best = " union all ".join(f"select {i} as i, tau / n as rho from s{i} where n >= {k}" for i in range(1, rounds + 1))
    nodes = " union all ".join(f"select {i} as i, node from a{i}" for i in range(1, rounds + 1))
    return _motif_sql("m3", DAY, "select 'batch' as algorithm, node, round(rho, 6) as density from top join x using (i)", f"{text}, top as (select i, rho from ({best}) order by rho desc, i limit 1), x as ({nodes})")


for _a in ("greedy", "batch", "exact", "hybrid", "probpeel"):

    @_query(_batch_sql(3, 0.01, 14) if _a == "batch" else None, name=f"tmds_{_a}")
    def _tmds(spark, sf_dir, a=_a):
        return D.densest(event_graph(spark, sf_dir), M.MOTIFS["m3"], DAY, a).withColumn("density", r6("density"))


@_query()
def motif_sampling_spread(spark, sf_dir):
    return D.estimate_spread(event_graph(spark, sf_dir), M.MOTIFS["m3"], DAY, 3)


@_query()
def motif_xi_sweep(spark, sf_dir):
    return D.sweep(spark, event_graph(spark, sf_dir), M.MOTIFS["m3"], DAY, [100], [0.01, 0.1])


@_query(f"{_G}, o as (select src as node, dst as other, 1 as o from g union all select dst, src, 0 from g), p as (select node, other, sum(o) as o, sum(1 - o) as i from o group by all) select node, sum(o)::bigint as t_out, sum(i)::bigint as t_in, sum((o > 0)::int)::bigint as s_out, sum((i > 0)::int)::bigint as s_in, count(*) as s_any from p group by node")
def temporal_degrees(spark, sf_dir):
    return M.degree_profile(event_graph(spark, sf_dir))


@_query(f"{_G} select src, dst, count(*) as n, min(t) as first_t, max(t) as last_t from g group by all")
def static_projection(spark, sf_dir):
    return M.projection(event_graph(spark, sf_dir)).select("src", "dst", F.size("times").cast("long").alias("n"), F.col("times")[0].alias("first_t"), F.element_at("times", -1).alias("last_t"))


# Tables


@_query("select o_orderkey from orders where (o_totalprice > 100000 and not (o_orderstatus = 'F')) or o_orderpriority = '1-URGENT'")
def filter_tree(spark, sf_dir):
    tree = ("or", ("and", ("o_totalprice", ">", 100000), ("not", ("o_orderstatus", "=", "F"))), ("o_orderpriority", "=", "1-URGENT"))
    return R.select(_t(spark, sf_dir, "orders"), tree).select("o_orderkey")


@_query("select p_partkey from part where contains(p_name, '1')")
def filter_substr(spark, sf_dir):
    return R.select(_t(spark, sf_dir, "part"), ("p_name", "substr", "1")).select("p_partkey")


@_query("select s_suppkey, n_nationkey from supplier, nation where s_nationkey = n_nationkey and s_nationkey <= n_regionkey * 5")
def filter_columns(spark, sf_dir):
    both = R.join(_t(spark, sf_dir, "supplier"), _t(spark, sf_dir, "nation"), "s_nationkey", "n_nationkey")
    return R.select(both, (F.col("s_nationkey"), "<=", F.col("n_regionkey") * 5)).select("s_suppkey", "n_nationkey")


@_query("select c_custkey, case when c_acctbal < 0 then 1 else 0 end as label from customer")
def classify_label(spark, sf_dir):
    return R.classify(_t(spark, sf_dir, "customer"), ("c_acctbal", "<", 0), "label").select("c_custkey", "label")


@_query("select c_custkey as id, c_name as name from customer")
def project_rename(spark, sf_dir):
    return R.rename(R.project(_t(spark, sf_dir, "customer"), "c_custkey", "c_name"), c_custkey="id", c_name="name")


@_query("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
def join_inner(spark, sf_dir):
    return R.join(_t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer"), "o_custkey", "c_custkey").select("o_orderkey", "c_name")


@_query("select a.n_nationkey as n_nationkey_1, b.n_nationkey as n_nationkey_2 from nation a join nation b on a.n_regionkey = b.n_regionkey")
def join_self(spark, sf_dir):
    return R.self_join(_t(spark, sf_dir, "nation"), "n_regionkey").select("n_nationkey_1", "n_nationkey_2")


_LINES = "select o_custkey, l_suppkey, l_partkey from lineitem join orders on l_orderkey = o_orderkey"


def _lines(spark, sf_dir):
    return R.join(_t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "orders"), "l_orderkey", "o_orderkey").select("o_custkey", "l_suppkey", "l_partkey")


@_query(f"with l as ({_LINES}), x as materialized (select * from l) select a.o_custkey as key1, b.o_custkey as key2, count(*) as matches from x a join x b on a.l_suppkey = b.l_suppkey group by all having count(*) >= 60")
def join_threshold(spark, sf_dir):
    x = _lines(spark, sf_dir)
    return R.threshold_join(x, "o_custkey", "l_suppkey", x, "o_custkey", "l_suppkey", 60)


@_query(f"with l as ({_LINES}), x as materialized (select * from l) select a.o_custkey as key1, b.o_custkey as key2, a.l_suppkey as value, count(*) as matches from x a join x b on a.l_suppkey = b.l_suppkey group by all having count(*) >= 12")
def join_threshold_per_key(spark, sf_dir):
    x = _lines(spark, sf_dir)
    return R.threshold_join(x, "o_custkey", "l_suppkey", x, "o_custkey", "l_suppkey", 12, per_value=True)


@_query("select a.s_suppkey as a, b.c_custkey as b from supplier a join customer b on sqrt((a.s_acctbal - b.c_acctbal) ** 2 + (a.s_nationkey - b.c_nationkey) ** 2) <= 25.0")
def join_sim_l2(spark, sf_dir):
    return R.sim_join_l2(_t(spark, sf_dir, "supplier"), _t(spark, sf_dir, "customer"), ["s_acctbal", "s_nationkey"], ["c_acctbal", "c_nationkey"], 25.0).select(F.col("s_suppkey").alias("a"), F.col("c_custkey").alias("b"))


_PLACES = "select c_custkey as {0}, (c_custkey % 120)::double - 60 as lat{1}, (c_custkey * 7 % 360)::double - 180 as lon{1} from customer"


@_query(f"with a as ({_PLACES.format('a', 1)}), b as ({_PLACES.format('b', 2)}) select a, b from a, b where 2 * 6373.0 * atan2(sqrt(sin(radians(lat2 - lat1) / 2) ** 2 + cos(radians(lat1)) * cos(radians(lat2)) * sin(radians(lon2 - lon1) / 2) ** 2), sqrt(greatest(1 - (sin(radians(lat2 - lat1) / 2) ** 2 + cos(radians(lat1)) * cos(radians(lat2)) * sin(radians(lon2 - lon1) / 2) ** 2), 0))) <= 150.5")
def join_haversine(spark, sf_dir):
    place = lambda i: _t(spark, sf_dir, "customer").selectExpr(f"c_custkey as {'ab'[i - 1]}", f"cast(c_custkey % 120 as double) - 60 as lat{i}", f"cast(c_custkey * 7 % 360 as double) - 180 as lon{i}")
    return R.sim_join_haversine(place(1), place(2), "lat1", "lon1", "lat2", "lon2", 150.5).select("a", "b")


@_query("with s as (select distinct c_nationkey as g, c_mktsegment || (c_custkey % 10) as v from customer), n as (select g, count(*) as n from s group by g), c as (select a.g as g1, b.g as g2, count(*) as c from s a join s b on a.v = b.v group by all) select g1 as g_1, g2 as g_2, round(1 - c / (x.n + y.n - c), 6) as distance from c join n x on g1 = x.g join n y on g2 = y.g where 1 - c / (x.n + y.n - c) <= 0.9")
def join_jaccard_group(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("g"), F.concat("c_mktsegment", (F.col("c_custkey") % 10).cast("string")).alias("v"))
    return R.jaccard_groups(rows, ["g"], "v", 0.9).withColumn("distance", r6("distance"))


@_query("with r as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as n from events) select a.user_id, a.event_id as event_id_1, b.event_id as event_id_2, (b.n - a.n)::int as step from r a join r b on a.user_id = b.user_id and b.n - a.n between 1 and 2")
def join_next_k(spark, sf_dir):
    return R.next_k(_t(spark, sf_dir, "events"), ["ts", "event_id"], 2, ["user_id"], ["event_id"])


_EVENTS = "with c as (select event_id as id, user_id as source, lead(user_id) over (order by ts, event_id) as dest, epoch_us(ts) // 1000000 as start, 60 as duration from events), k as materialized (select * from c where dest is not null)"


def _cascade(spark, sf_dir):
    e = event_graph(spark, sf_dir)
    ids = R.rank(_t(spark, sf_dir, "events"), ["ts"], "event_id", "eid", coarse=F.to_date("ts")).select("eid", F.col("event_id").alias("id"))
    return e.join(ids, "eid").select("id", F.col("src").alias("source"), F.col("dst").alias("dest"), F.col("t").alias("start"), F.lit(60).alias("duration"))


@_query(f"{_EVENTS} select a.id as a, b.id as b from k a join k b on a.dest = b.source and a.source <> a.dest and b.source <> b.dest and b.start between a.start + 60 and a.start + 60 + 3600 and a.id <> b.id")
def join_interval_cascade(spark, sf_dir):
    return R.interval_join(_cascade(spark, sf_dir), 3600)


@_query("select p_partkey, coalesce(v, -1.0) as value from part left join (select l_partkey, max(l_quantity) as v from lineitem where l_discount > 0.09 group by 1) on p_partkey = l_partkey")
def update_from_table(spark, sf_dir):
    part = _t(spark, sf_dir, "part").select("p_partkey", F.lit(0.0).alias("value"))
    return R.update_from(part, "p_partkey", "value", _t(spark, sf_dir, "lineitem").where("l_discount > 0.09"), "l_partkey", "l_quantity", -1.0)


_AGGREGATES = {
    "min": ("o_totalprice", "min(o_totalprice) over w"),
    "max": ("o_totalprice", "max(o_totalprice) over w"),
    "sum": ("o_orderkey", "(sum(o_orderkey) over w)::bigint"),
    "mean": ("o_orderkey", "((sum(o_orderkey) over w) // (count(*) over w))::bigint"),
    "median": ("o_orderkey", "list_sort(list(o_orderkey) over w)[(count(*) over w) // 2 + 1]"),
    "first": ("o_totalprice", "arg_min(o_totalprice, o_orderkey) over w"),
    "last": ("o_totalprice", "arg_max(o_totalprice, o_orderkey) over w"),
    "count": (None, "count(*) over w"),
}
for _op, (_column, _expression) in _AGGREGATES.items():

    @_query(f"select o_orderkey, {_expression} as result from orders window w as (partition by o_custkey)", f"agg_keep_rows_{_op}")
    def _agg(spark, sf_dir, op=_op, column=_column):
        orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
        return R.aggregate(orders, ["o_custkey"], op, column, "result", "o_orderkey").select("o_orderkey", "result")


@_query("select l_returnflag, count(*) as n from lineitem group by 1")
def agg_collapse(spark, sf_dir):
    return R.aggregate(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], "count", None, "n", collapse=True)


@_query("select l_orderkey, l_linenumber, round((l_quantity + l_discount + l_tax) / 3, 6) as result from lineitem")
def agg_cols(spark, sf_dir):
    return R.aggregate_columns(_t(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "mean", "result").select("l_orderkey", "l_linenumber", r6("result").alias("result"))


@_query("select c_custkey, dense_rank() over (order by c_nationkey, c_mktsegment) - 1 as grp from customer")
def group_id(spark, sf_dir):
    return R.group_ids(_t(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], "grp").select("c_custkey", "grp")


@_query("select min(o_orderkey) as o_orderkey from orders group by o_custkey, o_orderstatus")
def unique_first(spark, sf_dir):
    return R.unique(_t(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], "o_orderkey").select("o_orderkey")


@_query("with n as (select l_linenumber as value, count(*) as n from lineitem group by 1) select value, n, round(n / sum(n) over (), 6) as pdf, round(sum(n) over (order by value) / sum(n) over (), 6) as cdf, round(sum(n) over (order by value desc) / sum(n) over (), 6) as ccdf from n")
def value_distribution(spark, sf_dir):
    d = R.distribution(_t(spark, sf_dir, "lineitem"), "l_linenumber")
    return d.select("value", "n", *[r6(c).alias(c) for c in ("pdf", "cdf", "ccdf")])


@_query("select count(l_quantity) as n, round(avg(l_quantity), 6) as mean, round(var_pop(l_quantity), 6) as variance, min(l_quantity) as least, quantile_cont(l_quantity, 0.5) as median, max(l_quantity) as most from lineitem")
def value_moments(spark, sf_dir):
    return R.moments(_t(spark, sf_dir, "lineitem"), "l_quantity").select("n", r6("mean").alias("mean"), r6("variance").alias("variance"), "least", "median", "most")


@_query("select round(corr(l_quantity, l_extendedprice), 6) as r, round(regr_slope(l_extendedprice, l_quantity), 4) as slope from lineitem")
def value_correlation(spark, sf_dir):
    return R.correlation(_t(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").select(r6("r").alias("r"), F.round("slope", 4).alias("slope"))


@_query("with n as (select o_orderpriority, count(*) as n from orders group by 1) select round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) as bits from n")
def value_entropy(spark, sf_dir):
    return R.entropy(_t(spark, sf_dir, "orders"), "o_orderpriority").select(r6("bits").alias("bits"))


@_query("select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) - 1 as rank from orders")
def order_rank(spark, sf_dir):
    coarse = F.floor(F.col("o_totalprice") / 1000)
    return R.rank(_t(spark, sf_dir, "orders"), ["o_totalprice"], "o_orderkey", ascending=False, coarse=coarse).select("o_orderkey", "rank")


@_query("select o_orderkey, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) - 1 as rank from orders")
def order_rank_reset(spark, sf_dir):
    return R.rank(_t(spark, sf_dir, "orders"), ["o_custkey", "o_totalprice"], "o_orderkey", reset=True).select("o_orderkey", "rank")


@_query("select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 10")
def first_n(spark, sf_dir):
    return _t(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey")


@_query("select o_orderkey from (select o_orderkey, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as r from orders) where r <= 3")
def top_k(spark, sf_dir):
    return R.top_k(_t(spark, sf_dir, "orders"), ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_orderkey")


def _keys(spark, sf_dir):
    return _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), _t(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k"))


_K = "with a as (select s_nationkey as k from supplier), b as (select c_nationkey as k from customer where c_acctbal > 5000)"
for _name, _select, _set in (
    ("union_all", "select k from a union all select k from b", R.union_all),
    ("union_set", "select k from a union select k from b", R.union),
    ("intersect_bag", "select k from b where k in (select k from a)", R.intersection),
    ("minus_bag", "select k from a where k not in (select k from b)", R.minus),
):

    @_query(f"{_K} {_select}", _name)
    def _sets(spark, sf_dir, f=_set):
        return f(*_keys(spark, sf_dir))


@_query("select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) as revenue, l_orderkey // l_linenumber as quotient, l_orderkey % 7 as rest, greatest(l_partkey, l_suppkey) as larger from lineitem")
def col_arith(spark, sf_dir):
    df = _t(spark, sf_dir, "lineitem").withColumn("kept", 1 - F.col("l_discount"))
    df = C.arithmetic(df, "l_extendedprice", "mul", "kept", "revenue")
    df = C.arithmetic(C.arithmetic(df, "l_orderkey", "div", "l_linenumber", "quotient"), "l_orderkey", "mod", 7, "rest")
    return C.arithmetic(df, "l_partkey", "max", "l_suppkey", "larger").select("l_orderkey", "l_linenumber", r6("revenue").alias("revenue"), "quotient", "rest", "larger")


@_query("select c_custkey, c_name || '/' || c_mktsegment as label from customer")
def col_concat(spark, sf_dir):
    return C.concat(_t(spark, sf_dir, "customer"), "c_name", "c_mktsegment", "/", "label").select("c_custkey", "label")


@_query("with a as (select s_suppkey, row_number() over (order by s_suppkey) as r from supplier), b as (select c_acctbal, row_number() over (order by c_custkey) as r from customer) select s_suppkey, c_acctbal from a join b using (r)")
def col_other_table(spark, sf_dir):
    return C.with_rows_of(_t(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", _t(spark, sf_dir, "customer"), "c_custkey", ["c_acctbal"])


@_query("select doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))::int as n from documents")
def text_word_count(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(C.words(F.col("text"))).alias("n"))


@_query("select page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) as digest from pages")
def strip_html(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.md5(C.strip_html(F.col("html"))).alias("digest"))


@_query("select page_id, regexp_replace(regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]+)', 1), '^www\\.', '') as site from pages")
def url_website(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", C.website(F.col("url")).alias("site"))


@_query("select event_id, year(ts)::int as y, month(ts)::int as m, day(ts)::int as d, hour(ts)::int as h, (dayofweek(ts) + 1)::int as w from events")
def time_parts(spark, sf_dir):
    p = C.time_parts(F.col("ts"))
    return _t(spark, sf_dir, "events").select("event_id", p["year"].alias("y"), p["month"].alias("m"), p["day"].alias("d"), p["hour"].alias("h"), p["weekday"].alias("w"))


# Buckets

_SPAN = "with t as (select event_id, epoch_us(ts) // 1000000 as t from events), z as (select min(t) as z from t)"


def _times(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    t = events.select("event_id", F.floor(micros(events, "ts") / 1_000_000).cast("long").alias("t"))
    lo, hi = t.agg(F.min("t"), F.max("t")).first()
    return t, lo, hi


@_query(f"{_SPAN} select event_id, (t - z) // 3600 as bucket from t, z")
def bucket_tumbling(spark, sf_dir):
    t, lo, hi = _times(spark, sf_dir)
    return B.tumbling(t, "t", lo, hi, 3600).select("event_id", "bucket")


@_query(f"{_SPAN}, r as (select event_id, t - z as x from t, z) select event_id, unnest(generate_series(greatest((x - 7200 + 90000) // 1800 - 50 + 1, 0), x // 1800)) as bucket from r")
def bucket_sliding(spark, sf_dir):
    t, lo, hi = _times(spark, sf_dir)
    return B.sliding(t, "t", lo, hi, 7200, 1800).select("event_id", "bucket")


@_query(f"{_SPAN}, r as (select t - z as x, (select max(t) - min(t) from t) as h from t, z) select b as bucket, count(*) as n from r, generate_series(0, 2000) s(b) where b >= x // 604800 and b <= h // 604800 group by 1")
def bucket_expanding(spark, sf_dir):
    t, lo, hi = _times(spark, sf_dir)
    return B.expanding(t, "t", lo, hi, 604800).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@_query(f"{_SPAN}, r as (select event_id, t - z as x from t, z) select event_id, 0 as bucket from r where x >= 0 and x < 86400 union all select event_id, 1 from r where x >= 43200 and x < 172800")
def bucket_intervals(spark, sf_dir):
    t, lo, _ = _times(spark, sf_dir)
    return B.intervals(t, "t", [(lo, lo + 86400), (lo + 43200, lo + 172800)]).select("event_id", "bucket")


@_query(f"{_G} select t // 3600 * 3600 as bucket, count(*) as n from g group by 1")
def edge_buckets_hour(spark, sf_dir):
    return event_graph(spark, sf_dir).groupBy(B.unit_start(F.col("t"), "1h").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@_query(f"{_G} select (t + 345600) // 604800 * 604800 - 345600 as bucket, count(*) as n from g group by 1")
def edge_buckets_week(spark, sf_dir):
    return event_graph(spark, sf_dir).groupBy(B.unit_start(F.col("t"), "week").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@_query(f"{_G} select src, dst, min(t) as t from g group by all")
def first_edge_net(spark, sf_dir):
    return B.first_edges(event_graph(spark, sf_dir))


@_query(f"{_G} select node, min(t) as t from (select src as node, t from g union all select dst, t from g) group by 1")
def node_first_times(spark, sf_dir):
    return B.node_times(event_graph(spark, sf_dir))


@_query(f"{_G}, f as (select src, dst, min(t) as t from g group by all), n as (select node, min(t) as t from (select src as node, t from g union all select dst, t from g) group by 1), a as (select t // 86400 * 86400 as bucket, count(*) as x from f group by 1), b as (select t // 86400 * 86400 as bucket, count(*) as y from n group by 1), c as (select coalesce(a.bucket, b.bucket) as bucket, coalesce(x, 0) as x, coalesce(y, 0) as y from a full join b on a.bucket = b.bucket) select bucket, sum(x) over (order by bucket)::bigint as edges, sum(y) over (order by bucket)::bigint as nodes from c")
def snapshot_growth(spark, sf_dir):
    return B.growth(event_graph(spark, sf_dir)).select("bucket", "edges", "nodes")


@_query(f"{_G}, f as materialized (select least(src, dst) as a, greatest(src, dst) as b, min(t) as t from g group by 1, 2), s as materialized (select a as x, b as y, t from f union all select b, a, t from f) select f.a, f.b, f.t from f where exists (select 1 from s p, s q where p.x = q.x and p.y = f.a and q.y = f.b and p.t < f.t and q.t < f.t)")
def triad_closing_edges(spark, sf_dir):
    return B.closing_edges(event_graph(spark, sf_dir))


@_query(f"{_G} select src || ' ' || dst || ' ' || (t - (select min(t) from g)) as value from g")
def temporal_edge_lines(spark, sf_dir):
    return temporal_lines(event_graph(spark, sf_dir), relative=True)


@_query("select c_name as name, row_number() over (order by c_name) - 1 as id from customer group by 1")
def dense_node_ids(spark, sf_dir):
    return dense_ids(_t(spark, sf_dir, "customer").select(F.col("c_name").alias("name")), "name").select("name", "id")


# Graphs


def _graph(spark, sf_dir):
    return event_graph(spark, sf_dir).select("src", "dst")


def _pairs(spark, sf_dir):
    """Every distinct pair of the event graph."""
    return _graph(spark, sf_dir).distinct()


def _on_pairs(sql: str):
    """Adds f(edges) over every pair of the event graph as a query."""

    def add(f):
        _query(sql, f.__name__)(lambda spark, sf_dir: f(_pairs(spark, sf_dir)))
        return f

    return add


#: The distinct pairs and, symmetric, q.
_PAIRS = f"{_G}, p as materialized (select distinct src, dst from g), q as materialized (select src, dst from u)"


@_query(f"{_G}, d as (select id, count(*) as deg from (select src as id from g union all select dst from g) group by 1) select deg as degree, count(*) as n from d group by 1")
def deg_distribution(spark, sf_dir):
    return G.degree_distribution(_graph(spark, sf_dir))


@_query(f"{_G} select id, sum(o)::bigint as out_deg, sum(1 - o)::bigint as in_deg from (select src as id, 1 as o from g union all select dst, 0 from g) group by 1")
def node_degrees(spark, sf_dir):
    return G.degrees(_graph(spark, sf_dir)).select("id", "out_deg", "in_deg")


@_query(f"{_G} select id, count(*) as deg from (select src as id from g union all select dst from g) group by 1 order by deg desc, id limit 1")
def max_degree_node(spark, sf_dir):
    return G.max_degree_node(_graph(spark, sf_dir))


@_query(f"{_G}, d as (select distinct src, dst from g) select (select count(*) from d) as directed, (select count(*) // 2 from u) as undirected, (select count(*) // 2 from d join d x on d.src = x.dst and d.dst = x.src) as mutual, 0::bigint as self_edges")
def uniq_edges(spark, sf_dir):
    return G.edge_counts(_graph(spark, sf_dir)).select(*[F.col(c).cast("long").alias(c) for c in ("directed", "undirected", "mutual", "self_edges")])


@_query(f"{_G}, n as (select count(distinct src) as n from u) select src as id, round(count(*) / (select n - 1 from n), 6) as centrality from u group by 1")
def degree_centrality(spark, sf_dir):
    return G.degree_centrality(_graph(spark, sf_dir)).select("id", r6("centrality").alias("centrality"))


@_on_pairs(f"{_PAIRS}, n as (select 1::bigint as id union select dst from p where src = 1 union select src from p where dst = 1) select src, dst from p where src in (select id from n) and dst in (select id from n)")
def egonet(e):
    return G.egonet(e, 1)[0]


@_on_pairs(f"{_PAIRS} select src, dst from p where src % 2 = 0 and dst % 2 = 0")
def subgraph(e):
    return G.induced(e, G.nodes_of(e).where("id % 2 = 0"))


@_on_pairs(f"{_PAIRS}, m as (select count(*) as m2 from q), s as (select src % 3 as part, sum((src % 3 = dst % 3)::int)::bigint as inside, count(*) as degree from q group by 1) select part, inside, degree, round((inside - degree * degree / m2) / m2, 6) as modularity from s, m")
def modularity_of_partition(e):
    parts = G.nodes_of(e).withColumn("part", F.col("id") % 3)
    return G.modularity(e, parts).withColumn("modularity", r6("modularity"))


@_on_pairs(f"{_PAIRS} select count(*) as triangles from q a join q b on a.dst = b.src join q c on b.dst = c.src and c.dst = a.src where a.src < a.dst and a.dst < b.dst")
def triangle_count(e):
    return G.triangle_count(e)


_TRIADS = f"{_PAIRS}, w as (select a.src as id, exists (select 1 from q c where c.src = a.dst and c.dst = b.dst) as closed from q a join q b on a.src = b.src and a.dst < b.dst), t as (select n.id, coalesce(sum(closed::int), 0)::bigint as closed, coalesce(sum(1 - closed::int), 0)::bigint as open from (select distinct src as id from q) n left join w on n.id = w.id group by 1)"


@_on_pairs(f"{_TRIADS} select id, closed, open from t")
def node_triads(e):
    return G.node_triads(e).select("id", F.col("closed").cast("long").alias("closed"), "open")


@_on_pairs(f"{_TRIADS} select id, round(case when closed + open > 0 then closed / (closed + open) else 0 end, 6) as cc from t")
def clustering_coeff(e):
    return G.clustering(e).select("id", r6("cc").alias("cc"))


@_on_pairs(f"{_PAIRS} select a.dst as a, b.dst as b, count(*) as common from q a join q b on a.src = b.src and a.dst < b.dst group by 1, 2")
def common_neighbors(e):
    return G.common_neighbors(e)


@_on_pairs(f"{_PAIRS}, d as (select src, count(*) as d from q group by 1), s as (select q.src, dst, 1 / d as p from q join d on q.src = d.src), i as (select a.src, b.dst, sum(a.p * b.p) as i from s a join s b on a.dst = b.src where a.src <> b.dst group by all) select s.src as id, round(sum((p + coalesce(i, 0)) ** 2), 6) as constr from s left join i on s.src = i.src and s.dst = i.dst group by 1")
def network_constraint(e):
    return G.network_constraint(e).select("id", r6("constraint").alias("constr"))


@_on_pairs(f"{_PAIRS}, w as (select a.src as b, a.dst as a, c.dst as c from q a join q c on a.src = c.src where a.dst < c.dst and a.dst < a.src) select count(*) as squares from w x join w y on x.a = y.a and x.c = y.c where x.b < y.b")
def squares(e):
    return G.squares(e).agg(F.count(F.lit(1)).alias("squares"))


@_on_pairs(f"{_PAIRS} select x.src as a, x.dst as b, y.dst as c from p x join p y on x.dst = y.src join p z on y.dst = z.src and z.dst = x.src where x.src < x.dst and x.src < y.dst")
def directed_triangles(e):
    return G.directed_triangles(e)


_ORDERS = "with g as materialized (select distinct o_custkey as src, l_suppkey as dst from lineitem join orders on l_orderkey = o_orderkey)"


@_query(f"{_ORDERS}, n as (select src, count(*) as n from g group by 1), c as (select a.src as a, b.src as b, count(*) as c from g a join g b on a.dst = b.dst and a.src <> b.src group by 1, 2), s as (select a, b, c / (x.n + y.n - c) as s from c join n x on a = x.src join n y on b = y.src) select a, b, round(s, 6) as similarity from s qualify row_number() over (partition by a order by s desc, b) <= 3")
def knn_jaccard(spark, sf_dir):
    return G.knn_jaccard(order_graph(spark, sf_dir).select("src", "dst"), 3).select("a", "b", r6("similarity").alias("similarity"))


_BFS = f"{_PAIRS}, b as (select 1::bigint as id, 0 as dist union select p.dst, dist + 1 from b join p on b.id = p.src where dist < 40)"


@_query(f"{_BFS} select id, min(dist) as dist from b group by 1")
def bfs_distance(spark, sf_dir):
    return G.bfs(_pairs(spark, sf_dir), spark.createDataFrame([(1,)], "id long")).select("id", "dist")


_ALL = f"{_PAIRS}, b as (select src as s, src as id, 0 as dist from (select distinct src from q) union select s, q.dst, dist + 1 from b join q on b.id = q.src where dist < 9), d as (select s, id, min(dist) as dist from b group by 1, 2)"


@_on_pairs(f"{_ALL} select s as id, max(dist) as eccentricity from d group by 1")
def eccentricity(e):
    return G.eccentricity(e)


@_on_pairs(f"{_ALL}, f as (select s as id, sum(dist) as t, count(*) as r from d group by 1) select id, round(case when r > 1 then t / (r - 1) * ((select count(distinct src) from q) - 1) / (r - 1) else 0 end, 6) as farness from f")
def closeness(e):
    return G.closeness(e).select("id", r6("farness").alias("farness"))


@_on_pairs(f"{_ALL} select dist, count(*) as n from d group by 1")
def distance_distribution(e):
    return G.distance_distribution(e)


@_on_pairs(f"{_PAIRS}, b as (select src as id, src as root from q union select q.dst, root from b join q on b.id = q.src) select id, min(root) as root from b group by 1")
def wcc(e):
    return G.weak_components(e)


@_on_pairs(f"{_PAIRS}, b as (select src as id, src as x from (select src from p union select dst from p) union select b.id, p.dst from b join p on b.x = p.src) select b.id, min(b.x) as root from b join b c on b.id = c.x and b.x = c.id group by 1")
def scc(e):
    return G.strong_components(e)


def _core_sql(k: int, rounds: int) -> str:
    text, last = _PAIRS, "q"
    for i in range(1, rounds + 1):
        text += f", d{i} as materialized (select src from {last} group by 1 having count(*) >= {k}), c{i} as materialized (select src, dst from {last} where src in (select src from d{i}) and dst in (select src from d{i}))"
        last = f"c{i}"
    return f"{text} select src as a, dst as b from {last} where src < dst"


@_on_pairs(_core_sql(3, 14))
def kcore_3(e):
    return G.k_core(e, 3)


def _pagerank_sql(rounds: int) -> str:
    text = f"{_PAIRS}, o as materialized (select src, count(*) as o from p group by 1), n as materialized (select distinct id from (select src as id from p union select dst from p)), r0 as (select id, 1.0::double / (select count(*) from n) as r from n)"
    for i in range(1, rounds + 1):
        text += f", s{i} as materialized (select n.id, coalesce(sum(0.85 * r / o.o), 0) as r from n left join p on p.dst = n.id left join o on o.src = p.src left join r{i - 1} x on x.id = p.src group by 1), r{i} as materialized (select id, r + (1 - (select sum(r) from s{i})) / (select count(*) from n) as r from s{i})"
    return f"{text} select id, round(r, 6) as rank from r{rounds}"


@_on_pairs(_pagerank_sql(10))
def pagerank_10(e):
    return G.pagerank(e, 10, tolerance=0.0).select("id", r6("rank").alias("rank"))


def _hits_sql(rounds: int) -> str:
    text = f"{_PAIRS}, n as materialized (select distinct id from (select src as id from p union select dst from p)), h0 as (select id, 1.0::double as h from n)"
    for i in range(1, rounds + 1):
        text += f", x{i} as materialized (select n.id, coalesce(sum(h), 0) as a from n left join p on p.dst = n.id left join h{i - 1} h on h.id = p.src group by 1), a{i} as materialized (select id, a / (select sqrt(sum(a * a)) from x{i}) as a from x{i}), y{i} as materialized (select n.id, coalesce(sum(a), 0) as h from n left join p on p.src = n.id left join a{i} a on a.id = p.dst group by 1), h{i} as materialized (select id, h / (select sqrt(sum(h * h)) from y{i}) as h from y{i})"
    return f"{text} select h.id, round(h, 6) as hub, round(a, 6) as authority from h{rounds} h join a{rounds} a on h.id = a.id"


@_on_pairs(_hits_sql(5))
def hits_5(e):
    return G.hits(e, 5).select("id", r6("hub").alias("hub"), r6("authority").alias("authority"))


def _eigen_sql(rounds: int) -> str:
    text = f"{_PAIRS}, n as materialized (select distinct src as id from q), r0 as (select id, 1.0::double as r from n)"
    for i in range(1, rounds + 1):
        text += f", x{i} as materialized (select q.src as id, sum(r) as r from q join r{i - 1} on id = q.dst group by 1), r{i} as materialized (select id, r / (select sqrt(sum(r * r)) from x{i}) as r from x{i})"
    return f"{text} select id, round(r, 6) as score from r{rounds}"


@_on_pairs(_eigen_sql(20))
def eigenvector(e):
    return G.eigenvector(e, 20, 0.0).select("id", r6("score").alias("score"))


def _personal_sql(rounds: int, weight: str = "1.0", reset: int | None = 1, edges: str = "p") -> str:
    """PageRank unrolled; what is lost goes to reset, or evenly to all."""
    text = f"{_PAIRS}, ew as materialized (select src, dst, {weight} as w from {edges} group by src, dst), o as materialized (select src, sum(w) as o from ew group by 1), n as materialized (select distinct src as id from q), r0 as (select id, {f'(id = {reset})::int::double' if reset else '1.0::double / (select count(*) from n)'} as r from n)"
    for i in range(1, rounds + 1):
        add = f"(id = {reset})::int * (1 - (select sum(r) from s{i}))" if reset else f"(1 - (select sum(r) from s{i})) / (select count(*) from n)"
        text += f", s{i} as materialized (select n.id, coalesce(sum(0.85 * r * w / o.o), 0) as r from n left join ew on ew.dst = n.id left join o on o.src = ew.src left join r{i - 1} x on x.id = ew.src group by 1), r{i} as materialized (select id, r + {add} as r from s{i})"
    return f"{text} select id, round(r, 6) as rank from r{rounds}"


@_on_pairs(_personal_sql(10))
def personal_pagerank(e):
    return G.pagerank(e, 10, tolerance=0.0, reset=1).select("id", r6("rank").alias("rank"))


@_query(_personal_sql(10, "count(*)::double", None, "g"))
def weighted_pagerank(spark, sf_dir):
    return G.pagerank(_graph(spark, sf_dir).withColumn("w", F.lit(1.0)), 10, tolerance=0.0, weight="w").select("id", r6("rank").alias("rank"))


@_on_pairs(f"{_PAIRS}, b as (select 1::bigint as id, 0 as dist union select p.dst, dist + p.dst % 5 + 1 from b join p on b.id = p.src where dist < 40) select id, min(dist)::double as dist from b group by 1")
def weighted_distance(e):
    return G.weighted_distances(e.withColumn("w", (F.col("dst") % 5 + 1).cast("double")), 1, "w")


@_on_pairs(f"{_PAIRS}, d as (select src as id, count(*) as d from q group by 1), r as materialized (select id, d, row_number() over (order by d desc, id) as rank from d), l as (select greatest(a.rank, b.rank) as rank, count(*) as n from q join r a on q.src = a.id join r b on q.dst = b.id where q.src < q.dst group by 1), z as materialized (select r.id, rank, sum(coalesce(n, 0)) over (order by rank) as i, sum(d) over (order by rank) as e from r left join l using (rank)), c as (select *, rank * (rank - 1) / 2 - i + (select count(*) // 2 from q) - e + i as cost from z) select id, rank::bigint as rank, rank <= (select rank from c order by cost, rank limit 1) as core from c")
def core_periphery(e):
    return G.core_periphery(e).select("id", "rank", "core")


#: Numbers of shortest paths between all pairs, level by level as far as the SQL's scale needs.
_SIGMA = f"{_PAIRS}, l0 as (select distinct src as s, src as id, 0 as d, 1::double as n from q)" + "".join(
    f", l{i} as materialized (select s, q.dst as id, {i} as d, sum(n) as n from l{i - 1} join q on q.src = id where not exists (select 1 from ({' union all '.join(f'select s, id from l{j}' for j in range(i))}) x where x.s = l{i - 1}.s and x.id = q.dst) group by 1, 2)" for i in range(1, 7)
) + ", sg as materialized (" + " union all ".join(f"select * from l{i}" for i in range(7)) + ")"


@_on_pairs(f"{_SIGMA} select v.id, round(coalesce(sum(case when v.id <> st.s and v.id <> st.id and sv.d + vt.d = st.d then sv.n * vt.n / st.n end), 0) / 2, 4) as betweenness from (select distinct src as id from q) v join sg sv on sv.id = v.id join sg st on st.s = sv.s join sg vt on vt.s = v.id and vt.id = st.id group by 1")
def betweenness(e):
    return S.betweenness_table(e).select("id", F.round("betweenness", 4).alias("betweenness"))


_CASCADE_LINKS = f"{_EVENTS}, kl as materialized (select a.id as a, b.id as b from k a join k b on a.dest = b.source and a.source <> a.dest and b.source <> b.dest and b.start between a.start + 60 and a.start + 60 + 60 and a.id <> b.id)"


@_query(f"{_CASCADE_LINKS.replace('with ', 'with recursive ', 1) if 'recursive' not in _CASCADE_LINKS else _CASCADE_LINKS}, rr as (select a as root, a as id from (select distinct a from kl where a not in (select b from kl)) union select root, b from rr join kl on kl.a = rr.id) select root, count(*) as size from rr group by 1")
def top_cascades(spark, sf_dir):
    return G.top_cascades(R.interval_join(_cascade(spark, sf_dir), 60))


_STATS = f"""{_PAIRS}, dg as materialized (select id, sum(o)::bigint as o, sum(1 - o)::bigint as i from (select src as id, 1 as o from p union all select dst, 0 from p) group by 1),
    tr as materialized (select a.src as x, a.dst as y, b.dst as z from q a join q b on a.dst = b.src join q c on b.dst = c.src and c.dst = a.src where a.src < a.dst and a.dst < b.dst),
    cl as (select id, count(*) as t from (select x as id from tr union all select y from tr union all select z from tr) group by 1), de as (select src as id, count(*) as d from q group by 1),
    wc as (select src as id, src as root from q union select q.dst, root from wc join q on wc.id = q.src), cs as (select root, count(*) as n from (select id, min(root) as root from wc group by 1) group by 1)
    select 'nodes' as statistic, (select count(*) from dg)::double as value union all select 'no_in', (select count(*) from dg where i = 0)::double union all select 'no_out', (select count(*) from dg where o = 0)::double
    union all select 'max_degree', (select max(o + i) from dg)::double union all select 'mean_degree', (select round(avg(o + i), 6) from dg) union all select 'directed', (select count(*) from p)::double
    union all select 'undirected', (select count(*) // 2 from q)::double union all select 'mutual', (select count(*) // 2 from p join p x on p.src = x.dst and p.dst = x.src)::double union all select 'self_edges', 0.0
    union all select 'triangles', (select count(*) from tr)::double union all select 'clustering', (select round(avg(coalesce(case when d > 1 then t / (d * (d - 1) / 2) end, 0)), 6) from de left join cl using (id))
    union all select 'components', (select count(*) from cs)::double union all select 'largest_component', (select max(n) from cs)::double"""


@_on_pairs(_STATS)
def graph_statistics(e):
    return G.statistics(e).withColumn("value", r6("value"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from weftline import registry_more  # noqa: F401, its queries are registered on import

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    from weftline import registry_more  # noqa: F401

    return dict(_sql)
