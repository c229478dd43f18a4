"""Readers and writers of edge lists, motifs and delimited tables, and the graphs made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftline.functions.times import micros


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None, sep: str = "\t", header: bool = False, columns: list[str] | None = None) -> DataFrame:
    """A delimited text table; # starts a comment. Without a schema the types are inferred from all rows."""
    reader = spark.read.option("sep", sep).option("header", header).option("comment", "#").option("mode", "FAILFAST")
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, sep: str = "\t", header: bool = True) -> None:
    df.write.mode("errorifexists").option("sep", sep).option("header", header).csv(path)


def _fields(spark: SparkSession, path: str, pattern: str = "\\s+") -> DataFrame:
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line != '' and not startswith(line, '#')")
    return lines.select("line", F.split("line", pattern).alias("f"))


def _field(i: int, arity: int, kind: str) -> Column:
    right = F.size("f") == arity
    return F.when(right, F.col("f")[i].cast(kind)).otherwise(F.raise_error(F.concat(F.lit(f"expected {arity} fields: "), "line")).cast(kind))


def read_temporal_edges(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, t of lines `src dst t`; self-loops are dropped, other arities fail."""
    return _fields(spark, path).select(*[_field(i, 3, "bigint").alias(n) for i, n in enumerate(("src", "dst", "t"))]).where("src != dst")


def count_self_loops(spark: SparkSession, path: str) -> int:
    return _fields(spark, path).where("f[0] = f[1]").count()


def read_edges(spark: SparkSession, path: str, pattern: str = "\\s+") -> DataFrame:
    """src, dst of an edge list with numbers as ids."""
    return _fields(spark, path, pattern).select(F.col("f")[0].cast("long").alias("src"), F.col("f")[1].cast("long").alias("dst"))


def read_named_edges(spark: SparkSession, path: str, pattern: str = "\\s+") -> tuple[DataFrame, DataFrame]:
    """Edges with dense ids and the table (id, name), for an edge list with strings as ids."""
    named = _fields(spark, path, pattern).select(F.col("f")[0].alias("a"), F.col("f")[1].alias("b"))
    names = dense_ids(named.select(F.col("a").alias("name")).union(named.select("b")).distinct(), "name")
    ids = names.select(F.col("id").alias("src"), F.col("name").alias("a")), names.select(F.col("id").alias("dst"), F.col("name").alias("b"))
    return named.join(ids[0], "a").join(ids[1], "b").select("src", "dst"), names


def read_connections(spark: SparkSession, path: str) -> DataFrame:
    """src, dst of lines `node neighbour neighbour ...`."""
    f = _fields(spark, path).select(F.col("f")[0].cast("long").alias("src"), F.expr("slice(f, 2, greatest(size(f) - 1, 0))").alias("rest"))
    return f.select("src", F.explode(F.col("rest").cast("array<bigint>")).alias("dst"))


def read_pajek(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name) and edges (src, dst) of a Pajek file, whose sections are told apart by their line numbers."""
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split("value", "\\r?\\n")).alias("no", "line")).select("no", F.trim("line").alias("line")).where("line != ''")
    heads = lines.where("startswith(line, '*')").select(F.col("no").alias("h"), F.lower(F.split("line", "\\s+")[0]).alias("section"))
    inside = lines.where("not startswith(line, '*')").join(F.broadcast(heads), F.col("h") < F.col("no")).groupBy("no", "line").agg(F.max_by("section", "h").alias("section"))
    nodes = inside.where("section = '*vertices'").select(F.split("line", "\\s+")[0].cast("long").alias("id"), F.regexp_extract("line", '"([^"]*)"', 1).alias("name"))
    edges = inside.where("section in ('*arcs', '*edges')").select(F.split("line", "\\s+")[0].cast("long").alias("src"), F.split("line", "\\s+")[1].cast("long").alias("dst"))
    return nodes, edges


def read_edge_times(spark: SparkSession, path: str, src: int, dst: int, t: int, pattern: str = "\\s+") -> DataFrame:
    """src, dst, t (longs) from the fields with these numbers of a separated text; lines without them fail."""
    at = lambda i: F.when(F.size("f") > i, F.col("f")[i].cast("bigint")).otherwise(F.raise_error(F.concat(F.lit(f"no field {i}: "), "line")).cast("bigint"))
    return _fields(spark, path, pattern).select(at(src).alias("src"), at(dst).alias("dst"), at(t).alias("t"))


def write_network(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """An attributed network as two tables, nodes (id, ...) and edges (src, dst, ...), under path."""
    nodes.write.mode("errorifexists").parquet(f"{path}/nodes")
    edges.write.mode("errorifexists").parquet(f"{path}/edges")


def read_network(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def from_mapping(spark: SparkSession, values: dict, key: str, value: str, kinds: str) -> DataFrame:
    """A table of two columns from a mapping; kinds: their types, separated by a comma."""
    a, b = kinds.split(",")
    return spark.createDataFrame(list(values.items()), f"{key} {a}, {value} {b}")


def edge_lines(edges: DataFrame) -> DataFrame:
    """Text lines of an edge list, for df.write.text."""
    return edges.select(F.concat_ws("\t", "src", "dst").alias("value"))


def pajek_lines(edges: DataFrame) -> DataFrame:
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    n = nodes.count()
    head = edges.sparkSession.createDataFrame([(0, 0, 0, f"*Vertices {n}"), (2, 0, 0, "*Arcs")], "part int, a long, b long, value string")
    rows = head.union(nodes.select(F.lit(1), "id", F.lit(0), F.format_string('%d "%d"', "id", "id"))).union(edges.select(F.lit(3), "src", "dst", F.concat_ws(" ", "src", "dst")))
    return rows.orderBy("part", "a", "b").select("value")


def dot_lines(edges: DataFrame, directed: bool = True) -> DataFrame:
    arrow, kind = ("->", "digraph") if directed else ("--", "graph")
    ends = edges.sparkSession.createDataFrame([(0, 0, 0, kind + " G {"), (2, 0, 0, "}")], "part int, a long, b long, value string")
    rows = ends.union(edges.select(F.lit(1), "src", "dst", F.concat(F.lit("  "), F.col("src").cast("string"), F.lit(f" {arrow} "), F.col("dst").cast("string"), F.lit(";"))))
    return rows.orderBy("part", "a", "b").select("value")


def matlab_lines(edges: DataFrame) -> DataFrame:
    """Sparse triples with one-based ids."""
    return edges.select(F.concat_ws("\t", F.col("src") + 1, F.col("dst") + 1, F.lit(1)).alias("value"))


def temporal_lines(edges: DataFrame, relative: bool = False) -> DataFrame:
    """Lines `src dst t`; relative: times from the earliest one."""
    start = edges.agg(F.min("t").alias("t0"))
    rows = edges.crossJoin(F.broadcast(start)) if relative else edges.withColumn("t0", F.lit(0))
    return rows.select(F.concat_ws(" ", "src", "dst", F.col("t") - F.col("t0")).alias("value"))


def dense_ids(df: DataFrame, column: str) -> DataFrame:
    """id 0, 1, ... of the distinct values in order."""
    from weftline.operators.order import numbered

    return numbered(df.select(column).distinct(), [column], "id")


def indexed(df: DataFrame, order: list[str], coarse: Column, name: str) -> DataFrame:
    """A gapless number from 0 in the given order. coarse must not fall along it; its ranges are numbered on their own,
    then shifted by the sizes of those before, so only the table of ranges is ordered as a whole."""
    rows = df.withColumn("__range", coarse)
    sizes = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return rows.withColumn("__own", own).join(before, "__range").withColumn(name, (F.col("__before") + F.col("__own")).cast("long")).drop("__range", "__own", "__before", "__n")


def event_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """eid, src, dst, t: from each event's user to that of the next event, at whole seconds; no self-loops.

    Days are ordered on their own; the last event of a day takes its successor from the first of the next day.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id")
    day = F.floor(micros(e, "ts") / 86_400_000_000).cast("long")
    rows = indexed(e, ["ts", "event_id"], day, "eid").withColumn("day", day).withColumn("micros", micros(e, "ts"))
    firsts = rows.groupBy("day").agg(F.min_by("user_id", "eid").alias("first"))
    following = firsts.withColumn("next_first", F.lead("first").over(Window.orderBy("day"))).drop("first")
    inside = F.lead("user_id").over(Window.partitionBy("day").orderBy("ts", "event_id"))
    out = rows.withColumn("dst", inside).join(following, "day").withColumn("dst", F.coalesce("dst", "next_first"))
    return out.select("eid", F.col("user_id").alias("src"), "dst", F.floor(F.col("micros") / 1_000_000).cast("long").alias("t")).where("dst is not null and src != dst")


def order_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src (customer), dst (supplier, from 10**9), t (ship date in seconds)."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey", "l_shipdate")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 10**9).alias("dst"), F.floor(micros(lines, "l_shipdate") / 1_000_000).cast("long").alias("t"))
