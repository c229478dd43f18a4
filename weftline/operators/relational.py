"""Table operators: predicates, joins, grouping, ranks and set operations, each a function from DataFrames to a DataFrame."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from weftline.operators.order import numbered, prefix
from weftline.operators.pair_sums import blocks_for, in_blocks, listed, met
from weftline.plans.densest import cut_lineage

# Predicates


def compare(left: Column | str, op: str, right: Column | str | float) -> Column:
    """op: one of < <= = != >= > substr superstr. A str on the left is a column's name, on the right a value."""
    a, b = F.col(left) if isinstance(left, str) else left, right if isinstance(right, Column) else F.lit(right)
    table = {"<": lambda: a < b, "<=": lambda: a <= b, "=": lambda: a == b, "!=": lambda: a != b, ">=": lambda: a >= b, ">": lambda: a > b, "substr": lambda: F.contains(a, b), "superstr": lambda: F.contains(b, a)}
    if op not in table:
        raise ValueError(f"unknown comparison {op}")
    return table[op]()


def predicate(tree: tuple | Column) -> Column:
    """A Column from nested ("and", x, y, ...), ("or", x, y, ...), ("not", x) and (left, op, right)."""
    if isinstance(tree, Column):
        return tree
    head = tree[0] if isinstance(tree[0], str) else None
    if head in ("and", "or") and not (len(tree) == 3 and isinstance(tree[1], str)):
        return reduce(Column.__and__ if head == "and" else Column.__or__, [predicate(x) for x in tree[1:]])
    return ~predicate(tree[1]) if head == "not" and len(tree) == 2 else compare(*tree)


def select(df: DataFrame, tree: tuple | Column) -> DataFrame:
    return df.where(predicate(tree))


def classify(df: DataFrame, tree: tuple | Column, label: str, positive: int = 1, negative: int = 0) -> DataFrame:
    return df.withColumn(label, F.when(predicate(tree), F.lit(positive)).otherwise(F.lit(negative)))


def project(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns)


def rename(df: DataFrame, **names: str) -> DataFrame:
    return df.withColumnsRenamed(names)


def lookup(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


# Joins


def sided(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with _1 and _2 behind the names they share."""
    both = set(left.columns) & set(right.columns)
    return tuple(df.withColumnsRenamed({c: f"{c}_{i}" for c in both}) for i, df in ((1, left), (2, right)))


def join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    both = set(left.columns) & set(right.columns)
    a, b = sided(left, right)
    return a.join(b, F.col(f"{left_key}_1" if left_key in both else left_key) == F.col(f"{right_key}_2" if right_key in both else right_key))


def self_join(df: DataFrame, key: str) -> DataFrame:
    return join(df, df, key, key)


def threshold_join(left: DataFrame, key1: str, join1: str, right: DataFrame, key2: str, join2: str, least: int, per_value: bool = False) -> DataFrame:
    """key1, key2, (value,) matches: the key pairs with at least so many matching rows. Rows are summed by (key, value), and
    pairs of keys in blocks by the squares of a key's sums: a pair has at most the root of their product as matches, so
    most pairs and blocks need not be summed."""
    a = left.groupBy(F.col(key1).alias("key1"), F.col(join1).alias("value")).agg(F.count(F.lit(1)).alias("na"))
    b = right.groupBy(F.col(key2).alias("key2"), F.col(join2).alias("value")).agg(F.count(F.lit(1)).alias("nb"))
    if per_value:  # one row on each side for a key and value, so the products are the sums
        return a.join(b, "value").select("key1", "key2", "value", (F.col("na") * F.col("nb")).alias("matches")).where(F.col("matches") >= least)
    goal = max(least, 0) ** 2
    sides = [cut_lineage(listed(x.where("value is not null"), f"key{i}", "value", F.col(n), F.sum(F.col(n) * F.col(n)))) for i, x, n in ((1, a, "na"), (2, b, "nb"))]
    most = [x.agg(F.max("size")).first()[0] or 0 for x in sides]
    sides = [x.where(F.col("size").cast("double") * other >= goal) for x, other in zip(sides, reversed(most), strict=True)]
    blocks = blocks_for(max(x.agg(F.sum(F.size("vs"))).first()[0] or 0 for x in sides))
    (one, ends1), (two, ends2) = (in_blocks(x, "size", blocks) for x in sides)
    pairs = [(i, j) for i in ends1 for j in ends2 if ends1[i][1] * ends2[j][1] >= goal]
    kinds = [x.schema["key"].dataType.simpleString() for x in sides]

    def pick(keys1, keys2, size1, size2, i, j, total):
        enough = total >= least
        return [keys1.take(pa.array(i[enough])), keys2.take(pa.array(j[enough])), pa.array(total[enough])]

    return met(one, two, pairs, pick, lambda x, y: x.astype(float) * y >= goal, f"key1 {kinds[0]}, key2 {kinds[1]}, matches bigint")


def sim_join_l2(left: DataFrame, right: DataFrame, columns1: list[str], columns2: list[str], most: float) -> DataFrame:
    """All pairs at Euclidean distance most or less, by a grid of that width over the first two columns."""
    if most <= 0:
        raise ValueError("the distance has to be positive")
    both = set(left.columns) & set(right.columns)
    a, b = sided(left, right)
    one = [F.col(f"{c}_1" if c in both else c) for c in columns1]
    two = [F.col(f"{c}_2" if c in both else c) for c in columns2]
    near = lambda c: F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda x: F.floor(c / most) + x))
    for i, (x, y) in enumerate(list(zip(one, two, strict=True))[:2]):
        a, b = a.withColumn(f"_g{i}", F.floor(x / most)), b.withColumn(f"_g{i}", near(y))
    keys = [f"_g{i}" for i in range(min(2, len(one)))]
    distance = F.sqrt(sum((F.pow(x - y, 2) for x, y in zip(one, two, strict=True)), F.lit(0.0)))
    return a.join(b, keys).drop(*keys).withColumn("distance", distance).where(F.col("distance") <= most)


EARTH_KM = 6373.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(h), F.sqrt(F.greatest(1 - h, F.lit(0.0))))


#: Rows of a place that meet others as one, and about the rows of a place that one task gathers. Spark keeps all rows in memory
#: that one row is exploded to, so the square of the first has to be small.
_RUN, _GATHERED = 128, 100_000


def _runs(df: DataFrame, lat: str, lon: str, side: int) -> DataFrame:
    """_y, _x, _at and each column as an array, for runs of at most _RUN rows of a place (_y, _x); _at has the positions."""
    df = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    hashed = [c for c, kind in df.dtypes if "map<" not in kind]
    # A place of very many rows is gathered in parts: other rows by their hash, equal ones by the partition that has them.
    hot = df.groupBy(F.col(lat).alias("_hy"), F.col(lon).alias("_hx")).agg(F.ceil(F.count(F.lit(1)) / _GATHERED).alias("_k")).where("_k > 1")
    parts = F.coalesce("_k", F.lit(1))
    part = F.pmod(F.pmod(F.xxhash64(*hashed), parts) + F.col("_p"), parts)
    known = df.withColumn("_p", F.spark_partition_id()).join(F.broadcast(hot), (F.col(lat) == F.col("_hy")) & (F.col(lon) == F.col("_hx")), "left")
    rows = F.collect_list(F.struct(*df.columns))
    # In order, so that a task that runs again cuts the same runs. Maps have none.
    rows = F.sort_array(rows) if hashed == df.columns else rows
    places = known.groupBy(F.col(lat).alias(f"_y{side}"), F.col(lon).alias(f"_x{side}"), part.alias("_p")).agg(rows.alias("_rows"))
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.size("_rows"), F.lit(_RUN)), lambda i: F.slice("_rows", i, _RUN)))
    runs = places.select(f"_y{side}", f"_x{side}", cut.alias("_run"))
    return runs.select(f"_y{side}", f"_x{side}", F.sequence(F.lit(0), F.size("_run") - 1).alias(f"_at{side}"), *[F.col("_run").getField(c).alias(c) for c in df.columns])


def sim_join_haversine(left: DataFrame, right: DataFrame, lat1: str, lon1: str, lat2: str, lon2: str, most_km: float) -> DataFrame:
    """All pairs within most_km; columns must differ between the sides. Distances are taken once for each pair of different
    places, whose rows meet in runs: pairs of runs are dealt one by one and become pairs of rows in the task that gets them.
    Cells of latitude bands, cut by longitude where the band is not too near a pole, bound the candidates."""
    half = min(most_km / EARTH_KM / 2, 1.5707963)
    band = 2 * half * 180 / 3.141592653589793
    # The least cosine of the latitudes of a band and its neighbours bounds the difference of longitudes of a pair.
    far = lambda t: F.least(F.greatest(F.abs((t - 1) * band), F.abs((t + 2) * band)), F.lit(90.0))
    width = lambda t: F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sin(F.lit(half)) / F.greatest(F.cos(F.radians(far(t))), F.lit(1e-9)))))
    cells = lambda t: F.greatest(F.lit(1), F.floor(360 / (width(t) * 1.0001))).cast("long")
    cell = lambda lon, n: F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * n)
    a, b = left.select(lat1, lon1).distinct(), right.select(lat2, lon2).distinct()
    a = a.withColumn("_b", F.floor(F.col(lat1) / band)).withColumn("_c", cell(F.col(lon1), cells(F.col("_b"))))
    b = b.withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda x: F.floor(F.col(lat2) / band) + x)))
    b = b.withColumn("_n", cells(F.col("_b"))).withColumn("_m", cell(F.col(lon2), F.col("_n")))
    b = b.withColumn("_c", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda x: F.pmod(F.col("_m") + x, F.col("_n")))))).drop("_n", "_m")
    near = a.join(b, ["_b", "_c"]).drop("_b", "_c").withColumn("distance", haversine(F.col(lat1), F.col(lon1), F.col(lat2), F.col(lon2))).where(F.col("distance") <= most_km)
    near = near.select(*[F.col(c).alias(k) for c, k in ((lat1, "_y1"), (lon1, "_x1"), (lat2, "_y2"), (lon2, "_x2"))], "distance")
    met = _runs(left, lat1, lon1, 1).join(near, ["_y1", "_x1"]).join(_runs(right, lat2, lon2, 2), ["_y2", "_x2"])
    # By number, as Spark would put a few pairs of runs, which may be billions of pairs of rows, into one task.
    met = met.select("_at1", "_at2", *left.columns, *right.columns, "distance").repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = met.select("*", F.explode("_at1").alias("_i")).select("_at2", *[F.get(c, "_i").alias(c) for c in left.columns], *right.columns, "distance")
    return pairs.select("*", F.explode("_at2").alias("_j")).select(*left.columns, *[F.get(c, "_j").alias(c) for c in right.columns], "distance")


def sim_join_l1(left: DataFrame, right: DataFrame, columns1: list[str], columns2: list[str], most: float) -> DataFrame:
    """All pairs at a sum of absolute differences of most or less: the Euclidean join's pairs, which contain them, checked."""
    both = set(left.columns) & set(right.columns)
    name = lambda c, i: F.col(f"{c}_{i}" if c in both else c)
    distance = sum((F.abs(name(x, 1) - name(y, 2)) for x, y in zip(columns1, columns2, strict=True)), F.lit(0.0))
    return sim_join_l2(left, right, columns1, columns2, most).withColumn("distance", distance).where(F.col("distance") <= most)


def sim_join(left: DataFrame, right: DataFrame, columns1: list[str], columns2: list[str], most: float, kind: str = "l2") -> DataFrame:
    """The join of a kind: l1, l2 or haversine (latitude and longitude); others raise NotImplementedError."""
    if kind == "haversine":
        return sim_join_haversine(left, right, *columns1, *columns2, most)
    if kind not in ("l1", "l2"):
        raise NotImplementedError(f"no similarity join by {kind}")
    return (sim_join_l1 if kind == "l1" else sim_join_l2)(left, right, columns1, columns2, most)


def jaccard_groups(df: DataFrame, groups: list[str], value: str, most: float = 1.0) -> DataFrame:
    """Ordered pairs of groups, themselves included, at Jaccard distance most or less. Below 1 only pairs that share a
    value are formed; at 1 all pairs belong to the result, as many as the square of the groups."""
    sets = df.select(F.struct(*groups).alias("g"), F.col(value).alias("v")).where("v is not null").distinct()
    sizes = sets.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    common = sets.select(F.col("g").alias("g1"), "v").join(sets.select(F.col("g").alias("g2"), "v"), "v").groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("common"))
    one, two = (sizes.select(F.col("g").alias(f"g{i}"), F.col("n").alias(f"n{i}")) for i in (1, 2))
    both = common.join(one, "g1").join(two, "g2") if most < 1 else one.crossJoin(two).join(common, ["g1", "g2"], "left").na.fill(0, ["common"])
    distance = 1 - F.col("common") / (F.col("n1") + F.col("n2") - F.col("common"))
    return both.withColumn("distance", distance).where(F.col("distance") <= most).select(*[F.col(f"g{i}.{g}").alias(f"{g}_{i}") for i in (1, 2) for g in groups], "distance")


def next_k(df: DataFrame, order: list[str], k: int, groups: list[str], columns: list[str]) -> DataFrame:
    """Each row of a group with each of the k rows after it: groups, columns with _1 and _2, step 1..k."""
    w = Window.partitionBy(*groups).orderBy(*order)
    after = F.filter(F.array(*[F.struct(F.lit(i).alias("step"), F.lead(F.struct(*columns), i).over(w).alias("r")) for i in range(1, k + 1)]), lambda x: x["r"].isNotNull())
    rows = df.select(*groups, *[F.col(c).alias(f"{c}_1") for c in columns], after.alias("after"))
    return rows.select(*groups, *[f"{c}_1" for c in columns], F.explode("after").alias("a")).select(*groups, *[f"{c}_1" for c in columns], *[F.col(f"a.r.{c}").alias(f"{c}_2") for c in columns], F.col("a.step").alias("step"))


def update_from(df: DataFrame, key: str, column: str, other: DataFrame, other_key: str, other_column: str, default: float, order: str | None = None) -> DataFrame:
    """df with column taken from other by key, default where it has none. Of equal keys the last by order counts, without
    an order the largest value."""
    value = F.max_by(other_column, order) if order else F.max(other_column)
    found = other.groupBy(F.col(other_key).alias("_k")).agg(value.alias("_v"))
    return df.drop(column).join(found, F.col(key) == F.col("_k"), "left").withColumn(column, F.coalesce("_v", F.lit(default))).drop("_k", "_v")


def interval_join(events: DataFrame, window: int) -> DataFrame:
    """Pairs a, b of events (id, source, dest, start, duration): b starts at a's destination within window after a's end."""
    a = events.select(F.col("id").alias("a"), F.col("dest").alias("_at"), (F.col("start") + F.col("duration")).alias("_end"))
    width = max(window, 1)
    a = a.withColumn("_b", F.floor(F.col("_end") / width))
    b = events.select(F.col("id").alias("b"), F.col("source").alias("_at"), F.col("start").alias("_start")).withColumn("_b", F.explode(F.array(F.floor(F.col("_start") / width), F.floor(F.col("_start") / width) - 1)))
    return a.join(b, ["_at", "_b"]).where(f"_start between _end and _end + {window} and a != b").select("a", "b")


# Grouping


def _value(df: DataFrame, op: str, value: str | None, order: str | None) -> Column:
    c = F.col(value) if value else None
    whole = value is not None and isinstance(df.schema[value].dataType, ByteType | ShortType | IntegerType | LongType)
    table = {
        "min": lambda: F.min(c), "max": lambda: F.max(c), "sum": lambda: F.sum(c), "count": lambda: F.count(F.lit(1)),
        "first": lambda: F.min_by(c, F.col(order)), "last": lambda: F.max_by(c, F.col(order)),
        "mean": lambda: F.try_divide(F.sum(c) - F.sum(c) % F.count(c), F.count(c)).cast("long") if whole else F.avg(c),
        "median": lambda: F.element_at(F.sort_array(F.collect_list(c)), F.floor(F.count(c) / 2).cast("int") + 1),
    }
    if op not in table:
        raise ValueError(f"unknown aggregate {op}")
    return table[op]()


def aggregate(df: DataFrame, groups: list[str], op: str, value: str | None, result: str, order: str | None = None, collapse: bool = False) -> DataFrame:
    """All rows with their group's min, max, sum, mean, median (the upper one), first, last or count; or one row a group.

    The group's value is made by an aggregation with map-side sums and joined, so a hot group is no single task's work.
    The mean of whole numbers is cut towards zero.
    """
    found = df.groupBy(*groups).agg(_value(df, op, value, order).alias(result))
    if collapse:
        return found
    keys = found.withColumnsRenamed({g: f"_{g}" for g in groups})
    return df.join(keys, reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups])).drop(*[f"_{g}" for g in groups])


def aggregate_columns(df: DataFrame, columns: list[str], op: str, result: str) -> DataFrame:
    """The min, max, sum, mean or median of several columns of each row."""
    c = [F.col(x) for x in columns]
    total = reduce(Column.__add__, c)
    table = {"min": lambda: F.least(*c), "max": lambda: F.greatest(*c), "sum": lambda: total, "mean": lambda: total / len(c), "median": lambda: F.sort_array(F.array(*c))[len(c) // 2]}
    return df.withColumn(result, table[op]())


def group_ids(df: DataFrame, columns: list[str], result: str, ordered: bool = True) -> DataFrame:
    """Rows with a number for each distinct combination, in its order; unordered: the columns' values in any order are one."""
    key = F.struct(*columns) if ordered else F.array_sort(F.array(*columns))
    rows = df.withColumn("_key", key)
    return rows.join(numbered(rows.select("_key").distinct(), ["_key"], result), "_key").drop("_key")


def unique(df: DataFrame, columns: list[str], order: str, ordered: bool = True) -> DataFrame:
    """The first row by order of each distinct combination, by an aggregation."""
    key = F.struct(*columns) if ordered else F.array_sort(F.array(*columns))
    first = df.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*df.columns), F.col(order)).alias("r"))
    return first.select("r.*")


def distribution(df: DataFrame, value: str) -> DataFrame:
    """value, n, pdf, cdf and ccdf (share at or above)."""
    counts = df.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    summed = prefix(counts, ["value"], {"upto": F.col("n")})
    total, upto = F.col("total"), F.col("upto")
    all_ = counts.agg(F.sum("n").alias("total"))
    return summed.crossJoin(F.broadcast(all_)).select("value", "n", (F.col("n") / total).alias("pdf"), (upto / total).alias("cdf"), ((total - upto + F.col("n")) / total).alias("ccdf"))


def exponential_bins(df: DataFrame, value: str, base: float = 2.0) -> DataFrame:
    return df.where(F.col(value) > 0).groupBy(F.floor(F.log(F.col(value).cast("double")) / F.log(F.lit(base))).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def moments(df: DataFrame, value: str) -> DataFrame:
    c = F.col(value)
    return df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.var_pop(c).alias("variance"), F.stddev_pop(c).alias("deviation"), F.min(c).alias("least"), F.percentile(c, 0.25).alias("quartile1"), F.percentile(c, 0.5).alias("median"), F.percentile(c, 0.75).alias("quartile3"), F.percentile(c, 0.9).alias("decile9"), F.max(c).alias("most"))


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation and the least-squares line."""
    return df.agg(F.corr(x, y).alias("r"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def entropy(df: DataFrame, value: str) -> DataFrame:
    """Bits of entropy of the values' frequencies."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("bits"))


def power_law_exponent(df: DataFrame, value: str, least: float = 1.0) -> DataFrame:
    """Maximum-likelihood exponent of the values at or above least."""
    return df.where(F.col(value) >= least).agg((1 + F.count(F.lit(1)) / F.sum(F.log(F.col(value) / least))).alias("alpha"))


def chi_square(df: DataFrame, observed: str, expected: str) -> DataFrame:
    return df.agg(F.sum(F.pow(F.col(observed) - F.col(expected), 2) / F.col(expected)).alias("chi2"))


def ks_distance(df: DataFrame, value: str, sample: str) -> DataFrame:
    """Largest distance between the distributions of the two samples (0 and 1 in the column sample)."""
    c = df.groupBy(value).agg(F.sum((F.col(sample) == 0).cast("long")).alias("a"), F.sum((F.col(sample) == 1).cast("long")).alias("b"))
    all_ = c.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    upto = prefix(c, [value], {"ua": F.col("a"), "ub": F.col("b")}).crossJoin(F.broadcast(all_))
    return upto.agg(F.max(F.abs(F.col("ua") / F.col("na") - F.col("ub") / F.col("nb"))).alias("ks"))


def histogram(df: DataFrame, value: str, least: float, most: float, bins: int) -> DataFrame:
    """bin 1..bins and n over [least, most]; values outside are left out, most itself is in the last bin."""
    inside = df.where(F.col(value).between(least, most))
    at = F.least(F.floor((F.col(value) - least) / ((most - least) / bins)) + 1, F.lit(bins)).cast("int")
    return inside.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def least_squares(df: DataFrame, xs: list[str], y: str) -> DataFrame:
    """term and coefficient of the linear model of y by xs and an intercept: the normal equations are summed over the
    cluster, and the system of len(xs) + 1 unknowns is solved on the driver."""
    import numpy as np

    columns = [F.lit(1.0), *[F.col(x).cast("double") for x in xs], F.col(y).cast("double")]
    n = len(columns)
    sums = df.na.drop(subset=[*xs, y]).agg(*[F.sum(columns[i] * columns[j]) for i in range(n) for j in range(i, n)]).first()
    gram = np.zeros((n, n))
    gram[np.triu_indices(n)] = [x or 0.0 for x in sums]
    gram += np.triu(gram, 1).T
    found = np.linalg.lstsq(gram[:-1, :-1], gram[:-1, -1], rcond=None)[0]
    return df.sparkSession.createDataFrame(list(zip(["intercept", *xs], map(float, found), strict=True)), "term string, coefficient double")


# Columns and groups as values


def column_values(df: DataFrame, column: str, order: str, limit: int = 1_000_000) -> list:
    """The values of a column in order, on the driver; more than limit raise an error."""
    rows = df.orderBy(order).select(column).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    return [r[0] for r in rows]


def append_column(df: DataFrame, order: str, values: list, result: str, kind: str) -> DataFrame:
    """df with the values as a column, the first at the first row by order; as many values as rows."""
    given = df.sparkSession.createDataFrame(list(enumerate(values)), f"_row long, {result} {kind}")
    out = numbered(df, [order], "_row")
    if out.count() != len(values):
        raise ValueError("the number of values is not that of the rows")
    return out.join(given, "_row").drop("_row")


def splice_by_group(df: DataFrame, groups: list[str], path: str) -> list[tuple]:
    """One folder of Parquet files a group under path, groups being columns of the folders' names; returns the groups."""
    df.repartition(*groups).write.mode("errorifexists").partitionBy(*groups).parquet(path)
    return [tuple(r) for r in df.sparkSession.read.parquet(path).select(*groups).distinct().orderBy(*groups).collect()]


# Order


def rank(df: DataFrame, columns: list[str], tie: str, result: str = "rank", ascending: bool = True, reset: bool = False, coarse: Column | None = None) -> DataFrame:
    """A 0-based rank in the order of columns, then tie; reset: from 0 for each value of the first column.

    coarse, a column that never falls (or rises, descending) along the order, lets ranges be ranked on their own.
    """
    keys = [F.col(c).asc() if ascending else F.col(c).desc() for c in columns] + [F.col(tie).asc()]
    if reset:
        return df.withColumn(result, (F.row_number().over(Window.partitionBy(columns[0]).orderBy(*keys[1:])) - 1).cast("long"))
    if coarse is None:
        return numbered(df, keys, result)
    rows = df.withColumn("_c", coarse)
    sizes = rows.groupBy("_c").agg(F.count(F.lit(1)).alias("_n"))
    by = F.col("_c").asc() if ascending else F.col("_c").desc()
    before = sizes.select("_c", F.coalesce(F.sum("_n").over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_c").orderBy(*keys)) - 1
    return rows.withColumn("_own", own).join(before, "_c").withColumn(result, (F.col("_own") + F.col("_before")).cast("long")).drop("_c", "_own", "_before")


def first_n(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_k(df: DataFrame, groups: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


# Sets of rows


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def _same(a: DataFrame, b: DataFrame) -> tuple[DataFrame, Column]:
    other = b.distinct().withColumnsRenamed({c: f"_{c}" for c in b.columns})
    return other, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in a.columns])


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of b, as often as they are there, that a has too."""
    other, same = _same(b, a)
    return b.join(other, same, "left_semi")


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of a, as often as they are there, that b doesn't have."""
    other, same = _same(a, b)
    return a.join(other, same, "left_anti")
