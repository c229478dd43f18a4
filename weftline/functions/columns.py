"""Column arithmetic, strings, texts and times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType


def arithmetic(df: DataFrame, left: str, op: str, right: str | float, result: str) -> DataFrame:
    """result = left op right for add, sub, mul, div, mod, min, max; right is a column's name or a number.

    Whole numbers divide to whole numbers; mod is for whole numbers only.
    """
    whole = lambda c: isinstance(df.schema[c].dataType, ByteType | ShortType | IntegerType | LongType)
    ints = whole(left) and (whole(right) if isinstance(right, str) else isinstance(right, int))
    a, b = F.col(left), F.col(right) if isinstance(right, str) else F.lit(right)
    if op == "mod" and not ints:
        raise TypeError("mod is for whole numbers")
    table = {"add": lambda: a + b, "sub": lambda: a - b, "mul": lambda: a * b, "div": lambda: F.when(b != 0, F.floor(F.abs(a) / F.abs(b)).cast("long") * F.signum(a).cast("long") * F.signum(b).cast("long")) if ints else a / b, "mod": lambda: a % b, "min": lambda: F.least(a, b), "max": lambda: F.greatest(a, b)}
    return df.withColumn(result, table[op]())


def with_rows_of(df: DataFrame, order: str, other: DataFrame, other_order: str, columns: list[str]) -> DataFrame:
    """df with columns of the other table, row by row in both orders."""
    from weftline.operators.relational import rank

    a = rank(df, [order], order, "_row")
    b = rank(other, [other_order], other_order, "_row").select("_row", *columns)
    return a.join(b, "_row").drop("_row")


def concat(df: DataFrame, left: str, right: str | Column, separator: str, result: str) -> DataFrame:
    return df.withColumn(result, F.concat_ws(separator, F.col(left), F.col(right) if isinstance(right, str) else right))


def word_count(text: Column, stop: tuple[str, ...] = ()) -> Column:
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda x: x != "")
    return F.size(F.filter(words, lambda x: ~x.isin(*stop)) if stop else words)


def words(text: Column) -> Column:
    return F.filter(F.split(text, "\\s+"), lambda x: x != "")


def lines(text: Column) -> Column:
    return F.split(text, "\\r?\\n")


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, "(?<=[.!?])\\s+"), lambda x: x != "")


def strip_html(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), "\\s+", " "))


def clean(text: Column) -> Column:
    """Letters, digits and single spaces."""
    return F.trim(F.regexp_replace(text, "[^\\p{L}\\p{N}]+", " "))


def shorten(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def latin_fraction(text: Column) -> Column:
    return F.try_divide(F.length(F.regexp_replace(text, "[^A-Za-z]", "")), F.length(F.regexp_replace(text, "\\s", "")))


def host(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), "^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]+)", 1)


def website(url: Column) -> Column:
    return F.regexp_replace(host(url), "^www\\.", "")


def normalized_url(url: Column) -> Column:
    """Lower-case host without www, path without fragment and final slash."""
    rest = F.regexp_extract(url, "^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]*([^#]*)", 1)
    return F.concat(website(url), F.regexp_replace(rest, "/$", ""))


def person_name(name: Column) -> Column:
    """Last name and initials, `lovelace_a`."""
    parts = F.filter(F.split(F.lower(F.regexp_replace(name, "[^\\p{L} ]", "")), " +"), lambda x: x != "")
    return F.concat_ws("_", F.element_at(parts, -1), F.array_join(F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.substring(x, 1, 1)), ""))


def time_parts(ts: Column) -> dict[str, Column]:
    return {"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "hour": F.hour(ts), "minute": F.minute(ts), "second": F.second(ts), "weekday": F.dayofweek(ts)}


def math(x: Column) -> dict[str, Column]:
    return {"log": F.log(x), "log2": F.log2(x), "sqrt": F.sqrt(x), "sign": F.signum(x), "round2": F.round(x, 2), "factorial": F.factorial(F.least(F.abs(x).cast("int"), F.lit(20)))}


def log_factorial(x: Column) -> Column:
    """Logarithm of the factorial of a whole number, as the sum of logarithms up to it."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(x.cast("int"), F.lit(1))), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))


def log_binomial(n: Column, k: Column) -> Column:
    """Logarithm of the number of ways to choose k of n."""
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def to_json_column(df: DataFrame, columns: list[str], result: str) -> DataFrame:
    return df.withColumn(result, F.to_json(F.struct(*columns)))


def from_json_column(df: DataFrame, column: str, schema: str) -> DataFrame:
    """df with the fields of the JSON texts as columns."""
    return df.withColumn("_j", F.from_json(F.col(column), schema)).select(*df.columns, "_j.*")


def array_edit(df: DataFrame, column: str, append=None, remove=None, delete_at: int | None = None) -> DataFrame:
    """An array column with a value appended, a value removed, or the element at a 0-based place deleted."""
    c = F.col(column)
    if append is not None:
        c = F.array_append(c, F.lit(append))
    if remove is not None:
        c = F.array_remove(c, remove)
    if delete_at is not None:
        c = F.filter(c, lambda _, i: i != delete_at)
    return df.withColumn(column, c)
