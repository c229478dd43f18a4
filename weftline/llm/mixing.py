"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Every document draws an exponential key -ln(u) / w, u from a hash of its doc_id and the seed, w its quality weight.
A source takes its documents in the order of their keys: whole epochs first, then those whose prefix sum of sizes comes
into what is left of the token budget.

Scale: texts are read once, to count words; all else moves rows of about 40 bytes. The prefix sums of a source are made
in two steps, sums of key ranges and sums within a range, with about sqrt(n) of each, so that a source with a third of
all rows meets in no task. The table of sources is the only one that is ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.scratch import durable

SEED = 20240607
MAX_EPOCHS = 3
#: Weights of documents labelled good, not labelled, and labelled poor.
GOOD, PLAIN, POOR = 2.0, 1.0, 0.5


def n_words(text: str) -> Column:
    """How many words [^\\x20\\x09-\\x0D]+ the text has; null: none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _quality(labels: DataFrame) -> DataFrame:
    """doc_id and weight of each labelled document; the best label counts where there are several."""
    best = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("q_id")).agg(F.max("quality").alias("q"))
    return best.select("q_id", F.when(F.col("q") > 0, F.lit(GOOD)).otherwise(F.lit(POOR)).alias("weight"))


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes: src (struct of source and whether it is null), source_size, n_docs. Adds target.

    Sources by code point, null last, weigh 1, 2, 3 and so on again and share the sum of all sizes; a target above
    max_epochs times its source's size stops there, and the excess goes to the others by weight. That is
    min(max_epochs * size, level * weight) with the level at which the targets add up.
    """
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("w", ((F.row_number().over(everything.orderBy("src.missing", "src.name")) - 1) % 3 + 1).cast("double"))
    ranked = ranked.withColumn("cap", max_epochs * F.col("source_size").cast("double")).withColumn("total", F.sum("source_size").over(everything).cast("double"))
    by_level = everything.orderBy(F.col("cap") / F.col("w"), "src.missing", "src.name")
    below = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # If all sources up to the one before are at their caps, the others share what remains at this level.
    levels = ranked.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("w").over(rest))
    open_level = F.min(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.struct(F.col("cap") / F.col("w"), "level"))).over(everything)
    return levels.withColumn("open", open_level["level"]).select("src", "source_size", "n_docs", F.least("cap", F.coalesce(F.col("open") * F.col("w"), F.col("cap"))).alias("target"))


def _mixed(base: DataFrame, max_epochs: int) -> DataFrame:
    """base: uid, doc_id, src, size, weight, key. Adds source_size, target, taken."""
    sizes = base.groupBy("src").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = durable(source_targets(sizes, max_epochs))
    ranges = F.greatest(F.lit(1.0), F.least(F.sqrt("n_docs") * 2, F.col("n_docs") / 512))
    rows = base.join(targets, "src").withColumn("range", F.floor((1 - F.exp(-F.col("key"))) * ranges).cast("long"))
    ahead = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("src", "range").agg(F.sum("size").alias("in_range")).select("src", "range", F.coalesce(F.sum("in_range").over(ahead), F.lit(0)).alias("before"))
    within = Window.partitionBy("src", "range").orderBy("key", "doc_id", "uid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The window comes before the join, which keeps the join's sides plain exchanges.
    prefix = rows.withColumn("prefix", F.sum("size").over(within)).join(sums, ["src", "range"])
    epochs = F.floor(F.col("target") / F.col("source_size"))
    left = F.col("target") - epochs * F.col("source_size")
    # mix() takes whole documents; one counts as inside if most of it is, which is as near the budget as they allow.
    inside = F.col("before") + F.col("prefix") - F.col("size") / 2 <= left
    copies = F.when(F.col("source_size") > 0, F.least(epochs + F.when(inside, 1).otherwise(0), F.lit(max_epochs))).otherwise(0).cast("int")
    # The document at the end of the budget is taken in part, so the words taken are the target, rounded.
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.round(left).cast("long") - (F.col("before") + F.col("prefix") - F.col("size"))))
    taken = F.when(F.col("source_size") > 0, F.least(epochs * F.col("size") + part, max_epochs * F.col("size"))).otherwise(0).cast("long")
    return prefix.withColumn("copies", copies).withColumn("taken", taken)


def _base(docs: DataFrame, labels: DataFrame | None, seed: int, *more: Column) -> DataFrame:
    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    src = F.struct(F.col("source").isNull().alias("missing"), F.coalesce("source", F.lit("")).alias("name"))
    base = durable(docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), src.alias("src"), n_words("text").alias("size"), uniform.alias("u"), *more))
    weighted = base.withColumn("weight", F.lit(PLAIN)) if labels is None else base.join(_quality(labels), F.col("doc_id") == F.col("q_id"), "left").drop("q_id").withColumn("weight", F.coalesce("weight", F.lit(PLAIN)))
    return weighted.withColumn("key", -F.log("u") / F.col("weight"))


def mixture(docs: DataFrame, labels: DataFrame | None = None, seed: int = SEED, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per row of docs (doc_id, text, source; others are ignored): doc_id, size, source_size, target, taken.

    taken is in words, at most max_epochs times size: whole epochs, and one more for the documents before the end of the
    source's budget, of which the last is taken in part. labels (doc_id, quality) give the weights. Null texts and
    texts without words have size 0 and take nothing; null is a source of its own; equal keys go by doc_id. A source
    without words has target 0, an empty table gives an empty result, and reruns agree.
    """
    return _mixed(_base(docs, labels, seed), max_epochs).select("doc_id", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, labels: DataFrame | None = None, seed: int = SEED, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The rows of docs that mixture() takes, each as often as it is taken, with all columns as they were.

    Documents are whole here: the one at the end of a source's budget comes if most of it does. Of documents without words
    (null or empty texts) those come whose keys are before the end. Extra columns may have any names; repeated rows are
    documents of their own; an empty table stays empty.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    base = _base(docs, labels, seed, row)
    copies = _mixed(base.drop("row"), max_epochs).where("copies > 0").select("uid", "copies")
    taken = base.select("uid", "row").join(copies, "uid").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
