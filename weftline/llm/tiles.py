"""Groups whose members meet each other, dealt so that no task gets more than two parts of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.scratch import durable, small

#: Members up to which a group is a single tile.
TILE = 2048


def dealt(members: DataFrame, sizes: DataFrame, key: str, member: str, tile: int = TILE, near: list[Column] | None = None) -> DataFrame:
    """members, sorted by tile: adds i, j (the tile's parts) and side (the member's part).

    sizes: key and n, the number of members of each group. A group of more than tile members is cut into parts of about
    tile / 2 by a hash of the column member; part x meets part y in the tile (x, y). In tiles with i = j all pairs count,
    in the others those of different sides. near: what tiles of one task should share, in place of the key; it must follow from
    the key.
    """
    large = durable(sizes.where(F.col("n") > tile).select(key, F.ceil(F.col("n") / (tile // 2)).alias("parts")))
    rows = members.join(small(large), key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("side", F.pmod(F.xxhash64(member), F.col("parts"))).withColumn("meets", F.explode(F.expr("sequence(0L, parts - 1)")))
    rows = rows.withColumn("i", F.least("side", "meets")).withColumn("j", F.greatest("side", "meets")).drop("parts", "meets")
    tasks = max(8, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks, *(near or [F.col(key)]), "i", "j").sortWithinPartitions(key, "i", "j")
