"""Connected components of a link table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, small

#: Rows of one key beyond which a join deals them over several tasks.
HEAVY = 5_000


def heavy_keys(rows: DataFrame, key: str, heavy: int | None = None) -> DataFrame | None:
    """hk, parts: the keys with more than `heavy` rows (so at most one in `heavy` rows has one), or None."""
    heavy = heavy or HEAVY
    found = rows.groupBy(key).agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > heavy)
    found = materialise(found.select(F.col(key).alias("hk"), F.ceil(F.col("m") / heavy).cast("int").alias("parts")), "heavy")
    return None if found.isEmpty() else small(found)


def spread_join(rows: DataFrame, table: DataFrame, keys: dict[str, str], heavy: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows joined with table (unique on its keys) on rows' keys -> table's keys; rows of a heavy first key are dealt over its parts.

    The table's row of such a key is copied into each part, so no task gets more of one key than HEAVY rows.
    """
    same = [F.col(a) == F.col(b) for a, b in keys.items()]
    if heavy is None:
        return rows.join(table, same, how)
    mine, theirs = next(iter(keys.items()))
    dealt = rows.join(heavy, F.col(mine) == F.col("hk"), "left").withColumn("__s", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64(*rows.columns), F.col("parts"))).otherwise(0).cast("int")).drop("hk", "parts")
    copied = table.join(heavy, F.col(theirs) == F.col("hk"), "left").withColumn("__t", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("hk", "parts")
    return dealt.join(copied, [*same, F.col("__s") == F.col("__t")], how).drop("__s", "__t")


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> node, label: the smallest node that a link path reaches. Nodes without links don't appear.

    Each round takes the least label among a node and its neighbours and then the label of that label, so the
    rounds grow with the logarithm of a component's width. Every round is a written table; nothing is collected. A node with very
    many links, or a label with very many nodes, is dealt over several tasks.
    """
    links = materialise(links.select("a", "b").filter("a <> b").distinct(), "links")
    both = links.union(links.select("b", "a"))
    hubs = heavy_keys(both, "b")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = spread_join(both, labels, {"b": "node"}, hubs).groupBy("a").agg(F.min("label").alias("m"))
        least = materialise(labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label")), "least")
        used = least.select(F.col("label").alias("l1")).distinct().join(labels, F.col("l1") == F.col("node")).filter("label < l1").select(F.col("l1").alias("n2"), F.col("label").alias("l2"))
        jumps = materialise(used, "jumps")
        after = least
        if not jumps.isEmpty():
            after = spread_join(least, jumps, {"label": "n2"}, heavy_keys(least, "label"), "left").select("node", "old", F.coalesce("l2", "label").alias("label"))
        after = materialise(after, "labels")
        discard(labels, least, jumps)
        if after.filter("old <> label").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")
        labels._ridgecast_path = after._ridgecast_path
