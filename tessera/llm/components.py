"""Connected components of an edge table, without gathering links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """Columns node, root (the least node of its component) for every node of ``edges`` (a, b).

    Alternates large-star and small-star steps (Kiveris et al. 2014), in which nodes link to the
    least neighbour, until the edges stand still; each is a grouped minimum and an equi-join, so a
    node with any number of neighbours is pre-aggregated and its join can be split.  They take
    O(log(n) ** 2) rounds.  Every round is cut into the shared checkpoint folder.  Null nodes, loops and repeated edges are allowed;
    no edges give no rows.
    """

    def least(pairs: DataFrame) -> DataFrame:
        found = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return pairs.join(found, "u")

    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = least(large)
        now = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state
