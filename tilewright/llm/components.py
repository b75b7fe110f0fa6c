"""Connected components of an edge table, by rounds of joins with written tables between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """``id, component_id`` (the smallest id of the component) of every id in ``edges(a, b)``.

    Alternates two steps until nothing changes: every vertex links its larger
    neighbours to its smallest one, then its smaller neighbours to the smallest.
    Star centres with many links are summed by partial aggregation.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(now, "edges")
    state = None
    while True:
        # Large star: links of both directions, larger neighbours go to the minimum of the neighbourhood.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: of each vertex's smaller neighbours, all go to the smallest.
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, now = now, materialize(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(before)
        # Both steps keep the sum of an edge's ends from growing; equal sums and counts mean that nothing moved.
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    roots = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component_id"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(roots)
