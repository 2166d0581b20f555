"""Connected components by alternating large-star and small-star rounds, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage_table


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b) -> (node, component): the smallest node reachable. Only nodes with an edge appear.

    Each round re-links neighbours to the smallest one seen, so chains shrink geometrically; a round's
    edges are written to the shared folder, as is the result, a table of stage_table. Null ends and self links are ignored; no edges give no rows.
    Minimum per node is a partial aggregate and joins back on the node, so a hub is no single task.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stage_table(e, "links")
    seen = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).distinct()
        before, e = e, stage_table(small, "links")
        discard(before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
    else:
        raise RuntimeError("components did not converge")
    parts = stage_table(e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct()), "parts")
    discard(e)
    return parts
