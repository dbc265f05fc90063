"""Connected components of an edge table by Spark joins: hooking to smaller labels and shortcutting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlytics.llm.common import stored


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Smallest vertex reachable from each vertex of the edges ``(a, b)``: columns ``v, label``.

    After a limited number of ``rounds`` vertices with one label are connected, but connected ones may still differ.

    Each round a vertex's root takes the smallest label among its neighbours' labels, and labels then
    point to their label's label; the number of rounds is logarithmic on usual graphs. Every round
    is written to the shared folder; nothing but the number of changes comes to the driver. Groupings
    are partial sums or joins on a side with one row per key, so a hub is not gathered.
    """
    edges = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
                    .select("v", F.least("v", "m").alias("label")), "labels")
    while rounds is None or rounds > 0:
        near = (edges.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v"))
                .agg(F.min("label").alias("m")))
        grown = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "m").alias("m"))
        roots = grown.groupBy(F.col("old").alias("r")).agg(F.min("m").alias("rm"))
        hooked = (grown.join(roots, F.col("old") == F.col("r"), "left")
                  .select("v", "old", F.least("m", F.coalesce("rm", "m")).alias("label")))
        up = labels.select(F.col("v").alias("p"), F.col("label").alias("pl"))
        after = stored(hooked.join(up, F.col("label") == F.col("p"), "left")
                       .select("v", "old", F.least("label", F.coalesce("pl", "label")).alias("label")), "labels")
        labels = after.select("v", "label")
        if rounds is None and not after.where("old <> label").limit(1).count():
            break
        rounds = None if rounds is None else rounds - 1
    return labels
