"""Connected components of an edge table, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import sized, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One stored row per vertex of the edges: v and comp, the smallest vertex of its component.

    Labels move to neighbours and then jump to their label's label, so rounds grow with the logarithm of a
    component's diameter.  Each round is written to the shared folder; only the number of vertices whose
    label changed reaches the driver.  Null ends and self-loops are ignored; a vertex can be of any type
    that has an order.  Labels are broadcast while they are counted to be few.  Beyond that, a vertex with
    very many edges is combined before the shuffle of each minimum, and the joins on it are plain shuffles
    that adaptive execution splits.
    """
    ends = F.array(F.struct(F.col(a).alias("a"), F.col(b).alias("b")), F.struct(F.col(b).alias("a"), F.col(a).alias("b")))
    e = stored(edges.filter(F.col(a) != F.col(b)).select(F.inline(ends)).distinct(), "edges")
    labels = stored(
        e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("comp")),
        "labels",
    )
    n = labels.count()
    while True:
        of_b = sized(labels.select(F.col("v").alias("b"), "comp"), n)
        offered = e.join(of_b, "b").groupBy(F.col("a").alias("v")).agg(F.min("comp").alias("m"))
        near = offered.join(sized(labels, n), "v").select("v", F.col("comp").alias("old"), F.least("comp", "m").alias("near"))
        jump = sized(labels.select(F.col("v").alias("near"), F.col("comp").alias("far")), n)
        moved = stored(near.join(jump, "near").select("v", F.least("near", "far").alias("comp"), "old"), "labels")
        changed = moved.filter("comp <> old").count()
        labels = moved.select("v", "comp")
        if not changed:
            return labels
