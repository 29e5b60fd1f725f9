"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialise


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for every id of ``edges`` (columns a, b, of one orderable type): comp is the least id reachable.

    Each round takes the least label among neighbours, then the label of that label,
    so long chains shorten by doubling; it ends when nothing changes.  Rounds are cut at tables in
    the shared folder.  A node with very many links is one label on the
    aggregated side of the join, whose link side AQE may split.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                       .where("a <> b").distinct(), "links")
    label = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("comp")), "labels")
    while True:
        near = (both.join(label.select(F.col("id").alias("b"), "comp"), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near")))
        hooked = label.join(near, "id").select("id", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        up = label.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        after = materialise(hooked.join(up, "comp", "left")
                            .select("id", "was", F.least("comp", F.coalesce("up", "comp")).alias("comp")), "labels")
        drop(label)
        label = after
        if label.where("comp <> was").limit(1).count() == 0:
            drop(both)
            return label.select("id", "comp")
