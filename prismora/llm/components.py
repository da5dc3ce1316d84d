"""Connected components of a link table, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rounds after which the job gives up; each at least doubles the distance that a label has come.
ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id reachable from each id that has a link (a, b).

    Each round takes the least label among neighbours and then the label of the label, so a chain's length costs
    its logarithm. Every round is written to the shared folder.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    for _ in range(ROUNDS):
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        nearer = labels.join(near, "id", "left").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        own = labels.select(F.col("id").alias("label"), F.col("label").alias("jump"))
        after = cut(nearer.join(own, "label", "left").select("id", "was", F.least("label", "jump").alias("label")), "labels")
        labels = after.select("id", "label")
        if after.where("label <> was").isEmpty():
            return labels
    raise RuntimeError("components didn't settle")
