"""Connected components of links between 64-bit node keys, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilworks.llm.common import drop, written


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for every node of links (a, b); root is the least node that is reachable.

    Each round, a node's label becomes the least among its own and its neighbours' and then that label's own label, so
    labels travel ever longer ways. Counts are partial before each shuffle, so a node with many links is no burden.
    A round is written to the shared folder before the next one reads it, and then the one before goes.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        # a root that has met a smaller label hands it on to all that it labels
        moved = hooked.groupBy(F.col("was").alias("root_was")).agg(F.min("root").alias("best"))
        new = hooked.join(moved, F.col("was") == F.col("root_was")).select("node", "was", F.least("root", "best").alias("root"))
        jump = new.select(F.col("node").alias("via"), F.col("root").alias("beyond"))
        new = new.join(jump, F.col("root") == F.col("via"), "left").select("node", "was", F.least("root", F.coalesce("beyond", "root")).alias("root"))
        new = written(new, "labels")
        drop(labels)
        labels = new
        if new.filter(F.col("was") != F.col("root")).limit(1).count() == 0:
            break
    else:
        raise RuntimeError("components did not settle")
    drop(both)
    return labels.select("node", "root")
