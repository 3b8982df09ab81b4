"""Connected components of a link table, by smallest reachable id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled


def smallest_reachable(links: DataFrame) -> DataFrame:
    """``links``: pairs of longs ``a``, ``b``, in either order. Returns
    ``node, root`` for every node that has a link, ``root`` being the smallest
    node reachable from it.

    Each round takes, for every node, the least of its own label, its
    neighbours' labels and the label of its label, so labels travel along
    shortcuts and long chains need few rounds. A label is treated as one more
    link from the node it names, so a round is one join and one pre-aggregated
    minimum, written to the shared checkpoint folder. A node with very many links
    is a hot key of a join between two plain exchanges, which AQE splits.
    """
    both = settled(links.where("a <> b").select("a", "b").union(links.where("a <> b").select("b", "a"))
                   .distinct().toDF("src", "dst"))
    labels = settled(both.select(F.col("src").alias("node")).distinct().withColumn("root", F.col("node")))
    while True:
        along = both.union(labels.where("root <> node").select("root", "node"))
        told = (along.join(labels, F.col("src") == F.col("node"))
                .select(F.col("dst").alias("node"), "root", F.lit(None).cast("long").alias("own")))
        labels = settled(told.union(labels.withColumn("own", F.col("root")))
                         .groupBy("node").agg(F.min("root").alias("root"), F.max("own").alias("own")))
        if not labels.where("root < own").limit(1).count():
            return labels.select("node", "root")
        labels = labels.select("node", "root")
