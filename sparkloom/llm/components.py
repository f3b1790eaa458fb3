"""Connected components of a link table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table


def components(links: DataFrame) -> DataFrame:
    """node and component (its least node), for every node of links (x, y).

    A round takes the least label among a node and its neighbours, then the
    label of that label, so that chains shorten by doubling. Each round's labels
    are a table in the shared folder; nothing but a count reaches the driver.
    """
    both = table(links.select("x", "y").union(links.select("y", "x")).where("x <> y").distinct(), "links")
    labels = table(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("x"), F.min("y")).alias("component")), "labels")
    while True:
        near = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("component").alias("_n"))
        step = labels.join(near, F.col("node") == F.col("x")).select("node", F.least("component", "_n").alias("_c"), F.col("component").alias("_old"))
        jump = labels.select(F.col("node").alias("_at"), F.col("component").alias("_to"))
        new = table(step.join(jump, F.col("_c") == F.col("_at")).select("node", F.least("_c", "_to").alias("component"), "_old"), "labels")
        if not new.where("component <> _old").limit(1).count():
            return new.select("node", "component")
        labels = new.select("node", "component")
