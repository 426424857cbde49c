"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def components(links: DataFrame) -> DataFrame:
    """(v, component) for every node of the edges (a, b): the smallest node that can be reached.

    Each round takes over the smallest name among the neighbours and then the name of that name, so a path is halved per
    round and stars are done at once. Names only shrink; the rounds end when none does. Every round is stored.
    """
    both = links.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(links.select(F.col("b").alias("v"), F.col("a").alias("w")))
    names = durable(both.groupBy("v").agg(F.least("v", F.min("w")).alias("component")))
    edges = durable(both)
    while True:
        held = names.select(F.col("v").alias("w"), F.col("component").alias("_c"))
        lower = edges.join(held, "w").groupBy("v").agg(F.min("_c").alias("_least"))
        moved = names.join(lower, "v").select("v", F.col("component").alias("_old"), F.least("component", "_least").alias("_mid"))
        jump = moved.select(F.col("v").alias("_at"), F.col("_mid").alias("_to"))
        new = durable(moved.join(jump, F.col("_mid") == F.col("_at")).select("v", F.col("_to").alias("component"), (F.col("_to") < F.col("_old")).alias("_fell")))
        names = new.select("v", "component")
        if new.where("_fell").isEmpty():
            return names
