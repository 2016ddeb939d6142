"""Connected components of a link table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.session import checkpointed


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b): label is the smallest node of its component.

    Alternates two steps until no link changes: every node ties its larger neighbours to the smallest
    node it knows, then its smaller ones. Links shrink to stars in a logarithmic number of rounds; each
    round is written to the checkpoint folder. No node's neighbours are gathered: only their minimum
    is, and it is joined back. Null ends and loops are ignored; no links give no rows.
    """
    pairs = checkpointed(
        edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").select(F.col("v").alias("x"), "m").where("x != m")
            .unionByName(low.select(F.col("u").alias("x"), "m"))
            .select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()
        )
        after = checkpointed(small)
        same = after.exceptAll(pairs).isEmpty() and pairs.exceptAll(after).isEmpty()
        pairs = after
        if same:
            break
    label = pairs.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return label.unionByName(roots)
