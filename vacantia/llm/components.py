"""Connected components of an edge table, in a number of rounds that grows with the log of a path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.exchange import partitions
from vacantia.session import materialize

#: Rows of a table of edges or labels for each file that it is written to, and the least number of files.
FILE_ROWS, FILES = 1 << 16, 8


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the component's least node.

    Each round takes the least label among a node and its neighbours, then the label's own label.
    Labels are aggregated, never collected per node, and each round's table is written to the
    shared folder, in a number of files that goes by the edges: rounds over few edges cost the
    driver few tasks, whatever the number of shuffle partitions. Repeated edges and loops change
    nothing; edges with a null end are left out.
    """
    given = edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = materialize(given.union(given.select("b", "a")).distinct(), "edges")
    files = min(partitions(edges), max(FILES, both.count() // FILE_ROWS))
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    labels = materialize(labels.coalesce(files), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(near, labels.node == near.a, "left").select(
            "node", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root")
        )
        lower = materialize(lower.coalesce(files), "labels")
        above = lower.select(F.col("node").alias("up"), F.col("root").alias("top"))
        jumped = lower.join(above, lower.root == above.up, "left").select("node", "old", F.least("root", F.coalesce("top", "root")).alias("root"))
        jumped = materialize(jumped.coalesce(files), "labels")
        labels = jumped.select("node", "root")
        if jumped.where("root <> old").isEmpty():
            return labels
