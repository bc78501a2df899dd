"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, materialise, shuffle_partitions

#: Rows of links or labels in one partition; labels are broadcast up to this many (16 bytes each), joined by a shuffle beyond.
ROWS = 250_000


def connected_components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """node and component (its smallest node) for every end of a link (a, b). rows: of the table that the links stem from, if known.

    Labels spread to neighbours and then jump to their label's label, so stars take two rounds and
    chains a logarithmic number. Labels are combined before each shuffle. Beyond ROWS links a hub's rows meet its label in a
    sort-merge join, which adaptive execution splits.
    """
    spark = links.sparkSession
    keep = materialise if rows is None else lambda df: kept(df, rows)
    both = keep(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    n = both.count()
    parts = max(1, min(shuffle_partitions(spark), -(-n // ROWS)))
    small = F.broadcast if n <= ROWS else lambda df: df  # there are at most as many labels as links
    both = both.coalesce(parts)
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")).coalesce(parts))
    while True:
        heard = both.join(small(labels), both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        spread = heard.join(small(labels), "node").select("node", "component", F.least("component", "heard").alias("next"))
        roots = labels.select(F.col("node").alias("next"), F.col("component").alias("root"))
        jumped = spread.join(small(roots), "next", "left").select("node", F.col("component").alias("was"), F.least("next", F.coalesce("root", "next")).alias("component"))
        jumped = materialise(jumped.coalesce(parts))
        changed = jumped.where("component <> was").limit(1).count()
        labels = jumped.select("node", "component")
        if not changed:
            return labels
