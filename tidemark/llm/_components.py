"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import detached

#: Links left below which a round joins by broadcast: the driver builds several such tables a round.
SMALL = 16_000


def connected_components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """Rows (node, component) for each node of links (a, b), about so many; component is its least reachable node.

    Every round hooks each node to its least neighbour, follows those pointers, and
    contracts the links to what is left; the number of rounds grows with the
    logarithm of the longest chain.  Nothing is collected.  What is left is counted
    each round and broadcast to the joins once it is small.
    """
    edges = detached(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct(), rows)
    labels = None
    while n_edges := edges.count():
        nodes = 2 * n_edges
        # The counted edges bound the nodes left: every table below has at most twice as many rows.
        small = F.broadcast if n_edges <= SMALL else lambda df: df
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooked = detached(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p")), nodes)
        up = hooked.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        parent = detached(hooked.join(small(up), "p").select("u", F.col("pp").alias("p")), nodes)
        at = parent.select(F.col("u").alias("component"), F.col("p").alias("to"))
        if labels is None:
            labels, all_nodes = parent.select(F.col("u").alias("node"), F.col("p").alias("component")), nodes
        else:
            labels = detached(labels.join(small(at), "component", "left").select("node", F.coalesce("to", "component").alias("component")), all_nodes)
        ends = parent.select(F.col("u").alias("v"), F.col("p").alias("q"))
        left = edges.join(small(parent), "u").select("p", "v").join(small(ends), "v").select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v"))
        edges = detached(left.where("u <> v").distinct(), n_edges)
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component")).where("false")
    return labels
