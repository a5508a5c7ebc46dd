"""Connected components by alternating large-star and small-star steps, in DataFrame joins.

Edges point from a node to a smaller one. Large-star hooks every larger neighbour of a node
onto the smallest node it knows; small-star does so with the smaller neighbours. Both keep
components as they are, and after O(log^2 n) rounds each component is a star. Per round the
edge list is written to the shared folder, so no lineage builds up and a lost executor costs
one round at most. Nothing but a count reaches the driver.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.llm.frames import kept_in_table, quoted

MOST_ROUNDS = 100


def _star(pairs: DataFrame) -> DataFrame:
    """Hook each neighbour of a node onto the least node around it. pairs: (node, other)."""
    # The minimum comes from a partial aggregate, so a node with very many neighbours is met as one row per task.
    least = pairs.groupBy("node").agg(F.min("other").alias("least"))
    least = least.select("node", F.least("node", "least").alias("least"))
    return pairs.join(least, "node")


def components(nodes: DataFrame, links: DataFrame, node: str) -> DataFrame:
    """(node, group) for every row of `nodes`; group is the smallest node reachable over `links` (a, b)."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = kept_in_table(edges, "links")
    before = None
    for _ in range(MOST_ROUNDS):
        both = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(
            edges.select(F.col("v").alias("node"), F.col("u").alias("other"))
        )
        large = _star(both).filter("other > node").select(F.col("other").alias("u"), F.col("least").alias("v")).distinct()
        down = large.select(F.col("u").alias("node"), F.col("v").alias("other"))
        hooked = _star(down).filter("other <> least").select(F.col("other").alias("u"), F.col("least").alias("v"))
        kept = down.groupBy("node").agg(F.min("other").alias("v")).select(F.col("node").alias("u"), "v")
        edges = kept_in_table(hooked.unionByName(kept).filter("u <> v").distinct(), "links")
        # Two rounds with the same count and the same sum over hashed edges: nothing changes any more.
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or state[0] == 0:
            break
        before = state
    else:
        raise RuntimeError(f"links have not settled after {MOST_ROUNDS} rounds")
    own = quoted(node)
    return nodes.select(own.alias("node")).join(edges.select(F.col("u").alias("node"), "v"), "node", "left").select(
        "node", F.coalesce("v", "node").alias("group")
    )
