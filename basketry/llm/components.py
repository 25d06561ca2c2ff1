"""Connected components of a link table, as joins over written tables.

Each round points every node at its smallest neighbour (or itself), shortens
the pointers twice and contracts the links; links within one component
vanish, so the link table shrinks by at least half in nodes per round until it
is empty.  The rounds' pointers are then composed from the last to the first.
No link list or component ever sits in one task: minima are pre-aggregated,
joins run between written tables, so AQE splits their skewed keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has a link; the nodes of a component share one root.

    Self-links, repeated links and either direction are allowed; a link with a
    null end is no link.  An empty table gives an empty table.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = written(pairs.union(pairs.select("b", "a")).distinct(), "links")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        up = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("up"))
                     .select("node", "up"), "pointers")
        for _ in range(2):
            higher = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            up = written(up.join(higher, "up").select("node", F.col("top").alias("up")), "pointers")
        rounds.append(up)
        left, right = up.toDF("a", "ra"), up.toDF("b", "rb")
        edges = written(edges.join(left, "a").join(right, "b").where("ra <> rb")
                        .select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds.pop().toDF("node", "root")
    while rounds:
        top = out.toDF("up", "top")
        out = written(rounds.pop().join(top, "up", "left")
                      .select("node", F.coalesce("top", "up").alias("root")), "roots")
    return out
