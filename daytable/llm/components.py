"""Connected components of a graph given as a table of edges."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytable.llm.common import cut

#: Edges up to which their nodes, 16 bytes each, are broadcast.
SMALL = 50_000
FEW_TASKS = 8


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of edges (a, b): label is the smallest node that it is connected with.

    Large-star and small-star steps take turns until nothing changes: every node with a larger neighbour points it to the
    smallest node it knows. Neighbourhoods are only ever reduced to their minimum, which combines before the shuffle, and
    each step's edges are cut into the shared folder. Loops and repeated edges do no harm.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    state = None
    while True:
        last, state = state, tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        few = (lambda df: df.coalesce(FEW_TASKS)) if state[0] <= SMALL else lambda df: df  # else tasks outnumber the edges
        small = (lambda df: F.broadcast(few(df))) if state[0] <= SMALL else lambda df: df  # at most two nodes for each edge
        now = few(now)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.min("a")).alias("m"))
        large = both.join(small(least), F.col("a") == F.col("u")).filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        met = large.join(small(down), F.col("a") == F.col("u"))
        met = met.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        now = cut(few(met.filter("a <> b").distinct()))
