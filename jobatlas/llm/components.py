"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobatlas.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; the root is some node of its component.

    Each round every node moves to the member of its closed neighbourhood that comes first
    in a fresh pseudo-random order, and edges are redrawn between the nodes moved to.  The
    random order shrinks paths and stars alike by a constant factor a round, so rounds grow
    with the logarithm of the component size.  A node of any degree is met by a partial
    minimum, and every round is written to the shared folder.
    """
    edges = cut_lineage(edges.select("a", "b"), "cc-edges")
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        salt = len(moves)

        def rank(c: str):
            return F.struct(F.xxhash64(F.col(c), F.lit(salt)).alias("r"), F.col(c).alias("v"))

        both = edges.union(edges.select("b", "a"))
        step = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("m"))
        step = step.select("node", F.least("m", rank("node"))["v"].alias("root"))
        step = cut_lineage(step, "cc-step")
        moves.append(step)
        to_a = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        to_b = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = edges.join(to_a, "a").join(to_b, "b").where("ra <> rb")
        edges = cut_lineage(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
                            "cc-edges")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = moves[0]
    for step in moves[1:]:
        nxt = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = out.join(nxt, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out
