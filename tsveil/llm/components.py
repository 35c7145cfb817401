"""Connected components of a table of edges, by repeated hooking and contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsveil.llm.base import Workspace


def components(edges: DataFrame, space: Workspace, name: str) -> DataFrame:
    """(node, c) for each node of edges (x, y, both long): c is the least node of its component.

    Each pass lets every label that has a smaller neighbour take its smallest one, follows such steps twice, and
    renames the edges; those inside a label go. Labels only fall, so no cycle arises, and passes grow with the
    logarithm of the nodes.
    """
    labels = space.save(
        edges.select(F.explode(F.array("x", "y")).alias("node")).distinct().select("node", F.col("node").alias("c")),
        f"{name}-l0",
    )
    left, step = edges.select("x", "y"), 0
    while True:
        step += 1
        left = space.save(
            left.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(),
            f"{name}-e{step}",
        )
        if left.isEmpty():
            return labels
        hooks = space.save(left.groupBy(F.col("y").alias("of")).agg(F.min("x").alias("to")), f"{name}-h{step}")
        for jump in range(2):
            on = hooks.select(F.col("of").alias("of2"), F.col("to").alias("to2"))
            hooks = hooks.join(on, F.col("to") == F.col("of2"), "left").select("of", F.coalesce("to2", "to").alias("to"))
            if jump == 0:
                hooks = space.save(hooks, f"{name}-j{step}")
        hooks = space.save(hooks, f"{name}-k{step}")
        labels = space.save(
            labels.join(hooks, F.col("c") == F.col("of"), "left").select("node", F.coalesce("to", "c").alias("c")),
            f"{name}-l{step}",
        )
        a, b = hooks.select(F.col("of").alias("ox"), F.col("to").alias("tx")), hooks.select(F.col("of").alias("oy"), F.col("to").alias("ty"))
        left = (
            left.join(a, F.col("x") == F.col("ox"), "left")
            .join(b, F.col("y") == F.col("oy"), "left")
            .select(F.coalesce("tx", "x").alias("x"), F.coalesce("ty", "y").alias("y"))
        )
