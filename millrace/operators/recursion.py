"""Walks over parent pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import cut


def terminal_ancestors(edges: DataFrame, node: str, parent: str, depth: int = 60) -> DataFrame:
    """node, root: for each node the last ancestor on its way up; nodes on a cycle have none.

    By pointer doubling: after k rounds a pointer spans 2^k steps, so a tree of depth d takes log2(d) joins.
    """
    links = edges.select(F.col(node).alias("node"), F.col(parent).alias("at")).where("node is not null").distinct()
    state = links.select("node", F.coalesce("at", "node").alias("at"), (F.col("at").isNull() | (F.col("at") == F.col("node"))).alias("done"))
    known = state.select(F.col("node").alias("n")).distinct()
    state = cut(state.join(known, F.col("at") == F.col("n"), "left").select("node", "at", (F.col("done") | F.col("n").isNull()).alias("done")))
    for _ in range(depth):
        if not state.where(~F.col("done")).take(1):
            break
        step = state.select(F.col("node").alias("n"), F.col("at").alias("to"), F.col("done").alias("end"))
        state = cut(state.join(step, F.col("at") == F.col("n"), "left").select("node", F.when(F.col("done"), F.col("at")).otherwise(F.col("to")).alias("at"), (F.col("done") | F.coalesce("end", F.lit(True))).alias("done")))
        moving = state.where(~F.col("done"))
        if not moving.where("node != at").take(1):  # what is left turns in a circle
            break
    return state.where("done").select("node", F.col("at").alias("root"))
