"""Groups of records that matched pairs link: minimum labels, pointer jumping and contraction, until no edge is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landweave.session import Stage


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, label) of every node, label the least node of its group; ``pairs`` has u and v. A node without pairs has its own label.

    Each round hangs a node under its least neighbour if that is less than itself, follows these
    pointers to the end, and goes on with the edges between ends only; a round leaves fewer edges
    and its tables are written, so lineage stays short. Only nodes with pairs take part.
    """
    stage = Stage(nodes.sparkSession)
    edges = stage.write(pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    trees: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other")), F.struct(F.col("v").alias("node"), F.col("u").alias("other")))))
        tree = stage.write(both.groupBy("node").agg(F.min("other").alias("label")).select("node", F.least("node", "label").alias("label")))
        while True:
            over = tree.select(F.col("node").alias("label"), F.col("label").alias("over"))
            nxt = stage.write(tree.join(over, "label").select("node", F.col("over").alias("label"), (F.col("over") != F.col("label")).alias("moved")))
            stage.drop(tree)
            tree = nxt
            if nxt.where("moved").isEmpty():
                break
        trees.append(tree.select("node", "label"))
        ends = [tree.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "uv"]
        nxt = stage.write(edges.join(ends[0], "u").join(ends[1], "v").where("lu <> lv").select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v")).distinct())
        stage.drop(edges)
        edges = nxt
    found = nodes.select("node").distinct().withColumn("label", F.col("node"))
    for tree in trees:
        over = tree.select(F.col("node").alias("label"), F.col("label").alias("top"))
        found = found.join(over, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return found
