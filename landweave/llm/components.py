"""Groups of records that pairwise match decisions link directly or through others.

Minimum labels are propagated over two hops, which leaves at most half of the nodes as local
minima, whatever the shape of the graph; pointer jumping then hangs every node under its local
minimum, and the edges between minima are the next, smaller graph. Each round is written to the
shared folder; the rounds end when no label changes, that is when no edge is left. All steps are
equi-joins and map-side combined minima on record ids, so a hub that holds a third of all pairs
is reduced before it is shuffled, and nothing is gathered in one task or in the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave.session import Stage


def links(pairs: DataFrame, a: str, b: str, is_match: Column) -> DataFrame:
    """Distinct undirected links (u < v) of the rows where ``is_match`` is true.

    Null and empty ids name no record and give no link, neither does a record paired with
    itself; a null decision is no match. Repeats and both orientations give one link.
    """
    x, y = F.col(a), F.col(b)
    return (
        pairs.where(is_match & x.isNotNull() & y.isNotNull() & (x != y) & (x != "") & (y != ""))
        .select(F.least(x, y).alias("u"), F.greatest(x, y).alias("v"))
        .distinct()
    )


def _two_hop_minimum(edges: DataFrame, stage: Stage) -> DataFrame:
    """(node, label): the least node within two hops, the node itself included."""
    both = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("e")).select("e.*")
    one = stage.write(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")))
    two = both.join(one.select(F.col("x").alias("y"), "m"), "y").groupBy("x").agg(F.min("m").alias("label"))
    out = stage.write(two.select(F.col("x").alias("node"), "label"))
    stage.drop(one)
    return out


def _jump(parent: DataFrame, stage: Stage) -> DataFrame:
    """Hang every node under the root of its tree; a root's label is itself."""
    while True:
        up = parent.select(F.col("node").alias("label"), F.col("label").alias("over"))
        nxt = stage.write(parent.join(up, "label").select("node", F.col("over").alias("label"), (F.col("over") != F.col("label")).alias("moved")))
        stage.drop(parent)
        parent = nxt
        if nxt.where("moved").isEmpty():
            return nxt


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v), u < v, distinct.

    ``label`` is the least node of the component, by bytes. No edges give no rows.
    """
    stage = Stage(edges.sparkSession)
    edges = stage.write(edges)
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        tree = _jump(_two_hop_minimum(edges, stage), stage).select("node", "label")
        levels.append(tree)
        at_u = tree.select(F.col("node").alias("u"), F.col("label").alias("lu"))
        at_v = tree.select(F.col("node").alias("v"), F.col("label").alias("lv"))
        nxt = stage.write(
            edges.join(at_u, "u").join(at_v, "v").where(F.col("lu") != F.col("lv"))
            .select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v")).distinct()
        )
        stage.drop(edges)
        edges = nxt
    if not levels:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    final = levels[-1]
    for tree in reversed(levels[:-1]):
        over = final.select(F.col("node").alias("label"), F.col("label").alias("top"))
        final = tree.join(over, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return final


def match_groups(pairs: DataFrame) -> DataFrame:
    """(record_id, group_id) of every record that a true pair decision links to another."""
    found = connected_components(links(pairs, "record_id_a", "record_id_b", F.col("is_match")))
    return found.select(F.col("node").alias("record_id"), F.col("label").alias("group_id"))
