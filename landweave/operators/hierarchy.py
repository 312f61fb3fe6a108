"""Paths, depths, roots and descendants of parent-child rows of unknown depth, cycles included.

Nodes with one parent form chains. Rows are range-partitioned so that families lie together, and
each partition contracts its chains to fragment exits: the first node outside the partition or
with none or several parents. The exits that are chain nodes themselves are the smaller quotient
forest; it is solved in the same way over fewer, wider fragments until no chain leaves its
fragment, and the fragment paths are expanded again by one join a level. A chain that comes back
to itself is a local cycle, one of the quotient a global cycle. What is left is the graph of the
nodes with several parents, small against all; its paths to roots are doubled each round, with
minimum distances, and a node that reaches itself or a marked node is marked as cyclic.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave.session import Stage

#: Rows of one fragment; a partition of fewer rows is not worth a task of its own.
FRAGMENT_ROWS = 250_000


def key(c: Column) -> Column:
    """Node ids are compared without regard to letter case and surrounding blanks."""
    return F.upper(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")))


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follows the pointers node -> (up, steps) within the partition.

    ``open`` tells that ``up`` is a chain node itself; a row whose chain closes on itself gets a
    null ``up``.
    """
    nodes: list[str] = []
    ups: list[str] = []
    steps: list[int] = []
    opened: list[bool] = []
    for b in batches:
        d = b.to_pydict()
        nodes += d["node"]
        ups += d["up"]
        steps += d["steps"]
        opened += d["open"]
    at = {n: i for i, n in enumerate(nodes)}
    done: list[tuple[str | None, int, bool] | None] = [None] * len(nodes)
    for i in range(len(nodes)):
        trail: list[int] = []
        on: set[int] = set()
        j: int | None = i
        while j is not None and done[j] is None and j not in on:
            trail.append(j)
            on.add(j)
            j = at.get(ups[j]) if opened[j] else None
        if j is not None and done[j] is None:  # back on this trail
            for k in trail:
                done[k] = (None, 0, False)
            continue
        end = done[j] if j is not None else None
        for k in reversed(trail):
            if end is None:
                end = (ups[k], steps[k], opened[k])
            elif end[0] is not None:
                end = (end[0], end[1] + steps[k], end[2])
            done[k] = end
    yield pa.RecordBatch.from_pydict(
        {"node": nodes, "up": [x[0] for x in done], "steps": [x[1] for x in done], "open": [x[2] for x in done]},  # type: ignore[index]
        schema=pa.schema([("node", pa.string()), ("up", pa.string()), ("steps", pa.int32()), ("open", pa.bool_())]),
    )


def _chains(pointers: DataFrame, order: list[str], stage: Stage, level: int = 0) -> DataFrame:
    """(node, up, steps) of every chain node: its first ancestor that is none; null ``up`` on or below a cycle.

    ``pointers`` has node, up, steps, open and the columns of ``order``, by which rows of a family
    lie together.
    """
    n = pointers.count()
    parts = max(1, -(-n // (FRAGMENT_ROWS << level)))
    laid = pointers.repartitionByRange(parts, *order) if parts > 1 else pointers.coalesce(1)
    local = stage.write(laid.select("node", "up", "steps", "open").mapInArrow(_contract, "node string, up string, steps int, open boolean"))
    if parts == 1:
        return local.select("node", "up", "steps")
    exits = local.where("open").select(F.col("up").alias("node")).distinct()
    quotient = local.join(exits, "node", "left_semi")
    # One doubling before the next level halves every chain of exits, however the rows were laid.
    over = quotient.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("open").alias("open2"))
    # A null exit of the node above is a cycle above.
    nxt = quotient.join(over, "up", "left").select(
        "node",
        F.when(F.col("open2").isNotNull(), F.col("up2")).otherwise(F.col("up")).alias("up"),
        (F.col("steps") + F.coalesce("steps2", F.lit(0))).cast("int").alias("steps"),
        F.coalesce("open2", "open").alias("open"),
    )
    solved = _chains(stage.write(nxt), ["up", "node"], stage, level + 1)
    top = solved.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.lit(True).alias("hit"))
    return local.join(top, "up", "left").select(
        "node", F.when(F.col("hit"), F.col("up2")).otherwise(F.col("up")).alias("up"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).cast("int").alias("steps")
    )


def edges_of(rows: DataFrame, node: str, parents: str, near: str | None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): distinct nodes with the column ``near``, and distinct (node, parent) of nodes with rows.

    Null and blank ids, and parents without a row, are ignored; parents of a node are those of all
    its rows.
    """
    r = rows.select(key(F.col(node)).alias("node"), F.col(parents).alias("parents"), (F.col(near) if near else F.lit("")).alias("near"))
    r = r.where(F.col("node").isNotNull() & (F.col("node") != ""))
    nodes = r.groupBy("node").agg(F.min("near").alias("near"))
    named = r.select("node", F.explode("parents").alias("parent")).select("node", key(F.col("parent")).alias("parent"))
    named = named.where(F.col("parent").isNotNull() & (F.col("parent") != "")).distinct()
    return nodes, named.join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi").select("node", "parent")


def roots(rows: DataFrame, node: str = "node_id", parents: str = "parent_ids", near: str | None = "case_id") -> DataFrame:
    """(node_id, root_id, depth) of each node and each root above it, depth the fewest steps.

    A root has itself at 0. A node that is on a cycle or has one above it has one row, root ''
    and depth -1. Repeated rows of a node add their parents; ``near`` is a column whose values
    families mostly share and only decides how rows are laid out. An empty table gives no rows.
    """
    stage = Stage(rows.sparkSession)
    nodes, edges = edges_of(rows, node, parents, near)
    edges = stage.write(edges)
    count = edges.groupBy("node").agg(F.count("*").alias("n"), F.min("parent").alias("parent"))
    kinds = stage.write(nodes.join(count, "node", "left").select("node", "near", F.coalesce("n", F.lit(0)).alias("n"), "parent"))
    chain = kinds.where(F.col("n") == 1)
    is_chain = chain.select(F.col("node").alias("up"), F.lit(True).alias("open"))
    pointers = chain.select("node", "near", F.col("parent").alias("up")).join(is_chain, "up", "left")
    pointers = stage.write(pointers.select("node", "up", F.lit(1).alias("steps"), F.coalesce("open", F.lit(False)).alias("open"), "near"))
    chains = stage.write(_chains(pointers, ["near", "node"], stage))
    stage.drop(pointers)

    # Steps of nodes with several parents to the next such node or root.
    many = kinds.where(F.col("n") > 1).select("node")
    at = chains.select(F.col("node").alias("parent"), "up", "steps", F.lit(True).alias("hit"))
    hop = (
        edges.join(many, "node", "left_semi").join(at, "parent", "left")
        .select("node", F.when(F.col("hit"), F.col("up")).otherwise(F.col("parent")).alias("up"), (F.coalesce("steps", F.lit(0)) + 1).cast("long").alias("steps"))
    )
    # A null or own `up` is a cycle; so is every later meeting with a marked node.
    reach = stage.write(hop.groupBy("node", "up").agg(F.min("steps").alias("steps")))
    open_ = many.select(F.col("node").alias("up"))
    marked = stage.write(reach.where(F.col("up").isNull() | (F.col("up") == F.col("node"))).select("node").distinct())
    # Round k leaves ways of 2**k such nodes; longer than all of them together, a way has met a cycle.
    longest, nodes_left = 1, many.count()
    while True:
        reach2 = stage.write(reach.join(marked, "node", "left_anti"))
        stage.drop(reach)
        reach = reach2
        inner = reach.join(open_, "up", "left_semi")
        if inner.isEmpty():
            break
        if longest > nodes_left:
            bad = inner.select("node").distinct()
        else:
            bad = inner.join(marked.select(F.col("node").alias("up")), "up", "left_semi").select("node").distinct()
        longest *= 2
        over = reach.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"))
        # Nodes whose way leads to a marked node find no continuation there; they are marked below.
        nxt = (
            reach.join(over, "up", "left")
            .select("node", F.coalesce("up2", "up").alias("up"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"))
            .groupBy("node", "up").agg(F.min("steps").alias("steps"))
        )
        nxt = stage.write(nxt)
        more = stage.write(marked.union(bad).union(nxt.where(F.col("up") == F.col("node")).select("node")).distinct())
        stage.drop(reach, marked)
        reach, marked = nxt, more
    above = reach.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"))
    marks = marked.select(F.col("node").alias("up"), F.lit(True).alias("bad"))
    below = (
        chains.join(marks, "up", "left").where(F.col("up").isNotNull() & F.col("bad").isNull())
        .join(above, "up", "left").select("node", F.coalesce("up2", "up").alias("root"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("depth"))
    )
    cyclic = chains.join(marks, "up", "left").where(F.col("up").isNull() | F.col("bad")).select("node").union(marked)
    found = (
        below.union(reach.select("node", "up", "steps"))
        .union(kinds.where(F.col("n") == 0).select("node", "node", F.lit(0)))
        .union(cyclic.select("node", F.lit(""), F.lit(-1)))
    )
    return found.select(F.col("node").alias("node_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"))


def paths(rows: DataFrame, found: DataFrame, node: str = "node_id", parents: str = "parent_ids") -> DataFrame:
    """(node_id, root_id, depth, path) with the path from root to node, the least of the shortest by bytes.

    ``found`` is the result of ``roots``. Every node starts with itself and a pointer to its parent on
    the way to each root; a round puts the parent's piece before its own and takes over the parent's
    pointer, so pieces double and the rounds are logarithmic in the depth. Nodes without a sound
    ancestry have an empty path. A node with several rows or repeated parents has each path once.
    """
    stage = Stage(rows.sparkSession)
    _, edges = edges_of(rows, node, parents, None)
    edges, found = stage.write(edges), stage.write(found)
    # The parent through which the shortest way leads: one step nearer to the same root.
    up = found.select(F.col("node_id").alias("parent"), "root_id", (F.col("depth") + 1).alias("depth"))
    via = (
        found.where(F.col("depth") > 0).join(edges.withColumnRenamed("node", "node_id"), "node_id").join(up, ["parent", "root_id", "depth"])
        .groupBy("node_id", "root_id", "depth").agg(F.min("parent").alias("up"))
    )
    piece = stage.write(via.select("node_id", "root_id", "depth", "up", F.array("node_id").alias("piece")))
    while True:
        open_ = piece.where(F.col("up") != F.col("root_id"))
        if open_.isEmpty():
            break
        over = piece.select(F.col("node_id").alias("up"), "root_id", F.col("up").alias("up2"), F.col("piece").alias("before"))
        longer = open_.join(over, ["up", "root_id"]).select("node_id", "root_id", "depth", F.col("up2").alias("up"), F.concat("before", "piece").alias("piece"))
        nxt = stage.write(piece.where(F.col("up") == F.col("root_id")).unionByName(longer))
        stage.drop(piece)
        piece = nxt
    out = found.where(F.col("depth") == 0).select("node_id", "root_id", "depth", F.array("node_id").alias("path"))
    out = out.union(piece.select("node_id", "root_id", "depth", F.concat(F.array("root_id"), "piece")))
    return out.union(found.where(F.col("depth") < 0).select("node_id", "root_id", "depth", F.array().cast("array<string>")))


def descendants(rows: DataFrame, found: DataFrame, node: str = "node_id", parents: str = "parent_ids") -> DataFrame:
    """(node_id, descendant_id, steps): every sound node with each node below it through any parents, steps the fewest.

    ``found`` is the result of ``roots``. A round composes the pairs of exactly ``span`` steps with
    those of at most as many, so ``span`` doubles and no pair is built from all nodes between. What
    is above a sound node is sound, so the edges have no cycle and the rounds end.
    """
    stage = Stage(rows.sparkSession)
    _, edges = edges_of(rows, node, parents, None)
    sound = found.where(F.col("depth") >= 0).select(F.col("node_id").alias("node")).distinct()
    known = stage.write(edges.join(sound, "node", "left_semi").select(F.col("parent").alias("ancestor"), "node", F.lit(1).alias("steps")))
    span = 1
    while True:
        far = known.where(F.col("steps") == span).select("node", F.col("ancestor").alias("mid"))
        over = known.select(F.col("node").alias("mid"), "ancestor", "steps")
        longer = far.join(over, "mid").groupBy("ancestor", "node").agg((F.min("steps") + span).cast("int").alias("steps"))
        # Pairs already known have at most ``span`` steps.
        new = stage.write(longer.join(known.select("ancestor", "node"), ["ancestor", "node"], "left_anti"))
        if new.isEmpty():
            break
        known = known.union(new)
        span *= 2
    return known.select(F.col("ancestor").alias("node_id"), F.col("node").alias("descendant_id"), "steps")
