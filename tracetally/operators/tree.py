"""Tree computations by pointer doubling.

Round i joins every node to its ancestor 2^i levels up, so a tree of depth d
needs about log2(d) rounds of one equi-join (plus one aggregation for sums
towards the root) over n rows, instead of d rounds or a table of all
ancestor-descendant pairs. Finished nodes (no ancestor left at that distance)
drop out of the join. Each round is cut with a durable checkpoint.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import cut


def _rounds(n: int) -> int:
    """Doublings after which every acyclic tree of n nodes is finished."""
    return max(1, math.ceil(math.log2(n + 1)) + 1)


def fold_ancestors(
    nodes: DataFrame,
    node: str,
    parent: str,
    state: dict[str, Column],
    combine: dict[str, "callable"],
) -> DataFrame:
    """Fold an associative state over the path root -> node (the node included).

    ``state`` gives each node's own value, ``combine[name](upper, lower)`` joins
    two adjacent stretches of the path. A parent that does not exist ends the
    path and sets ``missing``. Nodes on or below a cycle get ``cyclic``.
    Returns node, the folded state, root, depth, missing, cyclic.
    """
    names = list(state)
    base = nodes.select(
        F.col(node).alias("_node"),
        F.col(parent).alias("_up"),
        *[c.alias(n) for n, c in state.items()],
    )
    known = base.select(F.col("_node").alias("_known"))
    cur = base.join(known, F.col("_up") == F.col("_known"), "left").select(
        "_node",
        F.col("_known").alias("_jump"),
        (F.col("_up").isNotNull() & F.col("_known").isNull()).alias("missing"),
        F.lit(0).cast("long").alias("depth"),
        F.col("_node").alias("root"),
        *names,
    )
    cur = cut(cur)
    total = cur.count()
    done: DataFrame | None = None
    for i in range(_rounds(total)):
        active = cur.filter(F.col("_jump").isNotNull())
        if active.isEmpty():
            break
        upper = cur.select(
            F.col("_node").alias("_u"),
            F.col("_jump").alias("_u_jump"),
            F.col("missing").alias("u_missing"),
            F.col("root").alias("u_root"),
            F.col("depth").alias("u_depth"),
            *[F.col(n).alias(f"_u_{n}") for n in names],
        )
        stepped = active.join(upper, F.col("_jump") == F.col("_u")).select(
            "_node",
            F.col("_u_jump").alias("_jump"),
            (F.col("missing") | F.col("u_missing")).alias("missing"),
            (F.when(F.col("_u_jump").isNull(), F.lit(2**i) + F.col("u_depth")).otherwise(F.lit(2 ** (i + 1)))).alias("depth"),
            F.col("u_root").alias("root"),
            *[combine[n](F.col(f"_u_{n}"), F.col(n)).alias(n) for n in names],
        )
        cur = cut(stepped.unionByName(cur.filter(F.col("_jump").isNull())))
    return cur.select(
        F.col("_node").alias(node), *names, "root", "depth", "missing", F.col("_jump").isNotNull().alias("cyclic")
    )


def sum_descendants(
    nodes: DataFrame, node: str, parent: str, state: list[str], merge: dict[str, Column], add: dict[str, "callable"]
) -> DataFrame:
    """Aggregate a mergeable state over each node's whole subtree (the node included).

    ``merge[name]`` aggregates the state columns of many nodes, ``add[name](a, b)``
    adds two states, either of which may be NULL. Nodes caught in a cycle have no
    subtree; they come back with ``cyclic`` set.
    """
    known = nodes.select(F.col(node).alias("_known"))
    cur = nodes.join(known, F.col(parent) == F.col("_known"), "left").select(
        F.col(node).alias("_node"), F.col("_known").alias("_jump"), *state
    )
    cur = cut(cur)
    for _ in range(_rounds(cur.count())):
        active = cur.filter(F.col("_jump").isNotNull())
        if active.isEmpty():
            break
        below = active.groupBy("_jump").agg(*[merge[n].alias(f"_b_{n}") for n in state]).withColumnRenamed("_jump", "_below")
        hops = cur.select(F.col("_node").alias("_hop"), F.col("_jump").alias("_hop_jump"))
        moved = active.select("_node", "_jump").join(hops, F.col("_jump") == F.col("_hop")).select(
            F.col("_node").alias("_moved"), F.col("_hop_jump")
        )
        cur = cut(
            cur.join(below, F.col("_node") == F.col("_below"), "left")
            .join(moved, F.col("_node") == F.col("_moved"), "left")
            .select("_node", F.col("_hop_jump").alias("_jump"), *[add[n](F.col(n), F.col(f"_b_{n}")).alias(n) for n in state])
        )
    return cur.select(F.col("_node").alias(node), *state, F.col("_jump").isNotNull().alias("cyclic"))
