"""Connected components of an edge table, distributed.

Alternating large-star and small-star steps: every step is one aggregation and
one join over the edges, the state is cut through the shared checkpoint folder,
and nothing but two numbers per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortal.llm.common import cut


def _oriented(df: DataFrame) -> DataFrame:
    """Edges as (hi, lo) with lo < hi, once each, without loops."""
    return (
        df.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )


def _lowest(edges: DataFrame) -> DataFrame:
    """Each node's smallest smaller neighbour.

    It is materialised so that the join that follows reads both sides straight
    from an exchange: only then can adaptive execution split a hub's rows.
    """
    return cut(edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("low")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every node's larger neighbours to its smallest neighbour."""
    low = _lowest(edges)
    moved = edges.join(low, edges.lo == low.node, "left").select(
        F.col("hi").alias("a"), F.coalesce("low", "lo").alias("b")
    )
    # The node's own edge to its smallest neighbour stays.
    return _oriented(moved.unionByName(low.select(F.col("node").alias("a"), F.col("low").alias("b"))))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every node and its smaller neighbours to the smallest of them."""
    low = _lowest(edges)
    moved = edges.join(low, edges.hi == low.node).select(F.col("lo").alias("a"), F.col("low").alias("b"))
    return _oriented(moved.unionByName(low.select(F.col("node").alias("a"), F.col("low").alias("b"))))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node reachable.

    ``a`` and ``b`` are columns of one orderable type; structs order field by
    field. Nodes without an edge, and loops, give no row. Repeated edges count
    once. An empty table gives an empty result.
    """
    state = cut(_oriented(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))))
    seen = None
    for _ in range(max_rounds):
        state = cut(_small_star(cut(_large_star(state))))
        mark = state.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return state.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        state.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )
