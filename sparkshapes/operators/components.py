"""Connected components by alternating stars, without collecting any edge."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegralType, StringType

from ..plans.tables import discard, stored, with_groups

#: Edges that one task joins by union-find; more go through rounds of stars.
FEW = 200_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on distinct edges (u > v): nodes hang on the least node they can see.

    Large: every greater neighbour of a node hangs on the node's least neighbour (or itself). Small: a node and its
    lesser neighbours hang on the least of them.
    """
    arcs = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = stored(arcs.groupBy("u").agg(F.min("v").alias("_m"), F.count("*").alias("_n")), "least")
    total = least.agg(F.sum("_n")).first()[0] or 0
    met = with_groups(arcs, least, "u", "_n", total)
    if large:
        moved = met.where("v > u").select(F.col("v").alias("u"), F.least("u", "_m").alias("v"))
    else:
        moved = met.select(F.col("v").alias("u"), F.col("_m").alias("v")).union(least.select("u", F.col("_m").alias("v")))
    return moved.where("u > v").distinct()


def _forest(edges: DataFrame) -> bool:
    """Whether every node hangs on one other and that one on none: then the edges are the answer."""
    if not edges.groupBy("u").count().where("count > 1").isEmpty():
        return False
    return edges.select("v").distinct().join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def _united(edges: DataFrame) -> DataFrame:
    """Components of at most FEW edges a, b by union-find in one task; ids that Python orders as Spark does."""

    def run(batches: Iterator):
        import pyarrow as pa

        above: dict = {}

        def least(x):
            while (y := above.setdefault(x, x)) != x:
                above[x] = x = above[y]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = least(a), least(b)
                if a < b:
                    above[b] = a
                else:
                    above[a] = b
        nodes = list(above)
        for at in range(0, len(nodes), 10_000):
            some = nodes[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, kind), pa.array([least(x) for x in some], kind)], ["node", "component"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind, name = to_arrow_type(edges.schema["a"].dataType), edges.schema["a"].dataType.simpleString()
    return edges.coalesce(1).mapInArrow(run, f"node {name}, component {name}")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """edges: two columns of one ordered type. A row for each node that has an edge: node, component (the least node).

    At most FEW edges are one task's work, without rounds. Of more, rounds of a large and a small star go on until only
    stars are left, which takes O(log^2 n) rounds; each is an aggregation and a join whose heavy nodes are broadcast by a
    proven bound, so a node with any number of edges is no single task's work. Edges from a node to itself make it a
    component. Null ends are ignored.
    """
    given = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    given = stored(given.distinct(), "edges")
    if isinstance(given.schema["a"].dataType, (BinaryType, IntegralType, StringType)) and given.schema["a"].dataType == given.schema["b"].dataType and given.count() <= FEW:
        return _united(given)
    now = stored(given.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    while not _forest(now):
        after = stored(_star(_star(now, True), False), "stars")
        discard(now)
        now = after
    nodes = given.select(F.col("a").alias("node")).union(given.select("b")).distinct()
    return nodes.join(now, nodes["node"] == now["u"], "left").select("node", F.coalesce("v", "node").alias("component"))
