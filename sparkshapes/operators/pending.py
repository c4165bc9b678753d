"""Whether merging still has something to do: nodes that hold a link by which another node would join them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms as t

Links = Iterable[tuple[str, str]]
#: (predicate, side the node is on).
EITHER_SAME = ((t.SAME, "s"), (t.SAME, "o"))
CLASS_LINKS = (*EITHER_SAME, (t.EQ_CLASS, "s"), (t.EQ_CLASS, "o"))
PROPERTY_LINKS = (*EITHER_SAME, (t.EQ_PROPERTY, "s"), (t.EQ_PROPERTY, "o"))
BELOW = ((t.SUBPROPERTY, "o"),)


def awaiting(graph: DataFrame, nodes: DataFrame, links: Links) -> DataFrame:
    """node: those of nodes (its first column) with a link, in one pass over the graph."""
    links = list(links)
    ends = F.filter(F.array(*[F.when(F.col("p") == p, F.col(side)) for p, side in links]), lambda x: x.isNotNull())
    held = graph.where(F.col("p").isin(*{p for p, _ in links})).select(F.explode(ends).alias("node"))
    return nodes.select(F.col(nodes.columns[0]).alias("node")).distinct().join(held, "node", "left_semi")


def has_candidates(graph: DataFrame, node: str, links: Links) -> bool:
    return not awaiting(graph, graph.sparkSession.createDataFrame([(node,)], "node string"), links).isEmpty()


def _settled(graph: DataFrame, names: Iterable[str], links: Links) -> bool:
    names = [(x,) for x in names]
    return not names or awaiting(graph, graph.sparkSession.createDataFrame(names, "node string"), links).isEmpty()


def _links(links: Links, owl: bool) -> list[tuple[str, str]]:
    """Under RDFS rules only owl:sameAs and sub-properties count."""
    return [x for x in links if owl or x[0] in (t.SAME, t.SUBPROPERTY)]


def properties_settled(graph: DataFrame, names: Iterable[str], owl: bool = True) -> bool:
    """No property is the same as or equivalent to another."""
    return _settled(graph, names, _links(PROPERTY_LINKS, owl))


def below_settled(graph: DataFrame, names: Iterable[str]) -> bool:
    """No property has sub-properties."""
    return _settled(graph, names, BELOW)


def paths_settled(graph: DataFrame, names: Iterable[str], owl: bool = True) -> bool:
    return _settled(graph, names, _links((*PROPERTY_LINKS, *BELOW), owl))


def classes_settled(graph: DataFrame, names: Iterable[str], owl: bool = True) -> bool:
    return _settled(graph, names, _links(CLASS_LINKS, owl))


def unsettled_focus(graph: DataFrame, focus: DataFrame) -> DataFrame:
    """node: focus nodes that are the same as something, or that something other than a focus node is the same as."""
    focus = focus.select(F.col(focus.columns[0]).alias("node")).distinct()
    same = graph.where(F.col("p") == t.SAME)
    inner = same.join(focus.select(F.col("node").alias("s")), "s", "left_anti").select(F.col("o").alias("node"))
    return focus.join(same.select(F.col("s").alias("node")).union(inner), "node", "left_semi")


def focus_settled(graph: DataFrame, focus: DataFrame) -> bool:
    return unsettled_focus(graph, focus).isEmpty()
