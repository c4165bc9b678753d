"""Transitive closures: on the driver for schemas of a checked size, as DataFrames for any size."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import discard, stored

#: Rows of a schema that the driver may hold.
SCHEMA_ROWS = 200_000


class SchemaTooLarge(RuntimeError):
    """A schema has more rows than the driver may hold."""


def collected(df: DataFrame, limit: int = SCHEMA_ROWS) -> list[tuple]:
    """df's rows on the driver, which are checked to be at most limit."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise SchemaTooLarge(f"more than {limit} schema rows")
    return [tuple(r) for r in rows]


def reachable(edges: Iterable[tuple[str, str]], start: Iterable[str]) -> set[str]:
    """Nodes reachable from start, start included, cycles and all."""
    to = defaultdict(set)
    for a, b in edges:
        to[a].add(b)
    seen, todo = set(start), list(start)
    while todo:
        for b in to[todo.pop()] - seen:
            seen.add(b)
            todo.append(b)
    return seen


def closed(edges: Iterable[tuple[str, str]]) -> set[tuple[str, str]]:
    """Pairs (a, b), a != b, with a path from a to b."""
    edges = set(edges)
    return {(a, b) for a in {x for x, _ in edges} for b in reachable(edges, [a]) if a != b}


def groups(edges: Iterable[tuple[str, str]]) -> list[set[str]]:
    """Connected components of undirected edges."""
    edges = [(a, b) for a, b in edges]
    both = edges + [(b, a) for a, b in edges]
    left, out = {x for e in edges for x in e}, []
    while left:
        part = reachable(both, [next(iter(left))])
        out.append(part)
        left -= part
    return out


def transitive(edges: DataFrame, *by: str, a: str = "s", b: str = "o") -> DataFrame:
    """All pairs with a path, by the columns by. Path lengths double each round: pairs meet pairs until none is new."""
    cols = [*by, a, b]
    known = stored(edges.select(*cols).distinct(), "paths")
    while True:
        right = known.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(a).alias("_mid"), F.col(b).alias("_end"))
        on = [F.col(c) == F.col(f"_{c}") for c in by] + [F.col(b) == F.col("_mid")]
        longer = known.join(right, on).select(*by, a, F.col("_end").alias(b))
        after = stored(known.union(longer).distinct(), "paths")
        grown = after.count() > known.count()
        discard(known)
        known = after
        if not grown:
            return known
