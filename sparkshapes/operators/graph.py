"""Triple patterns and set operations on graphs: DataFrames of distinct s, p, o."""

from __future__ import annotations

import hashlib
import sys
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import is_blank
from ..plans.tables import stored
from .closure import collected


def triples(graph: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """The triples that match; None matches all. Bound places reach the scan as filters."""
    for name, value in (("s", s), ("p", p), ("o", o)):
        if value is not None:
            graph = graph.where(F.col(name) == value)
    return graph


def subjects(graph: DataFrame, p: str | None = None, o: str | None = None) -> DataFrame:
    return triples(graph, None, p, o).select("s").distinct()


def objects(graph: DataFrame, s: str | None = None, p: str | None = None) -> DataFrame:
    return triples(graph, s, p).select("o").distinct()


def subject_objects(graph: DataFrame, p: str) -> DataFrame:
    return triples(graph, None, p).select("s", "o")


def star(graph: DataFrame, nodes: DataFrame, side: str = "s") -> DataFrame:
    """The triples whose s (or o) is among nodes (its first column)."""
    return graph.join(nodes.select(F.col(nodes.columns[0]).alias(side)).distinct(), side, "left_semi").select("s", "p", "o")


def contains(graph: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted triples with `present`."""
    held = graph.select("s", "p", "o", F.lit(True).alias("_in")).distinct()
    return wanted.join(held, ["s", "p", "o"], "left").select(*wanted.columns, F.coalesce("_in", F.lit(False)).alias("present"))


def union(*graphs: DataFrame) -> DataFrame:
    out = graphs[0].select("s", "p", "o")
    for g in graphs[1:]:
        out = out.union(g.select("s", "p", "o"))
    return out.distinct()


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("s", "p", "o").subtract(b.select("s", "p", "o"))


def difference_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, n, n_blank: triples in one graph only, and those of them with a blank node."""
    side = lambda name, x, y: minus(x, y).agg(F.count("*").alias("n"), F.count_if(is_blank(F.col("s")) | is_blank(F.col("o"))).alias("n_blank")).select(F.lit(name).alias("side"), "n", "n_blank")
    return side("left", a, b).union(side("right", b, a))


def colour_rounds(graph: DataFrame) -> Iterator[tuple[DataFrame, int]]:
    """For each round of refinement by their triples: blank nodes n with colours c, and how many colours there are."""
    blank = lambda c: is_blank(F.col(c))
    nodes = graph.where(blank("s")).select(F.col("s").alias("n")).union(graph.where(blank("o")).select("o")).distinct()
    colours = nodes.withColumn("c", F.lit("_:0"))
    n = colours.limit(1).count()
    while True:
        yield colours, n
        named = _named(graph, colours)
        seen = named.where(blank("s")).select(F.col("s").alias("n"), F.concat_ws(" ", F.lit(">"), "p", "o2", "s2").alias("e"))
        seen = seen.union(named.where(blank("o")).select(F.col("o").alias("n"), F.concat_ws(" ", F.lit("<"), "p", "s2", "o2").alias("e")))
        # The sum of edge hashes stands for the multiset of edges, whatever a node's degree.
        digest = lambda salt: F.sum(F.xxhash64("e", F.lit(salt)).cast("decimal(38,0)"))
        colours = stored(seen.groupBy("n").agg(F.concat_ws(":", F.lit("_"), digest(1).cast("string"), digest(2).cast("string")).alias("c")), "colours")
        n = colours.select("c").distinct().count()


def _named(graph: DataFrame, colours: DataFrame) -> DataFrame:
    named = graph.join(colours.select(F.col("n").alias("s"), F.col("c").alias("sc")), "s", "left").join(colours.select(F.col("n").alias("o"), F.col("c").alias("oc")), "o", "left")
    return named.select("s", "p", "o", F.coalesce("sc", "s").alias("s2"), F.coalesce("oc", "o").alias("o2"))


def coloured(graph: DataFrame) -> Iterator[tuple[DataFrame, int]]:
    """The graph with colours in place of blank nodes, for each round."""
    for colours, n in colour_rounds(graph):
        yield _named(graph, colours).select(F.col("s2").alias("s"), "p", F.col("o2").alias("o")), n


def isomorphic(a: DataFrame, b: DataFrame) -> bool:
    """Whether the graphs are equal up to names of blank nodes. Colours are refined until they stay as many in both graphs;
    ground parts must be equal, and the coloured rest equal as a multiset. Blank nodes that share a colour are then told
    apart on the driver, where their triples must fit: one of each graph at a time gets a colour of its own."""
    a, b = (x.select("s", "p", "o").distinct() for x in (a, b))
    last = None
    for (x, n), (y, m) in zip(*(coloured(v) for v in (a, b)), strict=True):
        if (n, m) == last:
            break
        last = n, m
    x, y = (stored(v, "coloured") for v in (x, y))
    count = lambda v: v.groupBy("s", "p", "o").count()
    if not (count(x).subtract(count(y)).isEmpty() and count(y).subtract(count(x)).isEmpty()):
        return False
    # Only nodes whose colour others share are left, with all triples they stand in.
    rest = [_shared(v) for v in (a, b)]
    return matched(*rest)


def _shared(graph: DataFrame) -> list[tuple[str, str, str]]:
    last, nodes = None, None
    for colours, n in colour_rounds(graph):
        if n == last:
            break
        last, nodes = n, colours
    named = lambda c: F.when(is_blank(F.col(c)), F.coalesce(F.col(f"{c}_c"), F.col(c))).otherwise(F.col(c))
    twice = nodes.groupBy("c").agg(F.count("*").alias("k")).where("k > 1").select("c")
    open_ = nodes.join(twice, "c", "left_semi").select("n")
    closed = nodes.join(twice, "c", "left_anti")
    held = graph.join(open_.select(F.col("n").alias("s")), "s", "left_semi").select("s", "p", "o").union(graph.join(open_.select(F.col("n").alias("o")), "o", "left_semi").select("s", "p", "o")).distinct()
    for c in ("s", "o"):
        held = held.join(closed.select(F.col("n").alias(c), F.concat(F.lit("="), "c").alias(f"{c}_c")), c, "left")
    return collected(held.select(named("s").alias("s"), "p", named("o").alias("o")))


def matched(a: list[tuple[str, str, str]], b: list[tuple[str, str, str]]) -> bool:
    """Isomorphism of small graphs: refinement, then a node of the smallest shared colour is tried against all of its."""

    def refined(graph: list, colours: dict[str, str]) -> dict[str, str]:
        while True:
            seen: dict[str, list] = {n: [] for n in colours}
            for s, p, o in graph:
                if s in colours:
                    seen[s].append((">", p, colours.get(o, o)))
                if o in colours:
                    seen[o].append(("<", p, colours.get(s, s)))
            new = {n: hashlib.md5(repr((c, sorted(seen[n]))).encode()).hexdigest() for n, c in colours.items()}
            if len(set(new.values())) == len(set(colours.values())):
                return new
            colours = new

    def search(x: dict[str, str], y: dict[str, str]) -> bool:
        x, y = refined(a, x), refined(b, y)
        if sorted(x.values()) != sorted(y.values()):
            return False
        sizes = Counter(x.values())
        if not sizes or max(sizes.values()) == 1:
            name = {c: n for n, c in y.items()}
            to = {n: name[c] for n, c in x.items()}
            return {(to.get(s, s), p, to.get(o, o)) for s, p, o in a} == set(b)
        colour = min((k, c) for c, k in sizes.items() if k > 1)[1]
        one = min(n for n, c in x.items() if c == colour)
        return any(search(x | {one: "chosen"}, y | {n: "chosen"}) for n, c in sorted(y.items()) if c == colour)

    if len(a) != len(b):
        return False
    start = [{n: "" for s, _, o in g for n in (s, o) if n.startswith("_:")} for g in (a, b)]
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 10_000 + 4 * len(start[0])))
    try:
        return search(*start)
    finally:
        sys.setrecursionlimit(limit)
