"""RDFS and OWL 2 RL rules as joins: each takes the triples it reads and gives the triples it adds.

Schema sides are broadcast only as collected tables of a checked size; assertions meet them in one pass. Equalities are
star edges to a group's least member, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms as t
from .closure import transitive


def table(graph: DataFrame, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A broadcast table of driver rows, which come from a schema of checked size."""
    return F.broadcast(graph.sparkSession.createDataFrame(sorted(rows), schema))


def _spo(df: DataFrame, s: str, p, o: str) -> DataFrame:
    return df.select(F.col(s).alias("s"), (F.lit(p) if isinstance(p, str) else p).alias("p"), F.col(o).alias("o"))


def having_type(graph: DataFrame, kind: str) -> DataFrame:
    """p: the properties of an OWL kind."""
    return graph.where((F.col("p") == t.TYPE) & (F.col("o") == kind)).select(F.col("s").alias("p")).distinct()


def assertions(graph: DataFrame, props: Iterable[str]) -> DataFrame:
    props = sorted(props)
    return graph.where(F.col("p").isin(*props)) if props and len(props) <= 200 else graph.join(table(graph, [(x,) for x in props], "p string"), "p", "left_semi").select("s", "p", "o")


def symmetric(graph: DataFrame, props: Iterable[str]) -> DataFrame:
    return _spo(assertions(graph, props), "o", F.col("p"), "s")


def transitive_property(graph: DataFrame, props: Iterable[str]) -> DataFrame:
    return transitive(assertions(graph, props), "p").select("s", "p", "o")


def moved(graph: DataFrame, rules: Iterable[tuple[str, str, bool]]) -> DataFrame:
    """Assertions of one property repeated for another; the third value tells if subject and object change places.
    Sub-properties, equivalent properties, inverses and symmetric properties, closed beforehand, are all of this form."""
    joined = graph.join(table(graph, rules, "p string, q string, turned boolean"), "p")
    return joined.select(F.when(F.col("turned"), F.col("o")).otherwise(F.col("s")).alias("s"), F.col("q").alias("p"), F.when(F.col("turned"), F.col("s")).otherwise(F.col("o")).alias("o"))


def domain_types(graph: DataFrame, axioms: Iterable[tuple[str, str]]) -> DataFrame:
    return _spo(graph.join(table(graph, axioms, "p string, c string"), "p"), "s", t.TYPE, "c").distinct()


def range_types(graph: DataFrame, axioms: Iterable[tuple[str, str]]) -> DataFrame:
    return _spo(graph.join(table(graph, axioms, "p string, c string"), "p"), "o", t.TYPE, "c").distinct()


def class_types(graph: DataFrame, pairs: Iterable[tuple[str, str]]) -> DataFrame:
    """x a c gives x a d for each pair (c, d): equivalent classes, super-classes."""
    types = graph.where(F.col("p") == t.TYPE)
    return _spo(types.join(table(graph, pairs, "o string, d string"), "o"), "s", t.TYPE, "d")


def functional_same(graph: DataFrame, props: Iterable[str]) -> DataFrame:
    """Objects of one subject and functional property are the same: edges to the least of them."""
    held = assertions(graph, props)
    least = held.groupBy("p", "s").agg(F.min("o").alias("m"), F.countDistinct("o").alias("n")).where("n > 1")
    return _spo(held.join(least, ["p", "s"]).where("o <> m"), "m", t.SAME, "o").distinct()


def inverse_functional_same(graph: DataFrame, props: Iterable[str]) -> DataFrame:
    held = assertions(graph, props)
    least = held.groupBy("p", "o").agg(F.min("s").alias("m"), F.countDistinct("s").alias("n")).where("n > 1")
    return _spo(held.join(least, ["p", "o"]).where("s <> m"), "m", t.SAME, "s").distinct()


def replaced(graph: DataFrame, rep: DataFrame, places: str = "so") -> DataFrame:
    """Terms of rep (member, rep) replaced in the given places."""
    for c in places:
        graph = graph.join(rep.select(F.col("member").alias(c), F.col("rep").alias("_r")), c, "left").withColumn(c, F.coalesce("_r", c)).drop("_r")
    return graph.select("s", "p", "o").distinct()


def copied(graph: DataFrame, pairs: DataFrame) -> DataFrame:
    """Triples of a copied to b, as subject and as object, for pairs a, b of equal nodes."""
    one = graph.join(pairs.select(F.col("a").alias("s"), "b"), "s").select(F.col("b").alias("s"), "p", "o")
    both = graph.union(one)
    two = both.join(pairs.select(F.col("a").alias("o"), "b"), "o").select("s", "p", F.col("b").alias("o"))
    return one.union(two).distinct()


# Class expressions, keys and chains. Their axioms are driver rows of checked size.


def typed(graph: DataFrame) -> DataFrame:
    return graph.where(F.col("p") == t.TYPE).select("s", "o")


def intersection_types(graph: DataFrame, lists: dict[str, list[str]]) -> DataFrame:
    """Instances of all of a list's classes are instances of the class that is their intersection."""
    rows = {(x, c, len(set(parts))) for c, parts in lists.items() for x in parts}
    met = typed(graph).join(table(graph, rows, "o string, c string, n int"), "o").groupBy("s", "c", "n").agg(F.count_distinct("o").alias("_n"))
    return _spo(met.where("_n = n"), "s", t.TYPE, "c")


def some_values(graph: DataFrame, rows: Iterable[tuple[str, str, str]]) -> DataFrame:
    """rows: (restriction, property, class). What has a value of the class is in the restriction."""
    held = graph.join(table(graph, rows, "c string, p string, d string"), "p").select("s", "c", "d", F.col("o").alias("v"))
    anything = held.where(F.col("d") == t.THING)
    of_class = held.where(F.col("d") != t.THING).join(typed(graph).select(F.col("s").alias("v"), F.col("o").alias("d")), ["v", "d"], "left_semi")
    return _spo(anything.select("s", "c").union(of_class.select("s", "c")).distinct(), "s", t.TYPE, "c")


def all_values(graph: DataFrame, rows: Iterable[tuple[str, str, str]]) -> DataFrame:
    """rows: (restriction, property, class). Values of what is in the restriction are of the class."""
    held = graph.join(table(graph, rows, "c string, p string, d string"), "p").select("s", "c", "d", F.col("o").alias("v"))
    inside = held.join(typed(graph).withColumnRenamed("o", "c"), ["s", "c"], "left_semi")
    return _spo(inside.select("v", "d").distinct(), "v", t.TYPE, "d")


def has_value(graph: DataFrame, rows: Iterable[tuple[str, str, str]]) -> DataFrame:
    """rows: (restriction, property, value). What is in the restriction has the value, and what has it is in it."""
    small = table(graph, rows, "c string, q string, v string")
    has = typed(graph).join(small, F.col("o") == F.col("c")).select("s", F.col("q").alias("p"), F.col("v").alias("o"))
    inside = graph.join(small, (F.col("p") == F.col("q")) & (F.col("o") == F.col("v")))
    return has.union(_spo(inside, "s", t.TYPE, "c")).distinct()


def at_most_one(graph: DataFrame, rows: Iterable[tuple[str, str]]) -> DataFrame:
    """rows: (restriction, property). Values of what is in the restriction are the same: edges to the least."""
    held = graph.join(table(graph, rows, "c string, p string"), "p").select("s", "c", "p", "o")
    held = held.join(typed(graph).withColumnRenamed("o", "c"), ["s", "c"], "left_semi")
    least = held.groupBy("s", "p").agg(F.min("o").alias("m"), F.count_distinct("o").alias("n")).where("n > 1")
    return _spo(held.join(least, ["s", "p"]).where("o <> m"), "m", t.SAME, "o").distinct()


def same_by_key(graph: DataFrame, cls: str, props: list[str]) -> DataFrame:
    """Instances of a class that share a value of every property of its key are the same: edges to the least."""
    rows = typed(graph).where(F.col("o") == cls).select("s").distinct()
    for i, p in enumerate(props):
        rows = rows.join(graph.where(F.col("p") == p).select("s", F.col("o").alias(f"v{i}")), "s")
    key = [f"v{i}" for i in range(len(props))]
    least = rows.groupBy(*key).agg(F.min("s").alias("m"), F.count_distinct("s").alias("n")).where("n > 1")
    return _spo(rows.join(least, key).where("s <> m"), "m", t.SAME, "s").distinct()


def chained(graph: DataFrame, prop: str, chain: list[str]) -> DataFrame:
    """What a chain of properties joins, the property joins."""
    out = None
    for p in chain:
        step = graph.where(F.col("p") == p).select(F.col("s").alias("_m"), F.col("o").alias("o"))
        out = step.withColumnRenamed("_m", "s") if out is None else out.withColumnRenamed("o", "_m").join(step, "_m").select("s", "o").distinct()
    return _spo(out, "s", prop, "o").distinct()


def resources(graph: DataFrame) -> DataFrame:
    """Everything that is no literal is a resource, and what stands as a predicate is a property."""
    ends = graph.select("s").union(graph.where(~F.col("o").startswith('"')).select("o")).union(graph.select("p")).distinct()
    return ends.select("s", F.lit(t.TYPE).alias("p"), F.lit(t.RESOURCE).alias("o")).union(_spo(graph.select("p").distinct().withColumnRenamed("p", "s").withColumn("o", F.lit(t.PROPERTY)), "s", t.TYPE, "o"))


# Consistency checks: rule, s, p, o, detail.


def _found(df: DataFrame, rule: str, s: str, p, o: str, detail) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.col(s).alias("s"), (F.lit(p) if isinstance(p, str) else p).alias("p"), F.col(o).alias("o"), detail.alias("detail"))


def check_asymmetric(graph: DataFrame) -> DataFrame:
    held = graph.join(having_type(graph, t.ASYMMETRIC), "p")
    turned = held.select("p", F.col("o").alias("s"), F.col("s").alias("o"))
    return _found(held.join(turned, ["p", "s", "o"], "left_semi"), "prp-asyp", "s", F.col("p"), "o", F.col("p")).distinct()


def check_irreflexive(graph: DataFrame) -> DataFrame:
    return _found(graph.join(having_type(graph, t.IRREFLEXIVE), "p").where("s = o"), "prp-irp", "s", F.col("p"), "o", F.col("p")).distinct()


def check_disjoint_properties(graph: DataFrame) -> DataFrame:
    pairs = graph.where(F.col("p") == t.PROPERTY_DISJOINT).select(F.col("s").alias("p"), F.col("o").alias("q"))
    one = graph.join(pairs, "p")
    two = graph.select("s", "o", F.col("p").alias("q"))
    return _found(one.join(two, ["s", "o", "q"], "left_semi"), "prp-pdw", "s", F.col("p"), "o", F.col("q")).distinct()


def _shared_instances(graph: DataFrame, axiom: str, rule: str) -> DataFrame:
    pairs = graph.where(F.col("p") == axiom).select(F.col("s").alias("c"), F.col("o").alias("d")).distinct()
    types = graph.where(F.col("p") == t.TYPE).select("s", F.col("o").alias("c"))
    one = types.join(pairs, "c")
    return _found(one.join(types.select("s", F.col("c").alias("d")), ["s", "d"], "left_semi"), rule, "s", t.TYPE, "c", F.col("d")).distinct()


def check_complement(graph: DataFrame) -> DataFrame:
    return _shared_instances(graph, t.COMPLEMENT, "cls-com")


def check_disjoint_classes(graph: DataFrame) -> DataFrame:
    return _shared_instances(graph, t.DISJOINT, "cax-dw")


def check_different(graph: DataFrame) -> DataFrame:
    same = graph.where(F.col("p") == t.SAME).select("s", "o")
    other = graph.where(F.col("p") == t.DIFFERENT).select("s", "o")
    either = other.union(other.select(F.col("o").alias("s"), F.col("s").alias("o")))
    return _found(same.join(either, ["s", "o"], "left_semi"), "eq-diff1", "s", t.SAME, "o", F.lit(t.DIFFERENT)).distinct()


CHECKS = {
    "prp-asyp": check_asymmetric, "prp-irp": check_irreflexive, "prp-pdw": check_disjoint_properties,
    "cls-com": check_complement, "cax-dw": check_disjoint_classes, "eq-diff1": check_different,
}


def check_consistency(graph: DataFrame) -> DataFrame:
    """All contradictions: rule, s, p, o, detail."""
    out = None
    for check in CHECKS.values():
        out = check(graph) if out is None else out.unionByName(check(graph))
    return out
