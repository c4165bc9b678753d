"""Reasoning before validation: merging, materialising and full closures.

fuse (merge mode): derive what the shapes' classes, focus nodes and paths need, one representative for each set of
equal nodes and equal properties, and shapes rewritten to match. infer (materialise mode): the same without replacing
anything. full_closure: all rules over the whole graph. Rounds add only what is new and end when nothing is, so the
result does not depend on order; the schema is held on the driver with its size checked.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms as t
from ..operators import rules as r
from ..operators.closure import closed, collected, groups, reachable
from ..operators.components import connected_components
from .shapes import Shapes, sh
from .tables import stored
from .validator import Validator

SCHEMA = (t.SUBCLASS, t.SUBPROPERTY, t.DOMAIN, t.RANGE, t.EQ_CLASS, t.EQ_PROPERTY, t.INVERSE)
PROPERTY_KINDS = (t.SYMMETRIC, t.TRANSITIVE, t.FUNCTIONAL, t.INVERSE_FUNCTIONAL)


class FusionError(RuntimeError):
    """The graph contradicts itself."""


@dataclass
class Fused:
    graph: DataFrame
    same: DataFrame  # rep, member (null for a focus node without equals)
    shapes: Shapes
    focus: DataFrame  # node
    classes: set[str]
    paths: set[str]

    def same_sets(self) -> DataFrame:
        """rep, members: equal nodes of each focus node, an empty set for most."""
        return self.same.groupBy("rep").agg(F.collect_set("member").alias("members"))


class Schema:
    """The axioms of a graph on the driver, and what follows from them alone."""

    def __init__(self, graph: DataFrame, owl: bool, names: set[str] = frozenset()):
        axioms = graph.where(F.col("p").isin(*SCHEMA) | ((F.col("p") == t.TYPE) & F.col("o").isin(*PROPERTY_KINDS))).select("s", "p", "o").distinct()
        self.by: dict[str, set[tuple[str, str]]] = defaultdict(set)
        for s, p, o in collected(axioms):
            self.by[p].add((s, o))
        subjects = {x for p in SCHEMA for e in self.by[p] for x in e} | set(names)
        same = graph.where(F.col("p") == t.SAME).select("s", "o")
        if subjects:
            few = r.table(graph, [(x,) for x in subjects], "s string")
            same = same.join(few, "s", "left_semi").union(same.join(few.select(F.col("s").alias("o")), "o", "left_semi").select("s", "o")).distinct()
            self.by[t.SAME] = set(collected(same))
        self.owl = owl
        sub = set(self.by[t.SUBPROPERTY])
        if owl:
            sub |= {e for a, b in self.by[t.EQ_PROPERTY] | self.by[t.SAME] for e in ((a, b), (b, a))}
        self.sub = closed(sub)
        below = set(self.by[t.SUBCLASS])
        if owl:
            below |= {e for a, b in self.by[t.EQ_CLASS] for e in ((a, b), (b, a))}
        self.below = closed(below)

    def equal_properties(self) -> set[tuple[str, str]]:
        """Pairs of properties below each other."""
        return {(a, b) for a, b in self.sub if (b, a) in self.sub}

    def kind(self, kind: str) -> set[str]:
        return {s for s, o in self.by[t.TYPE] if o == kind} if self.owl else set()

    def class_groups(self, classes: set[str]) -> list[set[str]]:
        edges = (self.by[t.EQ_CLASS] if self.owl else set()) | self.by[t.SAME]
        return [g for g in groups(edges) if g & classes]

    def moves(self, paths: set[str] | None) -> set[tuple[str, str, bool]]:
        """(p, q, turned): assertions of p hold for q, closed over sub-properties, inverses and symmetric properties."""
        one: dict[tuple[str, bool], set] = defaultdict(set)
        for a, b in self.sub:
            if paths is None or b in paths:
                one[a].add((b, False))
        if self.owl:
            for a, b in self.by[t.INVERSE]:
                if paths is None or a in paths or b in paths:
                    one[a].add((b, True))
                    one[b].add((a, True))
            for p in self.kind(t.SYMMETRIC):
                if paths is None or p in paths:
                    one[p].add((p, True))
        out = set()
        for p in list(one):
            seen, todo = {(p, False)}, [(p, False)]
            while todo:
                q, turned = todo.pop()
                for to, turn in one[q] if q in one else ():
                    if (step := (to, turned != turn)) not in seen:
                        seen.add(step)
                        todo.append(step)
            out |= {(p, q, turned) for q, turned in seen if (q, turned) != (p, False)}
        return out

    def axioms(self, kind: str, paths: set[str] | None, classes: set[str] | None) -> set[tuple[str, str]]:
        """(property, class) domain or range axioms that apply; those of a property also hold for what is below it."""
        out = set()
        for p, c in self.by[kind]:
            wanted = paths is None or p in paths or (classes is not None and c in classes and self.owl)
            if wanted:
                out.add((p, c))
            if wanted and (self.owl or paths is None):
                out |= {(q, c) for q, above in self.sub if above == p}
        return out


def _grow(graph: DataFrame, found: list[DataFrame]) -> tuple[DataFrame, bool]:
    """The graph with what is new in found as a further part, and whether anything was. Nothing is copied."""
    new = found[0].select("s", "p", "o")
    for f in found[1:]:
        new = new.union(f.select("s", "p", "o"))
    new = stored(new.where("s IS NOT NULL AND o IS NOT NULL").distinct().join(graph, ["s", "p", "o"], "left_anti"), "new")
    if new.isEmpty():
        return graph, False
    return graph.union(new), True


def _derive(graph: DataFrame, schema: Schema, paths: set[str] | None, classes: set[str] | None, above: bool = False, same_nodes: bool = True) -> list[DataFrame]:
    """One round's derivations for the given scope; None scopes nothing out. above: types of super-classes too."""
    out = []
    if moves := schema.moves(paths):
        out.append(r.moved(graph, moves))
    for kind, rule in ((t.DOMAIN, r.domain_types), (t.RANGE, r.range_types)):
        if axioms := schema.axioms(kind, paths, classes):
            out.append(rule(graph, axioms))
    if schema.owl:
        inside = lambda props: props if paths is None else props & paths
        if props := inside(schema.kind(t.TRANSITIVE)):
            out.append(r.transitive_property(graph, props))
        if same_nodes and (props := inside(schema.kind(t.FUNCTIONAL))):
            out.append(r.functional_same(graph, props))
        if same_nodes and (props := inside(schema.kind(t.INVERSE_FUNCTIONAL))):
            out.append(r.inverse_functional_same(graph, props))
    equal = schema.class_groups(classes if classes is not None else {x for e in schema.by[t.EQ_CLASS] for x in e})
    pairs = {(a, b) for g in equal for a in g for b in g if a != b}
    if above:
        pairs |= schema.below
    if pairs:
        out.append(r.class_types(graph, pairs))
    if equal:
        links = [(a, t.SUBCLASS, b) for g in equal for a in g for b in g if a != b]
        out.append(graph.sparkSession.createDataFrame(links, "s string, p string, o string"))
    return out


def _checked(graph: DataFrame, on_inconsistency: str) -> None:
    if on_inconsistency == "raise":
        found = r.check_consistency(graph).take(1)
        if found:
            raise FusionError(f"inconsistent: {tuple(found[0])}")


def extract(graph: DataFrame, shapes: Shapes, schema: Schema | None = None) -> tuple[set[str], DataFrame, set[str]]:
    """(classes, focus nodes, paths) that the shapes are about, sub-classes and super-properties included."""
    schema = schema or Schema(graph, True)
    props = [shapes.get_all(p, sh("path"))[0] for p in shapes.property_shapes() if shapes.get_all(p, sh("path"))]
    paths = reachable([(a, b) for a, b in schema.by[t.SUBPROPERTY]], set(props))
    asked = {c for p in shapes.property_shapes() for c in shapes.get_all(p, sh("class"))} | shapes.target_classes()
    classes = reachable([(b, a) for a, b in schema.by[t.SUBCLASS]], asked)
    return classes, expanded(graph, shapes, Validator(graph, shapes).focus_nodes().select("node")), paths


def expanded(graph: DataFrame, shapes: Shapes, focus: DataFrame) -> DataFrame:
    """Focus nodes and the values of paths whose property shape has sh:node."""
    links = sorted({x for p in shapes.property_shapes() if shapes.get_all(p, sh("node")) for x in shapes.get_all(p, sh("path"))})
    if links:
        focus = focus.union(graph.where(F.col("p").isin(*links)).select(F.col("o").alias("node")))
    return focus.distinct()


def _joined_nodes(graph: DataFrame, schema: Schema, paths: set[str], classes: set[str], focus: DataFrame) -> DataFrame:
    """Focus nodes with those that domains, ranges and class equivalences make instances of the shapes' classes."""
    out = focus
    for kind, side in ((t.DOMAIN, "s"), (t.RANGE, "o")):
        axioms = {(p, c) for p, c in schema.axioms(kind, paths, classes) if c in classes}
        if axioms:
            out = out.union(r.assertions(graph, {p for p, _ in axioms}).select(F.col(side).alias("node")))
    equal = {c for g in schema.class_groups(classes) if len(g) > 1 for c in g}
    if equal:
        out = out.union(graph.where(F.col("p") == t.TYPE).join(r.table(graph, [(c,) for c in equal], "o string"), "o").select(F.col("s").alias("node")))
    return out.distinct()


def fuse(graph: DataFrame, shapes: Shapes, rules: str = "owl", gated: bool = False, materialize_types: bool = False, on_inconsistency: str = "ignore") -> Fused:
    """Merge mode. rules: "owl" or "rdfs". gated: derive only if a class or path awaits merging, as a guarded loop does."""
    owl = rules == "owl"
    graph = stored(graph.select("s", "p", "o").distinct(), "graph")
    schema = Schema(graph, owl)
    classes, focus, paths = extract(graph, shapes, schema)
    _checked(graph, on_inconsistency)
    spark = graph.sparkSession
    same = stored(spark.createDataFrame([], "rep string, member string"), "same")
    dropped: dict[str, set[tuple[str, str]]] = {t.SUBPROPERTY: set(), t.EQ_PROPERTY: set(), t.EQ_CLASS: set()}
    waiting = any(len(g) > 1 for g in schema.class_groups(classes)) or any(q in paths or p in paths for p, q in schema.by[t.SUBPROPERTY] | schema.by[t.EQ_PROPERTY])
    focus = stored(focus, "focus")
    while True:
        schema = Schema(graph, owl, classes | paths)
        before = (set(classes), set(paths), focus.count())
        for g in schema.class_groups(classes):
            classes |= g
        dropped[t.EQ_CLASS] |= {(a, b) for a, b in schema.by[t.EQ_CLASS] if owl and {a, b} <= classes}
        dropped[t.SUBPROPERTY] |= {(a, b) for a, b in schema.by[t.SUBPROPERTY] if b in paths}
        changed = False
        # Equal properties: one representative, in every place of a triple and in the shapes.
        equal = set(schema.by[t.SAME]) | (schema.by[t.EQ_PROPERTY] if owl else set())
        if owl:
            equal |= schema.equal_properties()
        names = {}
        for g in groups(equal):
            if own := g & paths:
                names |= {x: min(own) for x in g if x != min(own)}
        if names:
            graph = graph.where(~((F.col("p").isin(t.EQ_PROPERTY, t.SAME)) & F.col("s").isin(*names, *names.values()) & F.col("o").isin(*names, *names.values())))
            graph = stored(r.replaced(graph, r.table(graph, names.items(), "member string, rep string"), "spo"), "graph")
            graph = graph.where(~((F.col("p") == t.SUBPROPERTY) & (F.col("s") == F.col("o"))))
            shapes = shapes.rewritten({}, names)
            paths = {names.get(p, p) for p in paths}
            schema, changed = Schema(graph, owl, classes | paths), True
        if not gated or waiting:
            graph, grown = _grow(graph, [*_derive(graph, schema, paths, classes), spark.createDataFrame([], "s string, p string, o string")])
            changed |= grown
            focus = _joined_nodes(graph, schema, paths, classes, focus)
        focus = stored(expanded(graph, shapes, focus), "focus")
        # Equal nodes: components with a focus node get the least of these as representative.
        links = graph.where(F.col("p") == t.SAME).select("s", "o")
        if not links.isEmpty():
            parts = stored(connected_components(links, "s", "o"), "parts")
            reps = parts.join(focus, "node", "left_semi").groupBy("component").agg(F.min("node").alias("rep"))
            members = stored(parts.join(reps, "component").where("node <> rep").select(F.col("node").alias("member"), "rep"), "members")
            inner = parts.join(reps, "component").select(F.col("node").alias("s"), "rep")
            if not members.isEmpty():
                inside = inner.select("s").union(members.select("rep")).distinct()
                graph = graph.where(F.col("p") != t.SAME).union(graph.where(F.col("p") == t.SAME).join(inside, "s", "left_anti"))
                graph = stored(r.replaced(graph, members), "graph")
                targets = {x for s in shapes.values() for k, x in s.targets if k == "targetNode"}
                moved = dict(collected(members.join(r.table(graph, [(x,) for x in targets], "member string"), "member"))) if targets else {}
                shapes = shapes.rewritten(moved, {}) if moved else shapes
                same = stored(_renamed(same, members).union(members.select("rep", "member")).distinct(), "same")
                focus = stored(focus.join(members, focus["node"] == members["member"], "left").select(F.coalesce("rep", "node").alias("node")).distinct(), "focus")
                changed = True
            elif not inner.isEmpty():
                graph = stored(graph.join(inner.select("s").distinct().withColumn("p", F.lit(t.SAME)), ["s", "p"], "left_anti").select("s", "p", "o"), "graph")
        _checked(graph, on_inconsistency)
        if not changed and before == (classes, paths, focus.count()):
            break
        if gated and not waiting:
            break
    graph = _finished(graph, schema, focus, materialize_types)
    gone = [(a, p, b) for p, e in dropped.items() for a, b in e]
    if gone:
        graph = graph.join(r.table(graph, gone, "s string, p string, o string"), ["s", "p", "o"], "left_anti")
    graph = graph.union(same.select(F.col("rep").alias("s"), F.lit(t.SAME).alias("p"), F.col("member").alias("o"))).distinct()
    full = focus.join(same, focus["node"] == same["rep"], "left").select(F.col("node").alias("rep"), "member")
    return Fused(stored(graph, "fused"), stored(full, "same-sets"), shapes, focus, classes, paths)


def _renamed(same: DataFrame, members: DataFrame) -> DataFrame:
    """Earlier equalities whose representative was merged itself."""
    to = members.select(F.col("member").alias("rep"), F.col("rep").alias("_to"))
    return same.join(to, "rep", "left").select(F.coalesce("_to", "rep").alias("rep"), "member")


def _finished(graph: DataFrame, schema: Schema, focus: DataFrame, materialize_types: bool) -> DataFrame:
    """Super-properties of focus nodes' assertions, and on request the super-classes of their types."""
    own = graph.join(focus.select(F.col("node").alias("s")), "s", "left_semi").select("s", "p", "o")
    more = []
    if schema.sub:
        more.append(r.moved(own, {(a, b, False) for a, b in schema.sub}))
    if materialize_types and schema.below:
        more.append(r.class_types(own, schema.below))
    return _grow(graph, more)[0] if more else graph


def infer(graph: DataFrame, shapes: Shapes, rules: str = "owl", on_inconsistency: str = "ignore") -> DataFrame:
    """Materialise mode: what fuse derives, with equal nodes' triples copied to each other and nothing replaced.

    rules "rdfs" keeps sub-properties, domains and ranges only."""
    owl = rules == "owl"
    graph = stored(graph.select("s", "p", "o").distinct(), "graph")
    classes, focus, paths = extract(graph, shapes)
    focus = stored(focus, "focus")
    while True:
        schema = Schema(graph, owl, classes | paths if owl else set())
        if owl:
            for g in schema.class_groups(classes):
                classes |= g
            paths = paths | {b for a, b in schema.sub if a in paths and (b, a) in schema.sub}
        found = _derive(graph, schema, paths, classes if owl else set())
        focus = stored(expanded(graph, shapes, _joined_nodes(graph, schema, paths, classes, focus)), "focus")
        if owl:
            links = graph.where(F.col("p") == t.SAME).select("s", "o")
            if not links.isEmpty():
                parts = stored(connected_components(links, "s", "o"), "parts")
                live = parts.join(focus, "node", "left_semi").select("component").distinct()
                parts = parts.join(live, "component", "left_semi")
                pairs = parts.select("component", F.col("node").alias("a")).join(parts.select("component", F.col("node").alias("b")), "component").select("a", "b")
                pairs = stored(pairs, "equal-pairs")
                found.append(r.copied(graph.where(F.col("p") != t.SAME), pairs.where("a <> b")))
                found.append(pairs.select(F.col("a").alias("s"), F.lit(t.SAME).alias("p"), F.col("b").alias("o")))
                focus = stored(focus.union(parts.select("node")).distinct(), "focus")
        graph, grown = _grow(graph, found) if found else (graph, False)
        _checked(graph, on_inconsistency)
        if not grown:
            return _finished(graph, schema, focus, False)


class Expressions:
    """Class expressions, keys and property chains of a graph, on the driver."""

    LISTS = (t.INTERSECTION, t.UNION, t.ONE_OF, t.HAS_KEY, t.CHAIN)
    PARTS = (t.ON_PROPERTY, t.SOME, t.ALL, t.HAS_VALUE, t.MAX_CARDINALITY)

    def __init__(self, graph: DataFrame):
        self.by: dict[str, set[tuple[str, str]]] = defaultdict(set)
        for s, p, o in collected(graph.where(F.col("p").isin(*self.LISTS, *self.PARTS)).select("s", "p", "o").distinct()):
            self.by[p].add((s, o))
        first, rest = {}, {}
        if any(self.by[p] for p in self.LISTS):
            for s, p, o in collected(graph.where(F.col("p").isin(t.FIRST, t.REST)).select("s", "p", "o").distinct()):
                (first if p == t.FIRST else rest)[s] = o
        self.items: dict[str, list[str]] = {}
        for p in self.LISTS:
            for _, head in self.by[p]:
                found, at = [], head
                while at in first and len(found) <= len(first):
                    found.append(first[at])
                    at = rest.get(at, t.NIL)
                self.items[head] = found

    def lists(self, p: str) -> list[tuple[str, list[str]]]:
        return [(s, self.items[o]) for s, o in sorted(self.by[p]) if self.items[o]]

    def restrictions(self, p: str) -> set[tuple[str, str, str]]:
        """(restriction, property, what it asks for)."""
        on = defaultdict(set)
        for s, q in self.by[t.ON_PROPERTY]:
            on[s].add(q)
        return {(s, q, o) for s, o in self.by[p] for q in on[s]}

    def below(self) -> set[tuple[str, str]]:
        """Sub-classes that intersections and unions make."""
        return {(c, x) for c, parts in self.lists(t.INTERSECTION) for x in parts} | {(x, c) for c, parts in self.lists(t.UNION) for x in parts}

    def derive(self, graph: DataFrame) -> list[DataFrame]:
        out = []
        if lists := self.lists(t.INTERSECTION):
            out.append(r.intersection_types(graph, dict(lists)))
        for kind, rule in ((t.SOME, r.some_values), (t.ALL, r.all_values), (t.HAS_VALUE, r.has_value)):
            if rows := self.restrictions(kind):
                out.append(rule(graph, rows))
        if rows := {(s, p) for s, p, n in self.restrictions(t.MAX_CARDINALITY) if n.startswith('"1"')}:
            out.append(r.at_most_one(graph, rows))
        if members := [(x, t.TYPE, c) for c, parts in self.lists(t.ONE_OF) for x in parts]:
            out.append(graph.sparkSession.createDataFrame(members, "s string, p string, o string"))
        out += [r.same_by_key(graph, c, props) for c, props in self.lists(t.HAS_KEY)]
        out += [r.chained(graph, p, chain) for p, chain in self.lists(t.CHAIN)]
        return out


def full_closure(graph: DataFrame, rules: str = "both", resources: bool = False) -> DataFrame:
    """All rules over the whole graph. rules: "rdfs", or "both" for RDFS and OWL RL. resources: types of everything that
    is a resource or a property too."""
    owl = rules != "rdfs"
    graph = stored(graph.select("s", "p", "o").distinct(), "graph")
    more = Expressions(graph) if owl else None
    if more and (below := more.below()):
        graph, _ = _grow(graph, [graph.sparkSession.createDataFrame([(a, t.SUBCLASS, b) for a, b in below], "s string, p string, o string")])
    while True:
        predicates = {p for (p,) in collected(graph.select("p").distinct())} if owl else set()
        schema = Schema(graph, owl, predicates)
        found = _derive(graph, schema, None, None, above=True)
        links = [(a, t.SUBCLASS, b) for a, b in schema.below] + [(a, t.SUBPROPERTY, b) for a, b in schema.sub]
        found.append(graph.sparkSession.createDataFrame(links, "s string, p string, o string"))
        if owl:
            found += more.derive(graph)
            same = graph.where(F.col("p") == t.SAME).select("s", "o")
            if not same.isEmpty():
                parts = stored(connected_components(same, "s", "o"), "parts")
                pairs = parts.select("component", F.col("node").alias("a")).join(parts.select("component", F.col("node").alias("b")), "component").select("a", "b")
                found += [r.copied(graph.where(F.col("p") != t.SAME), pairs.where("a <> b")), pairs.select(F.col("a").alias("s"), F.lit(t.SAME).alias("p"), F.col("b").alias("o"))]
        graph, grown = _grow(graph, found)
        if not grown:
            return _grow(graph, [r.resources(graph)])[0] if resources else graph
