"""SHACL Core validation: one plan for each kind of constraint, whatever the number of shapes.

Compiled constraints are broadcast tables (a shapes graph is read on the driver, so its size is checked there). Focus
nodes join the triples once for each depth of shapes: all property shapes' value nodes come from one join, and each
component is an aggregation, an anti-join or a column predicate over them. Operands of or, and, xone, not, node and
qualified shapes are validated first, as a batch of (shape, node) rows one level down.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as t
from ..operators.closure import closed, collected, transitive
from .shapes import Path, Shapes, sh
from .tables import stored

RESULT = ["focus", "path", "value", "component", "shape", "severity", "message"]
ROWS = "root string, focus string, path string, value string, component string, shape string, severity string, message string"


def path_text(path: Path | None) -> str | None:
    if path is None:
        return None
    if path[0] == "p":
        return path[1]
    inner = [path_text(x) for x in path[1:]]
    marks = {"inv": "^{}", "star": "{}*", "plus": "{}+", "opt": "{}?"}
    return marks[path[0]].format(inner[0]) if path[0] in marks else {"seq": "/", "alt": "|"}[path[0]].join(inner)


class Validator:
    """graph: s, p, o. subclass: pairs (class, super-class), transitively closed, on the driver."""

    def __init__(self, graph: DataFrame, shapes: Shapes, store: bool = False):
        """store: reads the graph once, as far as the shapes ask for it."""
        self.shapes = shapes
        self.spark: SparkSession = graph.sparkSession
        self.graph = graph.select("s", "p", "o")
        if store:
            if (wanted := self.predicates()) is not None:
                self.graph = self.graph.where(F.col("p").isin(*sorted(wanted)))
            self.graph = stored(self.graph.distinct(), "validated")
        schema = graph.where(F.col("p") == t.SUBCLASS).select("s", "o").distinct()
        self.subclass = closed((s, o) for s, o in collected(schema))

    def predicates(self) -> set[str] | None:
        """The predicates that validation reads; None: all, as for closed shapes and paths of any length."""
        out = {t.TYPE, t.SUBCLASS}

        def walk(path: Path) -> bool:
            if path[0] == "p":
                out.add(path[1])
                return True
            return path[0] not in ("star", "opt") and all(walk(x) for x in path[1:])

        for shape in self.shapes.values():
            if shape.path and not walk(shape.path):
                return None
            out |= {x for kind, x in shape.targets if kind in ("targetSubjectsOf", "targetObjectsOf")}
            for c in shape.constraints:
                if c.kind == "closed":
                    return None
                if c.kind in ("equals", "disjoint", "lessThan", "lessThanOrEquals"):
                    out |= set(c.args)
        return out

    def small(self, rows: Iterable[tuple], schema: str) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame(list(rows), schema))

    def classes_below(self, classes: Iterable[str]) -> list[tuple[str, str]]:
        """(class, it or a sub-class)."""
        wanted = set(classes)
        return sorted({(c, c) for c in wanted} | {(c, d) for d, c in self.subclass if c in wanted})

    def instances(self, classes: Iterable[str]) -> DataFrame:
        """c, node: instances of classes or their sub-classes."""
        below = self.classes_below(classes)
        types = self.graph.where(F.col("p") == t.TYPE)
        return types.join(self.small(below, "c string, o string"), "o").select("c", F.col("s").alias("node")).distinct()

    def focus_nodes(self, only: Iterable[str] | None = None) -> DataFrame:
        """shape, node: the targets of all shapes."""
        targets = [(s, kind, x) for s in (only or self.shapes.roots) for kind, x in self.shapes[s].targets]
        of = lambda kind: [(s, x) for s, k, x in targets if k == kind]
        out = self.spark.createDataFrame(of("targetNode"), "shape string, node string")
        if by_class := of("targetClass"):
            found = self.instances({c for _, c in by_class})
            out = out.union(found.join(self.small(by_class, "shape string, c string"), "c").select("shape", "node"))
        for kind, side in (("targetSubjectsOf", "s"), ("targetObjectsOf", "o")):
            if rows := of(kind):
                out = out.union(self.graph.join(self.small(rows, "shape string, p string"), "p").select("shape", F.col(side).alias("node")))
        return out.distinct()

    def pairs(self, path: Path) -> DataFrame:
        """s, o joined by a path; starred paths hold every node of the graph with itself."""
        kind = path[0]
        if kind == "p":
            return self.graph.where(F.col("p") == path[1]).select("s", "o")
        if kind == "inv":
            return self.pairs(path[1]).select(F.col("o").alias("s"), F.col("s").alias("o"))
        if kind == "alt":
            out = self.pairs(path[1])
            for part in path[2:]:
                out = out.union(self.pairs(part))
            return out.distinct()
        if kind == "seq":
            out = self.pairs(path[1])
            for part in path[2:]:
                out = out.select("s", F.col("o").alias("m")).join(self.pairs(part).select(F.col("s").alias("m"), "o"), "m").select("s", "o").distinct()
            return out
        inner = self.pairs(path[1]).distinct()
        if kind in ("star", "plus"):
            inner = transitive(inner)
        if kind == "plus":
            return inner
        nodes = self.graph.select(F.col("s").alias("n")).union(self.graph.select("o"))
        nodes = nodes.union(self.spark.createDataFrame([(x,) for s in self.shapes.values() for k, x in s.targets if k == "targetNode"], "n string"))
        return inner.union(nodes.select(F.col("n").alias("s"), F.col("n").alias("o"))).distinct()

    def values(self, items: DataFrame, shapes: set[str]) -> DataFrame:
        """items: root, focus, shape, node, each once. The same with value nodes, each once: those at the path's end, or the
        node itself. The graph meets the paths of all shapes first, so its rows are few before they are shuffled."""
        plain = [(s, p[1]) for s in shapes if (p := self.shapes[s].path) and p[0] == "p"]
        out = None
        if plain:
            held = self.graph.where(F.col("p").isin(*sorted({p for _, p in plain}))).join(self.small(plain, "shape string, p string"), "p")
            out = items.join(held.select("shape", F.col("s").alias("node"), F.col("o").alias("value")), ["shape", "node"]).select("root", "focus", "shape", "node", "value")
        own = [(s,) for s in shapes if self.shapes[s].path is None]
        if own:
            more = items.join(self.small(own, "shape string"), "shape").select("root", "focus", "shape", "node", F.col("node").alias("value"))
            out = more if out is None else out.union(more)
        complex_: dict[Path, list[tuple]] = {}
        for s in shapes:
            if (p := self.shapes[s].path) and p[0] != "p":
                complex_.setdefault(p, []).append((s,))
        for p, rows in complex_.items():
            ends = self.pairs(p).select(F.col("s").alias("node"), F.col("o").alias("value"))
            more = items.join(self.small(rows, "shape string"), "shape").join(ends, "node").select("root", "focus", "shape", "node", "value")
            out = more if out is None else out.union(more)
        return items.withColumn("value", F.col("node")).limit(0) if out is None else out

    def results(self, focus: DataFrame, shapes: set[str]) -> DataFrame:
        """focus: shape, node. root, focus and the result columns: what fails in each shape, sh:property included."""
        items, level = focus.select(F.col("shape").alias("root"), F.col("node").alias("focus"), "shape", "node"), set(shapes)
        all_items, all_values, reached, again = items, self.values(items, level), set(level), False
        values = all_values
        while edges := [(s, p) for s in level for p in self.shapes[s].properties]:
            children = self.small([(s, p) for s, p in edges], "shape string, child string")
            items = values.join(children, "shape").select("root", "focus", F.col("child").alias("shape"), F.col("value").alias("node")).distinct()
            level = {p for _, p in edges}
            values = self.values(items, level)
            all_items, all_values = all_items.union(items), all_values.union(values)
            again |= bool(reached & level)
            reached |= level
        used = [(s, c) for s in sorted(reached) for c in self.shapes[s].constraints]
        kinds = {c.kind for _, c in used}
        nested = kinds & {"or", "and", "xone", "not", "node", "qualified"}
        # A shape met at two depths may meet a node twice; else every row is there once.
        items, values = (all_items.distinct(), all_values.distinct()) if again else (all_items, all_values)
        if nested or len(kinds) > 3:
            items, values = stored(items, "focus"), stored(values, "values")
        parts = [f for f in (self.component(k, [(s, c) for s, c in used if c.kind == k], items, values) for k in sorted(kinds)) if f is not None]
        if not parts:
            return self.spark.createDataFrame([], ROWS)
        facts = self.small([(s, path_text(self.shapes[s].path), self.shapes[s].severity, self.shapes[s].message) for s in reached], "shape string, path string, severity string, message string")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.join(facts, "shape").select("root", "focus", "path", "value", "component", "shape", "severity", "message")

    def component(self, kind: str, used: list, items: DataFrame, values: DataFrame) -> DataFrame | None:
        """root, focus, shape, value, component of one kind of constraint."""
        name = sh({"qualified": "QualifiedValueShape"}.get(kind, kind[0].upper() + kind[1:]) + "ConstraintComponent")
        say = lambda df, value="value", what=name: df.select("root", "focus", "shape", (F.lit(None).cast("string") if value is None else F.col(value)).alias("value"), F.lit(what).alias("component"))
        one = [(s, c.group, c.args[0]) for s, c in used if c.args]
        args = lambda: self.small(one, "shape string, g int, arg string")
        key = ["root", "focus", "shape", "node"]
        if kind in ("minCount", "maxCount"):
            limits = self.small([(s, g, int(x.split('"')[1])) for s, g, x in one], "shape string, g int, n int")
            counts = values.groupBy(*key).agg(F.count("*").alias("_n"))
            if kind == "minCount":
                met = items.join(limits, "shape").join(counts, key, "left")
                return say(met.where(F.coalesce("_n", F.lit(0)) < F.col("n")), None)
            return say(counts.join(limits, "shape").where("_n > n"), None)
        if kind == "class":
            typed = self.instances({x for *_, x in one}).select(F.col("c").alias("arg"), F.col("node").alias("value"))
            return say(values.join(args(), "shape").join(typed, ["value", "arg"], "left_anti"))
        if kind in ("in", "languageIn"):
            rows = [(s, c.group, x) for s, c in used for x in c.args]
            with_sets = values.join(self.small([(s, c.group) for s, c in used], "shape string, g int"), "shape")
            if kind == "in":
                return say(with_sets.join(self.small(rows, "shape string, g int, value string"), ["shape", "g", "value"], "left_anti"))
            langs = self.small([(s, g, x.split('"')[1].lower()) for s, g, x in rows], "shape string, g int, lang string")
            own = with_sets.withColumn("_l", t.language(F.col("value")))
            hit = own.join(langs, ["shape", "g"]).where((F.col("_l") == F.col("lang")) | F.col("_l").startswith(F.concat("lang", F.lit("-")))).select(*key, "value", "g").distinct()
            return say(own.join(hit, [*key, "value", "g"], "left_anti"))
        if kind == "hasValue":
            held = values.select(*key, F.col("value").alias("arg"))
            return say(items.join(args(), "shape").join(held, [*key, "arg"], "left_anti"), None)
        if kind == "uniqueLang":
            langs = values.join(self.small([(s,) for s, _ in used], "shape string"), "shape").withColumn("_l", t.language(F.col("value"))).where("_l <> ''")
            return say(langs.groupBy(*key, "_l").agg(F.count("*").alias("_n")).where("_n > 1"), None)
        if kind in ("equals", "disjoint", "lessThan", "lessThanOrEquals"):
            other = items.join(args(), "shape").join(self.graph.select(F.col("s").alias("node"), F.col("p").alias("arg"), F.col("o").alias("other")), ["node", "arg"]).select(*key, "g", "other").distinct()
            mine = values.join(args(), "shape").select(*key, "g", "value")
            if kind == "disjoint":
                return say(mine.join(other.withColumnRenamed("other", "value"), [*key, "g", "value"], "left_semi"))
            if kind == "equals":
                theirs = other.withColumnRenamed("other", "value")
                return say(mine.join(theirs, [*key, "g", "value"], "left_anti")).union(say(theirs.join(mine, [*key, "g", "value"], "left_anti")))
            a, b = F.col("value"), F.col("other")
            less = lambda x, y: x < y if kind == "lessThan" else x <= y
            ok = F.coalesce(t.compared(a, b, less), less(t.moment(a), t.moment(b)), F.when((t.datatype(a) == t.datatype(b)) & t.number(a).isNull() & t.moment(a).isNull(), less(t.lexical(a), t.lexical(b))), F.lit(False))
            return say(mine.join(other, [*key, "g"]).where(~ok))
        if kind == "closed":
            allowed = self.small([(s, p) for s, c in used for p in c.args], "shape string, p string")
            out = items.join(self.small([(s,) for s, _ in used], "shape string"), "shape").join(self.graph.select(F.col("s").alias("node"), "p", F.col("o").alias("value")), "node")
            return say(out.join(allowed, ["shape", "p"], "left_anti"))
        if kind in ("or", "and", "xone", "not", "node", "qualified"):
            return self.logical(kind, used, items, values, say, key)
        met = values.join(self.small([(s, c.group, c.args[0], (c.args[1:] or [""])[0]) for s, c in used], "shape string, g int, arg string, flags string"), "shape")
        return say(met.where(~F.coalesce(self.predicate(kind), F.lit(False))))

    def predicate(self, kind: str) -> Column:
        v, arg = F.col("value"), F.col("arg")
        if kind == "datatype":
            return (t.datatype(v) == arg) & t.well_formed(v)
        if kind == "nodeKind":
            is_ = {"IRI": t.is_iri(v), "BlankNode": t.is_blank(v), "Literal": t.is_literal(v)}
            out = F.lit(False)
            for name, parts in {**{k: (k,) for k in is_}, "BlankNodeOrIRI": ("BlankNode", "IRI"), "BlankNodeOrLiteral": ("BlankNode", "Literal"), "IRIOrLiteral": ("IRI", "Literal")}.items():
                hit = F.lit(False)
                for p in parts:
                    hit = hit | is_[p]
                out = F.when(arg == sh(name), hit).otherwise(out)
            return out
        text = t.lexical(v)
        if kind in ("minLength", "maxLength"):
            n = F.char_length(text)
            limit = t.lexical(arg).try_cast("int")
            return ~t.is_blank(v) & (n >= limit if kind == "minLength" else n <= limit)
        if kind == "pattern":
            flags = t.lexical(F.col("flags"))
            return ~t.is_blank(v) & F.regexp_like(text, F.concat(F.when(flags != "", F.concat(F.lit("(?"), flags, F.lit(")"))).otherwise(F.lit("")), t.lexical(arg)))
        compare = {"minInclusive": lambda a, b: a >= b, "minExclusive": lambda a, b: a > b, "maxInclusive": lambda a, b: a <= b, "maxExclusive": lambda a, b: a < b}[kind]
        return F.coalesce(t.compared(v, arg, compare), compare(t.moment(v), t.moment(arg)))

    def logical(self, kind: str, used: list, items: DataFrame, values: DataFrame, say, key: list[str]) -> DataFrame:
        """Operand shapes are validated for the values that meet them; a constraint then counts operands that hold."""
        operands = self.small([(s, c.group, i, x) for s, c in used for i, x in enumerate(c.args)], "shape string, g int, i int, arg string")
        wanted = values.join(operands, "shape").select(F.col("arg").alias("shape"), F.col("value").alias("node"))
        names = {x for _, c in used for x in c.args}
        if siblings := [(s, c.group, x) for s, c in used for x in c.siblings]:
            wanted = wanted.union(values.join(self.small(siblings, "shape string, g int, arg string"), "shape").select("arg", "value"))
            names |= {x for *_, x in siblings}
        failed = self.results(wanted.distinct(), names).select(F.col("root").alias("arg"), F.col("focus").alias("value")).distinct()
        failed = stored(failed.withColumn("_bad", F.lit(True)), "failed")
        groups = self.small([(s, c.group, len(c.args)) for s, c in used], "shape string, g int, all int")
        met = values.join(groups, "shape").join(operands.drop("i") if kind == "node" else operands, ["shape", "g"], "left").join(failed, ["arg", "value"], "left")
        held = met.groupBy(*key, "value", "g", "all").agg(F.count_if(F.col("arg").isNotNull() & F.col("_bad").isNull()).alias("_held"))
        if kind == "or":
            # An empty list of alternatives holds for everything.
            return say(held.where("_held = 0 AND all > 0"))
        if kind == "xone":
            return say(held.where("_held <> 1"))
        if kind in ("and", "node"):
            return say(held.where("_held < all"))
        if kind == "not":
            return say(held.where("_held > 0"))
        good = held.where("_held = 1")
        if siblings:
            others = values.join(self.small(siblings, "shape string, g int, arg string"), "shape").join(failed, ["arg", "value"], "left_anti").select(*key, "value", "g").distinct()
            good = good.join(others, [*key, "value", "g"], "left_anti")
        counts = good.groupBy(*key, "g").agg(F.count("*").alias("_n"))
        limits = self.small([(s, c.group, c.low, c.high) for s, c in used], "shape string, g int, low int, high int")
        full = items.join(limits, "shape").join(counts, [*key, "g"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
        low = say(full.where("_n < low"), None, sh("QualifiedMinCountConstraintComponent"))
        return low.union(say(full.where("_n > high"), None, sh("QualifiedMaxCountConstraintComponent")))


def validate(graph: DataFrame, shapes: Shapes, only: Iterable[str] | None = None) -> DataFrame:
    """The results of all targeted shapes: focus, path, value, component, shape, severity, message. No rows: conforms.

    shape is the shape that the failing constraint stands in. A node that two shapes target is validated by both.
    """
    v = Validator(graph, shapes, store=True)
    roots = list(only or shapes.roots)
    if not roots:
        return v.spark.createDataFrame([], ROWS).drop("root")
    return v.results(v.focus_nodes(roots), set(roots)).drop("root")


__all__ = ["RESULT", "Validator", "validate"]
