"""Compiles a shapes graph: shapes, their targets, paths and constraints as rows.

Unknown parameters (misspelt ones, sh:value, sh:NodeKind as a parameter) are ignored, as the standard asks; a sh:node
that names no shape is an empty shape, to which everything conforms.
"""

from __future__ import annotations

import warnings
from collections import defaultdict
from dataclasses import dataclass, field

from ..functions.terms import FIRST, NIL, RDFS, REST, SH, TYPE, iri

Path = tuple  # ("p", iri) | ("inv" | "star" | "plus" | "opt", path) | ("seq" | "alt", path, ...)


def sh(name: str) -> str:
    return iri(SH + name)


VALUE_KINDS = ("class", "datatype", "nodeKind", "minExclusive", "minInclusive", "maxExclusive", "maxInclusive", "minLength", "maxLength", "pattern", "hasValue", "equals", "disjoint", "lessThan", "lessThanOrEquals", "minCount", "maxCount")
LIST_KINDS = ("in", "languageIn")


@dataclass
class Constraint:
    kind: str
    args: list[str] = field(default_factory=list)  # terms, or ids of operand shapes
    group: int = 0
    low: int | None = None  # of qualified counts
    high: int | None = None
    siblings: list[str] = field(default_factory=list)


@dataclass
class Shape:
    id: str
    path: Path | None = None
    targets: list[tuple[str, str]] = field(default_factory=list)
    constraints: list[Constraint] = field(default_factory=list)
    properties: list[str] = field(default_factory=list)
    severity: str = sh("Violation")
    message: str = ""


class Shapes(dict):
    """Shape id -> Shape, those that validation starts from, and the graph they were read from."""

    def __init__(self, triples: list[tuple[str, str, str]]):
        super().__init__()
        self.triples = list(triples)
        self.out: dict[str, dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
        for s, p, o in self.triples:
            self.out[s][p].append(o)
        declared = {s for s, p, o in triples if p == TYPE and o in (sh("NodeShape"), sh("PropertyShape"))}
        declared |= {s for s, p, _ in triples if p in (sh("targetClass"), sh("targetNode"), sh("targetSubjectsOf"), sh("targetObjectsOf"), sh("property"), sh("path"))}
        for s in sorted(declared):
            self.shape(s)
        self.roots = [s for s in self if self[s].targets]
        self.strata()

    def get_all(self, s: str, p: str) -> list[str]:
        return self.out[s][p] if s in self.out and p in self.out[s] else []

    def items_of(self, node: str) -> list[str]:
        out = []
        while node != NIL and self.get_all(node, FIRST):
            out += self.get_all(node, FIRST)[:1]
            node = (self.get_all(node, REST) or [NIL])[0]
        return out

    def path(self, node: str) -> Path:
        for kind, name in (("inv", "inversePath"), ("star", "zeroOrMorePath"), ("plus", "oneOrMorePath"), ("opt", "zeroOrOnePath")):
            if inner := self.get_all(node, sh(name)):
                return (kind, self.path(inner[0]))
        if alt := self.get_all(node, sh("alternativePath")):
            return ("alt", *map(self.path, self.items_of(alt[0])))
        if self.get_all(node, FIRST):
            return ("seq", *map(self.path, self.items_of(node)))
        return ("p", node)

    def shape(self, s: str) -> str:
        if s in self:
            return s
        if s not in self.out:
            warnings.warn(f"{s} is not a shape; everything conforms to it", stacklevel=2)
        get = lambda name: self.get_all(s, sh(name))
        shape = self[s] = Shape(s)
        if get("deactivated") and get("deactivated")[0].startswith('"true"'):
            return s
        if get("path"):
            shape.path = self.path(get("path")[0])
        shape.severity = (get("severity") or [shape.severity])[0]
        shape.message = (get("message") or [""])[0]
        for kind in ("targetClass", "targetNode", "targetSubjectsOf", "targetObjectsOf"):
            shape.targets += [(kind, x) for x in get(kind)]
        if any(c in self.get_all(s, TYPE) for c in (iri(RDFS + "Class"), "<http://www.w3.org/2002/07/owl#Class>")):
            shape.targets.append(("targetClass", s))
        add = lambda *a, **k: shape.constraints.append(Constraint(*a, group=len(shape.constraints), **k))
        for kind in VALUE_KINDS:
            for value in get(kind):
                add(kind, [value] + (get("flags")[:1] if kind == "pattern" else []))
        for kind in LIST_KINDS:
            for value in get(kind):
                add(kind, self.items_of(value))
        for kind in ("or", "and", "xone"):
            for value in get(kind):
                add(kind, [self.shape(x) for x in self.items_of(value)])
        for kind in ("not", "node"):
            for value in get(kind):
                add(kind, [self.shape(value)])
        if get("uniqueLang") and get("uniqueLang")[0].startswith('"true"'):
            add("uniqueLang")
        if get("closed") and get("closed")[0].startswith('"true"'):
            allowed = [x for v in get("ignoredProperties") for x in self.items_of(v)]
            add("closed", allowed + [p for ps in get("property") for p in self.get_all(ps, sh("path"))])
        number = lambda name: int(get(name)[0].split('"')[1]) if get(name) else None
        for value in get("qualifiedValueShape"):
            others = []
            if get("qualifiedValueShapesDisjoint") and get("qualifiedValueShapesDisjoint")[0].startswith('"true"'):
                parents = [x for x, p, o in self.triples if p == sh("property") and o == s]
                others = [q for x in parents for ps in self.get_all(x, sh("property")) if ps != s for q in self.get_all(ps, sh("qualifiedValueShape")) if q != value]
            add("qualified", [self.shape(value)], low=number("qualifiedMinCount"), high=number("qualifiedMaxCount"), siblings=[self.shape(q) for q in others])
        shape.properties = [self.shape(x) for x in get("property")]
        return s

    def operands(self, s: str) -> list[str]:
        return [x for c in self[s].constraints if c.kind in ("or", "and", "xone", "not", "node", "qualified") for x in c.args + c.siblings] + self[s].properties

    def strata(self) -> dict[str, int]:
        """Depth of each shape over the shapes it refers to; a shape that reaches itself is refused."""
        depth: dict[str, int] = {}

        def visit(s: str, above: tuple[str, ...]) -> int:
            if s in above:
                raise ValueError(f"recursive shape {s}")
            if s not in depth:
                depth[s] = 1 + max((visit(x, (*above, s)) for x in self.operands(s)), default=0)
            return depth[s]

        for s in self:
            visit(s, ())
        return depth

    def property_shapes(self) -> list[str]:
        return sorted({p for s in self for p in self[s].properties})

    def target_classes(self) -> set[str]:
        return {x for s in self for kind, x in self[s].targets if kind == "targetClass"}

    def rewritten(self, nodes: dict[str, str], paths: dict[str, str]) -> Shapes:
        """The shapes with target nodes and paths replaced by their representatives."""
        rules = {sh("targetNode"): nodes, sh("path"): paths}
        return Shapes([(s, p, rules[p].get(o, o) if p in rules else o) for s, p, o in self.triples])


__all__ = ["Constraint", "Path", "Shape", "Shapes", "sh"]
