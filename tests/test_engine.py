"""Reasoning: goldens of the harbour graph, rules one by one, and merge against materialise."""

import random

import pytest

from sparkshapes.operators import graph as g
from sparkshapes.operators import components, pending
from sparkshapes.operators import rules as r
from sparkshapes.operators.closure import SchemaTooLarge, collected, transitive
from sparkshapes.operators.components import connected_components
from sparkshapes.plans.engine import FusionError, full_closure, fuse, infer
from sparkshapes.plans.shapes import Shapes
from sparkshapes.plans.validator import validate
from sparkshapes.sources.loader import load_data_graph
from sparkshapes.sources.turtle import parse_turtle
from tests.test_sources import HARBOUR

PREFIX = "@prefix : <http://e/> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\n"
SHAPE = PREFIX + ":S a sh:NodeShape ; sh:targetClass :Vessel ; sh:property [ sh:path :calledAt ; sh:class :Port ] , [ sh:path :pilotedInto ; sh:class :Port ; ] ."


def graph(spark, text):
    return spark.createDataFrame([q[:3] for q in parse_turtle(PREFIX + text)], "s string, p string, o string")


def shapes(text):
    return Shapes([q[:3] for q in parse_turtle(PREFIX + text)])


def e(*names):
    return {f"<http://e/{n}>" for n in names}


def facts(df):
    return {tuple(x.removeprefix("<http://e/").removesuffix(">") for x in row) for row in df.select("s", "p", "o").collect()}


def test_harbour_goldens(spark):
    """Called at, piloted into and entered at lead to ports; what calls is a vessel, so also a ship."""
    data, s = graph(spark, HARBOUR), shapes(SHAPE)
    assert validate(data, s).count() == 0
    fused = fuse(data, s, materialize_types=True)
    assert fused.classes == e("Vessel", "Ship", "Tug", "Port") - e("Tug") and fused.paths == e("calledAt", "pilotedInto")
    assert {x.node for x in fused.focus.collect()} == e("aurora", "boreas", "north")
    assert {x.rep: set(x.members) for x in fused.same_sets().collect()} == {"<http://e/aurora>": e("aurora2"), "<http://e/boreas>": set(), "<http://e/north>": set()}
    found = facts(fused.graph)
    assert {("aurora", "pilotedInto", "north"), ("aurora", "calledAt", "north"), ("north", "hosted", "aurora"), ("north", "hosted", "boreas")} <= found
    assert not any(p == "enteredAt" for _, p, _ in found)
    types = {s: {o for x, p, o in found if x == s and p.endswith("#type")} for s in ("aurora", "boreas", "north")}
    assert types == {"aurora": {"Tug", "Vessel", "Ship", "Craft", "Hull"}, "boreas": {"Vessel", "Ship", "Craft", "Hull"}, "north": {"Port"}}
    assert {(s, o) for s, p, o in found if p.endswith("sameAs")} == {("aurora", "aurora2")}
    assert validate(fused.graph, fused.shapes).count() == 0
    stranded = fuse(graph(spark, HARBOUR + ":boreas :calledAt :reef ."), s)
    assert {(x.focus, x.value) for x in validate(stranded.graph, stranded.shapes).collect()} == {("<http://e/boreas>", "<http://e/reef>")}


def test_order_does_not_matter_and_fusing_again_adds_nothing(spark):
    # A sub-property that gains assertions only through an equivalent property.
    data = graph(spark, ":q rdfs:subPropertyOf :calledAt . :z owl:equivalentProperty :q . :a a :Vessel ; :z :b .")
    s = shapes(SHAPE)
    first = fuse(data, s)
    assert ("a", "calledAt", "b") in facts(first.graph)
    shuffled = fuse(data.orderBy("o").repartition(3, "p"), s)
    assert facts(first.graph) == facts(shuffled.graph)
    assert facts(fuse(first.graph, first.shapes).graph) == facts(first.graph)


def test_class_level_same_as_ends(spark):
    fused = fuse(graph(spark, ":Vessel owl:sameAs :Bateau . :x a :Bateau ."), shapes(SHAPE))
    assert any(s == "x" and o == "Vessel" for s, _, o in facts(fused.graph))


def test_target_node_moves_with_its_node(spark):
    s = shapes(":S sh:targetNode :b, :a ; sh:property [ sh:path :p ; sh:minCount 2 ] .")
    fused = fuse(graph(spark, ":a :p 1 . :b :p 2 ; owl:sameAs :a ."), s)
    assert {x for _, x in fused.shapes["<http://e/S>"].targets} == e("a")
    assert validate(fused.graph, fused.shapes).count() == 0


def test_functional_literals(spark):
    found = facts(r.functional_same(graph(spark, ":a :p 1, 2 . :b :p 3 ."), e("p")))
    assert len(found) == 1 and next(iter(found))[1].endswith("sameAs")


def test_merge_and_materialise_agree(spark):
    data = graph(spark, HARBOUR + ":cirrus a :Vessel . :boreas :calledAt :reef .")
    s = shapes(SHAPE.replace(":Port ] ,", ":Port ; sh:minCount 1 ] ,"))
    merged = fuse(data, s)
    to = {x.member: x.rep for x in merged.same.where("member IS NOT NULL").collect()}
    a = {(x.focus, x.value, x.component) for x in validate(merged.graph, merged.shapes).collect()}
    b = {(to.get(x.focus, x.focus), to.get(x.value, x.value), x.component) for x in validate(infer(data, s), s).collect()}
    assert a == b and a


def test_full_closures(spark):
    data = graph(spark, HARBOUR)
    rdfs, owl = facts(full_closure(data, "rdfs")), facts(full_closure(data))
    assert any(s == "aurora" and o == "Hull" for s, _, o in rdfs) and ("aurora", "calledAt", "north") not in rdfs
    assert ("aurora2", "calledAt", "north") in owl and ("north", "hosted", "aurora2") in owl


def test_class_expressions(spark):
    lists = "@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . "
    data = graph(spark, lists + """:x a :A, :B ; :p :v . :y a :A . :v a :D . :Both owl:intersectionOf ( :A :B ) . :Any owl:unionOf ( :B :E ) .
    :Some owl:onProperty :p ; owl:someValuesFrom :D . :Thing1 owl:onProperty :p ; owl:someValuesFrom owl:Thing . :A rdfs:subClassOf :One . :One owl:onProperty :q ; owl:maxCardinality 1 . :x :q :m, :n .
    :Only owl:onProperty :p ; owl:allValuesFrom :F . :B rdfs:subClassOf :Only . :Has owl:onProperty :r ; owl:hasValue :z . :y a :Has . :w :r :z . :Few owl:oneOf ( :y :w ) .
    :A owl:hasKey ( :k ) . :x :k 5 . :k1 a :A ; :k 5 . :grand owl:propertyChainAxiom ( :p :s ) . :v :s :t . :p owl:sameAs :pp .""")
    found = facts(full_closure(data))
    types = {(s, o) for s, p, o in found if p.endswith("#type")}
    assert {("x", "Both"), ("x", "Any"), ("x", "Some"), ("x", "Thing1"), ("v", "F"), ("w", "Has"), ("y", "Few"), ("w", "Few")} <= types and ("y", "Both") not in types
    same = {(s, o) for s, p, o in found if p.endswith("sameAs")}
    assert {("m", "n"), ("n", "m"), ("x", "k1")} <= same
    assert {("y", "r", "z"), ("x", "grand", "t"), ("x", "pp", "v"), ("k1", "q", "n")} <= found
    assert ("x", "Resource") in {(s, o.rpartition("#")[2]) for s, p, o in facts(full_closure(data, "rdfs", resources=True))}


def test_pending(spark):
    data = graph(spark, ":a owl:sameAs :b . :p owl:equivalentProperty :q . :r rdfs:subPropertyOf :p . :C owl:equivalentClass :D .")
    nodes = lambda *names: spark.createDataFrame([(f"<http://e/{n}>",) for n in names], "node string")
    iris = lambda *names: [f"<http://e/{n}>" for n in names]
    assert not pending.properties_settled(data, iris("q")) and pending.properties_settled(data, iris("q"), owl=False) and pending.properties_settled(data, iris("r"))
    assert not pending.below_settled(data, iris("p")) and pending.below_settled(data, iris("q", "r")) and not pending.paths_settled(data, iris("p"), owl=False)
    assert not pending.classes_settled(data, iris("C", "E")) and pending.classes_settled(data, iris("E")) and pending.classes_settled(data, iris("C"), owl=False)
    # A focus node that something else is the same as is settled only if that is a focus node too.
    assert not pending.focus_settled(data, nodes("a")) and not pending.focus_settled(data, nodes("b")) and pending.focus_settled(data, nodes("c"))
    assert {r.node for r in pending.unsettled_focus(data, nodes("a", "b")).collect()} == {"<http://e/a>"}
    assert pending.has_candidates(data, "<http://e/D>", pending.CLASS_LINKS) and not pending.has_candidates(data, "<http://e/D>", pending.EITHER_SAME)


def test_isomorphism_beyond_colours(spark):
    """Two triangles and a hexagon look the same to refinement."""
    ring = lambda name, n: [(f"_:{name}{i}", "next", f"_:{name}{(i + 1) % n}") for i in range(n)]
    make = lambda rows: spark.createDataFrame(rows, "s string, p string, o string")
    both = make(ring("a", 3) + ring("b", 3))
    assert not g.isomorphic(both, make(ring("h", 6))) and g.isomorphic(both, make(ring("c", 3) + ring("d", 3)))


@pytest.mark.parametrize("method", ["direct", "direct-rdfs", "direct-owl", "merged", "merged-rdfs"])
def test_methods(spark, method):
    from sparkshapes.cli import results_of

    found = results_of(graph(spark, HARBOUR + ":boreas :calledAt :reef ."), shapes(SHAPE), method)
    hits = {(x.focus, x.value) for x in found.collect()}
    assert (("<http://e/boreas>", "<http://e/reef>") in hits) == (method != "direct")


def test_command_line(spark, tmp_path, capsys):
    from sparkshapes import cli

    (tmp_path / "bay.ttl").write_text(HARBOUR + ":boreas :calledAt :reef .")
    (tmp_path / "s.ttl").write_text(SHAPE)
    for _ in range(2):
        assert cli.main([str(tmp_path / "bay.ttl"), str(tmp_path / "s.ttl"), "--method", "merged", "--rounds", "1", "--out", str(tmp_path / "out")]) == 0
    assert "merging" in capsys.readouterr().out
    assert (tmp_path / "out/bay/times.txt").read_text().count("| merging") == 2 and "Conforms: False" in (tmp_path / "out/bay/reports/merged.txt").read_text()
    again = load_data_graph(spark, str(tmp_path / "out/bay/reportGraphs/merged"), "ttl")
    assert again.where("p LIKE '%#result>'").join(again.where("p LIKE '%#focusNode>'").selectExpr("s AS o", "o AS focus"), "o").first().focus == "<http://e/boreas>"


def test_consistency(spark):
    data = graph(spark, ":p a owl:IrreflexiveProperty . :x :p :x . :A owl:disjointWith :B . :y a :A, :B . :m owl:sameAs :n . :n owl:differentFrom :m .")
    assert {x.rule for x in r.check_consistency(data).collect()} == {"prp-irp", "cax-dw", "eq-diff1"}
    with pytest.raises(FusionError):
        fuse(data, shapes(SHAPE), on_inconsistency="raise")


def test_closures_and_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "d")], "s string, o string")
    assert transitive(edges).count() == 10
    assert {tuple(x) for x in connected_components(edges, "s", "o").collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")}
    assert connected_components(edges.limit(0), "s", "o").count() == 0
    with pytest.raises(SchemaTooLarge):
        collected(edges, 2)


def test_few_edges_take_no_rounds(spark, monkeypatch):
    """Few edges are joined by one task, with the same least nodes as the rounds give, for every kind of id."""
    rng = random.Random(7)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    for form, kind in ((lambda x: x - 150, "long"), (lambda x: f"\u00e9{x:x}\U0001f600" if x % 3 else f"\uffff{x}", "string"), (lambda x: bytes([x % 256, x // 256]), "binary")):
        edges = spark.createDataFrame([(form(a), form(b)) for a, b in pairs] + [(None, form(1))], f"s {kind}, o {kind}")
        found = []
        for few in (0, components.FEW):
            monkeypatch.setattr(components, "FEW", few)
            found.append({tuple(x) for x in connected_components(edges, "s", "o").collect()})
            monkeypatch.undo()
        assert found[0] == found[1] and len(found[0]) == len({x for p in pairs for x in p})
    monkeypatch.setattr(components, "_star", None)
    assert connected_components(edges, "s", "o").count() == len(found[0])


def test_graph_operators(spark):
    a, b = graph(spark, ":s :p _:x . _:x :q 1 ."), graph(spark, ":s :p _:y . _:y :q 1 .")
    assert g.isomorphic(a, b) and not g.isomorphic(a, graph(spark, ":s :p _:y . _:y :q 2 ."))
    assert {(x.side, x.n, x.n_blank) for x in g.difference_counts(a, b).collect()} == {("left", 2, 2), ("right", 2, 2)}
    assert g.triples(a, p="<http://e/p>").count() == 1 and g.objects(a).count() == 2 and g.star(a, a.where("p = '<http://e/p>'").select("o")).count() == 1


def test_shapes_rewriting_and_recursion():
    with pytest.raises(ValueError):
        shapes(":S sh:targetClass :C ; sh:node :T . :T a sh:NodeShape ; sh:node :S .")
    with pytest.warns(UserWarning):
        s = shapes(":S sh:targetClass :C ; sh:property [ sh:path :p ; sh:node :NoShape ; sh:manCount 1 ; sh:NodeKind sh:IRI ; sh:value 3 ] .")
    assert [c.kind for c in s[s.property_shapes()[0]].constraints] == ["node"]
    assert s.rewritten({}, {"<http://e/p>": "<http://e/q>"})[s.property_shapes()[0]].path == ("p", "<http://e/q>")


def test_isomorphism_reaches_a_fixpoint(spark):
    def chains(*lengths):
        rows = [(f"_:c{c}n{i}", "next", f"_:c{c}n{i + 1}" if i < n - 1 else "nil") for c, n in enumerate(lengths) for i in range(n)]
        return spark.createDataFrame(rows, "s string, p string, o string")

    assert not g.isomorphic(chains(10, 20), chains(15, 15)) and g.isomorphic(chains(10, 20), chains(20, 10))
