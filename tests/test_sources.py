"""Parsers, loaders and writers."""

import pytest
from pyspark.sql import functions as F

from sparkshapes.functions import terms as t
from sparkshapes.sources import loader
from sparkshapes.sources.turtle import TurtleError, parse_rdfxml, parse_turtle

HARBOUR = """@prefix : <http://e/> .
@prefix owl: <http://www.w3.org/2002/07/owl#>.
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
# what calls at a port is a vessel, and what berths vessels is a port
:calledAt rdfs:domain :Vessel .
:berths rdfs:range :Vessel ; rdfs:domain :Port .
:Tug rdfs:subClassOf :Ship . :Vessel owl:equivalentClass :Ship .
:Ship rdfs:subClassOf :Craft . :Craft rdfs:subClassOf :Hull . :Hull rdfs:subClassOf :Craft .
:pilotedInto rdfs:subPropertyOf :calledAt . :enteredAt owl:equivalentProperty :pilotedInto . :hosted owl:inverseOf :calledAt .
:boreas :calledAt :north . :north :berths :aurora .
:aurora :enteredAt :north ; a :Tug ; owl:sameAs :aurora2 .
"""


def test_turtle_features():
    text = """@base <http://b/> . PREFIX x: <http://x/>
    x:s a x:C ; x:p 1, -2.5, 3e4, true, "a\\"b"@EN, 'c'^^<http://x/d>, <rel>, [ x:q ( x:a "l" ) ; ] ; .
    x:s x:long \"\"\"two
lines\"\"\" . x:pct <http://x/%3Ca%3E> [] ."""
    quads = parse_turtle(text)
    objects = [o for s, p, o, _ in quads if s == "<http://x/s>"]
    assert t.literal("1", t.XSD + "integer") in objects and t.literal("-2.5", t.XSD + "decimal") in objects and t.literal("3e4", t.XSD + "double") in objects
    assert '"a\\"b"@en' in objects and '"c"^^<http://x/d>' in objects and "<http://b/rel>" in objects and '"two\\nlines"' in objects
    assert sum(p == t.FIRST for _, p, _, _ in quads) == 2 and any(p == "<http://x/%3Ca%3E>" for _, p, _, _ in quads)
    with pytest.raises(TurtleError):
        parse_turtle("<a> <b> unknown:c .")


def test_trig_and_first_graph(spark):
    quads = loader.load_quads(spark, b"<http://g/2> { <a:s> <a:p> <a:o> } GRAPH <http://g/1> { <a:s> <a:p> 1 . }")
    assert {r.g for r in quads.collect()} == {"<http://g/1>", "<http://g/2>"}
    assert [r.o for r in loader.first_graph(quads).collect()] == [t.literal("1", t.XSD + "integer")]
    assert loader.named_graphs(quads).count() == 2


def test_rdfxml():
    text = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/" xml:base="http://b/">
    <e:C rdf:about="#x" e:name="n"><e:p rdf:resource="y"/><e:q rdf:parseType="Collection"><rdf:Description rdf:about="http://e/1"/></e:q>
    <e:r rdf:datatype="http://d">v</e:r><e:s><e:D/></e:s><e:t xml:lang="fr">mot</e:t></e:C></rdf:RDF>"""
    quads = {q[:3] for q in parse_rdfxml(text)}
    assert ("<http://b/#x>", t.TYPE, "<http://e/C>") in quads and ("<http://b/#x>", "<http://e/p>", "<http://b/y>") in quads
    assert ("<http://b/#x>", "<http://e/r>", '"v"^^<http://d>') in quads and ("<http://b/#x>", "<http://e/t>", '"mot"@fr') in quads
    assert any(p == t.FIRST and o == "<http://e/1>" for _, p, o in quads)


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "Toy-a.ttl").write_text(HARBOUR)
    graph = loader.load_data_graph(spark, str(tmp_path / "Toy-a.ttl"))
    loader.write_ntriples(graph, str(tmp_path / "out"))
    again = loader.load_data_graph(spark, str(tmp_path / "out"), "nt")
    assert graph.count() == again.count() == 16 and graph.subtract(again).isEmpty()
    text = loader.to_turtle([tuple(r) for r in graph.collect()], {"e": "http://e/"})
    assert {q[:3] for q in parse_turtle(text)} == {tuple(r) for r in graph.collect()} and "e:aurora" in text
    assert len(loader.find_files(spark, str(tmp_path), "toy")) == 1
    loader.write_text(spark, "x", str(tmp_path / "deep/er/file.txt"))
    assert (tmp_path / "deep/er/file.txt").read_text() == "x"
    assert loader.load_with_ontology(spark, str(tmp_path / "Toy-a.ttl"), str(tmp_path / "Toy-a.ttl")).count() == 16


def test_ntriples_lines(spark, tmp_path):
    for name, text in (("one.nt", '_:x <a:p> "caf\\u00e9 \\\\n" . # end\n# none\n\n<a:s> <a:p> "1"^^<http://www.w3.org/2001/XMLSchema#string> .\n'), ("two.nt", '_:x <a:p> "b"@EN .\n')):
        (tmp_path / name).write_text(text)
    one, two = ({(r.s, r.o) for r in loader.load_data_graph(spark, str(tmp_path / f)).collect()} for f in ("one.nt", "two.nt"))
    assert {o for _, o in one} == {t.literal("café \\n"), '"1"'} and {o for _, o in two} == {'"b"@en'}
    assert not {s for s, _ in one if s.startswith("_:")} & {s for s, _ in two}
    assert {q[2] for q in loader.parse((tmp_path / "one.nt").read_text(), "ntriples")} == {o for _, o in one}
    (tmp_path / "bad.nt").write_text("<a:s> <a:p> .\n")
    with pytest.raises(Exception, match="malformed"):
        loader.load_data_graph(spark, str(tmp_path / "bad.nt")).count()


def test_terms(spark):
    terms = [t.literal("C:\\new"), t.literal('say "x"\n'), t.literal("300", t.XSD + "byte"), t.literal("-5", t.XSD + "byte"), t.literal("9007199254740993", t.XSD + "integer"), "<a:b>"]
    rows = spark.createDataFrame([(x,) for x in terms], "c string").select(t.lexical(F.col("c")).alias("text"), t.well_formed(F.col("c")).alias("fits"), t.compared(F.col("c"), F.lit(t.literal("9007199254740992", t.XSD + "long")), lambda a, b: a > b).alias("more")).collect()
    assert [r.text for r in rows] == ["C:\\new", 'say "x"\n', "300", "-5", "9007199254740993", "a:b"]
    assert [r.fits for r in rows[2:5]] == [False, True, True] and rows[4].more and rows[0].more is None


def test_names_and_errors(spark):
    assert loader.dataset_name("a/b/lubm-skg-1.ttl") == "lubm/skg1" and loader.dataset_name("x/Lite50(no).ttl") == "Lite50"
    assert loader.dataset_name("x/run7-b.ttl", r"run(?P<n>\d+)-(?P<v>.)", r"\g<v>\g<n>") == "b7" and loader.dataset_name("x/plain.ttl") == "plain"
    assert loader.ontology_for("EnDe-50", {"ende": "o.owl"}) == "o.owl" and loader.ontology_for("lubm", {"ende": "o"}) is None
    with pytest.raises(ValueError):
        loader.load_data_graph(spark, 3)
    with pytest.raises(ValueError):
        loader.format_of("x.pdf")
