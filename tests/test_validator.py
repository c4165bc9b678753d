"""Each constraint component with nodes that conform and nodes that do not."""

import pytest

from sparkshapes.plans.report import conforms, pretty_table, report_counts, report_graph, report_text
from sparkshapes.plans.validator import validate
from sparkshapes.streaming.validate import validate_stream
from tests.test_engine import graph, shapes

DATA = """:a a :C ; :n 1, 5 ; :s "abc"@en, "d"@EN, "x" ; :f :b ; :d "2020-02-30"^^xsd:date ; :e "2021-01-01"^^xsd:date .
:b a :D ; :n 3 ; :s "abcd" ; :f :a, :c ; :w "7"^^xsd:nonNegativeInteger . :D rdfs:subClassOf :C . :c a :E ; :m "-4"^^xsd:nonNegativeInteger ; :n 2 ."""
CASES = {
    "sh:path :n ; sh:minCount 2": {("b", None)},
    "sh:path :n ; sh:maxCount 1": {("a", None)},
    "sh:path :f ; sh:class :C": {("b", "c")},
    "sh:path :d ; sh:datatype xsd:date": {("a", '"2020-02-30"')},
    "sh:path :e ; sh:datatype xsd:date": set(),
    "sh:path :n ; sh:datatype xsd:string": {("a", '"1"'), ("a", '"5"'), ("b", '"3"')},
    "sh:path :n ; sh:in ( 1 3 )": {("a", '"5"')},
    "sh:path :n ; sh:minInclusive 2 ; sh:maxExclusive 5": {("a", '"1"'), ("a", '"5"')},
    "sh:path :s ; sh:minLength 2 ; sh:maxLength 3": {("a", '"d"'), ("a", '"x"'), ("b", '"abcd"')},
    'sh:path :s ; sh:pattern "^A" ; sh:flags "i"': {("a", '"d"'), ("a", '"x"')},
    'sh:path :s ; sh:languageIn ( "en" )': {("a", '"x"'), ("b", '"abcd"')},
    "sh:path :s ; sh:uniqueLang true": {("a", None)},
    "sh:path :n ; sh:hasValue 3": {("a", None)},
    "sh:path :f ; sh:nodeKind sh:Literal": {("a", "b"), ("b", "a"), ("b", "c")},
    "sh:path :n ; sh:equals :n": set(),
    "sh:path :f ; sh:disjoint :f": {("a", "b"), ("b", "a"), ("b", "c")},
    "sh:path :e ; sh:lessThan :e": {("a", '"2021-01-01"')},
    "sh:path :f ; sh:or ( [ sh:class :D ] [ sh:class :E ] )": {("b", "a")},
    "sh:path :f ; sh:or ( )": set(),
    "sh:path :f ; sh:and ( [ sh:class :C ] [ sh:class :D ] )": {("b", "a"), ("b", "c")},
    "sh:path :f ; sh:xone ( [ sh:class :C ] [ sh:class :D ] )": {("a", "b"), ("b", "c")},
    "sh:path :f ; sh:not [ sh:class :E ]": {("b", "c")},
    "sh:path :f ; sh:node [ sh:property [ sh:path :s ; sh:minCount 1 ] ]": {("b", "c")},
    "sh:path :f ; sh:qualifiedValueShape [ sh:class :C ] ; sh:qualifiedMinCount 2": {("a", None), ("b", None)},
    "sh:path ( :f :f ) ; sh:minCount 2": {("b", None)},
    "sh:path [ sh:inversePath :f ] ; sh:maxCount 0": {("a", None), ("b", None)},
    "sh:path [ sh:alternativePath ( :n :s ) ] ; sh:maxCount 4": {("a", None)},
    "sh:path [ sh:zeroOrMorePath :f ] ; sh:class :C": {("a", "c"), ("b", "c")},
    "sh:path [ sh:oneOrMorePath :f ] ; sh:minCount 4": {("a", None), ("b", None)},
    "sh:path [ sh:zeroOrOnePath :f ] ; sh:maxCount 2": {("b", None)},
}


def short(x):
    return x and x.removeprefix("<http://e/").removesuffix(">").split("^^")[0].split("@")[0]


@pytest.fixture(scope="module")
def data(spark):
    return graph(spark, DATA).cache()


@pytest.mark.parametrize("body", CASES)
def test_component(data, body):
    found = validate(data, shapes(f":S a sh:NodeShape ; sh:targetClass :C ; sh:property [ {body} ] ."))
    assert {(short(x.focus), short(x.value)) for x in found.collect()} == CASES[body]


def test_node_shapes_targets_and_closed(spark, data):
    s = shapes(""":S sh:targetSubjectsOf :w ; sh:closed true ; sh:ignoredProperties ( <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> ) ; sh:property [ sh:path :n ] .
    :T sh:targetNode :c, :gone ; sh:class :E . :U sh:targetObjectsOf :f ; sh:nodeKind sh:IRI . :V sh:targetClass :C ; sh:deactivated true ; sh:class :Z .""")
    found = {(short(x.focus), short(x.value), short(x.shape)) for x in validate(data, s).collect()}
    assert found == {("b", '"abcd"', "S"), ("b", "a", "S"), ("b", "c", "S"), ("b", '"7"', "S"), ("gone", "gone", "T")}


def test_report(spark, data, tmp_path):
    s = shapes(':S sh:targetClass :C ; sh:property [ sh:path :n ; sh:minCount 2 ; sh:maxCount 1 ; sh:message "count" ; sh:severity sh:Warning ] .')
    results = validate(data, s)
    assert not conforms(results) and report_counts(results).count() == 2
    text = report_text(results)
    assert "Conforms: False" in text and "Results (2)" in text and "count" in text
    triples = {tuple(x) for x in report_graph(results).collect()}
    assert sum(p.endswith("result>") for _, p, _ in triples) == 2 and any(p.endswith("resultMessage>") for _, p, _ in triples)
    assert conforms(validate(data, shapes(":S sh:targetClass :None ; sh:class :X .")))
    assert pretty_table(["a"], [[1]]).count("\n") == 5


def test_stream(spark, data, tmp_path):
    data.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    seen = []
    s = shapes(":S sh:targetClass :C ; sh:property [ sh:path :n ; sh:minCount 2 ] .")
    q = validate_stream(stream, s, data.where("p LIKE '%subClassOf>'"), lambda df, n: seen.extend(df.collect()), str(tmp_path / "cp"), availableNow=True)
    q.awaitTermination()
    assert {short(x.focus) for x in seen} == {"b"}
