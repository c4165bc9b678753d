"""RDF terms as canonical N-Triples strings, and what columns can tell from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SH = "http://www.w3.org/ns/shacl#"
XSD = "http://www.w3.org/2001/XMLSchema#"


def iri(text: str) -> str:
    return f"<{text}>"


TYPE, FIRST, REST, NIL = (iri(RDF + x) for x in ("type", "first", "rest", "nil"))
SUBCLASS, SUBPROPERTY, DOMAIN, RANGE = (iri(RDFS + x) for x in ("subClassOf", "subPropertyOf", "domain", "range"))
SAME, DIFFERENT, EQ_CLASS, EQ_PROPERTY, INVERSE = (iri(OWL + x) for x in ("sameAs", "differentFrom", "equivalentClass", "equivalentProperty", "inverseOf"))
SYMMETRIC, TRANSITIVE, FUNCTIONAL, INVERSE_FUNCTIONAL, ASYMMETRIC, IRREFLEXIVE = (
    iri(f"{OWL}{x}Property") for x in ("Symmetric", "Transitive", "Functional", "InverseFunctional", "Asymmetric", "Irreflexive")
)
DISJOINT, COMPLEMENT, PROPERTY_DISJOINT = (iri(OWL + x) for x in ("disjointWith", "complementOf", "propertyDisjointWith"))
INTERSECTION, UNION, ONE_OF, HAS_KEY, CHAIN = (iri(OWL + x) for x in ("intersectionOf", "unionOf", "oneOf", "hasKey", "propertyChainAxiom"))
ON_PROPERTY, SOME, ALL, HAS_VALUE, MAX_CARDINALITY, THING = (iri(OWL + x) for x in ("onProperty", "someValuesFrom", "allValuesFrom", "hasValue", "maxCardinality", "Thing"))
ALL_DIFFERENT, MEMBERS, DISTINCT_MEMBERS, RESOURCE, PROPERTY = iri(OWL + "AllDifferent"), iri(OWL + "members"), iri(OWL + "distinctMembers"), iri(RDFS + "Resource"), iri(RDF + "Property")

ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
INTEGERS = ("integer", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "int", "long", "short", "byte", "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte")
#: Lexical forms of the checked datatypes.
LEXICAL = {
    "integer": r"^[+-]?\d+$", "int": r"^[+-]?\d+$", "long": r"^[+-]?\d+$", "short": r"^[+-]?\d+$", "byte": r"^[+-]?\d+$",
    "nonNegativeInteger": r"^(\+?\d+|-0+)$", "positiveInteger": r"^\+?0*[1-9]\d*$", "nonPositiveInteger": r"^(-\d+|\+?0+)$", "negativeInteger": r"^-0*[1-9]\d*$",
    "unsignedInt": r"^\+?\d+$", "unsignedLong": r"^\+?\d+$", "unsignedShort": r"^\+?\d+$", "unsignedByte": r"^\+?\d+$",
    "decimal": r"^[+-]?(\d+(\.\d*)?|\.\d+)$", "boolean": r"^(true|false|0|1)$",
    "double": r"^([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?INF|NaN)$", "float": r"^([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?INF|NaN)$",
    "gYear": r"^-?\d{4,}(Z|[+-]\d\d:\d\d)?$", "date": r"^-?\d{4,}-\d\d-\d\d(Z|[+-]\d\d:\d\d)?$",
    "dateTime": r"^-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?$",
}

#: The least and the greatest value of the bounded integer types.
BOUNDS = {
    "byte": (-128, 127), "short": (-32768, 32767), "int": (-(2**31), 2**31 - 1), "long": (-(2**63), 2**63 - 1),
    "unsignedByte": (0, 255), "unsignedShort": (0, 65535), "unsignedInt": (0, 2**32 - 1), "unsignedLong": (0, 2**64 - 1),
}


def literal(text: str, datatype: str | None = None, lang: str | None = None) -> str:
    body = '"' + "".join(ESCAPES.get(c, c) for c in text) + '"'
    if lang:
        return f"{body}@{lang.lower()}"
    return body if datatype in (None, XSD + "string") else f"{body}^^<{datatype}>"


def is_iri(c: Column) -> Column:
    return c.startswith("<")


def is_blank(c: Column) -> Column:
    return c.startswith("_:")


def is_literal(c: Column) -> Column:
    return c.startswith('"')


def lexical(c: Column) -> Column:
    """What a literal says, escapes undone; an IRI without its brackets."""
    raw = F.regexp_extract(c, r'(?s)^"(.*)"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?$', 1)

    def undone(part: Column) -> Column:
        for plain, escaped in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            part = F.replace(part, F.lit(escaped), F.lit(plain))
        return part

    # Escaped backslashes part what other escapes can stand in, so one pass undoes all.
    raw = F.when(raw.contains("\\"), F.array_join(F.transform(F.split(raw, r"\\\\"), undone), "\\")).otherwise(raw)
    return F.when(is_literal(c), raw).when(is_iri(c), F.regexp_extract(c, "^<(.*)>$", 1)).otherwise(c)


def language(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r'"@([A-Za-z0-9-]+)$', 1))


def datatype(c: Column) -> Column:
    """IRI (in brackets) of a literal's datatype; null for other terms."""
    typed = F.regexp_extract(c, r'"\^\^(<[^>]*>)$', 1)
    return F.when(is_literal(c), F.when(typed != "", typed).when(language(c) != "", F.lit(iri(RDF + "langString"))).otherwise(F.lit(iri(XSD + "string"))))


def well_formed(c: Column) -> Column:
    """Whether a literal's text fits its datatype; unknown datatypes fit."""
    kind, text, out = datatype(c), lexical(c), F.lit(True)
    for name, pattern in LEXICAL.items():
        fits = text.rlike(pattern)
        if name in BOUNDS:
            fits = fits & F.coalesce(text.try_cast("decimal(38,0)").between(*(F.lit(str(x)).cast("decimal(38,0)") for x in BOUNDS[name])), F.lit(False))
        if name == "date":
            fits = fits & F.regexp_extract(text, r"^(-?\d{4,}-\d\d-\d\d)", 1).try_cast("date").isNotNull()
        out = F.when(kind == iri(XSD + name), fits).otherwise(out)
    return out


def number(c: Column) -> Column:
    """A numeric literal's value, null for others."""
    return F.when(datatype(c).isin(*[iri(XSD + n) for n in (*INTEGERS, "decimal", "double", "float")]), lexical(c).try_cast("double"))


def exact(c: Column) -> Column:
    """The value of an integer or decimal literal of at most 28 digits before the point and 10 after it, null for others."""
    text = lexical(c)
    fits = datatype(c).isin(*[iri(XSD + n) for n in (*INTEGERS, "decimal")]) & ~F.regexp_like(text, F.lit(r"\.\d{11,}"))
    return F.when(fits, text.try_cast("decimal(38,10)"))


def compared(a: Column, b: Column, how) -> Column:
    """how(a, b) of two numeric literals, exactly where both are exact; null if one is no number."""
    return F.coalesce(how(exact(a), exact(b)), how(number(a), number(b)))


def moment(c: Column) -> Column:
    return F.when(datatype(c).isin(iri(XSD + "date"), iri(XSD + "dateTime")), lexical(c).try_cast("timestamp"))
