"""Turtle, TriG and RDF/XML into triples of canonical terms, on the driver: shapes, ontologies and small graphs."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from urllib.parse import urljoin

from ..functions.terms import FIRST, NIL, RDF, REST, TYPE, XSD, iri, literal

Quad = tuple[str, str, str, str]
NAME = r"[A-Za-z_0-9\u00C0-\uFFFF](?:[\w\u00B7.%:\-]|\\.)*"
TOKEN = re.compile(
    rf'''\s+|\#[^\n]*
    |(?P<iri><[^<>"{{}}|^`\\\x00-\x20]*(?:\\[uU][0-9A-Fa-f]+[^<>"\x00-\x20]*)*>)
    |(?P<long>"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^'\\]|\\.|'(?!''))*\'\'\')
    |(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<mark>\^\^|[\[\](){{}};,])
    |(?P<blank>_:[\w\u00C0-\uFFFF](?:[\w.\-\u00B7\u00C0-\uFFFF]*[\w\-\u00B7\u00C0-\uFFFF])?)
    |(?P<double>[+-]?(?:\d+\.\d*|\.?\d+)[eE][+-]?\d+)|(?P<decimal>[+-]?\d*\.\d+)|(?P<integer>[+-]?\d+)(?![\w:])
    |(?P<name>(?:[A-Za-z\u00C0-\uFFFF][\w.\-\u00C0-\uFFFF]*)?:(?:{NAME})?|[A-Za-z]+)
    |(?P<dot>\.)''',
    re.X | re.S,
)
PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        c = m[1]
        return chr(int(c[1:], 16)) if c[0] in "uU" else PLAIN.get(c, c)

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, text, flags=re.S)


class TurtleError(ValueError):
    """Text that is not Turtle."""


class Turtle:
    """One document. quads: (s, p, o, graph), graph "" for the default graph."""

    def __init__(self, text: str, base: str = "", scope: str = "b"):
        self.base, self.scope, self.prefixes, self.quads = base, scope, {}, []
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m or m.end() == at:
                raise TurtleError(f"unexpected {text[at : at + 30]!r}")
            at = m.end()
            if kind := m.lastgroup:
                value = m[kind]
                # A name may not end in a dot: that is the statement's end.
                dots = len(value) - len(value.rstrip(".")) if kind == "name" else 0
                self.tokens.append((kind, value[: len(value) - dots]))
                self.tokens += [("dot", ".")] * dots
        self.at, self.blanks, self.graph = 0, 0, ""
        while self.at < len(self.tokens):
            self.statement()

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *values: str) -> tuple[str, str]:
        found = self.peek()
        if values and found[1] not in values:
            raise TurtleError(f"expected {values}, found {found[1]!r}")
        self.at += 1
        return found

    def fresh(self) -> str:
        self.blanks += 1
        return f"_:{self.scope}g{self.blanks}"

    def emit(self, s: str, p: str, o: str) -> None:
        self.quads.append((s, p, o, self.graph))

    def resolve(self, token: str) -> str:
        text = unescape(token[1:-1])
        return iri(urljoin(self.base, text) if self.base and not re.match(r"[A-Za-z][\w+.\-]*:", text) else text)

    def statement(self) -> None:
        kind, value = self.peek()
        word = value.lower()
        if (kind == "lang" and word in ("@prefix", "@base")) or (kind == "name" and word in ("prefix", "base")):
            self.take()
            if word.endswith("prefix"):
                name = self.take()[1]
                self.prefixes[name[:-1]] = self.resolve(self.take()[1])[1:-1]
            else:
                self.base = self.resolve(self.take()[1])[1:-1]
            if kind == "lang":
                self.take(".")
        elif value == "{" or (kind == "name" and word == "graph") or (kind in ("iri", "name", "blank") and self.tokens[self.at + 1 : self.at + 2] == [("mark", "{")]):
            if word == "graph":
                self.take()
            self.graph = "" if value == "{" else self.term()
            self.take("{")
            while self.peek()[1] != "}":
                self.triples()
                if self.peek()[1] == ".":
                    self.take()
            self.take("}")
            self.graph = ""
        else:
            self.triples()
            self.take(".")

    def triples(self) -> None:
        lone = self.peek()[1] == "["
        s = self.term()
        if not (lone and self.peek()[1] in (".", "}")):
            self.properties(s)

    def properties(self, s: str) -> None:
        while True:
            while self.peek()[1] == ";":
                self.take()
            if self.peek()[1] in (".", "]", "}"):
                return
            p = TYPE if self.peek() == ("name", "a") else None
            if p:
                self.take()
            else:
                p = self.term()
            self.emit(s, p, self.term())
            while self.peek()[1] == ",":
                self.take()
                self.emit(s, p, self.term())
            if self.peek()[1] != ";":
                return

    def term(self) -> str:
        kind, value = self.take()
        if kind == "iri":
            return self.resolve(value)
        if kind == "blank":
            return f"_:{self.scope}{value[2:]}"
        if kind in ("text", "long"):
            n = 3 if kind == "long" else 1
            text = unescape(value[n:-n])
            if self.peek()[0] == "lang":
                return literal(text, lang=self.take()[1][1:])
            if self.peek()[1] == "^^":
                self.take()
                return literal(text, self.term()[1:-1])
            return literal(text)
        if kind in ("integer", "decimal", "double"):
            return literal(value, XSD + kind)
        if kind == "name" and value in ("true", "false"):
            return literal(value, XSD + "boolean")
        if kind == "name" and ":" in value:
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise TurtleError(f"unknown prefix {prefix!r}")
            return iri(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))
        if value == "[":
            s = self.fresh()
            self.properties(s)
            self.take("]")
            return s
        if value == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.term())
            self.take(")")
            nodes = [self.fresh() for _ in items]
            for i, item in enumerate(items):
                self.emit(nodes[i], FIRST, item)
                self.emit(nodes[i], REST, nodes[i + 1] if i + 1 < len(items) else NIL)
            return nodes[0] if nodes else NIL
        raise TurtleError(f"unexpected {value!r}")


def parse_turtle(text: str, base: str = "", scope: str = "b") -> list[Quad]:
    """Distinct quads in order; blank nodes carry scope, so sources can be united."""
    return list(dict.fromkeys(Turtle(text, base, scope).quads))


def parse_rdfxml(text: str, base: str = "", scope: str = "x") -> list[Quad]:
    """RDF/XML node and property elements, typed nodes, rdf:parseType Resource and Collection, xml:lang and xml:base."""
    out: list[Quad] = []
    count = 0
    xml = "{http://www.w3.org/XML/1998/namespace}"

    def name(tag: str) -> str:
        return tag[1:].replace("}", "") if tag[0] == "{" else tag

    def fresh() -> str:
        nonlocal count
        count += 1
        return f"_:{scope}g{count}"

    def resolve(text: str, base: str) -> str:
        return iri(urljoin(base, text) if base and not re.match(r"[A-Za-z][\w+.\-]*:", text) else text)

    def node(e: ET.Element, base: str, lang: str) -> str:
        base, lang = e.get(xml + "base", base), e.get(xml + "lang", lang)
        about, ident, blank = (e.get(f"{{{RDF}}}{k}") for k in ("about", "ID", "nodeID"))
        s = resolve(about, base) if about is not None else resolve("#" + ident, base) if ident else f"_:{scope}{blank}" if blank else fresh()
        if name(e.tag) != RDF + "Description":
            out.append((s, TYPE, iri(name(e.tag)), ""))
        for k, v in e.attrib.items():
            if not k.startswith((f"{{{RDF}}}", xml)) and k[0] == "{":
                out.append((s, iri(name(k)), literal(v, lang=lang or None), ""))
            elif k == f"{{{RDF}}}type":
                out.append((s, TYPE, resolve(v, base), ""))
        at = 0
        for child in e:
            p = name(child.tag)
            if p == RDF + "li":
                at += 1
                p = f"{RDF}_{at}"
            prop(s, iri(p), child, base, lang)
        return s

    def prop(s: str, p: str, e: ET.Element, base: str, lang: str) -> None:
        base, lang = e.get(xml + "base", base), e.get(xml + "lang", lang)
        get = lambda k: e.get(f"{{{RDF}}}{k}")
        if (to := get("resource")) is not None:
            out.append((s, p, resolve(to, base), ""))
        elif (to := get("nodeID")) is not None:
            out.append((s, p, f"_:{scope}{to}", ""))
        elif get("parseType") == "Resource":
            inner = fresh()
            out.append((s, p, inner, ""))
            for child in e:
                prop(inner, iri(name(child.tag)), child, base, lang)
        elif get("parseType") == "Collection":
            items = [node(c, base, lang) for c in e]
            cells = [fresh() for _ in items]
            out.append((s, p, cells[0] if cells else NIL, ""))
            for i, item in enumerate(items):
                out.append((cells[i], FIRST, item, ""))
                out.append((cells[i], REST, cells[i + 1] if i + 1 < len(items) else NIL, ""))
        elif len(e):
            out.append((s, p, node(e[0], base, lang), ""))
        else:
            out.append((s, p, literal(e.text or "", get("datatype"), None if get("datatype") else lang or None), ""))

    root = ET.fromstring(text)
    base, lang = root.get(xml + "base", base), root.get(xml + "lang", "")
    for e in root if name(root.tag) == RDF + "RDF" else [root]:
        node(e, base, lang)
    return list(dict.fromkeys(out))
