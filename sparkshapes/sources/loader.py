"""Loading graphs and shapes, and writing graphs and reports.

N-Triples and N-Quads are read by Spark in parallel, any size. Turtle, TriG and RDF/XML have no line structure to split
at, so they are parsed whole, each file in one task; shapes are parsed on the driver.
"""

from __future__ import annotations

import re
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import iri, literal
from ..operators.closure import collected
from .turtle import Quad, TurtleError, parse_rdfxml, parse_turtle, unescape

QUADS = "s string, p string, o string, g string"
FORMATS = {"ttl": "turtle", "turtle": "turtle", "trig": "turtle", "nt": "ntriples", "ntriples": "ntriples", "nq": "ntriples", "nquads": "ntriples", "owl": "xml", "rdf": "xml", "xml": "xml", "rdfxml": "xml", "application/rdf+xml": "xml", "n3": "turtle"}
#: One statement, and lines that hold none.
NOTHING = r"^\s*(#.*)?$"
LINE = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*(<[^>]*>|_:\S+)?\s*\.\s*(?:#.*)?$'


def format_of(path: str, rdf_format: str | None = None) -> str:
    kind = (rdf_format or PurePosixPath(path).suffix.lstrip(".") or "turtle").lower()
    if kind not in FORMATS:
        raise ValueError(f"unknown RDF format {kind!r}")
    return FORMATS[kind]


def parse(text: str, kind: str, scope: str = "b") -> list[Quad]:
    if kind == "ntriples":
        return list(dict.fromkeys(statement(line, scope) for line in re.split(r"[\r\n]+", text) if not re.match(NOTHING, line)))
    return parse_rdfxml(text, scope=scope) if kind == "xml" else parse_turtle(text, scope=scope)


def statement(line: str, scope: str) -> Quad:
    """The quad of a line of N-Triples or N-Quads, terms in canonical form."""
    m = re.match(LINE, line)
    if not m:
        raise TurtleError(f"malformed line: {line[:200]!r}")

    def term(x: str) -> str:
        if x.startswith("_:"):
            return f"_:{scope}{x[2:]}"
        if x.startswith("<"):
            return iri(unescape(x[1:-1]))
        body, _, rest = x[1:].rpartition('"')
        return literal(unescape(body), rest[3:-1] if rest.startswith("^^") else None, rest[1:] if rest.startswith("@") else None)

    return term(m[1]), term(m[2]), term(m[3]), term(m[4]) if m[4] else ""


def load_quads(spark: SparkSession, source: str | bytes | DataFrame, rdf_format: str | None = None) -> DataFrame:
    """s, p, o, g of a path, of bytes or of a DataFrame of triples or quads; g is "" in the default graph.

    Blank nodes carry a name made from their file's path, so files can be united.
    """
    if isinstance(source, DataFrame):
        return source if "g" in source.columns else source.select("s", "p", "o", F.lit("").alias("g"))
    if isinstance(source, bytes):
        return spark.createDataFrame(parse(source.decode(), FORMATS[(rdf_format or "turtle").lower()]), QUADS)
    if not isinstance(source, str):
        raise ValueError(f"cannot load a graph from {type(source).__name__}")
    kind = format_of(source, rdf_format)
    if kind == "ntriples":
        # Lines are read in parallel; those with escapes are few and take the long way. Parts of one folder are one file.
        lines = spark.read.text(source).where(~F.col("value").rlike(NOTHING))
        scope = F.concat(F.lit("b"), F.substring(F.md5(F.regexp_replace(F.input_file_name(), "/part-[^/]*$", "").cast("binary")), 1, 16))
        lines = lines.withColumn("scope", scope)
        part = lambda i: F.regexp_extract("value", LINE, i)
        named = lambda c: F.when(c.startswith("_:"), F.concat(F.lit("_:"), "scope", F.substr(c, F.lit(3)))).otherwise(c)
        bad = F.raise_error(F.concat(F.lit("malformed line: "), F.substring("value", 1, 200)))
        plain = lines.where(~F.col("value").contains("\\")).withColumn("value", F.when(F.col("value").rlike(LINE), F.col("value")).otherwise(bad))
        plain = plain.select(named(part(1)).alias("s"), part(2).alias("p"), named(canonical(part(3))).alias("o"), named(part(4)).alias("g"))

        def escaped(batches):
            import pandas as pd

            for pdf in batches:
                yield pd.DataFrame([statement(v, s) for v, s in zip(pdf["value"], pdf["scope"], strict=True)], columns=["s", "p", "o", "g"])

        return plain.union(lines.where(F.col("value").contains("\\")).mapInPandas(escaped, QUADS))

    def run(batches):
        import hashlib

        import pandas as pd

        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                scope = "b" + hashlib.md5(re.sub("/part-[^/]*$", "", path).encode()).hexdigest()[:16]
                yield pd.DataFrame(parse(bytes(data).decode(), kind, scope), columns=["s", "p", "o", "g"])

    return spark.read.format("binaryFile").load(source).select("path", "content").mapInPandas(run, QUADS).distinct()


def canonical(o):
    """xsd:string literals without their datatype, language tags in lower case."""
    o = F.regexp_replace(o, r"\^\^<http://www\.w3\.org/2001/XMLSchema#string>$", "")
    tag = F.regexp_extract(o, r'"(@[A-Za-z0-9-]+)$', 1)
    return F.when(tag != "", F.concat(F.regexp_replace(o, r"@[A-Za-z0-9-]+$", ""), F.lower(tag))).otherwise(o)


def load_data_graph(spark: SparkSession, source: str | bytes | DataFrame, rdf_format: str | None = None) -> DataFrame:
    """The triples of a data graph: of a dataset's named graphs the first is taken, or else the default graph."""
    return first_graph(load_quads(spark, source, rdf_format))


def named_graphs(quads: DataFrame) -> DataFrame:
    """graph, n: the graphs of a dataset and their triples."""
    return quads.groupBy(F.col("g").alias("graph")).agg(F.countDistinct("s", "p", "o").alias("n"))


def first_graph(quads: DataFrame) -> DataFrame:
    """Triples of the default graph if it has any, else of the named graph that sorts first."""
    first = quads.agg(F.min("g").alias("g"))
    return quads.join(F.broadcast(first), "g").select("s", "p", "o").distinct()


def load_shapes(source: str | bytes | DataFrame, rdf_format: str | None = None, spark: SparkSession | None = None) -> list[tuple[str, str, str]]:
    """The triples of a shapes graph, on the driver: a path, bytes or a DataFrame."""
    if isinstance(source, DataFrame):
        return collected(source.select("s", "p", "o"))
    if isinstance(source, bytes):
        return [q[:3] for q in parse(source.decode(), FORMATS[(rdf_format or "turtle").lower()], "s")]
    if not isinstance(source, str):
        raise ValueError(f"cannot load shapes from {type(source).__name__}")
    spark = spark or SparkSession.active()
    text = spark.read.text(source, wholetext=True).first()[0]
    return [q[:3] for q in parse(text, format_of(source, rdf_format), "s")]


def load_with_ontology(spark: SparkSession, data: str | DataFrame, ontology: str | DataFrame | None, ontology_format: str | None = None) -> DataFrame:
    """Data and ontology as one graph."""
    graph = load_data_graph(spark, data)
    return graph if ontology is None else graph.union(load_data_graph(spark, ontology, ontology_format)).distinct()


def find_files(spark: SparkSession, folder: str, part: str = "", suffix: str = ".ttl") -> list[str]:
    """Files below a folder (of any file system Spark reaches) whose path contains part, whatever its case."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found, todo = [], [path]
    while todo:
        for status in files.listStatus(todo.pop()):
            if status.isDirectory():
                todo.append(status.getPath())
            elif (name := status.getPath().toString()).endswith(suffix) and part.lower() in name.lower():
                found.append(name)
    return sorted(found)


def dataset_name(uri: str, pattern: str = r"(?P<set>lubm)-(?P<kind>[^-.]+)-(?P<no>[^-.]+)", name: str = r"\g<set>/\g<kind>\g<no>") -> str:
    """A dataset's short name: files that pattern matches are named by the template, others by what precedes a bracket."""
    stem = PurePosixPath(uri).name
    if found := re.match(pattern, stem, re.I):
        return found.expand(name).lower()
    return re.sub(r"(\(.*|\.ttl)$", "", stem)


def ontology_for(dataset: str, ontologies: dict[str, str]) -> str | None:
    """The ontology to add to a dataset, by the first key its name contains; most have none."""
    return next((path for key, path in ontologies.items() if key.lower() in dataset.lower()), None)


def write_ntriples(graph: DataFrame, path: str, mode: str = "errorifexists") -> None:
    graph.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value")).write.mode(mode).text(path)


def to_turtle(triples: list[tuple[str, str, str]], prefixes: dict[str, str] | None = None) -> str:
    """Turtle of a small graph, subjects together."""
    prefixes = prefixes or {}

    def short(term: str) -> str:
        base = term
        if (at := term.rfind("^^<")) > 0:
            return base[: at + 2] + short(base[at + 2 :])
        for name, ns in prefixes.items():
            if term.startswith(f"<{ns}") and re.fullmatch(r"[A-Za-z_][\w-]*", term[len(ns) + 1 : -1]):
                return f"{name}:{term[len(ns) + 1 : -1]}"
        return term

    lines = [f"@prefix {k}: {iri(v)} ." for k, v in prefixes.items()]
    by_subject: dict[str, list[str]] = {}
    for s, p, o in sorted(set(triples)):
        by_subject.setdefault(s, []).append(f"{short(p)} {short(o)}")
    lines += [f"{short(s)} " + " ;\n    ".join(rest) + " ." for s, rest in by_subject.items()]
    return "\n".join(lines) + "\n"


def write_turtle(graph: DataFrame, path: str, prefixes: dict[str, str] | None = None, mode: str = "errorifexists") -> None:
    """Turtle of a graph of any size: one file a partition, a subject's triples together in one of them.

    A path that ends in .ttl is one file, written in one task.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"value": [to_turtle(list(pdf[["s", "p", "o"]].itertuples(index=False, name=None)), prefixes)]})

    rows = graph.select("s", "p", "o").distinct()
    rows = rows.coalesce(1) if path.endswith(".ttl") else rows.repartition("s")
    texts = rows.sortWithinPartitions("s", "p", "o").mapInPandas(run, "value string")
    if not path.endswith(".ttl"):
        texts.write.mode(mode).text(path)
        return
    write_text(graph.sparkSession, "".join(r["value"] for r in texts.toLocalIterator()), path)


def append_text(spark: SparkSession, text: str, path: str) -> None:
    """Adds to the text at a path, which may not exist yet; the whole is written anew, as most stores cannot append."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target)
    write_text(spark, (spark.read.text(path, wholetext=True).first()[0] if there else "") + text, path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """Puts a text where any file system path points, making folders on the way."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()
