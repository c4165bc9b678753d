"""The relational test tables as a graph, by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import terms as t

U = "urn:x:"


def u(name: str) -> str:
    return f"<{U}{name}>"


def node(kind: str, key: str) -> str:
    return f"concat('<{U}{kind}/', cast({key} as string), '>')"


def kind(name: str) -> str:
    return f"'{u(name)}'"


def typed(expr: str, name: str) -> str:
    return f"concat('\"', cast({expr} as string), '\"^^<{t.XSD}{name}>')"


def plain(expr: str) -> str:
    return f"concat('\"', {expr}, '\"')"


#: table -> (s, p, o) of each kind of triple.
LIFTS: dict[str, list[tuple[str, str, str]]] = {
    "region": [(node("region", "r_regionkey"), t.TYPE, kind("Region"))],
    "nation": [(node("nation", "n_nationkey"), t.TYPE, kind("Nation")), (node("nation", "n_nationkey"), u("partOf"), node("region", "n_regionkey"))],
    "customer": [
        (node("customer", "c_custkey"), t.TYPE, f"concat('<{U}', replace(c_mktsegment, ' ', '_'), 'Customer>')"),
        (node("customer", "c_custkey"), u("inNation"), node("nation", "c_nationkey")),
        (node("customer", "c_custkey"), u("acctCents"), typed("cast(round(c_acctbal * 100) as bigint)", "integer")),
    ],
    "supplier": [(node("supplier", "s_suppkey"), t.TYPE, kind("Supplier")), (node("supplier", "s_suppkey"), u("inNation"), node("nation", "s_nationkey"))],
    "part": [
        (node("part", "p_partkey"), t.TYPE, f"concat('<{U}', replace(p_type, ' ', '_'), 'Part>')"),
        (node("part", "p_partkey"), u("brand"), plain("p_brand")), (node("part", "p_partkey"), u("size"), typed("p_size", "integer")),
    ],
    "orders": [
        (node("order", "o_orderkey"), t.TYPE, kind("Order")), (node("order", "o_orderkey"), u("placedBy"), node("customer", "o_custkey")),
        (node("order", "o_orderkey"), u("status"), plain("o_orderstatus")), (node("order", "o_orderkey"), u("orderDate"), typed("cast(o_orderdate as date)", "date")),
    ],
    "lineitem": [(node("order", "l_orderkey"), u("contains"), node("part", "l_partkey")), (node("order", "l_orderkey"), u("suppliedBy"), node("supplier", "l_suppkey"))],
    "documents": [
        (node("doc", "doc_id"), t.TYPE, kind("Doc")), (node("doc", "doc_id"), u("inLang"), plain("lang")), (node("doc", "doc_id"), u("contentHash"), plain("md5(text)")),
    ],
    "conversations": [
        (f"concat('<{U}turn/', cast(conv_id as string), '/', cast(turn as string), '>')", u("next"), f"concat('<{U}turn/', cast(conv_id as string), '/', cast(turn + 1 as string), '>')"),
        (f"concat('<{U}turn/', cast(conv_id as string), '/', cast(turn as string), '>')", u("role"), plain("role")),
    ],
    "events": [(node("user", "user_id"), u("did"), "concat('<urn:x:', event_type, 'Event>')")],
}
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD")
#: The ontology of the lifted graph.
TBOX: list[tuple[str, str, str]] = [
    *[(u(f"{s}Customer"), t.SUBCLASS, u("Customer")) for s in SEGMENTS],
    (u("Customer"), t.SUBCLASS, u("Party")), (u("Supplier"), t.SUBCLASS, u("Party")), (u("Party"), t.SUBCLASS, u("Agent")),
    (u("Customer"), t.EQ_CLASS, u("Client")), (u("Client"), t.EQ_CLASS, u("Buyer")), (u("Buyer"), t.EQ_CLASS, u("Customer")),
    (u("inNation"), t.SUBPROPERTY, u("locatedIn")), (u("partOf"), t.SUBPROPERTY, u("locatedIn")), (u("locatedIn"), t.TYPE, t.TRANSITIVE),
    (u("placedBy"), t.DOMAIN, u("Order")), (u("placedBy"), t.RANGE, u("Customer")),
    (u("placedBy"), t.SUBPROPERTY, u("involves")), (u("suppliedBy"), t.SUBPROPERTY, u("involves")),
    (u("contains"), t.INVERSE, u("containedIn")), (u("next"), t.TYPE, t.TRANSITIVE), (u("contentHash"), t.TYPE, t.INVERSE_FUNCTIONAL),
    (u("orderedBy"), t.EQ_PROPERTY, u("placedBy")),
]


def lift(spark: SparkSession, sf_dir: str, *tables: str, only: tuple[str, ...] = (), tbox: list[tuple[str, str, str]] = (), distinct: bool = True) -> DataFrame:
    """The triples of some tables (of some predicates only), with ontology triples; distinct, as graphs are sets."""
    out = None
    for name in tables:
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        for s, p, o in LIFTS[name]:
            if not only or p in only:
                part = rows.selectExpr(f"{s} AS s", f"'{p}' AS p", f"{o} AS o").where("s IS NOT NULL AND o IS NOT NULL")
                out = part if out is None else out.union(part)
    if tbox:
        more = spark.createDataFrame(list(tbox), "s string, p string, o string")
        out = more if out is None else out.union(more)
    return out.distinct() if distinct else out


def lift_sql(*tables: str, only: tuple[str, ...] = (), tbox: list[tuple[str, str, str]] = ()) -> str:
    """The same in SQL."""
    parts = [f"SELECT DISTINCT {s} AS s, '{p}' AS p, {o} AS o FROM {name} WHERE {s} IS NOT NULL AND {o} IS NOT NULL" for name in tables for s, p, o in LIFTS[name] if not only or p in only]
    if tbox:
        parts.append("SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{p}', '{o}')" for s, p, o in tbox) + ") AS v(s, p, o)")
    return "\nUNION ".join(parts)
