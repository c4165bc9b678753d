"""The queries of the driver contract, each an operator at work on the lifted graph, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as t
from ..operators import graph as g
from ..operators import pending
from ..operators import rules as r
from ..operators.closure import closed, transitive
from ..operators.components import connected_components
from ..sources import loader
from .engine import Schema, extract, full_closure, fuse, infer
from .lift import LIFTS, TBOX, U, lift, lift_sql, plain, typed, u
from .report import report_counts, report_graph
from .shapes import Shapes, sh
from .tables import shared_dir
from .validator import Validator, validate

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def over(lifted: str, body: str) -> str:
    """body over the lifted graph as t."""
    return f"WITH RECURSIVE t AS ({lifted}) {body}" if "WITH" not in body[:5] else f"WITH RECURSIVE t AS ({lifted}), {body[5:]}"


def values(rows) -> str:
    """Rows of strings as a VALUES list."""
    return "VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in rows)


def schema_rows(p: str) -> list[tuple[str, str]]:
    return [(s, o) for s, q, o in TBOX if q == p]


def shapes(*triples: tuple[str, str, str]) -> Shapes:
    return Shapes([(s, p, o) for s, p, o in triples])


def int_(n: int) -> str:
    return t.literal(str(n), t.XSD + "integer")


def property_shape(shape: str, target: str, prop: str, *rest: tuple[str, str], name: str = "p1") -> list[tuple[str, str, str]]:
    ps = f"_:{name}"
    return [(u(shape), sh("targetClass"), target), (u(shape), sh("property"), ps), (ps, sh("path"), prop), *[(ps, p, o) for p, o in rest]]


ORDERS = ("orders", "lineitem")
CLOSE = """WITH e AS ({edges}), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) """

# Scans, patterns and sets.


@query(over(lift_sql(*LIFTS), "SELECT p, count(*) AS n FROM t GROUP BY p"))
def q01_triple_count_by_predicate(spark, d):
    return lift(spark, d, *LIFTS).groupBy("p").agg(F.count("*").alias("n"))


@query(over(lift_sql("orders"), f"SELECT s, o FROM t WHERE p = '{u('placedBy')}'"))
def q02_pattern_subject_objects(spark, d):
    return g.subject_objects(lift(spark, d, "orders", only=(u("placedBy"),)), u("placedBy"))


STAR_SQL = "\nUNION ".join(
    f"SELECT DISTINCT {x} AS s, '{p}' AS p, {o} AS o FROM {name} WHERE {key} IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')" for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")) for x, p, o in LIFTS[name]
)


@query(STAR_SQL)
def q03_pattern_star(spark, d):
    graph = lift(spark, d, "orders", "lineitem")
    return g.star(graph, g.subjects(graph, u("status"), '"F"'))


@query(over(lift_sql("orders"), f"SELECT '<{U}order/' || cast(o_orderkey + 1 as string) || '>' AS s, '{t.TYPE}' AS p, '{u('Order')}' AS o, o_orderkey + 1 IN (SELECT o_orderkey FROM orders) AS present FROM orders"))
def q04_pattern_in(spark, d):
    wanted = spark.read.parquet(f"{d}/orders.parquet").selectExpr(f"concat('<{U}order/', cast(o_orderkey + 1 as string), '>') AS s", f"'{t.TYPE}' AS p", f"'{u('Order')}' AS o")
    return g.contains(lift(spark, d, "orders", only=(t.TYPE,)), wanted)


@query(over(lift_sql("customer", "supplier", "customer"), "SELECT s, p, o FROM t"))
def q05_graph_union(spark, d):
    return g.union(lift(spark, d, "customer", "supplier"), lift(spark, d, "customer"))


@query(over(lift_sql("customer"), f"SELECT s, p, o FROM t EXCEPT SELECT s, p, o FROM t WHERE p = '{u('inNation')}'"))
def q06_graph_minus(spark, d):
    return g.minus(lift(spark, d, "customer"), lift(spark, d, "customer", only=(u("inNation"),)))


@query(over(lift_sql("orders"), f"SELECT s, p, o FROM t WHERE NOT (p = '{u('status')}' AND o = '\"O\"')"))
def q07_remove_triples(spark, d):
    graph = lift(spark, d, "orders")
    return graph.join(g.triples(graph, p=u("status"), o='"O"'), ["s", "p", "o"], "left_anti")


@query(over(lift_sql("customer"), "SELECT s, p, o FROM t"))
def q08_merge_named_graph_pick(spark, d):
    from ..sources.loader import first_graph

    quads = lift(spark, d, "customer").withColumn("g", F.lit(u("g1"))).union(lift(spark, d, "supplier").withColumn("g", F.lit(u("g2"))))
    return first_graph(quads)


@query(over(lift_sql("part"), f"SELECT o AS v FROM t WHERE p = '{u('brand')}'"))
def q09_bgp_select(spark, d):
    return g.triples(lift(spark, d, "part"), p=u("brand")).select(F.col("o").alias("v"))


# Closures and rules.


def pair_frame(spark, pairs, a="a", b="b"):
    return spark.createDataFrame(sorted(pairs), f"{a} string, {b} string")


def axioms(spark, d, name: str, *rows: tuple[str, str, str]) -> DataFrame:
    """Ontology triples from a table: SQL for s, p and o of each."""
    source, out = spark.read.parquet(f"{d}/{name}.parquet"), None
    for x, p, o in rows:
        part = source.selectExpr(f"{x} AS s", f"{p} AS p", f"{o} AS o").where("s IS NOT NULL AND o IS NOT NULL")
        out = part if out is None else out.union(part)
    return out.distinct()


PART_CLASSES = [(f"concat('<{U}', p_brand, '/', p_type, 'Part>')", f"'{t.SUBCLASS}'", f"concat('<{U}', p_type, 'Part>')"), (f"concat('<{U}', p_type, 'Part>')", f"'{t.SUBCLASS}'", f"'{u('Part')}'")]


@query("WITH RECURSIVE e AS (" + " UNION ".join(f"SELECT DISTINCT {x} AS a, {o} AS b FROM part" for x, _, o in PART_CLASSES) + "), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT DISTINCT a, b FROM c WHERE a <> b")
def q10_subclass_closure(spark, d):
    return pair_frame(spark, Schema(axioms(spark, d, "part", *PART_CLASSES), False).below)


@query("WITH RECURSIVE " + CLOSE.format(edges=f"SELECT * FROM ({values(schema_rows(t.SUBPROPERTY))}) v(a, b)")[5:] + "SELECT DISTINCT a, b FROM c WHERE a <> b")
def q11_subproperty_closure(spark, d):
    edges = pair_frame(spark, schema_rows(t.SUBPROPERTY), "s", "o")
    return transitive(edges).where("s <> o").select(F.col("s").alias("a"), F.col("o").alias("b"))


EQUAL = f"SELECT * FROM ({values(schema_rows(t.EQ_CLASS) + schema_rows(t.EQ_PROPERTY))}) v(a, b)"


@query(f"WITH RECURSIVE e0 AS ({EQUAL}), e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a AS node, min(b) AS component FROM c GROUP BY a")
def q12_equivalence_components(spark, d):
    return connected_components(pair_frame(spark, schema_rows(t.EQ_CLASS) + schema_rows(t.EQ_PROPERTY)))


@query(over(lift_sql("nation"), f"SELECT s, p, o FROM t WHERE p = '{u('partOf')}' UNION SELECT o, p, s FROM t WHERE p = '{u('partOf')}'"))
def q13_symmetric(spark, d):
    graph = lift(spark, d, "nation", only=(u("partOf"),))
    return g.union(graph, r.symmetric(graph, [u("partOf")]))


@query(over(lift_sql("conversations", only=(u("next"),)), "WITH c AS (SELECT s, o FROM t UNION SELECT c.s, t.o FROM c JOIN t ON c.o = t.s) SELECT s, o FROM c"))
def q14_transitive_next(spark, d):
    return r.transitive_property(lift(spark, d, "conversations", only=(u("next"),)), [u("next")]).select("s", "o")


@query(f"""SELECT DISTINCT '<{U}customer/' || cast(c_custkey as string) || '>' AS s, o FROM customer JOIN nation ON c_nationkey = n_nationkey,
LATERAL (SELECT unnest(['<{U}nation/' || cast(n_nationkey as string) || '>', '<{U}region/' || cast(n_regionkey as string) || '>']) AS o)
UNION SELECT '<{U}nation/' || cast(n_nationkey as string) || '>', '<{U}region/' || cast(n_regionkey as string) || '>' FROM nation""")
def q15_located_in_transitive(spark, d):
    graph = lift(spark, d, "customer", "nation", only=(u("inNation"), u("partOf")), tbox=TBOX)
    schema = Schema(graph, True)
    located = r.moved(graph, {m for m in schema.moves(None) if m[1] == u("locatedIn")})
    return r.transitive_property(located, [u("locatedIn")]).select("s", "o")


@query(over(lift_sql("lineitem", only=(u("contains"),)), f"SELECT o AS s, '{u('containedIn')}' AS p, s AS o FROM t"))
def q16_inverse(spark, d):
    return r.moved(lift(spark, d, "lineitem", only=(u("contains"),)), {(u("contains"), u("containedIn"), True)})


@query(over(lift_sql("orders", only=(u("placedBy"),)), f"SELECT DISTINCT s, '{t.TYPE}' AS p, '{u('Order')}' AS o FROM t"))
def q17_domain(spark, d):
    return r.domain_types(lift(spark, d, "orders", only=(u("placedBy"),)), schema_rows(t.DOMAIN))


@query(over(lift_sql("orders", only=(u("placedBy"),)), f"SELECT DISTINCT o AS s, '{t.TYPE}' AS p, '{u('Customer')}' AS o FROM t"))
def q18_range(spark, d):
    return r.range_types(lift(spark, d, "orders", only=(u("placedBy"),)), schema_rows(t.RANGE))


@query(over(lift_sql("orders", only=(u("placedBy"),)), f"SELECT DISTINCT s, '{t.TYPE}' AS p, '{u('Deal')}' AS o FROM t UNION SELECT o, '{t.TYPE}', '{u('Side')}' FROM t"))
def q19_target_domain_range(spark, d):
    """Axioms of a super-property reach the assertions below it."""
    axioms = [*TBOX, (u("involves"), t.DOMAIN, u("Deal")), (u("involves"), t.RANGE, u("Side"))]
    graph = lift(spark, d, "orders", only=(u("placedBy"),), tbox=axioms)
    schema = Schema(graph, True)
    scope = {u("Deal"), u("Side")}
    keep = lambda kind: {(p, c) for p, c in schema.axioms(kind, set(), scope) if c in scope}
    return r.domain_types(graph, keep(t.DOMAIN)).union(r.range_types(graph, keep(t.RANGE)))


SAME_OBJECTS = f"SELECT DISTINCT m AS s, '{t.SAME}' AS p, o FROM (SELECT o, min(o) OVER (PARTITION BY s) AS m FROM t) x WHERE o <> m"


@query(over(lift_sql("lineitem", only=(u("suppliedBy"),)), SAME_OBJECTS))
def q20_functional_sameas(spark, d):
    return r.functional_same(lift(spark, d, "lineitem", only=(u("suppliedBy"),)), [u("suppliedBy")])


@query(over(lift_sql("documents", only=(u("contentHash"),)), f"SELECT DISTINCT m AS s, '{t.SAME}' AS p, s AS o FROM (SELECT s, min(s) OVER (PARTITION BY o) AS m FROM t) x WHERE s <> m"))
def q21_inverse_functional_sameas(spark, d):
    return r.inverse_functional_same(lift(spark, d, "documents", only=(u("contentHash"),)), [u("contentHash")])


@query(over(lift_sql("orders", "lineitem", only=(u("placedBy"), u("suppliedBy"))), f"SELECT DISTINCT s, '{u('involves')}' AS p, o FROM t"))
def q22_subproperty_assertions(spark, d):
    graph = lift(spark, d, "orders", "lineitem", only=(u("placedBy"), u("suppliedBy")))
    return r.moved(graph, {(p, u("involves"), False) for p in (u("placedBy"), u("suppliedBy"))}).distinct()


#: Sub-properties from the orders' priorities and states, and a ring of the nations of each region.
RANKS = [(f"concat('<{U}', replace(o_orderpriority, ' ', '_'), '/', o_orderstatus, '>')", f"'{t.SUBPROPERTY}'", f"concat('<{U}state/', o_orderstatus, '>')"), (f"concat('<{U}state/', o_orderstatus, '>')", f"'{t.SUBPROPERTY}'", f"'{u('state')}'")]
RANKS_SQL = "WITH RECURSIVE e AS (" + " UNION ".join(f"SELECT DISTINCT {x} AS a, {o} AS b FROM orders" for x, _, o in RANKS) + "), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) "
RING = [(f"concat('<{U}nation/', cast(n_nationkey as string), '>')", f"'{t.SUBPROPERTY}'", f"concat('<{U}nation/', cast((n_nationkey + 5) % 25 as string), '>')")]


@query(RANKS_SQL + "SELECT a, b FROM c WHERE a <> b")
def q23_scm_spo(spark, d):
    return pair_frame(spark, Schema(axioms(spark, d, "orders", *RANKS), False).sub)


@query(f"SELECT '<{U}nation/' || cast(x.n_nationkey as string) || '>' AS a, '<{U}nation/' || cast(y.n_nationkey as string) || '>' AS b FROM nation x JOIN nation y ON x.n_nationkey % 5 = y.n_nationkey % 5 AND x.n_nationkey <> y.n_nationkey")
def q24_scm_eqp2(spark, d):
    return pair_frame(spark, Schema(axioms(spark, d, "nation", *RING), True).equal_properties())


@query(RANKS_SQL + f"SELECT DISTINCT a AS p, '{u('Stated')}' AS cls FROM c WHERE b = '{u('state')}' UNION SELECT '{u('state')}', '{u('Stated')}'")
def q25_scm_dom2_rng2(spark, d):
    graph = axioms(spark, d, "orders", *RANKS, (f"'{u('state')}'", f"'{t.DOMAIN}'", f"'{u('Stated')}'"))
    return spark.createDataFrame(sorted(Schema(graph, True).axioms(t.DOMAIN, None, None)), "p string, cls string")


@query(over(lift_sql("orders", only=(u("placedBy"),)), f"SELECT s, '{u('orderedBy')}' AS p, o FROM t"))
def q26_equivalent_property_merge(spark, d):
    """The path of a shape takes the place of the properties equal to it."""
    graph = lift(spark, d, "orders", tbox=[(u("orderedBy"), t.EQ_PROPERTY, u("placedBy"))])
    fused = fuse(graph, shapes(*property_shape("OrderShape", u("Order"), u("orderedBy"), (sh("minCount"), int_(1)))))
    return fused.graph.where(F.col("p").isin(u("orderedBy"), u("placedBy")))


@query(over(lift_sql("supplier", only=(t.TYPE,)), f"SELECT s, p, x.c AS o FROM t, (VALUES ('{u('Vendor')}'), ('{u('Seller')}')) x(c)"))
def q27_equivalent_class_types(spark, d):
    graph = lift(spark, d, "supplier", only=(t.TYPE,), tbox=[(u("Supplier"), t.EQ_CLASS, u("Vendor")), (u("Seller"), t.EQ_CLASS, u("Vendor"))])
    equal = Schema(graph, True).class_groups({u("Supplier")})
    return r.class_types(graph, {(a, b) for x in equal for a in x for b in x if a != b}).where(F.col("s").contains("/"))


@query(over(lift_sql("customer", "supplier", only=(t.TYPE,)), f"WITH e AS (SELECT * FROM ({values(schema_rows(t.SUBCLASS))}) v(a, b)), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT DISTINCT s, p, b AS o FROM t JOIN c ON a = o"))
def q28_superclass_types(spark, d):
    return r.class_types(lift(spark, d, "customer", "supplier", only=(t.TYPE,)), closed(schema_rows(t.SUBCLASS))).distinct()


REP = "(SELECT s AS member, min(s) OVER (PARTITION BY o) AS rep FROM t WHERE p = '%s')" % u("contentHash")


@query(over(lift_sql("documents"), f"SELECT DISTINCT m.rep AS s, t.p, t.o FROM t JOIN {REP} m ON t.s = m.member"))
def q29_sameas_merge_graph(spark, d):
    graph = lift(spark, d, "documents")
    same = r.inverse_functional_same(graph, [u("contentHash")])
    parts = connected_components(same, "s", "o")
    return r.replaced(graph, parts.select(F.col("node").alias("member"), F.col("component").alias("rep")))


@query(over(lift_sql("documents"), f"SELECT DISTINCT rep, member FROM {REP} m WHERE rep <> member"))
def q30_sameas_dictionary(spark, d):
    same = r.inverse_functional_same(lift(spark, d, "documents", only=(u("contentHash"),)), [u("contentHash")])
    return connected_components(same, "s", "o").where("node <> component").select(F.col("component").alias("rep"), F.col("node").alias("member"))


@query(over(lift_sql("documents"), f"SELECT DISTINCT b.member AS s, t.p, t.o FROM t JOIN {REP} a ON t.s = a.member JOIN {REP} b ON a.rep = b.rep WHERE a.member <> b.member"))
def q31_sameas_materialize(spark, d):
    graph = lift(spark, d, "documents")
    parts = connected_components(r.inverse_functional_same(graph, [u("contentHash")]), "s", "o")
    pairs = parts.select("component", F.col("node").alias("a")).join(parts.select("component", F.col("node").alias("b")), "component").where("a <> b").select("a", "b")
    return r.copied(graph, pairs)


# Consistency checks on the graph with axioms that it breaks.

BROKEN = [
    (u("next"), t.TYPE, t.ASYMMETRIC), (u("partOf"), t.TYPE, t.IRREFLEXIVE), (u("region/1"), u("partOf"), u("region/1")),
    (u("order/1"), u("next"), u("order/2")), (u("order/2"), u("next"), u("order/1")),
    (u("inNation"), t.PROPERTY_DISJOINT, u("livesIn")), (u("customer/1"), u("livesIn"), u("nation/1")), (u("customer/1"), u("inNation"), u("nation/1")),
    (u("Supplier"), t.DISJOINT, u("Vendor")), (u("supplier/1"), t.TYPE, u("Vendor")), (u("Supplier"), t.COMPLEMENT, u("Other")), (u("supplier/2"), t.TYPE, u("Other")), (u("supplier/2"), t.TYPE, u("Supplier")), (u("supplier/1"), t.TYPE, u("Supplier")),
    (u("order/5"), t.SAME, u("order/6")), (u("order/6"), t.DIFFERENT, u("order/5")),
]
BROKEN_SQL = lift_sql("nation", "customer", "supplier", tbox=BROKEN)
FOUND = "SELECT DISTINCT '{rule}' AS rule, {s} AS s, {p} AS p, {o} AS o, {detail} AS detail FROM {rest}"


def broken(spark, d):
    return lift(spark, d, "nation", "customer", "supplier", tbox=BROKEN)


@query(over(BROKEN_SQL, FOUND.format(rule="prp-asyp", s="a.s", p="a.p", o="a.o", detail="a.p", rest=f"t a JOIN t b ON a.s = b.o AND a.o = b.s AND a.p = b.p JOIN t k ON k.s = a.p AND k.o = '{t.ASYMMETRIC}'")))
def q32_check_asymmetric(spark, d):
    return r.check_asymmetric(broken(spark, d))


@query(over(BROKEN_SQL, FOUND.format(rule="prp-irp", s="a.s", p="a.p", o="a.o", detail="a.p", rest=f"t a JOIN t k ON k.s = a.p AND k.o = '{t.IRREFLEXIVE}' WHERE a.s = a.o")))
def q33_check_irreflexive(spark, d):
    return r.check_irreflexive(broken(spark, d))


@query(over(BROKEN_SQL, FOUND.format(rule="prp-pdw", s="a.s", p="a.p", o="a.o", detail="b.p", rest=f"t k JOIN t a ON a.p = k.s JOIN t b ON b.p = k.o AND a.s = b.s AND a.o = b.o WHERE k.p = '{t.PROPERTY_DISJOINT}'")))
def q34_check_disjoint_properties(spark, d):
    return r.check_disjoint_properties(broken(spark, d))


SHARED = "t k JOIN t a ON a.o = k.s AND a.p = '{type}' JOIN t b ON b.o = k.o AND b.p = '{type}' AND a.s = b.s WHERE k.p = '{axiom}'"


@query(over(BROKEN_SQL, FOUND.format(rule="cls-com", s="a.s", p="a.p", o="a.o", detail="b.o", rest=SHARED.format(type=t.TYPE, axiom=t.COMPLEMENT))))
def q35_check_complement(spark, d):
    return r.check_complement(broken(spark, d))


@query(over(BROKEN_SQL, FOUND.format(rule="cax-dw", s="a.s", p="a.p", o="a.o", detail="b.o", rest=SHARED.format(type=t.TYPE, axiom=t.DISJOINT))))
def q36_check_disjoint_classes(spark, d):
    return r.check_disjoint_classes(broken(spark, d))


@query(over(BROKEN_SQL, FOUND.format(rule="eq-diff1", s="a.s", p="a.p", o="a.o", detail=f"'{t.DIFFERENT}'", rest=f"t a JOIN t b ON b.p = '{t.DIFFERENT}' AND ((a.s = b.s AND a.o = b.o) OR (a.s = b.o AND a.o = b.s)) WHERE a.p = '{t.SAME}'")))
def q37_check_different(spark, d):
    return r.check_different(broken(spark, d))


# Targets and shapes.

ORDER_SHAPE = property_shape("OrderShape", u("Order"), u("placedBy"), (sh("class"), u("Customer")), (sh("node"), u("PartyShape")))
PARTY_SHAPE = property_shape("PartyShape", u("Party"), u("inNation"), (sh("minCount"), int_(1)), name="p2")


@query(over(lift_sql("orders", "customer", "supplier"), f"""SELECT s AS node FROM t WHERE p = '{t.TYPE}' AND (o IN ('{u('Order')}', '{u('Supplier')}') OR o LIKE '%Customer>')
UNION SELECT o FROM t WHERE p = '{u('placedBy')}'"""))
def q40_focus_nodes(spark, d):
    return extract(lift(spark, d, "orders", "customer", "supplier", tbox=TBOX), shapes(*ORDER_SHAPE, *PARTY_SHAPE))[1]


@query(f"SELECT c FROM (VALUES ('{u('Order')}'), ('{u('Customer')}'), ('{u('Party')}'), ('{u('Supplier')}')) v(c) UNION SELECT DISTINCT '<{U}' || c_mktsegment || 'Customer>' FROM customer")
def q41_target_classes(spark, d):
    graph = lift(spark, d, "customer", tbox=TBOX)
    return spark.createDataFrame([(c,) for c in sorted(extract(graph, shapes(*ORDER_SHAPE, *PARTY_SHAPE))[0])], "c string")


@query(f"SELECT * FROM (VALUES ('{u('placedBy')}'), ('{u('involves')}'), ('{u('inNation')}'), ('{u('locatedIn')}')) v(path)")
def q42_paths(spark, d):
    graph = lift(spark, d, "region", tbox=TBOX)
    return spark.createDataFrame([(p,) for p in sorted(extract(graph, shapes(*ORDER_SHAPE, *PARTY_SHAPE))[2])], "path string")


@query(f"SELECT 'path' AS kind, '{u('partOf')}' AS term UNION ALL SELECT DISTINCT 'target', min('<{U}nation/' || cast(n_nationkey as string) || '>') OVER (PARTITION BY n_regionkey) FROM nation")
def q43_rewrite_shapes(spark, d):
    """Nations of one region are one node here, so target nodes become the least of them; the path its representative."""
    targets = [(u("S"), sh("targetNode"), f"<{U}nation/{x.n_nationkey}>") for x in spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey").collect()]
    s = shapes(*targets, (u("S"), sh("property"), "_:p"), ("_:p", sh("path"), u("partOf")))
    new = fuse(lift(spark, d, "nation", tbox=[(u("partOf"), t.TYPE, t.INVERSE_FUNCTIONAL), (u("within"), t.EQ_PROPERTY, u("partOf"))]), s).shapes
    return spark.createDataFrame([("path", new["_:p"].path[1]), *sorted({("target", x) for _, x in new[u("S")].targets})], "kind string, term string")


# Constraints: the failing focus nodes and values.


def failures(graph, s, *columns):
    return validate(graph, s).select(*(columns or ("focus", "value")))


def component(name: str) -> str:
    return sh(f"{name}ConstraintComponent")


MIN_SHAPE = property_shape("OrderShape", u("Order"), u("contains"), (sh("minCount"), int_(1)))
MIN_SQL = f"SELECT '<{U}order/' || cast(o_orderkey as string) || '>' AS focus, '{component('MinCount')}' AS component FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"


@query(MIN_SQL)
def q50_min_count(spark, d):
    return failures(lift(spark, d, *ORDERS, only=(t.TYPE, u("contains"))), shapes(*MIN_SHAPE), "focus", "component")


@query(f"SELECT '<{U}order/' || cast(l_orderkey as string) || '>' AS focus, '{component('MaxCount')}' AS component FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey HAVING count(DISTINCT l_partkey) > 7")
def q51_max_count(spark, d):
    s = shapes(*property_shape("OrderShape", u("Order"), u("contains"), (sh("maxCount"), int_(7))))
    return failures(lift(spark, d, *ORDERS, only=(t.TYPE, u("contains"))), s, "focus", "component")


@query(f"SELECT '<{U}order/' || cast(o_orderkey as string) || '>' AS focus, '<{U}customer/' || cast(o_custkey as string) || '>' AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment NOT IN ('BUILDING')")
def q52_class(spark, d):
    s = shapes(*property_shape("OrderShape", u("Order"), u("placedBy"), (sh("class"), u("BUILDINGCustomer"))))
    return failures(lift(spark, d, "orders", "customer", only=(t.TYPE, u("placedBy")), tbox=TBOX), s)


@query(f"SELECT '<{U}customer/' || cast(c_custkey as string) || '>' AS focus, concat('\"', cast(cast(round(c_acctbal * 100) as bigint) as string), '\"^^<{t.XSD}nonNegativeInteger>') AS value FROM customer WHERE round(c_acctbal * 100) < 0")
def q53_datatype(spark, d):
    graph = lift(spark, d, "customer", tbox=TBOX)
    graph = graph.withColumn("o", F.replace("o", F.lit("XMLSchema#integer"), F.lit("XMLSchema#nonNegativeInteger")))
    s = shapes(*property_shape("CustomerShape", u("Customer"), u("acctCents"), (sh("datatype"), t.iri(t.XSD + "nonNegativeInteger"))))
    return failures(graph, s)


@query(f"SELECT '<{U}order/' || cast(o_orderkey as string) || '>' AS focus, '\"' || o_orderstatus || '\"' AS value FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def q54_in(spark, d):
    listed = [("_:l1", t.FIRST, '"F"'), ("_:l1", t.REST, "_:l2"), ("_:l2", t.FIRST, '"O"'), ("_:l2", t.REST, t.NIL)]
    s = shapes(*property_shape("OrderShape", u("Order"), u("status"), (sh("in"), "_:l1")), *listed)
    return failures(lift(spark, d, "orders", only=(t.TYPE, u("status"))), s)


OR_SHAPE = [
    *property_shape("OrderShape", u("Order"), u("placedBy"), (sh("or"), "_:l1")), ("_:l1", t.FIRST, "_:a"), ("_:l1", t.REST, "_:l2"), ("_:l2", t.FIRST, "_:b"), ("_:l2", t.REST, t.NIL),
    ("_:a", sh("class"), u("BUILDINGCustomer")), ("_:b", sh("class"), u("MACHINERYCustomer")),
]


@query(f"SELECT '<{U}order/' || cast(o_orderkey as string) || '>' AS focus, '<{U}customer/' || cast(o_custkey as string) || '>' AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def q55_or(spark, d):
    return failures(lift(spark, d, "orders", "customer", only=(t.TYPE, u("placedBy"))), shapes(*OR_SHAPE))


@query(f"SELECT '<{U}customer/' || cast(o_custkey as string) || '>' AS value, '<{U}order/' || cast(o_orderkey as string) || '>' AS focus FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0")
def q56_node(spark, d):
    s = shapes(
        *property_shape("OrderShape", u("Order"), u("placedBy"), (sh("node"), u("Solvent"))), (u("Solvent"), sh("property"), "_:q"), ("_:q", sh("path"), u("acctCents")), ("_:q", sh("minInclusive"), int_(0))
    )
    return failures(lift(spark, d, "orders", "customer"), s)


@query(f"SELECT DISTINCT '<{U}customer/' || cast(c_custkey as string) || '>' AS focus FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def q57_not(spark, d):
    s = shapes(
        (u("Idle"), sh("targetClass"), u("BUILDINGCustomer")), (u("Idle"), sh("not"), "_:n"), ("_:n", sh("path"), "_:inv"), ("_:inv", sh("inversePath"), u("placedBy")), ("_:n", sh("minCount"), int_(1))
    )
    return failures(lift(spark, d, "orders", "customer", only=(t.TYPE, u("placedBy"))), s, "focus")


@query(f"SELECT component, count(*) AS n FROM (SELECT component FROM ({MIN_SQL}) x UNION ALL SELECT '{component('In')}' FROM orders WHERE o_orderstatus NOT IN ('F', 'O')) y GROUP BY component")
def q58_report_counts(spark, d):
    listed = [("_:l1", t.FIRST, '"F"'), ("_:l1", t.REST, "_:l2"), ("_:l2", t.FIRST, '"O"'), ("_:l2", t.REST, t.NIL)]
    s = shapes(*MIN_SHAPE, *property_shape("OrderShape", u("Order"), u("status"), (sh("in"), "_:l1"), name="p2"), *listed)
    return report_counts(validate(lift(spark, d, *ORDERS, only=(t.TYPE, u("contains"), u("status"))), s))


# Whole engines.

FUSE_SHAPES = [
    *property_shape("DocShape", u("Doc"), u("inLang"), (sh("maxCount"), int_(1))), (u("DocShape"), sh("property"), "_:p2"), ("_:p2", sh("path"), u("contentHash")), ("_:p2", sh("minCount"), int_(1)),
    (u("DocShape"), sh("property"), "_:p3"), ("_:p3", sh("path"), u("source")), ("_:p3", sh("minCount"), int_(1)),
]
DOC_TBOX = [x for x in TBOX if x[0] == u("contentHash")]


@query(f"""WITH d AS (SELECT min('<{U}doc/' || cast(doc_id as string) || '>') AS focus, count(DISTINCT lang) AS n FROM documents GROUP BY md5(text))
SELECT focus, '{component('MaxCount')}' AS component FROM d WHERE n > 1 UNION ALL SELECT focus, '{component('MinCount')}' FROM d""")
def q59_fuse_then_validate(spark, d):
    """Copies of a text are one node after fusion; each then lacks a source."""
    fused = fuse(lift(spark, d, "documents", tbox=DOC_TBOX), shapes(*FUSE_SHAPES))
    return failures(fused.graph, fused.shapes, "focus", "component")


@query(over(lift_sql("customer", "supplier", "orders", only=(t.TYPE, u("placedBy")), tbox=()), f"""WITH e AS (SELECT * FROM ({values(schema_rows(t.SUBCLASS))}) v(a, b)), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a),
y AS (SELECT s, o FROM t WHERE p = '{t.TYPE}' UNION SELECT o, '{u('Customer')}' FROM t WHERE p = '{u('placedBy')}')
SELECT o, count(*) AS n FROM (SELECT s, o FROM y UNION SELECT s, b FROM y JOIN c ON a = o) z GROUP BY o UNION ALL SELECT '{u('involves')}', count(*) FROM t WHERE p = '{u('placedBy')}'"""))
def q60_rdfs_full(spark, d):
    graph = full_closure(lift(spark, d, "customer", "supplier", "orders", only=(t.TYPE, u("placedBy")), tbox=[x for x in TBOX if x[1] in (t.SUBCLASS, t.SUBPROPERTY, t.DOMAIN, t.RANGE)]), "rdfs")
    types = graph.where((F.col("p") == t.TYPE) & F.col("s").contains("/")).groupBy("o").agg(F.count("*").alias("n"))
    return types.union(graph.where(F.col("p") == u("involves")).groupBy(F.col("p").alias("o")).agg(F.count("*").alias("n")))


@query(f"""SELECT '{u('locatedIn')}' AS p, (SELECT count(*) * 2 FROM customer) + (SELECT count(*) FROM nation) AS n
UNION ALL SELECT '{u('Buyer')}', count(*) FROM customer UNION ALL SELECT '{u('Agent')}', count(*) FROM customer""")
def q61_owl_full(spark, d):
    graph = full_closure(lift(spark, d, "customer", "nation", only=(t.TYPE, u("inNation"), u("partOf")), tbox=TBOX))
    located = graph.where(F.col("p") == u("locatedIn")).groupBy("p").agg(F.count("*").alias("n"))
    types = graph.where((F.col("p") == t.TYPE) & F.col("o").isin(u("Buyer"), u("Agent")) & F.col("s").contains("customer/")).groupBy(F.col("o").alias("p")).agg(F.count("*").alias("n"))
    return located.union(types)


@query("SELECT 'direct' AS method, count(*) AS n FROM documents UNION ALL SELECT 'merged', count(DISTINCT md5(text)) FROM documents")
def q62_direct_vs_merged(spark, d):
    s = shapes(*property_shape("DocShape", u("Doc"), u("source"), (sh("minCount"), int_(1))), (u("DocShape"), sh("property"), "_:p2"), ("_:p2", sh("path"), u("contentHash")))
    graph = lift(spark, d, "documents", tbox=DOC_TBOX)
    fused = fuse(graph, s)
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("method"), "n")
    return count("direct", validate(graph, s)).union(count("merged", validate(fused.graph, fused.shapes)))


@query("SELECT event_type AS method, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1")
def q63_bench_stats(spark, d):
    from .report import timing_stats

    found = timing_stats(spark.read.parquet(f"{d}/events.parquet").selectExpr("event_type AS method", "value AS seconds"))
    return found.select("method", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("SELECT true AS same, count(*) = 0 AS changed FROM nation")
def q64_isomorphic(spark, d):
    """Nations and regions without names of their own, told apart by what they are part of."""
    nation = spark.read.parquet(f"{d}/nation.parquet")
    named = lambda far: nation.selectExpr(f"concat('_:n', cast(n_nationkey + {far} as string)) AS s", f"'{u('partOf')}' AS p", f"concat('_:r', cast(n_regionkey + {far} as string)) AS o").union(
        nation.where("n_regionkey < 3").selectExpr(f"concat('_:r', cast(n_regionkey + {far} as string))", f"'{u('size')}'", "concat('\"', cast(n_nationkey as string), '\"')")
    )
    a, b = named(0), named(1000)
    return spark.createDataFrame([(g.isomorphic(a, b), g.isomorphic(a, b.where(F.col("o") != '"2"')))], "same boolean, changed boolean")


@query(over(lift_sql("documents"), f"SELECT DISTINCT b.member AS s, t.p, t.o FROM t JOIN {REP} a ON t.s = a.member JOIN {REP} b ON a.rep = b.rep WHERE t.p <> '{t.TYPE}' AND t.p <> '{t.SAME}'"))
def q65_infer_materialized(spark, d):
    """Materialise mode: copies of a text share their assertions."""
    s = shapes(*property_shape("DocShape", u("Doc"), u("contentHash"), (sh("minCount"), int_(1))))
    graph = infer(lift(spark, d, "documents", tbox=DOC_TBOX), s)
    return graph.where((F.col("p") != t.TYPE) & (F.col("p") != t.SAME))


@query(over(lift_sql("part"), f"""SELECT s AS focus, o AS value, '{component('MaxInclusive')}' AS component FROM t WHERE p = '{u('size')}' AND try_cast(regexp_extract(o, '"(\\d+)"', 1) AS INT) > 40
UNION ALL SELECT s, o, '{component('Pattern')}' FROM t WHERE p = '{u('brand')}' AND NOT regexp_matches(o, '1"$')"""))
def q66_value_ranges_and_patterns(spark, d):
    kinds = spark.read.parquet(f"{d}/part.parquet").select("p_type").distinct()
    below = kinds.selectExpr(f"concat('<{U}', replace(p_type, ' ', '_'), 'Part>') AS s", f"'{t.SUBCLASS}' AS p", f"'{u('Part')}' AS o")
    s = shapes(
        *property_shape("PartShape", u("Part"), u("size"), (sh("maxInclusive"), int_(40))),
        *property_shape("PartShape", u("Part"), u("brand"), (sh("pattern"), '"1$"'), name="p2"),
    )
    return failures(g.union(lift(spark, d, "part"), below), s, "focus", "value", "component")


# Loaders, writers and reports.


def kept(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(over(lift_sql("customer", "nation"), "SELECT s, p, o FROM t"))
def q70_ntriples_round_trip(spark, d):
    path = kept(spark, "ntriples")
    loader.write_ntriples(lift(spark, d, "customer", "nation"), path)
    return loader.load_data_graph(spark, path, "nt")


@query(over(lift_sql("nation", "supplier"), "SELECT s, p, o FROM t"))
def q71_turtle_round_trip(spark, d):
    path = kept(spark, "turtle")
    loader.write_turtle(lift(spark, d, "nation", "supplier"), path, {"x": U})
    return loader.load_data_graph(spark, path, "ttl")


@query(over(lift_sql("nation", "region"), "SELECT s, p, o FROM t"))
def q72_data_with_rdfxml_ontology(spark, d):
    """A file of data and an RDF/XML file as one graph."""
    import re

    folder = kept(spark, "combined")
    loader.write_turtle(lift(spark, d, "nation"), f"{folder}/nation.ttl", {"x": U})
    rows = sorted(r.s for r in lift(spark, d, "region").collect())
    items = "".join(f'<x:Region rdf:about="{x[1:-1]}"/>' for x in rows)
    loader.write_text(spark, f'<rdf:RDF xmlns:rdf="{t.RDF}" xmlns:x="{U}">{items}</rdf:RDF>', f"{folder}/region.owl")
    found = {re.sub(r".*/(\w+\.\w+)$", r"\1", f): f for x in (".ttl", ".owl") for f in loader.find_files(spark, folder, "", x)}
    ontology = loader.ontology_for("TPC regions", {"lubm": None, "region": f"{folder}/region.owl"})
    assert set(found) == {"nation.ttl", "region.owl"} and loader.dataset_name(f"{folder}/nation.ttl") == "nation"
    return loader.load_with_ontology(spark, f"{folder}/nation.ttl", ontology)


@query(f"SELECT graph, n FROM (VALUES ('{u('a')}', (SELECT count(DISTINCT n_nationkey) * 2 FROM nation)), ('{u('b')}', (SELECT count(DISTINCT s_suppkey) * 2 FROM supplier))) v(graph, n)")
def q73_named_graphs(spark, d):
    quads = lift(spark, d, "nation").withColumn("g", F.lit(u("a"))).union(lift(spark, d, "supplier").withColumn("g", F.lit(u("b"))))
    path = kept(spark, "quads")
    quads.select(F.concat_ws(" ", "s", "p", "o", "g", F.lit(".")).alias("value")).write.text(path)
    return loader.named_graphs(loader.load_quads(spark, path, "nq"))


REPORT_SQL = f"SELECT count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('F', 'O')"


@query(f"""WITH r AS ({REPORT_SQL}) SELECT p, n FROM r, (VALUES ('result'), ('focusNode'), ('resultPath'), ('value'), ('sourceConstraintComponent'), ('sourceShape'), ('resultSeverity')) v(q),
LATERAL (SELECT '<{t.SH}' || q || '>' AS p) x UNION ALL SELECT '<{t.SH}conforms>', 1 UNION ALL SELECT '{t.TYPE}', n + 1 FROM r""")
def q74_report_as_turtle(spark, d):
    """The report graph, written as Turtle and read again."""
    listed = [("_:l1", t.FIRST, '"F"'), ("_:l1", t.REST, "_:l2"), ("_:l2", t.FIRST, '"O"'), ("_:l2", t.REST, t.NIL)]
    s = shapes(*property_shape("OrderShape", u("Order"), u("status"), (sh("in"), "_:l1")), *listed)
    path = kept(spark, "report")
    loader.write_turtle(report_graph(validate(lift(spark, d, "orders", only=(t.TYPE, u("status"))), s)), path, {"sh": t.SH})
    return loader.load_data_graph(spark, path, "ttl").groupBy("p").agg(F.count("*").alias("n"))


@query(f"""WITH t AS ({lift_sql("documents", only=(u("contentHash"),))}), m AS (SELECT s, min(s) OVER (PARTITION BY o) AS rep FROM t)
SELECT 'before' AS at, s AS node FROM m WHERE s <> rep OR s IN (SELECT rep FROM m WHERE s <> rep)""")
def q75_nodes_awaiting_merge(spark, d):
    """Equal documents await merging; after fusion none is left, nor a path or class."""
    graph = lift(spark, d, "documents", tbox=DOC_TBOX)
    same = r.inverse_functional_same(graph, [u("contentHash")])
    focus = graph.where((F.col("p") == t.TYPE) & (F.col("o") == u("Doc"))).select("s")
    before = pending.awaiting(g.union(graph, same), focus, pending.EITHER_SAME)
    merged = g.minus(r.replaced(graph, connected_components(same, "s", "o").select(F.col("node").alias("member"), F.col("component").alias("rep"))), same)
    after = pending.unsettled_focus(merged, focus)
    assert pending.paths_settled(graph, [u("contentHash")]) and pending.classes_settled(graph, [u("Doc")]) and not pending.has_candidates(graph, u("Doc"), pending.CLASS_LINKS)
    return before.select(F.lit("before").alias("at"), "node").union(after.select(F.lit("after").alias("at"), "node"))


# Class expressions, keys and chains.


def listed(name: str, *items: str) -> list[tuple[str, str, str]]:
    return [x for i, item in enumerate(items) for x in ((f"_:{name}{i}", t.FIRST, item), (f"_:{name}{i}", t.REST, f"_:{name}{i + 1}" if i + 1 < len(items) else t.NIL))]


INDUSTRY = [
    (u("Industrial"), t.UNION, "_:u0"), *listed("u", u("MACHINERYCustomer"), u("BUILDINGCustomer")), (u("Placed"), t.ON_PROPERTY, u("inNation")), (u("Placed"), t.SOME, u("Nation")),
    (u("Both"), t.INTERSECTION, "_:i0"), *listed("i", u("Industrial"), u("Placed")),
]


@query(f"""WITH c AS (SELECT c_mktsegment IN ('MACHINERY', 'BUILDING') AS i, c_nationkey IN (SELECT n_nationkey FROM nation) AS p FROM customer)
SELECT '{u('Industrial')}' AS cls, count(*) AS n FROM c WHERE i UNION ALL SELECT '{u('Placed')}', count(*) FROM c WHERE p UNION ALL SELECT '{u('Both')}', count(*) FROM c WHERE i AND p""")
def q76_unions_and_intersections(spark, d):
    graph = full_closure(lift(spark, d, "customer", "nation", only=(t.TYPE, u("inNation")), tbox=INDUSTRY))
    return graph.where((F.col("p") == t.TYPE) & F.col("o").isin(u("Industrial"), u("Placed"), u("Both"))).groupBy(F.col("o").alias("cls")).agg(F.count("*").alias("n"))


VALUES_FROM = [
    (u("BUILDINGCustomer"), t.SUBCLASS, u("AtHome")), (u("AtHome"), t.ON_PROPERTY, u("inNation")), (u("AtHome"), t.ALL, u("Home")),
    (u("Northern"), t.ON_PROPERTY, u("partOf")), (u("Northern"), t.HAS_VALUE, u("region/1")), (u("Chosen"), t.ONE_OF, "_:o0"), *listed("o", u("region/0"), u("region/2")),
]


@query(f"""SELECT DISTINCT '<{U}nation/' || cast(c_nationkey as string) || '>' AS node, '{u('Home')}' AS cls FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT '<{U}nation/' || cast(n_nationkey as string) || '>', '{u('Northern')}' FROM nation WHERE n_regionkey = 1 UNION ALL SELECT * FROM (VALUES ('{u('region/0')}', '{u('Chosen')}'), ('{u('region/2')}', '{u('Chosen')}')) v(a, b)""")
def q77_values_of_restrictions(spark, d):
    graph = full_closure(lift(spark, d, "customer", "nation", only=(t.TYPE, u("inNation"), u("partOf")), tbox=VALUES_FROM))
    return graph.where((F.col("p") == t.TYPE) & F.col("o").isin(u("Home"), u("Northern"), u("Chosen"))).select(F.col("s").alias("node"), F.col("o").alias("cls"))


@query("SELECT coalesce(sum(n * n), 0)::BIGINT AS pairs, count(*) AS groups FROM (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL GROUP BY md5(text), lang) x WHERE n > 1")
def q78_same_by_key(spark, d):
    """Documents of one text and language are the same."""
    graph = full_closure(lift(spark, d, "documents", tbox=[(u("Doc"), t.HAS_KEY, "_:k0"), *listed("k", u("contentHash"), u("inLang"))]))
    same = graph.where(F.col("p") == t.SAME)
    return same.agg(F.count("*").alias("pairs")).join(same.groupBy("s").agg(F.min("o").alias("m")).agg(F.count_distinct("m").alias("groups")))


@query(over(lift_sql("customer", "nation"), f"SELECT DISTINCT a.s, '{u('inRegion')}' AS p, b.o FROM t a JOIN t b ON a.o = b.s WHERE a.p = '{u('inNation')}' AND b.p = '{u('partOf')}'"))
def q79_property_chain(spark, d):
    graph = full_closure(lift(spark, d, "customer", "nation", only=(u("inNation"), u("partOf")), tbox=[(u("inRegion"), t.CHAIN, "_:c0"), *listed("c", u("inNation"), u("partOf"))]))
    return graph.where(F.col("p") == u("inRegion"))


# The other constraint components, paths and targets.

IRI_PART = f"concat('<{U}part/', cast(p_partkey as string), '>')"


def parts(spark, d) -> DataFrame:
    """Parts as plain Part, with size, price (in whole thousands), brand, and the price again as cost."""
    rows = spark.read.parquet(f"{d}/part.parquet")
    price = typed("cast(floor(p_retailprice / 100) as bigint)", "integer")
    made = [(f"'{t.TYPE}'", f"'{u('Part')}'"), (f"'{u('size')}'", typed("p_size", "integer")), (f"'{u('price')}'", price), (f"'{u('cost')}'", price), (f"'{u('brand')}'", plain("p_brand"))]
    out = None
    for p, o in made:
        part = rows.selectExpr(f"{IRI_PART} AS s", f"{p} AS p", f"{o} AS o").where("o IS NOT NULL")
        out = part if out is None else out.union(part)
    return out


SIZED = "concat('\"', cast(p_size as string), '\"^^<" + t.XSD + "integer>')"
BRANDED = "concat('\"', p_brand, '\"')"


def part_failures(**cases: tuple[str, str]) -> str:
    """SQL for the failures of components: where each fails, and with what value."""
    return " UNION ALL ".join(f"SELECT {IRI_PART} AS focus, {value} AS value, '{component(name)}' AS component FROM part WHERE {where}" for name, (where, value) in cases.items())


@query(part_failures(MinInclusive=("p_size < 10", SIZED), MinExclusive=("p_size <= 5", SIZED), MaxExclusive=("p_size >= 45", SIZED)))
def q80_value_ranges(spark, d):
    return failures(parts(spark, d), shapes(*property_shape("PartShape", u("Part"), u("size"), (sh("minInclusive"), int_(10)), (sh("minExclusive"), int_(5)), (sh("maxExclusive"), int_(45)))), "focus", "value", "component")


@query(part_failures(MinLength=("length(p_brand) < 8", BRANDED), MaxLength=("length(p_brand) > 7", BRANDED), NodeKind=("p_brand IS NOT NULL", BRANDED), HasValue=("p_brand IS DISTINCT FROM 'Brand#11'", "NULL")))
def q81_lengths_kinds_and_values(spark, d):
    rest = ((sh("minLength"), int_(8)), (sh("maxLength"), int_(7)), (sh("nodeKind"), sh("IRI")), (sh("hasValue"), '"Brand#11"'))
    return failures(parts(spark, d), shapes(*property_shape("PartShape", u("Part"), u("brand"), *rest)), "focus", "value", "component")


PRICE = "cast(floor(p_retailprice / 100) as bigint)"


@query(part_failures(LessThan=(f"p_size >= {PRICE}", SIZED), LessThanOrEquals=(f"p_size > {PRICE}", SIZED), Disjoint=(f"p_size = {PRICE}", SIZED)))
def q82_pairs_of_properties(spark, d):
    """Prices equal costs, so that constraint gives nothing."""
    rest = [(u("PartShape"), sh("property"), "_:p2"), ("_:p2", sh("path"), u("price")), ("_:p2", sh("equals"), u("cost"))]
    s = shapes(*property_shape("PartShape", u("Part"), u("size"), (sh("lessThan"), u("price")), (sh("lessThanOrEquals"), u("price")), (sh("disjoint"), u("price"))), *rest)
    return failures(parts(spark, d), s, "focus", "value", "component")


CUSTOMER = f"'<{U}customer/' || cast(c_custkey as string) || '>'"
GROUPS = [
    *[(u("G"), sh("targetSubjectsOf"), u("inNation")), (u("G"), sh("closed"), '"true"^^<' + t.XSD + "boolean>"), (u("G"), sh("ignoredProperties"), "_:g0")], *listed("g", t.TYPE), (u("G"), sh("property"), "_:gp"), ("_:gp", sh("path"), u("inNation")),
    (u("G"), sh("and"), "_:a0"), *listed("a", "_:one", "_:two"), (u("G"), sh("xone"), "_:x0"), *listed("x", "_:one", "_:two"),
    ("_:one", sh("class"), u("BUILDINGCustomer")), ("_:two", sh("property"), "_:owes"), ("_:owes", sh("path"), u("acctCents")), ("_:owes", sh("maxExclusive"), int_(0)),
]


@query(f"""WITH c AS (SELECT {CUSTOMER} AS focus, c_mktsegment = 'BUILDING' AS one, c_acctbal < 0 AS two, '"' || cast(cast(round(c_acctbal * 100) as bigint) as string) || '"^^<{t.XSD}integer>' AS cents FROM customer)
SELECT focus, cents AS value, '{component('Closed')}' AS component FROM c UNION ALL SELECT focus, focus, '{component('And')}' FROM c WHERE NOT (one AND two) UNION ALL SELECT focus, focus, '{component('Xone')}' FROM c WHERE one = two""")
def q83_closed_and_xone(spark, d):
    return failures(lift(spark, d, "customer"), shapes(*GROUPS), "focus", "value", "component")


@query(f"""SELECT '<{U}order/' || cast(o_orderkey as string) || '>' AS focus, '{component('QualifiedMinCount')}' AS component FROM orders
LEFT JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey AND p_type = 'ECONOMY') x ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING count(l_partkey) < 2""")
def q84_qualified_counts(spark, d):
    s = shapes(*property_shape("OrderShape", u("Order"), u("contains"), (sh("qualifiedValueShape"), "_:q"), (sh("qualifiedMinCount"), int_(2))), ("_:q", sh("class"), u("ECONOMYPart")))
    return failures(lift(spark, d, "orders", "lineitem", "part", only=(t.TYPE, u("contains"))), s, "focus", "component")


PATHS = [
    (u("P"), sh("targetClass"), u("Order")), (u("P"), sh("property"), "_:seq"), ("_:seq", sh("path"), "_:s0"), *listed("s", u("placedBy"), u("inNation"), u("partOf")), ("_:seq", sh("in"), "_:r0"), *listed("r", u("region/0"), u("region/1")),
    (u("P"), sh("property"), "_:alt"), ("_:alt", sh("path"), "_:ap"), ("_:ap", sh("alternativePath"), "_:b0"), *listed("b", u("placedBy"), u("status")), ("_:alt", sh("minCount"), int_(3)),
]


@query(f"""WITH o AS (SELECT '<{U}order/' || cast(o_orderkey as string) || '>' AS focus, n_regionkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)
SELECT focus, '<{U}region/' || cast(n_regionkey as string) || '>' AS value, '{component('In')}' AS component FROM o WHERE n_regionkey NOT IN (0, 1) UNION ALL SELECT focus, NULL, '{component('MinCount')}' FROM o""")
def q85_sequence_and_alternative_paths(spark, d):
    return failures(lift(spark, d, "orders", "customer", "nation", only=(t.TYPE, u("placedBy"), u("inNation"), u("partOf"), u("status"))), shapes(*PATHS), "focus", "value", "component")


REACH = [
    (u("R"), sh("targetObjectsOf"), u("partOf")), (u("R"), sh("property"), "_:in"), ("_:in", sh("path"), "_:ip"), ("_:ip", sh("inversePath"), u("partOf")), ("_:in", sh("maxCount"), int_(4)),
    (u("N"), sh("targetSubjectsOf"), u("partOf")), (u("N"), sh("property"), "_:st"), ("_:st", sh("path"), "_:sp"), ("_:sp", sh("zeroOrMorePath"), u("partOf")), ("_:st", sh("minCount"), int_(3)),
    (u("N"), sh("property"), "_:pl"), ("_:pl", sh("path"), "_:pp"), ("_:pp", sh("oneOrMorePath"), u("partOf")), ("_:pl", sh("maxCount"), int_(0)),
    (u("N"), sh("property"), "_:op"), ("_:op", sh("path"), "_:oo"), ("_:oo", sh("zeroOrOnePath"), u("partOf")), ("_:op", sh("class"), u("Nation")),
]


@query(f"""WITH n AS (SELECT '<{U}nation/' || cast(n_nationkey as string) || '>' AS focus, '<{U}region/' || cast(n_regionkey as string) || '>' AS region FROM nation)
SELECT focus, NULL AS value, '{component('MinCount')}' AS component FROM n UNION ALL SELECT focus, NULL, '{component('MaxCount')}' FROM n UNION ALL SELECT focus, region, '{component('Class')}' FROM n
UNION ALL SELECT region, NULL, '{component('MaxCount')}' FROM n GROUP BY region HAVING count(*) > 4""")
def q86_repeated_and_inverse_paths(spark, d):
    return failures(lift(spark, d, "nation"), shapes(*REACH), "focus", "value", "component")


NAMED = "concat('\"', cast(doc_id as string), '\"@', lang)"
TEXT_IRI = f"concat('<{U}text/', md5(text), '>')"


@query(f"""WITH d AS (SELECT DISTINCT {TEXT_IRI} AS focus, lang, doc_id, {NAMED} AS value FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL)
SELECT focus, value, '{component('LanguageIn')}' AS component FROM d WHERE lang NOT IN ('en', 'fr') UNION ALL SELECT focus, NULL, '{component('UniqueLang')}' FROM d GROUP BY focus, lang HAVING count(*) > 1""")
def q87_languages(spark, d):
    """Each text names its documents, in the document's language."""
    graph = spark.read.parquet(f"{d}/documents.parquet").selectExpr(f"{TEXT_IRI} AS s", f"'{u('names')}' AS p", f"{NAMED} AS o").where("s IS NOT NULL AND o IS NOT NULL")
    s = [(u("L"), sh("targetSubjectsOf"), u("names")), (u("L"), sh("property"), "_:l"), ("_:l", sh("path"), u("names")), ("_:l", sh("languageIn"), "_:g0"), *listed("g", '"en"', '"fr"'), ("_:l", sh("uniqueLang"), '"true"^^<' + t.XSD + "boolean>")]
    return failures(graph, shapes(*s), "focus", "value", "component")


__all__ = ["Validator", "oracle_sql", "queries"]
