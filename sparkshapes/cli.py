"""Command line: validates a data graph by one of the methods, several rounds, and writes reports and timings."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession

from .functions import terms as t
from .plans.engine import full_closure, fuse
from .plans.report import conforms, pretty_table, report_graph, report_text, timing_stats, violation_count
from .plans.shapes import Shapes
from .plans.tables import stored
from .plans.validator import validate
from .sources.loader import append_text, dataset_name, load_shapes, load_with_ontology, write_text, write_turtle

#: method -> label of result tables
METHODS = {"direct": "no inference", "direct-rdfs": "RDFS closure", "direct-owl": "RDFS and OWL RL closure", "merged": "merging", "merged-rdfs": "merging, RDFS rules"}


def results_of(graph: DataFrame, shapes: Shapes, method: str) -> DataFrame:
    """The validation results of a method."""
    if method == "direct":
        return validate(graph, shapes)
    if method in ("direct-rdfs", "direct-owl"):
        return validate(full_closure(graph, "rdfs" if method == "direct-rdfs" else "both", resources=True), shapes)
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    fused = fuse(graph, shapes, "rdfs" if method == "merged-rdfs" else "owl")
    return validate(fused.graph, fused.shapes)


def timed(graph: DataFrame, shapes: Shapes, method: str, rounds: int = 3, warm_up: int = 1) -> tuple[DataFrame, list[float]]:
    """(results of the last round, seconds of each round); every round starts from the same input."""
    for _ in range(warm_up):
        validate(graph, shapes).count()
    seconds = []
    for _ in range(rounds):
        began = time.perf_counter()
        results = stored(results_of(graph, shapes, method), "results")
        seconds.append(time.perf_counter() - began)
    return results, seconds


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sparkshapes", description=__doc__)
    parser.add_argument("data")
    parser.add_argument("shapes")
    parser.add_argument("--ontology")
    parser.add_argument("--method", choices=METHODS, action="append", help="may be given again; all methods if not given")
    parser.add_argument("--rounds", type=int, default=3)
    parser.add_argument("--warm-up", type=int, default=1)
    parser.add_argument("--out", help="folder for report graphs, report texts and the table of results")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("sparkshapes").getOrCreate()
    graph = stored(load_with_ontology(spark, args.data, args.ontology), "data")
    shapes = Shapes(load_shapes(args.shapes, spark=spark))
    name, rows = dataset_name(args.data), []
    for method in args.method or list(METHODS):
        results, seconds = timed(graph, shapes, method, args.rounds, args.warm_up)
        stats = timing_stats(spark.createDataFrame([(method, s) for s in seconds], "method string, seconds double")).first()
        rows.append([METHODS[method], f"{stats['mean']:.3f}", f"{stats['std']:.3f}", conforms(results), violation_count(results)])
        if args.out:
            write_turtle(report_graph(results), f"{args.out}/{name}/reportGraphs/{method}", {"sh": t.SH}, "overwrite")
            write_text(spark, report_text(results), f"{args.out}/{name}/reports/{method}.txt")
    text = pretty_table(["method", "mean s", "std s", "conforms", "violations"], rows)
    print(text)
    if args.out:
        append_text(spark, text, f"{args.out}/{name}/times.txt")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
