"""Validation reports as tables, triples and text, and timing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms as t
from .shapes import sh


#: Results that a report in text may hold; a report graph has no such bound.
MOST_SHOWN = 1_000_000


def conforms(results: DataFrame) -> bool:
    return results.isEmpty()


def report_counts(results: DataFrame) -> DataFrame:
    """component, n."""
    return results.groupBy("component").agg(F.count("*").alias("n"))


def violation_count(results: DataFrame) -> int:
    return results.count()


def report_graph(results: DataFrame) -> DataFrame:
    """The report's triples: a sh:ValidationReport node and one sh:result for each row, named by the row's hash."""
    spark = results.sparkSession
    rows = results.withColumn("r", F.concat(F.lit("_:r"), F.md5(F.concat_ws("\x01", "focus", F.coalesce("path", F.lit("")), F.coalesce("value", F.lit("")), "component", "shape"))))
    report = "_:report"
    # A complex path has no IRI of its own, so it is given as text.
    path = F.when(F.col("path").rlike("^<[^>]*>$"), F.col("path")).when(F.col("path").isNotNull(), F.concat(F.lit('"'), "path", F.lit('"')))
    message = F.when(F.col("message") != "", F.col("message"))
    parts = [
        rows.select(F.lit(report).alias("s"), F.lit(sh("result")).alias("p"), F.col("r").alias("o")),
        *[
            rows.select(F.col("r").alias("s"), F.lit(p).alias("p"), o.alias("o"))
            for p, o in (
                (t.TYPE, F.lit(sh("ValidationResult"))), (sh("focusNode"), F.col("focus")), (sh("resultPath"), path), (sh("value"), F.col("value")),
                (sh("sourceConstraintComponent"), F.col("component")), (sh("sourceShape"), F.col("shape")), (sh("resultSeverity"), F.col("severity")), (sh("resultMessage"), message),
            )
        ],
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p.where("o IS NOT NULL"))
    verdict = results.agg(F.when(F.count("*") == 0, F.lit("true")).otherwise("false").alias("v"))
    head = spark.createDataFrame([(report, t.TYPE, sh("ValidationReport"))], "s string, p string, o string")
    value = verdict.select(F.lit(report).alias("s"), F.lit(sh("conforms")).alias("p"), F.concat(F.lit('"'), "v", F.lit(f'"^^<{t.XSD}boolean>')).alias("o"))
    return head.union(value).union(out)


def report_text(results: DataFrame, most: int | None = None) -> str:
    """The report for people, in order; most limits the results shown, not those counted. Text is made on the driver, so
    results without a limit must be few enough to hold."""
    n = results.count()
    if most is None and n > MOST_SHOWN:
        raise ValueError(f"{n} results are too many for a text: give a limit, or write the report graph")
    lines = ["Validation Report", f"Conforms: {n == 0}", f"Results ({n}):"]
    shown = results.orderBy("focus", "shape", "component", "value")
    for row in (shown.limit(most) if most is not None else shown).toLocalIterator():
        lines.append(f"{row['component']} in {row['shape']}:")
        lines += [f"\t{name}: {row[key]}" for name, key in (("Severity", "severity"), ("Focus Node", "focus"), ("Result Path", "path"), ("Value Node", "value"), ("Message", "message")) if row[key]]
    return "\n".join(lines) + "\n"


def timing_stats(timings: DataFrame) -> DataFrame:
    """method, seconds in rows: the mean and population deviation of each method."""
    return timings.groupBy("method").agg(F.avg("seconds").alias("mean"), F.stddev_pop("seconds").alias("std"))


def pretty_table(header: list[str], rows: list[list]) -> str:
    cells = [header, *[[str(x) for x in row] for row in rows]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(header))]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    line = lambda r: "|" + "|".join(f" {x:<{w}} " for x, w in zip(r, widths, strict=True)) + "|"
    return "\n".join([rule, line(cells[0]), rule, *map(line, cells[1:]), rule]) + "\n"
