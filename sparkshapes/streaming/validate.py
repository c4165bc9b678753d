"""Validation of streams of triples, one micro-batch at a time, against fixed shapes and a fixed ontology."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.shapes import Shapes
from ..plans.validator import validate


def validate_stream(triples: DataFrame, shapes: Shapes, ontology: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that gives sink each batch's results with a batch column.

    triples: a stream of s, p, o. A batch is judged by its own triples and the ontology's; a focus node's triples must
    therefore come in one batch, as they do from a source that delivers whole resources. The checkpoint makes batches
    restart with the same rows; sinks that overwrite by batch number are then exact.
    """

    def each(batch: DataFrame, number: int) -> None:
        graph = batch.select("s", "p", "o").union(ontology.select("s", "p", "o")).distinct()
        sink(validate(graph, shapes).withColumn("batch", F.lit(number)), number)

    writer = triples.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
