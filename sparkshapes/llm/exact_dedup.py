"""Exact duplicates through a persistent digest index that is bucketed and sorted by hash, with DataFrame functions only.

A batch of documents is hashed to SHA-256 digests without separators, grouped (partial aggregation before the shuffle,
so a digest that holds a third of the rows is one row a task), anti-joined to the index by sort-merge without moving
the index, and what is new is appended to it. Every verdict is then read from the index. Texts are equal when identical
after the separators are deleted.

Null texts count as empty, a null id sorts first, empty texts are equal to each other; of equal rows of the batch that
brings a digest the one with the most code points stays, then the smallest id. Rows repeated under one id are one
document and get the same verdict. A text of any length is one digest. Only the id and text columns are read, so further
columns, whatever their names, do no harm. An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, discard, free_name, read_table, row_key, stored, text_of, with_groups


class DigestIndex:
    """digest -> keep_id, in a bucketed table of the warehouse that later batches can reuse."""

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None):
        self.spark, self.table = spark, table
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, new: DataFrame) -> None:
        """new: digest, keep_id."""
        (
            new.select("digest", "keep_id").repartition(self.buckets, "digest").sortWithinPartitions("digest")
            .write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").format("parquet").saveAsTable(self.table)
        )

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Adds a batch. Returns a row for each row of it: id, n_code_points, digest, keep_id, group_size, kept.

        A digest already in the index keeps the id stored there: of the batch only a row of that very id stays, so adding
        a batch again gives the same verdicts. group_size counts the batch's rows.
        """
        text = text_of(text_col)
        hashed = stored(
            docs.select(
                F.col(id_col).alias("id"),
                F.char_length(text).cast("long").alias("n_code_points"),
                F.unhex(F.sha2(F.translate(text, SPACES, ""), 256)).alias("digest"),
            ),
            "digests",
        )
        groups = hashed.groupBy("digest").agg(
            F.min(F.struct((-F.col("n_code_points")).alias("n"), F.col("id"))).alias("best"), F.count("*").alias("group_size")
        ).select("digest", F.col("best.id").alias("keep_id"), "group_size")
        groups = stored(groups, "digest-groups")
        if not self.exists():
            self.append(groups.limit(0))
        self.append(groups.join(self.rows().hint("merge"), "digest", "left_anti"))
        found = stored(groups.drop("keep_id").join(self.rows().hint("merge"), "digest"), "digest-verdicts")
        discard(groups)
        return with_groups(hashed, found, "digest", "group_size", hashed.count()).withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The verdicts on docs against an index of their own, which goes when all digests have been looked up."""
    index = DigestIndex(docs.sparkSession, f"digest_index_{uuid.uuid4().hex}")
    try:
        return index.add(docs, id_col, text_col)
    finally:
        index.drop()


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text another row keeps. Rows count by id and text, so different texts under one id, or
    without one, are different documents; of rows that repeat both, one stays."""
    row = free_name(docs, "_row")
    keyed = docs.withColumn(row, row_key(docs, id_col, text_of(text_col)))
    stay = exact_dedup(keyed, row, text_col).where("kept").groupBy(F.col("id").alias(row)).agg(F.count("*").alias("n"))
    once = keyed.join(stay.where("n = 1"), row, "left_semi")
    return once.unionByName(keyed.join(stay.where("n > 1"), row, "left_semi").dropDuplicates([row])).drop(row)


QUERIES = {"op6_exact_dedup": op6_exact_dedup}
SQL = {
    "op6_exact_dedup": r"""
WITH h AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
}
