"""Cutting lineage through the shared folder, and joins that survive keys with a large share of the rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A heavy key holds at least 1/HEAVY of all rows, so there are at most HEAVY heavy keys.
HEAVY = 1000
_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor reaches: spark.checkpoint.dir, or where it is unset and all runs in one process (tests) an
    own one."""
    global _own_dir
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="sparkshapes-")
    return _own_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and rereads it: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files behind a stored() table that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file.rpartition("/")[0])
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def with_groups(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of rows with one row a key, safe for keys that hold a large share of the rows. Null keys meet nothing.

    Keys with at least 1/HEAVY of the rows number at most HEAVY, which bounds what is broadcast; the others go
    through a sort-merge join in which no key exceeds 1/HEAVY of the rows. groups.count is the rows of a key in rows.
    """
    limit = max(2, -(-total // HEAVY))
    heavy = groups.where(F.col(count) >= limit)
    light = groups.where(F.col(count) < limit)
    marked = rows.join(F.broadcast(heavy.withColumn("_heavy", F.lit(True))), key, "left")
    done = marked.where(F.col("_heavy")).drop("_heavy")
    others = marked.where(F.col("_heavy").isNull()).select(*rows.columns).join(light.hint("merge"), key)
    return done.unionByName(others.select(*done.columns))
