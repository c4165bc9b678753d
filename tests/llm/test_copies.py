"""The words that the mixing stage emits against those the mix takes."""

from pyspark.sql import functions as F

from sparkshapes.llm import mixing

SF = "/root/testdata/sf0.01"


def test_copies_meet_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 97 <> 0")
    docs = docs.unionByName(docs.limit(0)).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    took = mixing.mix(docs).groupBy("source").agg(F.max("target").alias("target"), F.max("source_size").alias("whole"), F.max("size").alias("largest"), F.sum("taken").alias("taken"))
    words = F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))
    emitted = {r.source: r.words for r in mixing.mixed(docs).groupBy("source").agg(words.alias("words")).collect()}
    for r in took.collect():
        assert abs(emitted[r.source] - r.taken) <= r.largest + 0.02 * r.target
    again = mixing.mixed(docs).groupBy("doc_id").count()
    assert again.exceptAll(mixing.mixed(docs).groupBy("doc_id").count()).isEmpty() and again.where("count > 2").isEmpty()


def test_copies_of_a_line(spark):
    rows = [(bytes([i]), "=a", 65, 100) for i in range(100)] + [(bytes([100 + i]), "=b", 3 * i // 2, i) for i in range(1, 100)]
    times = {r._row: r._times for r in mixing.whole_copies(spark.createDataFrame(rows, "_row binary, _key string, _taken long, _size long"), "s").collect()}
    for key in ("=a", "=b"):
        own = [(times[bytes(r)], t, n) for r, k, t, n in rows if k == key]
        assert all(x in (t // n, t // n + 1) for x, t, n in own) and abs(sum(x * n - t for x, t, n in own)) <= max(n for *_, n in own)
