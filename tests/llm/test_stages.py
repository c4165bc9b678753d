"""Pipeline stages on rows whose ids are null or used again."""

from pyspark.sql import functions as F

from sparkshapes.llm import exact_dedup, mixing, near_dedup, toxicity


def test_rows_without_an_id_of_their_own(spark):
    words = [f"w{i}" for i in range(60)]
    clean = [" ".join(words[i : i + 20]) + f" end{i}" for i in range(0, 40, 20)]
    rows = [(None, clean[0]), (None, clean[1]), (None, clean[1]), (7, clean[0] + " seven"), (7, "an other text under seven, long enough to be one"), (None, clean[1].replace(" ", "  "))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = lambda d: sorted(r.text for r in d.collect())
    assert texts(exact_dedup.drop_copies(docs)) == sorted([rows[0][1], rows[3][1], rows[4][1], rows[5][1]])
    near = texts(near_dedup.keep_one(docs))
    assert rows[0][1] in near and rows[4][1] in near and rows[3][1] not in near
    assert len({x.replace("  ", " ") for x in near} & {clean[1]}) == 1


def test_a_toxic_row_takes_no_other_along(spark, monkeypatch):
    docs = spark.createDataFrame([(None, "foul"), (None, "fine"), (3, "foul"), (3, "good")], "doc_id long, text string")
    monkeypatch.setattr(toxicity, "train", lambda *a, **k: None)
    monkeypatch.setattr(toxicity, "score", lambda d, m, id_col="doc_id", text_col="text": d.select(F.col(id_col).alias("id"), (F.col(text_col) == "foul").cast("double").alias("score")))
    assert sorted(r.text for r in toxicity.drop_toxic(docs, docs).collect()) == ["fine", "good"]


def test_stages_keep_columns_of_any_name(spark, monkeypatch):
    names = ("_row", "_rows", "_times", "_copy", "_key", "_bad", "_gone", "_stays", "_id", "_luck", "id", "n", "kept", "score")
    rows = [(i, f"word{i} and others that make a text of {i} words", "en", "s") for i in range(12)]
    docs = spark.createDataFrame([(*r, *[f"{c}{r[0]}" for c in names]) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in names))
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    for stage in (lambda d: toxicity.drop_toxic(d, labels), exact_dedup.drop_copies, near_dedup.keep_one, mixing.mixed):
        found = stage(docs)
        assert found.columns == docs.columns
        got = found.collect()
        assert got and all(r[c] == f"{c}{r.doc_id}" for r in got for c in names)


def test_training_gives_the_drivers_memory_back(spark):
    """What a fit has freed does not stay with the driver's process for the stages after it."""
    import psutil

    from sparkshapes.llm.common import read_table

    own, sf_dir = psutil.Process(), "/root/testdata/sf0.1"
    toxicity.released()
    before = own.memory_info().rss
    toxicity.train(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    assert own.memory_info().rss - before < 60_000_000


def test_a_chain_of_near_copies_takes_few_jobs(spark):
    """What the driver keeps of each job adds up over the stages: a chain of links, each row near its neighbours only, takes
    no rounds of jobs."""
    words = [f"w{i}" for i in range(900)]
    docs = spark.createDataFrame([(k, " ".join(words[8 * k : 8 * k + 100])) for k in range(100)], "doc_id long, text string")
    spark.sparkContext.setJobGroup("chain", "near copies")
    try:
        assert [r.doc_id for r in near_dedup.keep_one(docs).collect()] == [0]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("chain")
    assert len(jobs) <= 100
