"""Nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables, for every operator."""

import pytest

from sparkshapes.llm import chat_format, exact_dedup, fingerprints, language_id, mixing, near_dedup, sentencepiece_codec, suffix_dedup, token_counts, toxicity

LONG = "word " * 30_000 + "end"
ROWS = [
    (1, "A b c d e f g", "en", "s1"), (2, "a B c d  e f g", "en", "s1"), (3, None, None, None), (4, "", "en", None), (5, " \t\n", "fr", "s2"),
    (6, LONG, "en", "s1"), (7, LONG + " x", "en", "s2"), (8, "short", "en", "s1"), (8, "short", "en", "s1"), (9, "é😀 \x00 ▁x y", "fr", "s3"), (None, "null id", "en", "s3"), (10, "123 456", "fr", "s2"),
]
#: Columns whose names operators use themselves.
CLASHES = ("id", "row", "n", "kept", "digest", "size", "target", "score", "spans", "ids", "key", "label", "runs", "cluster", "rep")


@pytest.fixture(scope="module")
def docs(spark):
    wide = [(*r, *[f"{r[0]}"] * len(CLASHES)) for r in ROWS]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASHES))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (2, 1), (6, None), (7, 0), (None, 1)], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.default_codec()


def operators(labels, codec):
    return {
        "toxicity": lambda d: toxicity.score(d, toxicity.train(d, labels)),
        "near": near_dedup.near_dedup,
        "encode": lambda d: sentencepiece_codec.encode(d, codec),
        "tokens": lambda d: token_counts.token_counts(d, (["a", "s"], ["b", "h"])),
        "exact": exact_dedup.exact_dedup,
        "fingerprints": fingerprints.compared,
        "suffix": suffix_dedup.repeated_passages,
        "language": lambda d: language_id.identify(d, language_id.train(d)),
        "mix": mixing.mix,
    }


@pytest.mark.parametrize("name", ["toxicity", "near", "encode", "tokens", "exact", "fingerprints", "suffix", "language", "mix"])
def test_every_row_once_and_empty_tables(docs, labels, codec, name):
    op = operators(labels, codec)[name]
    found = op(docs).collect()
    assert sorted(str(r["id"]) for r in found) == sorted(str(r[0]) for r in ROWS)
    assert op(docs.limit(0)).count() == 0
    by = {r["id"]: r for r in found}
    if name == "near":
        assert [by[i]["n_shingles"] for i in (3, 4, 5, 8)] == [0, 0, 0, 1] and by[2]["component_id"] == 1 and by[7]["component_id"] == 7
        assert by[3]["kept"] and by[4]["kept"]
    if name == "encode":
        assert by[3]["ids"] is None and by[4]["ids"] == []
    if name == "tokens":
        assert (by[3]["n_words"], by[8]["n_tokens"], by[8]["n_unknown"]) == (0, 1, 1)
    if name == "exact":
        assert by[3]["keep_id"] == 3 and by[4]["keep_id"] == by[3]["keep_id"] or by[5]["keep_id"] == by[4]["keep_id"]
        assert by[8]["group_size"] == 2 and by[8]["kept"] and by[6]["kept"] and by[None]["kept"]
    if name == "fingerprints":
        assert by[6]["n_chars"] == len(LONG) and by[3]["n_chars"] == 0 and all(0 <= r["near_edited"] <= 1 for r in found)
    if name == "suffix":
        # A run of one repeated word is all repeats of itself but for its end.
        assert by[6]["n_removed"] > 149_000 and by[1]["n_removed"] == 0 and by[3]["n_bytes"] == 0
    if name == "language":
        assert by[3]["lang_pred"] == by[10]["lang_pred"] == "und" and by[9]["lang_pred"] in ("en", "fr")
    if name == "mix":
        assert by[3]["size"] == by[3]["taken"] == 0 and all(r["taken"] <= 2 * r["size"] for r in found)


def test_conversations(spark):
    rows = [(1, 0, "user", "User: hi?"), (1, 1, "assistant", "AI: yes"), (1, 2, None, None), (None, None, "user", ""), (2, 0, "system", "System: be good"), (2, 0, "system", "System: be good")]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS block", "'y' AS body", "'z' AS key", "1 AS part")
    model = chat_format.train(talk)
    found = chat_format.parse(talk, model).collect()
    assert sum(r.n_lines for r in found) == len(rows) and {str(r.conv) for r in found} == {"1", "2", "None"}
    assert {x for r in found for x in r.body.split("\n")} == {"hi?", "yes", "", "be good"}
    assert chat_format.parse(talk.limit(0), model).count() == 0 and chat_format.train(talk.limit(0)) is None


def test_turns_that_repeat(spark, monkeypatch):
    """A turn of many messages is dealt over blocks, and no message is lost."""
    monkeypatch.setattr(chat_format, "ROWS", 8)
    talk = spark.range(100).selectExpr("IF(id % 3 = 0, NULL, 5L) AS conv_id", "IF(id % 4 = 0, NULL, id % 2) AS turn", "'user: ' || id AS text")
    model = chat_format.train(talk.selectExpr("*", "'user' AS role"))
    found = chat_format.parse(talk, model).collect()
    assert sorted(r.body for r in found) == sorted(str(i) for i in range(100)) and len({r.block for r in found}) >= 8


def test_pipeline_stages_keep_columns(spark, docs, labels, monkeypatch):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    monkeypatch.setattr(p, "read_table", lambda spark, d, name: labels)
    now = docs.select("doc_id", "text", "lang", "source")
    for name, stage in p.STAGES[:-1]:
        now = p.stored(stage(spark, now, ""), name)
        assert now.columns == ["doc_id", "text", "lang", "source"]
    kept = {r.doc_id for r in now.collect()}
    assert 2 not in kept and 8 in kept
    assert p.STAGES[-1][1](spark, now, "").count() == now.count()


def test_null_conversation(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "BLOCK", 4)
    talk = spark.createDataFrame([(None, 0, "user: hi"), (1, 0, "user: hi")], "conv_id long, turn long, text string")
    model = chat_format.train(talk.selectExpr("*", "'user' AS role"))
    long_ = talk.unionByName(spark.range(1, 30).selectExpr("CAST(NULL AS long) AS conv_id", "id AS turn", "'user: ' || id AS text"))
    for d in (talk, long_):
        found = chat_format.parse(d, model)
        assert sorted((str(r.conv), r.first_turn) for r in found.collect()) == sorted((str(r.conv_id), r.turn) for r in d.collect())
