"""Language identification: multinomial logistic regression on TF-IDF of hashed character n-grams.

Features are counts (log-damped) of 1 to 3 character grams of the lower-cased text, in 2^BITS classes, times their
inverse document frequency over all learnable documents, scaled to length 1. Weights come from follow-the-regularised-
leader with an elastic net (the L1 part leaves most of them zero) over a bounded sample (TRAIN_ROWS, by the hash of
the id); a temperature fitted on the sample's last fifth turns logits into calibrated probabilities.

Null texts and texts without a letter are `und` with score 0. A text of any length is one vector of fixed width. Of
languages that tie in probability the one that sorts first is taken. Rows whose language is null are not learned from; with
nothing to learn from, all rows are `und`. Rows repeated under one id, or without one, are predicted each; only id, text and language
are read, so further columns do no harm. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import learn_remainder, read_table, text_batches

BITS = 15
#: The most labelled documents that weights are fitted on.
TRAIN_ROWS = 5000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.001
UNKNOWN = "und"


def grams(text: str) -> np.ndarray:
    """Hash classes of all 1, 2 and 3 character grams of a text, one space at either end."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    top = np.uint32(32 - BITS)
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(0xC2B2AE35) + c[2:] * np.uint32(0x27D4EB2F)
    return np.concatenate([c * np.uint32(0x165667B1) >> top, (two ^ two >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> top, (three ^ three >> np.uint32(15)) * np.uint32(0x297A2D39) >> top])


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes that occur, and their TF-IDF at length 1."""
    n = np.bincount(grams(text), minlength=1 << BITS)
    at = np.flatnonzero(n)
    x = np.log1p(n[at]) * idf[at]
    return at, x / np.sqrt(x @ x)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # classes x languages
    bias: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        at, x = vector(text, self.idf)
        return x @ self.weights[at] + self.bias

    def probabilities(self, text: str) -> np.ndarray:
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """docs: id, text. Documents that hold each class of grams, and documents: one row a class and task is shuffled."""

    def run(batches):
        import pyarrow as pa

        df, n = np.zeros(1 << BITS, np.int64), 0
        for _, texts in text_batches(batches):
            for text in texts:
                seen = np.zeros(1 << BITS, bool)
                seen[grams(text)] = True
                df += seen
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["class", "n"])

    found = docs.mapInArrow(run, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    df = np.zeros(1 << BITS)
    known = dict(zip(found["class"], found["n"], strict=True))
    total = known.pop(-1, 0)
    df[list(known)] = list(known.values())
    return df, total


def fit(texts: list[str], languages: list[str], idf: np.ndarray) -> Model:
    """Per-coordinate follow-the-regularised-leader; the last fifth of the rows sets the temperature."""
    names = sorted(set(languages))
    k, size = len(names), 1 << BITS
    y = np.array([names.index(x) for x in languages])
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))
    cut = len(texts) - len(texts) // 5

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)

    rng = np.random.default_rng(1)
    for epoch in range(EPOCHS):
        for i in rng.permutation(cut) if epoch else range(cut):
            at, x = vector(texts[i], idf)
            at, x = np.append(at, size), np.append(x, 1.0)
            w = weights(z[at], n[at])
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(z, n)
    model = Model(names, idf, w[:-1], w[-1], 1.0)
    held = list(range(cut, len(texts)))
    if held:
        logits = np.array([model.logits(texts[i]) for i in held])

        def loss(t: float) -> float:
            s = logits / t
            return float((np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(len(held)), y[held]]).mean())

        model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """docs: rows to learn from. Document frequencies cover all of them, weights at most TRAIN_ROWS."""
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    # Rows that repeat id, text and language are one row to learn from, so the bound holds for any table.
    drawn = rows.withColumn("luck", F.xxhash64(F.col("id").cast("string"), F.lit("language"), "text", "lang"))
    chosen = drawn.select("luck").distinct().orderBy("luck").limit(TRAIN_ROWS)
    sample = drawn.join(F.broadcast(chosen), "luck").dropDuplicates(["luck"]).select("luck", "id", "text", "lang").toArrow().to_pylist()
    sample = sorted((r for r in sample if has_letter(r["text"] or "")), key=lambda r: r["luck"])
    if not sample:
        return None
    df, n = document_frequencies(rows.select("id", "text"))
    return fit([r["text"] for r in sample], [r["lang"] for r in sample], np.log((1 + n) / (1 + df)) + 1)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, lang_pred, score."""

    def run(batches):
        import pyarrow as pa

        for batch, texts in text_batches(batches):
            found = []
            for text in texts:
                if model is None or not has_letter(text):
                    found.append((UNKNOWN, 0.0))
                else:
                    p = model.probabilities(text)
                    found.append((model.languages[int(p.argmax())], float(p.max())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["id", "lang_pred", "score"])

    few = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return few.mapInArrow(run, f"id {few.schema['id'].dataType.simpleString()}, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs.where(learn_remainder("doc_id", 4) != 2))
    found = identify(docs, model)
    return found.select(F.col("id").alias("doc_id"), (learn_remainder("id", 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op9_language_id": op9_language_id}
SQL: dict[str, str] = {}
