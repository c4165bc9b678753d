"""Toxic spans by a linear-chain conditional random field over words, and document scores from its marginals.

Two labels, clean and toxic. A word's emission is a sum of hashed features of the word and its neighbours; label
transitions are learned with it. Training labels for words come from labelled documents: in toxic documents the words
(or 4 to 6 letter beginnings) that toxic documents hold far more often than clean ones. Training rows are bounded
(TRAIN_TOXIC, TRAIN_CLEAN) and the number of gradient steps is fixed; scoring covers every whole text and runs
forward-backward over blocks of words side by side, joined by the blocks' transfer matrices. A document's score is a
logistic function of its marginals.

Null and empty texts, and texts without words, have no spans and the score of no evidence. A text of any length is cut
into blocks of words, and its marginals do not depend on where. Rows repeated under one id are scored each, equal texts
alike; a null id is scored like any other and never learned from. Labels that are null are not learned from; without
both kinds of labels no word is toxic. Of training rows that tie in the hash the smaller id is taken first. Only the id
and text are read, so further columns do no harm. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, learn_remainder, read_table, released, row_key, stored, text_batches, text_of

#: The most labelled documents of each kind that the model is fitted on, chosen by the hash of the id.
TRAIN_TOXIC, TRAIN_CLEAN = 2000, 3000
BITS = 18
#: Words of a block in the side-by-side recursion.
BLOCK = 256
#: Passes over the training words, and gradient steps of a pass, whatever the number of words.
EPOCHS, STEPS = 3, 16
#: A feature marks toxic words when toxic and clean documents differ in it by this log-likelihood ratio at least.
SURE = 26.0
#: Marks that do not belong to a word at its ends.
EDGES = " .,;:!?'\"`()[]{}<>*#$%&@^~_+=|/\\-\u2013\u2014\u2018\u2019\u201c\u201d\u2026\u00ab\u00bb\u00bf\u00a1\u3002\uff0c\u3001"
#: Distinct words whose features a task keeps over its batches.
KEPT_WORDS = 400_000


class Words(dict):
    """A number for each distinct word, in order of appearance; `new` has those that nobody has asked about yet."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        found = self[word] = len(self)
        self.new.append(word)
        return found

    def ids(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features of each word, five a word; a 32-bit hash of the word as it stands between spaces).

    The features are the lower-cased word without its outer marks, its beginnings of 4, 5 and 6 letters, and its length.
    """
    cores = [w.strip(EDGES) for w in "\n".join(words).lower().split("\n")]
    if len(cores) != len(words):  # one of the words is empty or has a line end
        cores = [w.lower().strip(EDGES) for w in words]
    out = np.zeros((len(words), 5), np.uint32)
    out[:, 0] = np.fromiter((zlib.crc32(c.encode("utf-8", "replace")) for c in cores), np.uint32, len(words))
    code = np.array(cores, "U6").view(np.uint32).reshape(len(words), 6) if words else np.zeros((0, 6), np.uint32)
    mixed = np.zeros(len(words), np.uint32)
    for i in range(6):
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + code[:, i]
        if i >= 3:
            out[:, i - 2] = (mixed ^ (mixed >> np.uint32(13))) * np.uint32(0x9E3779B1) + np.uint32(i)
    out[:, 4] = np.minimum(np.fromiter(map(len, cores), np.uint32, len(words)), 8) * np.uint32(0x85EBCA6B) + np.uint32(77)
    whole = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in words), np.uint32, len(words))
    return ((out ^ (out >> np.uint32(16))) & np.uint32((1 << BITS) - 1)).astype(np.int32), whole


@dataclass
class Model:
    emission: np.ndarray  # toxic minus clean, of a hashed feature
    before: np.ndarray  # the same from the word before
    after: np.ndarray
    transition: np.ndarray  # 2x2 log potentials
    score: tuple[float, float, float]  # weights of the largest marginal's logit and of the expected toxic words, offset

    def marginals(self, own: np.ndarray, left: np.ndarray, right: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """P(toxic) of each word. starts: where documents begin in the stream of words."""
        first = np.zeros(len(own), bool)
        first[starts] = True
        return forward_backward(joined(own, left, right, first), self.transition, first, False)[0]


def joined(own: np.ndarray, left: np.ndarray, right: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Emissions with what each word's neighbours in its document add: left is what a word adds to the next one."""
    emit = own.copy()
    emit[1:] += np.where(first[1:], 0, left[:-1])
    emit[:-1] += np.where(first[1:], 0, right[1:])
    return emit


def forward_backward(emit: np.ndarray, transition: np.ndarray, first: np.ndarray, with_pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(P(toxic) of each word, sums of the pair marginals as 2x2) for a stream of documents.

    Messages are ratios toxic : clean, so a word is a fractional linear map of the message before it, and a column of
    BLOCK words is the product of its words' 2x2 matrices. All columns' products advance together; columns are joined in
    order, forwards by the products and backwards by their transposes, and the recursion runs again from each column's
    true beginning and end. Between documents all transitions weigh the same, which lets no message through.
    """
    n = len(emit)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    cols = -(-n // BLOCK)
    (t00, t01), (t10, t11) = np.exp(transition)
    odds = np.ones(cols * BLOCK)
    odds[:n] = np.exp(np.clip(emit, -30, 30))
    fresh = np.zeros(cols * BLOCK, bool)
    fresh[:n], fresh[n:] = first, True
    odds, fresh = odds.reshape(cols, BLOCK).T.copy(), fresh.reshape(cols, BLOCK).T
    reset = [np.flatnonzero(x) for x in fresh]
    a, b, c, d = np.ones(cols), np.zeros(cols), np.zeros(cols), np.ones(cols)
    for t in range(BLOCK):
        o, cut = odds[t], reset[t]
        sums = (a[cut] + c[cut], b[cut] + d[cut]) if len(cut) else None
        a, c = o * (t11 * a + t01 * c), t10 * a + t00 * c
        b, d = o * (t11 * b + t01 * d), t10 * b + t00 * d
        if sums:
            c[cut], d[cut] = sums
            a[cut], b[cut] = o[cut] * sums[0], o[cut] * sums[1]
        if t % 8 == 7:
            scale = 1 / (a + b + c + d)
            a, b, c, d = a * scale, b * scale, c * scale, d * scale
    begin, end = np.empty(cols), np.empty(cols)
    maps = list(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True))
    now = 1.0
    for k, (p, q, r, s) in enumerate(maps):
        begin[k] = now
        now = (p * now + q) / (r * now + s)
    now = 1.0
    for k in range(cols - 1, -1, -1):
        p, q, r, s = maps[k]
        end[k] = now
        now = (p * now + r) / (q * now + s)
    ahead, behind = np.empty((BLOCK, cols)), np.empty((BLOCK, cols))
    now = begin
    for t in range(BLOCK):
        now = odds[t] * (t01 + t11 * now) / (t00 + t10 * now)
        if len(reset[t]):
            now[reset[t]] = odds[t][reset[t]]
        ahead[t] = now
    now = end
    for t in range(BLOCK - 1, -1, -1):
        behind[t] = now
        now = odds[t] * now
        now = (t10 + t11 * now) / (t00 + t01 * now)
        if len(reset[t]):
            now[reset[t]] = 1.0
    both = ahead * behind
    marginal = (both / (1 + both)).T.reshape(-1)[:n]
    pairs = np.zeros((2, 2))
    if with_pairs:
        inner = np.flatnonzero(~first[1:])
        f, g = ahead.T.reshape(-1)[inner], (odds * behind).T.reshape(-1)[inner + 1]
        z = t00 + t01 * g + t10 * f + t11 * f * g
        pairs[:] = [[(t00 / z).sum(), (t01 * g / z).sum()], [(t10 * f / z).sum(), (t11 * f * g / z).sum()]]
    return marginal, pairs


def sketch(hashes: np.ndarray, many: int = 8) -> list[tuple[int, int]]:
    """The smallest of many hashes each over a text's pairs of adjacent words; copies, near ones too, share some."""
    h = hashes.astype(np.uint64)
    pairs = h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:] * np.uint64(0x165667B19E3779F9) if len(h) > 1 else np.zeros(1, np.uint64)
    turn = np.arange(1, 2 * many, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return [(i, int(((pairs * x) >> np.uint64(20)).min())) for i, x in enumerate(turn)]


def marks_of(parts: list[np.ndarray], toxic: list[int], feats: np.ndarray, whole: np.ndarray) -> set[int]:
    """Hashed features that mark toxic words. Of near copies one counts: a copied text's words are no evidence twice."""
    size = 1 << BITS
    df, n = [np.zeros(size), np.zeros(size)], [0, 0]
    known: tuple[set, set] = (set(), set())
    for at, y in zip(parts, toxic, strict=True):
        own = sketch(whole[at])
        if not known[y].isdisjoint(own):
            continue
        known[y].update(own)
        df[y][np.unique(feats[np.unique(at), :4])] += 1
        n[y] += 1
    if not n[0] or not n[1]:
        return set()
    both = df[0] + df[1]
    expected = both * n[1] / (n[0] + n[1])
    gain = 2 * (df[1] * np.log(np.maximum(df[1], 1e-9) / np.maximum(expected, 1e-9)) + df[0] * np.log(np.maximum(df[0], 1e-9) / np.maximum(both - expected, 1e-9)))
    return set(np.flatnonzero((df[1] > expected) & (gain >= SURE) & (df[0] * n[1] <= 0.05 * df[1] * n[0])).tolist())


def fit(texts: list[str], toxic: list[int]) -> Model:
    """L2-regularised maximum likelihood by adaptive gradient steps. texts is emptied: word numbers take their place."""
    size = 1 << BITS
    table, parts = Words(), []
    for i, text in enumerate(texts):
        parts.append(table.ids(text.split()))
        texts[i] = ""
    feats, whole = features(table.new)
    del table
    marks = marks_of(parts, toxic, feats, whole)
    marked = np.isin(feats[:, :4], np.fromiter(marks, np.int32, len(marks))).any(1)
    at = np.concatenate([*parts, np.zeros(0, np.int32)])
    bounds = np.cumsum([0, *map(len, parts)])
    starts = bounds[:-1][np.diff(bounds) > 0]
    first = np.zeros(len(at), bool)
    first[starts] = True
    truth_of = np.repeat(np.array(toxic, bool), np.diff(bounds)) & marked[at]
    params = [np.zeros(size) for _ in range(3)]
    params[0] -= 0.5
    trans = np.zeros((2, 2))
    gone = [np.full(size, 1e-8) for _ in range(3)]
    gone_t = np.full((2, 2), 1e-8)
    model = Model(*params, trans, (1.0, 0.0, -1.0))
    # A step takes whole documents, a STEPS-th of the words or one document more.
    cuts = np.unique(np.append(bounds[np.searchsorted(bounds, np.arange(0, len(at), max(1, -(-len(at) // STEPS))))], len(at)))
    order = np.random.default_rng(1)
    for _ in range(EPOCHS if marks else 0):
        for b in order.permutation(len(cuts) - 1):
            some = slice(cuts[b], cuts[b + 1])
            begin, truth = first[some], truth_of[some].astype(float)
            used, where = np.unique(at[some], return_inverse=True)
            own, left, right = (p[feats[used]].sum(1)[where] for p in params)
            p, pairs = forward_backward(joined(own, left, right, begin), trans, begin)
            slope = truth - p
            inner = ~begin[1:]
            for k, g in enumerate((slope, np.append(np.where(inner, slope[1:], 0), 0), np.insert(np.where(inner, slope[:-1], 0), 0, 0))):
                per_word = np.bincount(where, g, len(used))
                grad = np.bincount(feats[used].ravel(), np.repeat(per_word, feats.shape[1]), size) - 0.002 * params[k]
                gone[k] += grad**2
                params[k] += (0.8 if k == 0 else 0.2) * grad / np.sqrt(gone[k])
            yi = truth.astype(int)
            true_pairs = np.bincount(2 * yi[:-1][inner] + yi[1:][inner], minlength=4).reshape(2, 2)
            grad_t = true_pairs - pairs - 0.002 * trans
            gone_t += grad_t**2
            trans += 0.3 * grad_t / np.sqrt(gone_t)
    if marks:
        # By steps again: all words at once would take far more memory.
        weights = [p[feats].sum(1) for p in params]
        found = [model.marginals(*(w[at[a:b]] for w in weights), starts[(starts >= a) & (starts < b)] - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        model.score = logistic(evidence(np.concatenate(found), bounds), np.array(toxic, float))
    return model


def evidence(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per document: the logit of the largest marginal, and the log of the expected number of likely toxic words."""
    out = np.zeros((len(bounds) - 1, 2))
    out[:, 0] = -12.0
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        most = np.clip(np.maximum.reduceat(p, bounds[:-1][full]), 6e-6, 1 - 6e-6)
        out[full, 0] = np.log(most / (1 - most))
        out[full, 1] = np.log1p(np.add.reduceat(np.where(p >= 0.5, p, 0), bounds[:-1][full]))
    return out


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Newton's method with a ridge; class weights make both classes weigh the same."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(3)
    balance = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (balance * p * (1 - p))[:, None]).T @ a + np.diag([1e-2 * len(y) ** 0.5] * 2 + [1e-3])
        w += np.linalg.solve(h, a.T @ (balance * (y - p)) - np.array([1e-2 * len(y) ** 0.5] * 2 + [1e-3]) * w)
    return tuple(float(v) for v in w)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """At most TRAIN_TOXIC and TRAIN_CLEAN labelled rows to learn from, by the hash of the id and then of the text."""
    known = labels.where(F.col(label_col).isin(0, 1) & (learn_remainder(id_col, 5) != 0)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic"))
    luck = F.xxhash64(F.col("_id").cast("string"), F.lit("toxicity"))
    most = lambda rows, y, n, *then: rows.where(F.col("toxic") == y).orderBy(luck, "_id", *then).limit(n)
    both = lambda rows, *then: most(rows, 1, TRAIN_TOXIC, *then).unionByName(most(rows, 0, TRAIN_CLEAN, *then))
    chosen = both(known.distinct())
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id").select("_id", "text", "toxic")
    # An id may have many rows; the bound holds for rows.
    return both(stored(found, "training-rows"), F.xxhash64("text"), F.col("text"))


def train(docs: DataFrame, labels: DataFrame, **columns: str) -> Model:
    rows = training_rows(docs, labels, **columns).toArrow()
    order = sorted(zip(rows.column("_id").to_pylist(), rows.column("text").to_pylist(), rows.column("toxic").to_pylist(), strict=True), key=lambda r: (r[0], r[1] or "", r[2]))
    del rows
    texts, toxic = [r[1] or "" for r in order], [r[2] for r in order]
    del order
    model = fit(texts, toxic)
    del texts
    released()  # the driver goes on to other stages
    return model


SPAN = "array<struct<start:int,end:int,probability:double>>"


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, score, n_words, spans (code points of words that are rather toxic than not)."""

    def run(batches):
        import pyarrow as pa

        params = np.stack([model.emission, model.before, model.after], 1)
        table, weights = Words(), np.zeros((0, 3))
        for batch, texts in text_batches(batches):
            split = [text.split() for text in texts]
            bounds = np.cumsum([0, *map(len, split)])
            at = table.ids([w for words in split for w in words])
            del split
            if table.new:
                weights = np.concatenate([weights, params[features(table.new)[0]].sum(1)])
                table.new.clear()
            own, left, right = weights[at].T
            starts = bounds[:-1][np.diff(bounds) > 0]
            p = model.marginals(np.ascontiguousarray(own), left, right, starts)
            found = evidence(p, bounds)
            z = found @ np.array(model.score[:2]) + model.score[2]
            scores = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            spans: list[list[dict]] = [[] for _ in texts]
            hits = np.flatnonzero(p >= 0.5)
            for d in np.unique(np.searchsorted(bounds, hits, side="right") - 1).tolist():
                part = p[bounds[d] : bounds[d + 1]]
                spans[d] = [{"start": m.start(), "end": m.end(), "probability": float(q)} for m, q in zip(re.finditer(r"\S+", texts[d]), part.tolist(), strict=True) if q >= 0.5]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array(np.diff(bounds).astype(np.int32)), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])))],
                ["id", "score", "n_words", "spans"],
            )
            if len(table) > KEPT_WORDS:
                table, weights = Words(), np.zeros((0, 3))

    few = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return few.mapInArrow(run, f"id {few.schema['id'].dataType.simpleString()}, score double, n_words int, spans {SPAN}")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = score(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return found.select(
        F.col("id").alias("doc_id"), (learn_remainder("id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_words", F.size("spans").alias("n_spans"),
        F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))).alias("offsets"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without the rows whose score reaches threshold; rows that share an id, or have none, count by their texts."""
    row = free_name(docs, "_row")
    keyed = docs.withColumn(row, row_key(docs, "doc_id", text_of("text")))
    bad = score(keyed, train(docs, labels), id_col=row).where(F.col("score") >= threshold).select(F.col("id").alias(row))
    return keyed.join(bad, row, "left_anti").drop(row)


QUERIES = {"op1_toxicity": op1_toxicity}
SQL: dict[str, str] = {}
