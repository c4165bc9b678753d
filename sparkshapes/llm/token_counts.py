"""Word-piece token counts by a longest-match automaton that runs once over each word.

The vocabulary's trie has the pieces that begin words below one root and those that continue words below another.
Each node has a failure link and the number of pieces popped on taking it, both computed once, breadth first; a
word's greedy longest-match-first length is then the sum of the popped counts over one pass, without the pieces.
A word that the vocabulary cannot spell counts as one unknown token. Words are maximal runs of other characters than
\\x20 and \\x09 to \\x0D.

Null and empty texts have 0 words and tokens. A text of any length is one pass over its words, a word one over its
characters. Greedy matching leaves no ties. Rows repeated under one id, or without one, are counted each, only id and
text are read, and an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordTable, read_table, text_batches

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
MARK = "▁"


class Automaton:
    """goto, failure links and popped counts as lists over nodes; node 0 begins words, node 1 continues them."""

    def __init__(self, begins: Iterable[str], continues: Iterable[str]):
        self.goto: list[dict[str, int]] = [{}, {}]
        whole = [False, False]
        for root, pieces in ((0, begins), (1, continues)):
            for piece in pieces:
                node = root
                for c in piece:
                    to = self.goto[node].get(c)
                    if to is None:
                        to = self.goto[node][c] = len(whole)
                        self.goto.append({})
                        whole.append(False)
                    node = to
                whole[node] |= node > 1
        self.link, self.popped = [-1] * len(whole), [0] * len(whole)
        queue = [0, 1]
        for node in queue:
            for c, to in self.goto[node].items():
                if whole[to]:
                    self.link[to], self.popped[to] = 1, 1
                else:
                    at, n = self.link[node], self.popped[node]
                    while at >= 0 and c not in self.goto[at]:
                        n += self.popped[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[to], self.popped[to] = self.goto[at][c], n
                queue.append(to)

    def count(self, word: str) -> int:
        """Pieces of a word, 0 if it cannot be spelled."""
        goto, link, popped = self.goto, self.link, self.popped
        node, n = 0, 0
        for c in word:
            while (to := goto[node].get(c)) is None:
                n += popped[node]
                node = link[node]
                if node < 0:
                    return 0
            node = to
        while node > 1:
            n += popped[node]
            node = link[node]
        return n if node == 1 else 0


def vocabulary(path: str) -> tuple[list[str], list[str]]:
    """(pieces that begin words, pieces that continue them) of a SentencePiece model file, whose word mark tells."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [p[1:] for p in plain if p[0] == MARK and p[1:] and MARK not in p[1:]], [p for p in plain if MARK not in p]


def token_counts(docs: DataFrame, vocabulary: tuple[list[str], list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, n_words, n_tokens, n_unknown."""

    def run(batches):
        import pyarrow as pa

        table = WordTable(Automaton(*vocabulary).count)
        for batch, texts in text_batches(batches):
            found = np.zeros((3, len(texts)), np.int64)
            for i, text in enumerate(texts):
                n = np.fromiter(map(table.__getitem__, WORDS.findall(text)), np.int64)
                unknown = int((n == 0).sum())
                found[:, i] = len(n), n.sum() + unknown, unknown
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found)], ["id", "n_words", "n_tokens", "n_unknown"])
            table.trim()

    few = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return few.mapInArrow(run, f"id {few.schema['id'].dataType.simpleString()}, n_words long, n_tokens long, n_unknown long")


def op5_token_counts(spark: SparkSession, sf_dir: str, model_file: str | None = None) -> DataFrame:
    import public_tokenizers

    pieces = vocabulary(model_file or public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts(read_table(spark, sf_dir, "documents"), pieces).withColumnRenamed("id", "doc_id")


QUERIES = {"op5_token_counts": op5_token_counts}
SQL: dict[str, str] = {}
