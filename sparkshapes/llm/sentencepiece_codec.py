"""SentencePiece encoding and decoding by a shared-prefix Viterbi over distinct words.

Spaces become the mark, with one mark in front of a text, and pieces never reach over the border from another
character to a mark, so a text's encoding is its marked words' encodings in a row; a word falls into parts between
neighbours that no piece has. A batch's distinct parts are sorted, which lays them out as a trie in depth-first order: a
part keeps the forward states of the prefix it shares with the part before it and only the rest is computed.

The forward state of a prefix is the score and the last piece of its best path. Kind "unigram": the best path has the
largest sum of the model's piece scores, of equal sums the one with the longest last piece. Kind "bpe", for models
trained by merging: two pieces may follow each other only if merging their characters leaves the two as they are;
exactly one path of each prefix meets that for every neighbouring pair, and it is the merge result, so the ids are those
of the SentencePiece library. Words that begin with several marks, whose pieces tie in score, go through the merges
themselves. Characters without a piece become their UTF-8 bytes. round_trip gives both kinds' ids side by side.

Null texts encode as null, empty ones as no ids; null ids decode as null, and a null's round trip is all null. Texts with
the mark itself decode with spaces in its place, as the format has no other way to write them. A text of any length is
one row of ids; a word of n characters takes n times the longest piece's steps. Rows repeated under one id, or without
one, are encoded each, only id and text are read, and an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
from array import array
from os.path import commonprefix

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, text_batches

MARK = "▁"
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
KINDS = ("unigram", "bpe")
#: Words whose encodings a task keeps over its batches.
KEPT_WORDS = 500_000
#: Score of an unknown character on a unigram path, below the lowest piece.
UNKNOWN_BELOW = 10.0


class Codec:
    """Pieces, scores and byte ids of a model file; kind is "bpe" or "unigram", the paths that encode() takes."""

    def __init__(self, path: str, kind: str = "bpe"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.kind, self.unknown = kind, model.unk_id()
        self.ids: dict[str, int] = {}
        self.byte_ids, self.scores = [-1] * 256, [0.0] * size
        self.surface: list[bytes] = [b""] * size
        for i in range(size):
            piece, self.scores[i] = model.id_to_piece(i), model.get_score(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.surface[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece], self.surface[i] = i, piece.replace(MARK, " ").encode()
        # A trie of the reversed pieces finds the pieces that end at a place: character -> [children, (score, id) or None].
        self.ends: dict[str, list] = {}
        for piece, i in self.ids.items():
            node, entry = self.ends, None
            for c in reversed(piece):
                entry = node.setdefault(c, [{}, None])
                node = entry[0]
            if entry:
                entry[1] = (self.scores[i], i)
        self.text = {i: piece for piece, i in self.ids.items()}
        # No piece reaches over two characters that are neighbours in none: words fall into parts there.
        self.inner = {piece[i : i + 2] for piece in self.ids for i in range(len(piece) - 1)}
        self.lowest = min(self.scores, default=0.0) - UNKNOWN_BELOW
        # No piece reaches over a line end, so words are cut there: far fewer are distinct then.
        self.cuts_lines = not any("\n" in piece for piece in self.ids)
        sizes = np.array([len(x) for x in self.surface], np.int64)
        self.bytes_of = (np.frombuffer(b"".join(self.surface), np.uint8), np.cumsum(sizes) - sizes, sizes)
        self.pairs: dict[int, bool] = {}
        self.edge: dict[int, tuple | None] = {}
        self.near: tuple | None = None  # made by parts_of

    def merged(self, word: str) -> list[str]:
        """The pieces that merging leaves: best score first, then leftmost."""
        ids, scores = self.ids, self.scores
        part, left, right = list(word), list(range(-1, len(word) - 1)), list(range(1, len(word) + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and right[i] < len(part) and (k := ids.get(both := part[i] + part[right[i]])) is not None:
                heapq.heappush(heap, (-scores[k], i, both))

        for i in range(len(part) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if not part[i] or right[i] >= len(part) or part[i] + part[right[i]] != both:
                continue
            j = right[i]
            part[i], part[j], right[i] = both, "", right[j]
            if right[i] < len(part):
                left[right[i]] = i
            offer(left[i])
            offer(i)
        return [p for p in part if p]

    def edges(self, i: int) -> tuple[list[tuple[str, float]], list[tuple[str, float]]] | None:
        """What stands first and last in a piece while its characters merge, each with the score of the merge that takes it.

        None if merging does not lead to the piece, or takes a merge of no lower score than one before it on the way there.
        """
        if i in self.edge:
            return self.edge[i]
        part, scores, left, right, found = list(self.text[i]), [float("inf")] * len(self.text[i]), [], [], None
        while len(part) > 1:
            offers = [(-self.scores[k], n) for n, pair in enumerate(map(str.__add__, part, part[1:])) if (k := self.ids.get(pair)) is not None]
            if not offers:
                break
            cost, n = min(offers)
            if -cost >= min(scores[n], scores[n + 1]):
                break
            if n == 0:
                left.append((part[0], -cost))
            if n == len(part) - 2:
                right.append((part[-1], -cost))
            part[n : n + 2], scores[n : n + 2] = [part[n] + part[n + 1]], [-cost]
        if len(part) == 1:
            last = (part[0], -float("inf"))
            found = [*left, last], [*right, last]
        self.edge[i] = found
        return found

    def follows(self, a: int, b: int) -> bool:
        """Whether piece b may stand right after piece a (-1: a character without one): merging both's characters leaves
        a and b. It does unless what stands last in a meets what stands first in b in a merge that comes before those that
        take either away; at equal scores the left one comes first."""
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        before = [self.text[a]] if a >= 0 else []
        if a >= 0 and (x := self.edges(a)) and (y := self.edges(b)):
            ids, scores, found = self.ids, self.scores, True
            for last, gone in x[1]:
                for first, taken in y[0]:
                    if (k := ids.get(last + first)) is not None and scores[k] > gone and scores[k] >= taken:
                        found = False
        else:
            found = self.merged("".join(before) + self.text[b]) == [*before, self.text[b]]
        self.pairs[(a + 1) * len(self.scores) + b] = found
        return found

    def spell(self, pieces: list[str]) -> bytes:
        out = array("i")
        for p in pieces:
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            else:
                out.extend(self.byte_ids[b] if self.byte_ids[b] >= 0 else self.unknown for b in p.encode("utf-8", "replace"))
        return out.tobytes()

    def encode_words(self, words: list[str], kinds: tuple[str, ...] = ()) -> list[list[bytes]]:
        """Ids of sorted distinct words, for each kind. One walk back from each end finds the pieces that end there.

        best[i], last[i], ids[i]: score, last piece's length and id of the best path over i characters (id -1: no piece);
        took[i], took_ids[i]: last piece of the merge result's.
        """
        kinds = kinds or (self.kind,)
        by_score, by_merge = "unigram" in kinds, "bpe" in kinds
        scored: list[bytes] = []
        merged: list[bytes] = []
        ends, follows, pairs, size, lowest, before = self.ends, self.follows, self.pairs, len(self.scores), self.lowest, ""
        best, last, ids, took, took_ids = [0.0], [0], [-1], [0], [-1]
        states = (best, last, ids, took, took_ids)
        for word in words:
            shared = len(commonprefix((before, word)))
            for state in states:
                del state[shared + 1 :]
            tied = by_merge and word.startswith(MARK * 2)
            for end in range(shared + 1, len(word) + 1):
                node, start, fits = ends, end - 1, []
                value, length, found = best[start] + lowest, 1, -1
                while start >= 0 and (entry := node.get(word[start])) is not None:
                    node, piece = entry
                    if piece is not None:
                        total = best[start] + piece[0]
                        if total >= value or found < 0:
                            value, length, found = total, end - start, piece[1]
                        fits.append((start, piece[1]))
                    start -= 1
                best.append(value)
                last.append(length)
                ids.append(found)
                if by_merge:
                    length, found = 1, -1
                    if not tied:
                        for start, i in reversed(fits):
                            if start == 0:
                                ok = True
                            elif (ok := pairs.get((took_ids[start] + 1) * size + i)) is None:
                                ok = follows(took_ids[start], i)
                            if ok:
                                length, found = end - start, i
                                break
                    took.append(length)
                    took_ids.append(found)
            before = "" if tied else word
            if by_score:
                scored.append(self.spelt(word, last, ids))
            if by_merge:
                merged.append(self.spell(self.merged(word)) if tied else self.spelt(word, took, took_ids))
        return [scored if kind == "unigram" else merged for kind in kinds]

    def spelt(self, word: str, last: list[int], ids: list[int]) -> bytes:
        """The ids of a path, from its end to its beginning; a character without a piece becomes its bytes."""
        end, out = len(word), []
        while end:
            if (i := ids[end]) >= 0:
                out.append(i)
            else:
                out.extend(self.byte_ids[b] if self.byte_ids[b] >= 0 else self.unknown for b in reversed(word[end - 1].encode("utf-8", "replace")))
            end -= last[end]
        out.reverse()
        return array("i", out).tobytes()

    def words_of(self, text: str) -> list[str]:
        """Keys of a text's words, which in a row spell it: a word without its mark, or a line end and what follows it."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        words = (text.replace("\n", " \n") if self.cuts_lines else text).split(" ")
        if "" not in words and not words[0].startswith("\n"):
            return words
        marked = WORDS.findall(MARK + text.replace(" ", MARK))
        if not self.cuts_lines:
            return [w[1:] for w in marked]
        return [k for w in marked for i, k in enumerate(w[1:].split("\n")) for k in ([k] if i == 0 else ["\n" + k])]

    def parts_of(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """(the parts of all words in a row, cut between neighbours that no piece has; where each word's begin and one more)."""
        if self.near is None:
            chars = sorted({c for pair in self.inner for c in pair})
            number = np.zeros(0x110000, np.int32)  # 0: a character of no pair
            number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
            near = np.zeros((len(chars) + 1) ** 2, bool)
            pairs = np.array([[ord(a), ord(b)] for a, b in self.inner], np.int64).reshape(-1, 2)
            near[number[pairs[:, 0]].astype(np.int64) * (len(chars) + 1) + number[pairs[:, 1]]] = True
            self.near = number, near, len(chars) + 1
        number, near, size = self.near
        text = "".join(words)
        at = number[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int64)
        begins = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        cut = np.append(np.insert(~near[at[:-1] * size + at[1:]], 0, True), True) if len(at) else np.ones(1, bool)
        cut[begins] = True
        cuts = np.flatnonzero(cut)
        bounds = cuts.tolist()
        return [text[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], np.searchsorted(cuts, np.insert(begins, 0, 0))

    def encode(self, texts: list[str], known: tuple[dict[str, bytes], ...], kinds: tuple[str, ...] = ()) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each kind (ids of all texts in a row, where each text's ids end). known: for each kind a dictionary of the
        encodings of words and one of their parts', which this adds to."""
        kinds = kinds or (self.kind,)
        split = [self.words_of(t) for t in texts]
        words, parts = known[: len(kinds)], known[len(kinds) :]
        for some in (words, parts):
            if len(some[0]) > KEPT_WORDS:
                for table in some:
                    table.clear()
        new = list(set().union(*split) - words[0].keys())
        cut, begins = self.parts_of([k if self.cuts_lines and k.startswith("\n") else MARK + k for k in new])
        order = sorted(set(cut) - parts[0].keys())
        out = []
        for table, pieces, found in zip(words, parts, self.encode_words(order, kinds), strict=True):
            pieces.update(zip(order, found, strict=True))
            spelt = list(map(pieces.__getitem__, cut))
            blob, at = b"".join(spelt), np.insert(np.cumsum(np.fromiter(map(len, spelt), np.int64, len(spelt))), 0, 0)[begins].tolist()
            table.update(zip(new, [blob[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], strict=True))
            ids = [b"".join(map(table.__getitem__, own)) for own in split]
            out.append((np.frombuffer(b"".join(ids), np.int32), np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) // 4))
        return out

    def decoded(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes that ids spell, all in a row, and where each id's bytes begin (one more than ids)."""
        blob, begins, sizes = self.bytes_of
        own = sizes[ids]
        ends = np.cumsum(own)
        at = np.repeat(begins[ids] - ends + own, own) + np.arange(ends[-1] if len(ends) else 0)
        return blob[at].tobytes(), np.insert(ends, 0, 0)

    def decode(self, ids: list[int]) -> str:
        text = self.decoded(np.array(ids, np.int64))[0].decode("utf-8", "replace")
        return text.removeprefix(" ")


def encode(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, ids."""

    def run(batches):
        import pyarrow as pa

        known: tuple[dict[str, bytes], ...] = ({}, {})
        for batch, texts in text_batches(batches):
            ((flat, ends),) = codec.encode(texts, known)
            lists = pa.ListArray.from_arrays(pa.array(np.insert(ends, 0, 0).astype(np.int32)), pa.array(flat), mask=batch.column(1).is_null())
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "ids"])

    few = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return few.mapInArrow(run, f"id {few.schema['id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, codec: Codec, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """A row for each row of encoded: id, text; null ids decode as null."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                texts = [None if ids is None else codec.decode(ids) for ids in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(texts, pa.string())], ["id", "text"])

    few = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return few.mapInArrow(run, f"id {few.schema['id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, codec: Codec) -> DataFrame:
    """A row for each row of docs, from one pass over the partitions: id; n_tokens, ids_sha256, decoded_sha256 and
    round_trip of the best-scoring path's ids; merge_tokens and merge_sha256 of the merge result's ids. Null texts have
    null in all but id. round_trip: whether the text comes back, the mark as a space."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        known: tuple[dict[str, bytes], ...] = ({}, {}, {}, {})
        digest = lambda x: hashlib.sha256(x).hexdigest()
        for batch, texts in text_batches(batches):
            (flat, ends), (merged, merged_ends) = codec.encode(texts, known, KINDS)
            begins, merged_begins = np.insert(ends, 0, 0), np.insert(merged_ends, 0, 0)
            spelt, at = codec.decoded(flat)
            spelt, at = memoryview(spelt), at[begins].tolist()
            ids, others = memoryview(flat.astype("<i4", copy=False)).cast("B"), memoryview(merged.astype("<i4", copy=False)).cast("B")
            rows = []
            b, m = (4 * begins).tolist(), (4 * merged_begins).tolist()
            for i, text in enumerate(texts):
                back = spelt[at[i] : at[i + 1]]
                back = back[1:] if back[:1] == b" " else back
                rows.append((digest(ids[b[i] : b[i + 1]]), digest(back), back == text.encode("utf-8", "replace") or str(back, "utf-8", "replace") == text.replace(MARK, " "), digest(others[m[i] : m[i + 1]])))
            gone = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            own, spoken, same, other = (pa.array([r[k] for r in rows], mask=gone) for k in range(4))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(begins), mask=gone), own, spoken, same, pa.array(np.diff(merged_begins), mask=gone), other],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip", "merge_tokens", "merge_sha256"],
            )

    few = docs.select(F.col("doc_id").alias("id"), F.col("text"))
    kind = few.schema["id"].dataType.simpleString()
    return few.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean, merge_tokens long, merge_sha256 string")


def default_codec(model_file: str | None = None) -> Codec:
    import public_tokenizers

    return Codec(model_file or public_tokenizers.path("piece_bpe_32k.model"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"), default_codec()).withColumnRenamed("id", "doc_id")


QUERIES = {"op3_sentencepiece": op3_sentencepiece}
SQL: dict[str, str] = {}
