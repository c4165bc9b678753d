"""Turns of raw transcripts by a hidden Markov model over lines, and their canonical rendering.

A transcript is the lines of its messages' texts in order; neither where a turn begins nor whose it is is given. Each
line shows features: the kind of speaker marker it begins with, if any, what stands before it (a blank line, another
line, nothing), its length class, and whether it asks. A state is a role with "begins a turn" or "goes on"; start,
transition and emission probabilities are smoothed counts, over fixed sets of values, of lines whose role is known.
Viterbi recovers the states; a turn is a beginning with what goes on from it, rendered without its marker.

Lines are laid out in blocks, so a conversation of any length is never one group: blocks of BLOCK turns, all of a task's
at once. Of a conversation with several blocks each becomes a best-score matrix over (state before, state at the end), a
chain of blocks is folded into larger and larger ones, the states at the ends go back down, and each block then finds its
own path. A block begins a turn. Turns that repeat so often that a block would hold more than ROWS messages are blocks of
their own, dealt further by the hash of the text.

Null and empty texts are messages of one empty line, which may go on with the turn before; blank lines only separate. Messages sort by turn, null
first, then by text (in blocks dealt by hash by that first); repeated rows are repeated messages. Messages without a
conversation are one conversation, the null one. A text of any length is as many lines. Only conversation, turn and text
are read (and the role in training), so further columns do no harm. An empty table gives no rows, and without any known
role there is no model. Ties go to the state of the role that sorts first, a beginning before going on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import learn_remainder, read_table, stored, text_of, with_groups

BLOCK, ROWS = 64, 256
#: Speaker markers as people write them, in classes; "dash" opens a turn without a name, "one" and "two" are speakers.
MARKERS = {
    "user": ("user", "human", "customer", "question", "q", "prompter", "me"),
    "assistant": ("assistant", "ai", "bot", "gpt", "model", "answer", "response"),
    "system": ("system", "sys", "instruction", "context"),
    "one": ("a", "speaker a", "speaker 1", "s1"),
    "two": ("b", "speaker b", "speaker 2", "s2"),
}
NAMES = {word: kind for kind, words in MARKERS.items() for word in words}
MARKER = re.compile(r"\s*(?:#{1,4}\s*|\*\*|<\|?|\[)?(" + "|".join(sorted(NAMES, key=len, reverse=True)) + r")\s*(?:\|?>|\]|\*\*)?\s*[:>\]]\s*", re.I)
DASH = re.compile(r"\s*(?:[-–—]|>>)\s+")
#: Features and how many values each has.
KINDS = ("none", *MARKERS, "dash")
FEATURES = {"marker": len(KINDS), "gap": 3, "length": 16, "asks": 2}


def lines_of(text: str, gap: int = 0) -> tuple[list[str], list[tuple[int, ...]]]:
    """(lines without their markers, their features). gap: what stands before: nothing (0), a blank (1) or a line (2)."""
    bodies, seen, before = [], [], gap
    for line in text.split("\n"):
        if not line.strip():
            gap = 1
            continue
        kind = 0
        if (m := MARKER.match(line)) and m.end():
            kind = KINDS.index(NAMES[m[1].lower()])
        elif m := DASH.match(line):
            kind = KINDS.index("dash")
        body = line[m.end() :] if m else line
        bodies.append(body)
        seen.append((kind, gap, min(15, len(body).bit_length()), int(body.rstrip().endswith("?"))))
        gap = 2
    return (bodies, seen) if bodies else ([""], [(0, before, 0, 0)])


class RoleModel:
    """Log probabilities: start[state], step[state before, state], emit[feature][value, state]; state 2 r begins a turn of
    role r, 2 r + 1 goes on with it."""

    def __init__(self, roles: list[str], counts: dict[tuple[str, int, int], int]):
        k = 2 * len(roles)
        self.roles = roles
        begins = np.arange(k) % 2 == 0
        start = np.where(begins, 1.0, 0.0)
        may = np.array([[begins[b] or a // 2 == b // 2 for b in range(k)] for a in range(k)])
        step = may.astype(float)
        emit = {f: np.full((n, k), 0.5) for f, n in FEATURES.items()}
        for (what, a, b), n in counts.items():
            if what == "start":
                start[b] += n
            elif what == "step" and may[a, b]:
                step[a, b] += n
            elif what in emit:
                emit[what][a, b] += n
        with np.errstate(divide="ignore"):
            self.start, self.step = np.log(start / start.sum()), np.log(step / step.sum(1, keepdims=True))
        self.emit = {f: np.log(x / x.sum(0)) for f, x in emit.items()}
        # A block begins a turn.
        self.enter = np.vstack([np.where(begins, self.step, -np.inf), self.start])

    def emissions(self, seen: list[tuple[int, ...]]) -> np.ndarray:
        codes = np.array(seen, np.int64).reshape(-1, len(FEATURES))
        return sum(self.emit[f][codes[:, i]] for i, f in enumerate(FEATURES))


def best_paths(model: RoleModel, emit: np.ndarray, sizes: np.ndarray, before: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state of each line, score of each block) by Viterbi over blocks of sizes lines each, side by side.

    before: the state before each block (-1: the conversation begins), end: its last state (-1: free).
    """
    order = np.argsort(-sizes, kind="stable")
    at, long_ = (np.cumsum(sizes) - sizes)[order], sizes[order]
    score = model.enter[before[order]] + emit[at]
    back = np.zeros(emit.shape, np.int8)
    live = [int(n) for n in np.searchsorted(-long_, -np.arange(1, int(long_[0]) + 1), side="right")] if len(sizes) else []
    for t in range(1, len(live)):
        m = live[t]
        reach = score[:m, :, None] + model.step
        back[at[:m] + t] = reach.argmax(1)
        score[:m] = reach.max(1) + emit[at[:m] + t]
    now = np.where(end[order] < 0, score.argmax(1), end[order])
    value = score[np.arange(len(now)), now]
    states = np.zeros(len(emit), np.int64)
    for t in range(len(live) - 1, -1, -1):
        m = live[t]
        states[at[:m] + t] = now[:m]
        now[:m] = back[at[:m] + t, now[:m]]
    out = np.empty(len(sizes))
    out[order] = value
    return states, out


def matrices(model: RoleModel, emit: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each block's best scores (state before, or the beginning as the last row; state at the end)."""
    order = np.argsort(-sizes, kind="stable")
    at, long_ = (np.cumsum(sizes) - sizes)[order], sizes[order]
    score = model.enter[None] + emit[at][:, None]
    for t in range(1, int(long_[0])):
        m = int(np.searchsorted(-long_, -t - 1, side="right"))
        score[:m] = (score[:m, :, :, None] + model.step).max(2) + emit[at[:m] + t][:, None]
    out = np.empty_like(score)
    out[order] = score
    return out


def whole_blocks(batches: Iterator, size: int = 4_000_000) -> Iterator:
    """Rows that are sorted by key and block, as tables of whole blocks with about size bytes of text or one block."""
    import pyarrow as pa
    import pyarrow.compute as pc

    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        sizes = np.cumsum(pc.binary_length(rest.column("text")).to_numpy() + 1)
        if len(sizes) and sizes[-1] >= size:
            key, block = rest.column("key"), rest.column("block").to_numpy()
            change = np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False) | (block[1:] != block[:-1])) + 1
            if len(change):
                yield rest.slice(0, int(change[-1]))
                rest = rest.slice(int(change[-1]))
    if rest is not None and rest.num_rows:
        yield rest


def block_lines(table) -> tuple[list[list[str]], list[list[tuple[int, ...]]], np.ndarray, np.ndarray]:
    """(bodies and features of each message, messages at which blocks begin, lines of each block)."""
    import pyarrow.compute as pc

    key, block = table.column("key"), table.column("block").to_numpy()
    change = pc.not_equal(key[1:], key[:-1]).to_numpy() if table.num_rows > 1 else np.zeros(0, bool)
    first = np.flatnonzero(np.append(True, change | (block[1:] != block[:-1])))
    before = np.full(table.num_rows, 2)
    before[first] = 0
    found = [lines_of(x, g) for x, g in zip(table.column("text").to_pylist(), before.tolist(), strict=True)]
    sizes = np.add.reduceat(np.array([len(x) for x, _ in found]), first)
    return [x for x, _ in found], [s for _, s in found], first, sizes


def blocked(messages: DataFrame, conv_col: str, turn_col: str, text_col: str, *more: str) -> DataFrame:
    """conv, key (of the conversation, never null), turn, part, block, text, in order: key, block, turn, part, text."""
    conv = F.col(conv_col)
    rows = messages.select(
        conv.alias("conv"), F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit("0")).alias("key"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit(-1)).alias("turn"), text_of(text_col).alias("text"), *more,
    ).withColumn("own", F.floor(F.col("turn") / BLOCK))
    counts = stored(rows.groupBy("key", "own", "turn").agg(F.count("*").alias("_n")), "turn-counts")
    full = counts.groupBy("key", "own").agg(F.sum("_n").alias("_all")).where(F.col("_all") > ROWS)
    wide = 1 << 20
    if full.isEmpty():
        return rows.withColumn("part", F.lit(0).cast("long")).withColumnRenamed("own", "block")
    crowd = counts.join(full, ["key", "own"]).select(F.struct("key", "turn").alias("_k"), "_n")
    whole = rows.withColumn("_k", F.struct("key", "turn"))
    # Turns of other blocks have one row each in rest, so its join needs no care for heavy keys.
    dealt = with_groups(whole, stored(crowd, "crowded-turns"), "_k", "_n", rows.count())
    part = F.pmod(F.xxhash64("text"), F.ceil(F.col("_n") / ROWS))
    dealt = dealt.withColumn("part", part).withColumn("block", (F.col("own") * (BLOCK + 1) + 1 + F.pmod("turn", F.lit(BLOCK))) * wide + F.col("part"))
    rest = whole.join(full.hint("merge"), ["key", "own"], "left_anti").withColumn("part", F.lit(0).cast("long")).withColumn("block", F.col("own") * (BLOCK + 1) * wide)
    keep = ["conv", "key", "turn", "text", *more, "part", "block"]
    return rest.select(*keep).unionByName(dealt.select(*keep))


def in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "turn", "part", "text")


def train(messages: DataFrame, role_col: str = "role", conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> RoleModel | None:
    """Counts over all messages whose role is known; each task adds up its own, so a few rows a task are shuffled."""
    known = blocked(messages.where(F.col(role_col).isNotNull()).withColumn("_role", F.col(role_col)), conv_col, turn_col, text_col, "_role")
    roles = sorted(r for (r,) in known.select("_role").distinct().limit(1000).collect())
    if not roles:
        return None
    number = {r: i for i, r in enumerate(roles)}

    def run(batches: Iterator):
        import pyarrow as pa

        total: Counter = Counter()
        for table in whole_blocks(batches):
            _, seen, first, _ = block_lines(table)
            begins, last = set(first.tolist()), 0
            blocks, parts = table.column("block").to_pylist(), table.column("_role").to_pylist()
            for i, (own, role) in enumerate(zip(seen, parts, strict=True)):
                for j, codes in enumerate(own):
                    state = 2 * number[role] + (j > 0)
                    if j or i not in begins:
                        total["step", last, state] += 1
                    elif blocks[i] <= 0:
                        total["start", 0, state] += 1
                    for f, v in zip(FEATURES, codes, strict=True):
                        total[f, v, state] += 1
                    last = state
        rows = [(*k, n) for k, n in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["what", "a", "b", "n"])

    cells = in_order(known.select("key", "block", "turn", "part", "text", "_role")).mapInArrow(run, "what string, a long, b long, n long")
    return RoleModel(roles, {(r["what"], r["a"], r["b"]): r["n"] for r in cells.groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect()})


def parse(messages: DataFrame, model: RoleModel, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """A row for each turn found: conv, block (from the conversation's first on), no (of the turn in its block), role, n_lines, first_turn (of the message in
    which it begins), body, rendered."""
    k = 2 * len(model.roles)
    rows = stored(blocked(messages, conv_col, turn_col, text_col), "messages")
    kind = rows.schema["conv"].dataType.simpleString()
    extent = rows.groupBy("key").agg(F.min("block").alias("_lo"), F.max("block").alias("_hi"), F.count("*").alias("_n"))
    far = stored(extent.where("_lo < _hi").select("key", "_lo", "_n"), "long-conversations")
    free = [F.lit(-1).alias("before"), F.lit(-1).alias("end")]
    first = rows.withColumn("block", F.lit(0).cast("long"))
    if far.isEmpty():
        ready = first.select("*", *free)
    else:
        long_ = with_groups(rows, far, "key", "_n", rows.count()).withColumn("block", F.col("block") - F.col("_lo"))
        long_ = stored(long_.select(*rows.columns), "long-messages")
        ends = block_ends(long_, model, k)
        met = long_.withColumn("_k", F.struct("key", "block")).join(ends.select(F.struct("key", "block").alias("_k"), "before", "end"), "_k")
        ready = first.join(far.hint("merge"), "key", "left_anti").select("*", *free).unionByName(met.select(*rows.columns, "before", "end"))

    def run(batches: Iterator):
        import pyarrow as pa

        for table in whole_blocks(batches):
            bodies, seen, first, sizes = block_lines(table)
            emit = model.emissions([s for own in seen for s in own])
            before, end = (table.column(c).to_numpy()[first] for c in ("before", "end"))
            states, _ = best_paths(model, emit, sizes, before, end)
            text = [x for own in bodies for x in own]
            message = np.repeat(np.arange(len(bodies)), [len(x) for x in bodies])
            turns = np.flatnonzero(states % 2 == 0)
            of = message[turns]
            block = np.searchsorted(first, of, side="right") - 1
            lengths = np.diff(np.append(turns, len(states)))
            own = np.append(True, block[1:] != block[:-1])[: len(block)]
            no = np.arange(len(turns)) - np.maximum.accumulate(np.where(own, np.arange(len(turns)), 0))
            at = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("conv").take(at).combine_chunks(), table.column("block").take(at).combine_chunks(), pa.array(no), pa.array([model.roles[s // 2] for s in states[turns].tolist()], pa.string()),
                    pa.array(lengths), table.column("turn").take(at).combine_chunks(), pa.array(["\n".join(text[a : a + n]) for a, n in zip(turns.tolist(), lengths.tolist(), strict=True)], pa.string()),
                ], ["conv", "block", "no", "role", "n_lines", "first_turn", "body"],
            )

    found = in_order(ready).mapInArrow(run, f"conv {kind}, block long, no long, role string, n_lines long, first_turn long, body string")
    return found.withColumn("first_turn", F.nullif("first_turn", F.lit(-1))).withColumn("rendered", render(F.col("role"), F.col("body")))


def block_ends(rows: DataFrame, model: RoleModel, k: int) -> DataFrame:
    """rows: messages of conversations with several blocks. key, block, before (state before it, -1: none), end (its last)."""

    def scores(batches: Iterator):
        import pyarrow as pa

        for table in whole_blocks(batches):
            _, seen, first, sizes = block_lines(table)
            found = matrices(model, model.emissions([s for own in seen for s in own]), sizes)
            at = pa.array(first)
            yield pa.RecordBatch.from_arrays([table.column("key").take(at).combine_chunks(), table.column("block").take(at).combine_chunks(), pa.array(found.reshape(len(first), -1).tolist(), pa.list_(pa.float64()))], ["key", "block", "m"])

    def fold(pdf):
        import pandas as pd

        pdf = pdf.sort_values("block")
        mats = [np.array(m).reshape(k + 1, k) for m in pdf["m"]]
        out = mats[0]
        for m in mats[1:]:
            out = (out[:, :, None] + m[None, :k, :]).max(1)
        return pd.DataFrame({"key": pdf["key"].iloc[:1], "block": pdf["block"].iloc[:1] // BLOCK, "m": [out.ravel().tolist()]})

    def unfold(left, right):
        import pandas as pd

        if not len(right) or not len(left):
            return pd.DataFrame({"key": [], "block": [], "before": [], "end": []})
        left = left.sort_values("block")
        mats = [np.array(m).reshape(k + 1, k) for m in left["m"]]
        before, end = int(right["before"].iloc[0]), int(right["end"].iloc[0])
        score, back = mats[0][k if before < 0 else before], []
        for m in mats[1:]:
            reach = score[:, None] + m[:k]
            back.append(reach.argmax(0))
            score = reach.max(0)
        path = [end]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path.reverse()
        return pd.DataFrame({"key": left["key"].to_numpy(), "block": left["block"].to_numpy(), "before": [before, *path[:-1]], "end": path})

    levels = [stored(in_order(rows).mapInArrow(scores, "key string, block long, m array<double>"), "block-scores")]
    while not levels[-1].groupBy("key").count().where("count > 1").isEmpty():
        up = levels[-1].groupBy("key", F.floor(F.col("block") / BLOCK).alias("_up")).applyInPandas(fold, "key string, block long, m array<double>")
        levels.append(stored(up, "block-scores"))
    top = levels[-1].select("key", "block", F.lit(-1).alias("before"), F.expr(f"array_position(slice(m, {k * k + 1}, {k}), array_max(slice(m, {k * k + 1}, {k}))) - 1").cast("int").alias("end"))
    for level in levels[-2::-1]:
        below = level.withColumn("_up", F.floor(F.col("block") / BLOCK))
        top = stored(below.groupBy("key", "_up").cogroup(top.groupBy("key", "block")).applyInPandas(unfold, "key string, block long, before int, end int"), "block-ends")
    return top


def render(role: Column, body: Column) -> Column:
    """The canonical form of a turn."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), F.trim(body), F.lit("<|im_end|>\n"))


def raw_transcripts(messages: DataFrame) -> DataFrame:
    """Messages as raw transcripts show them, without a look at their roles: by the hash of the conversation a blank line
    before each, a dash, or two speakers taking turns."""
    style, text = learn_remainder("conv_id", 3), text_of("text")
    speaker = F.when(F.pmod(F.coalesce("turn", F.lit(0)), F.lit(2)) == 0, F.lit("A: ")).otherwise(F.lit("B: "))
    shown = F.when(style == 1, F.concat(F.lit("- "), text)).when(style == 2, F.concat(speaker, text)).otherwise(F.concat(F.lit("\n"), text))
    return messages.withColumn("text", shown)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from conversations whose crc32 is not 0 modulo 5; the roles of the others are never seen."""
    raw = raw_transcripts(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    model = train(raw.where(learn_remainder("conv_id", 5) != 0))
    if model is None:
        model = RoleModel(["user"], {})
    found = parse(raw.drop("role"), model)
    return found.select(
        F.col("conv").alias("conv_id"), "block", "no", "first_turn", F.col("role").alias("role_found"), "n_lines",
        (learn_remainder("conv", 5) == 0).alias("held_out"), F.sha2("rendered", 256).alias("rendered_sha256"),
    )


def enumerate_paths(model: RoleModel, seen: list[tuple[int, ...]]) -> float:
    """The best score by trying all paths, for tests."""
    emit = model.emissions(seen)

    def value(path: tuple[int, ...]) -> float:
        return model.start[path[0]] + sum(model.step[a, b] for a, b in zip(path, path[1:], strict=False)) + sum(emit[i, s] for i, s in enumerate(path))

    return max(value(p) for p in product(range(len(model.start)), repeat=len(seen)))


QUERIES = {"op4_chat_format": op4_chat_format}
SQL: dict[str, str] = {}
