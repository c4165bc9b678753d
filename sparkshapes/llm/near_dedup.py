"""Near duplicates: a multi-index Hamming join over b-bit minhash signatures, links confirmed on full shingle sets.

A text's set is its distinct word shingles, hashed to 64 bits; equal sets collapse to one representative first. A
signature has PARTS * PART positions of BITS bits. By the pigeonhole principle two signatures that differ in fewer
than PARTS * (ERRORS + 1) positions have a part with at most ERRORS differing positions, so each part is indexed under
every choice of PART - ERRORS of its positions: no such pair is missed. At a similarity of 0.8 a pair that differs in
more of 64 positions has a chance of about one in ten million.

Pairs of one index key are never all emitted. First every member of a key meets the key's least member, then, in keys
of CROWD or more members that still hold several components, TURNS members chosen by hash, as long as one links any; the
links that the full sets confirm form components. What the keys left connect is a cluster. Of its components the largest meets only the others,
and these each other, in blocks of bounded size, each pair in one block. Sizes and signatures tell there which pairs
are worth a look, full sets decide, and only links that join two components come out. Pairs inside one component change
nothing and are not looked at, nor are sets so small that no different set is similar enough.

Null and empty texts and texts without words have empty sets and are linked with nothing; a null id is an id like others
and smaller than all. Of a group the smallest id stands for it, so ties decide nothing. A text of any length is one set;
its signature has a fixed size. Rows repeated under one id are copies and agree. Only id and text are read, and an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import WordTable, discard, free_name, read_table, row_key, stored, text_batches, text_of, with_groups

PARTS, PART, ERRORS, BITS = 16, 4, 1, 16
#: Shingles of a part of a cluster, at least LEAST a text; a block holds two parts.
BLOCK, LEAST = 200_000, 40
#: Members of a key that all others of other components meet, after its least member and before blocks; and the members of
#: the keys that are worth it.
TURNS, CROWD = 2, 1_000


def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def shingle_set(text: str, width: int, table: WordTable) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of width words; of all its words if they are fewer."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    out ^= out >> np.uint64(32)
    return np.unique(out * np.uint64(0xD6E8FEB86659FD93))


def turns() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, PARTS * PART, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, turn: np.ndarray) -> np.ndarray:
    least = np.full(len(turn), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 16_384):
        mixed = turn[:, None] * shingles[None, at : at + 16_384]
        least = np.minimum(least, mixed.min(1))
    least ^= least >> np.uint64(27)
    return (least * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype("<u2")


def keys_of(signatures: np.ndarray) -> np.ndarray:
    """Index keys of each signature (rows): a part, the positions kept, and their values, packed without loss."""
    parts = signatures.reshape(len(signatures), PARTS, PART).astype(np.int64)
    out = np.empty((len(signatures), PARTS, PART), np.int64)
    for gone in range(PART):
        key = np.broadcast_to(np.arange(PARTS) * PART + gone, parts.shape[:2]).copy()
        for i in range(PART):
            if i != gone:
                key = (key << BITS) | parts[:, :, i]
        out[:, :, gone] = key
    return out.reshape(len(signatures), PARTS * PART)


def shingled(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """id, n, digest of the set, signature."""

    def run(batches: Iterator):
        import pyarrow as pa

        table, turn = WordTable(word_hash), turns()
        for batch, texts in text_batches(batches):
            sets = [shingle_set(t, width, table) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([signature(s, turn).tobytes() for s in sets], pa.binary()),
                ], ["id", "n", "digest", "signature"],
            )
            table.trim()

    few = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return few.mapInArrow(run, f"id {few.schema['id'].dataType.simpleString()}, n long, digest binary, signature binary")


def keyed(reps: DataFrame) -> DataFrame:
    """key, id of each representative under each of its index keys."""

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                rows = batch.slice(at, 2000)
                keys = keys_of(np.frombuffer(b"".join(rows.column(1).to_pylist()), "<u2").reshape(rows.num_rows, -1))
                ids = rows.column(0).take(pa.array(np.repeat(np.arange(rows.num_rows), keys.shape[1])))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), ids], ["key", "id"])

    return reps.select("id", "signature").mapInArrow(run, f"key long, id {reps.schema['id'].dataType.simpleString()}")


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing positions of signatures, row by row (or broadcast)."""
    return (a != b).sum(-1)


def close_pairs(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose sizes allow the similarity and whose signatures are near enough."""
    few = reps.select("id", "n", "signature")
    both = (
        pairs.join(few.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("signature").alias("s_a")), "a")
        .join(few.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("signature").alias("s_b")), "b")
        .where((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")))
    )

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(batch.num_rows, -1) for i in (2, 3))
            keep = pa.array(apart(a, b) < PARTS * (ERRORS + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "b", "s_a", "s_b").mapInArrow(run, f"a {kind}, b {kind}")


def block_links(members: DataFrame, width: int, percent: int) -> DataFrame:
    """members: cluster, i, j, side, id, label, n, signature, text. Links a, b of labels that a block joins.

    A block holds one or two parts of a cluster. Each text's overlap with those of other labels whose sizes and signatures
    allow a link is counted at once, on full shingle sets; a link that joins two labels makes them one for the rest of the
    block, so few links come out. Texts without such a partner are not looked at.
    """

    def links_of(labels, side, sizes, signatures, texts, same, table):
        now = np.unique(labels, return_inverse=True)[1]
        beside, maybe = np.flatnonzero(side == 1), {}
        for x in range(len(labels)) if same else np.flatnonzero(side == 0).tolist():
            others = np.arange(x + 1, len(labels)) if same else beside
            others = others[(now[others] != now[x]) & (100 * np.minimum(sizes[others], sizes[x]) >= percent * np.maximum(sizes[others], sizes[x]))]
            others = others[apart(signatures[others], signatures[x]) < PARTS * (ERRORS + 1)]
            if len(others):
                maybe[x] = others
        if not maybe:
            return
        used = np.unique(np.concatenate([np.array(list(maybe)), *maybe.values()]))
        sets = [shingle_set(texts[y].as_py() or "", width, table) for y in used.tolist()]
        vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
        own = dict(zip(used.tolist(), np.split(flat, np.cumsum([len(s) for s in sets])[:-1]), strict=True))
        mark = np.zeros(len(vocabulary), np.int64)
        for x, others in maybe.items():
            others = others[now[others] != now[x]]
            if not len(others):
                continue
            mark[own[x]] = 1
            common = np.add.reduceat(mark[np.concatenate([own[y] for y in others.tolist()])], np.cumsum(sizes[others]) - sizes[others])
            mark[own[x]] = 0
            for y in others[(common > 0) & (100 * common >= percent * (sizes[others] + sizes[x] - common))].tolist():
                if now[y] != now[x]:
                    now[now == now[y]] = now[x]
                    yield (labels[x], labels[y])

    def run(batches: Iterator):
        import pyarrow as pa

        rest, table = None, WordTable(word_hash)
        for batch in _and_last(batches):
            whole = batch if rest is None else (rest if batch is None else pa.concat_tables([rest, batch]))
            if whole is None or not whole.num_rows:
                continue
            group = [whole.column(c).to_numpy() for c in ("cluster", "i", "j")]
            change = np.flatnonzero(np.any([g[1:] != g[:-1] for g in group], axis=0)) + 1
            ends = change if batch is not None else np.append(change, whole.num_rows)
            begin = 0
            for end in ends.tolist():
                part = whole.slice(begin, end - begin)
                labels, side, sizes = (part.column(c).to_numpy() for c in ("label", "side", "n"))
                signatures = np.frombuffer(b"".join(part.column("signature").to_pylist()), "<u2").reshape(part.num_rows, -1)
                found = list(links_of(labels, side, sizes, signatures, part.column("text"), group[1][begin] == group[2][begin], table))
                kind = part.schema.field("label").type
                yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], kind), pa.array([max(p) for p in found], kind)], ["a", "b"])
                begin = end
                table.trim()
            rest = whole.slice(begin)

    kind = members.schema["id"].dataType.simpleString()
    return members.mapInArrow(run, f"a {kind}, b {kind}")


def _and_last(batches: Iterator) -> Iterator:
    """The batches as tables, then None."""
    import pyarrow as pa

    for batch in batches:
        yield pa.Table.from_batches([batch])
    yield None


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs a, b whose full shingle sets are similar enough."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b"
    )

    def run(batches: Iterator):
        import pyarrow as pa

        table, known = WordTable(word_hash), {}

        def set_of(key, text):
            if key not in known:
                if len(known) > 2000:
                    known.clear()
                known[key] = shingle_set(text, width, table)
            return known[key]

        for batch in batches:
            keep = []
            for a, b, s, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = set_of(a, s), set_of(b, t)
                both_ = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both_ > 0 and 100 * both_ >= percent * (len(x) + len(y) - both_))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])
            table.trim()

    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}")


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """A row for each row of docs: id, n_shingles, component_id, kept. Links: 100 * common >= percent * union."""
    sets = stored(shingled(docs, width, id_col, text_col), "sets")
    grouped = sets.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    groups = stored(grouped, "set-groups")
    # A different set shares at most all of this one and has one shingle more: the smallest sets have no links.
    reps = groups.where(100 * F.col("n") >= percent * (F.col("n") + 1)).select(F.col("rep").alias("id"), "n", "signature")
    index = stored(keyed(reps), "keys")
    held = stored(index.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("members")).where("members > 1"), "index-keys")
    rows = groups.count() * PARTS * PART
    members = stored(with_groups(index, held, "key", "members", rows), "index")
    discard(index)
    texts = stored(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .join(members.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]), "candidate-texts",
    )
    pairs = members.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    links, parts = None, None
    for turn in range(TURNS + 1):
        found = stored(confirmed(stored(close_pairs(pairs, reps, percent), "star-pairs"), texts, width, percent), "links")
        if turn and found.isEmpty():  # what is open stays so, and members chosen by another hash would hardly link more
            break
        links = found if links is None else links.unionByName(found)
        parts = stored(connected_components(links), "components")
        # Keys with members of several components: members of three or more, as two have met as a star.
        slim = members.where("members > 2").select("key", "id", "least")
        by_id = slim.groupBy("id").agg(F.collect_list(F.struct("key", "least")).alias("_keys"))  # at most PARTS * PART
        labelled = by_id.join(parts, by_id["id"] == parts["node"], "left").select("id", F.coalesce("component", "id").alias("label"), F.explode("_keys").alias("_k"))
        labelled = labelled.select("_k.key", "id", "_k.least", "label")
        labelled = stored(labelled, "labelled")
        open_ = labelled.groupBy("key").agg(F.min("label").alias("_x"), F.max("label").alias("_y"), F.count("*").alias("_n"), F.min(F.struct(F.xxhash64("id", F.lit(turn)), "id", "label")).alias("_c"))
        open_ = stored(open_.where("_x <> _y").select("key", "_n", F.col("_c.id").alias("_center"), F.col("_c.label").alias("_own")), "open-keys")
        crowded = open_.where(F.col("_n") >= CROWD)
        if turn == TURNS or crowded.isEmpty():
            break
        met = with_groups(labelled, crowded, "key", "_n", rows).where("label <> _own")
        pairs = met.select(F.least("id", "_center").alias("a"), F.greatest("id", "_center").alias("b")).distinct()
    unsettled = stored(with_groups(labelled, open_.select("key", "_n"), "key", "_n", rows).select("id", "least", "label").distinct(), "unsettled")
    # What such keys connect is a cluster; its members meet in blocks of bounded size, each pair in one of them.
    clusters = connected_components(unsettled, "least", "id").select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    sized = stored(unsettled.select("id", "label").distinct().join(clusters, "id").join(reps.select("id", "n"), "id"), "clusters")
    by_label = sized.groupBy("cluster", "label").agg(F.count("*").alias("_m"), F.sum(F.greatest("n", F.lit(LEAST))).alias("_s"))
    counts = by_label.groupBy("cluster").agg(F.max(F.struct("_m", "label")).alias("_top"), F.max_by("_s", F.struct("_m", "label")).alias("_most"), F.sum("_m").alias("_m"), F.sum("_s").alias("_all"))
    counts = counts.select("cluster", "_m", F.col("_top.label").alias("_top"), F.ceil((F.col("_all") - F.col("_most")) / block).alias("_few"), F.ceil(F.col("_most") / block).alias("_many"))
    # Parts 0 to _few - 1 hold the smaller components, the others the largest; each block has a part of the former.
    placed = with_groups(sized, stored(counts, "cluster-sizes"), "cluster", "_m", sized.count())
    large = F.col("label") == F.col("_top")
    placed = placed.withColumn("_p", F.when(large, F.col("_few") + F.pmod(F.xxhash64("id"), F.col("_many"))).otherwise(F.pmod(F.xxhash64("id"), F.col("_few"))))
    last = F.when(large, F.col("_few")).otherwise(F.col("_few") + F.col("_many")) - 1
    spread = placed.withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    spread = spread.select("cluster", F.least("_p", "_q").alias("i"), F.greatest("_p", "_q").alias("j"), (F.col("_p") > F.col("_q")).cast("int").alias("side"), "id", "label")
    armed = spread.join(reps, "id").join(texts, "id").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "id")
    more = stored(block_links(armed.select("cluster", "i", "j", "side", "id", "label", "n", "signature", "text"), width, percent), "links")
    for table in (texts, members, labelled):
        discard(table)

    known = groups.select("digest", "rep", "copies").join(parts, F.col("rep") == F.col("node"), "left").select("digest", "copies", F.coalesce("component", "rep").alias("component_id"))
    if not more.isEmpty():
        joined = connected_components(more).select(F.col("node").alias("component_id"), F.col("component").alias("_joined"))
        known = known.join(stored(joined, "components"), "component_id", "left").select("digest", "copies", F.coalesce("_joined", "component_id").alias("component_id"))
    full = with_groups(sets.where("n > 0").select("id", "n", "digest"), stored(known, "set-components"), "digest", "copies", rows // (PARTS * PART))
    found = full.select("id", F.col("n").alias("n_shingles"), "component_id")
    found = found.unionByName(sets.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))
    return found.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read_table(spark, sf_dir, "documents"), width=4).withColumnRenamed("id", "doc_id")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each near-duplicate group, that of the smallest id; rows that share an id, or have none,
    count by their texts."""
    row = free_name(docs, "_row")
    keyed = docs.withColumn(row, row_key(docs, "doc_id", text_of("text")))
    gone = near_dedup(keyed, width, percent, row).where(~F.col("kept")).select(F.col("id").alias(row)).distinct()
    return keyed.join(gone, row, "left_anti").drop(row)


QUERIES = {"op2_near_dedup": op2_near_dedup}
SQL: dict[str, str] = {}
