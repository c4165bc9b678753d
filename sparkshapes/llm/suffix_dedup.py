"""Repeated passages by two-stage suffix sorting, over the places where a repeat is possible.

A byte goes when a string of LENGTH bytes that covers it also starts elsewhere. Anchors make that search local: in
every window of LENGTH bytes the GRAM-byte string with the least hash is an anchor, so two equal windows have equal
anchors at the same place. A region is an anchor with the bytes that any window around it can reach. Anchors that
occur once cannot lie in a repeat. Of an anchor's regions equal ones collapse, counted (their every window repeats);
the different ones are joined into one text whose suffixes are sorted: those smaller than their successors directly,
the others by one scan over the buckets; neighbours whose bytes have a common prefix of LENGTH repeat. Only suffixes at
which a window can start, and those that induce them, take part.

Equal windows have their anchor at the same place, o bytes from their begin. Of an anchor with more than MOST different
regions the places 0 to LENGTH - GRAM are halved: windows with lo <= o <= hi can only be equal where the lo bytes before the
anchor and those up to LENGTH - hi from it on are, so regions that share these bytes form a part, cut to what such windows
reach, and a region alone in its part has no repeat there. In parts of more than MOST regions equal ones repeat as a whole
and collapse, and the different ones are halved on; where one place is left, the bytes are the window. So each region is
dealt to two parts a round, and what repeats lies in one part.

A row is told apart by a 64-bit hash of id and text, which is checked to be one-to-one and mended where it is not. Null
texts count as empty, a null id is an id like others; texts shorter than LENGTH lose nothing, and longer ones of any
length are cut into regions. Rows repeated under one id are copies of each other and lose what repeats, all alike. Only
id and text are read, and an empty table gives no rows.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.closure import collected
from .common import discard, id_key, read_table, stored, text_batches, text_of, with_groups

LENGTH, GRAM = 200, 110
#: Different regions of one anchor, or part of it, that are sorted together, and bytes of regions sorted at once.
MOST, AT_ONCE = 5_000, 1_000_000
BASE = 0x9E3779B97F4A7C15


class Powers:
    """Powers of BASE and of its inverse modulo 2^64, as far as they were asked for."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up), 1 << 16)
            self.up = np.cumprod(np.insert(np.full(n - 1, BASE, np.uint64), 0, 1))
            self.down = np.cumprod(np.insert(np.full(n - 1, pow(BASE, -1, 1 << 64), np.uint64), 0, 1))


def sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least (or greatest) of every width neighbours, by running extremes in blocks from both sides."""
    op, fill = (np.minimum, np.iinfo(x.dtype).max) if least else (np.maximum, 0)
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, fill, x.dtype)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    ahead = op.accumulate(grid, 1).ravel()
    behind = op.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return op(behind[: n - width + 1], ahead[width - 1 : n])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def anchors(data: bytes, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, hashes of the anchors, hashes of their regions) of a text of at least LENGTH bytes."""
    n = len(data)
    powers.reach(n + 1)
    b = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(b * powers.up[:n], out=sums[1:])
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * powers.down[: n - GRAM + 1])
    width = LENGTH - GRAM + 1
    least = sliding(grams, width, True)
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(sliding(np.concatenate([edge, least, edge]), width, False) == grams)
    lo, hi = np.maximum(at - (LENGTH - GRAM), 0), np.minimum(at + LENGTH, n)
    whole = mixed((sums[hi] - sums[lo]) * powers.down[lo])
    region = mixed(whole + (at - lo).astype(np.uint64) * np.uint64(0x85EBCA6BC2B2AE35) + (hi - lo).astype(np.uint64) * np.uint64(0x27D4EB2F165667C5))
    return at, grams[at], region


def words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number that compares as they do; zeros follow the end."""
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    n = len(data)
    out = np.zeros(n, np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | wide[i : n + i]
    return out


def suffix_order(data: np.ndarray, depth: int, within: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of data (bytes) in order of their first depth bytes at least, by two-stage sorting.

    A suffix smaller than its successor is of the first kind; these are sorted directly. Each other suffix is its first
    byte and its successor, which precedes it in the order, so one scan in order puts it at the next free place at the
    front of its byte's bucket. within: marks the suffixes wanted; those that induce them come along.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    # A suffix's kind is that of the next differing pair of bytes; the last suffix is greater than nothing after it.
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1])
    step[-1] = -1
    at = np.where(step != 0, np.arange(n), n)
    small = step[np.minimum.accumulate(at[::-1])[::-1]] > 0
    among = np.ones(n, bool)
    if within is not None:
        # A suffix of the second kind takes its successors along, up to one of the first kind.
        ends = np.flatnonzero(within & ~small & ~np.append(within[1:], False))
        firsts = np.append(np.flatnonzero(small), n - 1)
        until = firsts[np.searchsorted(firsts, ends)]
        turn = np.zeros(n + 1, np.int64)
        np.add.at(turn, ends, 1)
        np.add.at(turn, until + 1, -1)
        among = within | (np.cumsum(turn[:n]) > 0)
    order = np.flatnonzero(small & among)
    strings = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(depth, np.uint8)), depth)
    order = order[np.argsort(np.ascontiguousarray(strings[order]).view(f"V{depth}").ravel())]
    counts = np.bincount(data[among], minlength=256)
    tails = np.cumsum(counts)
    heads = (tails - counts).tolist()
    out = np.full(tails[-1], -1, np.int64)
    first = data[order]
    here = np.bincount(first, minlength=256)
    out[(tails - here)[first] + np.arange(len(order)) - (np.cumsum(here) - here)[first]] = order
    byte, large, place = data.tobytes(), np.append(among & ~small, False).tobytes(), array("q", out.tobytes())
    if among[n - 1]:
        place[heads[byte[n - 1]]] = n - 1
        heads[byte[n - 1]] += 1
    for j in place:  # grows ahead of the scan
        j -= 1
        if large[j]:
            c = byte[j]
            place[heads[c]] = j
            heads[c] += 1
    return np.frombuffer(place, np.int64)


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix lengths of neighbours in the order (of each with the one before), depth at most."""
    word = np.concatenate([words8(data), np.zeros(depth + 8, np.uint64)])
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for d in range(0, depth, 8):
        same = word[order[live] + d] == word[order[live - 1] + d]
        gone = live[~same]
        bits = word[order[gone] + d] ^ word[order[gone - 1] + d]
        out[gone] = d + 7 - np.floor(np.log2(bits.astype(np.float64))).astype(np.int64) // 8
        live = live[same]
        out[live] = d + 8
    end = len(data)
    out[1:] = np.minimum(out[1:], np.minimum(end - order[1:], end - order[:-1]))
    return np.minimum(out, depth)


def repeated_starts(regions: list[bytes], rows: np.ndarray, begins: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each region, the places in it where a string of length bytes starts that also starts elsewhere.

    Regions of one row may overlap: elsewhere is another row or another place of the row, which rows and begins tell.
    """
    data = np.frombuffer(b"\xff".join(regions) + b"\xff", np.uint8) + np.uint8(1)  # no UTF-8 text has this byte
    sizes = np.array([len(r) + 1 for r in regions])
    ends = np.cumsum(sizes) - 1
    room = np.maximum(sizes - length, 0)  # windows in each region
    within = np.zeros(len(data), bool)
    within[np.repeat(ends - sizes + 1 - np.cumsum(room) + room, room) + np.arange(room.sum())] = True
    order = suffix_order(data, length, within)
    order = order[within[order]]
    if not len(order):
        return [np.zeros(0, np.int64)] * len(regions)
    run = np.cumsum(common_prefixes(data, order, length) < length)
    which = np.searchsorted(ends, order)
    offset = order - (ends - sizes + 1)[which]
    row, at = rows[which], begins[which] + offset
    first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    differ = lambda x: np.repeat(np.minimum.reduceat(x, first) != np.maximum.reduceat(x, first), np.diff(np.append(first, len(x))))
    hit = differ(row) | differ(at)
    which, offset = which[hit], offset[hit]
    by = np.lexsort((offset, which))
    cuts = np.searchsorted(which[by], np.arange(len(regions) + 1)).tolist()
    return [offset[by[a:b]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def runs(starts: np.ndarray, length: int = LENGTH) -> tuple[list[int], list[int]]:
    """The union of [s, s + length) as begins and ends."""
    if not len(starts):
        return [], []
    cut = np.flatnonzero(np.diff(starts) > length)
    return starts[np.insert(cut + 1, 0, 0)].tolist(), (starts[np.append(cut, len(starts) - 1)] + length).tolist()


def row_hash(docs: DataFrame, id_col: str, text_col: str):
    """A 64-bit hash of id and text that no two different rows share: those that would share one get another."""
    text, out, salt = text_of(text_col), F.xxhash64(F.col(id_col), text_of(text_col)), 0
    whole = F.concat(id_key(docs, id_col), F.unhex(F.md5(text)))
    while True:
        same = docs.select(out.alias("_h"), whole.alias("_w")).groupBy("_h").agg(F.min("_w").alias("_x"), F.max("_w").alias("_y"))
        shared = [h for (h,) in collected(same.where("_x <> _y").select("_h"), 10_000)]
        if not shared:
            return out
        salt += 1
        out = F.when(out.isin(shared), F.xxhash64(F.col(id_col), text, F.lit(salt))).otherwise(out)


def anchored(docs: DataFrame) -> DataFrame:
    """docs: row, text. anchor, region, row, place."""

    def run(batches: Iterator):
        import pyarrow as pa

        powers = Powers()
        for batch, texts in text_batches(batches):
            rows, found = batch.column(0).to_numpy(), []
            for row, text in zip(rows.tolist(), texts, strict=True):
                data = text.encode("utf-8", "replace")
                if len(data) >= LENGTH:
                    at, gram, region = anchors(data, powers)
                    found.append((gram.view(np.int64), region.view(np.int64), np.full(len(at), row, np.int64), at.astype(np.int32)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["anchor", "region", "row", "place"])

    return docs.mapInArrow(run, "anchor long, region long, row long, place int")


def cut_regions(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """wanted: anchor, region, row, place. anchor, region, row, begin, at, bytes: the regions' bytes, read from one row each;
    at: where the anchor is among them."""

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            out = []
            for row, grams, regions, at, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (text or "").encode("utf-8", "replace")
                for a, r, p in zip(grams, regions, at, strict=True):
                    begin = max(0, p - (LENGTH - GRAM))
                    out.append((a, r, row, begin, p - begin, data[begin : p + LENGTH]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["anchor", "region", "row", "begin", "at", "bytes"])

    by_row = wanted.groupBy("row").agg(F.collect_list("anchor").alias("anchor"), F.collect_list("region").alias("region"), F.collect_list("place").alias("place"))
    return docs.join(by_row, "row").select("row", "anchor", "region", "place", "text").mapInArrow(run, "anchor long, region long, row long, begin int, at int, bytes binary")


def sorted_repeats(regions: DataFrame) -> DataFrame:
    """regions: anchor, part, region, row, begin, shift, bytes (from shift on). anchor, region, begins, ends: what repeats
    within each part."""

    def run(batches: Iterator):
        import pyarrow as pa

        def decided(table):
            a, r, data = table.column("anchor").to_numpy(), table.column("region").to_numpy(), table.column("bytes").to_pylist()
            rows, shift = table.column("row").to_numpy(), table.column("shift").to_numpy()
            found = repeated_starts(data, rows, table.column("begin").to_numpy() + shift)
            found = [runs(s + x) for s, x in zip(found, shift.tolist(), strict=True)]
            keep = [i for i, f in enumerate(found) if f[0]]
            kind = pa.list_(pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(r[keep]), pa.array([found[i][0] for i in keep], kind), pa.array([found[i][1] for i in keep], kind)], ["anchor", "region", "begins", "ends"])

        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            while rest.num_rows:
                sizes = np.cumsum(pc_length(rest.column("bytes")))
                if sizes[-1] < 2 * AT_ONCE:
                    break
                a, p = rest.column("anchor").to_numpy(), rest.column("part").to_numpy()
                ends = np.flatnonzero((a[1:] != a[:-1]) | (p[1:] != p[:-1])) + 1
                ends = ends[sizes[ends - 1] >= AT_ONCE]
                if not len(ends):
                    break
                yield decided(rest.slice(0, int(ends[0])))
                rest = rest.slice(int(ends[0]))
        if rest is not None and rest.num_rows:
            yield decided(rest)

    spread = regions.select("anchor", "part", "region", "row", "begin", "shift", "bytes").repartition("anchor", "part").sortWithinPartitions("anchor", "part", "region")
    return spread.mapInArrow(run, "anchor long, region long, begins array<int>, ends array<int>")


def pc_length(column) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.binary_length(column).to_numpy().astype(np.int64)


def halved(regions: DataFrame) -> DataFrame:
    """regions: anchor, region, row, begin, shift, at, bytes, lo, hi. The same for each half of lo to hi in which the region
    has a window, with part: a hash of the bytes that all regions with an equal window there share."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    both = F.explode(F.array(F.struct(F.col("lo"), mid.alias("hi")), F.struct((mid + 1).cast("int").alias("lo"), F.col("hi"))))
    out = regions.withColumn("_half", both).drop("lo", "hi").select("*", "_half.lo", "_half.hi").drop("_half")
    out = out.where(f"at >= lo AND length(bytes) - at >= {LENGTH} - hi")
    out = out.withColumn("part", F.expr(f"xxhash64(anchor, lo, hi, substring(bytes, at - lo + 1, lo + {LENGTH} - hi))"))
    cut = F.expr("at - least(at, hi)")
    out = out.withColumn("bytes", F.expr(f"substring(bytes, at - least(at, hi) + 1, least(at, hi) + {LENGTH} - lo)"))
    return out.withColumn("shift", F.col("shift") + cut).withColumn("at", F.least("at", "hi"))


def region_repeats(texts: DataFrame, most: int) -> DataFrame:
    """texts: anchor, region, row, begin, at, bytes. anchor, region, begins, ends; a region may come in several rows."""
    crowd = stored(texts.groupBy("anchor").agg(F.count("*").alias("_d")).where(F.col("_d") > most), "crowded")
    whole = texts.withColumn("shift", F.lit(0))
    few = whole.withColumn("part", F.lit(0).cast("long"))
    if crowd.isEmpty():
        return stored(sorted_repeats(few), "repeats")
    few = few.join(crowd, "anchor", "left_anti").select("anchor", "part", "region", "row", "begin", "shift", "bytes")
    now = with_groups(whole, crowd, "anchor", "_d", texts.count()).drop("_d")
    now = stored(now.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(LENGTH - GRAM)), "crowded-regions")
    columns, sure = few.columns, []
    while not now.isEmpty():
        parts = halved(now)
        sizes = stored(parts.groupBy("part").agg(F.count("*").alias("_n")).where("_n > 1"), "part-sizes")
        met = stored(with_groups(parts, sizes, "part", "_n", 2 * now.count()), "parts")
        discard(now)
        few = few.unionByName(met.where(F.col("_n") <= most).select(*columns))
        large = met.where(F.col("_n") > most).withColumn("slice", F.struct("part", "at", "bytes"))
        # Equal bytes around equal places of the anchor repeat as a whole; one of them goes on for the others.
        one = F.min(F.struct("anchor", "region", "row", "begin", "shift", "lo", "hi"))
        slices = stored(large.groupBy("slice").agg(F.count("*").alias("_c"), one.alias("_one")), "slices")
        again = with_groups(large, slices.where("_c > 1").select("slice", "_c"), "slice", "_c", met.count())
        again = again.select("anchor", "region", F.array("shift").alias("begins"), F.array(F.expr("shift + length(bytes)")).alias("ends"))
        sure.append(stored(again, "equal-slices"))
        now = slices.where("_one.lo < _one.hi").select("_one.*", "slice.at", "slice.bytes")
        now = stored(now, "crowded-regions")
    return functools.reduce(DataFrame.unionByName, sure, stored(sorted_repeats(few), "repeats"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """A row for each row of docs: id, n_bytes, n_removed, begins, ends (maximal removed runs), kept (bytes)."""
    keyed = docs.select(F.col(id_col).alias("id"), row_hash(docs, id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    few = keyed.select("row", "text")
    every = stored(anchored(few), "anchors")
    per = every.groupBy("anchor").agg(F.count("*").alias("times"), F.min("region").alias("_x"), F.max("region").alias("_y"))
    again = stored(per.where("times > 1").select("anchor", "times", (F.col("_x") != F.col("_y")).alias("differ")), "repeated-anchors")
    seen = stored(with_groups(every, again, "anchor", "times", every.count()), "anchor-places")
    discard(every)
    distinct = seen.groupBy("anchor", "region").agg(F.count("*").alias("copies"), F.max("differ").alias("differ"), F.min(F.struct("row", "place")).alias("one"))
    distinct = stored(distinct.select("anchor", "region", "copies", "differ", "one.row", "one.place"), "regions")
    texts = stored(cut_regions(distinct.where("differ").select("anchor", "region", "row", "place"), few), "region-texts")
    found = region_repeats(texts, most)
    # Regions with copies repeat as a whole: their length is not needed, a run is cut at the text's end.
    whole = distinct.where("copies > 1").select("anchor", "region", "copies", F.lit(None).cast("array<int>").alias("begins"), F.lit(None).cast("array<int>").alias("ends"))
    part = distinct.where("copies = 1").select("anchor", "region", "copies").join(found, ["anchor", "region"])
    decided = whole.unionByName(part).withColumn("key", F.struct("anchor", "region")).drop("anchor", "region")
    places = seen.select(F.struct("anchor", "region").alias("key"), "row", "place")
    met = with_groups(places, stored(decided, "decided"), "key", "copies", seen.count())
    runs_ = met.select("row", "place", F.coalesce("begins", F.array(F.lit(-1))).alias("begins"), F.coalesce("ends", F.array(F.lit(-1))).alias("ends"))
    by_row = runs_.groupBy("row").agg(F.collect_list(F.struct("place", "begins", "ends")).alias("runs"))
    joined = keyed.join(by_row, "row", "left").select("id", "text", "runs")

    def run(batches: Iterator):
        import pyarrow as pa

        for batch, texts in text_batches(batches):
            data = [text.encode("utf-8", "replace") for text in texts]
            sizes = np.fromiter(map(len, data), np.int64, len(data))
            begins, ends, bounds = cut_runs(batch.column(2), sizes)
            kept, removed = data, np.zeros(len(data), np.int64)
            if len(begins):
                kept, removed = list(data), np.diff(np.append(0, np.cumsum(ends - begins))[bounds])
                b, e, cuts = begins.tolist(), ends.tolist(), bounds.tolist()
                for i in np.flatnonzero(removed).tolist():
                    own = slice(cuts[i], cuts[i + 1])
                    kept[i] = b"".join([data[i][x:y] for x, y in zip([0, *e[own]], [*b[own], len(data[i])], strict=True)])
            lists = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (begins, ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(removed), *lists, pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "begins", "ends", "kept"])

    kind = keyed.schema["id"].dataType.simpleString()
    return joined.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, begins array<int>, ends array<int>, kept binary")


def cut_runs(column, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """column: each text's list of (place, begins, ends), -1 for a whole region. (begins, ends of the maximal runs of all
    texts, where each text's runs begin and one more). All texts' runs are joined at once, one byte apart."""
    import pyarrow.compute as pc

    whole = lambda x: x.to_numpy(zero_copy_only=False).astype(np.int64)
    found, of = column.flatten(), whole(pc.list_parent_indices(column))
    starts, inner = found.field("begins"), whole(pc.list_parent_indices(found.field("begins")))
    doc, place = of[inner], whole(found.field("place"))[inner]
    b, e = whole(starts.flatten()), whole(found.field("ends").flatten())
    at = np.maximum(place - (LENGTH - GRAM), 0)
    begin = np.where(b < 0, at, at + b)
    end = np.where(b < 0, np.minimum(place + LENGTH, sizes[doc]), at + e)
    base = np.cumsum(sizes + 1) - sizes - 1
    order = np.argsort(base[doc] + begin, kind="stable")
    doc = doc[order]
    begin, end = base[doc] + begin[order], np.maximum.accumulate((base[doc] + end[order]))
    new = np.append(True, begin[1:] > end[:-1])[: len(begin)]
    last = np.append(new[1:], True)[: len(begin)]
    doc, begin, end = doc[new], begin[new], end[last]
    return begin - base[doc], end - base[doc], np.searchsorted(doc, np.arange(len(sizes) + 1))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("begins").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
SQL: dict[str, str] = {}
