"""Document fingerprints as invertible Bloom lookup tables of paragraph digests, with DataFrame functions only.

A text is cut into paragraphs by its content alone: after line ends, and lines of more than LINE characters after
sentences and triples of characters of certain classes, so their number grows with the text and an insertion, a deletion
or a shift changes only the paragraphs it touches. What is still longer than MOST (a run of one repeated word) is cut
every MOST characters. A paragraph's key is its 64-bit digest; repeated paragraphs of a text count once. A text of one
short line has one paragraph.

A table has three rows of cells; a key is added to one cell of each (count, xor of keys, xor of check hashes). The
fingerprint is a text's table of CELLS cells a row, printed: the cells that hold anything, each as place, count, keys
and checks in hexadecimal. The cells of one version minus those of another hold only the paragraphs in which they
differ; peeling takes keys out of cells that hold one key until nothing is left. Pairs that do not fit are tried again
with tables GROWTH times as large and other hashes; tables are sums, so a difference is made in one go from both texts'
paragraphs. Likeness is the share of the joined paragraphs that both have, from the counts and the keys peeled.

Null texts count as empty; an empty text has no paragraphs and is like another empty text (1) and no other (0). Rows
repeated under one id with one text take one place in the order and get the same result; rows of one id with several
texts follow each other by the texts' digests. Null ids come last in descending order. A text of any length is one row,
its paragraphs and tables arrays. Only id and text are read, and an empty table gives no rows; a single document's next
is itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_key, read_table, stored, text_of

#: Where paragraphs end: after a line, or a sentence of a script without spaces.
ENDS = "(?<=\n)|(?<=[。！？；])"
#: Where longer ones are cut: after sentences whose last letter is of a class, and after three characters of classes.
CUTS = "(?<=[aeiornst][.!?] )|(?<=[a-bA-B0-3][e-fE-F4-7][i-lI-L89])"
LINE, MOST = 256, 1024
#: Cells in a row of the fingerprint's table, growth of a row after a failure, tables tried, and rounds of peeling.
CELLS, GROWTH, TRIES, ROUNDS = 8, 4, 9, 30


def keys(text: str) -> str:
    """SQL for a text column's distinct paragraph keys."""
    even = f"transform(split(s, '{CUTS}'), y -> IF(char_length(y) > {MOST}, regexp_extract_all(y, '(?s).{{1,{MOST}}}', 0), array(y)))"
    pieces = f"flatten(transform(split({text}, '{ENDS}'), s -> IF(char_length(s) > {LINE}, flatten({even}), array(s))))"
    return f"array_distinct(transform(filter({pieces}, s -> s <> ''), s -> xxhash64(s)))"


def placed(of: str, sign: str, width: str, seed: str) -> str:
    """SQL for what an array of keys adds to a table: (i, c, k, h) for each key's three cells. width: a power of two."""
    at = lambda row: f"named_struct('i', cast(shiftrightunsigned(z.z, {21 * row}) & ({width} - 1) as int) + {row} * {width}, 'c', {sign}, 'k', z.k, 'h', z.h)"
    hashed = f"transform({of}, k -> named_struct('k', k, 'z', xxhash64(k, {seed}), 'h', xxhash64(k, 'check')))"
    return f"flatten(transform({hashed}, z -> array({at(0)}, {at(1)}, {at(2)})))"


def summed(of: str) -> str:
    """SQL for the table of what is added: the cells (i, c, k, h) that hold anything, in order of i.

    Sorting brings a cell's parts together, so the work is n log n in the keys.
    """
    starts = "filter(sequence(1, size(t)), j -> j = 1 OR t[j - 1].i <> get(t, j - 2).i)"
    total = "aggregate(slice(t, b, coalesce(get(g, n + 1), size(t) + 1) - b), named_struct('i', t[b - 1].i, 'c', 0, 'k', 0L, 'h', 0L), (a, x) -> named_struct('i', a.i, 'c', a.c + x.c, 'k', a.k ^ x.k, 'h', a.h ^ x.h))"
    cells = f"transform(array({starts}), g -> transform(g, (b, n) -> {total}))[0]"
    return f"transform(array(sort_array({of})), t -> IF(size(t) = 0, t, filter({cells}, x -> x.c <> 0 OR x.k <> 0 OR x.h <> 0)))[0]"


def peeled(table: str, width: str, seed: str) -> str:
    """SQL for (cells left, keys found) after peeling; each round takes all cells that hold one key."""
    single = lambda c: f"array_distinct(transform(filter(pure, x -> x.c = {c}), x -> x.k))"
    rest = summed(f"concat(s.cells, {placed('one.p', '-1', width, seed)}, {placed('one.m', '1', width, seed)})")
    found = f"named_struct('cells', {rest}, 'found', concat(s.found, one.p, one.m), 'going', true)"
    took = f"transform(array(named_struct('p', {single(1)}, 'm', {single(-1)})), one -> {found})[0]"
    halt = "named_struct('cells', s.cells, 'found', s.found, 'going', false)"
    step = f"transform(array(filter(s.cells, x -> abs(x.c) = 1 AND xxhash64(x.k, 'check') = x.h)), pure -> IF(size(pure) = 0, {halt}, {took}))[0]"
    begin = f"named_struct('cells', {table}, 'found', cast(array() as array<bigint>), 'going', true)"
    return f"aggregate(sequence(1, {ROUNDS}), {begin}, (s, round) -> IF(s.going, {step}, s))"


def difference(a: str, b: str) -> str:
    """SQL for (d, cells): how many keys two arrays of keys differ in, and cells of the table that showed it.

    The first table tried has a cell for every other key of both, or for each that their counts differ by.
    """
    width = f"cast({CELLS} * power({GROWTH}, go) as int)"
    table = summed(f"concat({placed(a, '1', 'w', 'go')}, {placed(b, '-1', 'w', 'go')})")
    done = f"transform(array({peeled(table, 'w', 'go')}), p -> named_struct('d', IF(size(p.cells) = 0, size(p.found), -1), 'cells', 3 * w))[0]"
    small = f"greatest((size({a}) + size({b})) / 2, abs(size({a}) - size({b}))) > 3 * w AND go < {TRIES - 1}"
    tried = f"transform(array({width}), w -> IF({small}, now, {done}))[0]"
    return f"aggregate(sequence(0, {TRIES - 1}), named_struct('d', -1, 'cells', 0), (now, go) -> IF(now.d >= 0, now, {tried}))"


def likeness(a: str, b: str, d: str) -> str:
    """SQL for shared over joined keys, from both counts and the number of keys that differ."""
    both = f"(size({a}) + size({b}))"
    return f"IF({both} = 0, 1D, ({both} - {d}) / cast({both} + {d} as double))"


def fingerprint(of: str) -> str:
    """SQL for the printed table of an array of keys."""
    table = summed(placed(of, "1", str(CELLS), "0"))
    return f"array_join(transform({table}, x -> lower(concat_ws('.', hex(x.i), hex(x.c), hex(x.k), hex(x.h)))), '-')"


def neighbours(rows: DataFrame) -> DataFrame:
    """rows: row, n. Adds `after`, the row that follows in descending order; the first follows the last.

    Rows are ranged over partitions; inside one a window finds the next, and each partition's last row is followed by
    the first row of the next partition that has any: one row a partition is all that meets in one place.
    """
    ranged = stored(rows.repartitionByRange(F.desc("row")).withColumn("part", F.spark_partition_id()), "ordered")
    order = Window.partitionBy("part").orderBy(F.desc("row"))
    inner = ranged.withColumn("after", F.lead("row").over(order))
    firsts = ranged.groupBy("part").agg(F.max("row").alias("row"))
    line = Window.orderBy("part")
    top = firsts.withColumn("_next", F.coalesce(F.lead("row").over(line), F.first("row").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    joined = inner.join(F.broadcast(top.select("part", "_next")), "part")
    return joined.select("row", "n", F.coalesce("after", "_next").alias("after"))


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    cells_edited, cells_next (of the tables that were peeled), next_id.

    Edited: the last third of a text's code points is replaced by as many (or all) from the start of the next one's.
    A row is its id and a 128-bit digest of its text. What a document takes along from the next one is the head it needs
    and the next one's keys. Both joins need the same columns of the documents, so one shuffle of the texts serves both.
    """
    text = text_of(text_col)
    base = docs.select(F.col(id_col).alias("id"), F.concat(id_key(docs, id_col), F.unhex(F.md5(text))).alias("row"), text.alias("text"))
    lengths = base.groupBy("row").agg(F.max(F.char_length("text")).alias("n"))
    order = stored(neighbours(lengths), "order")
    needs = order.groupBy(F.col("after").alias("row")).agg(F.first("row").alias("of"), F.first(F.floor(F.col("n") / 3).cast("int")).alias("need"))
    heads = base.join(needs.hint("merge"), "row").select(F.col("of").alias("row"), F.expr("substring(text, 1, need)").alias("head"), F.expr(keys("text")).alias("next"), F.col("id").alias("next_id"))
    heads = heads.dropDuplicates(["row"])
    whole = base.join(heads.hint("merge"), "row").withColumn("n_chars", F.char_length("text").cast("long"))
    edited = F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 3 as int)), head)")
    made = whole.select("id", "n_chars", F.expr(keys("text")).alias("own"), edited.alias("edited"), "next", "next_id")
    made = made.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", F.expr(keys("edited")).alias("new"), "next", "next_id")
    near = made.select("*", F.expr(difference("own", "new")).alias("_e"), F.expr(difference("own", "next")).alias("_n"))
    return near.select(
        "id", "n_chars", "edited_sha256", F.expr(fingerprint("own")).alias("fingerprint"), F.expr(fingerprint("new")).alias("edited_fingerprint"),
        F.expr(likeness("own", "new", "_e.d")).alias("near_edited"), F.expr(likeness("own", "next", "_n.d")).alias("near_next"),
        F.col("_e.cells").alias("cells_edited"), F.col("_n.cells").alias("cells_next"), "next_id",
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {"op7_fingerprints": op7_fingerprints}
SQL: dict[str, str] = {}
