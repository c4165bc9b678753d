"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame functions only.

Every source gets a target in words. All targets are cut into blocks of one size; the sources compete for all blocks by
highest quotients target / (2 k + 1), then a source's blocks are apportioned to its shards (seeded hash classes of its
documents) in the same way. A shard lays its documents on a line in seeded order; whole passes over the line come first
and the rest of its quota is a seeded choice of the line's blocks, so a document takes its words in the chosen blocks.
Nothing but (id, source, size) is shuffled, and hot sources are split into shards before any window sees them.

Null texts and texts without words have size 0 and take nothing; a source or a whole table of these has target 0. A text
of any length is one number here. Sources sort by code point, null last. Documents that tie on a line's order follow
their ids; a null id ties with no other. Rows repeated under one id are mixed each by itself. Further columns are not
read. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, read_table, row_key, stored, text_of, with_groups

#: Words of a block: the smallest target's BLOCKS-th part, but at least one and at most BLOCK_WORDS.
BLOCKS = 256
BLOCK_WORDS = 64
#: Words of a shard in a source of up to SHARDS shards; beyond, shards grow in number and in words alike.
SHARD_WORDS = 1 << 16
SHARDS = 4096
#: A prime above any number of blocks in a shard: stepping by it visits every block once.
STEP = 2147483647
#: A whole copy in the fixed-point numbers that copies are counted with.
ONE = 1 << 30


def seats_by_quotient(parties: DataFrame, group: str, party: list[str], weight: str, seats: str) -> DataFrame:
    """Sainte-Lague in each group: parties with a column `won`; the seats of a group are in each of its rows.

    Highest quotients are the same as rounding weight / divisor for the divisor that gives all seats. Three corrections
    of the divisor come close; each party then keeps its rounded seats less two, and the seats left go to the highest of
    the quotients that follow, five of each party.
    """
    every = Window.partitionBy(group)
    whole = parties.withColumn("_all", F.sum(weight).over(every)).withColumn("_for", F.col(seats).cast("double"))
    live = (F.col("_all") > 0) & (F.col(seats) > 0)
    rounded = F.when(live, F.floor(F.col(weight) * F.col("_for") / F.col("_all") + 0.5)).otherwise(F.lit(0)).cast("long")
    for _ in range(3):
        whole = whole.withColumn("_near", F.sum(rounded).over(every))
        whole = whole.withColumn("_for", F.greatest(F.col("_for") + F.col(seats) - F.col("_near"), F.lit(0.5)))
    based = whole.withColumn("_base", F.greatest(rounded - 2, F.lit(0)).cast("long")).withColumn("_left", (F.col(seats) - F.sum("_base").over(every)).cast("long"))
    tried = based.withColumn("_k", F.explode(F.sequence(F.col("_base"), F.col("_base") + 4)))
    order = Window.partitionBy(group).orderBy(F.desc(F.col(weight) / (2 * F.col("_k") + 1)), *party)
    ranked = tried.withColumn("_won", ((F.row_number().over(order) <= F.col("_left")) & (F.col(weight) > 0)).cast("long"))
    return ranked.groupBy(*parties.columns, "_base").agg(F.sum("_won").alias("_more")).select(*parties.columns, (F.col("_base") + F.col("_more")).alias("won"))


def targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """sources: source, source_size. Adds target: weights repeat over the sources in order; share (a fraction) of all
    sizes is dealt by weight, a target stops at `most` times its source's size and the excess is dealt again.

    The end of that dealing is found at once: in order of cap / weight, the first k sources are full for the k at which
    the rest's level no longer reaches the next cap. One row a source passes through a window without a partition.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    k = len(weights)
    weighted = sources.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(k)) + 1).cast("int")).cast("long"))
    weighted = weighted.withColumn("_cap", most * F.col("source_size"))
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    level = (
        weighted.withColumn("_full", F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_w_left", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
        .withColumn("_num", share[0] * F.sum("source_size").over(whole) - share[1] * F.col("_full"))
        .withColumn("_fits", F.col("_num") * F.col("_w") <= share[1] * F.col("_cap") * F.col("_w_left"))
    )
    first = F.min(F.when(F.col("_fits"), F.struct("_rank", "_num", "_w_left"))).over(whole)
    ranked = level.withColumn("_rank", F.row_number().over(by_level)).withColumn("_first", first)
    open_ = F.col("_rank") >= F.col("_first._rank")
    dealt = F.col("_w") * F.col("_first._num") / (share[1] * F.col("_first._w_left"))
    return ranked.select("source", "source_size", F.when(open_, dealt).otherwise(F.col("_cap").cast("double")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix-1") -> DataFrame:
    """A row for each row of docs: id, source, size, source_size, target, taken, quota_blocks, block_words."""
    words = F.regexp_count(text_of(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sized = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words.alias("size")), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    every = Window.partitionBy(F.lit(0))
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(every)
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.coalesce(least, F.lit(0.0)) / BLOCKS)))
    shards = F.ceil(F.col("source_size") / SHARD_WORDS)
    dealt = (
        targets(sources.select("source", "source_size"))
        .withColumn("block_words", block.cast("long"))
        .withColumn("shards", F.greatest(F.lit(1), F.when(shards <= SHARDS, shards).otherwise(F.ceil(F.sqrt(shards * SHARDS)))).cast("int"))
        .withColumn("seats", F.round(F.sum("target").over(every) / F.col("block_words")).cast("long"))
    )
    dealt = seats_by_quotient(dealt, "block_words", ["source"], "target", "seats").drop("seats").withColumnRenamed("won", "source_blocks")
    rows = sources.select("source", "source_rows")
    dealt = dealt.join(rows, dealt["source"].eqNullSafe(rows["source"])).drop(rows["source"])
    keyed = dealt.withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("0"))).drop("source")
    total = sized.count()
    placed = with_groups(sized.withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("0"))), stored(keyed, "targets"), "_key", "source_rows", total)
    luck = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed), F.col("id").cast("string"))), 1, 15), 16, 10).cast("long")
    placed = placed.withColumn("_luck", luck).withColumn("shard", F.pmod(F.col("_luck"), F.col("shards")))
    shard = ["_key", "shard"]
    line = Window.partitionBy(*shard)
    placed = (
        placed.withColumn("_end", F.sum("size").over(line.orderBy("_luck", "id").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_length", F.sum("size").over(line))
    )
    placed = stored(placed, "lines")
    quotas = placed.groupBy(*shard, "source_blocks", "block_words").agg(F.sum("size").alias("_length"))
    quotas = seats_by_quotient(quotas.select("_key", "shard", "_length", "source_blocks"), "_key", ["shard"], "_length", "source_blocks")
    placed = placed.join(quotas.select("_key", "shard", F.col("won").alias("quota_blocks")), shard)
    # A shard without words has no blocks; one stands for them, of which nothing is taken.
    n = F.greatest(F.lit(1), F.ceil(F.col("_length") / F.col("block_words")))
    start = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed), "_key", F.col("shard").cast("string"))), 1, 7), 16, 10).cast("long")
    placed = placed.withColumn("_n", n).withColumn("_start", start).withColumn("_begin", F.col("_end") - F.col("size"))
    passes = F.least(F.lit(2), F.floor(F.col("quota_blocks") / F.col("_n")))
    placed = placed.withColumn("_passes", passes).withColumn("_rest", F.when(passes >= 2, 0).otherwise(F.col("quota_blocks") - passes * F.col("_n")))
    # Words of the document's stretch [_begin, _end) that lie in chosen blocks of the line.
    some = F.expr(
        f"""aggregate(sequence(_begin div block_words, (_end - 1) div block_words), 0L, (got, b) -> got +
        IF(pmod(b * {STEP}L + _start, _n) < _rest, least(_end, (b + 1) * block_words) - greatest(_begin, b * block_words), 0L))"""
    )
    taken = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("_passes") * F.col("size") + F.when(F.col("_rest") == 0, F.lit(0)).otherwise(some))
    return placed.select("id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "quota_blocks", "block_words")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "quota_blocks", "block_words")


def whole_copies(taken: DataFrame, seed: str) -> DataFrame:
    """taken: _row, _key, _taken, _size. _row, _times: taken / size rounded down or up so that a source's words come out.

    What is over whole copies is summed along a line of each source, the largest rows first, and a row gets one more
    copy where the sum, begun at a seeded place, passes a whole number; so the words of all copies differ from those
    taken by less than the source's largest row. The line is ranged over partitions and the sums before a partition,
    one row a source and partition, are added to those inside it.
    """
    parts = taken.where("_size > 0").withColumn("_fix", F.floor(F.col("_taken") / F.col("_size") * ONE).cast("long"))
    parts = parts.select("_row", "_key", "_size", F.floor(F.col("_fix") / ONE).cast("int").alias("_whole"), F.pmod("_fix", F.lit(ONE)).alias("_over"))
    ranged = stored(parts.repartitionByRange("_key", F.desc("_size"), "_row").withColumn("_part", F.spark_partition_id()), "copies")
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_key", "_part").agg(F.sum("_over").alias("_sum"))
    begun = F.pmod(F.xxhash64(F.lit(seed), F.col("_key")), F.lit(ONE))
    sums = sums.select("_key", "_part", (begun + F.coalesce(F.sum("_sum").over(before), F.lit(0))).alias("_begun"))
    inside = Window.partitionBy("_part", "_key").orderBy(F.desc("_size"), "_row").rowsBetween(Window.unboundedPreceding, 0)
    line = ranged.withColumn("_upto", F.sum("_over").over(inside)).join(F.broadcast(sums), ["_key", "_part"])
    end = F.col("_begun") + F.col("_upto")
    more = F.floor(end / ONE) - F.floor((end - F.col("_over")) / ONE)
    return line.select("_row", (F.col("_whole") + more).cast("int").alias("_times"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix-1") -> DataFrame:
    """docs as the mix takes them: each row as often as whole_copies says; rows equal in id, text and source alike."""
    row, many, copy = (free_name(docs, x) for x in ("_row", "_times", "_copy"))
    keyed = docs.withColumn(row, row_key(docs, id_col, text_of(text_col), F.col(source_col)))
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("0")).alias("_key")
    taken = mix(keyed, row, text_col, source_col, seed).groupBy(F.col("id").alias("_row"), key).agg(F.sum("taken").alias("_taken"), F.sum("size").alias("_size"))
    times = whole_copies(taken, seed).where("_times > 0").select(F.col("_row").alias(row), F.col("_times").alias(many))
    return keyed.join(times, row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(many)))).select(*docs.columns)


QUERIES = {"op10_source_mix": op10_source_mix}
SQL = {
    "op10_source_mix": r"""
WITH d AS (
  SELECT doc_id, source, coalesce('=' || source, '0') AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(concat_ws('/', 'mix-1', doc_id::VARCHAR)), 1, 15))::BIGINT AS luck
  FROM documents),
s AS (SELECT source, key, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, 2 * source_size AS cap FROM s),
l AS (
  SELECT *, row_number() OVER o AS place, sum(source_size) OVER () AS everything,
         sum(cap) OVER o - cap AS full_before, sum(w) OVER () - sum(w) OVER o + w AS w_left
  FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
n AS (SELECT *, (3 * everything - 2 * full_before)::BIGINT AS num FROM l),
f AS (SELECT min(place) AS place, arg_min(num, place) AS num, arg_min(w_left, place) AS w_left FROM n WHERE num * w <= 2 * cap * w_left),
t AS (SELECT source, key, source_size, CASE WHEN n.place >= f.place THEN (n.w * f.num)::DOUBLE / (2 * f.w_left)::DOUBLE ELSE cap::DOUBLE END AS target FROM n, f),
b AS (
  SELECT *, greatest(1, least(64, floor(coalesce(min(CASE WHEN target > 0 THEN target END) OVER (), 0) / 256)))::BIGINT AS block_words,
         greatest(1, CASE WHEN ceil(source_size / 65536) <= 4096 THEN ceil(source_size / 65536) ELSE ceil(sqrt(ceil(source_size / 65536) * 4096)) END)::BIGINT AS shards
  FROM t),
seats1 AS (SELECT *, sum(target) OVER (PARTITION BY block_words) AS whole, round(sum(target) OVER (PARTITION BY block_words) / block_words)::BIGINT AS seats FROM b),
tried1 AS (
  SELECT source, block_words, seats, row_number() OVER (PARTITION BY block_words ORDER BY target / (2 * k + 1) DESC, source) AS rank
  FROM seats1, LATERAL (SELECT unnest(generate_series(greatest(0, floor(target * seats / whole)::BIGINT - 40), floor(target * seats / whole)::BIGINT + 40)) AS k) q
  WHERE whole > 0),
low1 AS (SELECT block_words, sum(greatest(0, floor(target * seats / whole)::BIGINT - 40)) AS base FROM seats1 WHERE whole > 0 GROUP BY 1),
won1 AS (SELECT source, count(*) AS extra FROM tried1 JOIN low1 USING (block_words) WHERE rank <= seats - base GROUP BY 1),
c AS (
  SELECT s1.*, CASE WHEN whole > 0 THEN greatest(0, floor(target * seats / whole)::BIGINT - 40) + coalesce(extra, 0) ELSE 0 END AS source_blocks
  FROM seats1 s1 LEFT JOIN won1 ON s1.source IS NOT DISTINCT FROM won1.source),
p AS (
  SELECT d.doc_id, d.source, d.key, d.size, c.source_size, c.target, c.block_words, c.source_blocks, luck % shards AS shard,
         sum(size) OVER (PARTITION BY d.key, luck % shards ORDER BY luck, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS stop,
         sum(size) OVER (PARTITION BY d.key, luck % shards)::BIGINT AS length
  FROM d JOIN c ON d.key = c.key),
g AS (SELECT DISTINCT key, shard, length, source_blocks FROM p),
g2 AS (SELECT *, sum(length) OVER (PARTITION BY key) AS whole FROM g),
tried2 AS (
  SELECT key, shard, source_blocks, row_number() OVER (PARTITION BY key ORDER BY length / (2 * k + 1) DESC, shard) AS rank
  FROM g2, LATERAL (SELECT unnest(generate_series(greatest(0, floor(length * source_blocks / whole)::BIGINT - 40), floor(length * source_blocks / whole)::BIGINT + 40)) AS k) q
  WHERE whole > 0),
low2 AS (SELECT key, sum(greatest(0, floor(length * source_blocks / whole)::BIGINT - 40)) AS base FROM g2 WHERE whole > 0 GROUP BY 1),
won2 AS (SELECT key, shard, count(*) AS extra FROM tried2 JOIN low2 USING (key) WHERE rank <= source_blocks - base GROUP BY ALL),
q AS (
  SELECT g2.key, g2.shard, CASE WHEN whole > 0 THEN greatest(0, floor(length * source_blocks / whole)::BIGINT - 40) + coalesce(extra, 0) ELSE 0 END AS quota_blocks
  FROM g2 LEFT JOIN won2 USING (key, shard)),
r AS (
  SELECT p.*, quota_blocks::BIGINT AS quota_blocks, stop - size AS start, ceil(length / block_words)::BIGINT AS blocks,
         ('0x' || substr(md5(concat_ws('/', 'mix-1', key, shard::VARCHAR)), 1, 7))::BIGINT AS turn
  FROM p JOIN q USING (key, shard)),
v AS (
  SELECT *, CASE WHEN blocks > 0 THEN least(2, quota_blocks // blocks) ELSE 0 END AS passes FROM r),
x AS (SELECT *, CASE WHEN passes >= 2 THEN 0 ELSE quota_blocks - passes * blocks END AS rest FROM v)
SELECT doc_id, source, size, source_size, target, quota_blocks, block_words,
       CASE WHEN size = 0 THEN 0 ELSE passes * size + coalesce((
         SELECT sum(least(stop, (i + 1) * block_words) - greatest(start, i * block_words))
         FROM (SELECT unnest(generate_series(start // block_words, (stop - 1) // block_words)) AS i) z
         WHERE (i * 2147483647 + turn) % blocks < rest), 0) END::BIGINT AS taken
FROM x
"""
}
