"""Mixing sources to target weights, in DataFrame operations only.

1. Every source is one stream of tokens: its documents in the order (bucket, id), where a bucket is a hash of
   the id. Running offsets come from windows inside a bucket, over the buckets of a group, and over the groups
   of a source, so that no window sees all of a hot source. The stream is cut into blocks of ``block`` tokens.
2. A source's quota of slots is its target in blocks. The quota is dealt to the output shards by a multinomial draw with
   equal cells: a count is halved again and again, and each half is a binomial draw from keyed hash bits
   (sixty-four coins a hash; beyond ``COINS`` coins the normal limit). Given the quotas, a shard's counts are the sources' shares
   in the mix plus multinomial noise, while totals stay exact to a block.
3. A shard's count of a source is a run of its slots. Slot ``j`` is epoch ``j div n`` and index ``j mod n`` over the source's ``n``
   blocks, and takes the block ``perm(index)``, a keyed swap-or-not permutation for each source and epoch: an epoch takes a block once at most.
4. Slots and the documents' parts of blocks meet on (source, block index), which no key dominates.

Sizes are counted once and written; shards hold about ``SHARD_SLOTS`` slots, however large the corpus.

Defined results: a null text has size 0; null sources are one source, the last;
documents of size 0 take nothing; an empty table gives an empty result; rows
that repeat an id are placed side by side in the stream, each as a document of
its own; reruns give the same rows. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import barrier, n_partitions, table, words, written

WEIGHTS, SHARE, MAX_EPOCHS = (5.0, 2.0, 1.0), 1.5, 2.0
#: Tokens of a block; documents of a bucket, about, and buckets of a group; rounds of the permutation.
BLOCK, BUCKET_DOCS, GROUP_BUCKETS, ROUNDS = 64, 4096, 4096, 24
#: Slots of a shard, about; coins that are tossed one by one for a binomial draw.
SHARD_SLOTS, COINS = 16_384, 1 << 16


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MAX_EPOCHS) -> DataFrame:
    """``_src, _size, _target, _rank`` from one row ``(_src, _size)`` for each source.

    Sources fill up in the order of ``most * size / weight``: one of them is at its
    limit if and only if the limit is below its part of what those before it left.
    This works on one row per source, the only global order here."""
    by_name = Window.orderBy(F.col("_src").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = barrier(sizes.withColumn("_rank", F.row_number().over(by_name)).withColumn("_w", w).withColumn("_limit", F.lit(most) * F.col("_size")))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("_limit") / F.col("_w"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_total", F.lit(share) * F.sum("_size").over(everything)).withColumn("_all_w", F.sum("_w").over(everything))
    level = (F.col("_total") - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / (F.col("_all_w") - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    s = s.withColumn("_level", level).withColumn("_full", F.col("_limit") <= F.col("_w") * F.col("_level"))
    # levels fall from the first source that is not full on: its own, the largest, holds for all the others
    s = s.withColumn("_open", F.max(F.when(~F.col("_full"), F.col("_level"))).over(everything))
    return s.select("_src", "_size", "_rank", F.when(F.col("_full"), F.col("_limit")).otherwise(F.col("_w") * F.col("_open")).alias("_target"))


def permuted(i: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """``i`` under a keyed swap-or-not permutation of ``0 .. n-1``: a bijection for each key and n."""

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - x + n, n)
        coin = F.xxhash64(key, r, F.greatest(x, other), F.lit("coin"))
        return F.when(F.shiftrightunsigned(coin, 63) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), i, step)


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``_id, _src, _n`` (size), written once."""
    return written(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_src"), F.size(words(F.col(text_col))).cast("long").alias("_n")), "sizes")


def sources(d: DataFrame, block: int, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``_src, _rank, _size, _target, _blocks, _buckets, _quota`` of the sources of ``d`` (see ``sized``)."""
    per = d.groupBy("_src").agg(F.sum("_n").alias("_size"), F.count("*").alias("_docs"))
    t = targets(per.select("_src", "_size"), weights, share, most)
    src = t.join(per.select(F.col("_src").alias("_s"), "_docs"), F.col("_src").eqNullSafe(F.col("_s")))
    src = src.withColumn("_blocks", F.ceil(F.col("_size") / block).cast("long")).withColumn("_buckets", F.greatest(F.ceil(F.col("_docs") / BUCKET_DOCS), F.lit(1)).cast("long"))
    # whole epochs exactly, the rest in blocks; the last block of a stream is short
    epochs = F.floor(F.col("_target") / F.greatest(F.col("_size"), F.lit(1)))
    rest = F.round((F.col("_target") - epochs * F.col("_size")) / block)
    quota = F.least(epochs * F.col("_blocks") + rest, F.floor(F.lit(most)) * F.col("_blocks")).cast("long")
    return written(src.select("_src", F.col("_rank").cast("long").alias("_rank"), "_size", "_target", "_blocks", "_buckets", quota.alias("_quota")), "sources")


def placed(d: DataFrame, src: DataFrame) -> DataFrame:
    """``_id, _src, _rank, _n, _size, _target, _start`` (offset in the source's stream)."""
    d = d.join(src.withColumnRenamed("_src", "_s"), F.col("_src").eqNullSafe(F.col("_s"))).select("_id", "_src", "_rank", "_n", "_size", "_target", "_buckets")
    d = d.withColumn("_bucket", F.pmod(F.xxhash64("_id", F.lit("bucket")), F.col("_buckets")))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = d.groupBy("_rank", "_bucket").agg(F.sum("_n").alias("_sum")).withColumn("_group", F.floor(F.col("_bucket") / GROUP_BUCKETS))
    groups = sums.groupBy("_rank", "_group").agg(F.sum("_sum").alias("_gsum"))
    groups = groups.select(F.col("_rank").alias("_r"), F.col("_group").alias("_g"), before("_gsum", Window.partitionBy("_rank").orderBy("_group")).alias("_gbase"))
    sums = sums.withColumn("_bbase", before("_sum", Window.partitionBy("_rank", "_group").orderBy("_bucket")))
    base = sums.join(groups, (F.col("_rank") == F.col("_r")) & (F.col("_group") == F.col("_g"))).select(F.col("_rank").alias("_r"), F.col("_bucket").alias("_b"), (F.col("_gbase") + F.col("_bbase")).alias("_base"))
    d = d.withColumn("_inside", before("_n", Window.partitionBy("_rank", "_bucket").orderBy("_id", "_n")))
    d = d.join(base, (F.col("_rank") == F.col("_r")) & (F.col("_bucket") == F.col("_b")))
    return d.select("_id", "_src", "_rank", "_n", "_size", "_target", (F.col("_base") + F.col("_inside")).alias("_start"))


def heads(n: Column, key: Column) -> Column:
    """A binomial draw: heads of ``n`` fair coins, from the hash bits of ``key``."""
    long = lambda x: F.lit(x).cast("long")
    whole = F.floor(n / 64).cast("long")
    toss = F.aggregate(F.sequence(long(1), whole), long(0), lambda s, i: s + F.bit_count(F.xxhash64(key, i)))
    part = F.pmod(n, F.lit(64)).cast("int")
    rest = F.when(part > 0, F.bit_count(F.call_function("shiftrightunsigned", F.xxhash64(key, long(0)), 64 - part))).otherwise(0)
    even = lambda i: (F.shiftrightunsigned(F.xxhash64(key, long(i)), 11) + 1) / F.lit(float(1 << 53))  # noqa: E731  in (0, 1]
    normal = F.sqrt(-2 * F.log(even(-1))) * F.cos(2 * math.pi * even(-2))
    limit = F.least(F.greatest(F.round(n / 2 + normal * F.sqrt(n) / 2), F.lit(0)), n)
    return F.when(n <= COINS, F.when(whole > 0, toss).otherwise(long(0)) + rest).otherwise(limit).cast("long")


def draws(src: DataFrame, shards: int, seed: int) -> DataFrame:
    """``_rank, _blocks, _shard, _first, _count``: each source's multinomial counts by shard, as runs of its slots."""
    if shards & (shards - 1):
        raise ValueError("the number of shards is a power of two")
    d = src.select("_rank", "_blocks", F.lit(0).cast("long").alias("_shard"), F.lit(0).cast("long").alias("_first"), F.col("_quota").alias("_count")).filter("_count > 0")
    for level in range(shards.bit_length() - 1):
        d = barrier(d.withColumn("_left", heads(F.col("_count"), F.xxhash64(F.lit(seed).cast("long"), "_rank", F.lit(level).cast("long"), "_shard"))))
        half = lambda bit, first, count: F.struct((F.col("_shard") * 2 + bit).alias("_shard"), first.alias("_first"), count.alias("_count"))
        halves = F.array(half(0, F.col("_first"), F.col("_left")), half(1, F.col("_first") + F.col("_left"), F.col("_count") - F.col("_left")))
        d = d.select("_rank", "_blocks", F.inline(halves)).filter("_count > 0")
    return d


def slots(src: DataFrame, block: int, seed: int, shards: int | None) -> DataFrame:
    """``_rank, _block, _slot, _shard``: what the mix takes, one row a slot, from the drawn counts."""
    if shards is None:
        total = src.agg(F.sum("_quota")).first()[0] or 0
        shards = 1 << max(0, math.ceil(math.log2(max(1, total) / SHARD_SLOTS)))
    run = draws(src, shards, seed).repartition(n_partitions(src.sparkSession), "_rank", "_shard")
    own = run.select("_rank", "_blocks", "_shard", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_count") - 1)).alias("_slot"))
    key = F.xxhash64(F.lit(seed).cast("long"), "_rank", F.floor(F.col("_slot") / F.col("_blocks")).cast("long"), F.lit("slot"))
    own = own.select("*", key.alias("_key"), F.pmod(F.col("_slot"), F.col("_blocks")).alias("_i"))
    return own.select("_rank", permuted(F.col("_i"), F.col("_blocks"), F.col("_key")).alias("_block"), "_slot", "_shard")


def pieces(d: DataFrame, block: int) -> DataFrame:
    """``_r, _start, _id, _at`` (block index)``, _begin`` (first word in the document)``, _words``: the documents' parts in each block."""
    p = d.filter(F.col("_n") > 0).select("_rank", "_start", "_n", "_id", F.explode(F.sequence(F.floor(F.col("_start") / block), F.floor((F.col("_start") + F.col("_n") - 1) / block))).alias("_at"))
    begin = F.greatest(F.col("_start"), F.col("_at") * block)
    end = F.least(F.col("_start") + F.col("_n"), (F.col("_at") + 1) * block)
    return p.select(F.col("_rank").alias("_r"), "_start", "_id", "_at", (begin - F.col("_start")).alias("_begin"), (end - begin).alias("_words"))


def _prepared(docs: DataFrame, id_col: str, text_col: str, source_col: str, block: int, weights: tuple[float, ...], share: float, most: float) -> tuple[DataFrame, DataFrame]:
    d = sized(docs, id_col, text_col, source_col)
    src = sources(d, block, weights, share, most)
    return written(placed(d, src), "placed"), src


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, block: int = BLOCK, seed: int = 17, shards: int | None = None,
          weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MAX_EPOCHS) -> DataFrame:
    """The mix itself, one row a slot and document part: ``shard, source, slot, block, id_col, begin, words``: the
    slot holds ``words`` words of that document from its word ``begin`` (from 0) on."""
    d, src = _prepared(docs, id_col, text_col, source_col, block, weights, share, most)
    s, p = slots(src, block, seed, shards), pieces(d, block)
    names = src.select(F.col("_rank").alias("_name"), F.col("_src").alias("source"))
    # planned by size it would be broadcast: nothing tells how many slots the few rows of sources become
    j = s.hint("merge").join(p, (F.col("_rank") == F.col("_r")) & (F.col("_block") == F.col("_at"))).join(names, F.col("_rank") == F.col("_name"))
    return j.select(F.col("_shard").alias("shard"), "source", F.col("_slot").alias("slot"), F.col("_block").alias("block"), F.col("_id").alias(id_col), F.col("_begin").alias("begin"), F.col("_words").alias("words"))


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, block: int = BLOCK, seed: int = 17, shards: int | None = None,
               weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MAX_EPOCHS) -> DataFrame:
    """One row a document: id, source, size, source_size, target, taken."""
    d, src = _prepared(docs, id_col, text_col, source_col, block, weights, share, most)
    s = slots(src, block, seed, shards).groupBy("_rank", "_block").agg(F.count("*").alias("_times"))
    p = pieces(d, block)
    # planned by size it would be broadcast: nothing tells how many slots the few rows of sources become
    taken = s.hint("merge").join(p, (F.col("_rank") == F.col("_r")) & (F.col("_block") == F.col("_at"))).groupBy("_rank", "_start").agg(F.sum(F.col("_times") * F.col("_words")).alias("_taken"))
    taken = taken.select(F.col("_rank").alias("_t"), F.col("_start").alias("_from"), "_taken")
    out = d.join(taken, (F.col("_rank") == F.col("_t")) & (F.col("_start") == F.col("_from")) & (F.col("_n") > 0), "left")
    return out.select(
        F.col("_id").alias(id_col), F.col("_src").alias(source_col), F.col("_n").alias("size"), F.col("_size").alias("source_size"),
        F.col("_target").alias("target"), F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
