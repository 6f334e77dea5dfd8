"""One document of each group of near copies: an exact self-join of shingle sets by prefixes.

Two texts are near copies if the Jaccard similarity of their sets of five-word
shingles (64-bit hashes) is 0.8 or more. In any one order of all shingles, such a
pair shares one of the first ``n // 5 + 1`` shingles of each side's ``n``: if it
did not, one side would lack more than a fifth of the other's. So a set is
entered under its prefix only, and no pair is missed, wherever and however the
texts differ. What meets is verified by the true similarity.

1. Equal sets are one row before anything is entered. The order is that of the
   hashes; shingles that more than ``BUCKET`` prefixes hold (boilerplate) are put last and
   the prefixes that held one are drawn again, so that texts meet by what is rare. The
   tests of a prefix against these shingles run on its own row: nothing is exploded for them.
2. Members of a key with at most ``BUCKET`` sets are paired. A pair is verified if
   sizes and the number of shared keys leave room for the similarity, and if a shared key comes so early in both
   that the rest suffices: a key in place ``p`` of ``n`` can be the first shared one only with sets of ``(5 n - 9 p) / 4`` at most.
3. In larger keys every member meets the key's centre, the one with most large keys for its size (it has fewest edits of its own). What is a near copy of it is linked. All others are
   compared by their differences: if ``x`` and ``y`` differ in ``h`` shingles at most, and from the centre in ``d`` and ``e``, then
   they share ``(d + e - h) / 2`` of these differences, and one at least unless both are near copies of the centre (in which
   case they are linked already). So members are entered again under prefixes of their differences, those that the centre
   lacks first and frequent ones last (and from the member with fewest rare differences as a better centre): copies of one text with edits of their own meet only by common edits, and a group's pairs are never listed.
4. Pairs are verified in shards, pairs with a common neighbour side by side, so that a complete
   set travels once or twice; a neighbour of many is split by the other side.

Defined results: rows whose id is null stay; rows that repeat an id stay or go
together; null and blank texts are copies of one another; the least id of a group
stays; columns are kept whatever their names; empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, n_partitions, trimmed, trimmed_groups, written
from .simhash import components

SHINGLE = 5
#: The largest key whose members are all paired at once.
BUCKET = 32
#: Frequent keys that are put last in the order, and rounds to find them.
LATE, ROUNDS = 100_000, 2
#: Shingles that a shard of pairs to verify holds, about.
SHARD = 2_000_000
#: Up to so many ids reach the texts by broadcast, more by a shuffle.
BROADCAST_IDS = 2_000_000


def shingles(text: str | None):
    """The set of hashes of a text's shingles, in order; a text shorter than a shingle is one."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, dtype=np.int64)
    grams = {b" ".join(w)} if len(w) < SHINGLE else set(map(b" ".join, zip(*(w[k:] for k in range(SHINGLE)), strict=False)))
    return np.unique(np.fromiter(map(xxh3_64_intdigest, grams), dtype=np.uint64).view(np.int64))


def _named(s) -> int:
    from xxhash import xxh3_64_intdigest

    f = xxh3_64_intdigest(s.tobytes())
    return f - (1 << 64) if f >> 63 else f


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id, _f`` (a hash of the set of shingles) ``, _n`` (its size) ``, _p`` (its prefix)."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, n, p = [], [], []
            for t in b.column(1):
                s = shingles(t.as_py())
                f.append(_named(s))
                n.append(len(s))
                p.append(s[: len(s) // 5 + 1])
            yield pa.record_batch([b.column(0), pa.array(f, pa.int64()), pa.array(n, pa.int32()), pa.array(p, pa.list_(pa.int64()))], names=["_id", "_f", "_n", "_p"])

    src = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    return src.mapInArrow(trimmed(run), f"_id {kind}, _f long, _n int, _p array<long>")


class Texts:
    """Complete sets of given rows, read from the texts again: sets are five times their prefixes and few are needed."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        self.src = docs.select(F.col(id_col).alias("_first"), F.col(text_col).alias("_t"))
        self.kind = self.src.schema[0].dataType.simpleString()

    def of(self, wanted: DataFrame, extra: str, out: str, make) -> DataFrame:
        """One row for each of ``wanted`` (_first, _f and the column ``extra``) and each text of that id whose set is ``_f``: the columns ``out``,
        where ``make(set)`` gives the last two. A row that repeats id and text gives its result again."""
        wanted = durable(wanted)
        small = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows, a, z = [], [], []
                for k, (f, t) in enumerate(zip(b.column(1).to_pylist(), b.column(3), strict=True)):
                    s = shingles(t.as_py())
                    if _named(s) == f:  # a repeated id may have other texts too
                        n, x = make(s)
                        rows.append(k)
                        a.append(n)
                        z.append(x)
                at = pa.array(rows, pa.int64())
                yield pa.record_batch([*(b.column(k).take(at) for k in range(3)), pa.array(a, pa.int32()), pa.array(z, pa.list_(pa.int64()))], names=["_first", "_f", extra, "_n", "_p"])

        met = self.src.join(F.broadcast(wanted) if small else wanted, "_first").select("_first", "_f", extra, "_t")
        return met.mapInArrow(trimmed(run), out)


def _keys(part: DataFrame, without: list[int], late: list[int]) -> DataFrame:
    """``_f, _n, _k, _w, _late``: the keys of the rows of ``part`` that hold none of ``without``; ``_w``: the largest set that the
    row's may share this key first with; ``_late``: the key is one of ``late``."""
    import numpy as np

    gone, last = np.array(without, dtype=np.int64), np.array(late, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.diff(b.column(2).offsets.to_numpy())
            key = b.column(2).flatten().to_numpy()
            row = np.repeat(np.arange(len(size)), size)
            stays = np.ones(len(size), dtype=bool)
            stays[row[np.isin(key, gone)]] = False
            place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
            most = (5 * b.column(1).to_numpy().astype(np.int64)[row] - 9 * place) // 4
            at = stays[row]
            row, key = pa.array(row[at]), key[at]
            yield pa.record_batch([b.column(0).take(row), b.column(1).take(row), pa.array(key), pa.array(most[at], pa.int32()), pa.array(np.isin(key, last))], names=["_f", "_n", "_k", "_w", "_late"])

    return part.select("_f", "_n", "_p").mapInArrow(trimmed(run), "_f long, _n int, _k long, _w int, _late boolean")


def _holders(part: DataFrame, keys: list[int], kind: str) -> DataFrame:
    """``_first, _f, _x`` of the rows of ``part`` that hold one of ``keys``."""
    import numpy as np

    some = np.array(keys, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.diff(b.column(2).offsets.to_numpy())
            row = np.repeat(np.arange(len(size)), size)
            at = pa.array(np.unique(row[np.isin(b.column(2).flatten().to_numpy(), some)]))
            yield pa.record_batch([b.column(0).take(at), b.column(1).take(at)], names=["_first", "_f"])

    return part.select("_first", "_f", "_p").mapInArrow(trimmed(run), f"_first {kind}, _f long").withColumn("_x", F.lit(0))


def _rare_first(single: DataFrame, texts: Texts, bucket: int) -> DataFrame:
    """``_f, _n, _k, _w, _late`` (see ``_keys``): the keys of every set, frequent ones last in the order. Any order is exact, so at most ``LATE``
    keys and ``ROUNDS`` rounds are spent on it; a round counts the prefixes that are new in it."""
    import numpy as np

    parts, known = [(single, [])], []  # prefixes, and the keys that were last when they were drawn
    for _ in range(ROUNDS):
        often = _keys(parts[-1][0], [], []).groupBy("_k").agg(F.count("*").alias("_m")).filter(F.col("_m") > bucket)
        often = [r._k for r in often.orderBy(F.desc("_m"), "_k").limit(LATE).collect()]
        new = sorted(set(often) - set(known))[: LATE - len(known)]
        if not new:
            break
        # a prefix without any of these keys is the same in the new order
        moved = None
        for part, _ in parts:
            held = _holders(part, new, texts.kind)
            moved = held if moved is None else moved.unionByName(held)
        known = known + new
        last = np.unique(np.array(known, dtype=np.int64))

        def draw(s, last=last):
            behind = np.isin(s, last)
            return len(s), np.concatenate([s[~behind], s[behind]])[: len(s) // 5 + 1]

        drawn = texts.of(moved.distinct(), "_x", f"_first {texts.kind}, _f long, _x int, _n int, _p array<long>", draw)
        parts.append((written(drawn.drop("_x"), "drawn"), known))
    out = None
    for part, seen in parts:
        rows = _keys(part, sorted(set(known) - set(seen)), known)
        out = rows if out is None else out.unionByName(rows)
    return out


def _near_sizes(n: Column, m: Column) -> Column:
    return F.least(n, m) * 5 >= F.greatest(n, m) * 4


def _room(shared: Column, n: Column, m: Column) -> Column:
    """Whether sets of ``n`` and ``m`` can be near copies if their prefixes share ``shared`` keys at most: beyond
    the prefix that ends first, no more than that side's rest is shared."""
    rest = lambda x: x - F.floor(x / 5) - 1
    return (shared + F.greatest(rest(n), rest(m))) * 9 >= (n + m) * 4


def _verify(pairs: pa.Table, sets: pa.Table, late, rank) -> pa.Table:
    import numpy as np

    chunks = [c for c in sets.column("_p").chunks if len(c)]
    held = dict(zip(sets.column("_f").to_pylist(), (x for c in chunks for x in np.split(c.flatten().to_numpy(), np.cumsum(np.diff(c.offsets.to_numpy()))[:-1])), strict=True))
    rows, near, apart, rare, diff = [], [], [], [], []
    for k, (a, b, star) in enumerate(zip(*(pairs.column(c).to_pylist() for c in ("u", "v", "star")), strict=True)):
        x, y = held[a], held[b]
        same = np.intersect1d(x, y, assume_unique=True)
        alike = len(same) * 9 >= (len(x) + len(y)) * 4
        if alike or star:
            rows.append(k)
            near.append(alike)
            apart.append(len(x) + len(y) - 2 * len(same))
            e = np.concatenate([np.setdiff1d(y, same, assume_unique=True), np.setdiff1d(x, same, assume_unique=True)]) if star else None
            own = len(e) if star else 0
            if star and len(late):
                at = np.minimum(np.searchsorted(late, e), len(late) - 1)
                behind = late[at] == e
                own -= int(behind.sum())
                e = np.concatenate([e[~behind], e[behind][np.argsort(rank[at[behind]])]])
            rare.append(own)
            diff.append(e[: len(y) // 4 + 1] if star else None)
    out = pairs.select(["u", "v", "m"]).take(pa.array(rows, pa.int64()))
    return out.append_column("near", pa.array(near, pa.bool_())).append_column("d", pa.array(apart, pa.int32())).append_column("r", pa.array(rare, pa.int32())).append_column("e", pa.array(diff, pa.list_(pa.int64())))


def verified(pairs: DataFrame, first: DataFrame, texts: Texts, late: list[int] = ()) -> DataFrame:
    """``u, v, m, near, d, r, e`` of the pairs (u, v, n, m, star) whose complete sets are near copies, and of all with ``star``: the sets differ
    in ``d`` shingles, ``r`` of them not in ``late``, ``e`` is the prefix of these for v, what u lacks first and the keys ``late`` last, in this order. ``first``: _f, _first of every set."""
    import numpy as np

    rank = np.argsort(np.array(late, dtype=np.int64))
    last, pairs = np.array(late, dtype=np.int64)[rank], durable(pairs)
    size = pairs.agg(F.sum(F.col("n") + F.col("m"))).first()[0] or 0
    shards = max(n_partitions(pairs.sparkSession), -(-size // SHARD))
    sides = pairs.select(F.col("u").alias("x"), "v").unionByName(pairs.select(F.col("v").alias("x"), F.col("u").alias("v")))
    near = sides.groupBy("x").agg(F.least(F.min("v"), F.col("x")).alias("_near"))
    p = durable(pairs.join(near.withColumnRenamed("x", "u"), "u"))  # read twice below
    many = p.groupBy("_near").agg(F.ceil(F.sum(F.col("n") + F.col("m")) / SHARD).alias("_many")).select(F.bitwise_not("_near").alias("_other"), "_many")
    p = p.join(many, F.bitwise_not("_near") == F.col("_other"))
    p = durable(p.select("u", "v", "m", "star", F.pmod(F.xxhash64("_near", F.pmod(F.xxhash64("v"), F.col("_many"))), F.lit(shards)).cast("long").alias("_s")))
    need = p.select(F.col("u").alias("_f"), "_s").distinct().unionByName(p.select(F.col("v").alias("_f"), "_s").distinct()).distinct().join(first, "_f").select("_first", "_f", "_s")
    sets = texts.of(need, "_s", f"_first {texts.kind}, _f long, _s long, _n int, _p array<long>", lambda s: (len(s), s)).select("_s", "_f", "_p")
    return durable(p.groupBy("_s").cogroup(sets.groupBy("_s")).applyInArrow(trimmed_groups(lambda a, b: _verify(a, b, last, rank)), "u long, v long, m int, near boolean, d int, r int, e array<long>"))


def links(single: DataFrame, texts: Texts, bucket: int = BUCKET) -> DataFrame:
    """``u, v``: pairs of near copies among distinct sets ``single`` (_f, _first, _n, _p) whose components are those of all such pairs."""
    keyed = _rare_first(single, texts, bucket)
    first = single.select("_f", "_first")
    # what is frequent has been put last, so that the count by key needs no group of its own: one exchange for both
    many = Window.partitionBy("_k")
    rare = written(keyed.filter(~F.col("_late")).select("_f", "_n", "_k", "_w").withColumn("_m", F.count("*").over(many)).filter("_m > 1"), "members")
    late = durable(keyed.filter("_late").select("_f", "_n", "_k", "_w"))
    hot = rare.filter(F.col("_m") > bucket).select("_f", "_n", "_k", "_w").unionByName(late)
    hots = hot.groupBy("_f").agg(F.count("*").alias("_hot"))
    early = lambda n, w, m, x: (m <= w) & (n <= x)
    few = rare.filter(F.col("_m") <= bucket).join(hots, "_f", "left").groupBy("_k").agg(F.collect_list(F.struct("_f", "_n", "_w", F.coalesce("_hot", F.lit(0)).alias("_hot"))).alias("_all"))
    few = few.select(F.explode("_all").alias("a"), "_all").select("a", F.explode("_all").alias("b")).filter((F.col("a._f") < F.col("b._f")) & _near_sizes(F.col("a._n"), F.col("b._n")))
    few = few.groupBy(F.col("a._f").alias("u"), F.col("b._f").alias("v"), F.col("a._n").alias("n"), F.col("b._n").alias("m"), F.least("a._hot", "b._hot").alias("h"))
    few = few.agg(F.count("*").alias("c"), F.max(early(F.col("a._n"), F.col("a._w"), F.col("b._n"), F.col("b._w"))).alias("e"))
    # a pair whose first shared key is a hot one is found there
    few = few.filter(F.col("e") & _room(F.col("c") + F.col("h"), F.col("n"), F.col("m"))).select("u", "v", "n", "m", F.lit(False).alias("star"))
    if hot.isEmpty():
        return verified(few, first, texts).select("u", "v")
    # members whose place leaves room for the smallest of the key
    centre = F.max(F.struct((F.col("_hot") / F.col("_n")).alias("_share"), "_f", "_n"))
    centres = hot.join(hots, "_f").groupBy("_k").agg(centre.alias("_o"), F.min("_n").alias("_least")).select(F.bitwise_not("_k").alias("_x"), "_o", "_least")
    star = hot.join(centres, (F.bitwise_not("_k") == F.col("_x")) & (F.col("_w") >= F.col("_least")) & (F.col("_f") != F.col("_o._f")))
    star = star.select(F.col("_o._f").alias("u"), F.col("_f").alias("v"), F.col("_o._n").alias("n"), F.col("_n").alias("m"), F.lit(True).alias("star"))
    found = verified(few.unionByName(star).groupBy("u", "v", "n", "m").agg(F.max("star").alias("star")), first, texts)
    met = found.filter("near").select("u", "v")
    stars = found.filter(F.col("e").isNotNull())
    behind: list[int] = []
    for turn in range(ROUNDS):
        often = stars.select("u", F.explode("e").alias("k")).groupBy("u", "k").agg(F.count("*").alias("_m")).filter(F.col("_m") > bucket)
        often = [r.k for r in often.groupBy("k").agg(F.max("_m").alias("_m")).orderBy(F.desc("_m"), "k").limit(LATE).collect()]
        known = set(behind)
        # the most frequent last of all; what an earlier round put last stays before, so that prefixes without a new key hold
        new = [k for k in often if k not in known][: LATE - len(behind)][::-1]
        if not new:
            break
        behind = behind + new
        held = stars.join(_holders(stars.select(F.col("u").alias("_first"), F.col("v").alias("_f"), F.col("e").alias("_p")), new, "long").select(F.col("_first").alias("u"), F.col("_f").alias("v"), F.lit(True).alias("_moves")), ["u", "v"], "left")
        held = written(held, "stars")
        again = held.filter("_moves").join(single.select(F.col("_f").alias("u"), F.col("_n").alias("n")), "u").select("u", "v", "n", "m", F.lit(True).alias("star"))
        stars = held.filter(F.col("_moves").isNull()).drop("_moves").unionByName(verified(again, first, texts, behind))
        if turn == 0:  # from now on by better centres, which the old ones meet like all others
            size = single.select(F.col("_f").alias("v"), F.col("_n").alias("m"))
            members = stars.select("u", "v", "m").unionByName(stars.select("u", F.col("u").alias("v")).distinct().join(size, "v").select("u", "v", "m"))
            best = stars.groupBy("u").agg(F.min(F.struct("r", "d", "v", "m")).alias("_b")).select(F.bitwise_not("u").alias("_x"), "_b")
            moved = members.join(best, (F.bitwise_not("u") == F.col("_x")) & (F.col("v") != F.col("_b.v")))
            moved = moved.select(F.col("_b.v").alias("u"), "v", F.col("_b.m").alias("n"), "m", F.lit(True).alias("star")).distinct()
            stars = verified(moved, first, texts, behind)
            met = met.unionByName(stars.filter("near").select("u", "v"))
    comp = components(met).select(F.col("v").alias("_f"), F.col("u").alias("_root"))
    entry = stars.join(comp, F.col("v") == F.col("_f"), "left").select("u", "v", "m", "d", F.coalesce("_root", "v").alias("_root"), F.posexplode("e").alias("p", "k"))
    entry = written(entry, "differences")
    mixed = entry.groupBy("u", "k").agg(F.min("_root").alias("_a"), F.max("_root").alias("_b")).filter("_a <> _b").select(F.col("u").alias("_u"), F.bitwise_not("k").alias("_x"))
    entry = durable(entry.join(mixed, (F.col("u") == F.col("_u")) & (F.bitwise_not("k") == F.col("_x"))).select("u", "k", "v", "m", "d", "p", "_root"))
    other = entry.select(F.col("u").alias("_u"), F.bitwise_not("k").alias("_x"), F.col("v").alias("v2"), F.col("m").alias("m2"), F.col("d").alias("d2"), F.col("p").alias("p2"), F.col("_root").alias("_root2"))
    # a shared difference in places p and p2 can be the first of as many as must be shared
    must = F.greatest(F.lit(1), F.ceil((F.col("d") + F.col("d2") - F.floor((F.col("m") + F.col("m2")) / 9)) / 2))
    early = (F.col("d") - F.col("p") >= must) & (F.col("d2") - F.col("p2") >= must)
    apart = (F.col("v") < F.col("v2")) & (F.col("_root") != F.col("_root2")) & _near_sizes(F.col("m"), F.col("m2"))
    cross = entry.join(other, (F.col("u") == F.col("_u")) & (F.bitwise_not("k") == F.col("_x")) & apart & early)
    cross = cross.select(F.col("v").alias("u"), F.col("v2").alias("v"), F.col("m").alias("n"), F.col("m2").alias("m"), F.lit(False).alias("star")).distinct()
    return met.unionByName(verified(cross, first, texts).select("u", "v"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """The rows of ``docs``, all columns, but those of a group of near copies that are not its least id."""
    fp = written(fingerprints(docs, id_col, text_col), "prefixes")
    single = written(fp.groupBy("_f").agg(F.min("_id").alias("_first"), F.first("_n").alias("_n"), F.first("_p").alias("_p")), "single")
    least = single.select("_f", "_first")
    comp = components(links(single, Texts(docs, id_col, text_col), bucket))
    rooted = least.join(comp.select(F.col("v").alias("_f"), F.col("u").alias("_root")), "_f", "left").select("_f", "_first", F.coalesce("_root", "_f").alias("_root"))
    stays = rooted.groupBy("_root").agg(F.min("_first").alias("_stay"))
    named = rooted.join(stays, "_root").select("_f", "_stay")
    gone = fp.select("_id", "_f").join(named, "_f").filter(F.col("_id") != F.col("_stay")).select(F.col("_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
