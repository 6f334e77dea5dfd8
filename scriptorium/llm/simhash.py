"""SimHash near-duplicate classes by multi-index hashing.

1. Each text gets a fingerprint (Arrow batches; numpy hashes the shingles of many
   texts at once, those of one length together, and counts the bits of their XXH64
   hashes). From there on only distinct fingerprints move, so a
   group of exact copies, whatever its size, is one row.
2. Multi-index hashing: a fingerprint has two 32-bit segments. Two fingerprints
   within two bits differ by one bit at most in the first segment, or not at all
   in the second. Each enters the tables of both segments, probes the first with
   its Hamming ball of radius one (only 0 -> 1 flips: one of the two sides sees the
   other) and the second with itself; hits are verified on all 64 bits.
3. Buckets with more than ``BUCKET`` fingerprints (large groups of near copies)
   are not paired. Every fingerprint that is in such a bucket or probes one enters
   instead under all keys of its radius-one ball over all 64 bits: two fingerprints
   are within two bits if and only if these balls share a key, and all that share
   one are linked, so each is linked to the key's least member: a star, not pairs, of at
   most 65 members. This is exact, and linear in the number of fingerprints.
4. Components come from large-star/small-star rounds over the links, each round
   checkpointed to the shared folder. Nothing but counts reaches the driver.

Defined results: a null text, or one without words, has fingerprint zero, linked
like any other; fewer words than a shingle takes are one shingle; rows that
repeat a doc_id share its component; a null id is kept as a row and never names a
component unless its component has no other; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table, trimmed

SHINGLE, SEED, BITS, RADIUS = 3, 42, 64, 2
#: The largest bucket that is paired; larger ones take the exact way of step 3.
BUCKET = 32
#: Bytes of text whose shingles are hashed at once (longer texts go through ``fingerprint``), and of the longest shingle in an array.
AT_ONCE, LONGEST = 1_000_000, 160
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    import numpy as np
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()  # bytes: only A-Z change, only \x20 and \x09-\x0D split
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < shingle else map(b" ".join, zip(*(w[k:] for k in range(shingle)), strict=False))
    h = np.fromiter((xxh64_intdigest(g, SEED) for g in grams), dtype=np.uint64)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def _xxh64(data: bytes, starts, ends):
    """XXH64 of each ``data[start:end]``, by arrays of equal length."""
    import numpy as np
    from xxhash import xxh64_intdigest

    u, wrap = np.uint64, (1 << 64) - 1
    p1, p2, p3, p4, p5 = map(u, (_P1, _P2, _P3, _P4, _P5))
    padded = data + bytes(8)
    eight = np.ascontiguousarray(np.ndarray(len(data) + 1, np.uint64, padded, strides=(1,)))  # the eight bytes from each place on

    def turned(x, k: int):
        return (x << u(k)) | (x >> u(64 - k))

    def mixed(lane):
        return turned(lane * p2, 31) * p1

    out, sizes = np.empty(len(starts), dtype=u), ends - starts
    order = np.argsort(np.minimum(sizes, LONGEST + 1).astype(np.uint8), kind="stable")
    bounds = np.cumsum(np.bincount(np.minimum(sizes, LONGEST + 1), minlength=LONGEST + 2))
    for size in range(1, LONGEST + 1):
        own = order[bounds[size - 1] : bounds[size]]
        if not len(own):
            continue
        s, at = starts[own], 0
        if size >= 32:
            v = [np.full(len(own), (SEED + x) & wrap, dtype=u) for x in (_P1 + _P2, _P2, 0, -_P1)]
            for at in range(0, size - 31, 32):
                v = [turned(x + eight.take(s + (at + 8 * k)) * p2, 31) * p1 for k, x in enumerate(v)]
            at += 32
            h = turned(v[0], 1) + turned(v[1], 7) + turned(v[2], 12) + turned(v[3], 18)
            for x in v:
                h = (h ^ mixed(x)) * p1 + p4
            h += u(size)
        else:
            h = np.full(len(own), (SEED + _P5 + size) & wrap, dtype=u)
        while size - at >= 8:
            h = turned(h ^ mixed(eight.take(s + at)), 27) * p1 + p4
            at += 8
        if size > at:
            rest = eight.take(s + at)
            if size - at >= 4:
                h = turned(h ^ ((rest & u(0xFFFFFFFF)) * p1), 23) * p2 + p3
                rest >>= u(32)
                at += 4
            for k in range(size - at):
                h = turned(h ^ (((rest >> u(8 * k)) & u(255)) * p5), 11) * p1
        h = (h ^ (h >> u(33))) * p2
        h = (h ^ (h >> u(29))) * p3
        out[own] = h ^ (h >> u(32))
    for k in order[bounds[LONGEST] :].tolist():
        out[k] = xxh64_intdigest(data[starts[k] : ends[k]], SEED)
    return out


def _at_once(texts: list[bytes], counts: list[int], shingle: int) -> list[int]:
    """The fingerprints of texts of ``shingle`` to 65,535 words each, ``counts``, with one space between words."""
    import numpy as np

    data = b" ".join(texts)
    gaps = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 32)
    starts, ends = np.append(0, gaps + 1), np.append(gaps, len(data))
    n = np.array(counts)
    grams = n - (shingle - 1)
    first = np.cumsum(grams) - grams
    at = np.arange(grams.sum()) + np.repeat((np.cumsum(n) - n) - first, grams)
    h = _xxh64(data, starts[at], ends[at + shingle - 1])
    ones = np.empty((len(n), 4, 16), dtype=np.int64)
    for k in range(16):  # four counters of 16 bits each in a number
        ones[:, :, k] = np.add.reduceat((h >> np.uint64(k)) & np.uint64(0x0001000100010001), first).view(np.uint16).reshape(-1, 4)
    return np.packbits(2 * ones.reshape(-1, BITS) > grams[:, None], axis=1, bitorder="little").view(np.uint64).ravel().tolist()


def fingerprints_of(texts: Iterable[bytes | None], shingle: int = SHINGLE) -> list[int]:
    """``fingerprint`` of each of the UTF-8 texts."""
    out, own, held, counts, size = [], [], [], [], 0

    def done() -> None:
        for k, f in zip(own, _at_once(held, counts, shingle) if own else [], strict=True):
            out[k] = f
        for x in (own, held, counts):
            x.clear()

    for t in texts:
        w = (t or b"").lower().split() if len(t or b"") <= AT_ONCE else []
        if not shingle <= len(w) < 65536:
            out.append(fingerprint((t or b"").decode(), shingle))
            continue
        own.append(len(out))
        out.append(0)
        held.append(b" ".join(w))
        counts.append(len(w))
        size += len(held[-1])
        if size >= AT_ONCE:
            done()
            size = 0
    done()
    return out


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """``_id, _fp``: the fingerprint as a signed 64-bit number."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = fingerprints_of((t.as_buffer().to_pybytes() if t.is_valid else None for t in b.column(1)), shingle)
            yield pa.record_batch([b.column(0), pa.array([f - (1 << 64) if f >> 63 else f for f in fps], pa.int64())], names=["_id", "_fp"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).mapInArrow(trimmed(run), f"_id {kind}, _fp long")


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``u < v`` for distinct fingerprints ``_fp`` such that the links' components are those
    of all pairs within two bits."""
    first = F.shiftrightunsigned("_fp", 32)
    second = F.col("_fp").bitwiseAND(F.lit(0xFFFFFFFF))
    seg = fps.select("_fp", F.explode(F.array(F.struct(F.lit(0).alias("s"), first.alias("k")), F.struct(F.lit(1).alias("s"), second.alias("k")))).alias("_e")).select("_fp", "_e.s", "_e.k")
    one = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.call_function("shiftrightunsigned", F.col("_fp"), i + 32).bitwiseAND(F.lit(1)) == 0)
    ball = F.transform(one, lambda i: F.struct(F.lit(0).alias("s"), first.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)).alias("k")))
    probes = fps.select("_fp", F.explode(ball).alias("_e")).select(F.col("_fp").alias("_q"), F.col("_e.s").alias("s"), F.col("_e.k").alias("k"))
    # equal segments pair up inside the bucket, so the tables double as the probes of radius zero
    sizes = seg.groupBy("s", "k").agg(F.count("*").alias("_m"), F.min("_fp").alias("_least"))
    hot = sizes.filter(F.col("_m") > bucket).select("s", "k")
    small = seg.join(hot, ["s", "k"], "left_anti").groupBy("s", "k").agg(F.collect_list("_fp").alias("_members"))
    apart = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= RADIUS
    inside = small.filter(F.size("_members") > 1).select(F.explode("_members").alias("u"), "_members").select("u", F.explode("_members").alias("v")).filter((F.col("u") < F.col("v")) & apart(F.col("u"), F.col("v")))
    across = probes.join(small.filter(F.col("s") == 0), ["s", "k"]).select(F.col("_q").alias("a"), F.explode("_members").alias("b")).filter(apart(F.col("a"), F.col("b")))
    found = inside.select("u", "v").unionByName(across.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")))
    # the exact way for hot buckets: members and those that probe them
    touched = seg.join(hot, ["s", "k"], "left_semi").select("_fp").unionByName(probes.join(hot, ["s", "k"], "left_semi").select(F.col("_q").alias("_fp"))).distinct()
    whole = F.concat(F.array(F.col("_fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("_fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    keyed = touched.select("_fp", F.explode(whole).alias("k"))
    stars = keyed.groupBy("k").agg(F.sort_array(F.collect_list("_fp")).alias("_m")).filter(F.size("_m") > 1)
    stars = stars.select(F.element_at("_m", 1).alias("u"), F.explode(F.slice("_m", F.lit(2), F.size("_m"))).alias("v"))
    return found.unionByName(stars).distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as stars around the least member: the same components, at most one link a node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        r = x
        while (p := parent.get(r, r)) != r:
            r = p
        while (p := parent.get(x, x)) != r:
            parent[x], x = r, p
        return r

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = root(u), root(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
    nodes = [x for x in parent if parent[x] != x]
    for at in range(0, len(nodes), 65536):
        part = nodes[at : at + 65536]
        yield pa.record_batch([pa.array([root(x) for x in part], pa.int64()), pa.array(part, pa.int64())], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """``v, u``: every node of ``edges`` (u, v) but the least of its component, with that least node.

    Alternates large-star and small-star until a round changes nothing; the
    number of rounds grows with the logarithm of the nodes."""
    e = durable(edges.select("u", "v").mapInArrow(trimmed(_forest), "u long, v long"))
    while True:
        if e.isEmpty():
            return e.select("v", "u")
        # large star: neighbours above a node go to the least around it
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("m").alias("u"), "v").distinct()
        # small star: a node's lower neighbours, and itself, go to the least of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").filter(F.col("u") != F.col("m")).select(F.col("m").alias("u"), F.col("u").alias("v"))
        nxt = durable(small.unionByName(low.select(F.col("m").alias("u"), "v")).distinct())
        # done when every node hangs on one node that hangs on none
        stray = nxt.groupBy("v").agg(F.min("u").alias("u"), F.count("*").alias("n"))
        if stray.filter(F.col("n") > 1).isEmpty() and nxt.join(nxt.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            return nxt.select("v", "u")
        e = nxt


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """One row a row of ``docs``: id, ``fingerprint`` (16 hex digits), ``component_id``."""
    fp = durable(fingerprints(docs, id_col, text_col, shingle))
    least = fp.groupBy("_fp").agg(F.min("_id").alias("_first"))
    comp = components(links(fp.select("_fp").distinct(), bucket))
    comp = comp.select(F.col("v").alias("_fp"), F.col("u").alias("_root"))
    rooted = least.join(comp, "_fp", "left").select("_fp", "_first", F.coalesce("_root", "_fp").alias("_root"))
    smallest = rooted.groupBy("_root").agg(F.min("_first").alias("component_id"))
    named = rooted.join(smallest, "_root").select("_fp", "component_id")
    return fp.join(named, "_fp").select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, but those of a component that are not its least id. Rows with a null
    id stay; of rows that repeat an id, all stay if one of them does."""
    named = near_duplicates(docs, id_col, text_col)
    gone = named.groupBy(F.col(id_col).alias("_gone")).agg(F.bool_and(F.col(id_col) != F.col("component_id")).alias("_all")).filter("_all").select("_gone")
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
