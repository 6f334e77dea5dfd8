"""Exact substring dedup with suffix arrays by induced sorting, in shards.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts elsewhere.

1. Every window of ``LENGTH`` bytes has a key that depends on its bytes alone: the
   least hash of its grams. Neighbouring windows share keys, so a text falls into
   segments (one key, some 80 windows, about 280 bytes). Windows that are equal
   have equal keys; a key that one segment of the corpus has, with one place of the least gram, holds no repeat. Keys
   are counted first (pre-summed in each task), then segments with repeated keys
   are kept. So equal windows always meet, whichever documents they are in.
2. Segments with equal bytes are one from here on: large groups of copies shrink
   to a row, all of whose windows are repeats.
3. Keys with several different segments, or one that may repeat itself, are sent to shards by key. A shard
   leaves out what cannot be equal to another window (around the least gram it differs from every other segment
   of its key), concatenates the rest and builds their suffix array by induced sorting:
   classify suffixes, sort the leftmost-smaller (LMS) substrings by inducing, name
   them, sort the string of names by the same procedure again, induce the array; then each suffix's common
   prefix with its predecessor, in text order. Bytes are induced bucket by bucket in numpy, whose stable sort of sixteen-bit
   values is a radix sort; names have wide alphabets and are induced by plain scans. All steps are linear.
4. A key with more than ``GROUP`` different segments (a passage in very many
   contexts) is not sent to one shard: its windows are counted by 128-bit hash.
5. Repeats return to all places of their segments and are merged per document.

Defined results: a null text is empty; texts under ``LENGTH`` bytes lose nothing;
rows that repeat id and text are one document, reported for each row, and do not
repeat each other; rows that share an id but not the text are different
documents; a null id is an id; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, trimmed, trimmed_group, written

LENGTH, GRAM = 200, 40
#: Window starts of a segment at most; bytes handled at a time, and hashed at a time; segments of a key in one shard; bytes of a shard, about;
#: places of the least gram that are looked at together.
STARTS, CHUNK, BLOCK, GROUP, SHARD_BYTES, SPAN = 512, 500_000, 48_000, 5000, 700_000, 40
_P, _M = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def _keys(data, length: int):
    """``keys`` of one block: its numbers are to stay in the processor's cache."""
    import numpy as np

    gram = min(GRAM, length)
    h, n = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(_M), 1
    done, size, p = None, 0, _P
    while True:
        if gram & n:
            if done is None:
                done = h
            else:
                m = min(len(done), len(h) - size)
                done = done[:m] * np.uint64(p) + h[size : size + m]
            size += n
        if size == gram:
            break
        h = h[: len(h) - n] * np.uint64(p) + h[n:]
        n, p = 2 * n, p * p % (1 << 64)
    g = done[: len(data) - gram + 1]
    g = (g ^ (g >> np.uint64(31))) * np.uint64(_M)
    g ^= g >> np.uint64(29)
    wide, n, grams = length - gram + 1, 1, g
    while 2 * n <= wide:
        g, n = np.minimum(g[: len(g) - n], g[n:]), 2 * n
    return (np.minimum(g[: len(g) - (wide - n)], g[wide - n :]) if wide > n else g), grams


def keys(data, length: int = LENGTH):
    """The key of the window at each start of ``data`` (uint8), and the hashes of the grams."""
    import numpy as np

    n = len(data) - length + 1
    if n <= BLOCK:
        return _keys(data, length)
    k, grams = np.empty(n, dtype=np.uint64), np.empty(len(data) - min(GRAM, length) + 1, dtype=np.uint64)
    for at in range(0, n, BLOCK):
        own, g = _keys(data[at : at + BLOCK + length - 1], length)
        k[at : at + len(own)], grams[at : at + len(g)] = own, g
    return k, grams


def segments(data, offsets, length: int = LENGTH):
    """``(doc, start, windows, key, alike)`` arrays of the segments of the texts between ``offsets`` in
    ``data``. ``alike``: windows of one segment may be equal. They are only if the leftmost least
    gram is another one in its last window than in its first."""
    import numpy as np

    out = []
    last = len(data) - length
    for at in range(0, last + 1, CHUNK):
        k, grams = keys(data[at : min(len(data), at + CHUNK + length - 1)], length)
        new = np.ones(len(k), dtype=bool)
        new[1:] = k[1:] != k[:-1]
        new[offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, at + len(k))] - at] = True
        first = np.flatnonzero(new)
        parts = -(-np.diff(np.append(first, len(k))) // STARTS)  # periodic text keeps a key for long
        first = np.repeat(first, parts) + STARTS * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        doc = np.searchsorted(offsets, first + at, side="right") - 1
        many = np.minimum(np.append(first[1:], len(k)), offsets[doc + 1] - length + 1 - at) - first  # windows that end within the text come first
        ok = many > 0
        doc, first, many = doc[ok], first[ok], many[ok]
        least, most = _least_grams(grams, first, many, length)
        out.append((doc, first + at - offsets[doc], many, k[first], least != most))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, dtype=np.int64)] * 3 + [np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)]


def _least_grams(grams, first, many, length: int = LENGTH):
    """The places of the leftmost least gram of the first and of the last of ``many`` windows from ``first``."""
    import numpy as np

    view = np.lib.stride_tricks.sliding_window_view(grams, length - min(GRAM, length) + 1)
    return view[first].argmin(axis=1) + first, view[first + many - 1].argmin(axis=1) + first + many - 1


def _bytes(col):
    """Data and offsets of a binary column without nulls."""
    import numpy as np

    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def _key_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    held, size = [], 0
    for b in batches:
        *_, k, alike = segments(*_bytes(b.column(0)))
        k = np.concatenate([k, k[alike]])
        held.append(k)
        size += len(k)
        if size > 2_000_000:
            yield _counted(np.concatenate(held))
            held, size = [], 0
    if size:
        yield _counted(np.concatenate(held))


def _counted(k) -> pa.RecordBatch:
    import numpy as np

    v, n = np.unique(k, return_counts=True)
    return pa.record_batch([pa.array(v.view(np.int64)), pa.array(n)], names=["v", "n"])


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np
    from xxhash import xxh3_64_intdigest

    for b in batches:
        data, off = _bytes(b.column(2))
        doc, start, many, key, alike = segments(data, off)
        raw, at = data.tobytes(), off[doc] + start
        d = np.fromiter((xxh3_64_intdigest(raw[a : a + n]) for a, n in zip(at.tolist(), (many + LENGTH - 1).tolist(), strict=True)), dtype=np.uint64, count=len(at))
        ix = pa.array(doc)
        yield pa.record_batch([b.column(0).take(ix), b.column(1).take(ix), pa.array(key.view(np.int64)), pa.array(d.view(np.int64)), pa.array(start), pa.array(many.astype(np.int32)), pa.array(alike)], names=["id", "c", "v", "d", "s", "n", "alike"])


def _types(t):
    """Which suffixes of ``t`` are smaller than the next one (the last is), and the leftmost of each run of these."""
    import numpy as np

    n = len(t)
    step = np.sign(t[1:].astype(np.int64) - t[:-1].astype(np.int64))
    nxt = np.where(step != 0, np.arange(n - 1), n)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    small = np.append(step[np.minimum(nxt, n - 2)] > 0, True)
    return small, np.flatnonzero(small[1:] & ~small[:-1]) + 1


def _named(t, lms, ordered):
    """Names of the LMS substrings, in text order, from their sorted order: equal ones (equal length and equal hash) share a name."""
    import numpy as np

    n = len(t)
    power = np.multiply.accumulate(np.append(np.uint64(1), np.full(n, _P, dtype=np.uint64)))
    with np.errstate(over="ignore"):
        mixed = (t.astype(np.uint64) + np.uint64(3)) * np.uint64(_M)
        mixed ^= mixed >> np.uint64(29)
        total = np.append(np.uint64(0), np.cumsum(mixed * power[:n], dtype=np.uint64))
        inverse = pow(_P, -1, 1 << 64)
        back = np.multiply.accumulate(np.append(np.uint64(1), np.full(n, inverse, dtype=np.uint64)))
        end = np.append(lms[1:], n - 1) + 1
        hashed = (total[end] - total[lms]) * back[lms]
    place = np.zeros(n, dtype=np.int64)
    place[lms] = np.arange(len(lms))
    ix, size = place[ordered], end - lms
    new = np.ones(len(ix), dtype=np.int64)
    new[1:] = (hashed[ix[1:]] != hashed[ix[:-1]]) | (size[ix[1:]] != size[ix[:-1]])
    rank = np.empty(len(ix), dtype=np.int64)
    rank[ix] = np.cumsum(new) - 1
    return rank, ix


def _names_sorted(t):
    """The suffix array of names ``t`` (the last is 0 and occurs once) by induced sorting, recursively. Names have wide
    alphabets, for which plain scans are faster than a call of numpy for each bucket."""
    import numpy as np

    n, k = len(t), int(t.max()) + 1
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    small, lms = _types(t)
    end = np.cumsum(np.bincount(t, minlength=k))
    tails, heads = end.tolist(), (end - np.bincount(t, minlength=k)).tolist()
    own = t.tolist()
    before_large = bytes(np.concatenate([[0], ~small[:-1], [0]]).astype(np.uint8))  # by place; -1, an empty slot, reads the last
    before_small = bytes(np.concatenate([[0], small[:-1], [0]]).astype(np.uint8))

    def induce(order):
        sa = [-1] * n
        at = tails.copy()
        for i in order[::-1].tolist():
            x = own[i]
            at[x] -= 1
            sa[at[x]] = i
        at = heads.copy()
        for i in sa:  # sees what it puts ahead
            if before_large[i]:
                x = own[i - 1]
                sa[at[x]] = i - 1
                at[x] += 1
        at = tails.copy()
        for i in reversed(sa):
            if before_small[i]:
                x = own[i - 1]
                at[x] -= 1
                sa[at[x]] = i - 1
        return np.array(sa, dtype=np.int64)

    if len(lms) < 2:
        return induce(lms)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    sa = induce(lms)
    rank, ix = _named(t, lms, sa[is_lms[sa]])
    if rank[ix[-1]] < len(ix) - 1:
        ix = _names_sorted(rank)
    return induce(lms[ix])


def suffix_array(t, k: int):
    """The suffix array of ``t`` (values below ``k``, at most sixteen bits; the last is 0 and occurs once) by induced sorting."""
    import numpy as np

    n = len(t)
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    small, lms = _types(t)
    count = np.bincount(t, minlength=k)
    tail = np.cumsum(count)
    head = tail - count
    present = np.flatnonzero(count)

    def induce(order):
        sa = np.full(n, -1, dtype=np.int64)
        c = t[order]
        by = np.argsort(c, kind="stable")
        own = np.bincount(c, minlength=k)
        sa[np.concatenate([np.arange(b - m, b) for b, m in zip(tail[own > 0].tolist(), own[own > 0].tolist(), strict=True)])] = order[by]
        up = head.copy()

        def put(batch, ptr, want, sign):
            j = batch[batch > 0] - 1
            j = j[small[j] == want]
            if len(j):
                ch = t[j]
                o = np.argsort(ch, kind="stable")
                ch, j = ch[o], j[o]
                m = np.bincount(ch, minlength=k)
                rank = np.arange(len(j)) - (np.cumsum(m) - m)[ch]
                sa[ptr[ch] + rank if sign > 0 else ptr[ch] - 1 - rank] = j
                ptr += sign * m

        for x in present.tolist():
            i = head[x]
            while i < up[x]:
                i, a = up[x], i
                put(sa[a:i], up, False, 1)
            if own[x]:
                put(sa[tail[x] - own[x] : tail[x]], up, False, 1)
        down = tail.copy()
        for x in present[::-1].tolist():
            i = tail[x]
            while i > down[x]:
                i, b = down[x], i
                put(sa[i:b][::-1], down, True, -1)
            put(sa[head[x] : up[x]][::-1], down, True, -1)
        sa[0] = n - 1
        return sa

    sa = induce(lms)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]]
    rank, ix = _named(t, lms, ordered)
    # the string of names is sorted in the same way; its last name, the terminator's, is 0 and occurs once
    if rank[ix[-1]] < len(ix) - 1:
        ix = _names_sorted(rank)
    return induce(lms[ix])


def common_prefixes(t, sa, depth: int = LENGTH):
    """For each place of ``t`` (uint8), whether its suffix shares ``depth`` values or more with its
    predecessor in ``sa``: permuted common prefixes, compared eight bytes at a time, cut at ``depth``."""
    import numpy as np

    n = len(t)
    phi = np.full(n, -1, dtype=np.int64)
    phi[sa[1:]] = sa[:-1]
    alive = np.flatnonzero((phi >= 0) & (np.arange(n) + depth <= n) & (phi + depth <= n))
    padded = np.append(t, np.zeros(8, dtype=np.uint8))
    words = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), shape=(n + 1,), strides=(1,))
    for at in [*range(0, depth - 7, 8), depth - 8]:
        alive = alive[words[alive + at] == words[phi[alive] + at]]
    out = np.zeros(n, dtype=bool)
    out[alive] = True
    return out, phi


def repeats(texts: list[bytes], depth: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each text the runs ``[a, b)`` of starts whose window of ``depth`` bytes also starts elsewhere in ``texts``."""
    import numpy as np

    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    size = np.array([len(x) for x in texts])
    end = np.cumsum(size + 1)
    begin = end - size - 1
    t = np.ones(int(end[-1]) + 1, dtype=np.uint16)  # 1 between texts, 0 at the end
    mask = np.ones(len(t), dtype=bool)
    mask[end - 1] = mask[-1] = False
    t[mask] = raw.astype(np.uint16) + 2
    t[-1] = 0
    sa = suffix_array(t, 258)
    plain = np.zeros(len(t), dtype=np.uint8)
    plain[mask] = raw
    same, phi = common_prefixes(plain, sa, depth)
    # windows that leave their text are none
    owner = np.repeat(np.arange(len(texts)), size + 1)
    whole = np.zeros(len(t), dtype=bool)
    whole[:-1] = np.arange(len(t) - 1) + depth <= begin[owner] + size[owner]
    same &= whole
    at = np.flatnonzero(same)
    at = at[whole[phi[at]]]
    hit = np.zeros(len(t), dtype=bool)
    hit[at] = hit[phi[at]] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        k = int(owner[a])
        out[k].append((a - int(begin[k]), b - int(begin[k])))
    return out


_RUNS = pa.schema([("v", pa.int64()), ("d", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])


def _runs_table(rows: list[tuple[int, int, int, int]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, _RUNS, strict=True)], schema=_RUNS)


def candidates(v: list[int], texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, bytes]]:
    """``(k, start, part)``: of segments ``texts`` with keys ``v``, the parts that hold every window equal to another one.

    Equal windows have their leftmost least gram at the same place. Windows that have it at one of ``SPAN`` neighbouring
    places share the bytes around it that all of these cover; a segment whose shared bytes no other segment of its key
    has, has no equal window there. Keys with a segment that may repeat itself stay whole."""
    import numpy as np

    if not texts:
        return []
    gram = min(GRAM, length)
    size = np.array([len(x) for x in texts])
    begin = np.cumsum(size) - size
    least, most = _least_grams(keys(np.frombuffer(b"".join(texts), dtype=np.uint8), length)[1], begin, size - length + 1, length)
    alike = {v[k] for k in np.flatnonzero(least != most).tolist()}
    spans = [(lo, min(lo + SPAN - 1, length - gram)) for lo in range(0, length - gram + 1, SPAN)]
    shared: dict[tuple[int, int, bytes], list[int]] = {}
    place = (least - begin).tolist()
    for k, (p, x) in enumerate(zip(place, texts, strict=True)):
        if v[k] not in alike:
            for lo, hi in spans:
                if p >= lo and p + length - hi <= len(x):
                    shared.setdefault((v[k], lo, x[p - lo : p + length - hi]), []).append(k)
    reach = {k: (0, len(x)) for k, x in enumerate(texts) if v[k] in alike}
    for (_, lo, _), held in shared.items():
        if len(held) > 1:
            for k in held:
                a, b = max(0, place[k] - min(lo + SPAN - 1, length - gram)), min(len(texts[k]), place[k] + length - lo)
                was = reach.get(k, (a, b))
                reach[k] = (min(a, was[0]), max(b, was[1]))
    return [(k, a, texts[k][a:b]) for k, (a, b) in sorted(reach.items())]


def _shard(t: pa.Table) -> pa.Table:
    v, d = t.column("v").to_pylist(), t.column("d").to_pylist()
    parts = candidates(v, t.column("seg").to_pylist())
    found = repeats([x for *_, x in parts]) if parts else []
    return _runs_table([(v[k], d[k], at + a, at + b) for (k, at, _), runs in zip(parts, found, strict=True) for a, b in runs])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest

    for b in batches:
        for v, d, seg in zip(*(c.to_pylist() for c in b.columns), strict=True):
            n = len(seg) - LENGTH + 1
            yield pa.record_batch([pa.array([v] * n, pa.int64()), pa.array([d] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([xxh3_128_digest(seg[i : i + LENGTH]) for i in range(n)], pa.binary())], names=["v", "d", "a", "w"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    for b in batches:
        yield pa.record_batch([b.column(0), b.column(1), pa.array([zlib.compress(x.as_py(), 1) for x in b.column(2)], pa.binary())], names=["id", "c", "z"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    for b in batches:
        v, d, seg = [], [], []
        for z, ask in zip(b.column(0), b.column(1), strict=True):
            raw = zlib.decompress(z.as_py())
            for x in ask.as_py():
                v.append(x["v"])
                d.append(x["d"])
                seg.append(raw[x["s"] : x["s"] + x["n"] + LENGTH - 1])
        yield pa.record_batch([pa.array(v, pa.int64()), pa.array(d, pa.int64()), pa.array(seg, pa.binary())], names=["v", "d", "seg"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    for b in batches:
        size, gone, spans, text = [], [], [], []
        for z, runs in zip(b.column(1), b.column(2), strict=True):
            raw, at, cut, n, out = zlib.decompress(z.as_py()), 0, 0, 0, []
            for a, e in sorted((r["a"], r["b"]) for r in runs.as_py() or ()):
                e += LENGTH - 1
                if a > at or not n:
                    out.append(raw[at:a])
                    n += 1
                    cut += e - a
                else:
                    cut += max(0, e - at)
                at = max(at, e)
            out.append(raw[at:])
            size.append(len(raw))
            gone.append(cut)
            spans.append(n)
            text.append(b"".join(out))
        yield pa.record_batch([b.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(text, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept`` (the bytes that remain; they may end inside a character)."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("c"), text.cast("binary").alias("t"))
    often = src.select("t").mapInArrow(trimmed(_key_counts), "v long, n long").groupBy("v").agg(F.sum("n").alias("n")).filter("n > 1")
    away = lambda c: F.col(c).bitwiseXOR(F.lit(1))  # noqa: E731  as a join key it has both sides dealt anew, so that skew can be split
    places = src.mapInArrow(trimmed(_located), f"id {kind}, c long, v long, d long, s long, n int, alike boolean")
    places = places.join(often.select(away("v").alias("_v")), away("v") == F.col("_v"), "left_semi").distinct()
    places = written(places, "places")
    kinds = places.groupBy("v", "d").agg(F.count("*").alias("m"), F.min_by(F.struct("id", "c", "s", "n"), F.struct("c", "s")).alias("at"), F.max("alike").alias("alike"))
    per_key = kinds.groupBy("v").agg(F.count("*").alias("k"), F.max("alike").alias("alike")).filter("k > 1 or alike").select(F.col("v").alias("_v"), "k")
    ask = kinds.select("v", "d", "at").join(per_key, F.col("v") == F.col("_v")).select("at.id", "at.c", F.struct("v", "d", F.col("at.s").alias("s"), F.col("at.n").alias("n")).alias("x"), "k")
    wanted = ask.groupBy("id", "c").agg(F.collect_list("x").alias("ask")).select(F.col("id").alias("_i"), F.col("c").alias("_c"), "ask")
    packed = src.mapInArrow(trimmed(_pack), f"id {kind}, c long, z binary")
    here: Column = F.col("id").eqNullSafe(F.col("_i")) & (F.col("c") == F.col("_c"))
    # rows that repeat a document would cut its segments twice
    cut = packed.join(wanted, here).select("z", "ask").mapInArrow(trimmed(_cut), "v long, d long, seg binary").dropDuplicates(["v", "d"])
    segs = written(cut.join(per_key, F.col("v") == F.col("_v")).select("v", "d", "seg", "k"), "segments")
    size = segs.filter(F.col("k") <= group).agg(F.sum(F.length("seg"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    found = segs.filter(F.col("k") <= group).select("v", "d", "seg", F.pmod(F.xxhash64("v"), F.lit(shards)).alias("shard"))
    found = found.repartition(shards, "shard").groupBy("shard").applyInArrow(trimmed_group(_shard), "v long, d long, a int, b int")
    win = segs.filter(F.col("k") > group).select("v", "d", "seg").mapInArrow(trimmed(_windows), "v long, d long, a int, w binary")
    twice = win.groupBy("w").agg(F.count("*").alias("n")).filter("n > 1").select(F.concat("w", F.lit(b"")).alias("_w"))
    by_hash = win.join(twice, F.concat("w", F.lit(b"")) == F.col("_w"), "left_semi").select("v", "d", "a", (F.col("a") + 1).alias("b"))
    whole = kinds.filter("m > 1").select("v", "d", F.lit(0).alias("a"), F.col("at.n").alias("b"))
    cover = whole.unionByName(found).unionByName(by_hash).groupBy("v", "d").agg(F.collect_list(F.struct("a", "b")).alias("r"))
    cover = cover.select(away("v").alias("_v"), F.col("d").alias("_d"), "r")
    runs = places.join(cover, (away("v") == F.col("_v")) & (F.col("d") == F.col("_d"))).select("id", "c", F.col("s"), F.explode("r").alias("r"))
    runs = runs.groupBy("id", "c").agg(F.collect_list(F.struct((F.col("s") + F.col("r.a")).alias("a"), (F.col("s") + F.col("r.b")).alias("b"))).alias("runs"))
    runs = runs.select(F.col("id").alias("_i"), F.col("c").alias("_c"), "runs")
    out = packed.join(runs, here, "left").select("id", "z", "runs").mapInArrow(trimmed(_kept), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("id", id_col)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
