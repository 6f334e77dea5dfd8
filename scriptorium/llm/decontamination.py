"""Benchmark decontamination by pigeonhole edit matching.

Texts are normalised (lower case; runs of all but letters and digits are one
blank). An item of m characters has an error budget of k = floor(m * share)
edits and is cut into k + 1 pieces; a passage within k edits of the item holds
one piece at least unchanged. One pass of an Aho-Corasick automaton over each
whole text finds all exact piece hits; hits whose item would begin within k of
one another share a window, and each window is verified by Myers' bit-parallel
distance (the item as pattern, any end in the window).

Documents never move: each is matched where it is read, so neither a hot source
nor a long text nor a passage in every document shifts load elsewhere. The
benchmark goes to the tasks in blocks of at most ``BLOCK_CHARS`` characters, a
pass for each block, so what is sent is bounded however large the benchmark is.

Items with fewer than ``WHOLE`` normalised characters are matched as they are, as whole words: within one or no
edits they would be found inside other words. They are searched with ``min_chars=1``, as the query does; by default, and
in ``decontaminate``, they are left out, since ordinary text holds them.

Defined results: null or empty texts match nothing; items without a letter or digit (null ones too) match nothing; items that repeat an id and text count once; rows
that repeat a document repeat its matches; empty tables give an empty result;
other columns of both tables are not read, or kept whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import durable, table, trimmed

SHARE, WHOLE, BLOCK_CHARS = 0.06, 30, 1_000_000
_GAP = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return _GAP.sub(" ", (text or "").lower()).strip()


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` pieces of about the same length with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of ``text``, and where the first such substring ends."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp, hn = vn | ~(d0 | vp) & full, d0 & vp
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = hp << 1 & full, hn << 1 & full  # a match may begin anywhere: row zero stays zero
        vp, vn = hn | ~(d0 | hp) & full, d0 & hp
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """Finds items in normalised texts; those shorter than ``whole`` as whole words only."""

    def __init__(self, items: list[tuple], share: float, whole: int = WHOLE):
        import ahocorasick

        self.items, at = [], {}
        for key, text in items:
            short = len(text) < whole
            k = 0 if short else int(len(text) * share)
            if short:
                text = f" {text} "
            for off, piece in pieces(text, k):
                at.setdefault(piece, []).append((len(self.items), off))
            self.items.append((key, text, k, masks(text), short))
        self.auto = ahocorasick.Automaton()
        for piece, where in at.items():
            self.auto.add_word(piece, (len(piece), where))
        self.auto.make_automaton() if at else None
        self.any = bool(at)

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """``(item, distance, end)`` of the best match of each item within its budget."""
        if not self.any:
            return []
        starts: dict[int, set[int]] = {}
        text = f" {text} "
        for end, (n, where) in self.auto.iter(text):
            for i, off in where:
                starts.setdefault(i, set()).add(end + 1 - n - off)
        out = []
        for i, found in starts.items():
            key, item, k, peq, short = self.items[i]
            m, best, stop = len(item), k + 1, -1
            if short:  # one piece, hit as it is: the first hit, without the blanks around it
                out.append((key, 0, min(found) + m - 2))
                continue
            order, at = sorted(found), 0
            while at < len(order) and best:
                lo = hi = order[at]
                while at < len(order) and order[at] <= hi + 2 * k + 1 and order[at] - lo <= 4 * m:
                    hi, at = order[at], at + 1
                a = max(0, lo - k)
                if text.startswith(item, max(0, lo)):
                    best, stop = 0, max(0, lo) + m
                    break
                got, end = myers(peq, m, text[a : hi + m + k])
                if got < best:
                    best, stop = got, a + end
            if best <= k:
                out.append((key, best, min(max(stop - 1, 0), len(text) - 2)))
        return out


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
            share: float = SHARE, min_chars: int = WHOLE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``id_col, item_id, distance, end_at``: each item within its budget in each document, the best
    match once; ``end_at`` is a place in the normalised text. Items with fewer than ``min_chars`` normalised characters are left out."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType
    bench = benchmark.select(F.col(item_col).alias("i"), F.col(item_text).alias("t")).filter(F.length("t") >= min_chars)
    total = bench.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-2 * total // block_chars) or 1 if total > block_chars else 1
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    schema, item_type = f"_id {kind}, item_id {item_kind.simpleString()}, distance int, end_at long", to_arrow_type(item_kind)

    def one(k: int) -> DataFrame:
        rows = bench.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect() if n > 1 else bench.collect()
        items = sorted({(r.i, t) for r in rows if len(t := normal(r.t)) >= min_chars}, key=lambda x: (x[0] is None, str(x[0]), x[1]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, share)
            for b in batches:
                ids, at, hits = b.column(0), [], []
                for row, t in enumerate(b.column(1)):
                    if t.is_valid:
                        for hit in matcher.find(normal(t.as_py())):
                            at.append(row)
                            hits.append(hit)
                key, dist, end = zip(*hits, strict=True) if hits else ((), (), ())
                yield pa.record_batch([ids.take(pa.array(at, pa.int64())), pa.array(key, item_type), pa.array(dist, pa.int32()), pa.array(end, pa.int64())], names=["_id", "item_id", "distance", "end_at"])

        return src.mapInArrow(trimmed(run), schema)

    found = one(0) if n == 1 else None
    for k in range(n if n > 1 else 0):  # block by block: the driver holds one at a time
        part = durable(one(k))
        found = part if found is None else found.unionByName(part)
    return found.select(F.col("_id").alias(id_col), "item_id", "distance", "end_at")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item within its budget. A row whose id
    is null is matched under null: rows with a null id go together."""
    leaks = matches(docs, benchmark, id_col, text_col, **how).select(F.col(id_col).alias("_leak")).distinct()
    return docs.join(leaks, docs[id_col].eqNullSafe(leaks["_leak"]), "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), min_chars=1)
