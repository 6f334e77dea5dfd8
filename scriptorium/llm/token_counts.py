"""Token counts without token ids.

The byte-level BPE splits a text into pre-tokens and never merges across them, so a text's token count is the
sum, over its distinct pre-tokens, of frequency times pieces.

1. Each task reads documents in parts of at most ``PART_DOCS`` and states, for each distinct pre-token of a
   part, which documents hold it how often. Pre-tokens go to buckets by hash; what a part has for a bucket is one
   compressed row: the words, and four bytes for each document that holds one.
2. Frequencies are dealt out by bucket, once. There each distinct pre-token is run through the tokenizer once, and this
   table of pieces is joined to the frequencies. A pre-token that more than a ``HOT`` part of a part's documents hold is dealt out
   under ``SALTS`` salts, and counted once for each, so that no task gets all rows of a word that everyone uses.
3. Products are summed by document, inside each task first, and meet by part.

No row has ids of tokens. Memory is a part of documents, the table of a bucket (there are ``BUCKETS`` for each shuffle partition) or
``SUMS`` sums. A part is named by its task's partition and its place there, so ``docs`` has to give the same
rows in the same order when a lost task is run again, as tables in files do.

Defined results: a null text counts as empty (0 tokens); other columns are not
read; rows are independent, so repeated rows give repeated results; a null id is an id;
an empty table gives an empty result. A column named like an output column is
replaced by the output.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import n_partitions, table, trimmed, trimmed_group

#: The split of GPT-2's byte-level pre-tokenizer (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?[^\s\w]+|\s+(?!\S)|\s+"

#: Texts made of these characters only are split by ``re``: there both engines
#: agree on letters, digits and blanks. All others go through the tokenizer's own splitter.
_PLAIN = re.compile(r"[\t\n\r\x20-\x5e\x60-\x7e¡-©«¬®¯°±´¶·¸»¿À-ɏ‐-‧‰-‾€]*")

#: Documents of a part at most (two to the power ``BITS``), and its characters, about.
BITS = 14
PART_DOCS, PART_CHARS = 1 << BITS, 3_000_000
#: The share of a part's documents from which on a pre-token is salted, and the number of salts.
HOT, SALTS = 1 / 16, 64
#: Buckets for a shuffle partition; sums that a task holds before it states them; pre-tokens handed to the tokenizer at once.
BUCKETS, SUMS, ONCE = 8, 4_000_000, 4096


class PieceCounter:
    """Pre-tokens of texts and pieces of pre-tokens for one tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.split = re.compile(SPLIT).findall
        self.own = self.tok.pre_tokenizer.pre_tokenize_str
        special = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def pre_tokens(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return self.split(text)
        return [text[a:b] for _, (a, b) in self.own(text)]

    def read(self, text: str) -> tuple[int, list[str]]:
        """How many special strings ``text`` holds (a token each), and the pre-tokens between them."""
        parts = [text] if self.special is None else self.special.split(text)
        return len(parts) - 1, [w for part in parts if part for w in self.pre_tokens(part)]

    def pieces(self, new: list[str]) -> list[int]:
        return [len(e) for e in self.tok.encode_batch(new, add_special_tokens=False)]

    def count(self, text: str) -> int:
        n, found = self.read(text)
        known = dict(zip(new := sorted(set(found)), self.pieces(new), strict=True))
        return n + sum(known[w] for w in found)


@functools.lru_cache(maxsize=1)
def counter_of(path: str) -> PieceCounter:
    """One for each worker: a tokenizer's memory does not come back."""
    return PieceCounter(path)


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _frequencies(path: str, kind: pa.DataType, buckets: int):
    """Batches (id, text) to rows ``bucket, part, words, n_words, held, n_held, ids, sizes, special``: for each part a row with the documents'
    ids, bytes and special strings, and a row for each of its buckets. ``held`` has numbers for each word: its bytes, how many documents
    hold it, and for each of these frequency times ``PART_DOCS`` plus place."""
    import itertools

    import numpy as np
    from xxhash import xxh32_intdigest

    lists = {"ids": pa.list_(kind), "sizes": pa.list_(pa.int64()), "special": pa.list_(pa.int64())}

    def flush(part: int, ids: list, sizes: list, special: list, words: _Codes, codes: list) -> Iterator[pa.RecordBatch]:
        place = np.repeat(np.arange(len(codes), dtype=np.int64), [len(c) for c in codes])
        both, n = np.unique((np.concatenate(codes).astype(np.int64) << BITS) + place, return_counts=True)
        most = (1 << 31 - BITS) - 1
        while (n > most).any():  # a frequency beyond the bits is two entries
            big = n > most
            both, n = np.concatenate([both, both[big]]), np.concatenate([np.where(big, most, n), n[big] - most])
        size = np.bincount(both >> BITS, minlength=len(words))
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        salt = 1 + part % SALTS
        bucket = np.fromiter((xxh32_intdigest(w, salt if m else 0) for w, m in zip(raw, (size > max(1, HOT * len(ids))).tolist(), strict=True)), dtype=np.int64, count=len(raw)) % buckets
        order = np.lexsort((both, bucket[both >> BITS]))  # by bucket, then by word
        both, n = both[order], n[order]
        held = ((n << BITS) + (both & (PART_DOCS - 1))).astype(np.int32)
        rows = [(part % buckets, part, None, None, None, None, ids, sizes, special)]
        own = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[own], np.arange(buckets + 1))
        end = np.concatenate([[0], np.cumsum(size[own])])
        lens = np.fromiter(map(len, raw), dtype=np.int32, count=len(raw))
        for k in np.flatnonzero(np.diff(cut)).tolist():
            mine = own[cut[k] : cut[k + 1]]
            text = b"".join(raw[i] for i in mine.tolist())
            numbers = np.concatenate([lens[mine], size[mine].astype(np.int32), held[end[cut[k]] : end[cut[k + 1]]]])
            rows.append((k, part, pa.compress(text, "zstd", asbytes=True), len(mine), pa.compress(numbers.tobytes(), "zstd", asbytes=True), len(numbers), None, None, None))
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), *lists.values()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["bucket", "part", "words", "n_words", "held", "n_held", *lists])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counter, numbers = counter_of(path), itertools.count(TaskContext.get().partitionId() << 32)
        state: tuple = ([], [], [], _Codes(), [])
        chars = 0
        for b in batches:
            for x, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = t.as_py() or ""
                ids, sizes, special, words, codes = state
                n, found = counter.read(text)
                ids.append(x)
                sizes.append(len(text.encode()))
                special.append(n)
                codes.append(np.fromiter(map(words.__getitem__, found), dtype=np.int32, count=len(found)))
                chars += len(text)
                if len(ids) == PART_DOCS or chars >= PART_CHARS:
                    yield from flush(next(numbers), *state)
                    state, chars = ([], [], [], _Codes(), []), 0
        if state[0]:
            yield from flush(next(numbers), *state)

    return run


def _joined(path: str, kind: pa.DataType):
    """Rows of ``_frequencies``, bucket by bucket, to ``part, at, n`` (places, and sums of frequency times pieces) and the documents as they are."""
    import numpy as np

    lists = {"ids": pa.list_(kind), "sizes": pa.list_(pa.int64()), "special": pa.list_(pa.int64())}

    def out(sums: dict) -> pa.RecordBatch:
        at = {part: np.flatnonzero(v) for part, v in sums.items()}
        cols = [pa.array(list(sums), pa.int64()), pa.array([x.astype(np.int32) for x in at.values()], pa.list_(pa.int32())), pa.array([sums[part][x] for part, x in at.items()], pa.list_(pa.int64()))]
        return pa.record_batch([*cols, *(pa.nulls(len(sums), t) for t in lists.values())], names=["part", "at", "n", *lists])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, pieces, now, sums, size = counter_of(path), {}, None, {}, 0
        for b in batches:
            mine = b.column(6).is_valid()
            own = b.filter(mine)
            if len(own):
                yield pa.record_batch([own.column(1), pa.nulls(len(own), pa.list_(pa.int32())), pa.nulls(len(own), pa.list_(pa.int64())), *(own.column(k) for k in (6, 7, 8))], names=["part", "at", "n", *lists])
            for bucket, part, z, k, h, m, given in zip(*(b.column(c) for c in range(6)), mine.to_pylist(), strict=True):
                if given:
                    continue
                if bucket.as_py() != now:
                    now, pieces = bucket.as_py(), {}
                k, m = k.as_py(), m.as_py()
                numbers = np.frombuffer(pa.decompress(h.as_py(), 4 * m, "zstd", asbytes=True), dtype=np.int32)
                end = np.cumsum(numbers[:k])
                raw = pa.decompress(z.as_py(), int(end[-1]), "zstd", asbytes=True)
                words = [raw[a:e] for a, e in zip((end - numbers[:k]).tolist(), end.tolist(), strict=True)]
                new = [w for w in words if w not in pieces]
                for a in range(0, len(new), ONCE):
                    part_of = new[a : a + ONCE]
                    pieces.update(zip(part_of, counter.pieces([w.decode("utf-8", "surrogatepass") for w in part_of]), strict=True))
                n = np.repeat(np.fromiter(map(pieces.__getitem__, words), dtype=np.int64, count=k), numbers[k : 2 * k]) * (numbers[2 * k :] >> BITS)
                at = numbers[2 * k :] & (PART_DOCS - 1)
                # exact: every sum is far below two to the power 53
                add = np.bincount(at, weights=n).astype(np.int64)
                have = sums.get(part.as_py())
                if have is None:
                    sums[part.as_py()] = add
                    size += len(add)
                elif len(have) < len(add):
                    add[: len(have)] += have
                    sums[part.as_py()] = add
                    size += len(add) - len(have)
                else:
                    have[: len(add)] += add
                if size >= SUMS:
                    yield out(sums)
                    sums, size = {}, 0
        if sums:
            yield out(sums)

    return run


def _summed(t: pa.Table) -> pa.Table:
    import numpy as np

    own = t.filter(t.column("ids").is_valid())
    ids, sizes, special = (own.column(c)[0].values for c in ("ids", "sizes", "special"))
    total = special.to_numpy().copy()
    rest = t.filter(t.column("at").is_valid())
    for at, n in zip(rest.column("at"), rest.column("n"), strict=True):
        total[at.values.to_numpy()] += n.values.to_numpy()
    return pa.table({"id": ids, "n_bytes": sizes, "n_tokens": pa.array(total.astype(np.int64))})


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    The tokenizer file is read in each task; a text without bytes has no tokens."""
    kind = docs.schema[id_col].dataType
    name, parts = kind.simpleString(), n_partitions(docs.sparkSession)
    own = f"ids array<{name}>, sizes array<long>, special array<long>"
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    freq = src.mapInArrow(trimmed(_frequencies(path, to_arrow_type(kind), BUCKETS * parts)), f"bucket long, part long, words binary, n_words int, held binary, n_held int, {own}")
    met = freq.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(_joined(path, to_arrow_type(kind))), f"part long, at array<int>, n array<long>, {own}")
    out = met.groupBy("part").applyInArrow(trimmed_group(_summed), f"id {name}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
