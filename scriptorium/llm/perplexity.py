"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model.

The model is of characters, order five, one for each language, trained on the
trusted documents (label quality 1, toxic not 1) of four folds of five; the
fifth fold is held out and sets each language's threshold. All counts cover all
trusted text, whatever its amount.

Everything large is joined in shards:

* documents are dealt into blocks of one language by a hash of their id (compressed together, one
  exchange, used twice). A block states the distinct five-grams it needs;
* these requests meet the counts in shards by (language, the three inner
  characters): a five-gram, its context and its suffix's context all share
  them, so orders five and four are complete inside a shard; shards of three-grams by
  their inner character complete orders three and two, and single characters order one;
* the probability of each distinct five-gram returns to the blocks that asked
  for it, and each block scores its documents.

Shards and blocks bound the memory of a task, and partitions are ``PARTITIONS`` at most: blocks beyond that follow one
another in a task. The driver sees a row of counts of
counts for each language and order, and sizes. Trusted ids are broadcast only if
there are ``BROADCAST_IDS`` at most; beyond that they are joined by a shuffle.

A document is rejected if its log-perplexity is above its language's held-out
quantile (the query takes it as it is; ``slack`` adds its distance from the median so many times), plus
``ALLOWANCE`` over its number of characters (short texts vary more). A language with fewer than ``LEAST_HELD`` held-out documents uses the figures of all
languages together.

Defined results: null, empty and blank texts have no characters: perplexity null,
rejected; a null language is a language; without trusted text nothing with
characters is rejected; rows that repeat a document repeat its result; an empty
table gives an empty result; other columns are kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import durable, table, trimmed, trimmed_group, trimmed_groups, written

ORDER, FOLDS = 5, 5
BLOCK_BYTES, CHUNK = 24_000_000, 2_000_000
#: Bytes of text that a task packs at once; partitions at most; languages whose blocks are counted one by one.
PACK_BYTES, PARTITIONS, LANGUAGES = 16_000_000, 20_000, 1000
BROADCAST_IDS, LEAST_HELD = 2_000_000, 20
#: On labels of both classes (sf0.1): slack 3, 1 and 0 keep 55, 31 and 20 of 571 documents of quality 0 and
#: lose 5, 9 and 13 of 609 held-out ones of quality 1.
QUANTILE, SLACK = 0.95, 1.0
#: What the query and the filter use: the quantile itself. On the same labels the quantiles 0.95, 0.98 and 0.99 keep
#: 20, 31 and 60 of 571 and lose 13, 7 and 3 of 609.
PLAIN = {"quantile": 0.98, "slack": 0.0}
#: Nats that any text may spend beyond its threshold: the mean over few characters says little.
ALLOWANCE = 20.0
#: Probability of a character that the model has never seen: one of so many.
ALPHABET = 4096
PAD = "\x02"
_MULT, _MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def _points(text: str):
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _hashes(points):
    """A 64-bit hash of the ``ORDER`` characters that end at each place."""
    import numpy as np

    c = points.astype(np.uint64) * np.uint64(_MULT)
    c ^= c >> np.uint64(29)
    c *= np.uint64(_MIX)
    n = len(c) - ORDER + 1
    h = c[:n].copy()
    for k in range(1, ORDER):
        h *= np.uint64(_MULT)
        h += c[k : k + n]
    return h ^ (h >> np.uint64(31))


def normal(text: str | None) -> str:
    return " ".join((text or "").split())


def _runs(texts: list[str]) -> Iterator[str]:
    """The texts, each after a padding, in chunks of about ``CHUNK`` characters."""
    part, size = [], 0
    for t in texts:
        part.append(PAD * (ORDER - 1) + t)
        size += len(t)
        if size >= CHUNK:
            yield "".join(part)
            part, size = [], 0
    if part:
        yield "".join(part)


def _grams(texts: list[str], counted: bool):
    """Distinct grams of ``texts`` with their counts. Grams across two texts end in a padding and are left out."""
    import numpy as np
    import pandas as pd

    seen: dict[str, int] = {}
    for run in _runs(texts):
        if len(run) < ORDER:
            continue
        pts = _points(run)
        inside = np.flatnonzero(pts[ORDER - 1 :] != ord(PAD))
        if counted:
            codes, _ = pd.factorize(_hashes(pts)[inside])
            n = np.bincount(codes)
            first = np.empty(len(n), dtype=np.int64)
            first[codes[::-1]] = inside[::-1]
        else:
            first = inside[~pd.Series(_hashes(pts)[inside]).duplicated().to_numpy()]
            n = np.ones(len(first), dtype=np.int64)
        for at, m in zip(first.tolist(), n.tolist(), strict=True):
            g = run[at : at + ORDER]
            seen[g] = seen.get(g, 0) + m
    return seen


def _named(lang: str):
    """A language as it is inside: ``=`` and its name, or nothing for null, so that joins on it are plain."""
    return F.coalesce(F.concat(F.lit("="), F.col(lang).cast("string")), F.lit(""))


def _by_lang(langs: list, texts: list[str]) -> dict:
    out: dict = {}
    for lang, t in zip(langs, texts, strict=True):
        if t:
            out.setdefault(lang, []).append(t)
    return out


def trained_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``lang, g, c``: counts of the grams of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                seen = _grams(texts, True)
                yield pa.record_batch([pa.array([lang] * len(seen), pa.string()), pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "g", "c"])

        for b in batches:
            for lang, texts in _by_lang(b.column(0).to_pylist(), [normal(t.as_py()) for t in b.column(1)]).items():
                held.setdefault(lang, []).extend(texts)
                size += sum(map(len, texts))
            if size >= 4 * CHUNK:
                yield from out()
                held, size = {}, 0
        yield from out()

    part = docs.select(_named(lang_col).alias("lang"), F.col(text_col).alias("t")).mapInArrow(trimmed(run), "lang string, g string, c long")
    return part.groupBy("lang", "g").agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame) -> dict:
    """``{(lang, order): (D1, D2, D3)}`` from the numbers of grams with counts one to four."""
    out: dict = {}
    level = counts
    for order in range(ORDER, 0, -1):
        n = [F.sum((F.col("c") == r).cast("long")).alias(f"n{r}") for r in (1, 2, 3, 4)]
        for row in level.groupBy("lang").agg(*n).collect():
            n1, n2, n3, n4 = (max(row[f"n{r}"], 0) for r in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
            d = [r - (r + 1) * y * (b / a) if a else y for r, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
            out[row.lang, order] = tuple(min(max(x, 0.05), r - 0.05) for r, x in enumerate(d, 1))
        level = _continued(level, order - 1) if order > 1 else level
    return out


def _shares(df, grams: str, context: str, count: str, order: int, disc: dict):
    """Columns a (discounted share) and b (what the context leaves to the lower order) of each row of
    ``df``; its rows with a count are all grams of their contexts, each once."""
    import numpy as np
    import pandas as pd

    c = df[count].to_numpy()
    d = np.array([disc.get((x, order), (0.5, 0.5, 0.5)) for x in df["lang"]]).reshape(-1, 3)
    cut = np.where(c <= 0, 0.0, np.where(c == 1, d[:, 0], np.where(c == 2, d[:, 1], d[:, 2])))
    s = pd.DataFrame({"lang": df["lang"], "h": df[context], "c": c, "cut": cut}).groupby(["lang", "h"], sort=False)
    total, left = s["c"].transform("sum").to_numpy(), s["cut"].transform("sum").to_numpy()
    known = total > 0
    safe = np.where(known, total, 1)
    return np.where(known, (c - cut) / safe, 0.0), np.where(known, left / safe, 1.0)


def _step(size: int, disc: dict, merge: bool):
    """Shard function for grams of ``size`` characters: completes orders ``size`` and ``size - 1``, below
    three only ``size``. With ``merge`` a gram's request and its count are two rows. Rows (lang, g, p, rest) for the requested grams: probability so far and weight of the rest."""

    def run(t: pa.Table) -> pa.Table:
        import pandas as pd

        df = t.select(["lang", "g", "c", "asked"]).to_pandas()
        if merge:
            df = df.groupby(["lang", "g"], sort=False).agg(c=("c", "sum"), asked=("asked", "max")).reset_index()
        key = df["lang"]
        df["h"] = df["g"].str[:-1]
        p, rest = _shares(df, "g", "h", "c", size, disc)
        if size > 2:
            low = pd.DataFrame({"lang": df["lang"], "key": key, "g": df["g"].str[1:], "n": (df["c"] > 0).astype("int64")})
            suffix = pd.MultiIndex.from_arrays([key, low["g"]])
            low = low.groupby(["key", "g"], sort=False).agg(lang=("lang", "first"), n=("n", "sum")).reset_index()
            low["h"] = low["g"].str[:-1]
            low["a"], low["b"] = _shares(low, "g", "h", "n", size - 1, disc)
            at = low.set_index(["key", "g"])
            ix = at.index.get_indexer(suffix)
            p, rest = p + rest * at["a"].to_numpy()[ix], rest * at["b"].to_numpy()[ix]
        ask = df["asked"].to_numpy()
        return pa.table({"lang": pa.array(df["lang"][ask], pa.string()), "g": pa.array(df["g"][ask], pa.string()), "p": pa.array(p[ask]), "rest": pa.array(rest[ask])})

    return run


def probabilities(asked: DataFrame, counts: DataFrame, disc: dict, shards: int) -> DataFrame:
    """``lang, g, logp`` for the distinct grams ``asked`` (lang, g)."""

    def level(size: int) -> DataFrame:
        need = asked.select("lang", F.expr(f"right(g, {size})").alias("g"), F.lit(0).cast("long").alias("c"), F.lit(True).alias("asked"))
        both = need.unionByName(lower[size].select("lang", "g", "c", F.lit(False).alias("asked")))
        if size < ORDER:  # the longest are distinct on both sides: they meet in their shard
            both = both.groupBy("lang", "g").agg(F.sum("c").alias("c"), F.max("asked").alias("asked"))
        inner = F.substring("g", 2, size - 2) if size > 2 else F.substring("g", 1, size - 1)
        both = both.withColumn("shard", F.pmod(F.xxhash64("lang", inner), F.lit(shards)))
        return both.groupBy("shard").applyInArrow(trimmed_group(_step(size, disc, size == ORDER)), "lang string, g string, p double, rest double")

    lower = {ORDER: counts}
    for size in range(ORDER - 1, 0, -1):
        lower[size] = _continued(lower[size + 1], size)
    top = level(ORDER)
    for size in (ORDER - 2, ORDER - 4):
        low = level(size).select(F.col("lang").alias("_l"), F.col("g").alias("_s"), F.col("p").alias("_p"), F.col("rest").alias("_r"))
        top = top.join(low, (F.col("lang") == F.col("_l")) & (F.expr(f"right(g, {size})") == F.col("_s")))
        top = top.select("lang", "g", (F.col("p") + F.col("rest") * F.col("_p")).alias("p"), (F.col("rest") * F.col("_r")).alias("rest"))
    return top.select("lang", "g", F.log(F.col("p") + F.col("rest") / ALPHABET).cast("float").alias("logp"))


def _continued(counts: DataFrame, size: int) -> DataFrame:
    """Continuation counts of grams of ``size`` characters: in how many of the next longer grams each ends."""
    return counts.groupBy("lang", F.expr(f"right(g, {size})").alias("g")).agg(F.count("*").alias("c"))


def _packed(kind: pa.DataType):
    """Texts of a block that one task reads, compressed together: block, lang, ids, sizes (bytes), z."""

    def out(held: dict) -> pa.RecordBatch:
        codec = pa.Codec("zstd", compression_level=9)
        rows = [(block, lang, pa.array(ids, kind), list(map(len, texts)), codec.compress(b"".join(texts), asbytes=True)) for (block, lang), (ids, texts) in held.items()]
        block, lang, ids, sizes, z = zip(*rows, strict=True)
        return pa.record_batch([pa.array(block, pa.int64()), pa.array(lang, pa.string()), pa.array([x.to_pylist() for x in ids], pa.list_(kind)), pa.array(sizes, pa.list_(pa.int32())), pa.array(z, pa.binary())], names=["block", "lang", "ids", "sizes", "z"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        size = 0
        for b in batches:
            for block, x, lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                ids, texts = held.setdefault((block, lang), ([], []))
                ids.append(x)
                texts.append(normal(t.as_py()).encode())
                size += len(texts[-1])
                if size >= PACK_BYTES:
                    yield out(held)
                    held, size = {}, 0
        if held:
            yield out(held)

    return run


def _texts(t: pa.Table) -> list[str]:
    codec, out = pa.Codec("zstd"), []
    for sizes, z in zip(t.column("sizes").to_pylist(), t.column("z"), strict=True):
        total, at = sum(sizes), 0
        raw = codec.decompress(z.as_py(), decompressed_size=total, asbytes=True) if total else b""
        for n in sizes:
            out.append(raw[at : at + n].decode())
            at += n
    return out


def _ask(t: pa.Table) -> pa.Table:
    block = t.column("block")[0].as_py()
    by = _by_lang([x for x, ids in zip(t.column("lang").to_pylist(), t.column("ids"), strict=True) for _ in range(len(ids))], _texts(t))
    lang, grams = [], []
    for x, texts in by.items():  # one, unless two hashes of blocks are equal
        seen = _grams(texts, False)
        lang += [x] * len(seen)
        grams += seen
    return pa.table({"block": pa.array([block] * len(grams), pa.int64()), "lang": pa.array(lang, pa.string()), "g": pa.array(grams, pa.string())})


def _score(docs: pa.Table, replies: pa.Table) -> pa.Table:
    import numpy as np

    known: dict = {}
    if len(replies):
        h = _hashes_of(replies.column("g").to_pylist())
        logp = replies.column("logp").to_numpy()
        codes: dict = {}
        ix = np.array([codes.setdefault(x, len(codes)) for x in replies.column("lang").to_pylist()])
        for x, k in codes.items():
            own = np.flatnonzero(ix == k)
            own = own[np.argsort(h[own])]
            known[x] = h[own], logp[own]
    ids = [x for part in docs.column("ids").to_pylist() for x in part]
    langs = [x for x, part in zip(docs.column("lang").to_pylist(), docs.column("ids"), strict=True) for _ in range(len(part))]
    n, total = [], []
    for lang, text in zip(langs, _texts(docs), strict=True):
        s = 0.0
        if text and lang in known:  # a language may have asked for nothing: texts of padding characters
            keys, logp = known[lang]
            s = float(logp[np.searchsorted(keys, _hashes(_points(PAD * (ORDER - 1) + text)))].sum(dtype=np.float64)) if PAD not in text else _spelled(text, keys, logp)
        n.append(len(text))
        total.append(s)
    return pa.table({"id": pa.array(ids, docs.schema.field("ids").type.value_type), "lang": pa.array(langs, pa.string()), "n": pa.array(n, pa.int64()), "total": pa.array(total, pa.float64())})


def _spelled(text: str, keys, logp) -> float:
    """As above for a text that holds the padding character: grams that end in one were not asked for and count nothing."""
    import numpy as np

    pts = _points(PAD * (ORDER - 1) + text)
    h = _hashes(pts)[pts[ORDER - 1 :] != ord(PAD)]
    return float(logp[np.searchsorted(keys, h)].sum(dtype=np.float64))


def _hashes_of(grams: list[str]):
    """Hashes of single grams of ``ORDER`` characters."""
    return _hashes(_points("".join(grams)))[::ORDER]


def scores(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``id, lang, n, total`` (summed log-probability) of every row, under the model of the rows of ``docs`` whose id is in ``trusted`` (id)."""
    spark = docs.sparkSession
    small = trusted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    own = docs.join(F.broadcast(trusted) if small else trusted, docs[id_col] == trusted["id"], "left_semi")
    counts = written(trained_counts(own, text_col, lang_col), "grams")
    disc = discounts(counts)
    kind = docs.schema[id_col].dataType
    name = kind.simpleString()
    d, parts = _dealt(docs, id_col, text_col, lang_col)
    d = d.mapInArrow(trimmed(_packed(to_arrow_type(kind))), f"block long, lang string, ids array<{name}>, sizes array<int>, z binary").repartition(parts, "block")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-parts // 3))
    asked = d.groupBy("block").applyInArrow(trimmed_group(_ask), "block long, lang string, g string").filter("g is not null and lang is not null").repartition(shards, "lang", "g")
    # the filters, on blocks here and on grams above (as the join has one), let both branches read one exchange
    distinct = asked.groupBy("lang", "g").agg(F.min("block").alias("b")).filter(F.col("b").isNotNull()).select("lang", "g")
    prob = probabilities(distinct, counts, disc, shards)
    prob = prob.select(F.col("lang").alias("_l"), F.col("g").alias("_g"), "logp")
    replies = asked.join(prob, (F.col("lang") == F.col("_l")) & (F.col("g") == F.col("_g"))).select("block", "lang", "g", "logp")
    out = d.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(trimmed_groups(_score), f"id {name}, lang string, n long, total double")
    return out.withColumn("lang", F.when(F.col("lang") != "", F.substr(F.col("lang"), F.lit(2))))


def _dealt(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[DataFrame, int]:
    """``block, id, lang, t``, and how many partitions the blocks fill. A block is a hash of a language and one of
    its numbers; the ``LANGUAGES`` largest languages have as many numbers as their sizes ask for, all others as many as the next one."""
    lang = _named(lang_col)
    top = docs.groupBy(lang.alias("lang")).agg(F.sum(F.octet_length(text_col)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES + 1).collect()
    many = [max(1, -(-(r.n or 0) // BLOCK_BYTES)) for r in top]
    number = F.lit(many[LANGUAGES] if len(top) > LANGUAGES else 1)
    if known := [x for r, m in zip(top[:LANGUAGES], many, strict=False) for x in (F.lit(r.lang), F.lit(m))]:
        number = F.coalesce(F.try_element_at(F.create_map(*known), lang), number)
    block = F.xxhash64(lang, F.pmod(F.coalesce(F.xxhash64(id_col), F.lit(0)), number))
    d = docs.select(block.alias("block"), F.col(id_col).alias("id"), lang.alias("lang"), F.col(text_col).alias("t"))
    return d, max(1, min(3 * sum(many), PARTITIONS))


def classified(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_id: str = "doc_id", quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """``id_col, lang, n_chars, log_perplexity, threshold, kept`` for every row of ``docs``. ``labels`` has quality and toxic."""
    good = labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) != 1)).select(F.col(label_id).alias("id")).filter(F.col("id").isNotNull()).distinct()
    fold = F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS))
    s = durable(scores(docs, good.filter(fold != 0), id_col, text_col, lang_col))
    s = s.withColumn("ppl", F.when(F.col("n") > 0, -F.col("total") / F.col("n")))
    held = s.join(good.filter(fold == 0), "id", "left_semi").filter(F.col("ppl").isNotNull())
    figures = lambda g: g.agg(F.percentile_approx("ppl", F.array(F.lit(0.5), F.lit(quantile)), F.lit(10000)).alias("q"), F.count("*").alias("m"))
    limit = lambda c: F.element_at(c, 2) + slack * (F.element_at(c, 2) - F.element_at(c, 1))
    own = figures(held.groupBy("lang")).filter(F.col("m") >= LEAST_HELD).select(F.col("lang").alias("_l"), limit(F.col("q")).alias("_own"))
    everyone = figures(held).select(limit(F.col("q")).alias("_all"))
    s = s.join(own, F.col("lang").eqNullSafe(F.col("_l")), "left").join(F.broadcast(everyone))  # one row
    s = s.withColumn("threshold", F.coalesce("_own", "_all"))
    kept = F.col("ppl").isNotNull() & (F.coalesce("threshold", F.lit(float("inf"))) + ALLOWANCE / F.col("n") >= F.col("ppl"))
    return s.select(F.col("id").alias(id_col), F.col("lang").alias(lang_col), F.col("n").alias("n_chars"), F.col("ppl").alias("log_perplexity"), "threshold", F.coalesce(kept, F.lit(False)).alias("kept"))


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier keeps, by plain quantiles unless ``how`` says otherwise. A row whose
    id is null is judged with all rows of null id, one whose id repeats with all of that id: they go if one of them is bad."""
    bad = classified(docs, labels, id_col, text_col, lang_col, **(PLAIN | how)).filter(~F.col("kept")).select(F.col(id_col).alias("_bad")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_bad"]), "left_anti")


def op10_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), **PLAIN)

