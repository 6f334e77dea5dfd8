"""Quality rules with cross-document line frequency, in DataFrame operations only.

Base rules look at one document: counts of words, symbols, lines and repeated
five-word windows, all computed in the row. The corpus rule hashes normalised
lines, counts for each host the distinct documents that hold a line, removes
lines above the host's limit and rejects documents that lose most of their
words. Only hashes travel: the count is a two-level aggregate (first over
(line, document), then over lines), so a line on a third of all pages is summed
in every task before it moves; lines above a limit meet the documents' lines in
an ordinary equi-join, which adaptive execution may split where it is skewed.
A document counts by its id: text that a host serves under more ids than its limit is removed, as boilerplate and mirrored pages are.

Defined results: a null or empty text has no words and fails the base rules; a
null host is a host; rows that repeat an id are one document in all counts; a null id is one document; rows that repeat an id and text give repeated results; an
empty table gives none; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK_RUN, BLANKS, ascii_lower, barrier, table, words

SYMBOLS = "#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
#: A line is removed if more documents of its host hold it than the host's limit: HELD_SHARE of them, but MIN_HELD at least and
#: MAX_HELD at most, so that the limit is the same for every host of 200 documents or more;
#: a document is depleted if less than KEPT_SHARE of its words, or fewer than MIN_WORDS, remain.
MIN_HELD, MAX_HELD, HELD_SHARE, KEPT_SHARE = 3, 10, 0.05, 0.3


def _repeat_words(df: DataFrame, words_col: str) -> DataFrame:
    """Adds ``n_repeat_words``: words in five-word windows that the row holds twice or more. Sorts by
    hash and back by place, so a row of n words costs n log n however often it repeats itself."""
    w = F.col(words_col)
    n = F.size(w) - (WINDOW - 1)
    df = barrier(df.withColumn("_h", F.when(n > 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(w, i, WINDOW))))))
    df = barrier(df.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("p")))))).drop("_h"))
    none = F.expr("array(cast(null as struct<h: bigint, p: int>))")
    before = F.concat(none, F.slice("_s", F.lit(1), F.size("_s") - 1))
    after = F.concat(F.slice("_s", F.lit(2), F.size("_s") - 1), none)
    near = F.zip_with(F.col("_s"), before, lambda x, y: F.struct(x["h"].alias("h"), x["p"].alias("p"), (x["h"] == y["h"]).alias("a")))
    places = F.filter(F.zip_with(near, after, lambda x, y: F.when(F.coalesce(x["a"], F.lit(False)) | F.coalesce(x["h"] == y["h"], F.lit(False)), x["p"])), lambda p: p.isNotNull())
    df = barrier(df.withColumn("_p", F.when(F.col("_s").isNotNull(), F.array_sort(places))).drop("_s"))
    steps = F.zip_with(F.col("_p"), F.slice("_p", F.lit(2), F.size("_p")), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    total = F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)
    return df.withColumn("n_repeat_words", F.coalesce(F.when(F.col("_p").isNotNull(), total), F.lit(0)).cast("long")).drop("_p")


def base_counts(docs: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """``keep`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.translate(text, BLANKS, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    d = barrier(docs.select(*keep, words(F.col(text_col)).alias("_w"), F.length(bare).cast("long").alias("word_chars"),
                            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"), lines.alias("_l")))
    d = d.withColumn("n_words", F.size("_w").cast("long")).withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")).drop("_l")
    d = _repeat_words(d, "_w").drop("_w")
    return d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def host_lines(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """``_id, _c`` (content hash)``, _host, _h1, _h2`` (96 bits of the normalised line) ``, _pos, _n`` (its words), one row a line with words."""
    norm = lambda x: F.btrim(F.regexp_replace(ascii_lower(x), BLANK_RUN, " "), F.lit(" "))
    d = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_c"), F.col(host_col).alias("_host"), F.posexplode(F.transform(F.split(text_col, "\n"), norm)).alias("_pos", "_line"))
    d = d.filter(F.col("_line") != "")
    n = F.length("_line") - F.length(F.translate(F.col("_line"), " ", "")) + 1
    return d.select("_id", "_c", "_host", "_pos", F.xxhash64("_line").alias("_h1"), F.hash("_line").alias("_h2"), n.cast("int").alias("_n"))


def over_limit(lines: DataFrame, min_held: int, max_held: int, held_share: float) -> DataFrame:
    """``_host, _h1, _h2`` of the lines above their host's limit."""
    held = lines.groupBy("_host", "_h1", "_h2", "_id").agg(F.lit(1).alias("_one")).groupBy("_host", "_h1", "_h2").agg(F.count("*").alias("_held")).filter(F.col("_held") > min_held)
    hosts = lines.groupBy("_host", "_id").agg(F.lit(1).alias("_one")).groupBy("_host").agg(F.count("*").alias("_of"))
    hosts = hosts.select(F.col("_host").alias("_host2"), F.least(F.lit(float(max_held)), F.greatest(F.lit(float(min_held)), held_share * F.col("_of"))).alias("_limit"))
    over = held.join(hosts, F.col("_host").eqNullSafe(F.col("_host2"))).filter(F.col("_held") > F.col("_limit"))
    return over.select(F.col("_host").alias("_o"), F.col("_h1").alias("_o1"), F.col("_h2").alias("_o2"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", *,
                  min_held: int = MIN_HELD, max_held: int = MAX_HELD, held_share: float = HELD_SHARE, kept_share: float = KEPT_SHARE) -> DataFrame:
    """One row a document: id, base counts, base_failed, n_removed_words, kept."""
    base = base_counts(docs, text_col, [F.col(id_col).alias("_bid"), F.xxhash64(text_col).alias("_bc"), F.col(host_col).alias("_bhost")])
    lines = host_lines(docs, id_col, text_col, host_col)
    over = over_limit(lines, min_held, max_held, held_share)
    on = F.col("_host").eqNullSafe(F.col("_o")) & (F.col("_h1") == F.col("_o1")) & (F.col("_h2") == F.col("_o2"))
    # by place first: rows that repeat a document count once
    lost = lines.join(over, on, "left_semi").groupBy("_id", "_c", "_host", "_pos").agg(F.first("_n").alias("_n")).groupBy("_id", "_c", "_host").agg(F.sum("_n").alias("_lost"))
    out = base.join(lost, F.col("_bid").eqNullSafe(F.col("_id")) & (F.col("_bc") == F.col("_c")) & F.col("_bhost").eqNullSafe(F.col("_host")), "left")
    left = F.col("n_words") - F.least(F.coalesce("_lost", F.lit(0)), F.col("n_words"))
    verdict = (left >= MIN_WORDS) & (left >= kept_share * F.col("n_words"))
    return out.select(
        F.col("_bid").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (F.col("n_words") - left).alias("n_removed_words"), (~F.col("base_failed") & verdict).alias("kept"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


OP4_SQL = r"""
with d as (select doc_id, source, coalesce(text, '') as text from documents),
w as (select doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d),
g as (select doc_id, i, ws[i:i + 4] as win from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5)),
h as (select doc_id, i, count(*) over (partition by doc_id, win) as m from g),
r as (select doc_id, cast(sum(case when nx is null then 5 else least(5, nx - i) end) as bigint) as n
  from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nx from h where m >= 2) group by doc_id),
l0 as (select doc_id, source, text, unnest(string_split(text, chr(10))) as line from d),
l as (select doc_id, source, line, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as norm from l0),
dl as (select doc_id, count(*) - count(distinct line) as n from l where norm <> '' group by doc_id),
held as (select source, norm, count(distinct coalesce(cast(doc_id as varchar), '')) as n from l where norm <> '' group by source, norm),
hosts as (select source, count(distinct coalesce(cast(doc_id as varchar), '')) as n from l where norm <> '' group by source),
over_ as (select held.source, norm from held join hosts on held.source is not distinct from hosts.source where held.n > least(10, greatest(3, 0.05 * hosts.n))),
lost as (select doc_id, sum(len(string_split(norm, ' '))) as n from l where norm <> '' and exists (select 1 from over_ o where o.source is not distinct from l.source and o.norm = l.norm) group by doc_id),
b as (select w.doc_id, cast(len(ws) as bigint) as n_words, cast(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
  cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, coalesce(dl.n, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words, cast(coalesce(lost.n, 0) as bigint) as n_removed_words
  from w left join dl using (doc_id) left join r using (doc_id) left join lost using (doc_id)),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, n_words - n_removed_words as left_ from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words, (not base_failed and left_ >= 10 and left_ >= 0.3 * n_words) as kept from f
"""
