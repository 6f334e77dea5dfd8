"""Line dedup over the whole corpus.

Lines are exploded with nothing but a 128-bit hash of their key, hashes are
counted over distinct documents (partial aggregates first, so a line that a
third of all documents hold is pre-summed in every task), and only the few
(document, hash) pairs that lose lines travel back to the texts, which are then
put together by position. Nothing is broadcast unless adaptive execution
measures it as small.

Defined results: a null or empty text is one empty line and keeps it; a table
without rows gives none; rows that repeat a doc_id count as one document and
each is rewritten; a null doc_id counts as one document of its own (least in
order) and its rows are rewritten too. All columns of the input are kept as
they are, whatever their names; only the text changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, table

MIN_CHARS, MIN_DOCS = 40, 5


def line_key(line: Column) -> Column:
    """Blanks stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line_key(line)))


def dropped_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """One row per document that loses lines: ``(_id, _drop)``, the hashes of the keys it loses."""
    keys = docs.select(F.col(id_col).alias("_id"), F.explode(F.array_distinct(F.transform(
        F.filter(F.split(F.col(text_col), "\n"), lambda x: F.length(line_key(x)) >= min_chars), _digest))).alias("_h"))
    # one partial aggregate per (hash, document), then per hash: no task sees all rows of a hot line
    often = (
        keys.groupBy("_h", "_id").agg(F.lit(1).alias("_one")).groupBy("_h")
        .agg(F.count("*").alias("_n"), F.max("_id").alias("_keep")).filter(F.col("_n") >= min_docs).select("_h", "_keep")
    )
    # an expression as key has both sides dealt anew, so that adaptive execution can split a hot line's rows
    key = F.concat("_h", F.lit(b""))
    often = often.select(key.alias("_often"), "_keep")
    lost = keys.join(often, key == F.col("_often")).filter(~F.col("_id").eqNullSafe(F.col("_keep")))
    return lost.groupBy("_id").agg(F.collect_set("_h").alias("_drop"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, report: bool = False) -> DataFrame:
    """``docs`` without the repeated lines. A key of at least ``min_chars`` code points that at
    least ``min_docs`` documents hold loses its lines everywhere but in the largest id holding it.
    ``report`` adds ``n_lines`` (before) and ``n_dropped``."""
    drop = dropped_lines(docs, id_col, text_col, min_chars, min_docs)
    src = docs.select(F.struct("*").alias("_row"))
    joined = src.join(drop, src["_row"][id_col].eqNullSafe(drop["_id"]), "left")
    text = F.coalesce(F.col("_row")[text_col], F.lit(""))
    kept = F.when(F.col("_drop").isNull(), F.split(text, "\n")).otherwise(
        F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(F.col("_drop"), _digest(x))))
    joined = joined.select("_row", F.size(F.split(text, "\n")).cast("long").alias("_n"), F.col("_drop").isNotNull().alias("_cut"), kept.alias("_kept"))
    new_text = F.when(F.col("_cut"), F.array_join("_kept", "\n")).otherwise(F.col("_row")[text_col])
    cols = [new_text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns]
    if report:
        cols += [F.col("_n").alias("n_lines"), (F.col("_n") - F.size("_kept")).cast("long").alias("n_dropped")]
    return joined.select(*cols)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP6_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
o as (select key, max(doc_id) as keep from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
j as (select k.*, (o.key is not null and k.doc_id <> o.keep) as dropped from k left join o on k.key = o.key)
select doc_id, count(*) as n_lines, cast(sum(case when dropped then 1 else 0 end) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from j group by doc_id
"""
