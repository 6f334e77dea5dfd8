"""Preference formatting, in DataFrame operations only.

A pair holds a chosen and a rejected conversation. Both are gathered as arrays of
turns in order; the longest common turn prefix is rendered once as the prompt, and
what follows on each side is a completion: rendered text plus a mask that tells
which of its turns a loss may count (those of the trained role), as spans of
characters of the rendered completion. A prefix never takes all of both sides'
turns unless they are equal.

The conversations table holds single conversations, so the query branches each of them (``branched``): chosen is the
conversation up to the last turn of the trained role; rejected answers there with that role's turn before, an
answer to something else. Both sides come from one conversation: no group of equal first turns, however large, is ever gathered.

Defined results: turns are ordered by (turn, role, text), nulls first, repeated
rows of a turn count once; a conversation without two turns of the trained role has no rejected side, one without any is chosen as it is; a null role or text renders as empty and equals null
only; rows without conv_id are left out; a pair without one side has the prompt
of the side it has less its last turn and a null for the other; an empty table gives none. Other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import barrier, table

START, END = "<|im_start|>", "<|im_end|>"


def render_turn(t: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(END + "\n"))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that two arrays of turns share."""
    same = F.zip_with(a, b, lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]) & x["turn"].isNotNull() & y["turn"].isNotNull())
    return F.coalesce(F.array_position(same, False) - 1, F.lit(0)) + F.when(F.array_position(same, False) == 0, F.size(same) + 1).otherwise(0)


def _turn() -> Column:
    return F.struct(F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), "role", "text")


def preference_pairs(turns: DataFrame, pair: Column, chosen: Column, trained_role: str = "assistant") -> DataFrame:
    """``turns`` has conv_id, turn, role, text; ``pair`` and ``chosen`` are expressions of its columns.
    Result: pair_id, chosen_id, rejected_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask."""
    t = turns.filter(F.col("conv_id").isNotNull()).select(pair.alias("_pair"), chosen.alias("_chosen"), "conv_id", _turn().alias("_t"))
    g = t.groupBy("_pair").agg(
        F.min(F.when(F.col("_chosen"), F.col("conv_id"))).alias("chosen_id"), F.min(F.when(~F.col("_chosen"), F.col("conv_id"))).alias("rejected_id"),
        F.array_sort(F.collect_set(F.when(F.col("_chosen"), F.col("_t")))).alias("_a"), F.array_sort(F.collect_set(F.when(~F.col("_chosen"), F.col("_t")))).alias("_b"),
    )
    return formatted(g, trained_role)


def branched(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One pair a conversation, with the columns of ``preference_pairs``; pair_id is the conversation's id."""
    g = turns.filter(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.array_sort(F.collect_set(_turn())).alias("_t"))
    own = F.filter(F.transform("_t", lambda x, i: F.when(x["role"] == trained_role, i + 1)), lambda i: i.isNotNull())
    g = barrier(g.select("conv_id", "_t", own.alias("_own")))
    n = F.size("_own")
    last, before = F.try_element_at("_own", n), F.try_element_at("_own", n - 1)
    g = barrier(g.select("conv_id", "_t", F.when(n > 0, last).alias("_last"), F.when(n > 1, before).alias("_before")))
    answer, other = F.element_at("_t", F.col("_last")), F.element_at("_t", F.col("_before"))
    none = F.filter("_t", lambda x: F.lit(False))
    rejected = F.concat(F.slice("_t", F.lit(1), F.col("_last") - 1), F.array(F.struct(answer["turn"].alias("turn"), answer["role"].alias("role"), other["text"].alias("text"))))
    two = F.col("_before").isNotNull()
    g = g.select(
        F.col("conv_id").alias("_pair"), F.col("conv_id").alias("chosen_id"), F.when(two, F.col("conv_id")).alias("rejected_id"),
        F.when(F.col("_last").isNotNull(), F.slice("_t", F.lit(1), F.col("_last"))).otherwise(F.col("_t")).alias("_a"), F.when(two, rejected).otherwise(none).alias("_b"),
    )
    return formatted(barrier(g), trained_role)


def formatted(g: DataFrame, trained_role: str) -> DataFrame:
    """The pairs of ``g``: _pair, chosen_id, rejected_id and the turns of both sides in order, _a and _b."""
    g = barrier(g.withColumn("_p", common_prefix(F.col("_a"), F.col("_b"))))
    # one side missing: all but its last turn is the prompt
    alone = F.greatest(F.size("_a"), F.size("_b")) - 1
    has = (F.size("_a") > 0) & (F.size("_b") > 0)
    g = barrier(g.withColumn("_p", F.when(has, F.col("_p")).otherwise(alone).cast("int")))
    lead = F.when(F.size("_a") > 0, F.col("_a")).otherwise(F.col("_b"))

    def rest(side: str) -> Column:
        return F.filter(F.col(side), lambda x, i: i >= F.col("_p"))

    def mask(side: str) -> Column:
        """Spans [begin, end) of the trained role's texts in the rendered completion."""
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<begin: bigint, end: bigint>>)").alias("spans"))

        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + F.length(F.lit(START)) + F.length(F.coalesce(x["role"], F.lit(""))) + 1
            end = begin + F.length(F.coalesce(x["text"], F.lit(""))) + F.length(F.lit(END))
            span = F.array(F.struct(begin.cast("long").alias("begin"), end.cast("long").alias("end")))
            more = F.when(x["role"] == trained_role, F.concat(acc["spans"], span)).otherwise(acc["spans"])
            return F.struct((end + 1).cast("long").alias("at"), more.alias("spans"))

        return F.aggregate(rest(side), zero, step, lambda acc: acc["spans"])

    text = lambda arr: F.array_join(F.transform(arr, render_turn), "")
    return g.select(
        F.col("_pair").alias("pair_id"), "chosen_id", "rejected_id", F.when(has, F.col("_p")).otherwise(0).cast("long").alias("n_common"),
        text(F.slice(lead, F.lit(1), F.greatest(F.col("_p"), F.lit(0)))).alias("prompt"),
        F.when(F.size("_a") > 0, text(rest("_a"))).alias("chosen"), F.when(F.size("_b") > 0, text(rest("_b"))).alias("rejected"),
        F.when(F.size("_a") > 0, mask("_a")).alias("chosen_mask"), F.when(F.size("_b") > 0, mask("_b")).alias("rejected_mask"),
    )


def op3_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a pair (see ``branched``); masks as text ``begin-end,...``."""
    p = branched(table(spark, sf_dir, "conversations"))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string"))), ",")
    return p.withColumn("chosen_mask", spans(F.col("chosen_mask"))).withColumn("rejected_mask", spans(F.col("rejected_mask")))


#: Pairs of conversations 2k (chosen) and 2k + 1 (rejected), for tests.
PAIRS_SQL = r"""
with t as (select distinct conv_id, coalesce(turn, -1) as turn, role, text from conversations where conv_id is not null),
s as (select *, cast(floor(conv_id / 2) as bigint) as pair_id, ((conv_id % 2) + 2) % 2 = 0 as chosen,
  row_number() over (partition by conv_id order by turn, role nulls first, text nulls first) - 1 as i from t),
n as (select pair_id, max(case when chosen then conv_id end) as chosen_id, max(case when not chosen then conv_id end) as rejected_id,
  count(*) filter (where chosen) as na, count(*) filter (where not chosen) as nb from s group by pair_id),
d as (select a.pair_id, min(a.i) as first_diff from s a left join s b on a.pair_id = b.pair_id and a.i = b.i and a.chosen and not b.chosen
  where a.chosen and (b.conv_id is null or a.role is distinct from b.role or a.text is distinct from b.text) group by a.pair_id),
p as (select n.*, case when na > 0 and nb > 0 then coalesce(first_diff, na) else greatest(na, nb) - 1 end as p from n left join d using (pair_id)),
r as (select s.pair_id, s.chosen, s.i, p.p, p.na, s.role, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) as out,
  length(coalesce(role, '')) as lr, length(coalesce(text, '')) as lt from s join p using (pair_id)),
o as (select *, coalesce(sum(length(out)) over (partition by pair_id, chosen, i >= p order by i rows between unbounded preceding and 1 preceding), 0) as off from r)
select p.pair_id, chosen_id, rejected_id, cast(case when p.na > 0 and nb > 0 then p.p else 0 end as bigint) as n_common,
  coalesce(string_agg(out, '' order by i) filter (where i < p.p and chosen = (p.na > 0)), '') as prompt,
  case when p.na > 0 then coalesce(string_agg(out, '' order by i) filter (where chosen and i >= p.p), '') end as chosen,
  case when nb > 0 then coalesce(string_agg(out, '' order by i) filter (where not chosen and i >= p.p), '') end as rejected,
  case when p.na > 0 then coalesce(string_agg(cast(off + 13 + lr as bigint) || '-' || cast(off + 13 + lr + lt + 10 as bigint), ',' order by i) filter (where chosen and i >= p.p and role = 'assistant'), '') end as chosen_mask,
  case when nb > 0 then coalesce(string_agg(cast(off + 13 + lr as bigint) || '-' || cast(off + 13 + lr + lt + 10 as bigint), ',' order by i) filter (where not chosen and i >= p.p and role = 'assistant'), '') end as rejected_mask
from p join o using (pair_id) group by p.pair_id, chosen_id, rejected_id, p.p, p.na, nb
"""

#: Each conversation branched at its last answer.
OP3_SQL = r"""
with t as (select distinct conv_id, coalesce(turn, -1) as turn, role, text from conversations where conv_id is not null),
q as (select *, row_number() over (partition by conv_id order by turn, role nulls first, text nulls first) - 1 as i from t),
k as (select conv_id, max(i) filter (where role = 'assistant') as last, count(*) filter (where role = 'assistant') as m from q group by conv_id),
e as (select conv_id, max(i) as before from q join k using (conv_id) where role = 'assistant' and i < last group by conv_id),
s as (select conv_id, conv_id as pair_id, true as chosen, i, role, text from q join k using (conv_id) where last is null or i <= last
  union all select q.conv_id, q.conv_id, false, q.i, q.role, case when q.i = last then x.text else q.text end
  from q join k using (conv_id) join e using (conv_id) join q x on x.conv_id = q.conv_id and x.i = e.before where m > 1 and q.i <= last),
n as (select pair_id, max(case when chosen then conv_id end) as chosen_id, max(case when not chosen then conv_id end) as rejected_id,
  count(*) filter (where chosen) as na, count(*) filter (where not chosen) as nb from s group by pair_id),
d as (select a.pair_id, min(a.i) as first_diff from s a left join s b on a.pair_id = b.pair_id and a.i = b.i and a.chosen and not b.chosen
  where a.chosen and (b.conv_id is null or a.role is distinct from b.role or a.text is distinct from b.text) group by a.pair_id),
p as (select n.*, case when na > 0 and nb > 0 then coalesce(first_diff, na) else greatest(na, nb) - 1 end as p from n left join d using (pair_id)),
r as (select s.pair_id, s.chosen, s.i, p.p, p.na, s.role, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) as out,
  length(coalesce(role, '')) as lr, length(coalesce(text, '')) as lt from s join p using (pair_id)),
o as (select *, coalesce(sum(length(out)) over (partition by pair_id, chosen, i >= p order by i rows between unbounded preceding and 1 preceding), 0) as off from r)
select p.pair_id, chosen_id, rejected_id, cast(case when p.na > 0 and nb > 0 then p.p else 0 end as bigint) as n_common,
  coalesce(string_agg(out, '' order by i) filter (where i < p.p and chosen = (p.na > 0)), '') as prompt,
  case when p.na > 0 then coalesce(string_agg(out, '' order by i) filter (where chosen and i >= p.p), '') end as chosen,
  case when nb > 0 then coalesce(string_agg(out, '' order by i) filter (where not chosen and i >= p.p), '') end as rejected,
  case when p.na > 0 then coalesce(string_agg(cast(off + 13 + lr as bigint) || '-' || cast(off + 13 + lr + lt + 10 as bigint), ',' order by i) filter (where chosen and i >= p.p and role = 'assistant'), '') end as chosen_mask,
  case when nb > 0 then coalesce(string_agg(cast(off + 13 + lr as bigint) || '-' || cast(off + 13 + lr + lt + 10 as bigint), ',' order by i) filter (where not chosen and i >= p.p and role = 'assistant'), '') end as rejected_mask
from p join o using (pair_id) group by p.pair_id, chosen_id, rejected_id, p.p, p.na, nb
"""
