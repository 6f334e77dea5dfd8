"""The queries of ``queries()`` with their SQL, one for each operator family.

Boxes come from the words of ``documents`` (see ``operators.nodes.layout``); other
families read the star-schema tables. Every query runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, numbers, text
from ..functions.geometry import Box, bounding
from ..operators import classify, cluster, evaluate, joins, matching, nodes, packed, reduce

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def boxes(spark: SparkSession, d: str) -> DataFrame:
    return nodes.numbered(nodes.layout(read(spark, d, "documents")))


#: SQL of the layout: nodes(doc_id, r, k, text, l, t, rr, b, score, ix).
NODES = """
with li as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as r from documents),
tk as (select doc_id, r, unnest(string_split(line, ' ')) as text, generate_subscripts(string_split(line, ' '), 1) - 1 as k from li),
oc as (select *, coalesce(sum(length(text) + 1) over (partition by doc_id, r order by k rows between unbounded preceding and 1 preceding), 0) as c from tk),
nodes as materialized (select doc_id, r, k, text, cast(10 * c as bigint) as l, cast(20 * r + (7 * doc_id + 3 * k) % 5 as bigint) as t, cast(10 * (c + length(text)) as bigint) as rr,
  cast(20 * r + (7 * doc_id + 3 * k) % 5 + 12 + length(text) % 4 as bigint) as b, ((31 * doc_id + 17 * r + 7 * k) % 100) / 100.0::double as score,
  row_number() over (partition by doc_id order by r, k) - 1 as ix from oc where text <> '')
"""
#: Adds lines(.., line) to NODES.
LINES = NODES + """,
h as (select *, (t + b) / 2.0::double as cy, avg(b - t) over (partition by doc_id) * 0.15::double as gap from nodes),
g as (select *, case when cy - lag(cy) over (partition by doc_id order by cy, ix) >= gap then 1 else 0 end as n from h),
lines as (select *, cast(sum(n) over (partition by doc_id order by cy, ix rows unbounded preceding) as bigint) as line from g)
"""


@query(NODES + "select doc_id, cast(ix as bigint) as node_ix, text, l as \"left\", t as top, rr as \"right\", b as bottom, cast(score as double) as score from nodes")
def nodes_layout(spark, d):
    return boxes(spark, d).select("doc_id", F.col("node_ix").cast("long").alias("node_ix"), "text", "left", "top", "right", "bottom", F.col("score").cast("double").alias("score"))


@query(LINES + "select doc_id, line, string_agg(text, ' ' order by l, ix) as text, count(*) as n, min(l) as \"left\", min(t) as top, max(rr) as \"right\", max(b) as bottom from lines group by doc_id, line")
def row_lines(spark, d):
    n = cluster.joined(cluster.row_lines(boxes(spark, d)), ["doc_id", "line"], ["left", "node_ix"], " ")
    return n.select("doc_id", F.col("line").cast("long").alias("line"), "text", "n", "left", "top", "right", "bottom")


@query(NODES + """,
h as (select *, (l + rr) / 2.0::double as cx, avg(b - t) over (partition by doc_id) as gap from nodes),
g as (select *, case when cx - lag(cx) over (partition by doc_id order by cx, ix) >= gap then 1 else 0 end as n from h),
c as (select *, cast(sum(n) over (partition by doc_id order by cx, ix rows unbounded preceding) as bigint) as col from g)
select doc_id, col as "column", count(*) as n, min(l) as "left", max(rr) as "right" from c group by doc_id, col""")
def col_lines(spark, d):
    return packed.col_lines(read(spark, d, "documents"))


SEGMENTS = LINES + """,
sh as (select *, avg(b - t) over (partition by doc_id, line) as hh, max(rr) over (partition by doc_id, line order by l, ix rows between unbounded preceding and 1 preceding) as before from lines),
sg as (select *, case when l - before >= hh * 1.0 then 1 else 0 end as sn from sh),
segs as (select *, cast(sum(sn) over (partition by doc_id, line order by l, ix rows unbounded preceding) as bigint) as segment from sg)
"""


@query(SEGMENTS + "select doc_id, line, segment, string_agg(text, '' order by l, ix) as text, count(*) as n from segs group by doc_id, line, segment")
def x_segments(spark, d):
    return packed.x_segments(read(spark, d, "documents"))


@query(NODES + "select doc_id, count(*) as n, min(l) as \"left\", min(t) as top, max(rr) as \"right\", max(b) as bottom, cast(sum(b - t) as bigint) as height_sum, cast(sum(cast(round(score * 100) as bigint)) as bigint) as score_sum from nodes group by doc_id")
def document_boxes(spark, d):
    return boxes(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"), *bounding(), F.sum(F.col("bottom") - F.col("top")).alias("height_sum"), F.sum(F.round(F.col("score") * 100).cast("long")).alias("score_sum"))


@query(LINES + """,
w as (select *, count(*) over (partition by doc_id, line) as rn from lines)
select doc_id, line, max(rn) as row_nodes, count(distinct cast(floor(l / 200) as bigint)) as row_columns from w group by doc_id, line""")
def row_stats(spark, d):
    n = cluster.row_lines(boxes(spark, d)).withColumn("column", F.floor(F.col("left") / 200))
    return cluster.row_stats(n).groupBy("doc_id", F.col("line").cast("long").alias("line")).agg(F.max("row_nodes").alias("row_nodes"), F.max("row_columns").alias("row_columns"))


@query(LINES + """,
tx as (select doc_id, line, min(t) as top, max(b) as bottom, bool_or(regexp_matches(text, '[0-9]')) as is_key from lines group by doc_id, line),
a as (select *, last_value(case when is_key then line end ignore nulls) over (partition by doc_id order by line rows unbounded preceding) as at_,
  first_value(case when is_key then struct_pack(line := line, top := top, bottom := bottom) end ignore nulls) over (partition by doc_id order by line rows between 1 following and unbounded following) as nx from tx),
p as (select *, case when not is_key and nx is not null and greatest(bottom, nx.bottom) - least(top, nx.top) > 0
  and greatest(least(bottom, nx.bottom) - greatest(top, nx.top), 0) / cast(greatest(bottom, nx.bottom) - least(top, nx.top) as double) > 0.5 then nx.line else at_ end as key_line from a)
select doc_id, line, key_line from p where key_line is not null""")
def asof_key_rows(spark, d):
    return packed.asof_key_rows(read(spark, d, "documents"))


@query(LINES + """,
tx as (select doc_id, line, string_agg(text, ' ' order by l, ix) as text from lines group by doc_id, line),
s as (select *, min(case when regexp_matches(text, '[#$%&*]') then line end) over (partition by doc_id) as stop from tx)
select doc_id, line, text from s where stop is null or line < stop""")
def stop_line_cut(spark, d):
    return packed.stop_line_cut(read(spark, d, "documents"))


# fields: words with digits in two areas, reduced by weight
AREAS = [("code", 0, 0.0, 0.0, 400.0, 60.0, 2.0, 0.5), ("code", 1, 0.0, 0.0, 100000.0, 100000.0, 1.0, 0.5), ("mark", 0, 0.0, 0.0, 100000.0, 100000.0, 1.0, 0.5)]
RULES = [("code", "([0-9]{3,})", 1.0), ("code", "([0-9]+[.][0-9]+)", 2.0), ("mark", "([A-Z]{4,})", 1.0)]


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Boxes, lines, segments in reading order, then fields by area and pattern: one value a document and field."""
    n = cluster.x_segments(cluster.row_lines(boxes(spark, d)), 2.0)
    seg = cluster.joined(n.withColumn("_sc", F.array("score")), ["doc_id", "line", "segment"], ["left", "node_ix"], " ", scores="_sc")
    seg = seg.withColumn("score", text.mean_score(F.col("scores"))).withColumn("node_ix", F.row_number().over(Window.partitionBy("doc_id").orderBy("line", "segment")))
    areas = spark.createDataFrame(AREAS, "item_name string, area_ord int, l double, t double, r double, b double, w double, ioo double")
    rules = spark.createDataFrame(RULES, "item_name string, pattern string, w double")
    out = reduce.extract_fields(seg, areas, rules)
    return out.select("doc_id", "item_name", "content", F.round("probability", 6).alias("probability"))


def _rules_sql(rows: list[tuple], names: str) -> str:
    lit = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else (f"{x}::double" if isinstance(x, float) else str(x))
    return "(values " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") v({names})"


@query(SEGMENTS.replace("hh * 1.0", "hh * 2.0") + f""",
sj as (select doc_id, line, segment, string_agg(text, ' ' order by l, ix) as text, min(l) as l, min(t) as t, max(rr) as rr, max(b) as b, avg(score) as score,
  row_number() over (partition by doc_id order by line, segment) as ix from segs group by doc_id, line, segment),
ar as (select * from {_rules_sql(AREAS, 'item, ord, al, at_, ar_, ab, w, ioo')}), ru as (select * from {_rules_sql(RULES, 'item, pat, rw')}),
x as (select sj.*, ar.*, (greatest(least(rr, ar_) - greatest(l, al), 0) * greatest(least(b, ab) - greatest(t, at_), 0)) as inter, cast((rr - l) * (b - t) as double) as own, (ar_ - al) * (ab - at_) as other from sj, ar),
y as (select *, inter / (own + other - inter) as iou from x where inter / (own + 1e-8) > ioo),
z as (select y.*, regexp_extract(text, pat, 1) as value, w * rw as ww from y join ru using (item) where regexp_matches(text, pat)),
q as (select *, row_number() over (partition by doc_id, item order by w desc, ord, ww desc, iou desc, ix) as n from z where value <> '')
select doc_id, item as item_name, value as content, round(score, 6) as probability from q where n = 1""")
def field_top1(spark, d):
    return flagship(spark, d)


# spatial joins
@query(NODES + """,
a as (select * from nodes where ix = 0)
select a.doc_id, b.ix as node_ix, b.text from a join nodes b on a.doc_id = b.doc_id and b.ix <> 0 and (b.l + b.rr) / 2.0 > a.l - (a.rr - a.l) and (b.l + b.rr) / 2.0 < a.l + 3 * (a.rr - a.l)
  and (b.t + b.b) / 2.0 > a.t - 2 * (a.b - a.t) and (b.t + b.b) / 2.0 < a.t + 4 * (a.b - a.t)""")
def region_window(spark, d):
    n = boxes(spark, d)
    return joins.in_window(n.filter("node_ix = 0"), n).select(F.col("a_doc_id").alias("doc_id"), F.col("b_node_ix").cast("long").alias("node_ix"), F.col("b_text").alias("text"))


@query(NODES + """,
a as (select * from nodes where ix = 0)
select a.doc_id, b.ix as node_ix, b.text from a join nodes b on a.doc_id = b.doc_id and b.ix <> 0
where ((b.l between a.rr and a.rr + 2 * (a.rr - a.l)) and ((b.t + b.b) / 2.0 between a.t - 2 and a.b + 2)) or ((b.l between a.l - 5 and a.rr + 5) and ((b.t + b.b) / 2.0 between a.b and a.b + 2 * (a.b - a.t)))""")
def region_lookup(spark, d):
    n = boxes(spark, d)
    out = joins.by_region(n.filter("node_ix = 0"), n, ["R", "B"], (5.0, 2.0), 2.0, "left")
    return out.select(F.col("a_doc_id").alias("doc_id"), F.col("b_node_ix").cast("long").alias("node_ix"), F.col("b_text").alias("text"))


@query(NODES + """,
a as (select * from nodes where ix = 0)
select a.doc_id, b.ix as node_ix, b.text from a join nodes b on a.doc_id = b.doc_id and b.ix <> 0 and b.l between a.rr and a.rr + 500 and (b.t + b.b) / 2.0 between a.t - 3 and a.b + 3""")
def boundary_lookup(spark, d):
    n = boxes(spark, d)
    out = joins.by_boundary(n.filter("node_ix = 0"), n, lambda a: Box(a.right, a.top - 3, a.right + 500, a.bottom + 3))
    return out.select(F.col("a_doc_id").alias("doc_id"), F.col("b_node_ix").cast("long").alias("node_ix"), F.col("b_text").alias("text"))


@query(NODES + """,
p as (select a.doc_id, a.ix, b.ix as near, abs((a.l + a.rr) / 2.0 - (b.l + b.rr) / 2.0) + abs((a.t + a.b) / 2.0 - (b.t + b.b) / 2.0) as distance,
  row_number() over (partition by a.doc_id, a.ix order by abs((a.l + a.rr) / 2.0 - (b.l + b.rr) / 2.0) + abs((a.t + a.b) / 2.0 - (b.t + b.b) / 2.0), b.ix) as n
  from nodes a join nodes b on a.doc_id = b.doc_id and a.ix <> b.ix where regexp_matches(a.text, '[0-9]'))
select doc_id, ix as node_ix, near as near_ix, cast(distance as double) as distance from p where n = 1""")
def nearest_node(spark, d):
    n = boxes(spark, d)
    out = joins.nearest(n.filter(F.rlike("text", F.lit("[0-9]"))), n, Box.center_manhattan)
    return out.select(F.col("a_doc_id").alias("doc_id"), F.col("a_node_ix").cast("long").alias("node_ix"), F.col("b_node_ix").cast("long").alias("near_ix"), "distance")


@query(NODES + """,
h as (select doc_id, ix, l, rr, coalesce((lag(rr) over w + l) / 2.0, 0) as lo, coalesce((rr + lead(l) over w) / 2.0, 10000) as hi, row_number() over w - 1 as c from nodes where r = 0 window w as (partition by doc_id order by l, ix))
select n.doc_id, n.ix as node_ix, min(h.c) as "column" from nodes n left join h on n.doc_id = h.doc_id and (n.l + n.rr) / 2.0 > lo and (n.l + n.rr) / 2.0 <= hi where n.r > 0 group by n.doc_id, n.ix""")
def interval_columns(spark, d):
    n = boxes(spark, d)
    h = joins.header_intervals(n.filter("r = 0"))
    out = joins.assign_columns(n.filter("r > 0").select("doc_id", "node_ix", "left", "right"), h)
    return out.select("doc_id", F.col("node_ix").cast("long").alias("node_ix"), F.col("column").cast("long").alias("column"))


@query(NODES + """,
box as (select doc_id, ix, l, t, rr, b from nodes union all select doc_id, -1 - ix, l - 1, t - 1, rr + 1, b + 1 from nodes where regexp_matches(text, '[0-9]'))
select x.doc_id, x.ix as node_ix from box x where not exists (select 1 from box y where y.doc_id = x.doc_id and y.ix <> x.ix
  and ((x.rr - x.l) * (x.b - x.t) < (y.rr - y.l) * (y.b - y.t) or ((x.rr - x.l) * (x.b - x.t) = (y.rr - y.l) * (y.b - y.t) and x.ix > y.ix)) and y.t <= x.b and y.b >= x.t
  and greatest(least(x.rr, y.rr) - greatest(x.l, y.l), 0) * greatest(least(x.b, y.b) - greatest(x.t, y.t), 0) / ((x.rr - x.l) * (x.b - x.t) + 1e-8) >= 0.9)""")
def overlap_removed(spark, d):
    n = boxes(spark, d).select("doc_id", F.col("node_ix").cast("long").alias("node_ix"), "text", "left", "top", "right", "bottom")
    around = n.filter(F.rlike("text", F.lit("[0-9]"))).select("doc_id", (-1 - F.col("node_ix")).alias("node_ix"), "text", F.col("left") - 1, F.col("top") - 1, F.col("right") + 1, F.col("bottom") + 1)
    both = n.union(around)
    # a box that covers another overlaps its centre: bands of the page keep pairs near each other
    def on(a, b):
        smaller = (a.area < b.area) | ((a.area == b.area) & (F.col("a_node_ix") > F.col("b_node_ix")))
        return (F.col("a_node_ix") != F.col("b_node_ix")) & smaller & (a.ioo(b) >= 0.9)

    covered = joins.spatial_join(both, both, on, cell=40.0, reach=0.0).select(F.col("a_doc_id").alias("doc_id"), F.col("a_node_ix").alias("node_ix")).distinct()
    return both.select("doc_id", "node_ix").join(covered, ["doc_id", "node_ix"], "left_anti")


@query(NODES + """,
f as (select * from nodes where regexp_matches(text, '[.]$')), q as (select doc_id, max(l) over (partition by doc_id) as w, max(b) over (partition by doc_id) as hh, l as x, t as y from f)
select doc_id, count(*) >= 4 and count(distinct (case when x >= w / 2.0 then 2 else 0 end + case when y >= hh / 2.0 then 1 else 0 end)) >= 3 as ok from q group by doc_id""")
def perspective_gate(spark, d):
    w = Window.partitionBy("doc_id")
    p = boxes(spark, d).filter(F.rlike("text", F.lit("[.]$"))).select("doc_id", F.col("left").alias("x"), F.col("top").alias("y"), F.max("left").over(w).alias("w"), F.max("bottom").over(w).alias("h"))
    return reduce.perspective_gate(p, F.col("w"), F.col("h"))


@query(NODES + """,
p as (select doc_id, l as ax, (t + b) / 2.0 as ay, l + 3 as bx, (t + b) / 2.0 - 2 as by_ from nodes where ix < 3),
c as (select doc_id, dx, dy, avg(sqrt((bx + dx - ax) * (bx + dx - ax) + (by_ + dy - ay) * (by_ + dy - ay))) as cost from p, range(-5, 6) x(dx), range(-5, 6) y(dy) group by doc_id, dx, dy),
n as (select *, row_number() over (partition by doc_id order by round(cost, 9), dx, dy) as n from c)
select doc_id, cast(dx as bigint) as dx, cast(dy as bigint) as dy, round(cost, 6) as cost from n where n = 1""")
def anchor_offset(spark, d):
    cy = (F.col("top") + F.col("bottom")) / 2
    p = boxes(spark, d).filter("node_ix < 3").select("doc_id", F.col("left").alias("ax"), cy.alias("ay"), (F.col("left") + 3).alias("bx"), (cy - 2).alias("by"))
    o = reduce.offset_by_anchor(p, 5)
    return o.select("doc_id", F.col("dx").cast("long").alias("dx"), F.col("dy").cast("long").alias("dy"), F.round("cost", 6).alias("cost"))


# scalars over tokens and keys
TYPE_SQL = "case when regexp_matches(x, '^[0-9.,]+$') then 'ALL_NUM' when regexp_matches(x, '^[A-Za-z]+$') then 'ALL_CHAR' when regexp_matches(x, '^[^0-9A-Za-z]+$') then 'ALL_SPEC' when regexp_matches(x, '^[0-9.,]+[A-Za-z]+$') then 'NUM2CHAR' else 'MIX' end"


@query(NODES + f"select {TYPE_SQL} as text_type, count(*) as n from (select translate(text, ' _', '') as x from nodes) group by 1")
def text_type(spark, d):
    return boxes(spark, d).groupBy(text.text_type(F.col("text")).alias("text_type")).agg(F.count("*").alias("n"))


@query(r"""
with x as (select doc_id, regexp_replace(text, '[^ -~]', '', 'g') as s from documents)
select doc_id, regexp_replace(s, '[^0-9]', '', 'g') as digits, length(regexp_replace(s, '[^A-Z]', '', 'g')) as upper, trim(regexp_replace(s, '[^0-9A-Za-z]+', '_', 'g'), '_') as clean,
  coalesce(list_max(list_transform(regexp_extract_all(s, '[0-9]+'), lambda y: length(y))), 0) as longest, length(regexp_replace(s, '[^0-9A-Za-z]', '', 'g')) as alnum from x""")
def string_clean(spark, d):
    s = F.regexp_replace("text", "[^ -~]", "")
    x = read(spark, d, "documents").select("doc_id", s.alias("s"))
    c = F.col("s")
    return x.select("doc_id", text.only_digits(c).alias("digits"), text.count_upper(c).cast("long").alias("upper"), text.clean_english(c).alias("clean"), text.longest_digit_run(c).cast("long").alias("longest"), text.count_alnum(c).cast("long").alias("alnum"))


@query("""
select p_partkey, lower(regexp_replace(regexp_replace(c, '([^_])([A-Z][a-z]+)', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) as snake, c as camel
from (select p_partkey, array_to_string(list_transform(string_split(replace(p_name, ' ', '_'), '_'), lambda x: upper(x[1:1]) || x[2:]), '') as c from part)""")
def camel_snake(spark, d):
    p = read(spark, d, "part").select("p_partkey", text.snake_to_camel(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("camel"))
    return p.select("p_partkey", text.camel_to_snake(F.col("camel")).alias("snake"), "camel")


@query("""
with o as (select o_orderkey, printf('%.2f', o_totalprice) as s from orders),
x as (select o_orderkey, s, translate(s, '015', 'OIS') as bad from o),
y as (select *, regexp_replace(translate(regexp_replace(bad, '^[Y¥￥]', ''), 'OoDQUIlZSBGY，。', '000001125867,.'), '[^0-9.,_]', '', 'g') as f from x)
select o_orderkey, bad, string_split(f, '.')[1] || '.' || string_split(f, '.')[2] as repaired, s = string_split(f, '.')[1] || '.' || string_split(f, '.')[2] as same from y""")
def money_repair(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.format_string("%.2f", "o_totalprice").alias("s"))
    o = o.withColumn("bad", F.translate("s", "015", "OIS"))
    return o.select("o_orderkey", "bad", numbers.repair_money(F.col("bad")).alias("repaired"), (F.col("s") == numbers.repair_money(F.col("bad"))).alias("same"))


@query("""
with x as (select l_orderkey, l_linenumber, printf('%.2f', l_extendedprice) as s from lineitem)
select l_orderkey, l_linenumber, s as number from x""")
def financial_number(spark, d):
    x = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2).alias("s"))
    return x.select("l_orderkey", "l_linenumber", numbers.financial_number(F.col("s")).alias("number"))


@query("""
with x as (select c_custkey, cast(c_custkey * 7919 as varchar) as s from customer),
c as (select c_custkey, s, list_filter(list_transform(range(1, length(s)), lambda i: s[1:i] || '.' || s[i + 1:]), lambda y: cast(y as double) between 10 and 999) as f from x)
select c_custkey, f[1] as dotted from c""")
def add_dot(spark, d):
    x = read(spark, d, "customer").select("c_custkey", (F.col("c_custkey") * 7919).cast("string").alias("s"))
    return x.select("c_custkey", numbers.add_dot(F.col("s"), F.lit(10.0), F.lit(999.0)).alias("dotted"))


@query("""
with x as (select c_custkey, lpad(cast(c_custkey as varchar), 17, '1') as s from customer),
w as (select c_custkey, s, list_sum(list_transform(range(1, 18), lambda i: cast(s[i:i] as bigint) * ((1 << (18 - i)) % 11))) % 11 as m from x)
select c_custkey, s || '10X98765432'[cast(m as int) + 1 : cast(m as int) + 1] as full_id, true as valid from w""")
def id_checksum(spark, d):
    x = read(spark, d, "customer").select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 17, "1").alias("s"))
    return x.select("c_custkey", F.concat("s", numbers.check_char(F.col("s"))).alias("full_id"), numbers.is_valid_id(F.concat("s", numbers.check_char(F.col("s")))).alias("valid"))


@query("select o_orderkey, printf('%.2f', o_totalprice) as number, true as same from orders")
def amount_round_trip(spark, d):
    x = read(spark, d, "orders").select("o_orderkey", F.format_string("%.2f", "o_totalprice").alias("s"))
    x = x.withColumn("number", numbers.words_to_number(numbers.number_to_words(F.col("s"))))
    return x.select("o_orderkey", "number", (F.col("number") == F.col("s")).alias("same"))


@query("""
with x as (select o_orderkey, strftime(o_orderdate, '%Y%m%d') as a, strftime(o_orderdate, '%Y-%m-') || lpad(cast(o_orderkey % 33 as varchar), 2, '0') as b from orders)
select o_orderkey, a[1:4] || '-' || a[5:6] || '-' || a[7:8] as iso, try_strptime(b, '%Y-%m-%d') is not null as legal from x""")
def date_validity(spark, d):
    x = read(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("a"), F.concat(F.date_format("o_orderdate", "yyyy-MM-"), F.lpad((F.col("o_orderkey") % 33).cast("string"), 2, "0")).alias("b"))
    return x.select("o_orderkey", dates.fixed_width(F.col("a")).alias("iso"), dates.is_legal_text(F.col("b")).alias("legal"))


@query("""
with x as (select o_orderkey, case o_orderkey % 3 when 0 then strftime(o_orderdate, '%y') when 1 then strftime(o_orderdate, '%Y')[2:4] else strftime(o_orderdate, '%Y') end as y, strftime(o_orderdate, '%m') as m, strftime(o_orderdate, '%d') as d from orders),
f as (select *, case length(y) when 2 then case when cast(y as int) < 50 then '20' || y else '19' || y end when 3 then case when y[1] = '9' then '1' || y else '2' || y end else y end as full_ from x)
select o_orderkey, full_ as year, m as month, d as day from f""")
def date_fields(spark, d):
    o = F.col("o_orderdate")
    y = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(o, "yy")).when(F.col("o_orderkey") % 3 == 1, F.substr(F.date_format(o, "yyyy"), F.lit(2), F.lit(3))).otherwise(F.date_format(o, "yyyy"))
    x = read(spark, d, "orders").select("o_orderkey", dates.normal_fields(y, F.date_format(o, "MM"), F.date_format(o, "dd")).alias("f"))
    return x.select("o_orderkey", F.col("f.y").alias("year"), F.col("f.m").alias("month"), F.col("f.d").alias("day"))


@query("""
with x as (select l_orderkey, l_linenumber, cast(o_orderdate as date) as s, cast(l_shipdate as date) as e, l_orderkey % 3 as m from lineitem join orders on l_orderkey = o_orderkey)
select l_orderkey, l_linenumber, strftime(s, '%Y-%m-%d') as "start", strftime(e, '%Y-%m-%d') as "end",
  case when m = 2 then case when date_diff('day', s, e) >= 0 and date_diff('day', s, e) < 400 then date_diff('day', s, e) end else date_diff('day', s, e) end as stay from x""")
def stay_impute(spark, d):
    x = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    m = F.col("l_orderkey") % 3
    stay = F.date_diff("l_shipdate", "o_orderdate")
    f = dates.impute_stay(F.when(m != 0, day("o_orderdate")), F.when(m != 1, day("l_shipdate")), F.when(m != 2, stay))
    return x.select("l_orderkey", "l_linenumber", f.alias("f")).select("l_orderkey", "l_linenumber", "f.start", "f.end", F.col("f.stay").cast("long").alias("stay"))


# fuzzy joins
WORDS_SQL = "words as (select distinct w as word from (select unnest(string_split(p_name, ' ')) as w from part) where w <> '')"


def part_words(spark, d):
    return read(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).filter("word <> ''").distinct()


def event_words(spark, d):
    """Words with an error: the second character gone and the last doubled."""
    w = part_words(spark, d)
    return w.select(F.concat(F.substr("word", F.lit(1), F.lit(1)), F.substr("word", F.lit(3)), F.right("word", F.lit(1))).alias("q"))


FUZZY_SQL = f"with {WORDS_SQL}, q as (select distinct word[1:1] || word[3:] || word[length(word):] as q from words) select q, word, levenshtein(q, word) as ed from q, words where levenshtein(q, word) <= 2"


@query(FUZZY_SQL)
def fuzzy_within_k(spark, d):
    return joins.fuzzy_within(event_words(spark, d), part_words(spark, d), 2).select("q", "word", F.col("ed").cast("long").alias("ed"))


@query()
def fuzzy_best(spark, d):
    return joins.fuzzy_best(event_words(spark, d), part_words(spark, d), 2, 3)


@query(NODES + ", x as (select text, count(*) as n from (select regexp_replace(text, '[^A-Za-z]', '', 'g') as text from nodes) group by text) select text, n, levenshtein(text, 'that') <= 1 or levenshtein(text, 'the') <= 1 as near from x")
def edit_match(spark, d):
    x = boxes(spark, d).groupBy(F.regexp_replace("text", "[^A-Za-z]", "").alias("text")).agg(F.count("*").alias("n"))
    return x.select("text", "n", matching.keyword_edits({"that": 1, "the": 1})(F.col("text")).alias("near"))


# routing
@query(r"""
with cc as (select lang as cls, unnest(string_split(regexp_replace(lower(text), '\s\s+', ' ', 'g'), '')) as ch from documents),
c as (select cls, ch, count(*) as tf from cc where ch <> '' group by cls, ch), n as (select count(distinct lang) as n from documents),
idf as (select ch, ln((1 + any_value(n.n)) / cast(1 + count(*) as double)) + 1 as idf from c, n group by ch),
qq as (select conv_id * 100 + turn as id, unnest(string_split(regexp_replace(lower(text), '\s\s+', ' ', 'g'), '')) as ch from conversations),
q as (select id, ch, count(*) as tf from qq where ch <> '' group by id, ch),
cw as (select cls, ch, tf * idf as w from c join idf using (ch)), qw as (select id, ch, tf * idf as w from q join idf using (ch)),
cn as (select cls, sqrt(sum(w * w)) as norm from cw group by cls), qn as (select id, sqrt(sum(w * w)) as norm from qw group by id),
s as (select id, cls, sum(qw.w / qn.norm * cw.w / cn.norm) as cosine from qw join qn using (id) join cw using (ch) join cn using (cls) group by id, cls),
r as (select *, row_number() over (partition by id order by round(cosine, 9) desc, cls) as n from s)
select id, cls as class_name, round(cosine, 6) as cosine from r where n = 1""")
def tfidf_route(spark, d):
    c = read(spark, d, "documents").select(F.col("lang").alias("class_name"), "text")
    q = read(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    return classify.route_tfidf(c, q, "id").select("id", "class_name", F.round("cosine", 6).alias("cosine"))


CATEGORIES = [("licence", 1, ["licensed"], []), ("licence", 2, ["License."], ["the"]), ("plain", 3, [], ["$"])]


@query("""
select doc_id, case when contains(text, 'licensed') then 'licence' when contains(text, 'License.') and not contains(text, 'the') then 'licence' when not contains(text, '$') then 'plain' end as category
from documents where contains(text, 'licensed') or (contains(text, 'License.') and not contains(text, 'the')) or not contains(text, '$')""")
def rule_route(spark, d):
    rules = spark.createDataFrame(CATEGORIES, "category string, ord int, must array<string>, must_not array<string>")
    return reduce.categories(read(spark, d, "documents"), rules)


@query("select c_custkey as doc_id, case when c_custkey % 5 = 0 then 'own' when c_custkey % 5 = 1 then 'class-a' when c_custkey % 5 = 2 then 'class-b' when c_custkey % 2 = 0 then 'guess' end as class_name from customer")
def codes_route(spark, d):
    k = F.col("c_custkey") % 5
    docs = read(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.when(k == 0, "own").alias("class_name"), F.when(k == 1, "01").when(k == 2, "02").alias("primary_class"), F.when(k == 2, "x").alias("secondary_class"))
    codes = spark.createDataFrame([("01", None, "class-b2"), ("01", None, "class-a"), ("02", "x", "class-b")], "primary_class string, secondary_class string, class_name string")
    guess = docs.filter("doc_id % 2 = 0").select("doc_id", F.lit("guess").alias("class_name"))
    return classify.route(docs, codes, guess)


# evaluation: quality labels against a rule on the length of the text
GRADED = "g as (select l.doc_id as fid, case when l.doc_id % 2 = 0 then 'even' else 'odd' end as item_name, cast(quality as varchar) as gt, case when d.n_chars % 7 = 0 then null when n_chars > 700 then '1' else '0' end as pred, ((l.doc_id * 37) % 101) / 100.0::double as prob from labels l join documents d using (doc_id))"
COUNT_SQL = "count(*) as cnt_gt, count(*) filter (ok) as cnt_pass, count(*) filter (hit) as cnt_hit, count(*) filter (hit and ok) as cnt_pass_hit, count(*) filter (not hit) as cnt_err, count(*) filter (not hit and ok) as cnt_pass_err, cast(0 as bigint) as cnt_invalid, cast(0 as bigint) as cnt_pass_invalid"


def graded(spark, d):
    x = read(spark, d, "labels").join(read(spark, d, "documents"), "doc_id")
    pred = F.when(F.col("n_chars") % 7 == 0, None).when(F.col("n_chars") > 700, "1").otherwise("0")
    return x.select(F.col("doc_id").alias("fid"), F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("item_name"), F.col("quality").cast("string").alias("gt"), pred.alias("pred"), (((F.col("doc_id") * 37) % 101) / 100.0).alias("prob"))


@query(f"with {GRADED}, h as (select *, coalesce(gt = pred, false) as hit, pred is not null and prob >= 0.8 as ok from g) select item_name, {COUNT_SQL} from h group by item_name")
def eval_counters(spark, d):
    return evaluate.counters(graded(spark, d), ["item_name"])


@query(f"with {GRADED}, h as (select *, coalesce(gt = pred, false) as hit, pred is not null and prob >= 0.8 as ok from g), c as (select item_name, {COUNT_SQL} from h group by rollup(item_name)) select item_name, cnt_gt, round(cnt_hit / cnt_gt::double, 6) as acc, round(cnt_pass / cnt_gt::double, 6) as keep, round(case when cnt_pass > 0 then cnt_pass_hit / cnt_pass::double else 0 end, 6) as keep_acc from c")
def eval_total(spark, d):
    r = evaluate.ratios(evaluate.counters(graded(spark, d), ["item_name"], total=True))
    return r.select("item_name", "cnt_gt", *[F.round(c, 6).alias(c) for c in ("acc", "keep", "keep_acc")])


@query(f"""
with {GRADED}, t as (select i as k, round(0.5 + i * 0.01, 6) as thresh from range(0, 51) r(i)),
c as (select item_name, thresh, count(*) as cnt_gt, count(*) filter (pred is not null and round((prob - 0.5) / 0.01, 6) >= k) as cnt_pass, count(*) filter (pred is not null and round((prob - 0.5) / 0.01, 6) >= k and gt = pred) as cnt_pass_hit from g, t group by item_name, thresh)
select item_name, cast(thresh as double) as thresh, cnt_gt, cnt_pass, cnt_pass_hit from c""")
def thresh_sweep(spark, d):
    t = evaluate.thresholds(graded(spark, d), 0.5, 1.0, 0.01, ["item_name"])
    return t.select("item_name", "thresh", "cnt_gt", F.col("cnt_pass").cast("long").alias("cnt_pass"), F.col("cnt_pass_hit").cast("long").alias("cnt_pass_hit"))


PRED_ROWS = "p as (select l_orderkey, l_linenumber, case when (l_orderkey + l_linenumber) % 5 = 0 then l_returnflag || 'x' else l_returnflag end as v from lineitem where (l_orderkey + l_linenumber) % 7 <> 0)"


@query(f"with {PRED_ROWS} select l.l_linenumber as row_ix, count(*) as n, count(*) filter (p.v = l.l_returnflag) as hits, count(p.v) as found from (select l_orderkey, l_linenumber, any_value(l_returnflag) as l_returnflag from lineitem group by l_orderkey, l_linenumber having count(*) = 1) l left join (select l_orderkey, l_linenumber, any_value(v) as v from p group by l_orderkey, l_linenumber) p on l.l_orderkey = p.l_orderkey and l.l_linenumber = p.l_linenumber group by l.l_linenumber")
def eval_rows(spark, d):
    li = read(spark, d, "lineitem")
    w = Window.partitionBy("l_orderkey", "l_linenumber")
    once = li.withColumn("_n", F.count("*").over(w)).filter("_n = 1")
    cells = lambda v, df: df.select(F.col("l_orderkey").alias("fid"), F.lit("items").alias("table_name"), F.col("l_linenumber").alias("row_ix"), F.lit("flag").alias("col_name"), v.alias("value"))
    gt = cells(F.col("l_returnflag"), once)
    s = F.col("l_orderkey") + F.col("l_linenumber")
    pred = cells(F.when(s % 5 == 0, F.concat("l_returnflag", F.lit("x"))).otherwise(F.col("l_returnflag")), once.filter(s % 7 != 0)).withColumn("prob", F.lit(1.0))
    j = evaluate.compare_rows(gt, pred)
    return j.groupBy(F.col("row_ix").cast("long").alias("row_ix")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("gt") == F.col("pred"), F.lit(False))).alias("hits"), F.count("pred").alias("found"))


@query("""
with p as (select o_orderkey % 100 as fid, o_orderkey as k, o_orderstatus || case when o_orderkey % 9 = 0 then '!' else '' end as v from orders where o_orderkey % 4 <> 0)
select g.o_orderkey % 100 as fid, count(*) as n, count(*) filter (p.v = g.o_orderstatus) as hits from orders g left join p on p.fid = g.o_orderkey % 100 and p.k = g.o_orderkey group by 1""")
def eval_keys(spark, d):
    o = read(spark, d, "orders").select((F.col("o_orderkey") % 100).alias("fid"), F.col("o_orderkey").alias("name"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("row_ix"), F.lit(1.0).alias("prob"))
    pred = o.filter("name % 4 <> 0").withColumn("value", F.concat("value", F.when(F.col("name") % 9 == 0, "!").otherwise("")))
    j = evaluate.compare_keys(o, pred, "name", "value")
    return j.groupBy("fid").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("gt") == F.col("pred"), F.lit(False))).alias("hits"))


@query("""
with a as (select doc_id, quality, case when n_chars > 700 then 1 else 0 end as p from labels join documents using (doc_id)), b as (select doc_id, quality, case when n_chars % 2 = 0 then 1 else 0 end as p from labels join documents using (doc_id)),
x as (select doc_id, p from a where p <> quality), y as (select doc_id, p from b where p <> quality)
select case when y.doc_id is null then 'only_a' when x.doc_id is null then 'only_b' when x.p = y.p then 'same_error' else 'other_error' end as kind, count(*) as n from x full join y on x.doc_id = y.doc_id group by 1""")
def experiment_diff(spark, d):
    j = read(spark, d, "labels").join(read(spark, d, "documents"), "doc_id")
    wrong = lambda p: j.select("doc_id", "quality", p.cast("int").alias("pred")).filter("pred <> quality")
    out = evaluate.experiment_diff(wrong(F.col("n_chars") > 700), wrong(F.col("n_chars") % 2 == 0), ["doc_id"])
    return out.groupBy("kind").agg(F.count("*").alias("n"))


# pages, sets and sequences
@query("""
with i as (select conv_id, turn, 'role_last' as item_name, role as content from conversations union all select conv_id, turn, 'table_text', text from conversations)
select conv_id as doc_id, item_name, case when item_name = 'table_text' then string_agg(content, chr(10) order by turn) else arg_max(content, turn) end as content from i group by conv_id, item_name""")
def page_merge(spark, d):
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "role", "text")
    items = c.select("doc_id", "page", F.lit("role_last").alias("item_name"), F.col("role").alias("content")).unionByName(c.select("doc_id", "page", F.lit("table_text").alias("item_name"), F.col("text").alias("content")))
    return reduce.merge_pages(items)


@query(LINES + """,
tx as (select doc_id, line, string_agg(text, ' ' order by l, ix) as text from lines group by doc_id, line)
select doc_id, line, 'both' as kind from tx where regexp_matches(text, '[0-9]') and regexp_matches(text, '[A-Z]{2}')
union all select doc_id, line, 'either' from tx where regexp_matches(text, '[0-9]') or regexp_matches(text, '[A-Z]{2}')""")
def key_row_sets(spark, d):
    return packed.key_row_sets(read(spark, d, "documents"))


@query("""
with x as (select l_orderkey, l_linenumber, lag(l_linenumber) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as p from lineitem)
select l_orderkey, coalesce(bool_and(p is null or l_linenumber >= p), true) as ordered, count(*) filter (p + 1 = l_linenumber) as steps from x group by l_orderkey""")
def numbered_rows(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    x = read(spark, d, "lineitem").withColumn("p", F.lag("l_linenumber").over(w))
    return x.groupBy("l_orderkey").agg(F.bool_and(F.col("p").isNull() | (F.col("l_linenumber") >= F.col("p"))).alias("ordered"), F.count_if(F.coalesce(F.col("p") + 1 == F.col("l_linenumber"), F.lit(False))).alias("steps"))


@query("""
with p as (select page_id, regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g') as s, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages)
select page_id, title, length(s) as n_chars, regexp_extract(html, 'lang="([a-z]+)"', 1) as lang from p join pages using (page_id)""")
def page_fields(spark, d):
    p = read(spark, d, "pages")
    bare = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", ""), "[\\t\\n\\f\\r ]+", " ")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.length(bare).cast("long").alias("n_chars"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"))


@query("""
with s as (select user_id, event_type, ts, event_id, case when date_diff('second', lag(ts) over w, ts) > 1800 or lag(ts) over w is null then 1 else 0 end as n from events window w as (partition by user_id order by ts, event_id)),
g as (select *, sum(n) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from s)
select user_id, cast(session as bigint) as session, count(*) as n, count(distinct event_type) as kinds from g group by user_id, session""")
def event_sessions(spark, d):
    e = read(spark, d, "events").withColumn("at", F.unix_timestamp("ts"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("_n", F.coalesce((F.col("at") - F.lag("at").over(w) > 1800).cast("int"), F.lit(1)))
    e = e.withColumn("session", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"))


@query()
def paragraphs(spark, d):
    return packed.paragraph_boxes(read(spark, d, "documents"))


@query()
def sequence_match(spark, d):
    b = read(spark, d, "benchmark")
    return b.select("item_id", F.round(text.block_ratio(F.col("text"), F.lit("the and that on er")), 6).alias("ratio"), text.lcs_length(F.col("text"), F.lit("the and that on er")).alias("lcs"))


from . import scalars  # noqa: E402, F401  registers its queries
