"""Operators against plain Python, and their edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.functions.geometry import Box
from scriptorium.operators import address, classify, cluster, evaluate, joins, lattice, matching, nodes, reduce, registration, tables, template
from scriptorium.sources import readers, sinks

BOX = "doc_id long, node_ix int, text string, left double, top double, right double, bottom double"


def boxes(spark, rows):
    return spark.createDataFrame([(*r[:3], *map(float, r[3:])) for r in rows], BOX)


def random_boxes(seed, docs=8, n=30):
    r = random.Random(seed)
    return [(d, k, f"w{k}", x := float(r.randrange(200)), y := float(r.randrange(100)), x + r.randrange(1, 40), y + r.randrange(5, 15)) for d in range(docs) for k in range(n)]


def test_row_lines_equal_the_fold(spark):
    rows = random_boxes(1)
    got = {(r.doc_id, r.node_ix): r.line for r in cluster.row_lines(boxes(spark, rows), 0.5).collect()}
    for d in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == d), key=lambda r: ((r[4] + r[6]) / 2, r[1]))
        t = sum(r[6] - r[4] for r in own) / len(own) * 0.5
        lines = []
        for r in own:
            cy = (r[4] + r[6]) / 2
            for k, last in enumerate(lines):
                if cy - last < t:
                    lines[k], hit = cy, k
                    break
            else:
                lines.append(cy)
                hit = len(lines) - 1
            assert got[d, r[1]] == hit


def test_segments_equal_interval_merging(spark):
    rows = random_boxes(2)
    got = {(r.doc_id, r.node_ix): r.segment for r in cluster.x_segments(boxes(spark, rows), 0.3, ["doc_id"]).collect()}
    for d in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == d), key=lambda r: (r[3], r[1]))
        t, right, k = sum(r[6] - r[4] for r in own) / len(own) * 0.3, None, 0
        for r in own:
            if right is not None and r[3] - right >= t:
                k += 1
            right = r[5] if right is None else max(right, r[5])
            assert got[d, r[1]] == k


def test_spatial_grid_changes_nothing(spark):
    n = boxes(spark, random_boxes(3))
    on = lambda a, b: (F.col("a_node_ix") != F.col("b_node_ix")) & (a.ioo(b) >= 0.5)
    key = lambda df: sorted((r.a_doc_id, r.a_node_ix, r.b_node_ix) for r in df.collect())
    assert key(joins.spatial_join(n, n, on)) == key(joins.spatial_join(n, n, on, cell=12.0, reach=10.0))


def test_fuzzy_join_is_exact(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randrange(0, 9)))
    qs, ws = {word() for _ in range(60)}, {word() for _ in range(60)}

    def ed(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    for k in (0, 1, 2):
        got = {(x.q, x.word, x.ed) for x in joins.fuzzy_within(spark.createDataFrame([(q,) for q in qs] + [(None,)], "q string"), spark.createDataFrame([(w,) for w in ws], "word string"), k).collect()}
        assert got == {(q, w, ed(q, w)) for q in qs for w in ws if ed(q, w) <= k}


def test_template_fields(spark):
    n = boxes(spark, [(1, 0, "No 12345", 0, 0, 50, 10), (1, 1, "total 9.50", 100, 100, 150, 110), (2, 0, "nothing", 0, 0, 50, 10)])
    conf = {"version": 2, "fg_items": [{"item_name": "no", "filter_areas": [{"area": [0, 0, 60, 20]}], "filter_regexs": [{"regex": "([0-9]{5})"}]},
                                       {"item_name": "sum", "filter_areas": [[0, 0, 500, 500]], "filter_regexs": ["([0-9]+[.][0-9]+)"], "item_post_func": "select_down"}, {"item_name": "hidden", "should_output": False}]}
    got = {(r.doc_id, r.item_name): r.content for r in template.run_template(n, conf).collect()}
    assert got == {(1, "no"): "12345", (1, "sum"): "9.50", (2, "no"): "", (2, "sum"): ""}
    with pytest.raises(template.ConfigError):
        template.bound({"item_name": "x", "item_post_func": "none_such"}, "post")


def test_key_value(spark):
    n = boxes(spark, [(1, 0, "money", 0, 0, 50, 10), (1, 1, "42", 60, 0, 80, 10), (2, 0, "other", 0, 0, 50, 10)])
    got = template.key_value(n, "money", lambda a: Box(a.right, a.top - 2, a.right + 100, a.bottom + 2), 1, "1").collect()
    assert {(r.doc_id, r.content) for r in got} == {(1, "42"), (2, "1")}


def test_counters(spark):
    rows = [("a", "1", "1", 0.9), ("a", "2", "3", 0.9), ("a", "x&1", "x&1", 0.9), ("a", "", "", 0.9), ("a", "1.0", "1", 0.1), ("b", "q", None, None)]
    df = spark.createDataFrame(rows, "item_name string, gt string, pred string, prob double")
    r = {x.item_name: x for x in evaluate.ratios(evaluate.counters(df, ["item_name"], total=True)).collect()}
    assert (r["a"].cnt_gt, r["a"].cnt_hit, r["a"].cnt_pass, r["a"].cnt_pass_hit, r["a"].cnt_invalid) == (5, 3, 4, 2, 1)
    assert (r["b"].cnt_pass, r["b"].cnt_err, r[None].cnt_gt) == (0, 1, 6)


def test_thresholds_equal_recounting(spark):
    r = random.Random(7)
    rows = [("i", "1", r.choice(["1", "0", None]), round(r.random(), 2)) for _ in range(300)]
    df = spark.createDataFrame(rows, "item_name string, gt string, pred string, prob double")
    for t in evaluate.thresholds(df, 0.5, 0.9, 0.05, ["item_name"]).collect():
        passed = [x for x in rows if x[2] is not None and round(x[3] - t.thresh, 9) >= 0]
        assert (t.cnt_gt, t.cnt_pass, t.cnt_pass_hit) == (300, len(passed), sum(x[2] == "1" for x in passed))


def test_registration():
    import numpy as np

    p = np.array([[0, 0], [100, 0], [100, 50], [0, 60], [30, 30]], float)
    h = np.array([[1.1, 0.1, 5], [-0.05, 0.9, 3], [0.0001, 0.0002, 1]])
    q = registration.project(h, p)
    assert np.allclose(registration.homography(p, q), h, atol=1e-6)
    s, a, _ = registration.scale_and_angle(p, p * 1.2, 0)
    assert abs(s - 1.2) < 0.05 and abs(a) < 0.5
    assert registration.polygon_ioo([[0, 0], [2, 0], [2, 2], [0, 2]], [[1, 1], [3, 1], [3, 3], [1, 3]]) == pytest.approx(0.25)


def test_registered_boxes(spark):
    n = boxes(spark, [(1, 0, "a", 0, 0, 10, 10)])
    pairs = spark.createDataFrame([(1, x, y, x + 5.0, y + 7.0) for x, y in ((0.0, 0.0), (100.0, 0.0), (100.0, 80.0), (0.0, 80.0))], "doc_id long, sx double, sy double, dx double, dy double")
    r = registration.registered(n, pairs).first()
    assert (round(r.left, 4), round(r.top, 4), round(r.right, 4), round(r.bottom, 4)) == (5, 7, 15, 17)


def test_offset_search(spark):
    n = boxes(spark, [(1, 0, "a", 10, 10, 20, 20), (1, 1, "b", 50, 50, 60, 60)])
    anchors = spark.createDataFrame([(0, "a", True, 13.0, 10.0, 23.0, 20.0), (1, "b", False, 53.0, 50.0, 63.0, 60.0)], "anchor int, text string, must boolean, left double, top double, right double, bottom double")
    r = reduce.offset_by_iou(n, anchors, 180, 100).first()
    assert abs(r.dx - 3) <= 1 and abs(r.dy) <= 1 and r.score > 1e4


def test_lattice(spark):
    pts = [(1, 0, 0.0, 0.0), (1, 1, 10.0, 0.0), (1, 2, 20.0, 0.0), (1, 6, 0.0, 10.0), (1, 7, 10.0, 10.0), (1, 8, 20.0, 10.0), (1, 8, 20.5, 10.2)]
    p = lattice.dedup_points(spark.createDataFrame(pts, "doc_id long, label int, x double, y double"), 1.0)
    assert p.count() == 6
    g = lattice.grid(lattice.cells(lattice.edges(p, 2.0)), 2.0)
    assert {(r.row, r.col) for r in g.collect()} == {(0, 0), (0, 1)}
    assert lattice.point_scores(p, p, 1.0).first().f1 == 1.0


def test_tables(spark):
    head = boxes(spark, [(1, 0, "name", 0, 0, 40, 10), (1, 1, "price", 100, 0, 140, 10)])
    body = boxes(spark, [(1, 2, "pen", 0, 20, 30, 30), (1, 3, "1.50", 100, 20, 130, 30), (1, 4, "ink", 0, 40, 30, 50)])
    cells = tables.align_rows(tables.columns_by_interval(tables.below_headers(body, head), head))
    assert {(r.node_ix, r.column, r.row) for r in cells.collect()} == {(2, 0, 0), (3, 1, 0), (4, 0, 1)}
    pairs = tables.one_to_one(body.filter("node_ix = 2"), body.filter("node_ix = 3"), 200.0).collect()
    assert [(r.key_ix, r.value_ix) for r in pairs] == [(2, 3)]
    rows = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 12.0, 22.0), (1, 2, 90.0, 100.0), (1, 3, 24.0, 34.0)], "doc_id long, row int, top double, bottom double")
    assert {r.row for r in tables.row_gaps(rows, 0.0, 1.0).collect()} == {0, 1, 3}
    c = tables.charges(spark.createDataFrame([(1, 0, ["西药费用", "12.50"]), (1, 1, ["检查费用", "3.00", "9.00"]), (1, 2, ["x"])], "doc_id long, line int, texts array<string>")).collect()
    assert {(r.name, r.kind, r.unit_price, r.total_price) for r in c} == {("西药费用", "summary", None, 12.5), ("检查费用", "detail", 3.0, 9.0)}


def test_matching(spark):
    n = boxes(spark, [(1, 0, "收款", 0, 0, 20, 10), (1, 1, "人", 22, 0, 32, 10), (1, 2, "收款人张三", 0, 50, 50, 60), (1, 3, "A", 0, 80, 10, 90), (1, 4, "B", 20, 80, 30, 90)])
    assert [r.text for r in matching.key_merged(n, "收款人").collect()] == ["收款人"]
    assert {(r.node_ix, r.rest) for r in matching.key_split(n, "收款人").collect()} == {(2, "张三")}
    assert {r.node_ix for r in matching.key_distance(n, "收款人", 1).collect()} == {0}
    assert [r.ix for r in matching.header_rows(n, [matching.exact("A"), matching.exact("B")]).collect()] == [[3, 4]]


def test_empty_inputs(spark):
    e = boxes(spark, [])
    for out in (cluster.row_lines(e), cluster.paragraphs(e), joins.overlapped(e), joins.nearest(e, e), cluster.anchored_rows(e)):
        assert out.count() == 0


def test_routes_and_addresses(spark):
    corpora = spark.createDataFrame([("x", "aaab"), ("y", "zzzy")], "class_name string, text string")
    assert [r.class_name for r in classify.route_tfidf(corpora, spark.createDataFrame([(1, "ab")], "id int, text string"), "id").collect()] == ["x"]
    gaz = spark.createDataFrame([("浙江省", "杭州市", "西湖区")], "province string, city string, county string")
    got = address.repaired(spark.createDataFrame([(1, "浙江省杭洲市西湖区文一路")], "id int, address string"), gaz).first()
    assert got.fixed == "浙江省杭州市西湖区文一路"


def test_files(spark, tmp_path):
    rec = tmp_path / "d7.json"
    rec.write_text('{"subjects": [{"recognition": {"texts": [{"points": [{"x":0,"y":0},{"x":10,"y":0},{"x":10,"y":5},{"x":0,"y":5}], "content": "hi", "probabilities": [0.5,0.7]}]}}]}')
    n = nodes.from_points(readers.subjects(spark, str(tmp_path))).collect()
    assert [(r.doc_id, r.text, r.right, r.scores) for r in n] == [("d7", "hi", 10.0, [0.5, 0.7])]
    items = spark.createDataFrame([("d7", "a", "A", "v", 0.5)], "doc_id string, item_name string, show_name string, content string, probability double")
    sinks.write_results(items, str(tmp_path / "out"))
    back = readers.predictions(spark.read.text(str(tmp_path / "out")).select(F.lit("d7").alias("fid"), "value")).first()
    assert (back.item_name, back.value, back.prob) == ("a", "v", 0.5)
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "d.txt").write_text("Ａb\n\n c \n")
    assert {r.word for r in readers.dictionary(spark, str(tmp_path / "w")).collect()} == {"Ab", "c"}
