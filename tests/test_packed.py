"""Results of whole documents in Arrow functions are those of the operators on box tables."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import cluster, nodes, packed


def by_rows(name, documents):
    n = nodes.numbered(nodes.layout(documents))
    if name == "col_lines":
        return cluster.col_lines(n).groupBy("doc_id", "column").agg(F.count("*"), F.min("left"), F.max("right"))
    if name == "paragraphs":
        return cluster.paragraphs(n).groupBy("doc_id", "paragraph").agg(F.count("*"))
    n = cluster.row_lines(n)
    if name == "x_segments":
        return cluster.joined(cluster.x_segments(n), ["doc_id", "line", "segment"], ["left", "node_ix"]).select("doc_id", "line", "segment", "text", "n")
    if name == "asof_key_rows":
        x = n.groupBy("doc_id", "line").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.bool_or(F.rlike("text", F.lit("[0-9]"))).alias("is_key"))
        return cluster.assign_key_rows(x).select("doc_id", "line", "key_line")
    lines = cluster.joined(n, ["doc_id", "line"], ["left", "node_ix"], " ").select("doc_id", "line", "text")
    if name == "stop_line_cut":
        return cluster.cut_at_stop(lines, F.rlike("text", F.lit("[#$%&*]")))
    a, b = F.rlike("text", F.lit("[0-9]")), F.rlike("text", F.lit("[A-Z]{2}"))
    return lines.select("doc_id", "line", F.explode(F.array_compact(F.array(F.when(a & b, "both"), F.when(a | b, "either")))))


NAMES = ["col_lines", "asof_key_rows", "key_row_sets", "stop_line_cut", "x_segments", "paragraphs"]


@pytest.mark.parametrize("name", NAMES)
def test_packed_is_as_by_rows(spark, name, monkeypatch):
    monkeypatch.setattr(packed, "CHUNK", 700)
    r = random.Random(1)
    words = ["a", "bb", "ccc", "d1", "E", "EF", "#", "é𝄞", "", "x" * 9, "word", "12", "1.5", "A"]
    text = lambda: "\n".join(" ".join(r.choice(words) for _ in range(r.randrange(0, 12))) for _ in range(r.randrange(0, 9)))
    rows = [(i - 20, text()) for i in range(120)] + [(None, text()), (900, None), (901, ""), (902, " \n "), (903, "\n\n a"), (904, "one"), (905, "w " * 3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = getattr(packed, name)(d)
    assert "Window" not in got._jdf.queryExecution().toString()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, by_rows(name, d).collect())))


@pytest.mark.parametrize("name", NAMES)
def test_queries_keep_documents_in_a_row(spark, name):
    """No row for each box: nothing is exploded, and no window sorts boxes."""
    from scriptorium.plans import catalogue

    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Window" not in plan


def test_rows_of_one_id_are_one_document(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "c"), (1, "d")], "doc_id long, text string")
    assert {x.doc_id: x.n for x in packed.col_lines(d).groupBy("doc_id").agg(F.sum("n").alias("n")).collect()} == {1: 3, 2: 1}


def test_paragraphs_query_has_every_box(spark):
    """The query gives the paragraphs' boxes, not their numbers alone: each membership of the operator's bridge."""
    from scriptorium.plans import catalogue

    d = "/root/testdata/sf0.001"
    got = catalogue.QUERIES["paragraphs"](spark, d)
    assert got.filter("n <> size(nodes)").count() == 0
    bridge = cluster.paragraphs(catalogue.boxes(spark, d))
    want = sorted(map(tuple, bridge.select("doc_id", "paragraph", "node_ix").collect()))
    assert sorted(map(tuple, got.select("doc_id", "paragraph", F.explode("nodes")).collect())) == want


def test_paragraph_boxes_on_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(packed, "CHUNK", 900)
    r = random.Random(7)
    words = ["a", "bb", "ccc", "é𝄞", "", "x" * 30, "word", "12"]
    text = lambda n, m: "\n".join(" ".join(r.choice(words) for _ in range(r.randrange(0, n))) for _ in range(r.randrange(0, m)))
    rows = [(i - 30, text(12, 30)) for i in range(60)] + [(i, text(60, 5)) for i in range(100, 120)] + [(None, text(9, 9)), (None, "a b\na"), (900, None), (901, ""), (902, " \n "), (903, "\n\n a"), (904, "one"), (905, "w " * 3000), (906, "w\n" * 3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = packed.paragraph_boxes(d).select("doc_id", "paragraph", F.posexplode("nodes")).select("doc_id", "paragraph", "col", "pos").collect()
    want = cluster.paragraphs(nodes.numbered(nodes.layout(d))).collect()
    assert sorted(repr(tuple(x)[:3]) for x in got) == sorted(map(repr, map(tuple, want)))


@pytest.mark.parametrize("turn, few", [(0, 0), (0, 4), (0, 10**6), (30, 16), (10**9, 16)])
def test_paragraphs_row_by_row_are_those_of_the_fold(monkeypatch, turn, few):
    """All documents' rows at once, or each document alone: the same boxes in the same order."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(packed, "TURN", turn)
    monkeypatch.setattr(packed, "FEW", few)
    r = random.Random(turn + few)
    words = ["a", "bb", "ccc", "dddd", "", "x" * 45]
    for _ in range(12):
        texts = ["\n".join(" ".join(r.choice(words) for _ in range(r.randrange(0, 40))) for _ in range(r.choice([1, 3, 30]))) for _ in range(9)] + ["a b\nc dd", "x " * 300]
        ids = [r.choice([None, 5, 5, 10**12, *range(-9, 40)]) if r.random() < 0.3 else 100 + i for i in range(len(texts))]
        at = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0))
        b = packed.Boxes(pa.array([ids[i] for i in at], pa.int64()), pa.array([texts[i] for i in at], pa.string()))
        docs, groups, sizes, lists = (x.to_pylist() if isinstance(x, pa.Array) else x.tolist() for x in packed._paragraph_boxes(b))
        want = []
        for k in sorted(set(b.doc.tolist())):
            own = np.flatnonzero(b.doc == k)
            order = own[np.lexsort((b.left[own], b.top[own]))]
            made = {}
            for i, g in plain_fold(list(zip(*(x[order].tolist() for x in (b.left, b.top, b.right, b.bottom)), strict=True))):
                made.setdefault(g, []).append(int(order[i] - own[0]))
            want += [(b.ids[k].as_py(), g, len(made[g]), made[g]) for g in sorted(made)]
        assert list(zip(docs, groups, sizes, lists, strict=True)) == want


def plain_fold(rows):
    """Every open paragraph is asked for every box."""
    groups, out, made = [], [], 0
    for i, (left, top, right, bottom) in enumerate(rows):
        h, hit = bottom - top, False
        groups = [g for g in groups if top - g["bottom"] < g["h"] / g["n"]]
        for g in groups:
            wide = min(right, g["right"]) - max(left, g["left"])
            if abs(left - g["left"]) < g["h"] / g["n"] or wide > 0.1 * min(right - left, g["right"] - g["left"]):
                hit = True
                out.append((i, g["k"]))
                g.update(bottom=max(g["bottom"], bottom), left=min(g["left"], left), right=max(g["right"], right), h=g["h"] + h, n=g["n"] + 1)
        if not hit:
            groups.append({"k": made, "left": left, "right": right, "bottom": bottom, "h": h, "n": 1})
            out.append((i, made))
            made += 1
    return out


def test_paragraph_fold():
    r = random.Random(5)
    for turn in range(400):
        whole = turn % 2
        num = (lambda a, b: r.randrange(a, b)) if whole else (lambda a, b: r.uniform(a, b))
        rows = []
        for _ in range(r.randrange(0, 60)):
            x, y = num(-50, 300), num(0, 120)
            rows.append((x, y, x + num(-10 if turn % 7 == 0 else 0, 200 if turn % 5 == 0 else 40), y + num(-3 if turn % 11 == 0 else 1, 20)))
        rows.sort(key=lambda x: (x[1], x[0]))
        boxes, groups = [], []
        sizes = packed.memberships(*(list(c) for c in (zip(*rows, strict=True) if rows else [()] * 4)), boxes, groups)
        want = plain_fold(rows)
        assert sorted(zip(boxes, groups, strict=True)) == sorted(want)
        assert sizes == [sum(k == g for _, g in want) for k in range(len(sizes))]


def test_paragraphs_of_a_long_line_take_no_pairs():
    import time

    n = 30000
    began = time.process_time()
    assert packed.memberships([60 * k for k in range(n)], [0] * n, [60 * k + 50 for k in range(n)], [12] * n) == [1] * n
    assert time.process_time() - began < 5
