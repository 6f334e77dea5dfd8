"""Scalar functions: literal cases and round trips."""

import datetime

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import dates, geometry, numbers, text
from scriptorium.functions.geometry import Box


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(("fn", "x", "want"), [
    (text.remove_last_dot, "1.2.", "1.2"), (text.remove_first_char, ".1", "1"), (text.remove_extra_dot, "1.2.3", "12.3"), (text.only_digits, "a1b2", "12"),
    (text.digits_or_rest, "a1b", "ab"), (text.digits_or_rest, "12a", "12"), (text.remove_space, "a b_c", "abc"), (text.clean_english, "a--b c!", "a_b_c"),
    (text.count_digits, "a1b22", 3), (text.longest_digit_run, "1a222b33", 3), (text.longest_digit_run, "abc", 0), (text.is_all_digits, "", True), (text.strip_space, "__ a_b _", "a_b"),
    (text.snake_to_camel, "ab_cd", "AbCd"), (text.camel_to_snake, "AbCdEf", "ab_cd_ef"), (lambda c: text.find_all(c, "ab"), "abxabab", [0, 3, 5]), (text.half_width, "Ａ１　", "A1 "),
    (text.nfkc, "ﬁ①", "fi1"), (text.only_cjk, "a发票b", "发票"), (text.has_cjk, "abc", False), (text.text_type, "12.5", "ALL_NUM"), (text.text_type, "12kg", "NUM2CHAR"), (text.text_type, "a1", "MIX"),
    (lambda c: text.remove_prefix(c, ["no[.:]"]), "xx no:12_", "12"), (lambda c: text.remove_suffix(c, ["kg"]), "12kg net", "12"), (text.drop_dimensions, "a 1*2*3 b", "a _ b"),
    (lambda c: text.lines_between(c, "^A", "^Z"), "x\nA\n1\n2\nZ\n3", ["1", "2"]), (lambda c: text.rtrim_units(c, "元."), "12元.", "12"),
    (lambda c: text.find_window(c, 2, lambda w: F.rlike(w, F.lit("^[0-9]+$")))["i"], "ab12c34", 2), (lambda c: text.lcs_length(c, F.lit("axbycz")), "abc", 3),
    (numbers.money_run, "a12.5b3", "12.5"), (lambda c: numbers.money_run(c, False), "a1b22.5", "22.5"), (numbers.clean_money, "000", "0.00"), (numbers.clean_money, "¥12.50", "12.50"),
    (numbers.redot, "1,234_56", "1234.56"), (numbers.financial_number, "-1,234.50", "-1234.50"), (numbers.repair_money, "I2.S0", "12.50"), (numbers.trim_leading_zeros, "007.5", "7.5"), (numbers.trim_leading_zeros, "0.5", "0.5"),
    (lambda c: numbers.add_dot(c, F.lit(10.0), F.lit(20.0)), "1234", "12.34"), (numbers.currency, "1234", "12.34"), (numbers.plate_number, "京A·I2O45", "京A12045"),
    (numbers.words_to_number, "壹仟贰佰叁拾肆圆伍角陆分", "1234.56"), (numbers.words_to_number, "拾万零伍圆整", "100005.00"), (numbers.words_to_number, "abc", None), (numbers.number_to_words, "1005.30", "壹仟零伍圆叁角整"),
    (dates.fixed_width, "20190230", None), (dates.fixed_width, "20190228", "2019-02-28"), (dates.from_digits, "2019 3 5", "2019-03-05"), (dates.from_seven, "2019105", "2019-01-05"),
    (dates.legal_triples, "no 2019 2 3 4", ["2019-02-03"]), (dates.from_chinese, "二〇一九年十二月三日", "2019-12-03"), (dates.standard, "2019年3月5日", "2019-03-05"), (dates.strip_time, "20190305112233", "20190305"),
    (dates.repaired, "2019-13-41", "2019-03-01"), (lambda c: dates.same_date(c, F.lit("2019-3-5")), "2019年03月05日", True),
])
def test_scalar(spark, fn, x, want):
    assert one(spark, x, fn) == want


def test_null_in_null_out(spark):
    for fn in (text.remove_extra_dot, text.camel_to_snake, numbers.to_money, numbers.financial_number, dates.fixed_width, dates.standard):
        assert one(spark, None, fn) is None


def test_id_checksum(spark):
    assert one(spark, "11010519491231002", lambda c: numbers.check_char(c)) == "X"
    assert one(spark, "11010519491231002X", numbers.is_valid_id) is True
    assert one(spark, "110105194912310021", numbers.is_valid_id) is False
    assert one(spark, "no 11010519491231002X", numbers.extract_id) == "11010519491231002X"


def test_amounts_round_trip(spark):
    values = [f"{n / 100:.2f}" for n in (1, 10, 99, 100, 101, 1005, 10010, 123456, 10000000, 1000000050, 10203040506, 120034005670, 99999999999999)]
    df = spark.createDataFrame([(v,) for v in values], "x string").select("x", numbers.words_to_number(numbers.number_to_words("x")).alias("y"))
    assert [(r.x, r.y) for r in df.collect() if r.x != r.y] == []


def test_dates_enumerate(spark):
    got = one(spark, "2019112", lambda c: dates.parse_dates(c, 2010, 2025))
    assert {(g.year, g.month, g.day) for g in got} >= {(2019, 1, 12), (2019, 11, 2)}
    days = [(y, m, d) for y in (1900, 2000, 2019, 2020) for m in range(1, 13) for d in range(28, 32)]
    df = spark.createDataFrame(days, "y int, m int, d int").select("y", "m", "d", dates.is_legal(F.col("y"), F.col("m"), F.col("d"), 1800, 2100).alias("ok"))
    for r in df.collect():
        try:
            datetime.date(r.y, r.m, r.d)
            assert r.ok
        except ValueError:
            assert not r.ok


def test_boxes(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 5.0, 5.0, 15.0, 15.0)], "a_left double, a_top double, a_right double, a_bottom double, b_left double, b_top double, b_right double, b_bottom double")
    a, b = Box.of("a_"), Box.of("b_")
    r = df.select(a.iou(b).alias("iou"), a.ioo(b).alias("ioo"), a.contains_center(b).alias("cc"), a.x_overlaps(b).alias("x"), a.y_overlaps(b, compat=True).alias("yc"), a.merge(b).struct().alias("m"), a.intersection(b).alias("i"),
                  a.transform((1, 1), 2, 0, (5, 5)).struct().alias("t"), a.window(1, 0).struct().alias("w"), a.center_distance(b).alias("d")).first()
    assert r.iou == pytest.approx(25 / 175) and r.ioo == pytest.approx(0.25) and not r.cc and r.x and not r.yc
    assert tuple(r.m) == (0, 0, 15, 15) and tuple(r.i) == (5, 5, 10, 10) and tuple(r.t) == (2, 2, 22, 22) and tuple(r.w) == (10, 0, 20, 10) and r.d == pytest.approx(50**0.5)


def test_quads_and_lines(spark):
    df = spark.createDataFrame([([10, 10, 0, 0, 10, 0, 0, 10],)], "q array<int>")
    r = df.select(geometry.quad_angle(F.col("q")).alias("a"), geometry.quad_width(F.col("q")).alias("w"), geometry.split_box(F.lit("abcd"), Box(*map(F.lit, (0, 0, 40, 10))), F.lit(1), F.lit(3)).alias("s"),
                  geometry.line_cross((F.lit(0), F.lit(0)), (F.lit(10), F.lit(10)), (F.lit(0), F.lit(10)), (F.lit(10), F.lit(0))).alias("c")).first()
    assert r.a == 0 and r.w == 10 and (r.s.text, r.s.left, r.s.right) == ("bc", 10, 30) and (r.c.x, r.c.y) == (5, 5)


def test_scored(spark):
    df = spark.createDataFrame([("a1b2", [0.5, 0.7])], "t string, s array<double>").select(text.scored(F.col("t"), F.col("s")).alias("x"))
    r = df.select("x", text.scored_keep(F.col("x"), "[0-9]").alias("k"), text.scored_slice(F.col("x"), F.lit(1), F.lit(3)).alias("p"), text.scored_replace("b", "zz", thresh=0.9)(F.col("x")).alias("r")).first()
    assert r.x.scores == pytest.approx([0.5, 0.7, 0.6, 0.6]) and r.k.text == "12" and r.p.text == "1b" and r.r.text == "a1zz2" and len(r.r.scores) == 5


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(k, *(v if isinstance(v, tuple) else (v,))) for k, v in enumerate(values)], f"k int, {kind if ' ' in kind else 'x ' + kind}")
    return [r.y for r in df.select("k", fn.alias("y")).orderBy("k").collect()]


# cases as published with their answers
def test_date_fields_as_published(spark):
    got = column(spark, [("18", "2", "11"), ("018", "2", "11"), ("2018", "2", "11"), ("98", "2", "11"), ("998", "2", "11"), ("1998", "2", "11")], dates.normal_fields(F.col("y0"), F.col("m"), F.col("d"), 1949), "y0 string, m string, d string")
    assert [tuple(g) for g in got] == [(y, "02", "11") for y in ("2018",) * 3 + ("1998",) * 3]


def test_dates_as_published(spark):
    cases = {
        "2019-11-23": "2019-11-23", "2019ab11cd23": "2019-11-23", "2019年1月3日": "2019-01-03", "2019年1月03日": "2019-01-03", "2019年01月3日": "2019-01-03", "2019年01月03日": "2019-01-03",
        "20191123": "2019-11-23", "2019-1123": "2019-11-23", "2019-112": "2019-11-02", "2019-1-2": "2019-01-02", "0190123": "2019-01-23", "19abc0123": "2019-01-23",
        "2022. 0118": "2022-01-18", "2025-_10-08": "2025-10-08", "2025-01-20-长期": "2025-01-20",
    }
    got = column(spark, list(cases), dates.parse_dates(F.col("x"), 1900, 2099))
    assert {k: f"{g[0].year}-{g[0].month:02d}-{g[0].day:02d}" for k, g in zip(cases, got, strict=True)} == cases


def test_amounts_in_words_as_published(spark):
    cases = {
        "万贰拾肆元陆角柒分": 24.67, "捌佰玖拾元零零角壹分": 890.01, "贰佰柒拾固叁角陆分整": 270.36, "肆捡圆整(40.00)___7": 40, "壹拾捌回整": 18, "贰拾伍捌整": 25,
        "合计大零贰佰肆拾捌元陆角捌分": 248.68, "叁佰固整": 300, "叁佰零壹园陆角(301.60)": 301.6, "贰万陆仟零叁拾零圆伍角肆分": 26030.54, "零万贰万零陆佰伍拾伍元伍角叁分": 20655.53,
    }
    got = column(spark, list(cases), numbers.words_to_number(F.col("x")))
    assert {k: g and float(g) for k, g in zip(cases, got, strict=True)} == cases


def test_plates_as_published(spark):
    cases = {"浙E0AZ19": "浙E0AZ19", "北E123A34": "", "豫AI2Z7G": "豫A12Z7G", "吉AX123456": "吉AX12345", "浙E0AZI9": "浙E0AZ19", "川A123AB": "川A123AB", "川A123AB123": "川A123AB1", "浙10AZI9": "浙I0AZ19", "川0123AB": "川O123AB", "京A23456": "京A23456"}
    assert dict(zip(cases, column(spark, list(cases), F.coalesce(numbers.plate_number(F.col("x")), F.lit(""))), strict=True)) == cases


def test_strings_as_published(spark):
    assert one(spark, "2015-0223", lambda c: text.find_window(c, 2, lambda w: w.try_cast("int").between(1, 12) & F.rlike(w, F.lit("^[0-9]+$")), start=4)) == (5, 7)
    assert one(spark, "2015-0223", lambda c: text.find_window(c, 2, lambda w: w.try_cast("int").between(1, 12) & F.rlike(w, F.lit("^[0-9]+$")), last=True, start=4)) == (5, 7)
    assert one(spark, "ab.753000", lambda c: text.digitalize(c, lambda x, i: F.when(x == ".", x).otherwise("0"))) == "00.753000"
    assert one(spark, "1230000", lambda c: numbers.add_dot(c, F.lit(123), F.lit(999))) == "123.0000" and one(spark, "990000", lambda c: numbers.add_dot(c, F.lit(123), F.lit(199))) is None
    for x, n, want in (("", 0, True), ("1123", 4, True), ("1.123", 3, True), ("1123", 5, False), ("陆百元", 1, False), ("陆百元", 0, True)):
        assert one(spark, x, lambda c, n=n: text.has_digit_run(c, n)) is want


def test_scored_as_published(spark):
    make = lambda t, s: text.scored(F.lit(t), F.lit(s).cast("array<double>") if s else F.expr("cast(array() as array<double>)"))
    df = spark.range(1)
    r = df.select(make("2019-3-1.1", []).alias("a"), make("2019", [0.9, 0.8]).alias("b"), make("2", [0.9, 0.8]).alias("c"), make("", [0.9, 0.8]).alias("d"), make("", []).alias("e")).first()
    assert r.a.scores == [1.0] * 10 and r.b.scores == pytest.approx([0.9, 0.8, 0.85, 0.85]) and r.c.scores == [0.9] and r.d.scores == [] and r.e.scores == []
    assert df.select(text.scored_concat(make("11", [0.9, 0.8]), make("22", [0.7, 0.6])).alias("x")).first().x == ("1122", [0.9, 0.8, 0.7, 0.6])
    six = [0.9, 0.8, 0.7, 0.6, 0.5, 0.4]
    cases = [
        ("1.121", six[:5], ".", "", {}, "1121", [0.9, 0.7, 0.6, 0.5]), ("1.12.1", [0.9, 0.8, 0.7, 0.6, 0.4, 0.5], ".", "", {}, "1121", [0.9, 0.7, 0.6, 0.5]), ("1.12.1", six, ".", "a", {}, "1a12a1", six),
        ("1.12.1", six, ".", "aa", {"count": 2}, "1aa12aa1", [0.9, 0.8, 0.8, 0.7, 0.6, 0.5, 0.5, 0.4]), ("1.12.1", six, ".", "aa", {"count": 1}, "1aa12.1", [0.9, 0.8, 0.8, 0.7, 0.6, 0.5, 0.4]),
        ("1.12..1", [*six, 0.3], "..", "a", {}, "1.12a1", [0.9, 0.8, 0.7, 0.6, 0.5, 0.3]), ("1.12..1", [*six, 0.3], "..", "aaa", {}, "1.12aaa1", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.45, 0.3]),
        ("1.12.1", six, ".", "a", {"thresh": 0.6}, "1.12a1", six), ("1.12.1", six, ".", "a", {"thresh": 0.9}, "1a12a1", six), ("1.12..1", [0.9, 0.8, 0.7, 0.6, 0.5, 0.1, 0.4], "..", "aaa", {"thresh": 0.6}, "1.12aaa1", [0.9, 0.8, 0.7, 0.6, 0.5, 0.1, 0.3, 0.4]),
    ]
    for t, s, old, new, how, want, scores in cases:
        x = df.select(text.scored_replace(old, new, **how)(make(t, s)).alias("x")).first().x
        assert x.text == want and x.scores == pytest.approx(scores), (t, how)



def test_missing_model_is_an_error(spark):
    from scriptorium.operators import template

    with pytest.raises(template.ConfigError):
        template.with_model(spark.range(1), "none of this name")
    template.MODELS["twice"] = lambda df: df.union(df)
    assert template.with_model(spark.range(1), "twice").count() == 2
    del template.MODELS["twice"]
