"""String functions for recognised text, as Column expressions.

``_`` is the recogniser's blank. Patterns say ``[0-9]`` or ``\\p{Nd}``: the meaning
of ``\\d`` differs between engines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CJK = "\\x{4E00}-\\x{9FA5}"
#: Characters that count as symbols when texts are compared.
SYMBOLS = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~，。、；：？！“”‘’（）《》【】…—·￥"
#: Chinese numerals of amounts in words.
AMOUNT_CHARS = "零壹贰叁肆伍陆柒捌玖拾佰仟万亿元圆角分整正"
CHINESE_DIGITS = "〇零一二三四五六七八九十"
# Letters and the digits they are read as, in amounts and numbers.
LOOKALIKES = {
    "A": "4", "a": "0",
    "B": "8", "b": "6",
    "C": "0", "c": "0",
    "D": "0", "d": "5",
    "E": "3", "e": "0",
    "F": "9", "f": "1",
    "G": "6", "g": "9",
    "Y": "7", "y": "7",
    "O": "0", "o": "0",
    "S": "5", "s": "5",
    "T": "7", "t": "4",
    "Z": "2", "z": "2",
}
# Letters and what stands for them in identifiers of institutions.
CONFUSIONS = {"B": "8", "O": "0", "o": "0", "K": "X", "I": "1", "D": "0", "G": "6", "Y": "7", "U": "0"}

# types, not DDL strings: workers import this module without a session
SCORED = T.StructType([T.StructField("text", T.StringType()), T.StructField("scores", T.ArrayType(T.DoubleType()))])
INDEXED = T.StructType([T.StructField("text", T.StringType()), T.StructField("index", T.ArrayType(T.IntegerType()))])

drop = lambda c, chars: F.translate(c, chars, "")
sub = F.regexp_replace


def remove_last_dot(c: Column) -> Column:
    return sub(c, "\\.$", "")


def remove_first_char(c: Column, char: str = ".") -> Column:
    return F.when(F.startswith(c, F.lit(char)), F.substr(c, F.lit(2))).otherwise(c)


def remove_extra_dot(c: Column) -> Column:
    """Only the last of several dots stays."""
    p = F.split(c, "\\.")
    return F.when(F.size(p) > 2, F.concat(F.array_join(F.slice(p, F.lit(1), F.size(p) - 1), ""), F.lit("."), F.element_at(p, -1))).otherwise(c)


def only_digits(c: Column) -> Column:
    return sub(c, "[^0-9]", "")


def without_digits(c: Column) -> Column:
    return sub(c, "[0-9]", "")


def digits_or_rest(c: Column) -> Column:
    """Digits if they are half the text or more, else all but digits."""
    return F.when(F.length(only_digits(c)) < F.length(c) * 0.5, without_digits(c)).otherwise(only_digits(c))


def only_alnum(c: Column) -> Column:
    return sub(c, "[^0-9A-Za-z]", "")


def remove_space(c: Column) -> Column:
    return drop(c, " _")


def remove_chars(c: Column, chars: str) -> Column:
    return drop(c, chars)


def replace_space(c: Column, char: str) -> Column:
    return F.translate(c, " _", char * 2)


def title_marks_to_parentheses(c: Column) -> Column:
    return F.translate(c, "《》〈〉", "()()")


def ascii_parentheses(c: Column) -> Column:
    return F.translate(c, "（）", "()")


def remove_symbols(c: Column, keep: str = "") -> Column:
    return drop(c, "".join(x for x in SYMBOLS if x not in keep))


def remove_symbols_and_space(c: Column) -> Column:
    return drop(c, SYMBOLS + " _")


def remove_symbols_except_parentheses(c: Column) -> Column:
    return remove_symbols(c, "()（）")


def replace_pairs(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements in order."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def replace_when(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Whole values replaced, in order."""
    return reduce(lambda x, p: F.when(x == p[0], F.lit(p[1])).otherwise(x), pairs, c)


def remove_patterns(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda x, p: sub(x, p, ""), patterns, c)


def confusions_to_digits(c: Column) -> Column:
    return F.translate(c, "".join(CONFUSIONS), "".join(CONFUSIONS.values()))


def lookalikes_to_digits(c: Column, table: dict[str, str] | None = None) -> Column:
    t = table or LOOKALIKES
    return F.translate(c, "".join(t), "".join(t.values()))


def only_amount_words(c: Column) -> Column:
    return sub(c, f"[^{AMOUNT_CHARS}]", "")


def has_chinese_digit(c: Column) -> Column:
    return F.rlike(c, F.lit(f"[{CHINESE_DIGITS}]"))


def only_cjk(c: Column, also: str = "") -> Column:
    return sub(c, f"[^{CJK}{also}]", "")


def without_cjk(c: Column) -> Column:
    return sub(c, f"[{CJK}]", "")


def has_cjk(c: Column) -> Column:
    return F.rlike(c, F.lit(f"[{CJK}]"))


def is_cjk(c: Column, compat: bool = False) -> Column:
    """Whether there is CJK; ``compat`` answers the opposite, as older pipelines did."""
    return ~has_cjk(c) if compat else has_cjk(c)


def clean_english(c: Column, lower: bool = False, replace_blank: bool = True) -> Column:
    """Runs of all but letters and digits become one ``_`` (or blank), trimmed."""
    mark = "_" if replace_blank else " "
    out = F.btrim(sub(c, "[^0-9A-Za-z]+", mark), F.lit(mark))
    return F.lower(out) if lower else out


def count_matching(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def count_digits(c: Column, unicode: bool = False) -> Column:
    return count_matching(c, "\\p{Nd}" if unicode else "[0-9]")


def count_alnum(c: Column) -> Column:
    return count_matching(c, "[0-9A-Za-z]")


def count_letters(c: Column) -> Column:
    return count_matching(c, "\\p{L}")


def count_upper(c: Column) -> Column:
    return count_matching(c, "[A-Z]")


def count_char(c: Column, char: str) -> Column:
    return F.length(c) - F.length(drop(c, char))


def longest_digit_run(c: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)), F.length)), F.lit(0))


def has_digit_run(c: Column, n: int = 10) -> Column:
    return longest_digit_run(c) >= n


def is_all_digits(c: Column) -> Column:
    """Also true of the empty text."""
    return F.rlike(c, F.lit("^[0-9]*$"))


def is_all_alnum(c: Column) -> Column:
    return F.rlike(c, F.lit("^[0-9A-Za-z]*$"))


def strip_space(c: Column) -> Column:
    return F.btrim(F.btrim(c, F.lit("_")), F.lit(" "))


def snake_to_camel(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, "_"), lambda x: F.concat(F.upper(F.substr(x, F.lit(1), F.lit(1))), F.substr(x, F.lit(2)))), "")


def camel_to_snake(c: Column) -> Column:
    return F.lower(sub(sub(c, "([^_])([A-Z][a-z]+)", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))


def find_all(c: Column, needle: str) -> Column:
    """Starts of all occurrences that do not overlap, from zero."""
    p = F.split(c, "\\Q" + needle + "\\E", -1)
    sizes = F.transform(F.slice(p, F.lit(1), F.size(p) - 1), F.length)
    grow = F.aggregate(sizes, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")),
                       lambda s, n: F.struct((s["at"] + n + len(needle)).cast("int").alias("at"), F.concat(s["out"], F.array((s["at"] + n).cast("int"))).alias("out")))
    return grow["out"]


def only_char(c: Column, char: str) -> Column:
    return (c != "") & (drop(c, char) == "")


def half_width(c: Column) -> Column:
    """Full-width forms and the ideographic blank to ASCII."""
    full = "".join(chr(k) for k in range(0xFF01, 0xFF5F)) + "　"
    return F.translate(c, full, "".join(chr(k - 0xFEE0) for k in range(0xFF01, 0xFF5F)) + " ")


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC, which Spark has no expression for."""
    return s.str.normalize("NFKC")


def is_none_or_empty(c: Column) -> Column:
    return c.isNull() | (c == "")


def is_none_or_blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def find_window(c: Column, size: int, test: Callable[[Column], Column], last: bool = False, start: int = 0) -> Column:
    """Struct i, j of the first (or last) window of ``size`` characters that passes ``test``."""
    chars = F.split(c, "")
    w = chars
    for k in range(1, size):  # windows as neighbours joined, which is linear in the text; those that leave it are null
        w = F.zip_with(w, F.slice(chars, F.lit(k + 1), F.size(chars)), lambda a, b: F.concat(a, b))
    at = F.filter(F.transform(w, lambda x, i: F.when((i >= start) & test(x), i)), lambda i: i.isNotNull())
    i = F.try_element_at(at, F.lit(-1 if last else 1))
    return F.when(i.isNotNull(), F.struct(i.alias("i"), (i + size).alias("j")))


def digitalize(c: Column, mapper: Callable[[Column, Column], Column]) -> Column:
    """Every character that is no digit goes through ``mapper(char, index)``."""
    return F.array_join(F.transform(F.split(c, ""), lambda x, i: F.when(F.rlike(x, F.lit("[0-9]")), x).otherwise(mapper(x, i))), "")


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def compose(*handlers: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda c: reduce(lambda x, h: h(x), handlers, c)


def rtrim_units(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, "[" + "".join("\\" + x if x in "\\]^-" else x for x in chars) + "]+$", "")


def remove_stop_chars(c: Column) -> Column:
    return drop(c, "0123456789,.:;()[]-*/\\'\"")


def dot_before_last_three(c: Column) -> Column:
    return F.concat(F.substr(c, F.lit(1), F.greatest(F.length(c) - 3, F.lit(0))), F.lit("."), F.right(c, F.lit(3)))


def remove_comma(c: Column) -> Column:
    return drop(c, ",")


def double_blank_a(c: Column) -> Column:
    return sub(c, "__A", "EA")


def remove_prefix(c: Column, rules: list[str]) -> Column:
    """All up to the end of the first rule that matches, then ``_`` trimmed."""
    return F.btrim(_first_rule(c, rules, lambda r: sub(c, f"^.*?(?:{r})", "")), F.lit("_"))


def remove_suffix(c: Column, rules: list[str]) -> Column:
    return _first_rule(c, rules, lambda r: sub(c, f"(?:{r}).*$", ""))


def _first_rule(c: Column, rules: list[str], then: Callable[[str], Column]) -> Column:
    out = None
    for r in rules:
        hit = F.rlike(c, F.lit(r))
        out = F.when(hit, then(r)) if out is None else out.when(hit, then(r))
    return c if out is None else out.otherwise(c)


def replace_in_lines(c: Column, rules: list[tuple[str, str]]) -> Column:
    one = lambda x: reduce(lambda y, r: sub(y, r[0], r[1]), rules, x)
    return F.array_join(F.transform(F.split(c, "\n"), one), "\n")


def first_format(c: Column, pattern: str) -> Column:
    return sub(first_match(c, pattern), "_+", "_")


def drop_dimensions(c: Column) -> Column:
    """Triples such as 10*20*30 become ``_``."""
    return sub(c, "[0-9.]+ *[xX*] *[0-9.]+ *[xX*] *[0-9.]+", "_")


def lines_between(c: Column, start: str | None = None, end: str | None = None, skip: str | None = None, keep: str | None = None) -> Column:
    """Lines after the first that matches ``start`` and before the next that matches ``end``, without
    those that match ``skip``, only those that match ``keep``."""
    lines = F.split(c, "\n")
    first = lambda arr, p: F.coalesce(F.try_element_at(F.filter(F.transform(arr, lambda x, i: F.when(F.rlike(x, F.lit(p)), i)), lambda i: i.isNotNull()), F.lit(1)), F.lit(-1))
    if start is not None:
        at = first(lines, start)
        lines = F.when(at >= 0, F.filter(lines, lambda x, i: i > at)).otherwise(F.slice(lines, F.lit(1), F.lit(0)))
    if end is not None:
        stop, before = first(lines, end), lines
        lines = F.when(stop >= 0, F.filter(before, lambda x, i: i < stop)).otherwise(before)
    if skip is not None:
        lines = F.filter(lines, lambda x: ~F.rlike(x, F.lit(skip)))
    return F.filter(lines, lambda x: F.rlike(x, F.lit(keep))) if keep is not None else lines


def text_type(c: Column) -> Column:
    """Class of a text: ALL_NUM, ALL_CHAR, ALL_SPEC, NUM2CHAR or MIX."""
    bare = remove_space(c)
    return (
        F.when(F.rlike(bare, F.lit("^[0-9.,]+$")), "ALL_NUM").when(F.rlike(bare, F.lit("^[A-Za-z]+$")), "ALL_CHAR")
        .when(F.rlike(bare, F.lit("^[^0-9A-Za-z]+$")), "ALL_SPEC").when(F.rlike(bare, F.lit("^[0-9.,]+[A-Za-z]+$")), "NUM2CHAR").otherwise("MIX")
    )


def charge_type(c: Column) -> Column:
    """NAME (three CJK or more), AMOUNT (one decimal), QUANTITY (one whole number below 100,000) or null."""
    dec, whole = F.regexp_count(c, F.lit("[0-9]+\\.[0-9]+")), F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0))
    one = F.try_element_at(whole, F.lit(1)).try_cast("long")
    return F.when(count_matching(c, f"[{CJK}]") >= 3, "NAME").when(dec == 1, "AMOUNT").when((dec == 0) & (F.size(whole) == 1) & (one < 100000) & (count_digits(c) * 2 >= F.length(c)), "QUANTITY")


def split_scored(c: Column, scores: Column, char: str) -> Column:
    """Parts of a text at ``char`` with their slices of the scores: array of struct text, at, scores."""
    p = F.split(c, "\\Q" + char + "\\E", -1)
    acc = F.aggregate(p, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<text:string,at:int,scores:array<double>>>)").alias("out")),
                      lambda s, x: F.struct((s["at"] + F.length(x) + len(char)).cast("int").alias("at"), F.concat(s["out"], F.array(F.struct(x.alias("text"), s["at"].alias("at"), F.slice(scores, s["at"] + 1, F.length(x)).alias("scores")))).alias("out")))
    return F.filter(acc["out"], lambda x: x["text"] != "")


# texts with a score for each character
def scored(text: Column, scores: Column) -> Column:
    """Struct text, scores; scores are padded with their mean (1 if there are none), or cut, to the text's length."""
    n, m = F.length(text), F.size(scores)
    mean = F.when(m > 0, F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / m).otherwise(1.0)
    return F.struct(text.alias("text"), F.when(m >= n, F.slice(scores, F.lit(1), n)).otherwise(F.concat(scores, F.array_repeat(mean, n - m))).alias("scores"))


def scored_keep(s: Column, pattern: str) -> Column:
    """Characters that match, with their scores."""
    z = F.filter(F.zip_with(F.split(s["text"], ""), s["scores"], lambda a, b: F.struct(a.alias("c"), b.alias("s"))), lambda p: F.rlike(p["c"], F.lit(pattern)))
    return F.struct(F.array_join(F.transform(z, lambda p: p["c"]), "").alias("text"), F.transform(z, lambda p: p["s"]).alias("scores"))


def scored_slice(s: Column, start: Column, end: Column) -> Column:
    return F.struct(F.substr(s["text"], start + 1, end - start).alias("text"), F.slice(s["scores"], start + 1, end - start).alias("scores"))


def scored_concat(a: Column, b: Column) -> Column:
    return F.struct(F.concat(a["text"], b["text"]).alias("text"), F.concat(a["scores"], b["scores"]).alias("scores"))


def scored_replace(old: str, new: str, count: int | None = None, thresh: float | None = None):
    """Column function: replaces ``old`` where the mean score is below ``thresh`` (always if None), at
    most ``count`` times; new characters take the scores of those they replace, further ones their mean."""

    @F.pandas_udf(SCORED)
    def run(text: pd.Series, scores: pd.Series) -> pd.DataFrame:
        out = []
        for t, s in zip(text, scores, strict=True):
            done, i, rt, rs, s = 0, 0, [], [], list(s)
            while old and i < len(t):
                part = s[i : i + len(old)]
                if t.startswith(old, i) and (count is None or done < count) and (thresh is None or sum(part) / len(part) < thresh):
                    rt.append(new)
                    rs += [*part[: len(new)], *[sum(part) / len(part)] * (len(new) - len(part))]
                    done, i = done + 1, i + len(old)
                else:
                    rt.append(t[i])
                    rs.append(s[i])
                    i += 1
            out.append(("".join(rt), rs) if old else (t, s))
        return pd.DataFrame(out, columns=["text", "scores"])

    return lambda s: run(s["text"], s["scores"])


def mean_score(scores: Column) -> Column:
    return F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / F.size(scores)).otherwise(0.0)


# longest common subsequences and matching blocks have no expression; both run on Arrow batches
def _lcs(a: str, b: str) -> int:
    row = 0  # bit-parallel, one word for a of any length
    full, where = (1 << len(a)) - 1, {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    v = full
    for ch in b:
        m = where.get(ch, 0)
        v = (v + (v & m)) | (v & ~m)
        v &= full
    row = len(a) - bin(v).count("1")
    return row


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _lcs(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


@F.pandas_udf(T.DoubleType())
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the matching blocks over the length of ``b``."""
    from difflib import SequenceMatcher

    return pd.Series([sum(m.size for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()) / max(1, len(y)) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


@F.pandas_udf(INDEXED)
def ordered_subsequence(seq: pd.Series, order: pd.Series) -> pd.DataFrame:
    """Longest common subsequence with its places in ``seq``; empty beyond 100 characters."""
    out = []
    for a, b in zip(seq, order, strict=True):
        if len(a) > 100 or len(b) > 100:
            out.append(("", []))
            continue
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
        i = j = 0
        at = []
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                at.append(i)
                i, j = i + 1, j + 1
            elif t[i + 1][j] >= t[i][j + 1]:
                i += 1
            else:
                j += 1
        out.append(("".join(a[k] for k in at), at))
    return pd.DataFrame(out, columns=["text", "index"])
