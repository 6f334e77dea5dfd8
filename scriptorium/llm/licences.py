"""Licence scan by sentences and rules, in DataFrame operations only.

A text is cut into sentences twice: with every line break as an end, and with
line breaks as blanks (wrapped notices). Normalised sentences are looked up
among known licence sentences, which gives each cut a sequence of identifiers in the order of the text, with 0 for each
unknown sentence in between. The ordered rules, the longest first, are matched against these sequences: a rule's
sentences follow one another without a gap, and what a rule has matched is consumed, so that a rule for one sentence of
a licence does not match where the whole text of the licence stands.

The known sentences are a fixed, bounded parameter (``MAX_SENTENCES``), looked up inside the row by the hash of the
sentence: the scan needs no shuffle and no key can be hot.

Defined results: a null or empty text has no sentences; an empty table gives an
empty result; rows are independent, so repeated rows repeat; other columns are
not read. Texts without a known sentence give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, barrier, table

MAX_SENTENCES = 5000
#: Tables that the known sentences are dealt to by hash.
TABLES = 64

# Sentences of public licence texts, by identifier.
SENTENCES: dict[int, str] = {
    1: "Released under the MIT License.",
    2: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    3: "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    4: "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    5: "Licensed under the MIT License.",
    6: "SPDX-License-Identifier: MIT",
    10: "Licensed under the Apache License, Version 2.0.",
    11: "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    12: "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    13: "See the License for the specific language governing permissions and limitations under the License.",
    14: "SPDX-License-Identifier: Apache-2.0",
    20: "This work is licensed under the GNU General Public License, version 3.",
    21: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    22: "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    23: "See the GNU General Public License for more details.",
    24: "You should have received a copy of the GNU General Public License along with this program.",
    25: "SPDX-License-Identifier: GPL-3.0-only",
    26: "SPDX-License-Identifier: GPL-3.0-or-later",
    30: "Licensed under CC BY-NC 4.0.",
    31: "Licensed under CC BY 4.0.",
    32: "Licensed under CC BY-SA 4.0.",
    33: "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    34: "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    40: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    41: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    42: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    43: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    44: "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    45: "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    46: "SPDX-License-Identifier: BSD-3-Clause",
    47: "SPDX-License-Identifier: BSD-2-Clause",
    50: "All rights reserved.",
    60: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    61: "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    62: "SPDX-License-Identifier: ISC",
    70: "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    71: "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    72: "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    73: "SPDX-License-Identifier: MPL-2.0",
    80: "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    81: "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    82: "See the GNU Lesser General Public License for more details.",
    83: "SPDX-License-Identifier: LGPL-2.1-or-later",
    84: "SPDX-License-Identifier: LGPL-2.1-only",
    85: "SPDX-License-Identifier: LGPL-3.0-or-later",
    90: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    91: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    92: "See the GNU Affero General Public License for more details.",
    93: "SPDX-License-Identifier: GPL-2.0-only",
    94: "SPDX-License-Identifier: GPL-2.0-or-later",
    95: "SPDX-License-Identifier: AGPL-3.0-or-later",
    100: "This is free and unencumbered software released into the public domain.",
    101: "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    102: "SPDX-License-Identifier: Unlicense",
    110: "This software is provided 'as-is', without any express or implied warranty.",
    111: "In no event will the authors be held liable for any damages arising from the use of this software.",
    112: "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    113: "SPDX-License-Identifier: Zlib",
    120: "Distributed under the Boost Software License, Version 1.0.",
    121: "SPDX-License-Identifier: BSL-1.0",
    130: "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    131: "SPDX-License-Identifier: CC0-1.0",
    140: "Licensed under CC BY-ND 4.0.",
    141: "Licensed under CC BY-NC-SA 4.0.",
    142: "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    143: "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    144: "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
}

# Rules in order, (licence, sentence identifiers that follow one another).
RULES: list[tuple[str, list[int]]] = [
    ("MIT", [2, 3, 4]),
    ("MIT", [2, 3]),
    ("MIT", [2]),
    ("Apache-2.0", [11, 12, 13]),
    ("Apache-2.0", [11, 12]),
    ("GPL-3.0-or-later", [21, 22, 23, 24]),
    ("GPL-3.0-or-later", [21, 22, 23]),
    ("BSD-3-Clause", [41, 42, 43]),
    ("BSD-2-Clause", [41, 42]),
    ("MIT", [1]), ("MIT", [5]), ("MIT", [6]),
    ("Apache-2.0", [10]), ("Apache-2.0", [11]), ("Apache-2.0", [14]),
    ("GPL-3.0-only", [20]), ("GPL-3.0-only", [25]), ("GPL-3.0-or-later", [21]), ("GPL-3.0-or-later", [26]),
    ("CC-BY-NC-4.0", [30]), ("CC-BY-NC-4.0", [34]), ("CC-BY-4.0", [31]), ("CC-BY-4.0", [33]), ("CC-BY-SA-4.0", [32]),
    ("proprietary", [50]),
    ("BSD-3-Clause", [40, 41, 42, 43, 44, 45]), ("BSD-2-Clause", [40, 41, 42, 44, 45]), ("BSD-3-Clause", [46]), ("BSD-2-Clause", [47]),
    ("ISC", [60, 61]), ("ISC", [60]), ("ISC", [62]),
    ("MPL-2.0", [70, 0, 71]), ("MPL-2.0", [70, 0, 72]), ("MPL-2.0", [70]), ("MPL-2.0", [73]),
    ("LGPL-2.1-or-later", [80, 81, 82]), ("LGPL-2.1-or-later", [80]), ("LGPL-2.1-or-later", [83]), ("LGPL-2.1-only", [84]), ("LGPL-3.0-or-later", [85]),
    ("GPL-2.0-or-later", [90, 22, 23]), ("GPL-2.0-or-later", [90]), ("AGPL-3.0-or-later", [91, 22, 92]), ("AGPL-3.0-or-later", [91]),
    ("GPL-2.0-only", [93]), ("GPL-2.0-or-later", [94]), ("AGPL-3.0-or-later", [95]),
    ("Unlicense", [100, 101]), ("Unlicense", [100]), ("Unlicense", [102]), ("Zlib", [110, 111, 112]), ("Zlib", [113]),
    ("BSL-1.0", [120]), ("BSL-1.0", [121]), ("CC0-1.0", [130]), ("CC0-1.0", [131]),
    ("CC-BY-ND-4.0", [140]), ("CC-BY-NC-SA-4.0", [141]), ("CC-BY-SA-4.0", [142]), ("CC-BY-ND-4.0", [143]), ("CC-BY-NC-SA-4.0", [144]),
]

# Sentences 2 and 12 in the parts that the paragraphs of the published texts cut.
_ABOVE, _UNLESS, _URL = SENTENCES[2].index("The above"), SENTENCES[12].index("Unless"), SENTENCES[12].index("http:")
PARTS: dict[int, str] = {
    7: SENTENCES[2][:_ABOVE], 8: SENTENCES[2][_ABOVE:],
    15: SENTENCES[12][:_URL], 16: SENTENCES[12][_URL:_UNLESS], 17: SENTENCES[12][_UNLESS:],
}
PART_RULES: list[tuple[str, list[int]]] = [("MIT", [7, 8, 3, 4]), ("MIT", [7, 8, 3]), ("MIT", [7, 8]), ("MIT", [7]), ("Apache-2.0", [11, 15, 16, 17, 13]), ("Apache-2.0", [11, 15, 16, 17])]
KNOWN, ALL_RULES = SENTENCES | PARTS, RULES + PART_RULES


def normal(c: Column) -> Column:
    """ASCII letters lower-cased, runs of all else but letters and digits as one blank."""
    return F.btrim(F.regexp_replace(ascii_lower(c), "[^0-9a-z\\x{80}-\\x{10FFFF}]+", " "), F.lit(" "))


def plain(s: str) -> str:
    import re

    return re.sub("[^0-9a-z\x80-\U0010ffff]+", " ", s.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))).strip(" ")


def sentences(text: Column, wrapped: bool) -> Column:
    """Ends are ``.``, ``!`` or ``?`` before a blank, and line breaks (only blank lines if ``wrapped``)."""
    if wrapped:
        text = F.regexp_replace(F.regexp_replace(text, "\n[\\x20\\x09-\\x0D]*\n", "\u0001"), "\n", " ")
        return F.split(F.regexp_replace(text, "([.!?])[\\x20\\x09-\\x0D]+", "$1\u0001"), "\u0001")
    return F.split(F.regexp_replace(text, "([.!?])[\\x20\\x09-\\x0D]+", "$1\n"), "\n")


def in_order(rules: list[tuple[str, list[int]]]) -> list[tuple[int, list[int]]]:
    """Positions (from 1) and sentences of the rules as they are matched: the longest first, else as given."""
    return sorted(((k, list(r)) for k, (_, r) in enumerate(rules, 1)), key=lambda x: -len(x[1]))


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[int, str] = KNOWN, rules: list[tuple[str, list[int]]] = ALL_RULES) -> DataFrame:
    """``id_col, sentence_ids, wrapped_ids`` (arrays in text order), ``rules`` (positions of those that match, from 1), ``licences`` (in rule order)."""
    from xxhash import xxh64_intdigest

    if len(known) > MAX_SENTENCES:
        raise ValueError(f"more than {MAX_SENTENCES} known sentences")
    norm = {i: plain(s) for i, s in known.items()}
    least = min(map(len, norm.values()))
    dealt: list[list] = [[F.lit(""), F.lit(-1)] for _ in range(TABLES)]
    for i, s in norm.items():
        h = xxh64_intdigest(s.encode(), 42)
        dealt[(h - (1 << 64) if h >> 63 else h) % TABLES] += [F.lit(s), F.lit(i)]
    tables = F.array(*[F.create_map(*x) for x in dealt])

    def found(wrapped: bool) -> Column:
        # normalising never lengthens, and may shorten by any amount
        table_of = lambda x: F.element_at(tables, (F.pmod(F.xxhash64(x), F.lit(TABLES)) + 1).cast("int"))
        own = F.filter(F.transform(sentences(F.col("_t"), wrapped), normal), lambda x: x != "")
        return F.transform(own, lambda x: F.when(F.length(x) >= least, F.coalesce(F.try_element_at(table_of(x), x), F.lit(0))).otherwise(0))

    d = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    d = barrier(d.select(id_col, found(False).alias("_a"), found(True).alias("_b")))
    some = lambda c: F.filter(c, lambda i: i > 0)
    d = barrier(d.withColumn("sentence_ids", some("_a")).withColumn("wrapped_ids", some("_b")))
    d = d.filter((F.size("sentence_ids") > 0) | (F.size("wrapped_ids") > 0))
    seq = lambda c: F.array_join(F.transform(c, lambda i: F.concat(F.lit("<"), i.cast("string"), F.lit(">"))), "")
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit("".join(f"<{i}>" for i in r)).alias("p")) for k, r in in_order(rules)])
    state = lambda a, b, hits: F.struct(a.alias("a"), b.alias("b"), hits.alias("hits"))

    def match(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc["a"], rule["p"]) | F.contains(acc["b"], rule["p"])
        used = lambda x: F.replace(x, rule["p"], F.lit("<x>"))
        return state(used(acc["a"]), used(acc["b"]), F.when(hit, F.concat(acc["hits"], F.array(rule["k"]))).otherwise(acc["hits"]))

    hits = F.aggregate(steps, state(seq("_a"), seq("_b"), F.expr("cast(array() as array<int>)")), match, lambda acc: F.array_sort(acc["hits"]))
    d = barrier(d.select(id_col, "sentence_ids", "wrapped_ids", hits.alias("rules")))
    names = F.array(*[F.lit(n) for n, _ in rules])
    return d.withColumn("licences", F.array_distinct(F.transform("rules", lambda k: F.element_at(names, k))))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = licence_scan(table(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return d.select("doc_id", text("sentence_ids"), text("wrapped_ids"), text("rules"), text("licences"))


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    norm = "trim(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\\x{80}-\\x{10FFFF}]+', ' ', 'g'), ' ')"
    known = ", ".join(f"({i}, {q(plain(s))})" for i, s in KNOWN.items())
    names = ", ".join(f"({k}, {q(n)})" for k, (n, _) in enumerate(ALL_RULES, 1))
    blanks = "[\\x20\\x09-\\x0D]"
    cut = f"string_split(regexp_replace(t, '([.!?]){blanks}+', '\\1' || chr(10), 'g'), chr(10))"
    wrap = f"string_split(regexp_replace(replace(regexp_replace(t, '\\n{blanks}*\\n', chr(1), 'g'), chr(10), ' '), '([.!?]){blanks}+', '\\1' || chr(1), 'g'), chr(1))"
    part = lambda e: f"(select doc_id, {norm} as s, pos from (select doc_id, unnest({e}) as s, generate_subscripts({e}, 1) as pos from d))"
    ids = lambda e: f"""select doc_id, coalesce(string_agg(cast(id as varchar), ',' order by pos) filter (where id is not null), '') as ids,
  string_agg('<' || coalesce(id, 0) || '>', '' order by pos) as seq from {part(e)} x left join known using (s) where s <> '' group by doc_id"""  # noqa: E731
    steps = in_order(ALL_RULES)
    pattern = lambda r: q("".join(f"<{i}>" for i in r))
    chain = ", ".join(f"contains({c}{n}, {pattern(r)}) as {c}h{k}, replace({c}{n}, {pattern(r)}, '<x>') as {c}{n + 1}" for n, (k, r) in enumerate(steps) for c in "ab")
    hits = " union all ".join(f"select doc_id, {k} as k from m where ah{k} or bh{k}" for k, _ in steps)
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
known(id, s) as (values {known}), names(k, name) as (values {names}),
a as ({ids(cut)}), b as ({ids(wrap)}),
j as (select a.doc_id, a.ids as sentence_ids, b.ids as wrapped_ids, a.seq as a0, b.seq as b0 from a join b using (doc_id) where a.ids <> '' or b.ids <> ''),
m as materialized (select *, {chain} from j),
h as ({hits}),
r as (select doc_id, string_agg(cast(k as varchar), ',' order by k) as rules from h group by doc_id),
n as (select doc_id, string_agg(name, ',' order by k) as licences from (select doc_id, name, min(k) as k from h join names using (k) group by doc_id, name) group by doc_id)
select j.doc_id, sentence_ids, wrapped_ids, coalesce(rules, '') as rules, coalesce(licences, '') as licences from j left join r using (doc_id) left join n using (doc_id)
"""


OP9_SQL = _sql()
