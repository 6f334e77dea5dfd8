"""Training-data operators against brute force and SQL, with nulls, empty and repeated rows, clashing columns."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import chat, decontamination, licences, line_dedup, mixing, near_dedup, perplexity, quality_rules, simhash, suffix_dedup, token_counts
from scriptorium.llm import queries as llm_queries

DOC = "doc_id long, text string, source string, lang string, _id string, _h long, id string"
DATA = "/root/testdata/sf0.001"


def docs(spark, texts, source="s", lang="en", start=0):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(start + i, t, source, lang, "x", 1, "y") for i, t in enumerate(texts)], DOC)


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(80)]
    lines = [" ".join(r.choice(vocab) for _ in range(r.randrange(4, 14))) for _ in range(90)]
    out = ["\n".join(r.choice(lines) for _ in range(r.randrange(1, 9))) for _ in range(n)]
    return [*out, out[0], out[1] + " tail", None, "", " \n\t ", "é" * 300, "ab " * 900]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    return duckdb.connect()


def same_as_sql(spark, duck, df, sql, **tables):
    for name, t in tables.items():
        duck.register("in_" + name, t.toPandas())
        duck.sql(f"create or replace view {name} as select * from in_{name}")
    rel = duck.sql(sql)
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())


# 1 SimHash
def brute_simhash(texts):
    from xxhash import xxh64_intdigest

    fps = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        g = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxh64_intdigest(x, 42) for x in g]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    comp = {i: i for i in fps}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    return {(i, f"{fps[i]:016x}", root(i)) for i in ids}


@pytest.mark.parametrize("bucket", [1, 32])
def test_simhash_components(spark, bucket):
    texts = corpus(2)
    got = {tuple(r) for r in simhash.near_duplicates(docs(spark, texts), bucket=bucket).collect()}
    assert got == brute_simhash(list(enumerate(texts)))


@pytest.mark.parametrize("at_once", [1, 3000, 10**6])
def test_fingerprints_are_hashed_together(monkeypatch, at_once):
    """Texts of three words or more, 65,535 at most, never go through the function for one text; all get its fingerprint."""
    r = random.Random(43)
    word = lambda: "".join(r.choice("abÄé漢😀Z.,\x00\x1c\u00a0") for _ in range(r.choice([1, 2, 3, 5, 8, 13, 40, 90])))
    usual = [" \t"[k % 2] + "".join(word() + r.choice([" ", "\n", "\r\n", "  "]) for _ in range(r.randrange(3, 90))) for k in range(150)]
    usual += ["a b c", "x " * 3000, "Ab " * 65535] + [t.upper() for t in usual[:9]]
    odd = [None, "", " \n", "a", "a b", "Ab " * 65536, "a " * 70000 + "b"]
    want = {i: int(f, 16) for t in (usual + odd,) for i, f, _ in brute_simhash(list(enumerate(t)))}
    monkeypatch.setattr(simhash, "AT_ONCE", at_once)
    mixed = [None if t is None else t.encode() for t in usual + odd]
    assert simhash.fingerprints_of(iter(mixed)) == [want[k] for k in range(len(mixed))]
    if at_once == 10**6:
        monkeypatch.setattr(simhash, "fingerprint", None)
        assert simhash.fingerprints_of([t.encode() for t in usual]) == [want[k] for k in range(len(usual))]
    assert simhash.fingerprints_of([]) == []


@pytest.mark.parametrize("bucket", [1, 4, 1000])
def test_links_give_all_pairs_within_two_bits(spark, bucket):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(6)]
    fps = {b ^ sum(1 << k for k in r.sample(range(64), r.randrange(0, 5))) for b in base for _ in range(40)} | {0, 1, 3, 7, 15}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    e = simhash.links(spark.createDataFrame([(x,) for x in signed], "_fp long"), bucket)
    group = {x: x for x in signed}

    def root(g, x):
        while g[x] != x:
            x = g[x]
        return x

    for u, v in e.collect():
        assert ((u ^ v) & (2**64 - 1)).bit_count() <= 2
        a, b = root(group, u), root(group, v)
        group[max(a, b)] = min(a, b)
    want = {x: x for x in signed}
    for x in signed:
        for y in signed:
            if x < y and ((x ^ y) & (2**64 - 1)).bit_count() <= 2:
                a, b = root(want, x), root(want, y)
                want[max(a, b)] = min(a, b)
    assert {x: root(group, x) for x in signed} == {x: root(want, x) for x in signed}


def test_components_of_long_chains(spark):
    r = random.Random(6)
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 50)] + [(2000, 2001)]
    r.shuffle(edges)
    got = {x.v: x.u for x in simhash.components(spark.createDataFrame(edges, "u long, v long").repartition(8)).collect()}
    assert got == {k: 0 for k in range(1, 301)} | {1000 + k: 1000 for k in range(1, 50)} | {2001: 2000}


def test_pipeline_near_dedup_is_by_simhash(spark):
    """What stays is the least id of each component of fingerprints, nothing else: also of texts alike in 0.8 of their
    shingles whose fingerprints are far apart, of rows without an id and of rows that repeat one."""
    import corpus_pipeline

    r = random.Random(41)
    vocab = [f"w{k}" for k in range(3000)]
    base = [[r.choice(vocab) for _ in range(200)] for _ in range(20)]
    texts = corpus(3) + [" ".join(w) for w in base] + [" ".join(edited(r, vocab, w, "tail", s)) for w in base for s in (0.005, 0.1)]
    named = brute_simhash(list(enumerate(texts)))
    assert brute_near(texts) != sorted({c for _, _, c in named})
    got = corpus_pipeline.dedup_near(spark, docs(spark, texts), "")
    assert sorted(x.doc_id for x in got.collect()) == sorted({c for _, _, c in named}) and got.columns == docs(spark, ["x"]).columns
    odd = spark.createDataFrame([(5, texts[0]), (7, texts[0]), (7, texts[1]), (8, texts[0]), (None, texts[0])], "doc_id long, text string")
    assert sorted(map(repr, (x.doc_id for x in corpus_pipeline.dedup_near(spark, odd, "").collect()))) == ["5", "7", "7", "None"]


def test_near_dedup_keeps_one(spark):
    r = random.Random(8)
    words = [f"w{k}" for k in range(4000)]
    base = [[r.choice(words) for _ in range(300)] for _ in range(12)]
    near = [b[:150] + ["changed"] + b[151:] for b in base]
    texts = [" ".join(b) for b in base] + [" ".join(b) for b in near] + [" ".join(base[0])]
    d = docs(spark, texts).unionByName(spark.createDataFrame([(None, texts[0], "s", "en", "", 0, "")], DOC))
    got = sorted((x.doc_id is None, x.doc_id or 0) for x in near_dedup.near_dedup(d).collect())
    assert got == [(False, k) for k in range(12)] + [(True, 0)]
    assert near_dedup.near_dedup(d).columns == d.columns


def brute_near(texts):
    """The places of the texts that stay: components of all pairs whose sets of five-word shingles are 0.8 alike."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for v, b in enumerate(sets):
        for u in range(v):
            a = sets[u]
            if a == b or (a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b)):
                x, y = root[u], root[v]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return sorted(set(root))


def edited(r, vocab, w, kind, share):
    n = int(len(w) * share)
    fresh = [r.choice(vocab) for _ in range(n)]
    if kind == "tail":
        return w[: len(w) - n] + fresh
    if kind == "append":
        return w + fresh
    at = set(r.sample(range(len(w)), n // 5))
    return [r.choice(vocab) if k in at else x for k, x in enumerate(w)]


def test_near_dedup_of_block_and_scattered_edits(spark):
    r = random.Random(21)
    vocab = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(25):
        w = [r.choice(vocab) for _ in range(200)]
        texts += [" ".join(w), *(" ".join(edited(r, vocab, w, kind, s)) for kind, s in (("tail", 0.1), ("tail", 0.14), ("append", 0.22), ("append", 0.3), ("scattered", 0.1), ("scattered", 0.2)))]
    r.shuffle(texts)
    got = sorted(x.doc_id for x in near_dedup.near_dedup(docs(spark, texts)).collect())
    assert got == brute_near(texts)


@pytest.mark.parametrize("bucket", [32, 3])
def test_near_dedup_of_crowded_keys(spark, bucket):
    r = random.Random(22)
    vocab = [f"w{k}" for k in range(100)]
    base = [r.choice(vocab) for _ in range(300)]
    texts = [" ".join(r.sample(base, len(base))) for _ in range(120)]
    texts += [" ".join([*t.split()[:90], "changed", *t.split()[91:]]) for t in texts[:40]]
    # one boilerplate in many texts, and many copies of one text with edits of their own
    frame = [r.choice(vocab) for _ in range(150)]
    texts += [" ".join([*frame, *(r.choice(vocab) for _ in range(n))]) for n in [25, 28, 31, 34, 37, 60] * 20]
    texts += [" ".join(edited(r, vocab, base, "tail", r.uniform(0.01, 0.15))) for _ in range(60)]
    r.shuffle(texts)
    got = sorted(x.doc_id for x in near_dedup.near_dedup(docs(spark, texts), bucket=bucket).collect())
    assert got == brute_near(texts)


def test_near_dedup_of_one_vocabulary(spark):
    """Twenty orders of the same 400 words, each with a near copy: two neighbours swapped."""
    r = random.Random(31)
    words, texts = [f"w{k}" for k in range(400)], []
    for _ in range(20):
        w = r.sample(words, 400)
        at = r.randrange(390)
        texts += [" ".join(w), " ".join([*w[:at], w[at + 1], w[at], *w[at + 2 :]])]
    got = sorted(x.doc_id for x in near_dedup.near_dedup(docs(spark, texts)).collect())
    assert got == list(range(0, 40, 2)) == brute_near(texts)


def test_near_dedup_draws_the_line_at_the_limit(spark):
    r = random.Random(23)
    vocab = [f"w{k}" for k in range(3000)]
    texts, stay = [], set()
    for k in range(120):
        # sets of 500 shingles that share 450 - k // 2: 0.82 down to 0.64
        w, same = [r.choice(vocab) for _ in range(504)], 450 - k // 2
        texts += [" ".join(w), " ".join([*w[: same + 4], *(f"x{r.random()}" for _ in range(500 - same))])]
        stay |= {2 * k} if 9 * same >= 4 * 1000 else {2 * k, 2 * k + 1}
    got = {x.doc_id for x in near_dedup.near_dedup(docs(spark, texts)).collect()}
    assert got == stay and len(stay) == 240 - 12


# 2 decontamination
def test_decontamination_finds_edits(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8)))
    items = [" ".join(word() for _ in range(25)) for _ in range(12)]
    bench = spark.createDataFrame([*enumerate(items), (99, "short"), (98, None), (0, items[0])], "item_id long, text string")
    texts, want = [], set()
    for k, item in enumerate(items):
        m = len(decontamination.normal(item))
        for edits in (0, int(m * 0.06), int(m * 0.06) + 6):
            s = list(item)
            for at in r.sample(range(len(s)), edits):
                s[at] = "z"
            texts.append(" ".join(word() for _ in range(30)) + " -- " + "".join(s).upper() + "!\n" + " ".join(word() for _ in range(5)))
    texts += [None, "", "short", " ".join(word() for _ in range(40))]

    def least(p, t):
        prev = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            cur = [i]
            for j, b in enumerate(t, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (a != b)))
            prev = cur
        return min(prev)

    for i, t in enumerate(texts):
        for k, item in enumerate(items):
            p = decontamination.normal(item)
            if t and (n := least(p, decontamination.normal(t))) <= int(len(p) * decontamination.SHARE):
                want.add((i, k, n))
    for block in (decontamination.BLOCK_CHARS, 700):
        got = {(x.doc_id, x.item_id, x.distance) for x in decontamination.matches(docs(spark, texts), bench, block_chars=block).collect()}
        assert got == want
    left = {x.doc_id for x in decontamination.decontaminate(docs(spark, texts), bench).collect()}
    assert left == set(range(len(texts))) - {i for i, _, _ in want} and len(want) >= 24


def test_decontamination_of_short_items_and_odd_ids(spark):
    bench = spark.createDataFrame([("a", "Paris!"), ("b", "the quick brown"), ("c", "?!"), (None, "null id item"), ("d", None)], "item_id string, text string")
    d = docs(spark, ["in Paris, France", "comparison", "THE  quick-brown fox", "the quick brownie", "a null id item", "?!", None, "paris", "word " * 200_000 + "paris"])
    got = {(x.doc_id, x.item_id): (x.distance, x.end_at) for x in decontamination.matches(d, bench, min_chars=1).collect()}
    assert got == {(0, "a"): (0, 8), (2, "b"): (0, 15), (4, None): (0, 14), (7, "a"): (0, 5), (8, "a"): (0, 1_000_005)}
    assert decontamination.decontaminate(d, bench).count() == d.count()
    assert decontamination.decontaminate(d, bench, min_chars=1).count() == d.count() - 5


# 3 preference formatting
def test_preference_pairs(spark, duck):
    t = spark.createDataFrame([(0, 0, "user", "hi"), (0, 1, "assistant", "good"), (1, 0, "user", "hi"), (1, 1, "assistant", "bad"), (1, 1, "assistant", "bad"), (2, 0, "user", None), (3, 0, "user", None), (4, 0, None, "x"), (4, 1, "assistant", "é"), (None, 0, "user", "q"), (7, 0, "user", "only")], "conv_id long, turn long, role string, text string")
    df = chat.preference_pairs(t, F.floor(F.col("conv_id") / 2).cast("long"), F.pmod("conv_id", F.lit(2)) == 0)
    r = {x.pair_id: x for x in df.collect()}
    assert r[0].n_common == 1 and r[0].prompt == "<|im_start|>user\nhi<|im_end|>\n"
    for side, word in (("chosen", "good"), ("rejected", "bad")):
        (span,) = r[0][side + "_mask"]
        assert r[0][side][span.begin : span.end] == word + "<|im_end|>"
    assert (r[1].n_common, r[1].chosen, r[1].rejected) == (1, "", "")
    assert r[2].rejected is None and r[2].chosen.endswith("é<|im_end|>\n") and r[3].chosen is None
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string"))), ",")
    same_as_sql(spark, duck, df.withColumn("chosen_mask", spans(F.col("chosen_mask"))).withColumn("rejected_mask", spans(F.col("rejected_mask"))).filter("pair_id < 2"), chat.PAIRS_SQL, conversations=t.filter("conv_id < 4"))
    assert chat.preference_pairs(t.limit(0), F.col("conv_id"), F.lit(True)).count() == 0


def test_branched_conversations(spark, duck):
    r = random.Random(32)
    rows = [(k, j, r.choice(["user", "assistant", "system", None]), r.choice(["hi", "é ü", "", None, "a\nb", "long " * 5])) for k in range(60) for j in range(r.randrange(1, 9))]
    rows += rows[:20] + [(3, None, "assistant", "late"), (None, 0, "user", "q"), (90, 0, "user", "q" * 200_000), (90, 1, "assistant", "one"), (90, 2, "user", "more"), (90, 3, "assistant", "two"), (91, 0, "assistant", "only"), (92, 0, "user", "none")]
    t = spark.createDataFrame([(*x, "id") for x in rows], "conv_id long, turn long, role string, text string, _t string")
    df = chat.branched(t)
    got = {x.pair_id: x for x in df.collect()}
    assert got[90].n_common == 3 and got[90].prompt.count("<|im_start|>") == 3 and got[90].prompt.endswith("user\nmore<|im_end|>\n")
    assert (got[90].chosen, got[90].rejected) == tuple(f"<|im_start|>assistant\n{w}<|im_end|>\n" for w in ("two", "one"))
    assert got[91].rejected is None and got[92].rejected is None and got[92].chosen.endswith("none<|im_end|>\n") and None not in got
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string"))), ",")
    same_as_sql(spark, duck, df.withColumn("chosen_mask", spans(F.col("chosen_mask"))).withColumn("rejected_mask", spans(F.col("rejected_mask"))), chat.OP3_SQL, conversations=t.filter("conv_id is not null").select("conv_id", "turn", "role", "text"))
    assert chat.branched(t.limit(0)).count() == 0 and sum(x.n_common > 0 and x.rejected is not None for x in got.values()) > 20


# 4 quality rules
def test_quality_rules(spark, duck):
    texts = [*corpus(5), *["shared boiler line here\n" + " ".join(f"u{k}x{j}" for j in range(12)) for k in range(30)], *["shared boiler line here\na b" for _ in range(3)], "a b c d e " * 8, "x " * 9]
    d = docs(spark, texts)
    df = quality_rules.quality_rules(d)
    same_as_sql(spark, duck, df, quality_rules.OP4_SQL, documents=d.select("doc_id", "text", "source"))
    kept = {x.doc_id: x.kept for x in df.collect()}
    held = [k for k, t in enumerate(texts) if t and "boiler" in t]
    assert len(held) == 33 and sum(kept[k] for k in held) == 30  # three are nothing but the line
    # sources of their own: a line of four of fifty documents is above that host's limit, of three is not
    small = docs(spark, [f"own {k} words of this one document go here and on\n" + ("often\n" if k < 4 else "") + ("seldom\n" if k < 3 else "") for k in range(50)], "tiny", start=5000).unionByName(docs(spark, [None, "null host line one two three"], None, start=6000))
    both = d.unionByName(small)
    same_as_sql(spark, duck, quality_rules.quality_rules(both), quality_rules.OP4_SQL, documents=both.select("doc_id", "text", "source"))
    assert {x.doc_id - 5000: x.n_removed_words for x in quality_rules.quality_rules(small).collect() if x.doc_id < 5010} == {k: int(k < 4) for k in range(10)}
    twice = quality_rules.quality_rules(d.union(d))
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, df.union(df).collect()))


# 5 suffix arrays
def brute_repeats(texts, size):
    seen = {}
    for k, x in enumerate(texts):
        for i in range(len(x) - size + 1):
            seen.setdefault(x[i : i + size], []).append((k, i))
    marks = [bytearray(len(x)) for x in texts]
    for at in seen.values():
        if len(at) > 1:
            for k, i in at:
                marks[k][i : i + size] = b"\1" * size
    return marks


def test_suffix_arrays_of_hard_strings():
    r = random.Random(9)
    for _ in range(150):
        alphabet = r.choice([b"a", b"ab", b"abc", bytes(range(256))])
        size = r.choice([8, 9, 12, 16])
        base = bytes(r.choice(alphabet) for _ in range(50))
        texts = [bytes(r.choice(alphabet) for _ in range(r.randrange(30))) + base[r.randrange(20) : r.randrange(20, 50)] for _ in range(r.randrange(1, 9))]
        got = [{i for a, b in runs for i in range(a, b)} for runs in suffix_dedup.repeats(texts, size)]
        seen = {}
        for k, x in enumerate(texts):
            for i in range(len(x) - size + 1):
                seen.setdefault(x[i : i + size], []).append((k, i))
        want = [set() for _ in texts]
        for at in seen.values():
            for k, i in at if len(at) > 1 else ():
                want[k].add(i)
        assert got == want


def test_suffix_arrays_are_sorted():
    """Against plain sorting, with inputs that recurse several times."""
    import numpy as np

    r = random.Random(11)
    fib = [1, 2]
    for a, b in [([1], [1, 2])]:
        while len(b) < 400:
            a, b = b, b + a
        fib = b
    cases = [fib, [1] * 50, [1, 2] * 80, [2, 1] * 80, list(range(1, 200)), list(range(200, 0, -1))]
    cases += [[r.randrange(1, m) for _ in range(r.randrange(1, 300))] for m in (2, 3, 4, 30, 258) for _ in range(30)]
    for c in cases:
        t = [*c, 0]
        want = sorted(range(len(t)), key=lambda i: t[i:])
        assert suffix_dedup._names_sorted(np.array(t)).tolist() == want
        assert suffix_dedup.suffix_array(np.array(t, dtype=np.uint16), 258).tolist() == want


def test_suffix_arrays_get_only_windows_that_may_repeat(monkeypatch):
    """Segments that share a key but no string around their least gram stay out; every equal window is found."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(12)
    word = lambda n: bytes(r.choice(b"abcdef ") for _ in range(n))
    phrase, passages, period = word(150), [word(r.randrange(195, 420)) for _ in range(12)], word(90)
    edited = [x[:k] + b"#" + x[k + 1 :] for x in passages for k in (0, 1, 100, len(x) - 1)]
    cases = [([word(400) + phrase + word(400) for _ in range(12)], False)]
    cases += [([word(r.randrange(250)) + x + word(r.randrange(250)) for x in r.sample(passages + edited, 30)] + [period * 9, period * 5 + word(300), period * 4], True) for _ in range(6)]
    given, arrays = [], suffix_dedup.repeats
    monkeypatch.setattr(suffix_dedup, "repeats", lambda texts, *a: given.extend(texts) or arrays(texts, *a))
    for texts, found in cases:
        given.clear()
        raw = b"".join(texts)
        off = np.cumsum([0, *map(len, texts)])
        doc, start, many, key, _ = suffix_dedup.segments(np.frombuffer(raw, dtype=np.uint8), off)
        segs = {(int(k), raw[a : a + n + 199]) for k, a, n in zip(key, off[doc] + start, many.tolist(), strict=True)}
        held = {}
        for k, _ in segs:
            held[k] = held.get(k, 0) + 1
        segs = sorted(x for x in segs if held[x[0]] > 1)
        assert segs
        v = pa.array(np.array([k for k, _ in segs], dtype=np.uint64).view(np.int64))
        out = suffix_dedup._shard(pa.table({"v": v, "d": pa.array(range(len(segs)), pa.int64()), "seg": pa.array([x for _, x in segs], pa.binary())}))
        at = {}
        for k, (_, x) in enumerate(segs):
            for i in range(len(x) - 199):
                at.setdefault(x[i : i + 200], set()).add((k, i))
        want = {y for x in at.values() if len(x) > 1 for y in x}
        assert {(d, i) for d, a, b in zip(*(out.column(c).to_pylist() for c in ("d", "a", "b")), strict=True) for i in range(a, b)} == want
        assert bool(want) == found and (sum(map(len, given)) < sum(len(x) for _, x in segs) if found else not given)


def test_segments_do_not_depend_on_blocks(monkeypatch):
    import numpy as np

    r = random.Random(13)
    texts = [bytes(r.choice(b"ab") for _ in range(n)) for n in (0, 199, 200, 3000, 0, 450)] + [b"xy" * 900, b""]
    data, off = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])
    want = suffix_dedup.segments(data, off)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 97)
    assert all((a == b).all() for a, b in zip(suffix_dedup.segments(data, off), want, strict=True))


@pytest.mark.parametrize("group", [2000, 1])
def test_suffix_dedup(spark, group):
    r = random.Random(10)
    rand = lambda n: "".join(r.choice("abcdeé ") for _ in range(n))
    passage = rand(400)
    texts = [rand(300) + passage + rand(r.randrange(100)) for _ in range(8)] + [rand(500) for _ in range(5)] + ["ab" * 700, "z" * 199, "z" * 200, "y" * 450, None, "", passage[:250], rand(3000)]
    texts += [texts[8], texts[-1] + texts[-1][:300]]
    d = docs(spark, texts)
    raw = [(t or "").encode() for t in texts]
    marks = brute_repeats(raw, 200)
    got = {x.doc_id: x for x in suffix_dedup.remove_repeats(d.union(d.limit(1)), group=group).collect()}
    for k, (x, m) in enumerate(zip(raw, marks, strict=True)):
        kept = bytes(c for c, f in zip(x, m, strict=True) if not f)
        spans = sum(1 for i in range(len(m)) if m[i] and (not i or not m[i - 1]))
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, bytes(got[k].kept)) == (len(x), sum(m), spans, kept)
    assert suffix_dedup.remove_repeats(d.limit(0)).count() == 0


# 6 line dedup
def test_line_dedup(spark, duck):
    long = "This is a long line that many documents hold, with some words"
    texts = [*corpus(6), *[f"{k}\n  {long if k % 2 else long.upper()}\t\n{long}\nend" for k in range(7)], long]
    d = docs(spark, texts)
    out = line_dedup.line_dedup(d, report=True)
    digest = out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
    same_as_sql(spark, duck, digest, line_dedup.OP6_SQL, documents=d.select("doc_id", "text"))
    assert line_dedup.line_dedup(d).columns == d.columns and line_dedup.line_dedup(d.union(d)).count() == 2 * len(texts)


# 7 token counts
def test_token_counts(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    odd = ["it's we'll  I'D\t\n x_1__ 12½ ²³ \x1c\x85\xa0  café 北京 🙂‿🙂 a<|endoftext|> b <|endoftext|><|endoftext|>", "<|endoftext|>", "  ", "a" * 5000, "ǅǀ٣ ÷× …—€", None, ""]
    texts = [*odd, *corpus(7)]
    got = {x.doc_id: x for x in token_counts.token_counts(docs(spark, texts), P.path("byte_bpe_50k.json")).collect()}
    for k, t in enumerate(texts):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len((t or "").encode()), n, n > 512)
    assert token_counts.token_counts(docs(spark, texts).limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_token_counts_of_long_and_repeated_rows(spark, monkeypatch):
    """Small parts, frequencies beyond the bits of an entry, a null id and rows that repeat."""
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    fast = token_counts.PieceCounter(path)
    texts = ["ab " * 300_000, "the cat sat " * 40_000, *["the common word"] * 500, "x" * 20_000]
    d = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, "no id", 1), (0, texts[0], 1)], "doc_id long, text string, word int").repartition(3)
    got = sorted((x.doc_id is None, x.doc_id or 0, x.n_tokens) for x in token_counts.token_counts(d, path).collect())
    want = [(False, k, fast.count(t)) for k, t in enumerate(texts)]
    assert got == sorted([*want, want[0], (True, 0, fast.count("no id"))])


def test_token_counts_of_any_character():
    P = pytest.importorskip("public_tokenizers")
    fast = token_counts.PieceCounter(P.path("byte_bpe_50k.json"))
    for base in range(0, 0x3000, 16):
        t = "".join(f"a{chr(c)} {chr(c)}1{chr(c)}{chr(c)} " for c in range(base, base + 16))
        assert fast.count(t) == len(fast.tok.encode(t, add_special_tokens=False).ids)


# 8 mixing
def test_mixing(spark):
    d = docs(spark, corpus(11, 200), "a").unionByName(docs(spark, corpus(12, 50), "b", start=1000)).unionByName(docs(spark, corpus(13, 20), "c", start=2000)).unionByName(docs(spark, ["w " * 400], None, start=3000))
    rows = mixing.mix_report(d).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_report(d.repartition(7)).collect())) and len(rows) == d.count()
    by = {}
    for x in rows:
        assert 0 <= x.taken <= 2 * x.size
        by.setdefault(x.source, []).append(x)
    sizes = {s: sum(x.size for x in v) for s, v in by.items()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    target, open_, total = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        left = total - sum(target.values())
        part = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = {s for s in open_ if part[s] > 2 * sizes[s]}
        if not full:
            target |= part
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        open_ -= full
    for s, v in by.items():
        assert {x.source_size for x in v} == {sizes[s]} and v[0].target == pytest.approx(target[s])
        assert abs(sum(x.taken for x in v) - target[s]) <= 1.5 * mixing.BLOCK  # half a block of rounding, and a short last block
    m = mixing.mixed(d)
    assert m.agg(F.sum("words")).first()[0] == sum(x.taken for x in rows)
    assert mixing.mix_report(d.limit(0)).count() == 0


def brute_mix(rows, block, seed, shards):
    """``taken`` by place for rows (id, source, text), from the definition: hashes as XXH64 chained over the columns."""
    import struct
    from collections import Counter

    from xxhash import xxh64_intdigest

    def h(*xs):
        v = 42
        for x in xs:
            v = xxh64_intdigest(x.encode() if isinstance(x, str) else struct.pack("<q", x - (1 << 64) if x >> 63 == 1 else x), v)
        return v

    sig = lambda v: v - (1 << 64) if v >> 63 else v
    size = [len([w for w in (t or "").translate(str.maketrans("\t\n\v\f\r", " " * 5)).split(" ") if w]) for _, _, t in rows]
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[1] == s) for s in names}
    w, target, open_, all_ = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}, {}, set(names), 1.5 * sum(size)
    while True:
        part = {s: (all_ - sum(target.values())) * w[s] / sum(w[x] for x in open_) for s in open_}
        if not (full := {s for s in open_ if part[s] > 2 * total[s]}):
            target |= part
            break
        target |= {s: 2.0 * total[s] for s in full}
        open_ -= full
    taken = Counter()
    for rank, s in enumerate(names, 1):
        n = -(-total[s] // block)
        if not n:
            continue
        own = [k for k, r in enumerate(rows) if r[1] == s]
        buckets = max(1, -(-len(own) // mixing.BUCKET_DOCS))
        own.sort(key=lambda k: (sig(h(rows[k][0], "bucket")) % buckets, rows[k][0], size[k]))
        epochs = int(target[s] // total[s])
        quota = min(epochs * n + int((target[s] - epochs * total[s]) / block + 0.5), 2 * n)
        runs = [(0, 0, quota)]
        for level in range(shards.bit_length() - 1):
            cut = []
            for shard, first, c in runs:
                key = h(seed, rank, level, shard)
                left = sum(h(key, i).bit_count() for i in range(1, c // 64 + 1)) + (h(key, 0) >> 64 - c % 64).bit_count()
                cut += [x for x in ((2 * shard, first, left), (2 * shard + 1, first + left, c - left)) if x[2]]
            runs = cut
        assert sum(c for _, _, c in runs) == quota and len({x for x, _, _ in runs}) == len(runs)
        times = Counter()
        for _, first, c in runs:
            for j in range(first, first + c):
                key, x = h(seed, rank, j // n, "slot"), j % n
                for r in range(1, mixing.ROUNDS + 1):
                    other = (sig(hi(h, key, r)) % n - x + n) % n
                    coin = hc(h, key, r, max(x, other))
                    x = other if coin >> 63 else x
                times[x] += 1
        at = 0
        for k in own:
            for b in range(at // block, -(-(at + size[k]) // block)):
                taken[k] += times[b] * (min(at + size[k], (b + 1) * block) - max(at, b * block))
            at += size[k]
    return size, taken


def hi(h, key, r):
    """The hash of (key, r) where r is a 32-bit number."""
    import struct

    from xxhash import xxh64_intdigest

    return xxh64_intdigest(struct.pack("<i", r), h(key))


def hc(h, key, r, x):
    import struct

    from xxhash import xxh64_intdigest

    return xxh64_intdigest(b"coin", xxh64_intdigest(struct.pack("<q", x), hi(h, key, r)))


@pytest.mark.parametrize("shards", [1, 8])
def test_mixing_equals_its_definition(spark, shards):
    rows = [(k, s, t) for s, lo, n in (("a", 0, 120), ("b", 1000, 40), (None, 2000, 9)) for k, t in enumerate(corpus(lo + 5, n), lo)]
    d = spark.createDataFrame([(k, t, s) for k, s, t in rows], "doc_id long, text string, source string")
    size, taken = brute_mix(rows, mixing.BLOCK, 17, shards)
    got = {x.doc_id: (x.size, x.taken) for x in mixing.mix_report(d, shards=shards).collect()}
    assert got == {r[0]: (size[k], taken[k]) for k, r in enumerate(rows)}
    m = mixing.mixed(d, shards=shards).collect()
    assert {x.shard for x in m} == set(range(shards)) and {i: sum(x.words for x in m if x.doc_id == i) for i in got} == {i: n for i, (_, n) in got.items()}
    by = {}
    for x in m:
        by.setdefault((x.source, x.slot), []).append(x)
    assert all(len({(x.shard, x.block) for x in v}) == 1 and sum(x.words for x in v) <= mixing.BLOCK and all(x.begin + x.words <= got[x.doc_id][0] for x in v) for v in by.values())


def test_draws_are_binomial(spark):
    """Means and variances of a thousand draws on both sides of the limit."""
    for n in (1, 63, 64, 1000, 1023, mixing.COINS, 10 * mixing.COINS):
        x = spark.range(1000).select(mixing.heads(F.lit(n).cast("long"), F.xxhash64("id")).alias("x")).agg(F.avg("x"), F.variance("x"), F.min("x"), F.max("x")).first()
        assert 0 <= x[2] and x[3] <= n and abs(x[0] - n / 2) < 5 * (n / 4 / 1000) ** 0.5 and 0.75 < x[1] / (n / 4) < 1.25


def test_permutation(spark):
    for n in (1, 2, 7, 100, 997):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long")).alias("p"))
        assert {r.p for r in got.collect()} == set(range(n))


# 9 licences
def test_licences(spark, duck):
    wrapped = "x\n\nLicensed under the Apache License,\nVersion 2.0.\n\ny"
    mit = " ".join(licences.SENTENCES[k] for k in (2, 3, 4))
    texts = ["Foo. Released under the MIT License. Bar", "RELEASED under the\tmit license", wrapped, mit, None, "", "All rights reserved.\nThis work is licensed under the GNU General Public License, version 3.", *corpus(14, 10)]
    d = docs(spark, texts)
    got = {x.doc_id: x for x in licences.licence_scan(d).collect()}
    assert got[0].licences == ["MIT"] and got[1].licences == ["MIT"] and got[2].licences == ["Apache-2.0"] and got[3].licences == ["MIT"] and got[3].rules[0] == 1
    assert got[6].licences == ["GPL-3.0-only", "proprietary"] and set(got) == {0, 1, 2, 3, 6}
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    flat = licences.licence_scan(d).select("doc_id", *map(text, ("sentence_ids", "wrapped_ids", "rules", "licences")))
    same_as_sql(spark, duck, flat, licences.OP9_SQL, documents=d.select("doc_id", "text"))


def test_licence_files_as_published(spark):
    import textwrap

    s = licences.SENTENCES
    par = lambda x: textwrap.fill(x, 72)
    a, b = s[2].split(" The above ")
    mit = "\n\n".join(["MIT License", "Copyright (c) 2020 A. Writer", par(a), par("The above " + b), par(s[3] + " " + s[4])])
    c, d = s[12].split(" Unless ")
    apache = "\n\n".join([par(s[11] + " " + c.split(" http")[0]), "    http" + c.split(" http")[1], par("Unless " + d + " " + s[13])])
    spread = "Released under" + " -" * 1500 + " the MIT License."
    got = {x.doc_id: x for x in licences.licence_scan(docs(spark, [mit, apache, spread])).collect()}
    assert got[0].wrapped_ids == [7, 8, 3, 4] and got[0].licences == ["MIT"]
    assert got[1].wrapped_ids == [11, 15, 16, 17, 13] and got[1].licences == ["Apache-2.0"] and len(got[1].rules) == 1  # the longest rule takes them all
    assert got[2].wrapped_ids == [1] and got[2].licences == ["MIT"]


def brute_rules(ids, rules):
    """Positions of the rules that match, longest first, each taking what it matches."""
    out, ids = [], list(ids)
    for k, r in licences.in_order(rules):
        i = 0
        while i + len(r) <= len(ids):
            if ids[i : i + len(r)] == r:
                out.append(k)
                ids[i : i + len(r)] = [-1]
            i += 1
    return sorted(set(out))


def test_rules_take_sentences_in_order_and_mind_gaps(spark, duck):
    s, r = licences.KNOWN, random.Random(33)
    rows = [[2, 3, 4], [2, 0, 3, 4], [3, 2], [2, 2, 3], [41, 42, 43], [40, 41, 42, 43, 44, 45], [21, 22, 23, 24, 50], [0], [], [90, 22, 23, 91, 22, 92]]
    rows += [[r.choice([0, *s]) for _ in range(r.randrange(1, 12))] for _ in range(40)] + [[k for _ in range(4) for k in r.choice(licences.ALL_RULES)[1]] for _ in range(30)]
    texts = ["\n".join("some words that nobody knows" if i == 0 else s[i] + ("" if s[i][-1] in ".!?" else " ") for i in x) for x in rows]
    d = docs(spark, [*texts, "x. " * 100_000 + s[1], None])
    got = {x.doc_id: x for x in licences.licence_scan(d).collect()}
    for k, ids in enumerate(rows):
        if any(ids):
            assert got[k].sentence_ids == [i for i in ids if i]
            a, b = brute_rules(ids, licences.ALL_RULES), set(got[k].rules)
            assert set(a) <= b
    assert [n for n, _ in (licences.ALL_RULES[k - 1] for k in got[1].rules)] == ["MIT"] and got[1].rules == [3] and got[5].licences == ["BSD-3-Clause"]
    assert got[len(rows)].licences == ["MIT"] and len(rows) + 1 not in got
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    flat = licences.licence_scan(d).select("doc_id", *map(text, ("sentence_ids", "wrapped_ids", "rules", "licences")))
    same_as_sql(spark, duck, flat, licences.OP9_SQL, documents=d.select("doc_id", "text"))


# 10 Kneser-Ney
def brute_model(texts, order):
    """Interpolated modified Kneser-Ney with the module's discounts, straight from its definition."""
    from collections import Counter

    pad = perplexity.PAD * (order - 1)
    counts = {order: Counter((pad + t)[i : i + order] for t in texts for i in range(len(t)))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    disc = {}
    for k, c in counts.items():
        n1, n2, n3, n4 = (sum(v == r for v in c.values()) for r in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        d = [r - (r + 1) * y * (b / a) if a else y for r, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        disc[k] = [min(max(x, 0.05), r - 0.05) for r, x in enumerate(d, 1)]
    ctx = {k: {} for k in counts}
    for k, c in counts.items():
        for g, v in c.items():
            ctx[k].setdefault(g[:-1], []).append(v)

    def p(g):
        if not g:
            return 1 / perplexity.ALPHABET
        k, vs = len(g), ctx[len(g)].get(g[:-1])
        if not vs:
            return p(g[1:])
        cut = lambda v: disc[k][min(v, 3) - 1]
        v = counts[k].get(g, 0)
        return ((v - cut(v)) if v else 0.0) / sum(vs) + sum(map(cut, vs)) / sum(vs) * p(g[1:])

    return p, pad


def test_perplexity_equals_the_definition(spark):
    import math

    texts = [t for t in corpus(15, 40) if t and t.strip()]
    test = ["a new text", "zzz 中!", texts[0], None, "  ", "odd \x02 mark"]
    d = docs(spark, [*texts, *test])
    got = {r.id: r for r in perplexity.scores(d, spark.createDataFrame([(k,) for k in range(len(texts))], "id long"), "doc_id", "text", "lang").collect()}
    p, pad = brute_model([perplexity.normal(t) for t in texts], perplexity.ORDER)
    for k, t in enumerate([*texts, *test]):
        s = perplexity.normal(t)
        want = sum(math.log(p((pad + s)[i : i + perplexity.ORDER])) for i in range(len(s)) if s[i] != perplexity.PAD)
        assert got[k].n == len(s) and got[k].total == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_perplexity_of_odd_languages(spark):
    rows = [(1, "\x02", "en"), (2, "plain words here", "de"), (3, "more of them", None), (None, "plain words", "de"), (2, "plain words here", "de"), (4, "\x02\x02 \x02", None), (5, None, "fr")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(2, 1, 0), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = perplexity.classified(d, labels).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0, x.n_chars) for x in got) == [(False, 1, 1), (False, 2, 16), (False, 2, 16), (False, 3, 12), (False, 4, 4), (False, 5, 0), (True, 0, 11)]
    assert perplexity.quality_filter(d, labels).count() <= 7


def test_perplexity_sees_five_characters(spark):
    """Only the character four places back tells whether ``z`` or ``y`` follows."""
    texts = ["abcdz" * 40 + "ebcdy" * 40, "abcdz" * 20, "abcdy" * 20]
    d = docs(spark, texts)
    got = {x.id: x.total / x.n for x in perplexity.scores(d, spark.createDataFrame([(0,)], "id long"), "doc_id", "text", "lang").collect()}
    assert got[1] > -0.2 and got[2] < got[1] - 1


def test_classifier(spark):
    r = random.Random(16)
    good = [" ".join(r.choice(["the", "of", "and", "house", "river", "light", "stone"]) for _ in range(40)) for _ in range(300)]
    junk = ["".join(r.choice("@#$%^&*()!ZXQ") for _ in range(200)) for _ in range(20)]
    d = docs(spark, [*good, *junk, None, ""])
    labels = spark.createDataFrame([(k, 1, 0) for k in range(250)] + [(None, 1, 0), (310, 0, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.kept for x in perplexity.classified(d, labels).collect()}
    assert all(got[k] for k in range(300)) and not any(got[k] for k in range(300, 322))
    assert perplexity.quality_filter(d, labels).columns == d.columns and perplexity.quality_filter(d, labels).count() == 300
    assert perplexity.classified(d.limit(0), labels).count() == 0
    assert all(x.kept for x in perplexity.classified(d.filter("doc_id < 320"), labels.limit(0)).collect())


def test_classifier_rejects_junk_near_the_quantile(spark):
    """A tenth of the trusted texts has some noise; junk has three times as much."""
    r = random.Random(17)
    noise = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5))
    text = lambda share: " ".join(noise() if r.random() < share else r.choice(["the", "of", "and", "house", "river", "light", "stone"]) for _ in range(400))
    d = docs(spark, [*(text(0.1 if k % 10 == 0 else 0) for k in range(400)), *(text(0.3) for _ in range(20))])
    labels = spark.createDataFrame([(k, 1, 0) for k in range(400)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.kept for x in perplexity.classified(d, labels).collect()}
    assert all(got[k] for k in range(400)) and not any(got[k] for k in range(400, 420))
    assert all(x.kept for x in perplexity.classified(d, labels, slack=3.0).collect())


def test_plain_quantiles_by_language(spark):
    """The limit is the held-out quantile of the language itself; junk of both languages goes, trusted text beyond the quantile too."""
    r = random.Random(18)
    noise = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5))
    vocab = {"en": ["the", "of", "and", "house", "river", "light", "stone"], "de": ["der", "und", "haus", "fluss", "licht", "stein", "von"]}
    text = lambda lang, share: " ".join(noise() if r.random() < share else r.choice(vocab[lang]) for _ in range(200))
    rows = [(k, text(lang, 0.1 if k % 10 == 0 else 0), lang) for k, lang in enumerate(["en", "de"] * 200)] + [(400 + k, text(lang, 0.4), lang) for k, lang in enumerate(["en", "de"] * 10)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(400)], "doc_id long, quality int, toxic int")
    got = perplexity.classified(d, labels, **perplexity.PLAIN).collect()
    fold = {x.k for x in spark.range(400).filter(F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(perplexity.FOLDS)) == 0).select(F.col("id").alias("k")).collect()}
    for lang in vocab:
        held = sorted(x.log_perplexity for x in got if x.doc_id in fold and x.lang == lang)
        own = [x for x in got if x.lang == lang]
        assert {x.threshold for x in own} == {held[-(-98 * len(held) // 100) - 1]}
        assert all(x.kept == (x.log_perplexity <= x.threshold + perplexity.ALLOWANCE / x.n_chars) for x in own)
        assert not any(x.kept for x in own if x.doc_id >= 400) and sum(x.kept for x in own) >= 190


# all
def test_empty_tables(spark):
    d = docs(spark, ["x"]).limit(0)
    bench = spark.createDataFrame([(1, "an item that is long enough to be searched for")], "item_id long, text string")
    outs = [simhash.near_duplicates(d), near_dedup.near_dedup(d), decontamination.matches(d, bench), decontamination.matches(docs(spark, ["x"]), bench.limit(0)), decontamination.decontaminate(d, bench),
            quality_rules.quality_rules(d), line_dedup.line_dedup(d), licences.licence_scan(d), mixing.mixed(d)]
    assert [o.count() for o in outs] == [0] * len(outs)


def test_every_query_runs(spark):
    for name, q in llm_queries.QUERIES.items():
        assert q(spark, DATA).count() > 0, name


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near-dedup", "decontamination", "mixing"]
    out = corpus_pipeline.run(spark, DATA)
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert 0.5 * n < out.count() < n and {"doc_id", "taken", "target"} <= set(out.columns)
    assert out.select("doc_id").distinct().count() == out.count()


def test_digest_is_of_the_whole_text():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
