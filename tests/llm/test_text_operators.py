"""Operators on one text at a time, against plain versions of what they compute."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import _bytes, decontaminate, licenses, quality, queries, tokens, toxicity

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
text = st.text(alphabet="abAB 01\n\t.é#|日x", max_size=80)


@given(st.lists(text, max_size=6))
@settings(max_examples=60, deadline=None)
def test_words_are_split_as_the_pattern_does(texts):
    raw = [t.encode() for t in texts]
    for words, rx in ((_bytes.spaced_exact, SPACED), (_bytes.alnum_folded, ALNUM)):
        _, starts, ends, data, _, bounds = _bytes.split_words(words, raw) if raw else ([], [], [], b"", [], [0])
        for i, t in enumerate(texts):
            got = [data[a:z].decode() for a, z in zip(starts[bounds[i] : bounds[i + 1]], ends[bounds[i] : bounds[i + 1]], strict=True)]
            assert [x.translate(AZ) for x in got] == rx.findall(t.translate(AZ))


def test_hashes_depend_on_the_word_alone(monkeypatch):
    long = b"w" * 300
    data = b" ".join([b"Word", b"word", long, long.upper(), b"word" * 20])
    h, *_ = _bytes.spaced_folded.hashes(data)
    assert h[0] == h[1] and h[2] == h[3] and len(set(h.tolist())) == 3
    monkeypatch.setattr(_bytes, "PIECE", 16)
    again, *_ = _bytes.spaced_folded.hashes(data)
    assert again.tolist() == h.tolist()


def plain_counts(t):
    w = SPACED.findall(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(grams)
    at = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if SPACED.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(at)


@given(st.lists(text, min_size=1, max_size=5))
@settings(max_examples=80, deadline=None)
def test_quality_counts(texts):
    assert list(quality.counts_of([t.encode() for t in texts])) == [plain_counts(t) for t in texts]


def test_quality_rules_keep_clean_texts_and_drop_junk(spark, documents):
    clean = [(i, " ".join(f"w{i * k % 997}x{k}" for k in range(80 + i % 7)), "en", "s1" if i % 3 else None) for i in range(120)]
    junk = [(900, " ".join(f"w{k}%%% y{k}***" for k in range(70)), "en", "s1"), (901, None, None, None), (902, "a b c " * 60, "en", "s1"), (903, "", "en", "s1")]
    got = {r["id"]: r for r in quality.quality_rules(documents(clean + junk)).collect()}
    assert len(got) == 124 and all(got[i]["kept"] for i in range(120))
    assert not got[900]["kept"] and not got[900]["base_failed"] and got[900]["failed_rates"] == ["symbol_rate"]
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in (901, 902, 903))
    assert quality.quality_rules(documents([])).count() == 0


def test_the_same_rate_is_judged_by_its_source(spark, documents):
    # one source writes symbols throughout, the other hardly any; the probe has the same rate in both
    def text(i, every):
        return " ".join(f"w{i * k % 997}x{k}" + ("#" if every and k % every == 0 else "") for k in range(100))

    rows = [(i, text(i, 5 + i % 4), "en", "signs") for i in range(1500)] + [(5000 + i, text(i, 0 if i % 16 else 50), "en", "plain") for i in range(1500)]
    rows += [(2000, text(3, 6), "en", "signs"), (2001, text(3, 6), "en", "plain"), (2001, text(3, 6), "en", "plain"), (2002, text(3, 90), "en", "plain"), (2003, "w " * 200_000, "en", "signs")]
    got = {r["id"]: r for r in quality.quality_rules(documents(rows)).collect()}
    assert got[2000]["kept"] and got[2000]["failed_rates"] == [] and not got[2001]["kept"] and got[2001]["failed_rates"] == ["symbol_rate"] and not got[2001]["base_failed"]
    assert got[2002]["kept"] and got[2003]["base_failed"] and got[2003]["n_words"] == 200_000
    assert all(got[i]["kept"] and got[5000 + i]["kept"] for i in range(1500))


def test_a_small_group_is_judged_by_its_language(spark, documents):
    quiet = [(i, " ".join(f"w{i * k % 997}x{k}" for k in range(90)), "en", "big") for i in range(400)]
    loud = [(500 + i, " ".join(f"w{k}#" for k in range(90)), "en", "tiny") for i in range(3)]
    got = {r["id"]: r for r in quality.quality_rules(documents(quiet + loud)).collect()}
    fence = {(r["source"], r["rate"]): r["fence"] for r in quality.fences(quality.text_counts(documents(quiet + loud), "text", ["lang", "source"]), ["lang", "source"]).collect()}
    assert all(got[500 + i]["failed_rates"] == ["symbol_rate"] for i in range(3)) and fence["big", "symbol_rate"] == 0 and 0 < fence["tiny", "symbol_rate"] < 100


def test_sketches_merge_to_the_same_quantiles(spark):
    from pyspark.sql import functions as F

    values = [int(x) for x in np.random.default_rng(1).lognormal(5, 2, 3000)]
    df = spark.createDataFrame([(v,) for v in values], "x long").select("x", quality.bucket(F.col("x")).alias("b"))
    pairs = [tuple(r) for r in df.collect()]
    assert all(b <= x and x - b <= x / 32 for x, b in pairs) and all(x == b for x, b in pairs if x < 64)


# -- tokens --------------------------------------------------------------------


def test_token_counts_equal_the_library(spark, documents):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    texts = ["Hello, it's 2024!", "", None, "<|endoftext|> and <|startoftext|>x", "é Éß øŽ ŉ ſ İ", "日本 ́a", "a\x1cb \x85", "word " * 4000, "x" * 3000, "it's it's", "Hello, it's 2024!"]
    got = sorted(map(tuple, tokens.token_counts(documents(list(enumerate(texts))), path, limit=5, table_size=3).collect()))
    tok = Tokenizer.from_file(path)
    want = [len(tok.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert got == [(i, len((t or "").encode()), n, n > 5) for i, (t, n) in enumerate(zip(texts, want, strict=True))]
    assert tokens.token_counts(documents([]), path).count() == 0


@given(st.lists(st.text(alphabet="aZ'sT re!é9 <|>_\t\nıß", max_size=30), max_size=8))
@settings(max_examples=80, deadline=None)
def test_fast_split_counts_as_the_library_does(texts):
    c = tokens.Counter2(queries.tokenizer_path(), {"a": 1})
    assert c.count(texts) == c.encode(texts)


@given(st.lists(st.text(max_size=40), max_size=6), st.lists(st.text(alphabet="日本語 ни́وبيК̈éİ²٣①😀_'s\u0301\u0085\u1680\u200b’İ́ΐﬁ\u0345", max_size=40), max_size=6))
@settings(max_examples=150, deadline=None)
def test_other_scripts_count_as_the_library_does(texts, more):
    c = tokens.Counter2(queries.tokenizer_path(), {})
    for part in (texts, more, texts + more):
        part = [t.encode("utf-8", "ignore").decode() for t in part]
        assert c.count(part) == c.encode(part)


def test_other_scripts_go_through_both_tiers(spark, documents):
    texts = ["привет мир привет", "日本 日本", "hello мир", "<|x привет"] * 3
    path = queries.tokenizer_path()
    found = tokens.frequent_pretokens(documents(list(enumerate(texts))), path)
    assert {"привет", "мир", "日本", "hello"} <= set(found)
    c = tokens.Counter2(path, {"мир": 100})
    assert c.count(["мир мир 日本"])[0] == 200 + c.cache["日本"] and c.split("<|x привет") is None


# -- decontamination -------------------------------------------------------------


def plain_overlap(t, items, size):
    w = [x.translate(AZ) for x in ALNUM.findall(t.translate(AZ))]
    hit, found = set(), set()
    for item, u in items:
        v = ALNUM.findall((u or "").translate(AZ))
        k = min(size, len(v))
        windows = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2


@pytest.mark.parametrize("block", [1 << 20, 30])
def test_decontamination_equals_brute_force(spark, documents, block):
    rnd = np.random.default_rng(3)
    items = [(k, " ".join(f"t{x}" for x in rnd.integers(0, 6, n))) for k, n in enumerate([9, 3, 12, 1, 0, 8, 20])] + [(50, None), (51, "Same Words here")]
    docs = [(i, " ".join(f"T{x}" if x % 2 else f"t{x}," for x in rnd.integers(0, 6, rnd.integers(0, 60)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, docs[5][1]), (102, docs[5][1]), (103, "x same WORDS here y " + items[2][1] * 2), (104, "é " * 3000 + items[6][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(documents(docs), bench, window=4, block_bytes=block).drop("n_near_items")
    want = sorted((i, *plain_overlap(t or "", items, 4)) for i, t in docs)
    assert sorted(map(tuple, found.collect())) == want
    empty = decontaminate.contamination(documents(docs), bench.limit(0))
    assert empty.filter("n_hit > 0").count() == 0 and empty.count() == len(docs)


def test_proximity_finds_words_in_any_order_within_reach(spark, documents):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    docs = documents([(1, "delta x gamma beta alpha"), (2, "alpha beta gamma delta"), (3, "delta x x x x gamma beta alpha"), (4, "alpha alpha beta gamma")])
    got = {r["id"]: (r["items"], r["near_items"]) for r in decontaminate.find_overlaps(docs, bench, near=2).collect()}
    assert got == {1: ([], ["1"]), 2: (["1"], []), 3: ([], []), 4: ([], [])}


def plain_near(t, items, size, near):
    """Items with a span of at most size + near words that holds all words of a window, found by counting every span."""
    w = ALNUM.findall((t or "").translate(AZ))
    out = set()
    for item, u in items:
        v = ALNUM.findall((u or "").translate(AZ))
        k = min(size, len(v))
        for a in range(len(v) - k + 1 if v else 0):
            need = Counter(v[a : a + k])
            if any(not need - Counter(w[i : i + k + near]) for i in range(len(w))):
                out.add(str(item))
    return out


@pytest.mark.parametrize("block", [1 << 20, 400])
def test_proximity_equals_brute_force(spark, documents, block):
    rnd = np.random.default_rng(9)
    items = [(k, " ".join(f"t{x}" for x in rnd.integers(0, 9, n))) for k, n in enumerate([9, 2, 12, 1, 0, 5, 7])] + [(7, None), (None, "t1 t2 t3 t4 t5")]
    docs = [(i, " ".join(f"t{x}" for x in rnd.integers(0, 12, rnd.integers(0, 50)))) for i in range(60)] + [(None, items[0][1]), (100, None)]
    bench = spark.createDataFrame([(*x, "clash", 1) for x in items], "item_id long, text string, id string, n_hit int")
    found = decontaminate.find_overlaps(documents(docs), bench, window=4, near=2, block_bytes=block).collect()
    named = [(k, t) for k, t in items if k is not None]
    want = []
    for i, t in docs:
        exact = {str(k) for k, u in named if plain_overlap(t or "", [(k, u)], 4)[2]}
        # an item without an id hits words but has no name
        want.append((i, plain_overlap(t or "", items, 4)[1], sorted(exact), sorted(plain_near(t, named, 4, 2) - exact)))
    got = [(r["id"], len(r["hits"]), r["items"], r["near_items"]) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(bool(x[3]) for x in got) > 10


def test_postings_are_stored_for_every_word_or_for_the_benchmarks(spark, documents, tmp_path):
    df = documents([(1, "a b a c"), (2, None), (1, "B d")]).select("doc_id", "text")
    every = decontaminate.build_index(df.coalesce(1), None, str(tmp_path / "every")).collect()
    few = decontaminate.build_index(df.coalesce(1), np.zeros(0, np.uint64), str(tmp_path / "few")).collect()
    assert sum(len(r["positions"]) // 4 for r in every) == 6 and sum(len(r["positions"]) for r in few) == 0
    kept = decontaminate.find_overlaps(df.coalesce(1), spark.createDataFrame([(1, "a b")], "item_id int, text string"), index_path=str(tmp_path / "kept"))
    assert kept.filter("size(hits) > 0").count() == 1 and spark.read.parquet(str(tmp_path / "kept")).count() == 1
    assert [i for r in few for i in r["ids"]] == [1, 2, 1] and [len(r["terms"]) // 8 for r in every] == [4]


# -- toxicity ----------------------------------------------------------------------


def test_toxicity_learns_without_negatives_and_leaves_held_out_labels_alone(spark, documents):
    import zlib

    rnd = np.random.default_rng(7)
    word = lambda: f"w{rnd.integers(0, 400)}"
    toxic = [i % 5 == 0 for i in range(600)]
    docs = [(i, " ".join([word() for _ in range(40)] + ([f"vile{rnd.integers(0, 4)}"] * 2 if toxic[i] else []))) for i in range(600)]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    # labels of held-out rows are wrong: learning from them would show
    labels = spark.createDataFrame([(i, int(toxic[i]) if not held(i) else int(not toxic[i])) for i in range(500)], "doc_id long, toxic int")
    more = [(900, None), (901, ""), (902, "vile1 " * 3000)]
    got = {r["id"]: r for r in toxicity.toxicity(documents(docs + more), labels).collect()}
    assert all(r["held_out"] == held(i) for i, r in got.items()) and all(0 <= r["score"] <= 1 for r in got.values())
    wrong = sum(got[i]["predicted"] != toxic[i] for i in range(600))
    assert wrong <= 6 and not got[900]["predicted"] and not got[901]["predicted"] and got[902]["predicted"]
    assert toxicity.toxicity(documents(docs[:5]), labels.limit(0)).filter("score <> 0").count() == 0
    assert toxicity.toxicity(documents([]), labels).count() == 0


def test_toxicity_equals_plain_training_and_scoring(spark, documents):
    import math
    import zlib

    rnd = np.random.default_rng(12)
    docs = [(i, " ".join(f"Word{rnd.integers(0, 60)}" if rnd.random() < 0.8 else f"ab{rnd.integers(0, 9)}" for _ in range(rnd.integers(0, 40))) + (f" Vile{rnd.integers(0, 3)} vileness" if i % 6 == 0 else "")) for i in range(400)]
    docs += [(900, None), (901, "éé vile日 VILE1"), docs[6], (None, "vile1 vileness")]
    known = {i: int(i % 6 == 0) for i in range(330)}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    labels = spark.createDataFrame([(i, y, "x", "t", 1.0, 0) for i, y in known.items()] + [(None, 1, "x", "t", 1.0, 0), (3, None, "x", "t", 1.0, 0)], "doc_id long, toxic int, lang string, text string, score double, predicted int")

    def features(t):
        words = {w.encode() for w in ALNUM.findall((t or "").translate(AZ))}
        return {("w", w) for w in words} | {(k, w[:k]) for w in words for k in (4, 5) if len(w) >= k}

    train = [(features(t), known[i]) for i, t in docs if i in known and not held(i)]
    ids = [i for i in known if not held(i)]
    prior = sum(known[i] for i in ids) / len(ids)
    n_p, n_u = sum(y for _, y in train), len(train)
    p, u = Counter(f for fs, y in train if y for f in fs), Counter(f for fs, _ in train for f in fs)
    clip = lambda x: min(1 - 1e-12, max(1e-12, x))

    def chosen(f):
        rate = clip((p[f] + u[f]) / (n_p + n_u))
        gain = lambda k, n: k * math.log(clip(k / n) / rate) + (n - k) * math.log((1 - clip(k / n)) / (1 - rate))
        share = p[f] / n_p
        negative = max(0.0, (u[f] / n_u - prior * share) / (1 - prior))
        return p[f] >= 3 and round(2 * (gain(p[f], n_p) + gain(u[f], n_u)), 6) > toxicity.SURPRISE and share > 3 * negative

    names = sorted(filter(chosen, u), key=str)
    matrix = lambda rows: np.array([[f in fs for f in names] for fs in rows], np.float32)
    w, b = toxicity.fit_nnpu(matrix([fs for fs, y in train if y]), matrix([fs for fs, _ in train]), prior)
    want = sorted((str(i), held(i), 1 / (1 + math.exp(-b - sum(x for f, x in zip(names, w, strict=True) if f in features(t))))) for i, t in docs)
    got = sorted((str(r["id"]), r["held_out"], r["score"]) for r in toxicity.toxicity(documents(docs), labels).collect())
    assert len(names) > 3 and [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=0.02)


def test_risk_is_non_negative_where_the_plain_one_is_not():
    rnd = np.random.default_rng(0)
    xp, xu = (rnd.random((30, 40)) < 0.3).astype(np.float32), (rnd.random((30, 40)) < 0.3).astype(np.float32)
    w, b = toxicity.fit_nnpu(xp, xu, 0.4, steps=300)
    negative = np.logaddexp(0, xu @ w + b).mean() - 0.4 * np.logaddexp(0, xp @ w + b).mean()
    assert negative > -0.1 and (w >= 0).all()


# -- licenses ----------------------------------------------------------------------


def plain_places(t):
    w = ALNUM.findall((t or "").translate(AZ))
    at, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def plain_labels(t, size=64):
    out, best = set(), 0.0
    for line in (t or "").translate(AZ).split("\n"):
        w = ALNUM.findall(line)
        for a in range(0, max(1, len(w) - size // 2), size // 2):
            block = set(w[a : a + size])
            shared = [(label, len(block & set(x.split())) / len(set(x.split())), len(set(x.split()))) for label, x in licenses.TEMPLATES]
            met = [(c, label) for label, c, k in shared if c * k >= (k * 80 + 99) // 100 - 1e-9]
            if met:
                top = max(c for c, _ in met)
                best = max(best, top)
                out |= {label for c, label in met if c == top}
    return out, best


def test_license_scan_equals_brute_force(spark, documents):
    texts = [
        None, "", "CC BY cc-by, cc by-nc. all rights reserved", "Licensed under the Apache License,\nVersion 2.0", "x " * 40 + "licensed under the apache license version 2.0 " + "y " * 500, "licensed UNDER cc by-sa 4.0",
        "This work is licensed under the GNU General Public License, version 3.", "general public\nlicense general public license", "the gnu lesser general public license version 3 this work is licensed under", "all rights all rights reserved", "no license here",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "subject to the terms of the mozilla public license v 2 0", "all rights reserved " * 3000, "cc by" * 3,
    ]
    texts += texts[3:5]
    got = sorted(licenses.license_scan(documents(list(enumerate(texts)))).collect(), key=lambda r: r["id"])
    assert len(got) == len(texts)
    for r, t in zip(got, texts, strict=True):
        assert tuple(r)[1:6] == plain_places(t)
        base = set(filter(None, r["base_labels"].split(",")))
        labels, best = plain_labels(t)
        assert set(filter(None, r["labels"].split(","))) == labels | base
        assert r["score"] == pytest.approx(1.0 if base else best)
    assert licenses.license_scan(documents([])).count() == 0


def test_a_block_with_two_notices_keeps_both(spark, documents):
    texts = ["Licensed under the Apache License 2.0; bundled parts are released under the MIT license", "licensed under cc by-nc 4.0", "this work is licensed under the gnu general public license version 3"]
    got = {r["id"]: r["labels"] for r in licenses.license_scan(documents(list(enumerate(texts)))).collect()}
    # what a fuller match holds in full is no notice of its own: cc-by-sa has six of its seven words in cc-by, lgpl twelve of thirteen in gpl
    assert got == {0: "apache,mit", 1: "cc-by,cc-by-nc", 2: "gpl"}


def test_the_license_query_finds_wrapped_notices(spark, documents, tmp_path):
    far = "x " * 50 + "\n" + "y " * 50
    texts = ["Redistribution and use in source and binary forms, with or without\nmodification, are permitted", "a\nLicensed under the Apache License,\nVersion 2.0\nb", f"licensed under the apache\n{far}\nlicense version 2 0"]
    documents(list(enumerate(texts))).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["labels"] for r in queries.op10_license_scans(spark, str(tmp_path)).collect()}
    assert got == {0: "bsd", 1: "apache", 2: ""}


def test_the_license_query_equals_its_sql_on_hard_texts(spark, documents, tmp_path):
    import duckdb

    from graphloom.llm import oracles

    rnd = np.random.default_rng(8)
    notices = [t.split() for _, t in licenses.TEMPLATES]
    texts = [None, "", "\n\n", "x", "the \u212a \u0130 CC BY \u0130cc by cc\u212a by", "all RIGHTS reserved. " * 40, "licensed under cc by-nc 4.0\nreleased under\nthe mit license"]
    for _ in range(120):
        w = []
        for _ in range(rnd.integers(1, 4)):
            notice = list(notices[rnd.integers(len(notices))])
            if rnd.random() < 0.4:
                notice.pop(rnd.integers(len(notice)))
            w += [f"w{k}" for k in rnd.integers(0, 90, rnd.integers(0, 60))] + notice
        texts.append("".join(x + (" " if rnd.random() < 0.9 else "\n" if rnd.random() < 0.7 else ", ") for x in w))
    documents(list(enumerate(texts))).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op10_license_scans(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(oracles.SQL["op10_license_scans"])
    columns = sorted(got.columns)
    key = lambda rows, names: sorted(tuple(r[names.index(c)] for c in columns) for r in rows)
    a, b = key([tuple(r) for r in got.collect()], got.columns), key(want.fetchall(), want.columns)
    assert a == b and sum("," in r[columns.index("labels")] for r in a) > 20


def test_license_templates_are_a_parameter(spark, documents):
    df = documents([(1, "Use of this thing needs a bow\nto the queen"), (1, "Use of this thing needs a bow\nto the queen"), (2, "released under the mit license"), (None, "bow to the queen of this thing")])
    own = spark.createDataFrame([("bow", "needs a bow to the queen"), ("none", None), ("empty", " ")], "label string, text string")
    got = sorted(((r["id"], r["labels"]) for r in licenses.license_scan(df, templates=own, across_lines=True).collect()), key=str)
    assert got == [(1, "bow"), (1, "bow"), (2, ""), (None, "")]
    assert {r["labels"] for r in licenses.license_scan(df, templates=[]).collect()} == {""}
    with pytest.raises(ValueError):
        licenses.license_scan(df, templates=[("x", "y")] * (licenses.MOST_TEMPLATES + 1))
