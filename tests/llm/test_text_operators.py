import datetime
import os
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from lattica.llm import decontam, langid, licenses, line_dedup, packing, pii, quality_net, quality_rules

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000


# Packing


def test_pack():
    rng = np.random.default_rng(0)
    n = rng.integers(1, 8193, 3000)
    bins, offset, cap = packing.pack(n)
    assert set(cap) <= set(packing.CAPACITIES)
    filled = np.bincount(bins, weights=n)
    sizes = np.zeros(len(filled))
    sizes[bins] = cap
    assert (filled <= sizes).all() and filled.sum() / sizes.sum() > 0.95
    for b in range(len(filled)):
        own = sorted((o, k) for o, k in zip(offset[bins == b], n[bins == b]))
        assert own[0][0] == 0 and all(a + k == c for (a, k), (c, _) in zip(own, own[1:]))
        # downsized: no smaller permitted length holds the contents
        assert all(c < filled[b] or c >= sizes[b] for c in packing.CAPACITIES)
    assert all(len(x) == 0 for x in packing.pack(np.zeros(0, dtype=np.int64)))


def test_best_fit_takes_the_tightest_bin():
    # 600 and 900 open bins of 1024; 100 goes beside 900, the tighter
    bins, _, _ = packing.pack(np.array([900, 600, 100]), capacities=(1024,))
    assert bins[0] == bins[2] != bins[1]


def test_packed(spark):
    rows = [(1, "a b c", "x"), (2, None, "x"), (3, "", "x"), (4, LONG, "x"), (1, "a b c", "x"), (None, "z", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bin string")
    got = packing.packed(docs, shard=3).collect()
    tokens = defaultdict(int)
    for r in got:
        tokens[r.doc_id] += r.n
    assert tokens == {1: 8, 2: 1, 3: 1, 4: 30_001, None: 2}
    per = defaultdict(int)
    for r in got:
        per[r.shard, r.bin, r.capacity] += r.n
    assert all(n <= cap for (_, _, cap), n in per.items())
    assert packing.packed(docs.limit(0)).count() == 0


# Decontamination


def brute_hits(text, items, window=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, got = find(text), set(), set()
    for item, t in items:
        v = find(t)
        size = min(window, len(v))
        for k in range(len(v) - size + 1 if size else 0):
            for p in range(len(w) - size + 1):
                if w[p : p + size] == v[k : k + size]:
                    hit.update(range(p, p + size))
                    got.update({item} - {None})
    return len(w), len(hit), len(got), decontam.digest(list(got)), bool(hit)


ITEMS = [(1, " ".join(f"q{i}" for i in range(14))), (2, "one"), (3, "a b c"), (4, ""), (5, None), (11, "q2 Q3, q4"), (None, "zzz"), (7, "a a a a a a a a a a a a")]
DOCS = [(1, "x " + " ".join(f"q{i}" for i in range(13)) + " y"), (2, None), (3, ""), (4, "A-b C d one. ONE"), (5, "q0 q1 q2 q3 q4 q5 q6 q7 q8"), (6, LONG), (7, "a " * 25), (7, "a " * 25), (None, "one zzz"), (8, "é ÉÉ one")]


@pytest.mark.parametrize("block", [1 << 20, 20])
def test_decontamination_equals_brute_force(spark, block):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = decontam.search(docs, bench, ["doc_id"], block_bytes=block).collect()
    want = Counter((d, *brute_hits(t, ITEMS)[:3]) for d, t in DOCS)
    assert Counter((r.doc_id, r["__n_words"], sum(s["n"] for s in r["__spans"]), len(r["__items"])) for r in rows) == want


def test_contaminated(spark):
    docs = spark.createDataFrame([(*r, "k") for r in DOCS], "doc_id long, text string, items string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.contaminated(docs, bench).collect()}
    assert got == {(d, *brute_hits(t, ITEMS)) for d, t in DOCS}
    assert decontam.contaminated(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.contaminated(docs.limit(0), bench).count() == 0
    assert decontam.clean(docs, bench).columns == docs.columns


# Line deduplication


def brute_lines(docs, k=8, sim=0.8):
    occ = [(d, i, l.strip(" \t\n\r\x0b\x0c").lower()) for d, t in docs if t is not None for i, l in enumerate(t.split("\n"))]
    names = sorted({l for _, _, l in occ if l})
    sets = [{l[j : j + k] for j in range(len(l) - k + 1)} for l in names]
    root = list(range(len(names)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(names)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and n >= sim * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    at = {l: find(i) for i, l in enumerate(names)}
    first = {}
    for d, i, l in occ:
        if l:
            first[at[l]] = min((d, i), first.get(at[l], (d, i)))
    gone = {(d, i) for d, i, l in occ if l and first[at[l]] != (d, i)}
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in docs}


def test_line_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdefghiorst"), rng.integers(2, 9))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(vocabulary, n))
    passage = line(14)
    base = [line(int(rng.integers(3, 40))) for _ in range(30)]
    docs = []
    for d in range(60):
        own = [base[int(rng.integers(30))] for _ in range(4)] + [line(12), f"{line(9)} {passage} {line(9)}"]
        w = own[0].split()
        w[int(rng.integers(len(w)))] = "changed"
        docs.append((d, "\n".join([*own, " ".join(w), "", "  "])))
    docs += [(100, None), (101, ""), (102, "short"), (103, " SHORT "), (104, LONG), (105, LONG + "x")]
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n_dropped int")
    got = line_dedup.deduplicated(df)
    assert got.columns == ["doc_id", "text", "n_dropped"]
    assert {r.doc_id: r.text for r in got.collect()} == brute_lines(docs)
    assert line_dedup.deduplicated(df.limit(0)).count() == 0


def test_line_dedup_of_a_large_group(spark):
    """A passage in very many lines, and very many near copies of one line."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrst"), 7))
    passage = " ".join(word() for _ in range(25))
    docs = [(i, f"{' '.join(word() for _ in range(12))} {passage} {' '.join(word() for _ in range(12))}") for i in range(150)]
    line = [word() for _ in range(60)]
    for i in range(150):
        w = list(line)
        w[int(rng.integers(60))] = word()
        docs.append((1000 + i, " ".join(w)))
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_lines(docs)


def test_repeated_rows_lose_the_same_lines(spark):
    df = spark.createDataFrame([(1, "a line of text\nother one"), (1, "a line of text\nother one"), (2, "a line of text"), (None, "other one")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in line_dedup.deduplicated(df).collect())
    assert got == [("1", "a line of text\nother one")] * 2 + [("2", ""), ("None", "")]


# Quality rules


def test_base_rules_equal_brute_force(spark):
    texts = ["a b c d e f g h i j", "one two three four five " * 3, "x " * 100, None, "", " \n\t", "a\n a\na\n\nb #*$ <x>|&%", LONG, "w1 w2 w3 w4 w5 w6 w1 w2 w3 w4 w5 w7 w8 w9", "Ä b c\x0bd"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_rules.judged(df).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        places = defaultdict(list)
        for k in range(len(w) - 4):
            places[tuple(w[k : k + 5])].append(k)
        hit = {k + j for p in places.values() if len(p) > 1 for k in p for j in range(5)}
        lines = [l for l in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", l)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w))
        assert not (r.base_failed and r.kept)
    assert quality_rules.judged(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_rules_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    run = con.execute(quality_rules.ORACLE)
    names = [d[0] for d in run.description]
    want = sorted(map(repr, run.fetchall()))
    got = quality_rules.judged(spark.read.parquet(f"{SF}/documents.parquet")).select(*names).collect()
    assert sorted(repr(tuple(r)) for r in got) == want


def test_unlike_texts_go(spark):
    rng = np.random.default_rng(0)
    common = ["the", "of", "and", "to", "in"]
    prose = lambda: " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice(list("abcdefgh"), 5)) for _ in range(120))
    shout = " ".join("".join(rng.choice(list("ABCDEFGH"), 5)) + "!!" for _ in range(120))
    df = spark.createDataFrame([(i, prose(), "en") for i in range(30)] + [(99, shout, "en"), (98, prose(), None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.kept for r in quality_rules.judged(df).collect()}
    assert not got.pop(99) and all(got.values())


# Pseudonyms


def luhn(s):
    d = [int(c) for c in s if c.isdigit()]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms(spark):
    text = "mail a.b1@mail7.example.com, card 4111111111111111 4111-1111-1111-1111 bad 4111111111111112, +1 (017) 555-7713 on 2024-02-29, 2023-02-29, 29.02.2024; 10.0.0.1 999.1.1.1 ssn 123-45-6789 000-12-1234 v4.0. $1 \\ end"
    rows = [(1, text), (2, None), (3, ""), (4, "no data"), (5, "4111111111111111"), (6, LONG)]
    got = {r.doc_id: r for r in pii.pseudonymised(spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_card int")).collect()}
    out = got[1].text
    shape = lambda s: re.sub(r"\d", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", s)))
    ip = re.compile(r"\d+\.\d+\.\d+\.\d+")
    assert shape(ip.sub("IP", out)) == shape(ip.sub("IP", text))
    for gone in ("a.b1@", "4111111111111111", "4111-1111", "017) 555", "2024-02-29", "29.02.2024", "10.0.0.1", "123-45-6789"):
        assert gone not in out
    for kept in ("4111111111111112", "2023-02-29", "999.1.1.1", "000-12-1234", "v4.0. $1 \\ end", "@mail7.example.com"):
        assert kept in out
    cards = re.findall(r"\d{16}|\d{4}-\d{4}-\d{4}-\d{4}", out)
    assert luhn(cards[0]) and cards[1].replace("-", "") == cards[0] == got[5].text
    iso, german = re.search(r"\d{4}-\d\d-\d\d", out)[0], re.search(r"\d\d\.\d\d\.\d{4}", out)[0]
    assert datetime.date.fromisoformat(iso).strftime("%d.%m.%Y") == german
    assert (got[1].n_card, got[1].n_date, got[1].n_ssn, got[1].n_ip, got[1].n_phone, got[1].n_email) == (2, 2, 1, 1, 1, 1)
    assert got[2].text is None and got[3].text == "" and got[4].text == "no data" and got[6].text == LONG
    assert pii.pseudonymised(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F

    df = spark.range(189 * 773).select(pii._feistel("k", "date", F.floor(F.col("id") / 773), F.col("id") % 773, F.lit(189), F.lit(773)).alias("s"))
    row = df.select((F.col("s.x") * 773 + F.col("s.y")).alias("v")).agg(F.countDistinct("v"), F.min("v"), F.max("v")).first()
    assert tuple(row) == (146097, 0, 146096)


def test_other_keys_give_other_pseudonyms(spark):
    df = spark.createDataFrame([(1, "4111111111111111 9@x.org")], "doc_id long, text string")
    assert pii.pseudonymised(df, "a").first().text != pii.pseudonymised(df, "b").first().text


# Licenses


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"]
    edited = mit.replace("hereby ", "").replace("without restriction", "without any big restriction").upper()
    rows = [(1, "x y z " * 30 + mit + " tail"), (2, None), (3, ""), (4, edited), (5, "Licensed under the Apache License, Version 2.0. And released under the MIT License."), (6, " ".join(mit.split()[:20])), (7, LONG)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.license, r.coverage, r.word_start, r.word_end) for r in licenses.scanned(docs).collect())
    n = len(licenses.words(mit))
    assert got[0] == (1, "MIT", 1.0, 90, 90 + n)
    assert got[1][:2] == (4, "MIT") and got[1][2] > 0.95
    assert [g[:3] for g in got[2:]] == [(5, "Apache-2.0-reference", 1.0), (5, "MIT-reference", 1.0)]
    assert licenses.scanned(docs.limit(0)).count() == 0


def test_every_template_is_found_anywhere():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    rng = np.random.default_rng(1)
    vocabulary = list(scanner.number)
    for name, t in licenses.TEMPLATES.items():
        noise = lambda: b" ".join(rng.choice(vocabulary, 40)).decode()
        assert any(m[0] == name and m[1] == 1 for m in scanner.scan(f"{noise()} {t} {noise()}")), name


# Language


def test_langid(spark):
    rng = np.random.default_rng(2)
    syllables = {"en": ["the", "ing", "tion", "and"], "de": ["der", "ung", "sch", "und"], "fr": ["les", "eau", "que", "ment"]}
    text = lambda l, n=60: " ".join("".join(rng.choice(syllables[l], 2)) for _ in range(n))
    docs = spark.createDataFrame([(i, text(l), l) for i, l in enumerate(list(syllables) * 10)] + [(99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string")
    pages = [(i, f"http://h{i % 3}.example.com/p", f"<html lang='{l}'><p>{text(l)}</p></html>") for i, l in enumerate(list(syllables) * 5)]
    pages += [(100, "http://only.example.de/x", "<p></p>"), (101, None, None), (102, "bad", ""), (103, "http://fr1.example.org", f"<html lang=de>{text('fr')}"), (103, "http://fr1.example.org", f"<html lang=de>{text('fr')}")]
    got = {r.page_id: r for r in langid.identified(spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, lang string"), docs).collect()}
    assert all(got[i].lang == l for i, l in enumerate(list(syllables) * 5))
    assert got[100].lang == "de" and got[103].lang == "fr" and got[103].declared == "de"
    assert 0 < got[101].posterior <= 1 and got[101].n_trigrams == 0
    none = langid.identified(spark.createDataFrame(pages, "page_id long, url string, html string"), docs.limit(0)).collect()
    assert len(none) == len(pages) and all(r.lang is None for r in none)
    assert langid.identified(spark.createDataFrame([], "page_id long, url string, html string"), docs).count() == 0


def test_address():
    assert langid.address("https://u@www.a.co.uk:80/x") == ("www.a.co.uk", "a.co.uk", "en")
    assert langid.address("http://a.b.example.com/fr-CA/q") == ("a.b.example.com", "example.com", "fr")
    assert langid.address(None) == langid.address("x") == ("", "", None)


# Quality classifier


def test_quality_network(spark):
    rng = np.random.default_rng(3)
    good = lambda: " ".join("".join(rng.choice(["the", "in", "re", "on", "st"], 2)) for _ in range(60)) + "."
    bad = lambda: " ".join("".join(rng.choice(["QX", "ZK", "JW"], 2)) + "!!" for _ in range(60))
    rows = [(i, bad() if i % 4 == 0 else good(), 0 if i % 4 == 0 else 1) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(900, None, "s"), (901, "", "s"), (902, LONG, "s"), (None, "the", "s")], "doc_id long, text string, predicted string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(0, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_net.fit(docs, labels)
    got = {r.doc_id: r for r in quality_net.scored(docs, model).collect()}
    held = [i for i, _, _ in rows if got[i].held_out]
    assert 50 < len(held) < 120 and all(got[i].predicted == q for i, _, q in rows)
    assert all(0 <= r.score <= 1 for r in got.values())
    again = {r.doc_id: r.score for r in quality_net.scored(docs.repartition(7), quality_net.fit(docs.repartition(5), labels)).collect()}
    assert all(abs(again[d] - r.score) < 1e-9 for d, r in got.items())
    assert quality_net.scored(docs, quality_net.fit(docs, labels.limit(0))).first().score == 0.5
    assert quality_net.scored(docs.limit(0), model).count() == 0
