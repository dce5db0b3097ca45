"""Language ID, packing, pseudonyms and license scans row for row against plain Python; held-out figures of the quality classifier."""

import datetime
import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_odd_columns import NAMES, odd, same_columns

from lattica.llm import langid, licenses, packing, pii, quality_net, simhash
from lattica.llm import queries as Q

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]


# Language


def brute_trigrams(text):
    data = re.sub(r"[\W\d_]+", " ", f" {text or ''} ".lower()).encode("utf-8", "replace")
    return [(((data[i] * 0x9E3779B1 + data[i + 1] * 0x85EBCA6B + data[i + 2] * 0xC2B2AE35) % 2**32) >> 8) % langid.BINS for i in range(len(data) - 2)]


def brute_langid(pages, docs):
    counts = defaultdict(Counter)
    for d in docs:
        if d["lang"] is not None and d["text"] is not None:
            counts[d["lang"]].update(brute_trigrams(d["text"]))
    langs = sorted(counts)
    k = len(langs)
    total = {l: sum(counts[l].values()) + 0.5 * langid.BINS for l in langs}
    held = []
    for p in pages:
        host, domain, suffix = langid.address(p["url"])
        said, text = langid.declared(p["html"]), langid.page_text(p["html"])
        found = brute_trigrams(text) if text else []
        log = []
        by_text = [sum(math.log((counts[l][t] + 0.5) / total[l]) for t in found) / len(found) * min(len(found), langid.EVIDENCE) if found else 0.0 for l in langs]
        for l, e in zip(langs, by_text):
            for word, truth in ((said, langid.DECLARED), (suffix, langid.ADDRESS)):
                if word in langs:
                    e += math.log(truth if word == l else (1 - truth) / (k - 1))
            log.append(e)
        top = max(log)
        share = [math.exp(x - top) for x in log]
        own = [round(x / sum(share) * langid.UNIT) for x in share]
        held.append((p["page_id"], host, domain, log, own, said, suffix, langs[by_text.index(max(by_text))] if found else None, len(found)))
    out = Counter()
    for page, host, domain, log, own, said, suffix, by_text, n in held:
        below = [1 / k] * k
        for level in (lambda h: True, lambda h: h[2] == domain, lambda h: h[1] == host):  # noqa: B023
            rest = [sum(h[4][i] for h in held if level(h)) - own[i] for i in range(k)]
            whole = sum(rest) / langid.UNIT
            below = [(r / langid.UNIT + langid.STRENGTH * b) / (whole + langid.STRENGTH) for r, b in zip(rest, below)]
        post = [e + math.log(b) for e, b in zip(log, below)]
        top = max(post)
        best = post.index(top)
        out[page, host, langs[best], round(1 / sum(math.exp(x - top) for x in post), 5), said, suffix, by_text, round(below[best], 5), n] += 1
    return out


def test_langid_equals_brute_force(spark):
    got = Counter((r.page_id, r.host, r.lang, round(r.posterior, 5), r.declared, r.address_lang, r.text_lang, round(r.host_prior, 5), r.n_trigrams) for r in Q.op1_langid_bayes(spark, SF).collect())
    want = brute_langid(rows(spark, "pages"), rows(spark, "documents"))
    near = lambda c: Counter((*k[:3], round(k[3], 4), *k[4:7], round(k[7], 4), k[8]) for k in c.elements())
    assert near(got) == near(want)


# Packing


def brute_pack(lengths):
    caps, weights = sorted(packing.CAPACITIES), packing.COST
    price = lambda c: weights[0] + weights[1] * c + weights[2] * c * c
    left, bins, where = sum(lengths), [], {}
    for clock, i in enumerate(sorted(range(len(lengths)), key=lambda i: -lengths[i])):
        n = lengths[i]
        left -= n
        fits = [b for b in bins if b["free"] >= n]
        if fits:
            # the tightest; of equally tight ones the one that was touched last
            b = min(fits, key=lambda b: (b["free"], -b["touched"]))
        else:
            cap = min((c for c in caps if c >= n), key=lambda c: (price(c) / (n + min(c - n, left)), c))
            bins.append(b := {"id": len(bins), "free": cap, "used": 0})
        where[i] = (b["id"], b["used"])
        b["used"] += n
        b["free"] -= n
        b["touched"] = clock
    size = {b["id"]: min(c for c in caps if c >= b["used"]) for b in bins}
    return [(*where[i], size[where[i][0]]) for i in range(len(lengths))]


def test_packing_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    for n in (1, 40, 400):
        lengths = np.minimum(rng.lognormal(6, 1.3, n).astype(int) + 1, 8192)
        assert list(zip(*(x.tolist() for x in packing.pack(lengths)))) == brute_pack(lengths.tolist())
    got = Q.op2_best_fit_packing(spark, SF).collect()
    most, pieces = max(packing.CAPACITIES), Counter()
    for d in rows(spark, "documents"):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) + 1
        pieces.update((d["doc_id"], k, k * most, min(most, n - k * most)) for k in range(-(-n // most)))
    assert Counter((r.doc_id, r.piece, r.start, r.n) for r in got) == pieces
    shard = sorted((r for r in got), key=lambda r: (r.doc_id, r.piece))
    assert len({r.shard for r in got}) == 1  # few enough rows for one shard, and no document twice
    assert [(r.bin, r.bin_offset, r.capacity) for r in shard] == brute_pack([r.n for r in shard])


# Pseudonyms


def prf(kind, *parts):
    return int(hashlib.sha256("|".join([pii.KEY, kind, *map(str, parts)]).encode()).hexdigest()[:15], 16)


def feistel(kind, x, y, a, b):
    for i in range(1, pii.ROUNDS + 1):
        x, y, a, b = y, (x + prf(kind, i, a, b, y)) % a, b, a
    return x, y


def unfeistel(kind, x, y, a, b):
    for i in range(pii.ROUNDS, 0, -1):
        # what step i made of (y0, x0): the left side came over, the right side was turned
        x, y, a, b = (y - prf(kind, i, b, a, x)) % b, x, b, a
    return x, y


def digits(kind, d):
    h = len(d) // 2
    x, y = feistel(kind, int(d[:h]), int(d[h:]), 10**h, 10 ** (len(d) - h))
    return f"{x:0{h}d}{y:0{len(d) - h}d}"


def luhn(d, odd):
    return sum(v - 9 if v > 9 else v for i, c in enumerate(reversed(d), 1) for v in [int(c) * (2 if i % 2 == odd else 1)])


def filled(pattern, new):
    new = iter(new)
    return "".join(next(new) if c.isdigit() else c for c in pattern)


def brute_value(m):
    """(kind, pseudonym) of a match; None for a form that this version does not write."""
    if "@" in m:
        local, rest = m.split("@", 1)
        h = -(-len(local) // 2)
        x, y = local[:h], local[h:]
        for i in range(1, 5):
            turned = ""
            for k, c in enumerate(x):
                for low, n in ((97, 26), (65, 26), (48, 10)):
                    if low <= ord(c) < low + n:
                        turned += chr(low + (ord(c) - low + prf("email", i, len(x), k, y)) % n)
                        break
                else:
                    turned += c
            x, y = y, turned
        return "email", f"{x}{y}@{rest}"
    d = re.sub("[^0-9]", "", m)
    if re.fullmatch(pii._PHONE_334, m):
        return "phone", m[: -len(m) + m.find(re.search(r"\(?[0-9]{3}\)?[ .\-]*[0-9]{3}[.\-][0-9]{4}$", m)[0])] + filled(re.search(r"\(?[0-9]{3}\)?[ .\-]*[0-9]{3}[.\-][0-9]{4}$", m)[0], digits("phone", d[-10:]))
    if re.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", m):
        a, g, s = map(int, m.split("-"))
        if not (0 < a < 900 and a != 666 and g and s):
            return "ssn", m
        x, y = feistel("ssn", (a - 1 - (a > 666)) * 99 + g - 1, s - 1, 898 * 99, 9999)
        return "ssn", f"{x // 99 + 1 + (x // 99 >= 665):03d}-{x % 99 + 1:02d}-{y + 1:04d}"
    if re.fullmatch(pii._DATE_PADDED, m):
        form = "%Y-%m-%d" if re.match("[0-9]{4}-", m) else "%Y/%m/%d" if re.match("[0-9]{4}/", m) else "%d.%m.%Y" if "." in m else "%m/%d/%Y"
        try:
            day = datetime.datetime.strptime(m, form).date()
        except ValueError:
            return "date", m
        n = (day - datetime.date(1700, 1, 1)).days
        x, y = feistel("date", n // 773, n % 773, 189, 773)
        new = datetime.date(1700, 1, 1) + datetime.timedelta(x * 773 + y)
        return "date", new.strftime(form)
    if re.fullmatch(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}", m):
        o = list(map(int, m.split(".")))
        x, y = feistel("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return "ip", f"{x >> 8}.{x & 255}.{y >> 8}.{y & 255}"
    if re.fullmatch(r"[0-9]{13,19}|(?:[0-9]{4}[ \-]){3}[0-9]{4}", m):
        if luhn(d, 0) % 10:
            return "card", m
        body = digits("card", d[:-1])
        return "card", filled(m, body + str(-luhn(body, 1) % 10))
    return None


def test_pseudonyms_equal_brute_force(spark):
    made = ["call (212) 555-0123 or 212-555-0124, +1 212.555.0125", "4111 1111 1111 1111 and 4111111111111111, not 4111111111111112", "born 1985-02-28 or 28.02.1985, 02/28/1985, 1985/12/31; not 1985-02-30", "123-45-6789, 666-12-3456, 899-99-9999", "10.0.0.1 to 255.255.255.255", "Jo.Doe+x9@mail.example.org, a@b.co"]
    docs = [(d["doc_id"], d["text"]) for d in rows(spark, "documents")] + [(10**6 + i, t) for i, t in enumerate(made)]
    got = {r.doc_id: r for r in pii.pseudonymised(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    pattern, seen = re.compile(pii._ANY), Counter()
    for doc, text in docs:
        if text is None:
            assert got[doc].text is None
            continue
        found = [(m, brute_value(m[0])) for m in pattern.finditer(text)]
        assert all(v is not None for _, v in found)
        want, at = "", 0
        counts = Counter()
        for m, (kind, value) in found:
            want += text[at : m.start()] + value
            at = m.end()
            counts[kind] += value != m[0]
        assert got[doc].text == want + text[at:]
        seen += counts
        # a value that is its own pseudonym (one in millions) would be counted by the operator alone
        assert all(got[doc][f"n_{k}"] == counts[k] for k in pii.PATTERNS)
    assert set(seen) == set(pii.PATTERNS)
    query = {r.doc_id: r.text for r in Q.op3_pii_feistel(spark, SF).collect()}
    assert all(query[d] == got[d].text for d, _ in docs if d < 10**6)


def test_the_key_goes_back():
    for x, y, a, b in ((5, 17, 100, 1000), (0, 0, 7, 3), (999, 65535, 1000, 65536)):
        assert unfeistel("ip", *feistel("ip", x, y, a, b), a, b) == (x, y)


# Licenses


def brute_alignment(template, text):
    """(matched words, first, end) of the best local alignment of all of them, without bands."""
    best = [(0.0, 0, -1, -1)] * (len(text) + 1)
    top = (0.0, 0, -1, -1)
    for t in template:
        new = [(0.0, 0, -1, -1)]
        for j, w in enumerate(text):
            s, n, f, e = best[j]
            here = (s + 1, n + 1, j if f < 0 else f, j + 1) if w == t else (s - 0.25, n, f, e)
            for other in (best[j + 1], new[j]):
                if other[0] - 0.25 > here[0]:
                    here = (other[0] - 0.25, *other[1:])
            new.append(here if here[0] >= 0 else (0.0, 0, -1, -1))
            top = max(top, new[-1], key=lambda x: x[0])
        best = new
    return top[1:]


def test_licenses_equal_brute_force(spark):
    rng = np.random.default_rng(12)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 400, n)]
    templates = {name: " ".join(f"{name}{i % 37}x{i}" if i % 3 else f"the{i}" for i in range(n)) for name, n in (("a", 30), ("b", 45), ("c", 60))}
    docs = []
    for k in range(24):
        name = "abc"[k % 3]
        body = templates[name].split()
        for at in sorted(rng.choice(len(body), k % 6, replace=False), reverse=True):
            body[at : at + 1] = [[], ["new"], [body[at], "more"]][int(rng.integers(0, 3))]
        docs.append((k, " ".join(word(int(rng.integers(0, 60))) + body + word(int(rng.integers(0, 60))))))
    docs += [(100, " ".join(word(80))), (101, None), (102, ""), (103, " ".join(templates["a"].split()[:20]))]
    got = {(r.doc_id, r.license, r.coverage, r.word_start, r.word_end, r.n_matched) for r in licenses.scanned(spark.createDataFrame(docs, "doc_id long, text string"), templates).collect()}
    want = set()
    for doc, text in docs:
        have = [w.lower() for w in re.findall("[A-Za-z0-9]+", text or "")]
        for name, template in templates.items():
            wanted = template.split()
            n, first, end = brute_alignment(wanted, have)
            if n / len(wanted) >= licenses.COVERAGE:
                want.add((doc, name, round(n / len(wanted), 4), first, end, n))
    assert got == want and len(want) > 20


# Quality


def test_quality_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.score, r.predicted, truth[r.doc_id]) for r in Q.op10_quality_random_index(spark, sf).collect() if r.held_out and r.doc_id in truth]
    good, bad = [s for s, _, t in held if t == 1], [s for s, _, t in held if t == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    accuracy = np.mean([p == t for _, p, t in held])
    print(f"{len(held)} held-out rows: AUC {auc:.4f}, accuracy {accuracy:.4f}")
    assert auc >= 0.98 and accuracy >= 0.93


# Columns and rows


def test_classifier_takes_columns_of_any_name(spark):
    docs = odd(spark, ["one line of text here", "one line of text here", None, ""])
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_net.fit(docs, labels)
    kept = quality_net.accepted(docs, model, 0.0)
    assert kept.columns == docs.columns and same_columns(kept.collect(), {0, 1, 2, 3})
    for name in ("__score", "__predicted", "score", "row"):
        extra = docs.withColumnRenamed("items", name) if name not in NAMES else docs
        assert quality_net.accepted(extra, model, 0.0).count() == 4 and quality_net.accepted(extra, model, 1.1).count() == 0
    assert quality_net.scored(docs, model).columns == ["doc_id", "held_out", "score", "predicted"]


def test_rows_are_told_apart_by_128_bits(spark):
    keys = [r[0] for r in spark.createDataFrame([(1, "a"), (1, "b"), (None, "a"), (1, None)], "doc_id long, text string").select(simhash.row_key()).collect()]
    assert len(set(keys)) == 4 and all(a != b for a, b in (k.split("-") for k in keys))


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_columns_of_any_name(spark, stage):
    import corpus_pipeline

    docs = odd(spark, ["first line of some words\nsecond line of other words", None, "", "third text of its own that nothing else is like", "word " * 3000]).selectExpr("*", "'en' as lang", "'s' as source", "length(text) as n_chars")
    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, docs, SF)
    if name != "pack":
        assert out.columns == docs.columns
        assert same_columns(out.collect(), {r.doc_id for r in out.collect()})
    assert out.count() > 0 or name == "classify"
