"""Columns of the user's whose names clash with those that operators use, ids of other types, and recall of the line sketches."""

import numpy as np
from test_text_operators import brute_lines

from lattica.llm import decontam, line_dedup, pii, token_files

NAMES = ["a.b", "__text", "__n_words", "__spans", "__row", "__drop", "__found", "__new", "row", "doc", "drop", "found", "made", "items", "key"]
EXTRA = ", ".join(f"`{c}` string" for c in NAMES)


def odd(spark, texts):
    return spark.createDataFrame([(i, t, *(f"{c}{i}" for c in NAMES)) for i, t in enumerate(texts)], f"doc_id long, text string, {EXTRA}")


def same_columns(rows, kept):
    return all(r[c] == f"{c}{r.doc_id}" for r in rows for c in NAMES) and {r.doc_id for r in rows} == kept


def test_clashing_names_pass_through(spark):
    docs = odd(spark, ["one line of text here\nanother line", "one line of text here", None, "", "mail joe@example.org now"])
    bench = spark.createDataFrame([("x1", "another line"), (None, "nothing of it")], "item_id string, text string")
    clean = decontam.clean(docs, bench)
    assert clean.columns == docs.columns and same_columns(clean.collect(), {1, 2, 3, 4})
    lines = line_dedup.deduplicated(docs)
    assert lines.columns == [*docs.columns, "n_dropped"]
    rows = lines.collect()
    assert same_columns(rows, {0, 1, 2, 3, 4}) and {r.doc_id: r.n_dropped for r in rows} == {0: 0, 1: 1, 2: 0, 3: 0, 4: 0}
    hidden = pii.pseudonymised(docs).collect()
    assert same_columns(hidden, {0, 1, 2, 3, 4}) and {r.doc_id: r.n_email for r in hidden}[4] == 1


def test_item_ids_of_any_type(spark):
    docs = spark.createDataFrame([(1, "p q r"), (2, "s t"), (3, "u")], "doc_id long, text string")
    bench = spark.createDataFrame([("b10", "p q r"), ("b9", "q"), (None, "s t")], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256) for r in decontam.contaminated(docs, bench).collect()}
    assert got == {1: (3, 2, decontam.digest(["b10", "b9"])), 2: (2, 0, decontam.digest([])), 3: (0, 0, decontam.digest([]))}


def test_recall_of_the_bands(spark):
    """Pairs of lines a little over the limit, in several lengths and two scripts: at least 97 of 100 share a band."""
    rng = np.random.default_rng(11)
    for letters in ("abcdefghijklmnoprstuvwyz     ", "абвгдежзиклмнопрстуфхця     "):
        rows, n = [], 0
        for length in (40, 90, 200, 400, 900):
            for _ in range(120):
                line = rng.choice(list(letters), length)
                other = line.copy()
                # each changed character takes up to 8 shingles of either line away
                for at in rng.choice(length, max(1, length // 75), replace=False):
                    other[at] = "q"
                one, two = ({"".join(x[i : i + 8]) for i in range(length - 7)} for x in (line, other))
                if len(one & two) >= 0.8 * len(one | two):
                    rows += [(2 * n, "".join(line)), (2 * n + 1, "".join(other))]
                    n += 1
        df = spark.createDataFrame(rows, "id long, line string")
        found = line_dedup._sketched(df, line_dedup.SHINGLE, line_dedup.SKETCH)
        bands = {r[0]: set(r[1]) for r in found.select("id", line_dedup._bands(found["least"], line_dedup.SKETCH, line_dedup.BAND, 0.8)).collect()}
        recall = sum(bool(bands[2 * k] & bands[2 * k + 1]) for k in range(n)) / n
        print(f"recall of the bands: {recall:.4f} of {n} pairs")
        assert n > 200 and recall >= 0.97


def test_sketches_in_common():
    assert line_dedup._needed(0.8, 24) == 11 and line_dedup._needed(1.0, 24) == 24


def test_large_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PIECE", 3)
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    shared = " ".join(word() for _ in range(14))
    docs = [(i, f"{shared} {' '.join(word() for _ in range(int(rng.integers(1, 7))))}") for i in range(40)]
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_lines(docs)


def test_new_runs_encoded_together_equal_whole_texts():
    path = token_files.default_vocabulary()
    texts = ["İ, a", "abc', x don't 3.14, e.g. x!? Σ, ΑΣ.", "a\x1c, b_, _. ²; ①, ǆ. é́, ﬁ.", "漢字, ...a, (b). c.) d,,,e,.. fͅ", "x.\x85y,\x1fz,", "", "  ", "ª, º. word word, word."]
    for a, b in zip(token_files.Encoder(path, by_run=False)(texts * 2), token_files.Encoder(path)(texts * 2), strict=True):
        assert a.tolist() == b.tolist()


def test_generations_of_the_cache(monkeypatch):
    monkeypatch.setattr(token_files, "_CACHE", 5)
    path = token_files.default_vocabulary()
    one, two = token_files.Encoder(path), token_files.Encoder(path, by_run=False)
    for k in range(12):
        texts = [f"alpha{j} beta gamma, {chr(97 + j)}." for j in range(k % 4, k % 4 + 6)]
        assert [x.tolist() for x in one(texts)] == [x.tolist() for x in two(texts)]
