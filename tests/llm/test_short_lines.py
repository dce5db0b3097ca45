import numpy as np
from test_text_operators import brute_lines

from lattica.llm import line_dedup


def test_similar_lines_of_few_shingles_are_linked(spark):
    """11 and 12 characters have 4 and 5 shingles, 4 in common: a similarity of exactly 0.8."""
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("bcdefghjklmnpqrstuvwxyz"), n))
    docs = []
    for k in range(300):
        line = word(12)
        docs += [(2 * k, line), (2 * k + 1, line[:-1] if k % 2 else line[1:])]
    docs += [(1000 + k, word(int(rng.integers(6, 24)))) for k in range(100)]
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_lines(docs)
    assert all(got[2 * k + 1] == "" for k in range(300))


def test_lines_of_few_shingles_at_other_similarities(spark):
    rng = np.random.default_rng(9)
    docs = []
    for k in range(150):
        line = "".join(rng.choice(list("bcdefghjklmnpqrstuvwxyz"), int(rng.integers(9, 19))))
        docs += [(2 * k, line), (2 * k + 1, line[int(rng.integers(0, 4)) : len(line) - int(rng.integers(0, 3))])]
    for similarity in (0.6, 0.7, 0.9):
        got = {r.doc_id: r.text for r in line_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string"), similarity=similarity).collect()}
        assert got == brute_lines(docs, sim=similarity)


def test_how_few_are_few():
    assert line_dedup._few(0.8, 16, 3) == 5 and line_dedup._few(0.6, 16, 3) == 15 and line_dedup._few(0.9, 16, 3) == 2
