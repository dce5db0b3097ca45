import numpy as np
from pyspark.sql import functions as F
from test_text_operators import brute_lines

from lattica.llm import line_dedup


def test_characters_beyond_16_bits_are_whole(spark):
    """Half a character begins no shingle: 12 characters have 5 shingles and 4 in common with the last 11."""
    rng = np.random.default_rng(10)
    docs = []
    for k in range(60):
        line = "".join(rng.choice(list("bcdefghjklmnpqrstuvwxyz"), 11))
        docs += [(2 * k, "\U0001f600" + line), (2 * k + 1, line)]
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_lines(docs)
    assert all(got[2 * k + 1] == "" for k in range(60))


def test_sizes_of_sets_of_shingles(spark):
    lines = ["", "abc", "abcdefg", "abcdefgh", "abcdefghi", "a" * 30, "\U0001f600ab\U0001f600cde\xe9fgh\xefж", "ab\U0001f600" * 5, "жук" * 6, "x y\x00z abcdefgh"]
    df = line_dedup._sketched(spark.createDataFrame([(line,) for line in lines], "line string"), 8, 24)
    rows = df.select("line", F.size(line_dedup._grams(F.col("line"), 8)).alias("n"), F.size("least").alias("sketched")).collect()
    assert {r.line: r.n for r in rows} == {line: len({line[i : i + 8] for i in range(len(line) - 7)}) for line in lines}
    assert all(r.sketched == r.n for r in rows)
