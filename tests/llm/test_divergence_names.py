"""The source audit and exact deduplication by block names: against DuckDB, against plain Python, and over odd tables."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lattica.llm import block_names as B
from lattica.llm import divergence as D

FIELDS = "doc_id long, text string, lang string, source string"
ODD = [
    (1, "One Two  two_three ÄÖ äö Äö é2é", "en", "a"), (1, "One Two  two_three ÄÖ äö Äö é2é", "en", "a"), (2, None, None, None), (3, "", "", ""), (4, "one\x00one 日本 日本語 😀x", "en", "b"),
    (None, "one two", "en", None), (5, "123 !!", "en", "c"), (6, "x " * 3000 + "tail", "en", "b"), (7, "only", "xx", "solo"), (8, " o n e\ttwo ", "en", "a"), (9, "onetwo", "de", "a"), (10, " one two", "en", "a"),
]


def against(spark, df, ours, sql):
    con = duckdb.connect()
    frame = df.toPandas()
    con.register("documents", frame)
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    cols = sorted(names)
    assert sorted(ours.columns) == cols
    one = Counter(tuple(r[c] for c in cols) for r in ours.collect())
    two = Counter(tuple(r[names.index(c)] for c in cols) for r in want.fetchall())
    assert one == two


def test_audit_equals_sql(spark, monkeypatch):
    monkeypatch.setattr(D, "_PIECE", 50)
    df = spark.createDataFrame(ODD, FIELDS).withColumn("lang", F.col("lang")).withColumn("doc_id", F.coalesce("doc_id", F.lit(99)))
    for least in (1, 2, 10):
        against(spark, df, D.audited(df, least), D.ORACLE.replace(">= 10", f">= {least}"))


def test_counts_in_small_parts(spark, monkeypatch):
    df = spark.createDataFrame(ODD, FIELDS)
    whole = Counter(tuple(r) for r in D.term_counts(df).collect())
    rows = [D._counted(iter(df.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).cast("binary").alias("text")).toArrow().to_batches()))]
    monkeypatch.setattr(D, "_HELD", 2)
    parts = defaultdict(lambda: [0, 0])
    for batch in rows[0]:
        for lang, source, term, n, docs in zip(*(c.to_pylist() for c in batch.columns)):
            parts[lang, source, term.decode()][0] += n
            parts[lang, source, term.decode()][1] += docs
    assert whole == Counter((*k, *v) for k, v in parts.items())
    for (lang, source, term), (n, docs) in parts.items():
        texts = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t, l, s in ODD if ((l or ""), (s or "")) == (lang, source)]
        assert term == "" or (n, docs) == (sum(t.count(term) for t in texts), sum(term in t for t in texts))


def test_shares_of_large_counts(spark):
    n, total, v = 7_123_456_789_012, 9_007_199_254_740, 123_456_789
    got = spark.range(1).select(D._share(F.lit(n), F.lit(total * 1000), F.lit(v))).first()[0]
    assert got == 1 + 10**9 * (n + 2) // (total * 1000 + 2 * v)


def test_audit_of_odd_tables(spark):
    assert D.audited(spark.createDataFrame([], FIELDS)).count() == 0
    extra = spark.createDataFrame([(1, "a b", "en", "s", 1, "x"), (1, "a b", "en", "s", 1, "x"), (2, "b c", "en", "t", 2, "y")], f"{FIELDS}, n int, term string")
    got = {(r.source, r.part, r.item): (r.value, r["rank"]) for r in D.audited(extra, 1).collect()}
    assert got["s", "pair", "t"] == got["t", "pair", "s"] and got["s", "pair", "t"][0] > 0


@pytest.mark.parametrize("size", [1, 2, 7, B.BLOCK])
def test_names_equal_sql(spark, size):
    texts = ["abcabcabc", "abc abc abc", "abcabcabd", "ab", "a\tb", "abcabcab", "", None, " \n", "ab" * 40, "ab" * 40 + " ", "ab" * 39 + "ba", "日本語日本", "日 本語日本", "Ab"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(i, t, "en", "s") for i, t in enumerate(texts[:4])] + [(None, "a b", "en", "s")]
    df = spark.createDataFrame(rows, FIELDS).withColumn("doc_id", F.coalesce("doc_id", F.lit(99)))
    against(spark, df, B.deduplicated(df, size), B.ORACLE)


def test_weak_sort_keys_are_found_out(spark):
    calls = []

    def weak(block, attempt):
        calls.append(attempt)
        return (F.octet_length(block).cast("long"), F.lit(0).cast("long")) if attempt < 2 else B.sort_key(block, attempt)

    df = spark.createDataFrame([(i, f"text {i % 5} {'x' * 20}", "en", "s") for i in range(20)], FIELDS)
    against(spark, df, B.deduplicated(df, 4, weak), B.ORACLE)
    assert max(calls) == 2
    with pytest.raises(ValueError, match="apart"):
        B.identities(df, 4, lambda block, attempt: (F.lit(1), F.lit(1)), 2)


def test_names_are_ranks(spark):
    keys = spark.range(1000).select((F.col("id") % 37).alias("a"), F.col("id").alias("b"), F.lit(1).cast("long").alias("n"))
    got = B._named(keys.repartition(7)).collect()
    assert [r.name for r in sorted(got, key=lambda r: (r.a, r.b))] == list(range(1, 1001))


def test_names_of_odd_tables(spark):
    assert B.deduplicated(spark.createDataFrame([], FIELDS)).count() == 0
    extra = spark.createDataFrame([(1, "a", 5, "n"), (None, "a", 6, "m"), (None, "a", 6, "m")], "doc_id long, text string, row int, name string")
    got = B.deduplicated(extra).collect()
    assert [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in sorted(got, key=lambda r: r.doc_id is None)] == [(1, 1, 3, True), (None, 1, 3, False), (None, 1, 3, False)]
    assert got[0].text_sha256 == hashlib.sha256(b"a").hexdigest()
    deep = spark.createDataFrame([(i, "abcdefgh" * 4000 + " " * (i % 2) + ("z" if i == 3 else "")) for i in range(6)], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in B.deduplicated(deep, 64).collect()}
    assert got == {i: (3, 1) if i == 3 else (1, 5) for i in range(6)}
