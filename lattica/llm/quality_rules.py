"""Quality rules: base counts, and the Jensen-Shannon distance of character-class and common-word histograms from those of the language. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, words_of

MIN_WORDS = 10
REPEAT_WINDOW = 5
REPEAT_PERCENT = 20
#: Common words of a language: the most frequent ones in all its documents.
COMMON = 40
#: Fewer words than this are too few to compare histograms.
GUARD = 30
#: A distance may be at most base + allowance / sqrt(number of words): shorter texts stray further by chance.
WORD_LIMIT = (0.17, 2.2)
CHAR_LIMIT = (0.12, 1.2)
#: Character classes; what is in none of them is one more.
CLASSES = {"lower": r"\p{Ll}", "upper": r"\p{Lu}", "digit": r"\p{Nd}", "space": r"\s", "mark": r"""\.,;:!?'"()\-"""}
#: Most languages whose references are broadcast; more are joined by shuffling.
BROADCAST_LANGS = 10_000


def _letters(text):
    """Runs of letters, in lower case; the list may have empty strings at its ends."""
    return F.split(F.lower(text), r"[^\p{L}]+")


def _repeat_words(df: DataFrame, size: int) -> DataFrame:
    """df (with words `w`) and n_repeat_words: words in windows of `size` that occur twice or more."""
    last = F.size("w") - size
    windows = F.transform(F.arrays_zip(*(F.slice("w", k + 1, last + 1) for k in range(size))), lambda x: F.xxhash64(x))
    df = df.withColumn("win", F.when(last > 0, windows))
    has = F.size(F.array_distinct("win")) < F.size("win")
    df = df.withColumn("byhash", F.when(has, F.sort_array(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("byhash", lambda x, j: (x["h"] == F.get("byhash", j - 1)["h"]) | (x["h"] == F.get("byhash", j + 1)["h"]))
    # get() beyond either end is null; null or true is true, anything else keeps the entry out
    df = df.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    new = F.transform("at", lambda p, j: F.least(F.lit(size), F.coalesce(F.get("at", j + 1), p + size) - p))
    return df.withColumn("n_repeat_words", F.coalesce(F.aggregate(new, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))).drop("win", "byhash", "at")


def base_rules(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, further columns) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = _repeat_words(docs.withColumn("w", words_of(F.col("text"))).withColumn("lines", lines), REPEAT_WINDOW)
    n_words = F.size("w").cast("long")
    return (
        df.withColumn("n_words", n_words)
        .withColumn("word_chars", F.length(F.array_join("w", "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT))
        .drop("w", "lines")
    )


def references(docs: DataFrame, common: int = COMMON) -> DataFrame:
    """(lang, common, share): each language's most frequent words over all its documents, ties in word order, and their shares.

    Words are counted before anything is shuffled and the ranking keeps `common` rows a task before it is.
    """
    counted = docs.where("text is not null").select("lang", F.explode(_letters(F.col("text"))).alias("word")).where("word != ''").groupBy("lang", "word").agg(F.count("*").alias("n"))
    counted = cut(counted)
    total = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    top = counted.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= common)
    listed = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("top")).join(total.withColumnRenamed("lang", "__lang"), F.col("lang").eqNullSafe(F.col("__lang"))).drop("__lang")
    return listed.select("lang", F.transform("top", lambda x: x["word"]).alias("common"), F.transform("top", lambda x: x["n"] / F.col("total")).alias("share"))


def _divergence(p, q):
    """Jensen-Shannon distance (base 2) of two arrays of shares, each adding up to 1."""

    def part(a, b):
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def _limit(limit, n):
    return limit[0] + limit[1] / F.sqrt(n)


def judged(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text, lang): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, n_letter_words, js_char, js_word (rounded to 6 places).

    Words are runs of characters but ASCII space and tab to carriage return. base_failed: fewer than 10 words, or more than
    20 % of them in 5-word windows that the text repeats. Others are kept unless a distance from the
    reference of their language is over its limit; texts of fewer than GUARD letter words are not compared.
    A reference is the sum over all documents of the language; a null lang is a language of its own. A null text has no words and
    fails. Repeated rows are judged alike; an empty table gives none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    ref = cut(references(docs))
    ref = F.broadcast(ref) if ref.count() <= BROADCAST_LANGS else ref
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.join(ref.withColumnRenamed("lang", "__lang"), F.col("lang").eqNullSafe(F.col("__lang")), "left").drop("__lang")
    rows = rows.withColumn("letters", F.array_remove(_letters(text), "")).withColumn("listed", F.concat(F.lit(" "), F.array_join("common", " "), F.lit(" ")))
    place = lambda word: F.position(F.concat(F.lit(" "), word, F.lit(" ")), F.col("listed"))
    # a common word is known by its place in the list of them, and numbers are counted faster than words
    rows = rows.withColumn("n_letter_words", F.size("letters").cast("long")).withColumn("hits", F.filter(F.transform("letters", place), lambda p: p > 0)).drop("letters")
    rows = rows.withColumn("found", F.transform("common", lambda c: F.size("hits") - F.size(F.array_remove("hits", place(c))))).drop("hits", "listed", "common")
    rows = rows.withColumn("n_chars", F.length(text).cast("long")).withColumn("left0", text)
    # no two classes have a character in common, so each is looked for in what the others left
    for k, c in enumerate(CLASSES.values()):
        rows = rows.withColumn(f"left{k + 1}", F.regexp_replace(f"left{k}", f"[{c}]+", ""))
    sizes = [(F.length(f"left{k}") - F.length(f"left{k + 1}")).cast("long") for k in range(len(CLASSES))]
    rows = rows.withColumn("classes", F.array(*sizes)).drop(*(f"left{k}" for k in range(len(CLASSES) + 1)))
    rows = cut(base_rules(rows).drop("text"))
    k = len(CLASSES)
    sums = rows.groupBy("lang").agg(F.array(*(F.sum(F.col("classes")[i]) for i in range(k))).alias("all"), F.sum("n_chars").alias("all_chars"))
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_LANGS else sums
    rows = rows.join(sums.withColumnRenamed("lang", "__lang"), F.col("lang").eqNullSafe(F.col("__lang"))).drop("__lang")

    def shares(counts, total):
        known = F.transform(counts, lambda n: n / total)
        return F.concat(known, F.array(1 - F.aggregate(counts, F.lit(0).cast("long"), lambda a, n: a + n) / total))

    def rest(values):
        return F.concat(values, F.array(1 - F.aggregate(values, F.lit(0.0), lambda a, x: a + x)))

    found = F.transform("found", lambda n: n.cast("long"))
    js_word = F.when((F.col("n_letter_words") > 0) & F.col("found").isNotNull(), F.round(_divergence(shares(found, F.col("n_letter_words")), rest(F.col("share"))), 6))
    js_char = F.when(F.col("n_chars") > 0, F.round(_divergence(shares(F.col("classes"), F.col("n_chars")), shares(F.col("all"), F.col("all_chars"))), 6))
    rows = rows.withColumn("js_char", js_char).withColumn("js_word", js_word)
    n = F.greatest(F.col("n_letter_words"), F.lit(1))
    strays = (F.col("n_letter_words") >= GUARD) & ((F.col("js_char") > _limit(CHAR_LIMIT, n)) | (F.col("js_word") > _limit(WORD_LIMIT, n)))
    kept = ~F.col("base_failed") & ~F.coalesce(strays, F.lit(False))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "n_letter_words", "js_char", "js_word")


ORACLE = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, lang FROM documents),
words AS (SELECT r, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM docs),
letters AS (SELECT r, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}]+'), lambda x: x <> '') AS l FROM docs),
counted AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(l) AS word FROM letters JOIN docs USING (r)) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank, sum(n) OVER (PARTITION BY lang) AS total FROM counted),
ref AS (SELECT lang, word, n / total AS q FROM ranked WHERE rank <= {COMMON}),
other AS (SELECT lang, 1 - sum(q) AS q FROM ref GROUP BY lang),
found AS (SELECT r, lang, word, count(*) AS n FROM (SELECT r, lang, unnest(l) AS word FROM letters JOIN docs USING (r)) JOIN ref USING (lang, word) GROUP BY ALL),
size AS (SELECT r, len(l) AS nl FROM letters),
pairs AS (SELECT d.r, coalesce(f.n, 0) / s.nl AS p, ref.q FROM docs d JOIN size s USING (r) JOIN ref ON d.lang IS NOT DISTINCT FROM ref.lang LEFT JOIN found f ON f.r = d.r AND f.word = ref.word WHERE s.nl > 0
  UNION ALL SELECT d.r, 1 - coalesce((SELECT sum(n) FROM found f WHERE f.r = d.r), 0) / s.nl, o.q FROM docs d JOIN size s USING (r) JOIN other o ON d.lang IS NOT DISTINCT FROM o.lang WHERE s.nl > 0),
jsw AS (SELECT r, round(sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)), 6) AS js_word FROM pairs GROUP BY r),
classes AS (SELECT r, lang, length(text) AS nc, [{", ".join(f"length(text) - length(regexp_replace(text, '[{c.replace(chr(39), chr(39) * 2)}]+', '', 'g'))" for c in CLASSES.values())}] AS c FROM docs),
sums AS (SELECT lang, sum(nc) AS nc, [{", ".join(f"sum(c[{i + 1}])" for i in range(len(CLASSES)))}] AS c FROM classes GROUP BY lang),
cp AS (SELECT a.r, unnest(list_append(list_transform(a.c, lambda x: x / a.nc), 1 - list_sum(a.c) / a.nc)) AS p, unnest(list_append(list_transform(s.c, lambda x: x / s.nc), 1 - list_sum(s.c) / s.nc)) AS q FROM classes a JOIN sums s ON a.lang IS NOT DISTINCT FROM s.lang WHERE a.nc > 0),
jsc AS (SELECT r, round(sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)), 6) AS js_char FROM cp GROUP BY r),
win AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM words WHERE len(w) >= 5),
wins AS (SELECT r, i, w[i : i + 4] AS v FROM win),
reps AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, v) AS c FROM wins) WHERE c > 1),
cover AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM reps, (SELECT unnest(range(0, 5)) AS k) GROUP BY r),
lines AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM docs),
base AS (SELECT d.r, doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, nl AS n_letter_words, js_char, js_word
  FROM docs d JOIN words USING (r) JOIN lines USING (r) JOIN size USING (r) LEFT JOIN cover USING (r) LEFT JOIN jsc USING (r) LEFT JOIN jsw USING (r)),
judged AS (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {REPEAT_PERCENT} AS base_failed,
  n_letter_words >= {GUARD} AND (coalesce(js_char, 0) > {CHAR_LIMIT[0]} + {CHAR_LIMIT[1]} / sqrt(greatest(n_letter_words, 1)) OR coalesce(js_word, 0) > {WORD_LIMIT[0]} + {WORD_LIMIT[1]} / sqrt(greatest(n_letter_words, 1))) AS strays FROM base)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT strays AS kept, n_letter_words::BIGINT AS n_letter_words, js_char, js_word FROM judged
"""
