"""Source divergence audit: how the word shares of the sources of a language part from one another, and by which terms.

Terms are counted where the texts are; what is shuffled is one row for each term and source of a task. Each term then becomes one row with an array
over the sources of its language, and array functions turn that row into its contributions to every pair of sources.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small, stored

#: Documents of a language that a kept term occurs in, and terms that are named for each source.
LEAST_DOCS = 10
TOP_TERMS = 10
#: Shares are whole numbers of this unit.
SCALE = 1_000_000_000
#: A task hands its counts on when it holds so many, and takes texts apart in pieces of about so many bytes.
_HELD = 200_000
_PIECE = 1 << 20

#: A-Z in lower case; ASCII characters that are no letters become separators; every byte of a character beyond ASCII is part of a term.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _pieces(text: bytes):
    """The text in pieces that end between terms."""
    at = 0
    while len(text) - at > _PIECE:
        end = text.find(b" ", at + _PIECE)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def _counted(batches):
    """(lang, source, term, n, docs) of each batch of (lang, source, text); a row without a term for every source seen."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def rows():
        lang, source, term, n, docs = [], [], [], [], []
        for (one, two), (count, seen) in groups.items():
            lang += [one] * (len(count) + 1)
            source += [two] * (len(count) + 1)
            term += [b"", *count]
            n += [0, *count.values()]
            docs += [0, *(seen[t] for t in count)]
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            count, seen = groups.setdefault((lang, source), (Counter(), Counter()))
            before, own = len(count), set()
            for piece in _pieces(text.translate(_FOLD)):
                terms = piece.split()
                count.update(terms)
                own.update(terms)
            seen.update(own)
            held += len(count) - before
            if held > _HELD:
                yield rows()
                groups, held = {}, 0
    if groups:
        yield rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term; one row with term '' for every (lang, source)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    parts = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text")).mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    return parts.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), by long division in steps of three digits, so that no product leaves 64 bits."""
    rest, base = count + 2, total + terms * 2
    out = F.lit(1).cast("long")
    for unit in (1_000_000, 1_000, 1):
        out = out + _div(rest * 1_000, base) * unit
        rest = (rest * 1_000) % base
    return out


def _part(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def wide_terms(counts: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """(terms, langs): a row for each kept term with the shares p of the sources, by their number, and q of the language; and a row for
    each language with its sources in order. counts: as term_counts gives them."""
    sources = stored(counts.where("term = ''").select("lang", "source", F.row_number().over(W.partitionBy("lang").orderBy("source")).cast("int").alias("at")), "sources")
    n_sources = sources.count()
    cells = counts.where("term != ''").join(small(sources, n_sources), ["lang", "source"])
    # a term has one cell for each source of its language at most
    kept = cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("cells")).where(F.col("docs") >= least_docs)
    kept = stored(kept.select("lang", "term", "n", "cells"), "wide-terms")
    totals = kept.select("lang", F.explode("cells").alias("at", "n")).groupBy("lang", "at").agg(F.sum("n").alias("total"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("whole"))
    none = F.lit(0).cast("long")
    named = sources.join(totals, ["lang", "at"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "source", F.coalesce("total", none).alias("total")))).alias("sources"))
    langs = stored(named.join(terms, "lang", "left").select("lang", "sources", F.coalesce("terms", none).alias("terms"), F.coalesce("whole", none).alias("whole")), "langs")
    each = kept.join(small(langs, n_sources), "lang")
    p = F.transform("sources", lambda s: _share(F.coalesce(F.try_element_at("cells", s["at"]), none), s["total"], F.col("terms")))
    return each.select("lang", "term", "cells", "sources", p.alias("p"), _share(F.col("n"), F.col("whole"), F.col("terms")).alias("q")), langs


def _ranked(rows: DataFrame) -> DataFrame:
    by = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(by))


def audited(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of each language the divergence from every other source (part 'pair'), and
    the terms by which it stands out most from the language (part 'term').

    Shares and divergences are whole numbers, so sums do not depend on any order. Null lang, source and text are ''; a source without terms
    has count 0 of each kept term; a language without kept terms gives pairs of value 0 and no terms; one source alone gives no pairs.
    Repeated rows count as often as they occur; values that tie go by item. An empty table gives none. Other columns are not looked at. The work on
    pairs is terms x sources^2 / 2 for each language and stays in tasks, one row of an array of sources at a time.
    """
    wide, langs = wide_terms(stored(term_counts(docs), "term-counts"), least_docs)
    one = wide.select("lang", "p", F.posexplode("p").alias("i", "own"))
    contributions = F.transform(F.slice("p", F.col("i") + 2, F.size("p")), lambda q, j: F.struct((F.col("i") + 1 + j).alias("j"), _part(F.col("own"), q).alias("f")))
    sums = one.select("lang", "i", F.inline(contributions)).groupBy("lang", "i", "j").agg(F.sum("f").alias("value"))
    first = langs.select("lang", "sources", F.posexplode("sources").alias("i", "a"))
    pairs = first.select("lang", "i", "a", F.posexplode("sources").alias("j", "b")).where("i != j")
    pairs = pairs.select("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item"), F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    pairs = pairs.join(sums, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    told = wide.select("lang", "term", "q", F.explode(F.filter(F.transform("sources", lambda s, i: F.struct(s["at"].alias("at"), s["source"].alias("source"), F.get("p", i).alias("p"))), lambda s: F.try_element_at("cells", s["at"]).isNotNull() & (s["p"] > F.col("q")))).alias("s"))
    told = told.select("lang", F.col("s.source").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), _part(F.col("s.p"), F.col("q")).alias("value"))
    return _ranked(pairs).unionByName(_ranked(told).where(F.col("rank") <= top))


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
tok AS (SELECT lang, source, r, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM tok GROUP BY ALL HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM tok SEMI JOIN kept USING (lang, term) GROUP BY ALL),
cell AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c FROM grp g JOIN kept k USING (lang) LEFT JOIN cnt USING (lang, source, term)),
share AS (SELECT lang, source, term, c, 1 + (1000000000 * (c + 2)) // (sum(c) OVER (PARTITION BY lang, source) + 2 * v)::HUGEINT AS p FROM cell JOIN v USING (lang)),
whole AS (SELECT lang, term, 1 + (1000000000 * (c + 2)) // (sum(c) OVER (PARTITION BY lang) + 2 * v)::HUGEINT AS q FROM (SELECT lang, term, sum(c)::HUGEINT AS c FROM cnt GROUP BY ALL) JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
told AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM share JOIN whole USING (lang, term) WHERE c > 0 AND p > q),
everything AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', item, value FROM told),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM everything)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
