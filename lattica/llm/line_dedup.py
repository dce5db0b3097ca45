"""Fuzzy line deduplication: MinHash sketches of character shingles, banding, exact Jaccard, union-find. DataFrame functions only."""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, stored
from .components import connected

#: Characters in a shingle.
SHINGLE = 8
SIMILARITY = 0.8
#: Least hashes that make a line's sketch, consecutive ones of them that make a run, and runs (those of least hash) that are a line's bands.
#: Two lines of similarity 0.8 share a band with probability 0.99 (measured in tests/llm). Lines of so few shingles that two similar
#: ones may have no run in common have single hashes as bands too, enough of them that no such pair is missed.
SKETCH = 24
BAND = 3
BANDS = 8
#: Pairs whose sketches have so little in common that a similar pair would have less with this probability are not compared further.
UNSEEN = 1e-4
#: Rounds in which a bucket's lines are compared with one line of it.
ROUNDS = 2
#: Lines of a bucket that are compared with the bucket in one piece; larger buckets are split.
PIECE = 512
#: Broadcast a lookup table only up to so many rows (tens of MB); beyond that it is shuffled.
BROADCAST_ROWS = 500_000

#: The order of shingles: first by the class of their first letter, then by hash. Long lines are sketched on the shingles of the
#: first class alone, so the others need not be extracted.
_CLASSES = ("a", "io")
_TRIM = " \t\x0b\f\r"


def _place(docs: DataFrame) -> tuple:
    """(doc, row): what tells the rows of docs apart; rows with one doc_id and text are one."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), F.xxhash64("text")


def _trimmed(line):
    # the ends are looked at as bytes: a substring would count the characters of the line
    edge = functools.reduce(operator.or_, (f(line, F.lit(c)) for c in _TRIM for f in (F.startswith, F.endswith)))
    return F.when(edge, F.btrim(line, F.lit(_TRIM))).otherwise(line)


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, row, at, line): each line with a word, folded."""
    doc, row = _place(docs)
    split = docs.select(doc.alias("doc"), row.alias("row"), F.posexplode(F.split(F.lower("text"), "\n")).alias("at", "raw"))
    return split.select("doc", "row", "at", _trimmed(F.col("raw")).alias("line")).where("line != ''")


def _few(similarity: float, sketch: int, band: int) -> int:
    """The most shingles of a line that may share no run with a similar one.

    c common shingles that e others part have a run of `band` unless c <= (band - 1) * (e + 1), and e <= c * (1 / similarity - 1).
    """
    part = 1 - (band - 1) * (1 / similarity - 1)
    return min(sketch - 1, math.floor((band - 1) / part / similarity + 1e-9)) if part > 0 else sketch - 1


def _needed(similarity: float, sketch: int) -> int:
    """The most common hashes that the sketches of a similar pair have but with probability UNSEEN."""
    below, m = 0.0, 0
    while (below := below + math.comb(sketch, m) * similarity**m * (1 - similarity) ** (sketch - m)) <= UNSEEN:
        m += 1
    return m


def _sketched(lines: DataFrame, shingle: int, sketch: int) -> DataFrame:
    """lines with `least`, the first hashes (at most `sketch`) in the order of their shingles."""
    tail = f".{{{shingle - 1}}}"
    # of one first letter only what follows it need be told apart; the last takes in its first character, so that none is halved
    patterns = [f"(?s)(?=([{c}]{tail}))" if len(c) > 1 else f"(?s){c}(?=({tail}))" for c in _CLASSES] + [f"(?s)(?=([^{''.join(_CLASSES)}]{tail}))."]
    out = lines.withColumn("least", F.array().cast("array<int>"))
    for k, pattern in enumerate(patterns):
        more = F.sort_array(F.array_distinct(F.transform(F.regexp_extract_all("line", F.lit(pattern), F.lit(1)), lambda s: F.hash(s))))
        now = F.slice(F.concat("least", more) if k else more, 1, sketch)
        out = out.withColumn("least", F.when(F.size("least") >= sketch, F.col("least")).otherwise(now) if k else now)
    return out


def _bands(least, sketch: int, band: int, similarity: float):
    """Band keys of a sketch: the least of the hashes of its runs of `band` consecutive hashes; for few shingles also so many
    single hashes (n less those that a similar line must have, and 1) that similar lines share one."""
    n = F.size(least)
    runs = F.array(*(F.xxhash64(*(F.get(least, F.lit(i + j)) for j in range(band))) for i in range(max(1, sketch - band + 1))))
    runs = F.slice(F.sort_array(F.slice(runs, 1, F.greatest(n - (band - 1), F.lit(1)))), 1, BANDS)
    single = F.transform(F.slice(least, 1, n - F.ceil(n * similarity - 1e-9).cast("int") + 1), lambda x: F.xxhash64(x, F.lit("single")))
    none = F.array().cast("array<long>")
    return F.when(n == 0, none).when(n <= _few(similarity, sketch, band), F.concat(runs, single)).otherwise(runs)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _shingles(line, shingle: int):
    """The shingles of a line in its order, as hashes; cut from four bytes a character, where each is found at once."""
    starts = lambda wide: F.when(
        F.octet_length(wide) >= 4 * shingle, F.sequence(F.lit(1), F.octet_length(wide) - 4 * shingle + 1, F.lit(4))
    ).otherwise(F.array().cast("array<int>"))
    return F.get(F.transform(F.array(F.encode(line, "UTF-32")), lambda wide: F.transform(starts(wide), lambda at: F.xxhash64(F.substring(wide, at, F.lit(4 * shingle))))), F.lit(0))


def _grams(line, shingle: int):
    """The set of shingles of a line, as hashes."""
    return F.array_distinct(_shingles(line, shingle))


def _jaccard(one, two, similarity: float):
    """Whether the sets of two lists are that similar. Each is computed once for a pair: a filter would compute a column anew wherever it is named.
    Of most pairs the sizes of the lists, repeats included, and of their union tell already that they are not."""
    lists = F.array(F.struct(one.alias("a"), two.alias("b")))
    joint = F.transform(lists, lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), F.size(F.array_union(t["a"], t["b"])).alias("all")))
    alike = lambda n, m, t: (n + m > t["all"]) & (n + m - t["all"] >= t["all"] * similarity)
    sets = lambda t: alike(F.size(F.array_distinct(t["a"])), F.size(F.array_distinct(t["b"])), t)
    return F.exists(joint, lambda t: F.when(alike(F.size(t["a"]), F.size(t["b"]), t), sets(t)).otherwise(False))


def _alike(one, two, similarity: float, sketch: int):
    """Whether two sketches have as much in common as those of similar lines; exact for lines of fewer shingles than a sketch."""
    n, m, common = F.size(one), F.size(two), F.size(F.array_intersect(one, two))
    whole = common >= (n + m - common) * similarity
    return F.when((n < sketch) & (m < sketch), whole).otherwise(common >= _needed(similarity, sketch))


def _similar(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float, sketch: int) -> DataFrame:
    """Those of the pairs (a, b, ra, rb) of line ids and their roots whose sets of shingles have at least this Jaccard similarity."""

    def side(x):
        return texts.select(F.col("id").alias(x), F.col("line").alias(f"l{x}"), F.col("least").alias(f"s{x}"))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(F.when(_alike(F.col("sa"), F.col("sb"), similarity, sketch), _jaccard(_shingles(F.col("la"), shingle), _shingles(F.col("lb"), shingle), similarity)).otherwise(False)).select("ra", "rb")


def _rooted(entries: DataFrame, roots: DataFrame | None) -> DataFrame:
    """entries (key, id) of buckets that still hold lines of several components, with their roots."""
    if roots is None:
        return entries.withColumn("root", F.col("id"))
    named = entries.join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    mixed = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
    return named.join(mixed, "key", "left_semi")


def _paired(rows: DataFrame) -> DataFrame:
    """(a, b, ra, rb) once for each pair, from rows with id, root, id2, root2."""
    up = F.col("id") > F.col("id2")
    pick = lambda x, y: F.when(up, F.col(x)).otherwise(F.col(y))
    return rows.select(pick("id", "id2").alias("a"), pick("id2", "id").alias("b"), pick("root", "root2").alias("ra"), pick("root2", "root").alias("rb")).distinct()


class _Links:
    """Components found so far among lines that meet in buckets. texts: id, line, least."""

    def __init__(self, texts: DataFrame, shingle: int, similarity: float, sketch: int, band: int):
        self.texts, self.shingle, self.similarity, self.sketch, self.band = texts, shingle, similarity, sketch, band
        self.roots = None

    def add(self, pairs: DataFrame) -> None:
        """Joins the components of similar pairs; the union-find runs over components, not lines."""
        self.join(_similar(pairs, self.texts, self.shingle, self.similarity, self.sketch).select(F.col("ra").alias("a"), F.col("rb").alias("b")))

    def join(self, edges: DataFrame) -> None:
        found = connected(edges)
        if self.roots is None:
            self.roots = found
            return
        moved = self.roots.join(found.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left").select("node", F.coalesce("new", "root").alias("root"))
        own = found.join(self.roots.select("node"), "node", "left_anti")
        self.roots = cut(moved.unionByName(own))

    def star(self, entries: DataFrame, seed: int) -> DataFrame:
        """Compares one line of each bucket, its centre, with the bucket's lines of other components; the entries that are left,
        without the centres, all of whose pairs are settled then.

        A large group of near copies becomes one component that way, at a cost in proportion to its size.
        """
        now = cut(_rooted(entries, self.roots))
        centre = now.groupBy("key").agg(F.min_by(F.struct("id", "root"), F.xxhash64("id", F.lit(seed))).alias("c")).select("key", F.col("c.id").alias("id2"), F.col("c.root").alias("root2"))
        self.add(_paired(now.join(centre, "key").where("root != root2")))
        return now.join(centre.select("key", F.col("id2").alias("id")), ["key", "id"], "left_anti").select("key", "id")

    def rest(self, now: DataFrame) -> None:
        """Compares the pairs of different components that share a bucket, each in the first bucket that it shares.

        A first pass compares sketches and keeps the lines that have a likely partner whose first shared bucket this is; the texts of these alone
        are brought together, and pairs are tested inside the join, so only links leave it. A bucket of more than PIECE lines is split: each piece of it meets
        a copy of the whole.
        """
        keys = _bands(F.col("least"), self.sketch, self.band, self.similarity)
        first = F.array_min(F.array_intersect("keys", "keys2")) == F.col("key")
        alike = _alike(F.col("least"), F.col("least2"), self.similarity, self.sketch)
        sketched = now.join(self.texts.select("id", "least", keys.alias("keys")), "id")
        one, two, met = _sides(sketched, "least", "keys")
        likely = cut(one.join(two, met & F.when(alike, first).otherwise(False), "left_semi").select("key", "id", "root"))
        lines = likely.join(self.texts.select("id", "line", "least", keys.alias("keys")), "id")
        one, two, met = _sides(lines, "least", "keys", "line")
        one, two = one.withColumn("grams", _grams(F.col("line"), self.shingle)).drop("line"), two.withColumn("grams2", _grams(F.col("line2"), self.shingle)).drop("line2")
        n, m = F.size("grams"), F.size("grams2")
        sizes = (F.least(n, m) > 0) & (F.least(n, m) >= F.greatest(n, m) * self.similarity)
        likely_pair = (F.col("id") > F.col("id2")) & sizes & F.when(alike, first).otherwise(False)
        found = one.join(two, met & F.when(likely_pair, _jaccard(F.col("grams"), F.col("grams2"), self.similarity)).otherwise(False))
        self.join(found.select(F.col("root").alias("a"), F.col("root2").alias("b")))


def _sides(rows: DataFrame, *columns: str) -> tuple:
    """The two sides of the join of rows (key, id, root, columns) with themselves within their buckets, and its condition."""
    large = cut(rows.groupBy("key").count().where(F.col("count") > PIECE).select("key", F.ceil(F.col("count") / PIECE).cast("int").alias("pieces")))
    rows = rows.join(_small(large, large.count()), "key", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    one = rows.select("key", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("piece"), "id", "root", *columns)
    two = rows.select(F.col("key").alias("key2"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece2"), *(F.col(c).alias(f"{c}2") for c in ("id", "root", *columns)))
    met = (F.col("key") == F.col("key2")) & (F.col("piece") == F.col("piece2")) & (F.col("id") != F.col("id2")) & (F.col("root") != F.col("root2"))
    return one.repartition("key", "piece"), two.repartition("key2", "piece2"), met


def _texts(docs: DataFrame, marks: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, check, line, least) of the asked ids, each from the first of its places."""
    at = marks.join(_small(asked, asked.count()), "id", "left_semi").groupBy("id").agg(F.min(F.struct("doc", "row", "at", "check", "least")).alias("m"))
    places = at.groupBy(F.col("m.doc").alias("doc"), F.col("m.row").alias("row")).agg(F.collect_list(F.struct("id", "m.at", "m.check", "m.least")).alias("places"))  # as many as a text has lines
    places = cut(places)
    doc, row = _place(docs)
    found = docs.select(doc.alias("doc"), row.alias("row"), "text").join(_small(places, places.count()), ["doc", "row"])
    lines = found.select(F.split(F.lower("text"), "\n").alias("lines"), "places").select("lines", F.explode("places").alias("p"))
    lines = lines.select("p.id", "p.check", F.get("lines", F.col("p.at")).alias("raw"), "p.least").select("id", "check", _trimmed(F.col("raw")).alias("line"), "least")
    # rows with one doc_id and text give a line several times
    return lines.dropDuplicates(["id"])


def _linked(entries: DataFrame, texts: DataFrame, shingle: int, similarity: float, sketch: int, band: int) -> DataFrame:
    """Components (node, root) of lines that share a band and are similar.

    Most lines are settled by comparing the lines of each bucket with a few centres, at a cost in proportion to their number; in buckets
    that still hold several components, all pairs of these are compared; of the pairs that share a band only those whose sketches are unlike
    (a similar pair is with probability UNSEEN) go unseen.
    """
    links = _Links(texts, shingle, similarity, sketch, band)
    for k in range(ROUNDS):
        entries = links.star(entries, k)
    links.rest(cut(_rooted(entries, links.roots)))
    return links.roots


def repeats(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, sketch: int = SKETCH, band: int = BAND) -> tuple[DataFrame, int]:
    """(doc, row, drop), rows: for each row of docs that loses lines the numbers (from 0) of those lines, and how many such rows there are."""
    marks = _sketched(_lines(docs), shingle, sketch).select("doc", "row", "at", F.xxhash64("line").alias("id"), F.xxhash64(F.lit(1), "line").alias("check"), "least")
    marks = stored(marks, "lines", **{"parquet.enable.dictionary": "false"})  # hashes seldom repeat
    bands = marks.select("id", F.explode(_bands(F.col("least"), sketch, band, similarity)).alias("key"))
    shared = cut(bands.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo != hi").select("key"))
    entries = cut(bands.join(_small(shared, shared.count()), "key", "left_semi").distinct())
    texts = cut(_texts(docs, marks, cut(entries.select("id").distinct())))
    roots = _linked(entries, texts, shingle, similarity, sketch, band)
    # a line is known by two hashes: by both where it repeats, and by the text that was compared where it is linked
    linked = texts.select("id", "check").join(roots.withColumnRenamed("node", "id"), "id").select("id", "check", "root", F.lit(0).cast("long").alias("mark"))
    again = marks.groupBy("id", "check").count().where("count > 1").select("id", "check")
    again = again.join(linked.select("id", "check"), ["id", "check"], "left_anti").select("id", "check", F.col("id").alias("root"), F.col("check").alias("mark"))
    involved = cut(linked.unionByName(again))
    named = marks.select("doc", "row", "at", "id", "check").join(_small(involved, involved.count()), ["id", "check"]).select("doc", "row", "at", "root", "mark")
    kept = cut(named.groupBy("root", "mark").agg(F.min(F.struct("doc", "row", "at")).alias("kept")))
    dropped = named.join(_small(kept, kept.count()), ["root", "mark"]).where(F.struct("doc", "row", "at") != F.col("kept"))
    # within one row a repeated line is one occurrence only at its own place
    lost = cut(dropped.select("doc", "row", "at").distinct().groupBy("doc", "row").agg(F.collect_list("at").alias("drop")))
    return lost, lost.count()


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, sketch: int = SKETCH, band: int = BAND, count_as: str = "n_dropped") -> DataFrame:
    """docs with `text` without repeated lines, and count_as, the number of lines left out (in the place of any column of that name).

    Lines are compared after trimming and lower-casing. Equal lines, and lines of at least this Jaccard similarity of
    character shingles, are linked; of each component the line with the least (doc_id, hash of the text, place) stays.
    Lines without a word are left as they are. Lines shorter than a shingle are linked only if equal. Rows with one
    doc_id and text lose the same lines. A null text stays null and a null doc_id comes last in the order; an
    empty table gives none; a text whose lines all go becomes empty. Other columns pass through, whatever their names.
    Lines are told apart by 128 bits of hashes, shingles of compared lines by 64. A pair of similarity 0.8 is found
    with probability 0.99, of 0.85 or of few shingles (and more) 0.999: banding and sketches are high-recall, not certain.
    """
    lost, rows = repeats(docs.select("doc_id", "text"), shingle, similarity, sketch, band)
    doc_as, row_as, drop_as = free_name(docs, "doc"), free_name(docs, "row"), free_name(docs, "drop")
    doc, row = _place(docs)
    lost = lost.select(F.col("doc").alias(doc_as), F.col("row").alias(row_as), F.col("drop").alias(drop_as))
    joined = docs.withColumns({doc_as: doc, row_as: row}).join(_small(lost, rows), [doc_as, row_as], "left")
    stay = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(drop_as, i))
    text = F.when(F.col(drop_as).isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))
    return joined.select(*(text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns if c != count_as), F.coalesce(F.size(drop_as), F.lit(0)).cast("long").alias(count_as))
