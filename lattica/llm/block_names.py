"""Exact deduplication by deterministic block naming. DataFrame functions only.

Texts are cut into blocks of a fixed size. The distinct blocks are sorted and their ranks are their names; then adjacent pairs of names are sorted and
named in the same way, again and again, until a document is one name. Two documents of the same number of blocks get one name if and only
if their texts are equal, so a (level, name) is an identity without collisions. A document that has a name which occurs once
in the whole corpus equals no other, and needs no further levels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small, stored

#: Bytes of a block.
BLOCK = 4096
SPACE = " \t\n\x0b\f\r"


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null is empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def sort_key(block: Column, attempt: int) -> tuple[Column, Column]:
    """What blocks are sorted by: 128 bits of them, other ones at each attempt. The seeds come first, else equal hashes would stay equal."""
    return F.xxhash64(F.lit(2 * attempt), block), F.xxhash64(F.lit(2 * attempt + 1), block)


def _blocks(data: Column, size: int) -> Column:
    """The bytes in pieces of `size`; one empty piece of an empty text."""
    last = F.greatest(F.floor((F.octet_length(data) - 1) / size), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def _named(keys: DataFrame) -> DataFrame:
    """keys (a, b, n), each once, with `name`: their rank from 1 in the order of (a, b), whatever the partitions."""
    placed = stored(keys.orderBy("a", "b").withColumn("id", F.monotonically_increasing_id()), "names")
    part = F.shiftrightunsigned("id", 33)
    sizes = placed.groupBy(part.alias("part")).count()
    # one row for each partition
    before = sizes.select("part", (F.sum("count").over(W.orderBy("part")) - F.col("count")).alias("before"))
    return placed.withColumn("part", part).join(F.broadcast(before), "part").select("a", "b", "n", (F.col("id").bitwiseAND((1 << 33) - 1) + F.col("before") + 1).alias("name"))


def _injective(rows: DataFrame, key: Callable, most: int) -> tuple[DataFrame, DataFrame]:
    """(rows, keys): rows with `keys`, the sort keys of their blocks, and each distinct key (a, b) with its occurrences n.

    Every key is held against the blocks that have it. Should two blocks share one, other bits are taken, so what is returned tells all
    blocks of the corpus apart.
    """
    for attempt in range(most):
        if attempt:
            rows = rows.withColumn("keys", _keys(F.col("blocks"), key, attempt))
        each = rows.select(F.explode(F.arrays_zip("keys", "blocks")).alias("k")).select("k.keys.a", "k.keys.b", "k.blocks")
        met = each.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("blocks").alias("low"), F.max("blocks").alias("high"))
        met = stored(met.select("a", "b", "n", (F.col("low") != F.col("high")).alias("clash")), "block-keys")
        if not met.where("clash").limit(1).count():
            return rows, met.select("a", "b", "n")
    raise ValueError(f"no sort key of {most} tells all blocks apart")


def _keys(blocks: Column, key: Callable, attempt: int) -> Column:
    def both(block):
        a, b = key(block, attempt)
        return F.struct(a.alias("a"), b.alias("b"))

    return F.transform(blocks, both)


def identities(docs: DataFrame, size: int = BLOCK, key: Callable = sort_key, attempts: int = 8) -> tuple[DataFrame, DataFrame]:
    """(rows, ids): the rows of docs (row, doc_id, points, text_sha256), numbered, and for each row its identity (level, name)."""
    text = normalised(F.col("text"))
    rows = docs.select(F.col("doc_id"), F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).alias("points"), text.alias("norm"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "points", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), _blocks(F.col("norm").cast("binary"), size).alias("blocks"))
    rows = stored(rows.withColumn("keys", _keys(F.col("blocks"), key, 0)), "blocks", compression="zstd")
    rows, met = _injective(rows, key, attempts)
    pairs, found, level = rows.select("row", F.posexplode("keys").alias("at", "k")).select("row", "at", "k.a", "k.b"), None, 0
    while True:
        names = _named(met)
        placed = pairs.join(small(names, names.count()), ["a", "b"])
        # as many names as a text has blocks
        now = placed.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("names"), F.min(F.struct("n", "name")).alias("least"))
        now = stored(now, "levels")
        settled = (F.size("names") == 1) | (F.col("least.n") == 1)
        done = now.where(settled).select("row", F.lit(level).alias("level"), F.col("least.name").alias("name"))
        found = done if found is None else found.unionByName(done)
        rest = now.where(~settled)
        if not rest.limit(1).count():
            return rows.select("row", "doc_id", "points", "text_sha256"), found
        last = F.floor((F.size("names") - 1) / 2).cast("int")
        # 0 is no name: it stands beside the last name of an odd number
        couple = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.get("names", i * 2).alias("a"), F.coalesce(F.get("names", i * 2 + 1), F.lit(0).cast("long")).alias("b")))
        pairs = rest.select("row", F.posexplode(couple).alias("at", "k")).select("row", "at", "k.a", "k.b")
        met = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
        level += 1


def deduplicated(docs: DataFrame, size: int = BLOCK, key: Callable = sort_key) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row; of rows whose texts are equal without ASCII white space one is kept.

    That is the row of the longest original text (in code points), then of the least doc_id; a null doc_id comes last. A null text is an
    empty one, and empty texts are equal. Of rows that repeat in full one is kept. Other columns are not looked at; an
    empty table gives none. Texts are compared byte by byte: sort keys of blocks are held against the blocks themselves.
    """
    rows, ids = identities(docs, size, key)
    named = rows.join(ids, "row")
    groups = named.groupBy("level", "name").agg(F.count("*").alias("group_size"), F.min(F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best"))
    groups = stored(groups.where("group_size > 1"), "groups")
    full = named.join(small(groups, groups.count()), ["level", "name"], "left")
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id"))
    return full.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("best.row") == F.col("row"))).alias("kept"), "text_sha256")


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
r AS (SELECT doc_id, t, row_number() OVER w AS k, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d
  WINDOW w AS (PARTITION BY t ORDER BY points DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(t) AS text_sha256 FROM r
"""
