"""Benchmark decontamination: Wu-Manber search for windows of benchmark words in documents."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import stored

WINDOW = 10
#: Bytes of benchmark text in one block of patterns; the blocks of a larger benchmark are searched in turn.
BLOCK_BYTES = 8 << 20

_KEEP = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))
#: A-Z to a-z; every other ASCII character that is in no word to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c in _KEEP else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class WuManber:
    """Patterns of one length over word numbers.

    The table of shifts is keyed by blocks of two words (one, for patterns of one word): how far the
    search may move on when it sees a block as the end of a place. Blocks that end a pattern have shift
    0; their bucket lists the patterns with that ending, told apart by their first word before
    the whole is compared. A block in no pattern allows the longest shift.
    """

    def __init__(self, patterns: dict[tuple[int, ...], list[int]]):
        self.length = m = len(next(iter(patterns)))
        self.block = b = min(2, m)
        self.far = m - b + 1
        self.shift: dict = {}
        self.bucket: dict = defaultdict(list)
        for p, items in patterns.items():
            for j in range(b, m + 1):
                key = p[j - 2 : j] if b == 2 else p[j - 1]
                self.shift[key] = min(self.shift.get(key, self.far), m - j)
            self.bucket[p[m - 2 :] if b == 2 else p[m - 1]].append((p[0], p, items))

    def search(self, text: list[int]):
        """(place, items) of each occurrence, by place."""
        m, far, shift, bucket, pair, at = self.length, self.far, self.shift.get, self.bucket, self.block == 2, self.length
        n = len(text)
        while at <= n:
            key = (text[at - 2], text[at - 1]) if pair else text[at - 1]
            move = shift(key, far)
            if move:
                at += move
                continue
            start = at - m
            first, whole = text[start], None
            for head, p, items in bucket[key]:
                if head == first:
                    whole = whole or tuple(text[start:at])
                    if whole == p:
                        yield start, items
            at += 1


class Matcher:
    """All windows of a block of items, a searcher for each length."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        by_length: dict = defaultdict(lambda: defaultdict(list))
        for item, text in items:
            have = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            size = min(window, len(have))
            for k in range(len(have) - size + 1 if size else 0):
                into = by_length[size][tuple(have[k : k + size])]
                if item not in into:
                    into.append(item)
        self.searchers = [WuManber(p) for _, p in sorted(by_length.items())]

    def search(self, text: str | None):
        """(number of words, spans of hit words (start, length) apart from each other, items found)."""
        got = words(text)
        ids = list(map(self.number.get, got, [0] * len(got)))
        spans, items = [], set()
        if self.searchers and any(ids):
            for s in self.searchers:
                for start, found in s.search(ids):
                    spans.append((start, start + s.length))
                    items.update(found)
        return len(got), union(spans), sorted(i for i in items if i is not None)


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint (start, length) that cover what the (start, end) cover."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b - a) for a, b in out]


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    return -(-(_items(benchmark).agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes)


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The items (item_id, text) in blocks of bounded size; one block is on the driver at a time."""
    sized, n = _items(benchmark), benchmark_blocks(benchmark, block_bytes)
    for k in range(n):
        part = sized if n == 1 else sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r[0], r[1]) for r in part.collect()]


_FOUND = "n_words long, spans array<struct<at:long,n:long>>, items array<string>"
_SPANS = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))


def _scan(source: DataFrame, items: list[tuple[int, str]], window: int) -> DataFrame:
    """source, whose last column is the text, with what is found in the place of the text."""

    def run(batches):
        matcher = Matcher(items, window)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = [matcher.search(t) for t in part.columns[-1].to_pylist()]
                out = [pa.array([x[0] for x in found], pa.int64()), pa.array([[{"at": a, "n": n} for a, n in x[1]] for x in found], _SPANS), pa.array([x[2] for x in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *out], [*part.schema.names[:-1], "n_words", "spans", "items"])

    fields = StructType([*source.schema.fields[:-1], *StructType.fromDDL(_FOUND).fields])
    return source.mapInArrow(run, fields)


def _found(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """Per row of docs: row (its columns, as one), n_words, spans (at, n) of hit words, items (item_ids found, as strings)."""
    row, text = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").cast("string").alias("text")
    if benchmark_blocks(benchmark, block_bytes) <= 1:
        return _scan(docs.select(row, text), next(blocks(benchmark, block_bytes), []), window)
    key = F.concat_ws("-", F.hex(F.xxhash64("text")), F.hex(F.xxhash64(F.lit(1), "text"))).alias("key")
    hits = None
    for items in blocks(benchmark, block_bytes):
        part = _scan(docs.select(key, text), items, window).where("size(spans) > 0").select("key", "spans", "items")
        hits = part if hits is None else hits.unionByName(part)
    hits = stored(hits, "hits")
    # equal texts have equal results, so distinct ones stay few for a text with many copies
    each = hits.select("key", F.inline("spans")).distinct()
    ordered = W.partitionBy("key").orderBy("at", "n")
    before = F.max(F.col("at") + F.col("n")).over(ordered.rowsBetween(W.unboundedPreceding, -1))
    runs = each.withColumn("begins", F.coalesce(F.col("at") > before, F.lit(True)).cast("long")).withColumn("run", F.sum("begins").over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow)))
    runs = runs.groupBy("key", "run").agg(F.min("at").alias("at"), (F.max(F.col("at") + F.col("n")) - F.min("at")).alias("n"))
    spans = runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("spans"))
    named = hits.select("key", F.explode("items").alias("item")).distinct().groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    merged = spans.join(named, "key", "left")
    counted = _scan(docs.select(row, key, text), [], window).drop("spans", "items")
    return counted.join(merged, "key", "left").select("row", "n_words", *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("spans", "array<struct<at:long,n:long>>"), ("items", "array<string>"))))


def search(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs: the columns `keep`, __n_words, __spans (at, n) of hit words, __items (item_ids found, as strings).

    A benchmark is sent to the executors in blocks of patterns of a checked size. With one block, the
    usual case, nothing is shuffled. With more, their results meet by 128 bits of hashes of the text.
    """
    found = _found(docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"]))), benchmark, window, block_bytes)
    return found.select(*(F.col(f"row.`{c}`") for c in keep), *(F.col(c).alias(f"__{c}") for c in ("n_words", "spans", "items")))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit (words in occurrences of windows), n_items, items_sha256 (of the item_ids
    found, sorted as strings and joined by commas), contaminated (n_hit > 0), spans.

    A window is `window` consecutive words of an item; a shorter item that has words is one window. Null and
    blank texts have no words and are clean; an item's id may be of any type, and words in windows of items with a null id are hit
    but there is no id to list or count; items without words are passed over; repeated items and rows count as such; an empty
    benchmark leaves all documents clean; an empty table gives none.
    """
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["n"])
    return _found(docs.select("doc_id", "text"), benchmark, window, BLOCK_BYTES).select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "spans",
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Those rows of docs, with all their columns whatever their names, that hold no window of any item. Null and blank texts have
    none and stay; repeated rows stay as often as they occur; an empty table gives none."""
    return _found(docs, benchmark, window, BLOCK_BYTES).where("size(spans) = 0").select(*(F.col(f"row.`{c}`") for c in docs.columns))


def digest(ids: list[int]) -> str:
    """items_sha256 of a list of ids."""
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
