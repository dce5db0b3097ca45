"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, words_of

#: Permitted sequence lengths, in tokens.
CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Cost of a sequence: a fixed part, a part for each token, and a part for each pair of tokens (attention).
COST = (16.0, 1.0, 1.0 / 16384)
#: Pieces that a shard should hold; bins are made within shards.
SHARD = 50_000


def cost(capacity, weights=COST):
    return weights[0] + weights[1] * capacity + weights[2] * capacity * capacity


class _Residuals:
    """Open bins by free space, with the least free space of at least n found through a bitmap of words."""

    def __init__(self, most: int):
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]
        self.bits = 0

    def add(self, free: int, b: int) -> None:
        if not self.bins[free]:
            self.bits |= 1 << free
        self.bins[free].append(b)

    def take(self, n: int) -> tuple[int, int] | None:
        rest = self.bits >> n
        if not rest:
            return None
        free = n + (rest & -rest).bit_length() - 1
        b = self.bins[free].pop()
        if not self.bins[free]:
            self.bits ^= 1 << free
        return free, b


def pack(lengths: np.ndarray, capacities=CAPACITIES, weights=COST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, capacity of that bin) of each length; a length is at least 1 and at most the largest capacity.

    Longest first, ties in the given order. A piece goes into the open bin with the least free space that
    holds it. If none does, it opens a bin of the size with the least cost for the tokens it can be expected to hold: the piece,
    and of the space beside it as much as the pieces still to come can fill. At the end each bin gets the
    smallest permitted size that holds its contents.
    """
    caps = sorted(capacities)
    order = np.argsort(-lengths, kind="stable")
    left = int(lengths.sum())
    bins, offsets, used = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64), []
    free_space = _Residuals(caps[-1])
    for i in order.tolist():
        n = int(lengths[i])
        left -= n
        found = free_space.take(n)
        if found is None:
            cap = min((c for c in caps if c >= n), key=lambda c: (cost(c, weights) / (n + min(c - n, left)), c))
            b, free = len(used), cap
            used.append(0)
        else:
            free, b = found
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        if free > n:
            free_space.add(free - n, b)
    sizes = np.array(caps)[np.searchsorted(caps, used)] if used else np.zeros(0, dtype=np.int64)
    return bins, offsets, sizes[bins]


def pieces(docs: DataFrame, length, most: int) -> DataFrame:
    """(doc_id, row, copy, piece, start, n): documents cut into pieces of at most `most` tokens; those without tokens have none.

    row tells repeated doc_ids with other texts apart, copy (from 1) the repeats of a row. Texts are read once: their lengths are
    written to the shared folder, and rows that repeat are counted before they are told apart.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), length.cast("long").alias("len")).where("len > 0")
    sized = cut(sized.groupBy("doc_id", "row", "len").agg(F.count("*").alias("copies")))
    most = F.lit(most).cast("long")
    cuts = F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1, most)).alias("piece", "start")
    each = sized.select("doc_id", "row", "len", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return each.select("doc_id", "row", "copy", "len", cuts).select("doc_id", "row", "copy", F.col("piece").cast("long").alias("piece"), "start", F.least(most, F.col("len") - F.col("start")).alias("n"))


def packed(docs: DataFrame, length=None, capacities=CAPACITIES, weights=COST, shard: int = SHARD) -> DataFrame:
    """Where each piece of each document goes: doc_id, piece, start (in the document), n (tokens), shard, bin (unique in
    the shard), bin_offset, capacity.

    length: column with a document's number of tokens (its words and an end token unless given). Documents longer
    than the largest capacity are cut into pieces. Pieces are dealt over shards by hash of document, copy and
    piece, about `shard` to each, and packed there, so only numbers are shuffled and no bin crosses tasks; the result does not depend on
    the partitioning of the input. A null or blank text is its end token alone; a null length or one of 0 gives
    no piece; repeated rows are packed as often as they occur; an empty table gives none.
    """
    size = F.size(words_of(F.col("text"))) + 1 if length is None else length
    rows = pieces(docs, size, max(capacities))
    total = rows.count()
    shards = max(1, -(-total // shard))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row", "copy", "piece"), F.lit(shards)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "row", "copy", "piece"], kind="stable").reset_index(drop=True)
        pdf["bin"], pdf["bin_offset"], pdf["capacity"] = pack(pdf["n"].to_numpy(), capacities, weights)
        return pdf[["doc_id", "piece", "start", "n", "shard", "bin", "bin_offset", "capacity"]]

    return dealt.groupBy("shard").applyInPandas(run, "doc_id long, piece long, start long, n long, shard long, bin long, bin_offset long, capacity long")
