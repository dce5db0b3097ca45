"""SimHash fingerprints and their near-duplicate components, searched with vantage-point trees."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import connected

SHINGLE = 3
RADIUS = 3
#: Fingerprints on which the trees are laid out; every fingerprint is routed through them.
SAMPLE = 16384
#: Fingerprints that a leaf should hold.
LEAF = 1024
#: Levels of a tree that is sent to all tasks. Leaves that then hold more than FULL times LEAF are split in their own task.
MAX_DEPTH = 13
FULL = 4


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash; 0 for null and blank texts."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = ends - np.fromiter(map(len, words), np.int64, n) - 1
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts[: n - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist())], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65536):
        part = hashes[k : k + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def row_key():
    """What tells rows apart: 128 bits of doc_id and text. The seed comes first, else rows equal in the first half would be in the second."""
    return F.concat(F.hex(F.xxhash64("doc_id", "text")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "doc_id", "text")))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row, fp): the fingerprint of each row's whole text as a signed 64-bit integer; row tells repeats of a doc_id apart."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                fps = np.array([fingerprint(t, shingle) for t in part.column(2).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fps.view(np.int64))], ["doc_id", "row", "fp"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, row string, fp long")


class Tree:
    """A vantage-point tree over one part of the fingerprint, flat in arrays.

    A node sends a point to the left if its distance to the vantage point is at most `cut`.
    """

    def __init__(self, sample: np.ndarray, radius: int, depth: int):
        self.radius, self.point, self.cut, self.child = radius, [], [], []
        self._grow(np.unique(sample), depth, np.random.default_rng(7))
        self.point, self.cut = np.array(self.point, dtype=np.uint64), np.array(self.cut, dtype=np.int16)
        self.child = np.array(self.child, dtype=np.int64).reshape(-1, 2)

    def _grow(self, have: np.ndarray, depth: int, rng) -> int:
        me = len(self.point)
        self.point.append(0), self.cut.append(-1), self.child.append((-1, -1))
        if depth == 0 or len(have) < 4:
            return me
        best = None
        for p in rng.choice(have, min(6, len(have)), replace=False):
            d = np.bitwise_count(have ^ p).astype(np.int64)
            freq = np.bincount(d, minlength=66) / len(d)
            low = np.cumsum(freq)
            for t in range(65):
                if 0.3 <= low[t] <= 0.7:
                    # what goes both ways, and how far from halves
                    cost = freq[max(0, t - self.radius + 1) : t + self.radius + 1].sum() + abs(low[t] - 0.5)
                    if best is None or cost < best[0]:
                        best = (cost, p, t, d)
        if best is None:
            return me
        _, p, t, d = best
        self.point[me], self.cut[me] = p, t
        left = self._grow(have[d <= t], depth - 1, rng)
        self.child[me] = (left, self._grow(have[d > t], depth - 1, rng))
        return me

    def route(self, part: np.ndarray, at_home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, at home) for each leaf that a point calls at.

        Each point is at home in one leaf, but those that at_home says are visitors from the start. For two points within the radius whose homes part at a
        node, the one on the right also goes left there, as a visitor; from then on it goes to
        every child that the triangle inequality does not exclude, so it reaches the other's home.
        """
        rows, node = np.arange(len(part)), np.zeros(len(part), dtype=np.int64)
        home = np.ones(len(part), dtype=bool) if at_home is None else at_home
        out = []
        while len(rows):
            done = self.cut[node] < 0
            out.append((rows[done], node[done], home[done]))
            rows, node, home = rows[~done], node[~done], home[~done]
            if not len(rows):
                break
            d = np.bitwise_count(part[rows] ^ self.point[node]).astype(np.int64)
            t = self.cut[node].astype(np.int64)
            go_left = d - self.radius <= t
            go_right = np.where(home, d > t, d + self.radius > t)
            rows, node, home = (
                np.concatenate([rows[go_left], rows[go_right]]),
                np.concatenate([self.child[node[go_left], 0], self.child[node[go_right], 1]]),
                np.concatenate([(home & (d <= t))[go_left], home[go_right]]),
            )
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (rows, node, home)


def _parts(fp: np.ndarray, tree: int) -> np.ndarray:
    """The half of the fingerprints that a tree is over; for tree 2, all of them."""
    return (fp >> np.uint64(32), fp & np.uint64(0xFFFFFFFF), fp)[tree]


def forest(homes: np.ndarray, visitors: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Star edges of the components that pairs within radius make: each home against all, in blocks."""
    every = np.concatenate([homes, visitors])
    root = np.arange(len(every))
    step = max(1, 2_000_000 // max(1, len(every)))
    for k in range(0, len(homes), step):
        near = np.bitwise_count(homes[k : k + step, None] ^ every[None, :]) <= radius
        for i in np.nonzero(near.sum(axis=1) > 1)[0]:
            found = np.unique(root[near[i]])
            if len(found) > 1:
                root[np.isin(root, found[1:])] = found[0]
    moved = np.nonzero(root != np.arange(len(every)))[0]
    return [(int(every[i]), int(every[root[i]])) for i in moved]


def _split(fp: np.ndarray, home: np.ndarray, radius: int, tree: int, leaf: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """The leaves (fp, home) of a tree grown on the home points; None if comparing these takes over half the work of comparing all."""
    own = _parts(fp[home], tree)
    some = own if len(own) <= SAMPLE else np.random.default_rng(7).choice(own, SAMPLE, replace=False)
    depth = min(MAX_DEPTH, int(np.ceil(np.log2(len(own) / leaf))))
    rows, at, own_leaf = Tree(some, radius if tree == 2 else radius // 2, depth).route(_parts(fp, tree), home)
    order = np.argsort(at, kind="stable")
    cuts = np.nonzero(np.diff(at[order]))[0] + 1
    pieces = [(fp[rows[i]], own_leaf[i]) for i in np.split(order, cuts)]
    if sum(int(h.sum()) * len(f) for f, h in pieces) * 2 > len(own) * len(fp):
        return None
    return [(f, h) for f, h in pieces if h.any()]


def settled(fp: np.ndarray, home: np.ndarray, radius: int, tree: int, leaf: int = LEAF) -> list[tuple[int, int]]:
    """Star edges of a leaf of a tree that join what pairs (a home point and any other) close in the tree's half join.

    A leaf of more than FULL * leaf home points is split by a tree grown on them, and again until its leaves hold fewer. Where
    the half does not tell the points apart, one over all 64 bits splits them; what that can't split is compared in blocks.
    """
    edges, todo = [], [(fp, home, tree)]
    while todo:
        fp, home, tree = todo.pop()
        if home.sum() > FULL * leaf:
            if pieces := _split(fp, home, radius, tree, leaf):
                todo += [(f, h, tree) for f, h in pieces]
                continue
            if tree < 2:
                todo.append((fp, home, 2))
                continue
        edges += forest(fp[home], fp[~home], radius)
    return edges


def links(fps: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, leaf: int = LEAF, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(a, b): star edges that join exactly those of the distinct fingerprints `fp` (long) which chains of
    pairs at `radius` or fewer differing bits join.

    Two fingerprints within 2r+1 bits are within r bits in one of their 32-bit halves, so there is a
    tree for each half with that smaller radius, and far fewer points lie near its boundaries. Each
    leaf is a shard: its home points are compared with all that call there, on all 64 bits. A leaf gives
    a spanning forest, not its pairs. The trees (at most 2**max_depth leaves each) are laid out on a bounded
    sample, all fingerprints go through them; a leaf that holds far more than `leaf` is split again in its task (settled).
    """
    spark = fps.sparkSession
    n = fps.count()
    some = [r[0] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()]
    some = np.array(some, dtype=np.int64).view(np.uint64)
    depth = min(max_depth, max(0, int(np.ceil(np.log2(max(1, n) / leaf)))))
    trees = [Tree(_parts(some, k), radius // 2, depth) for k in (0, 1)]

    def route(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, tree in enumerate(trees):
                rows, at, home = tree.route(_parts(fp, k))
                yield pa.RecordBatch.from_arrays([pa.array(at * 2 + k), pa.array(fp[rows].view(np.int64)), pa.array(home)], ["shard", "fp", "home"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, home = pdf["fp"].to_numpy().view(np.uint64), pdf["home"].to_numpy()
        edges = np.array(settled(fp, home, radius, int(pdf["shard"].iloc[0]) % 2, leaf), dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": edges[:, 0], "b": edges[:, 1]})

    routed = fps.select("fp").mapInArrow(route, "shard long, fp long, home boolean")
    return routed.groupBy("shard").applyInPandas(join, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per row of docs (doc_id, text; further columns are ignored): doc_id, fingerprint (16 hex digits),
    component_id (the least doc_id that chains of fingerprints at `radius` or fewer bits reach), row (hash of doc_id and
    text), first (whether the row is the least of its component by doc_id, then row).

    Null and blank texts have fingerprint zero and are linked like any other. Rows of one text have one
    fingerprint and are grouped before any search. Repeated rows are returned as often as they
    occur, each with the same `first`; a null doc_id is never a component_id unless no other is reachable. An empty table gives none.
    """
    rows = cut(fingerprints(docs, shingle))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = rows.groupBy("fp").agg(F.min(order).alias("least"))
    roots = connected(links(classes.select("fp"), radius))
    rooted = cut(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    linked = rooted.join(roots.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("least").alias("lowest"))
    named = rooted.join(linked, "root", "left").select("fp", F.coalesce("lowest", "least").alias("lowest"))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(named, "fp").select("doc_id", text, F.col("lowest.doc_id").alias("component_id"), "row", (order == F.col("lowest")).alias("first"))
