"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with a calibrated temperature."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Words are hashed to so many rows of the vector table, word shapes to so many more.
N_WORDS = 8192
N_SHAPES = 512
DIM = 64
#: Entries of +1 or -1 in a random index vector.
NONZERO = 4
#: The network is fitted on at most so many labelled rows, least hash of doc_id first.
MAX_LABELLED = 20_000
THRESHOLD = 0.3
_CACHE = 200_000
_EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _shape(word: str) -> str:
    """The word with runs of capitals, small letters and digits each as one character; other runs as their first character."""
    s = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() else "a" if m[0].islower() else "Aa", word)
    return re.sub(r"([^A])\1+", r"\1", re.sub(r"\d+", "9", s))


class Encoder:
    """Texts to numbers of words and shapes; a bounded cache saves repeated work."""

    def __init__(self, n_words: int = N_WORDS, n_shapes: int = N_SHAPES):
        self.n_words, self.n_shapes, self.known = n_words, n_shapes, {}

    def _number(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        plain = text.lower().encode().strip(_EDGE)
        got = (zlib.crc32(plain) % self.n_words) << 16 | self.n_words + zlib.crc32(_shape(text).encode()) % self.n_shapes
        if len(self.known) >= _CACHE:
            self.known.clear()
        self.known[word] = got
        return got

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").encode("utf-8", "replace").split()
        known, number = self.known.get, self._number
        both = np.array([known(w) or number(w) for w in words], dtype=np.int64)
        return both >> 16, both & 0xFFFF


def index_vectors(rows: int, dim: int, nonzero: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs), each rows x nonzero, of the sparse random index vectors."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, dim, (rows, nonzero)), rng.choice(np.array([-1, 1]), (rows, nonzero))


def context_sums(docs: DataFrame, n_words: int = N_WORDS, n_shapes: int = N_SHAPES, dim: int = DIM, nonzero: int = NONZERO) -> np.ndarray:
    """(n_words + n_shapes) x dim sums of the index vectors of each row's neighbours, over all documents.

    Each task adds up its own documents and gives one row for each row of the table; these are summed by Spark.
    The table, not the corpus, comes to the driver.
    """
    rows = n_words + n_shapes

    def run(batches):
        encode = Encoder(n_words, n_shapes)
        place, sign = index_vectors(rows, dim, nonzero)
        total = np.zeros(rows * dim)

        def add(of, by):
            for j in range(nonzero):
                np.add(total, np.bincount(of * dim + place[by, j], weights=sign[by, j], minlength=rows * dim), out=total)

        def flush(held):
            w, s = (np.concatenate(x) for x in zip(*held))
            inside = np.ones(len(w), dtype=bool)
            inside[np.cumsum([len(x) for x, _ in held if len(x)]) - 1] = False
            i = np.nonzero(inside)[0]  # words with a next one in their document
            add(w[i + 1], w[i]), add(w[i], w[i + 1]), add(w, s), add(s, w)

        held, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                w, s = encode(text.as_py())
                held.append((w, s))
                size += len(w)
                if size > 1_000_000:
                    flush(held)
                    held, size = [], 0
        if size:
            flush(held)
        table = total.reshape(rows, dim).astype(np.int64)
        used = np.nonzero(table.any(axis=1))[0]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), *(pa.array(table[used, j]) for j in range(dim))], ["row", *(f"v{j}" for j in range(dim))])

    schema = "row long, " + ", ".join(f"v{j} long" for j in range(dim))
    sums = docs.select(F.col("text").cast("string")).mapInArrow(run, schema).groupBy("row").agg(*(F.sum(f"v{j}").alias(f"v{j}") for j in range(dim)))
    out = np.zeros((rows, dim))
    for r in sums.collect():  # at most n_words + n_shapes rows
        out[r[0]] = r[1:]
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Context sums to vectors of unit length, without their common direction."""
    unit = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    unit -= unit.mean(axis=0)
    return (unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: list[str | None], encode: Encoder, vectors: np.ndarray) -> np.ndarray:
    """A row for each text: mean word vector, mean shape vector, log of the number of words, share of distinct words."""
    dim = vectors.shape[1]
    out = np.zeros((len(texts), 2 * dim + 3), dtype=np.float32)
    for i, text in enumerate(texts):
        w, s = encode(text)
        n = len(w)
        if not n:
            continue
        for k in range(0, n, 65536):
            out[i, :dim] += vectors[w[k : k + 65536]].sum(axis=0)
            out[i, dim : 2 * dim] += vectors[s[k : k + 65536]].sum(axis=0)
        out[i, : 2 * dim] /= n
        many = np.bincount(w)
        out[i, 2 * dim :] = np.log1p(n) / 10, np.count_nonzero(many) / min(n, len(many)), many.max() / n
    return out


@dataclass
class Network:
    """score = sigmoid((tanh((x - mean) / scale @ w1 + b1) @ w2 + b2) / temperature)"""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale).clip(-8, 8) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.logits(x) / self.temperature).clip(-40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, batch: int = 256, rate: float = 3e-3, decay: float = 1e-3, seed: int = 5, least_steps: int = 1500) -> Network:
    """Adam on four fifths of the rows, for more epochs if they are few; the temperature with the least log loss on the last fifth."""
    rng = np.random.default_rng(seed)
    x, y = x.astype(np.float64), y.astype(np.float64)
    order = rng.permutation(len(y))
    held, own = order[: len(y) // 5], order[len(y) // 5 :]
    net = Network(x.mean(axis=0), x.std(axis=0) + 1e-3, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), 0.0)
    z = ((x - net.mean) / net.scale).clip(-8, 8)
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(max(epochs, -(-least_steps // max(1, -(-len(own) // batch))))):
        mixed = rng.permutation(own)
        for k in range(0, len(mixed), batch):
            i = mixed[k : k + batch]
            h = np.tanh(z[i] @ params[0] + params[1])
            err = (1 / (1 + np.exp(-(h @ params[2] + params[3]).clip(-40, 40))) - y[i]) / len(i)
            back = np.outer(err, params[2]) * (1 - h * h)
            grads = [z[i].T @ back + decay * params[0], back.sum(axis=0), h.T @ err + decay * params[2], np.array([err.sum()])]
            step += 1
            for p, g, a, b in zip(params, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if len(held):
        logit, sign = net.logits(x[held]), 2 * y[held] - 1
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 121))
        net.temperature = float(grid[np.argmin([np.logaddexp(0, -sign * logit / t).mean() for t in grid])])
    return net


@dataclass
class Model:
    vectors: np.ndarray
    network: Network | None
    n_words: int = N_WORDS
    n_shapes: int = N_SHAPES

    def score(self, texts: list[str | None], encode: Encoder) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), 0.5)
        return self.network.score(pooled(texts, encode, self.vectors).astype(np.float64))


def held_out(doc_id):
    """Rows of the fold that is never learnt from: crc32 of doc_id as text, modulo 5, is 0. A null doc_id is not in it."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Word vectors from all documents, the network from at most max_labelled labelled rows outside the held-out fold.

    labels: doc_id, quality; a document with several labels counts as 1 if at least half of them are. Without any label
    the model scores 0.5.
    """
    vectors = word_vectors(context_sums(docs))
    known = labels.where("doc_id is not null and quality is not null").where(~held_out("doc_id"))
    known = known.groupBy(F.col("doc_id").cast("long").alias("labelled")).agg((F.avg("quality") >= 0.5).cast("double").alias("good"))
    some = known.orderBy(F.xxhash64("labelled"), "labelled").limit(max_labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), F.col("doc_id") == F.col("labelled")).select("text", "good")

    def features(batches):
        encode = Encoder()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                x = pooled(part.column(0).to_pylist(), encode, vectors)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), part.column(1)], ["x", "good"])

    # repeats of a labelled row could be many: as many as labelled rows are taken, in an order that does not depend on partitions
    got = rows.mapInArrow(features, "x binary, good double").orderBy(F.xxhash64("x"), "good").limit(max_labelled).collect()
    if not got:
        return Model(vectors, None)
    return Model(vectors, fit_network(np.array([np.frombuffer(r[0], dtype=np.float32) for r in got]), np.array([r[1] for r in got])))


def _scores(docs: DataFrame, columns: list[str], model: Model) -> DataFrame:
    """(row, score): the asked columns of each row, as one, whatever their names, and its score."""
    row = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row")
    source = docs.select(row, F.col("text").cast("string").alias("text"))

    def run(batches):
        encode = Encoder(model.n_words, model.n_shapes)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(part.column(1).to_pylist(), encode))], ["row", "score"])

    return source.mapInArrow(run, StructType([source.schema.fields[0], StructField("score", DoubleType())]))


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted.

    Null and blank texts are scored as texts without words. Only `text` enters the score. Repeated rows get the same score, further columns are not looked at.
    """
    out = _scores(docs, ["doc_id"], model).select(F.col("row.doc_id").alias("doc_id"), "score")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns whatever their names, whose score is at least the threshold."""
    return _scores(docs, docs.columns, model).where(F.col("score") >= threshold).select(*(F.col(f"row.`{c}`") for c in docs.columns))
