"""Token files: fixed-length sequences and masks as Arrow stream files that are read in place."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_path

#: Tokens in a sequence, and sequences in a record batch.
SEQUENCE = 2048
BATCH = 64
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Rows and bytes of documents that a file should hold.
FILE_ROWS = 20_000
FILE_BYTES = 96 << 20
#: Runs in a generation of the encoder's cache.
_CACHE = 600_000
_CONTROL = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


_MARKS = ".,;:!?"


def _pieces(run: str) -> int:
    """The pieces into which the vocabulary's rules part a run of letters and a run of marks at their end; 0 where this is not known."""
    word = run.rstrip(_MARKS)
    # this letter in lower case ends in a mark
    return (1 if len(word) == len(run) else 2) if word.isalpha() and "\u0130" not in word else 0


class Encoder:
    """Whole texts to token ids (int32).

    No token of this vocabulary reaches over white space, which its rules drop, so a text is the sequence of its runs of
    other characters; the ids of a run that was seen before come from a bounded cache of two generations, the older of which goes
    when the younger is full. New runs are encoded together where it is known how many pieces each has. Tokenizers that keep
    white space must be given by_run=False.
    """

    def __init__(self, path: str, by_run: bool = True):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.by_run, self.known, self.older = Tokenizer.from_file(path), by_run, {}, {}

    def _learn(self, new: set[str]) -> None:
        if len(self.known) > _CACHE:
            self.older, self.known = self.known, {}
        unseen = []
        for r in new:
            if (ids := self.older.get(r)) is None:
                unseen.append(r)
            else:
                self.known[r] = ids
        sized = [(r, _pieces(r)) for r in unseen]
        plain, other = [x for x in sized if x[1]], [r for r, n in sized if not n]
        for k in range(0, len(plain), 512):
            if not self._together(part := plain[k : k + 512]):
                other += [r for r, _ in part]
        for k in range(0, len(other), 4096):
            part = other[k : k + 4096]
            for r, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.known[r] = array("i", e.ids).tobytes()

    def _together(self, part: list[tuple[str, int]]) -> bool:
        """Encodes runs of known numbers of pieces as one text; False if it has not the pieces expected."""
        found = self.tokenizer.encode(" ".join(r for r, _ in part), add_special_tokens=False)
        words = np.array(found.word_ids, dtype=np.int64)
        ends = np.cumsum([n for _, n in part])
        if not len(words) or words[-1] + 1 != ends[-1]:
            return False
        ids, cuts = np.array(found.ids, dtype=np.int32).tobytes(), (np.searchsorted(words, ends) * 4).tolist()
        for (r, _), low, high in zip(part, [0, *cuts], cuts):
            self.known[r] = ids[low:high]
        return True

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_run:
            return [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        # str.split() also parts at four control characters that are no white space to the tokenizer
        runs = [t.split() if not _CONTROL.search(t) else [r for r in _SPACE.split(t) if r] for t in texts]
        every = set().union(*runs)
        if len(self.known) > _CACHE:
            self._learn(every)
        elif new := every.difference(self.known):
            self._learn(new)
        return [np.frombuffer(b"".join(map(self.known.__getitem__, have)), dtype=np.int32) for have in runs]


def _schema(length: int, ids: pa.DataType) -> pa.Schema:
    return pa.schema([pa.field("input_ids", pa.list_(ids, length), nullable=False), pa.field("mask", pa.list_(pa.bool_(), length), nullable=False)])


def write_stream(sink, chunks: Iterator[np.ndarray], length: int = SEQUENCE, batch: int = BATCH, meta: dict | None = None, vocabulary: int = 1 << 31) -> int:
    """Writes the ids of all chunks, one after the other, as sequences of `length` in batches of `batch`; the last sequence is filled
    up with zeros that its mask marks false. Ids of a vocabulary of at most 65,536 take 16 bits, others 32. Returns the number of ids."""
    kind = np.uint16 if vocabulary <= 1 << 16 else np.int32
    schema = _schema(length, pa.from_numpy_dtype(kind)).with_metadata({k: json.dumps(v) for k, v in (meta or {}).items()})
    block, held, n, total = length * batch, [], 0, 0

    with pa.ipc.new_stream(sink, schema) as writer:

        def put(ids: np.ndarray) -> None:
            rows = -(-len(ids) // length)
            mask = np.zeros(rows * length, dtype=bool)
            mask[: len(ids)] = True
            full = np.zeros(rows * length, dtype=kind)
            full[: len(ids)] = ids
            writer.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x), length) for x in (full, mask)], schema=schema))

        for chunk in chunks:
            held.append(chunk)
            n += len(chunk)
            total += len(chunk)
            if n >= block:
                every = np.concatenate(held)
                for k in range(0, n - n % block, block):
                    put(every[k : k + block])
                held, n = [every[n - n % block :]], n % block
        if n:
            put(np.concatenate(held))
    return total


class TokenFile:
    """Random access to a token file. Record batches view the mapped file; nothing is copied but what a slice over batches joins."""

    def __init__(self, source):
        self.batches = pa.ipc.open_stream(source).read_all().to_batches()
        self.length = self.batches[0].schema.field("input_ids").type.list_size if self.batches else SEQUENCE
        self.ends = np.cumsum([b.num_rows for b in self.batches]) * self.length if self.batches else np.zeros(0, dtype=np.int64)

    def _flat(self, k: int) -> np.ndarray:
        return self.batches[k].column("input_ids").values.to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """(ids, mask) of the i-th sequence, as views."""
        k = int(np.searchsorted(self.ends, i * self.length, side="right"))
        at = i * self.length - (int(self.ends[k - 1]) if k else 0)
        return self._flat(k)[at : at + self.length], self.batches[k].column("mask").values.slice(at, self.length)

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from place start of the file's stream of ids."""
        parts, k = [], int(np.searchsorted(self.ends, start, side="right"))
        while n > 0:
            low = int(self.ends[k - 1]) if k else 0
            part = self._flat(k)[start - low : start - low + n]
            parts.append(part)
            start, n, k = start + len(part), n - len(part), k + 1
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)


def _filesystem(path: str):
    """(file system, path in it) of a folder that all executors share."""
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def written(docs: DataFrame, path: str | None = None, vocabulary: str | None = None, length: int = SEQUENCE, end_id: int = END_ID, by_run: bool = True) -> tuple[DataFrame, str]:
    """Writes token files for docs (doc_id, text) under path; gives their index and the path.

    The documents are ordered by doc_id (nulls first; repeats of a doc_id by text) and dealt by ranges of it, a file to each range:
    part-<number>.arrow. A task writes under a name of its own attempt and then renames, so a lost or repeated task leaves
    one whole file. Index: doc_id, part, at (place in the file), n_tokens, start (tokens of all documents before).
    A null text is empty and consists of the end id alone. An empty table has an empty index and no files. by_run=False is for
    vocabularies that keep white space (see Encoder).
    """
    spark = docs.sparkSession
    path, vocabulary = path or fresh_path(spark, "tokens"), vocabulary or default_vocabulary()
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows, size = source.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    files = max(1, -(-rows // FILE_ROWS), -(-(size or 0) // FILE_BYTES))
    # ranges of doc_id and a hash: a doc_id with very many rows is dealt over several files too
    keyed = source.withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    fields = "doc_id long, part int, seq long, at long, n_tokens long"

    def run(batches):
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        fs, base = _filesystem(path)
        encode, rows, at = Encoder(vocabulary, by_run), [], 0
        size = encode.tokenizer.get_vocab_size()

        def chunks():
            nonlocal at
            for batch in batches:
                for k in range(0, batch.num_rows, 256):
                    cutout = batch.slice(k, 256)
                    for doc, ids in zip(cutout.column(0).to_pylist(), encode(cutout.column(1).to_pylist())):
                        ids = np.append(ids, np.int32(end_id))
                        rows.append((doc, at, len(ids)))
                        at += len(ids)
                        yield ids

        stream = chunks()
        first = next(stream, None)
        if first is None:
            return
        fs.create_dir(base, recursive=True)
        temporary = f"{base}/.part-{part:06d}-{attempt}"
        with fs.open_output_stream(temporary, compression=None) as sink:
            write_stream(sink, (x for s in ([first], stream) for x in s), length, meta={"part": part, "end_id": end_id}, vocabulary=max(size, end_id + 1))
        fs.move(temporary, f"{base}/part-{part:06d}.arrow")
        for k in range(0, len(rows), 10_000):
            some = rows[k : k + 10_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in some], pa.int64()), pa.array([part] * len(some), pa.int32()), pa.array(range(k, k + len(some)), pa.int64()), pa.array([r[1] for r in some], pa.int64()), pa.array([r[2] for r in some], pa.int64())],
                ["doc_id", "part", "seq", "at", "n_tokens"],
            )

    index = cut(ordered.select("doc_id", "text").mapInArrow(run, fields))
    # one number for each file comes to the driver
    sizes = sorted((r[0], r[1]) for r in index.groupBy("part").agg(F.sum("n_tokens")).collect())
    before, total = [], 0
    for part, size in sizes:
        before.append((part, total))
        total += size
    offsets = spark.createDataFrame(before, "part int, before long")
    index = index.join(F.broadcast(offsets) if len(before) <= 500_000 else offsets, "part").select("doc_id", "part", "seq", "at", "n_tokens", (F.col("before") + F.col("at")).alias("start"))
    return index, path


def read_back(index: DataFrame, path: str) -> DataFrame:
    """index with ids_crc32, the checksum of each document's ids (little-endian, 32 bits each) as the files have them."""
    fields = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches):
        fs, base = _filesystem(path)
        opened: tuple = (None, None)
        for batch in batches:
            doc, part, at, n, start = (batch.column(c).to_pylist() for c in ("doc_id", "part", "at", "n_tokens", "start"))
            crc = []
            for p, a, k in zip(part, at, n):
                if opened[0] != p:
                    name = f"{base}/part-{p:06d}.arrow"
                    local = isinstance(fs, pyarrow.fs.LocalFileSystem)
                    opened = (p, TokenFile(pa.memory_map(name) if local else fs.open_input_file(name)))
                crc.append(zlib.crc32(np.ascontiguousarray(opened[1].ids(a, k), dtype="<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return index.mapInArrow(run, fields)


def digests(docs: DataFrame, path: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """Per row of docs, read from the files that written() makes: doc_id, start, n_tokens, ids_crc32."""
    return read_back(*written(docs, path, vocabulary))
