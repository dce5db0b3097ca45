import io
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lattica.llm import packing, quality_net, simhash, token_files

public = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("size", [50_000, 100_000])
def test_stream_round_trip(size):
    rng = np.random.default_rng(0)
    chunks = [rng.integers(0, 50_000, n).astype(np.int32) for n in (5, 0, 700, 33, 1, 4000)]
    sink = io.BytesIO()
    assert token_files.write_stream(sink, iter(chunks), length=16, batch=4, vocabulary=size) == 4739
    f = token_files.TokenFile(pa.BufferReader(sink.getvalue()))
    every = np.concatenate(chunks)
    for start, n in ((0, 5), (5, 700), (63, 2), (738, 4001), (4738, 1), (10, 0)):
        assert (f.ids(start, n) == every[start : start + n]).all()
    ids, mask = f.sequence(4739 // 16)
    assert mask.to_pylist() == [True] * (4739 % 16) + [False] * (16 - 4739 % 16) and (ids[: 4739 % 16] == every[-(4739 % 16) :]).all()
    assert not f.sequence(3)[0].flags.owndata


def test_digests(spark):
    from tokenizers import Tokenizer

    texts = ["Hello, World! it's 42", None, "", "a\x1cb   c d", "naïve ＡＢ é <|endoftext|>x", "İstanbul ΣΑΣ\n\n\tend", "word " * 9000]
    rows = [(i * 3 - 2, t, i) for i, t in enumerate(texts)] + [(4, "repeat", 0), (4, "repeat", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(5)
    tokenizer = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    got = token_files.digests(docs).collect()
    want = Counter()
    for d, t, _ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want[d, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted(d for d, _, _ in rows)
    assert token_files.digests(docs.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline
    from test_text_operators import brute_hits, brute_lines

    got = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    model = quality_net.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    keep = {r.doc_id for r in quality_net.scored(docs, model).where("predicted = 1").collect()}
    rows = brute_lines([(r.doc_id, r.text) for r in docs.collect() if r.doc_id in keep])
    rows = {d: t for d, t in rows.items() if re.search(r"[^\x20\x09-\x0D]", t)}
    fp = {d: simhash.fingerprint(t) for d, t in rows.items()}
    root = {d: d for d in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in rows:
        for b in rows:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= simhash.RADIUS:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    left = {d: t for d, t in rows.items() if find(d) == d and not brute_hits(t, bench)[4]}
    want = Counter()
    for d, t in left.items():
        want[d] += len(t.split()) + 1
    have = Counter()
    for r in got:
        have[r.doc_id] += r.n
    assert have == want and set(r.capacity for r in got) <= set(packing.CAPACITIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_keep_columns_and_take_odd_rows(spark):
    import corpus_pipeline

    rows = [(1, "a b c", "en", None, None, "x", 1), (2, None, None, "s", 3, "y", 2), (3, "", "en", "s", 3, "y", 2), (None, "some words here", "en", "s", 3, "y", 2), (1, "a b c", "en", None, None, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, n int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out.collect()
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[2][1](spark, docs, SF).where("doc_id = 1").count() == 1
