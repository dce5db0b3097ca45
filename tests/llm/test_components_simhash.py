import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import simhash
from lattica.llm.components import connected


def brute_components(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_connected(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (130, 2))] + [(300 + i, 301 + i) for i in range(60)] + [(400, k) for k in range(401, 430)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges + edges[:5] + [(7, 7)], "a long, b long")).collect()}
    want = brute_components(500, edges)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == touched and all(want[x] == r for x, r in got.items())
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 6))
def test_tree_loses_no_pair(seed, depth):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**32, 300, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 32, 300, dtype=np.uint64))]))
    tree = simhash.Tree(rng.choice(fps, 100), 1, depth)
    rows, leaf, home = tree.route(fps)
    assert np.bincount(rows[home], minlength=len(fps)).tolist() == [1] * len(fps)
    at = {}
    for r, l in zip(rows.tolist(), leaf.tolist()):
        at.setdefault(r, set()).add(l)
    own = dict(zip(rows[home].tolist(), leaf[home].tolist()))
    for i in range(len(fps)):
        for j in np.nonzero(np.bitwise_count(fps ^ fps[i]) <= 1)[0].tolist():
            assert own[i] in at[j] or own[j] in at[i]


def naive(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    for text in (None, "", "  \n", "One", "Ä b", "a b c d e A B", "x\ty  z " * 50):
        assert simhash.fingerprint(text) == naive(text)


def test_near_duplicates(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choice(words, 400)) for _ in range(30)]
    for i in range(40):  # copies with one word changed
        t = texts[i % 5].split()
        t[int(rng.integers(len(t)))] = "changed"
        texts.append(" ".join(t))
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(100, None, 1), (101, "", 1), (102, " ", 1), (None, texts[0], 1), (3, texts[3], 1), (3, texts[3], 1)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()
    assert len(got) == len(rows)
    fps = [naive(t) for _, t, _ in rows]
    root = brute_components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3])
    least = {}
    for (d, _, _), r in zip(rows, root):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    want = sorted((str(d), f"{f:016x}", least[r]) for (d, _, _), f, r in zip(rows, fps, root))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_full_leaves_split(spark):
    """Trees without levels, so one leaf of each holds all: components are those of brute force, and work on far fewer pairs."""
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2**64, 1500, dtype=np.uint64)
    # a third of the points have one upper half, so no tree over it tells them apart
    seeds[:500] = (seeds[:500] & np.uint64(0xFFFFFFFF)) | np.uint64(0xABCDEF0100000000)
    near = seeds[rng.integers(0, len(seeds), 1500)].copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64)
    fps = np.unique(np.concatenate([seeds, near]))
    table = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    got = {}
    for depth, leaf in ((0, 16), (3, 32), (simhash.MAX_DEPTH, 1024)):
        edges = simhash.links(table, leaf=leaf, max_depth=depth).collect()
        at = {int(f): i for i, f in enumerate(fps.view(np.int64))}
        got[depth] = brute_components(len(fps), [(at[e.a], at[e.b]) for e in edges])
    pairs = [(i, int(j)) for i in range(len(fps)) for j in np.nonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 3)[0]]
    want = brute_components(len(fps), pairs)
    assert all(g == want for g in got.values())


def test_split_lowers_work():
    rng = np.random.default_rng(6)
    fps = np.unique(rng.integers(0, 2**64, 20000, dtype=np.uint64))
    home = np.ones(len(fps), dtype=bool)
    pieces = simhash._split(fps, home, 3, 0, 256)
    assert sum(int(h.sum()) for _, h in pieces) == len(fps)
    assert sum(int(h.sum()) * len(f) for f, h in pieces) * 20 < len(fps) ** 2
    # equal halves can't be split by the half
    one = fps & np.uint64(0xFFFFFFFF)
    assert simhash._split(one, home, 3, 0, 256) is None
