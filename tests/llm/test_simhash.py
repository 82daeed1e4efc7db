import numpy as np
import pytest
import xxhash

from rowcloak.llm.simhash import GrayIndex, components, fingerprints_of, links, simhash_dedup


def brute_fp(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", words) if w]
    if not words:
        return 0
    sh = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    v = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return v - (1 << 64) if v >> 63 else v


def brute_components(fps, limit=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    codes = np.array(fps, np.int64).view(np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(codes[i + 1:] ^ codes[i]) <= limit) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


TEXTS = [None, "", " \n", "One two", "one TWO", "a b c d", "ÀÉ x \x0b y z w", "a b c d e f g " * 50, "a b c d e f g " * 50 + "h", "word " * 3000]


def test_fingerprints():
    assert fingerprints_of([t or "" for t in TEXTS]) == [brute_fp(t or "") for t in TEXTS]


def clusters(seed, n):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    out = []
    for i in range(n):
        c = base[rng.integers(0, 40) if i % 3 else 0]
        for b in rng.integers(0, 64, rng.integers(0, 6)):
            c ^= np.uint64(1) << np.uint64(b)
        out.append(c)
    return np.unique(np.array(out, np.uint64))


def test_index_against_brute_force():
    for seed in range(3):
        codes = clusters(seed, 1500)
        index = GrayIndex(codes, 4)
        label = index.components(block=256)
        want = brute_components(index.codes.view(np.int64).tolist())
        assert [int(x) for x in label] == want


@pytest.mark.parametrize("group_limit", [20_000, 30])
def test_links_and_components(spark, group_limit):
    codes = clusters(7, 900).view(np.int64)
    fps = spark.createDataFrame([(int(c),) for c in codes], "fp long")
    got = {r.node: r.root for r in components(links(fps, 4, group_limit)).collect()}
    order = np.sort(codes).tolist()
    want = brute_components(order)
    assert {c: got.get(c, c) for c in order} == {c: order[w] for c, w in zip(order, want)}


def test_query_against_brute_force(spark):
    df = spark.createDataFrame([(i * 3, t, 1) for i, t in enumerate(TEXTS)] + [(0, None, 1), (None, "one two", 2)], "doc_id long, text string, fp int")
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for data in (df, real):
        rows = [(r.doc_id, brute_fp(r.text or "")) for r in data.select("doc_id", "text").collect()]
        rows.sort(key=lambda r: (r[0] is None, r[0]))
        comp = brute_components([f for _, f in rows])
        want = sorted((d, f, rows[c][0]) for (d, f), c in zip(rows, comp) if d is not None)
        got = simhash_dedup(data).collect()
        assert len(got) == len(rows)
        assert sorted((r.doc_id, r.fp, r.component_id) for r in got if r.doc_id is not None) == want
    assert simhash_dedup(df.limit(0)).count() == 0


def test_frontier_is_bounded():
    """A full group without links, whose index can't prune by components."""
    import tracemalloc

    codes = np.unique(np.random.default_rng(1).integers(0, 1 << 24, 20_000).astype(np.uint64) << np.uint64(40))
    tracemalloc.start()
    label = GrayIndex(codes, 4).components()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
    near = np.bitwise_count(codes[:, None][:500] ^ codes[None]) <= 4
    index = GrayIndex(codes, 4)
    place = {int(c): i for i, c in enumerate(index.codes)}
    for i, row in enumerate(near):
        for j in np.flatnonzero(row):
            assert label[place[int(codes[i])]] == label[place[int(codes[j])]]
