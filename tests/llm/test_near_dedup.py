import random

import numpy as np
import pytest

import corpus_pipeline as P
from rowcloak.llm.near_dedup import fingerprint, first_shingles, may_be_similar, near_dedup, shingles, similar, simhash_pairs, spanning, wide_parity


def brute_sets(texts):
    words = [(t or "").encode().lower().split() for t in texts]
    return [frozenset(b" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in words]


def brute(rows):
    """The doc_ids that stay, of rows (doc_id, text) with different ids."""
    rows = sorted(rows, key=lambda r: r[0])
    sets, root = brute_sets([t for _, t in rows]), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) and root[i] != root[j]:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    return [d for i, (d, _) in enumerate(rows) if root[i] == i]


def changed(words, n, rng):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.random()}"
    return " ".join(out)


def made():
    rng = random.Random(1)
    base = [[f"w{rng.randrange(5000)}" for _ in range(n)] for n in (8, 30, 120, 400, 1500)]
    rows = [" ".join(b) for b in base] + [changed(b, k, rng) for b in base for k in range(7) for _ in range(6) if k * 20 < len(b) + 40]
    chain = [f"c{i}" for i in range(140)]
    rows += [" ".join(chain[i:i + 60]) for i in range(0, 80, 5)] + [" ".join(["the same opening words of every page here"] + [f"x{rng.random()}" for _ in range(9)]) for _ in range(80)]
    rows += [None, "", " \n", "one", "One", "a b c d", "A b C d", "a b c d e", "a a a a a a a a a", "a a a a a", "É b c d e", "é b c d e"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("case", ["made", "sf0.001"])
def test_near_duplicates_against_all_pairs(spark, case):
    rows = made() if case == "made" else [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = P.near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in got.collect()) == brute(rows)


def test_large_groups_cut_in_blocks_against_all_pairs(spark):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for group in (2, 7):
        assert sorted(r.doc_id for r in near_dedup(docs, group=group).collect()) == brute(rows)


def test_a_similarity_of_four_fifths_links(spark):
    words = [f"w{i}" for i in range(94)]  # 90 shingles, of which the second text lacks ten and has ten others
    rows = [(1, " ".join(words)), (2, " ".join([*words[:84], *(f"v{i}" for i in range(10))])), (3, " ".join([*words[:83], *(f"u{i}" for i in range(11))]))]
    assert [r.doc_id for r in P.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").orderBy("doc_id").collect()] == brute(rows) == [1, 3]


def test_equal_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "A B"), (None, "x"), (2, "y z")], "doc_id long, text string")
    assert sorted(map(str, (tuple(r) for r in near_dedup(docs).collect()))) == sorted(map(str, [(1, "a b"), (None, "x"), (2, "y z")]))
    assert near_dedup(docs.limit(0)).count() == 0


def test_similar_sets_share_a_first_shingle():
    rng = np.random.default_rng(0)
    often = rng.integers(0, 3, 1 << 22).astype(np.uint8)
    for n in [*range(1, 30), 500]:
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: len(a) - len(a) // 9], rng.integers(0, 1 << 63, len(a) // 9).astype(np.uint64)]))
        assert not similar(a, b) or np.intersect1d(first_shingles(a, often), first_shingles(b, often)).size
    assert len(shingles("a b c d e f", 5)) == 2 and len(shingles("a b", 5)) == 1 and len(shingles(" ", 5)) == 0


def test_spanning_joins_what_all_pairs_join_without_circles():
    rng = np.random.default_rng(1)
    for n, m in ((1, 0), (2, 1), (40, 30), (40, 400), (300, 280)):
        q, r, label = rng.integers(0, n, m), rng.integers(0, n, m), np.arange(n)
        want = list(range(n))
        for a, b in zip(q, r):
            want = [min(want[a], want[b]) if w in (want[a], want[b]) else w for w in want]
        a, b = spanning(label, q, r)
        assert label.tolist() == want and len(a) == len(b) == n - len(set(want))


def test_staying_rows(spark):
    """Repeated rows come once and lost ones not at all."""
    from rowcloak.llm.near_dedup import staying

    rows = spark.range(3000).selectExpr("struct(id as doc_id) as _row", "id div 3 as _k", "id % 3 as _th").unionByName(spark.sql("select struct(3L as doc_id) as _row, 1L as _k, 0L as _th"))
    winners = rows.where("_th = 0").select("_k", "_th").distinct()
    out = staying(rows, winners)
    assert sorted(r.doc_id for r in out.collect()) == list(range(0, 3000, 3))
    assert staying(rows.where("_k < 0"), winners.where("_k < 0")).count() == 0


def test_wide_parities_tell_large_sets_apart_and_lose_no_similar_ones():
    rng = np.random.default_rng(3)
    fresh = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)
    for n in (513, 600, 1024, 1025, 3000, 5000):
        a = np.unique(fresh(n))
        for m in (len(a) // 9, len(a) // 3):  # so many shingles replaced
            b = np.unique(np.concatenate([a[m:], fresh(m)]))
            assert may_be_similar(wide_parity(a), wide_parity(b), len(a) + len(b)) == similar(a, b) == (m == len(a) // 9)
        c = np.unique(np.concatenate([a, fresh(len(a) // 4)]))  # 0.8, and from 1,024 on another number of classes for some
        assert similar(a, c) and may_be_similar(wide_parity(a), wide_parity(c), len(a) + len(c))
    assert wide_parity(a[:512]) is None


def test_large_near_copies_against_all_pairs(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(9000)}" for _ in range(n)] for n in (600, 1030, 2500)]
    rows = list(enumerate([" ".join(b) for b in base] + [changed(b, k, rng) for b in base for k in (1, len(b) // 60, len(b) // 40, len(b) // 15)]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in near_dedup(docs).collect()) == brute(rows)


def test_fingerprints_within_four_bits_are_candidates(spark):
    """As components: what pairs within four bits connect, no more and no less; few similar texts are that near, so the others need prefixes."""
    sets = [x for x in {shingles(t or "").tobytes() for _, t in made()}]
    rows = [(k, fingerprint(np.frombuffer(x, np.uint64))) for k, x in enumerate(sets)] + [(900, 5), (901, 5), (902, 5 ^ 15), (903, 5 ^ 255), (904, -1), (905, -1 ^ 31)]
    assert fingerprint(np.zeros(0, np.uint64)) == 0 and fingerprint(np.array([7, 5, 1 << 63], np.uint64)) == 5
    joined = lambda pairs: [min(c) for k, _ in rows for c in [next(c for c in _components([r[0] for r in rows], pairs) if k in c)]]
    near = [(a, b) for a, x in rows for b, y in rows if a < b and ((x ^ y) & (1 << 64) - 1).bit_count() <= 4]
    got = [(r.a, r.b) for r in simhash_pairs(spark.createDataFrame(rows, "_k long, _fp long").repartition(3)).collect()]
    assert all(a < b for a, b in got) and joined(got) == joined(near) and len(near) > 6


def _components(nodes, pairs):
    sets = {n: {n} for n in nodes}
    for a, b in pairs:
        if sets[a] is not sets[b]:
            sets[a] |= sets[b]
            for n in sets[b]:
                sets[n] = sets[a]
    return list({id(c): c for c in sets.values()}.values())


def test_the_stage_looks_fingerprints_up(spark, monkeypatch):
    from rowcloak.llm import near_dedup as N

    seen = []
    monkeypatch.setattr(N, "links", lambda fps, limit, f=N.links: seen.append(fps.count()) or f(fps, limit))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e f"), (3, "x y"), (4, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in P.near_duplicates(spark, docs, "").collect()) == [1, 3, 4] and seen == [3]
