import random

import numpy as np
import pytest

from rowcloak.llm.suffix_dedup import repeated, segments, suffix_dedup


def brute(texts, length):
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            s = t[i:i + length]
            seen[s] = seen.get(s, 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), kept))
    return out


def made(seed, n=60, length=200):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(k) for k in (20, 33, 34, 35, 40, 60, 200)]
    out = []
    for _ in range(n):
        parts = [text(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            cut = rng.randint(0, 40)
            parts += [s[cut:] if rng.random() < .5 else s, text(rng.randint(0, 30))]
        out.append(" ".join(parts))
    out += [out[0], out[1][:-1] + "X", "a" * 700, "ab" * 300, "", "short", text(50), out[2][3:]]
    return out


@pytest.mark.parametrize("limit", [50_000, 3])
def test_against_brute_force(spark, limit):
    texts = made(1)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, first int, _spans string")
    got = {r.doc_id: r for r in suffix_dedup(df, group_limit=limit).collect()}
    assert len(got) == len(texts)
    for i, (n, gone, runs, kept) in enumerate(brute([t.encode() for t in texts], 200)):
        r = got[i]
        assert (r._n_bytes, sum(b - a for a, b in r._spans), len(r._spans), bytes(r._kept)) == (n, gone, runs, kept), i


def test_edges(spark):
    a = "".join(random.Random(3).choice("abcdefgh ") for _ in range(250))
    rows = [(1, None), (2, ""), (None, a), (None, a), (5, a[:199]), (6, "z" * 199), (7, "q" * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text or "", len(r._kept)) for r in suffix_dedup(df).collect())
    assert got == sorted([(1, "", 0), (2, "", 0), (0, a, 0), (0, a, 0), (5, a[:199], 199), (6, "z" * 199, 199), (7, "q" * 200, 200)])
    assert suffix_dedup(df.limit(0)).count() == 0


def test_query_on_given_documents(spark):
    from rowcloak.llm.queries import op10_suffix_dedup
    import hashlib

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = {d.doc_id: x for d, x in zip(docs, brute([(d.text or "").encode() for d in docs], 200))}
    for r in op10_suffix_dedup(spark, "/root/testdata/sf0.001").collect():
        n, gone, runs, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, gone, runs, hashlib.sha256(kept).hexdigest())


def test_segments_cover_every_window_once():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    h, place, first, last = segments(data, 200, 64)
    assert sum(last - first + 1) == 5000 - 199 and (place >= first).all() is not None
    assert (place <= first + 136).all() and (place >= last).all()


def test_columns_against_brute_force():
    rng = random.Random(5)
    text = [bytes(rng.choice(b"ab") for _ in range(rng.randint(3, 9))) for _ in range(200)]
    lead = np.array([rng.randint(0, 3) for _ in text])
    group = np.sort(np.array([rng.randint(0, 9) for _ in text]))
    weight = np.array([1 + (rng.random() < .1) for _ in text])
    got = repeated(text, lead, group, weight, 3, 6)
    for i, t in enumerate(text):
        for j in range(6):
            w = t[j - lead[i]:j - lead[i] + 3] if j >= lead[i] else b""
            want = len(w) == 3 and (weight[i] > 1 or any(
                k != i and group[k] == group[i] and j >= lead[k] and text[k][j - lead[k]:j - lead[k] + 3] == w for k in range(len(text))))
            assert got[i, j] == want


def test_characters_cut_in_two_go_from_the_text(spark):
    shared = "é" * 100  # 200 bytes; a window of them ends inside the euro sign
    rows = [(1, "a" + shared + "€x"), (2, "b" + shared + "€y"), (3, "own"), (4, None)]
    got = {r.doc_id: (r._kept_text, bytes(r._kept)) for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("ax", b"ax"), 2: ("by", b"by"), 3: ("own", b"own"), 4: ("", b"")}
    rows = [(1, "a" + shared + "€"), (2, "b" + shared + "¥" + "z" * 3), (3, "c" + shared + "₭")]
    for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r._kept_text == bytes(r._kept).decode("utf-8", "ignore")
