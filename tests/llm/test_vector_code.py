"""op13 against a plain version in whole numbers."""

import hashlib
import random
from math import floor

import numpy as np
import pytest

from rowcloak.llm import vector_code
from rowcloak.llm.vector_code import books_digest, label_errors, nearest, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=4, entries=256, rounds=4):
    good = [(i, [floor(1024 * float(np.float32(x))) for x in v], c) for i, v, c in rows
            if v and all(x is not None and np.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(good[0][1]) // parts
    part = lambda v, p: v[p * width:(p + 1) * width]
    books = [[part(v, p) for _, v, _ in good[:entries]] for p in range(parts)]
    near = lambda x, b: min((sum((s - t) ** 2 for s, t in zip(x, e, strict=True)), k) for k, e in enumerate(b))
    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for _, v, _ in good:
                mine.setdefault(near(part(v, p), books[p])[1], []).append(part(v, p))
            books[p] = [[sum(c) // len(mine[k]) for c in zip(*mine[k], strict=True)] if k in mine else e for k, e in enumerate(books[p])]
    out = []
    for i, v, c in good:
        got = [near(part(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got), c))
    total = {}
    for _, _, e, c in out:
        total[c] = total.get(c, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, k, e, total[c]) for i, k, e, c in out), key=str), digest


def ours(spark, rows, **more):
    coded, books = vector_codes(spark.createDataFrame(rows, SCHEMA), **more)
    out = label_errors(coded)
    return sorted(((r.vec_id, r._code, r._error, r._label_error) for r in out.collect()), key=str), books_digest(books)


def vectors(n=160, dims=8, seed=4):
    rng = random.Random(seed)
    rows = [(i * 3 % 101, [rng.choice([0.0, -0.25, rng.uniform(-1, 1)]) for _ in range(dims)], rng.choice([0, 1, None])) for i in range(n)]
    rows += [rows[0]] * 40 + [(500, None, 1), (501, [1.0] * (dims - 1) + [None], 1), (502, [float("nan")] + [0.0] * (dims - 1), 0), (503, [float("-inf")] * dims, 0)]
    return rows


@pytest.mark.parametrize("entries", [256, 8])
def test_like_plain(spark, monkeypatch, entries):
    monkeypatch.setattr(vector_code, "HOT", 20)
    rows = vectors()
    assert ours(spark, rows, entries=entries) == brute(rows, entries=entries)


@pytest.mark.parametrize("leaves", [1, 3, 1024])
def test_trie(monkeypatch, leaves):
    monkeypatch.setattr(vector_code, "LEAVES", leaves)
    rng = np.random.default_rng(2)
    for n, dims in ((1, 1), (50, 1), (400, 3), (700, 6)):
        rows = np.unique(rng.integers(-4, 5, (n, dims)), axis=0)
        book = rng.integers(-5, 6, (17, dims))
        entry, distance = nearest(rows, book)
        every = ((rows[:, None] - book[None]) ** 2).sum(2)
        assert (entry == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert len(nearest(np.zeros((0, 3), np.int64), book)[0]) == 0


def test_edges(spark):
    assert ours(spark, [(1, None, 1), (2, [], 1)]) == ([], hashlib.sha256(b"").hexdigest())
    assert vector_codes(spark.createDataFrame([], SCHEMA))[0].count() == 0
    rows, _ = ours(spark, [(1, [0.5] * 8, None), (None, [0.5] * 8, None), (3, [0.5] * 4, 2), (4, [3e38] * 8, 7)])
    assert [r[:2] for r in rows] == [(1, "00000000"), (4, "01010101"), (None, "00000000")]
    five, books = vector_codes(spark.createDataFrame([(1, [0.5] * 5, 0), (2, [0.25] * 5, 0)], SCHEMA))
    assert {(r.vec_id, r._code) for r in five.collect()} == {(1, "00000000"), (2, "01010101")} and books[3].tolist() == [[0, 0], [0, 0]]
    wide = spark.createDataFrame([(1, [0.5] * 4, 0, "x", 2)], SCHEMA + ", _code string, `a.b` int")
    assert vector_codes(wide)[0].columns == ["vec_id", "embedding", "label", "a.b", "_code", "_error"]
