import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowcloak.llm import lm_score as L
from rowcloak.llm.queries import op1_lm_score


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w] + [None]


def brute(rows, order, rounds=30):
    """The same model with dictionaries."""
    fold = lambda d: zlib.crc32(str(d).encode()) % 7 if d is not None else 0

    def count(docs):
        c, n = Counter(), 0
        for _, t in docs:
            line = ["<s>"] * (order - 1 or 1) + words(t)
            pad = order - 1 or 1
            for i in range(pad - 1, len(line)):
                for k in range(1, order + 1):
                    if i - k + 1 >= 0 and (i >= pad or k < order):
                        c[tuple(line[i - k + 1:i + 1])] += 1
            n += len(line) - pad
        types = {g for g in c if len(g) == 1 and g != ("<s>",)}
        return c, n, len(types)

    def parts(t, c, n, v):
        pad = order - 1 or 1
        line = ["<s>"] * pad + words(t)
        for i in range(pad, len(line)):
            p, b = [1 / (v + 1), c[(line[i],)] / max(n, 1)], 0
            for k in range(2, order + 1):
                ctx = c[tuple(line[i - k + 1:i])]
                p.append(c[tuple(line[i - k + 1:i + 1])] / max(ctx, 1))
                if ctx:
                    b = (k - 2) * L.BUCKETS + 1 + min(int(math.log2(ctx)), L.BUCKETS - 1)
            yield np.array(p), b

    train = [r for r in rows if fold(r[0]) != 2]
    c, n, v = count([r for r in train if fold(r[0]) != 3])
    held = [x for r in train if fold(r[0]) == 3 for x in parts(r[1], c, n, v)]
    size = (order - 1) * L.BUCKETS + 1
    w, before = np.full((size, order + 1), 1 / (order + 1)), -np.inf
    for _ in range(rounds if held else 0):
        total, like = np.zeros_like(w), 0
        for p, b in held:
            x = w[b] * p
            like += math.log(x.sum())
            total[b] += x / x.sum()
        total += 1e-3
        w = total / total.sum(1, keepdims=True)
        if like - before < 1e-5 * abs(like):
            break
        before = like
    c, n, v = count(train)
    out = []
    for d, t in rows:
        ws = words(t)
        out.append((d, fold(d) == 2, len(ws), sum(c[(x,)] > 0 for x in ws), n, sum(math.log10((c[(x,)] + 1) / (n + v + 1)) for x in ws),
                    sum(math.log10(float(w[b] @ p)) for p, b in parts(t, c, n, v))))
    return out


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:5] == y[:5]
        assert x[5] == pytest.approx(y[5], rel=1e-9) and x[6] == pytest.approx(y[6], rel=1e-4)


@pytest.mark.parametrize("order, blocks", [(1, None), (2, None), (3, None), (2, 3), (3, 40)])
def test_against_dictionaries(spark, order, blocks, monkeypatch):
    monkeypatch.setattr(L, "CHUNK_BYTES", 3000)
    texts = ["The cat sat on the mat", "the cat  sat\non the\x0bhat", "a dog", None, "", "THE dog sat on the cat É é", "x " * 900, "the cat sat"] * 6
    rows = [(i if i != 5 else None, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, score int, part string")
    got = [tuple(r) for r in L.lm_score(df, *L.folds(), order=order, blocks=blocks).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    close(sorted(got, key=key), sorted(brute(rows, order), key=key))


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = sorted(tuple(r) for r in op1_lm_score(spark, "/root/testdata/sf0.001").collect())
    close(got, sorted(brute(rows, L.ORDER)))
    held = [r for r in got if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)  # better than the base on texts not learned from


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    assert L.lm_score(df.limit(0), *L.folds()).count() == 0
    r = L.lm_score(df, F.lit(True), F.lit(False)).collect()
    assert len(r) == 3 and all(x.train_tokens == 0 and x.n_known == 0 and math.isfinite(x.score) for x in r)


def test_rows_sent_in_two_levels(spark, monkeypatch):
    """Of many chunks far fewer rows are sent by blocks than from each chunk to each bucket."""
    monkeypatch.setattr(L, "CHUNK_BYTES", 2000)
    docs = spark.range(400).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 300), i -> cast(xxhash64(id, i) AS string))) AS text").repartition(4)
    chunks = L.split_chunks(docs, F.lit(True), F.lit(False)).cache()
    n = chunks.count()
    assert n >= 400
    one, two = (L.corpus_counts(chunks, 2, 100, b) for b in (1, 20))
    exact = lambda df: sum(r.stats[0] for r in df.where("chunk = -1").collect())
    assert exact(one) == exact(two) == 400 * 301
    rows = lambda df: df.where("chunk >= 0").count()
    assert rows(one) > 90 * n and rows(two) <= 5 * n


def test_heavy_tables_have_small_row_groups(spark):
    """A reader holds a row group's values at once; by default no group ends before its hundredth row."""
    import os

    import pyarrow.parquet as pq

    from rowcloak.llm.common import write_table

    big = spark.range(30).selectExpr("id", "array_join(transform(sequence(1, 16000), x -> sha2(cast(id * 16000 + x as string), 256)), '') as text").coalesce(1)
    for heavy, most in ((False, 30), (True, 29)):
        made = write_table(big, "heavy", heavy=heavy)
        groups = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in made.inputFiles()]
        assert max(m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)) <= most and made.count() == 30
