import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowcloak.llm.langid import DIM, SEGMENT, KernelModel, fit_language_model, predict_language, presence, segments, train_fold
from rowcloak.llm.queries import op9_langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = op9_langid(spark, "/root/testdata/sf0.1").join(docs.select("doc_id", "lang"), "doc_id")
    rows = out.where("held_out and lang is not null").collect()
    assert len(rows) > 1000
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def whole(text):
    return presence(np.concatenate([segments(text)[0], *(s[3:] for s in segments(text)[1:])]))


def test_segments():
    assert segments("") == segments("12 !?\n") == []
    one = presence(segments("Ab, aB")[0])
    assert (one == presence(segments("ab ab")[0])).all() and one.sum() <= 12
    text = "the quick brown fox " * 120_000
    parts = segments(text)
    assert len(parts) == round(len(text) / SEGMENT) and max(map(len, parts)) <= SEGMENT * 1.5 + 3
    assert (np.maximum.reduce([presence(p) for p in parts]) == whole("the quick brown fox " * 3)).all()
    assert segments("\U00020000") and not segments("\U0001f600")


def test_long_texts_with_noise(spark):
    """Two megabytes of English stay English with as much of random words behind them; with more the score falls."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = fit_language_model(docs.select("doc_id", "text", "lang"), train_fold())
    english = " ".join(r.text for r in docs.where("lang = 'en' and text is not null").orderBy("doc_id").limit(1_200).collect())[:2_000_000]
    rng = random.Random(1)
    noise = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(1_000_000))
    lang, score = model.predict([english, english + noise[:1_800_000], english + noise, noise])
    assert lang[:2] == ["en", "en"] and score[0] > 0.9 and score[1] > 0.5
    assert lang[2] == "en" or score[2] < 0.5
    assert score[0] > score[1] > score[2]


def test_ridge_against_dense_version():
    """With every row a landmark, the map is the kernel itself: the regression is solved here by gradients' zero."""
    rng = np.random.default_rng(3)
    x = (rng.random((12, DIM)) < 0.002 + 0.05 * (rng.random(DIM) < 0.02)).astype(np.uint8)
    labels = ["a", "b", "b"] * 4
    model = KernelModel.fit(x, labels, landmarks=12, ridge=1e-2)
    k = np.array([[(p & q).sum() / np.sqrt(float(p.sum()) * float(q.sum())) for q in x] for p in x])
    y = np.array([[1.0 if c == m else -1.0 for m in "ab"] for c in labels])
    share = np.array([1 / labels.count(c) for c in labels])
    values, vectors = np.linalg.eigh(k)
    phi = np.hstack([vectors * np.sqrt(np.maximum(values, 0)), np.ones((12, 1))])  # K^(1/2): the same inner products
    beta = np.linalg.lstsq(np.vstack([phi * np.sqrt(share)[:, None], np.sqrt(1e-2) * np.eye(13)]), np.vstack([y * np.sqrt(share)[:, None], np.zeros((13, 2))]), rcond=None)[0]
    assert np.allclose(model.decide(x), phi @ beta, atol=1e-3)


def test_kernel_against_sets():
    texts = ["abab", "abba", "xyz"]
    x = np.stack([presence(segments(t)[0]) for t in texts]).astype(np.float32)
    assert x.shape[1] == DIM

    def grams(t):
        t = f" {t} "
        return {t[i:i + n] for n in range(1, 5) for i in range(len(t) - n + 1)}

    k = KernelModel.kernel(x, x)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            A, B = grams(a), grams(b)
            assert abs(k[i, j] - len(A & B) / np.sqrt(len(A) * len(B))) < 0.1


def test_edges(spark):
    rows = [(1, "guten tag mein freund", "de", "x"), (2, "hello my friend there", "en", None), (2, "hello my friend there", "en", None),
            (3, None, "en", "x"), (4, "", None, "x"), (5, "123 ...", "de", "x"), (None, "hello there", "en", "x"), (7, "guten freund", None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, _score string")
    model = fit_language_model(df, F.lit(True))
    got = {(r.doc_id, r._lang_pred) for r in predict_language(df, model).collect()}
    assert got == {(1, "de"), (2, "en"), (3, "und"), (4, "und"), (5, "und"), (None, "en"), (7, "de")}
    assert fit_language_model(df.limit(0), train_fold()) is None
    assert {r._lang_pred for r in predict_language(df, None).collect()} == {"und"}
    assert predict_language(df.limit(0), model).count() == 0


def test_all_of_many_languages_are_learned(spark):
    """90 languages, each with letters of its own; one has a single row, one a very long text."""
    def word(k):
        return "".join(chr(0x4E00 + 40 * k + i) for i in range(6))

    rows = [(100 * k + i, f"{word(k)} {word(k)[::-1]} {i}", f"l{k}") for k in range(90) for i in range(1 if k == 7 else 5)]
    rows.append((99_999, word(3) * 50_000, "l3"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_language_model(df, F.lit(True), sample=200)  # two rows a language
    assert len(model.langs) == 90 and len(model.marks) == 179
    assert predict_language(df, model).where("lang <> _lang_pred").count() == 0


def test_too_many_languages_are_an_error(spark):
    df = spark.range(4_001).selectExpr("id as doc_id", "'text' as text", "cast(id as string) as lang")
    with pytest.raises(ValueError):
        fit_language_model(df, F.lit(True))
