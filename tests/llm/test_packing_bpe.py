import numpy as np
import pytest
from pyspark.sql import functions as F

from rowcloak.llm.bpe import PairIndexBpe, bpe_decode, bpe_encode
from rowcloak.llm.packing import Plan, pack
from rowcloak.llm.queries import vocabulary

ODD = ["", None, "Hello  world's <|endoftext|>\n\n x", "é̈ İstanbul ΣΣ é", "aaaa aaaaaaaa  \u0085 \x1c\x1d a\x0bb",
       "\U0001f600\U0001f600 123 4567!!!", " ", "a" * 5000, "x y " * 3000, "퟿�  　z <|startoftext|>q"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 3}" if i % 4 else None, 1, 2) for i, t in enumerate(ODD)] + [(2, ODD[2], "s2", 0, 0), (None, "no id", "s1", 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, part int, ids int")


def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


@pytest.mark.parametrize("which", ["odd", "real", "empty"])
def test_bpe_equals_the_library(spark, docs, which):
    df = {"odd": docs, "real": real(spark), "empty": docs.limit(0)}[which].select("doc_id", "text")
    path = vocabulary("byte_bpe_50k.json")
    tok = library("byte_bpe_50k.json")
    rows = bpe_decode(bpe_encode(df, path), path).collect()
    assert len(rows) == df.count()
    for r in rows:
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["_ids"] == ids
        assert r["_decoded"] == tok.decode(ids, skip_special_tokens=False) == (r["text"] or "")


def test_pair_index_on_random_words():
    bpe, tok = PairIndexBpe(vocabulary("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("aehtin "), 12)) for _ in range(500)] + ["aaaaaaa", "ababab", "!!!!!!!!!!"]
    assert [np.frombuffer(x, "<i4").tolist() for x in bpe.encode(words)] == [tok.encode(w).ids for w in words]


def check_pieces(spark, df, size, **kw):
    tok = library("word_bpe_49k.json")
    rows = pack(df, vocabulary("word_bpe_49k.json"), size=size, **kw).collect()
    want, got = {}, {}
    for r in df.collect():
        want.setdefault(r["doc_id"], []).append(tok.encode(r["text"] or "", add_special_tokens=False).ids + [2])
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
    assert got.keys() == want.keys()
    for k, v in want.items():
        pieces = sorted(got[k], key=lambda r: r["start"])
        if len(v) == 1:
            assert sum((np.frombuffer(r["ids"], "<u4").tolist() for r in pieces), []) == v[0]
            assert {r["doc_tokens"] for r in pieces} == {len(v[0])}
    fill = {}
    for r in rows:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["queue"]))
    assert sorted(fill) == list(range(len(fill)))
    for w, spans in fill.items():
        at = 0
        for offset, length, _ in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at == size or w == len(fill) - 1
    assert sum(n for s in fill.values() for _, n, _ in s) == sum(len(x) for v in want.values() for x in v)
    return fill


@pytest.mark.parametrize("size", [64, 4096])
def test_packing_odd(spark, docs, size):
    check_pieces(spark, docs, size)


def test_packing_real_keeps_the_mixture(spark):
    df = real(spark)
    fill = check_pieces(spark, df, 4096)
    total = {}
    for s in fill.values():
        for _, n, q in s:
            total[q] = total.get(q, 0) + n
    whole = sum(total.values())
    for w in list(fill)[:max(1, len(fill) // 2)]:
        for q, n in total.items():
            have = sum(k for _, k, x in fill[w] if x == q)
            assert abs(have - 4096 * n / whole) < 8


def test_packing_targets_and_empty(spark, docs):
    fill = check_pieces(spark, real(spark), 512, targets={"src0": 0.75, "src1": 0.25})
    assert {q for _, _, q in fill[0]} == {"src0", "src1"}
    assert sum(n for _, n, q in fill[0] if q == "src0") == 384
    assert pack(docs.limit(0), vocabulary("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("targets", [None, {"h1": 0.7, "h2": 0.001, "b": 0.3}])
def test_packing_many_sources_share_queues(spark, targets):
    """Most sources have one short document, one has a third of all; the pieces stay gapless and whole."""
    many = spark.range(0, 900).select("id", F.lit("a few words").alias("text"), F.concat(F.lit("h"), "id").alias("source"))
    big = spark.range(900, 1350).select("id", F.lit("a few words").alias("text"), F.lit("b").alias("source"))
    df = many.unionByName(big).withColumnRenamed("id", "doc_id").repartition(7, "doc_id")
    check_pieces(spark, df, 256, targets=targets)


def test_plan_serves_every_token_once():
    for totals, weights in (([5, 1000, 3], [1, 1, 1]), ([100_000, 1, 7777], [.5, .001, .4]), ([0, 9], [0, 0]), ([300] * 60, [1 / 60] * 60)):
        plan, full = Plan(totals, weights, 128), {}
        for q, n in enumerate(totals):
            pieces = plan.pieces(q, 0, n) if n else []
            assert sum(p[1] for p in pieces) == n
            for _, k, w, o in pieces:
                full.setdefault(w, []).append((o, k))
        for w, spans in full.items():
            assert sum(k for _, k in spans) == 128 or w == max(full)
