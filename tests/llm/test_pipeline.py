import re

import numpy as np
import pytest

import corpus_pipeline as P
from test_exact_line import brute_lines
from test_near_dedup import brute as brute_near
from test_suffix_dedup import brute as brute_spans
from rowcloak.llm.queries import vocabulary


def brute(rows):
    from tokenizers import Tokenizer

    rows = sorted((d, t) for d, t in rows if t and re.search(r"[^\W\d_]", t))
    rows = [(r[0], r[1]) for r in brute_lines(rows, 40)]
    stay = set(brute_near(rows))
    rows = [r for r in rows if r[0] in stay]
    cut = brute_spans([t.encode() for _, t in rows], 200)
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    return {d: tok.encode(c[3].decode("utf-8", "ignore"), add_special_tokens=False).ids + [2] for (d, _), c in zip(rows, cut)}


def test_run_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want, got = brute([tuple(r) for r in docs]), {}
    for r in P.run(spark, "/root/testdata/sf0.001").orderBy("doc_id", "start").collect():
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert got == want and 0 < len(got) < len(docs)


ROWS = [(1, "Some words\nmore words", "en", "a", 0), (1, "Some words\nmore words", "en", "a", 0), (2, None, None, None, None), (3, "", "en", "b", 0),
        (None, "nothing is known here about that", None, None, 0), (5, "123", "en", "c", 3), (6, "bonjour le monde " * 500, "fr", "c", 3), (7, "a\nb\nc\na\nb\nc", "en", "c", 1)]


@pytest.mark.parametrize("case", ["rows", "empty", "no labels"])
def test_stages_keep_the_columns(spark, case):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").selectExpr(
        "*", "1 as _fp", "'x' as _hit", "2 as first", "3 as h", "4 as _row", "5 as _text", "6 as `a.b`")
    if case == "empty":
        docs = docs.limit(0)
    if case == "no labels":
        docs = docs.withColumn("lang", __import__("pyspark").sql.functions.lit(None).cast("string"))
    counts = []
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        docs = P.write_table(out, "test")
        counts.append(docs.count())
    pieces = P.packing(spark, docs, "").collect()
    if case == "empty":
        assert counts == [0] * 4 and not pieces
    else:
        assert counts == [5, 5, 4, 4] and {r.doc_id for r in pieces} == {1, None, 6, 7}


def test_languages_to_keep(spark):
    rows = [(i, t, k) for i, (t, k) in enumerate([("guten tag mein lieber freund", "de"), ("hello my good old friend", "en"), ("bonjour mon cher ami", "fr")] * 4)]
    docs = spark.createDataFrame([*rows, (99, "12 34", "de")], "doc_id long, text string, lang string")
    kept = lambda **more: {r.lang for r in P.language(spark, docs, "", **more).collect()}
    assert kept() == {"de", "en", "fr"} and kept(languages={"de", "xx"}) == {"de"} and kept(languages=set()) == set()
    assert kept(least_score=1.1) == set() and P.language(spark, docs, "").count() == 12


def test_a_cluster_needs_a_shared_folder():
    from rowcloak.llm.common import scratch_path

    class Conf(dict):
        def get(self, key, default=None):
            return super().get(key, default)

    class Session:
        conf = Conf({"spark.master": "yarn"})

    with pytest.raises(ValueError, match="checkpoint"):
        scratch_path(Session, "x")
