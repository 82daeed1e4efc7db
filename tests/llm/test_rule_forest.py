"""op12: counts against a plain version, and what the forest drops and keeps."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rowcloak.llm.rule_forest import COUNTS, calibrated, count_rules, fit_rule_forest, grow, judge_rules, usual_depth

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHOWN = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def brute(text):
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


TEXTS = ["", " ", "\n\n", "a", "a b", "a b c", "a b c a b c", "a a a a", "x\nx\n x\nx", "é ü\x0bö\x85ä #*$%&|<>", "a\n\na\n", "日本 語 日本 語 日本 語\n日本 語",
         "one two three four\n" * 3, " ", "a b\nc a b\nc", "Z" * 3000 + " y"]


@pytest.mark.parametrize("order", [1, -1])
def test_counts(order):
    rng = random.Random(3)
    texts = (TEXTS + ["".join(rng.choice("ab \n#é") for _ in range(rng.randrange(60))) for _ in range(300)])[::order]
    got = count_rules(pa.array([t.encode() for t in texts], pa.binary()))
    assert got[:, [COUNTS.index(c) for c in SHOWN]].tolist() == [brute(t) for t in texts]
    assert count_rules(pa.array([], pa.binary())).shape == (0, len(COUNTS))


def prose(rng, n=120):
    return " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9))) + rng.choice(["", "", ".", ","]) for _ in range(n))


def labelled():
    rng = random.Random(5)
    rows = [(i, prose(rng), 1) for i in range(240)]
    rows += [(1000 + i, re.sub(r" ", "### ", prose(rng)), 0) for i in range(25)] + [(2000 + i, prose(rng).upper().replace(" ", "!! "), 0) for i in range(15)]
    return rows


def test_forest_drops_bad_and_keeps_good(spark):
    rows = labelled()
    learn = [r for r in rows if r[0] % 2]
    labels = spark.createDataFrame([(i, q) for i, _, q in learn], "doc_id long, quality int")
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    out = {r.doc_id: r for r in judge_rules(docs, fit_rule_forest(docs, labels)).collect()}
    held = [r for r in rows if not r[0] % 2]
    assert all(out[i]._kept for i, _, q in held if q) and not any(out[i]._kept for i, _, q in held if not q)
    assert all(out[i]._n_words == 120 and not out[i]._base_failed for i, _, _ in rows)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "k"), (1, None, "k"), (2, "", "k"), (3, "w " * 60, "k"), (4, " ".join(f"w{i}" for i in range(60)), "k"), (None, "x", "k")], "doc_id long, text string, _kept string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert fit_rule_forest(docs, labels) is None
    assert fit_rule_forest(docs.where("false"), spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, quality int")) is None
    out = judge_rules(docs, None)
    got = sorted(((r.doc_id or 0, r._n_words, r._base_failed, r._kept) for r in out.collect()))
    assert got == [(0, 1, True, False), (1, 0, True, False), (1, 0, True, False), (2, 0, True, False), (3, 60, True, False), (4, 60, False, True)]
    assert judge_rules(docs.where("false"), None).count() == 0 and out.columns.count("_kept") == 1


def test_isolation_tree():
    rng = np.random.default_rng(1)
    rows = np.vstack([rng.normal(size=(63, 2)), [[50.0, 50.0]]])
    feature, split, child, length = grow(rows, rng)
    assert (feature >= 0).sum() * 2 + 1 == len(feature)
    depth = {0: 0}
    for at in range(len(feature)):
        if feature[at] >= 0:
            depth[child[at]] = depth[child[at] + 1] = depth[at] + 1
        else:
            assert length[at] >= depth[at]
    assert max(depth.values()) <= 6 and np.isclose(usual_depth(2), 1) and usual_depth(1) == 0


def test_threshold():
    assert 0.5 < calibrated(np.array([0.4, 0.5]), np.array([0.7, 0.8]), 0.99) < 0.7
    assert calibrated(np.array([0.4, 0.9]), np.array([0.7, 0.8]), 0.99) >= 0.9
    assert calibrated(np.array([]), np.array([0.5]), 0.99) == 1.0
