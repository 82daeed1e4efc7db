"""Exact and line deduplication against plain versions."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from rowcloak.llm.exact_dedup import DigestIndex, exact_dedup
from rowcloak.llm.line_dedup import later_copies, line_dedup, numbered, ranked, repeated_runs, sequences, suffix_array

NORM = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
SCHEMA = "doc_id long, text string, digest string, copies int, _kept int, line int, rank long, start int, n string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, 2, 3, 4, 5, None) for d, t in rows], SCHEMA)


def brute_exact(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(NORM(t), []).append(d)
    out = []
    for d, t in rows:
        ids = groups[NORM(t)]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((d, keep, len(ids), d == keep, hashlib.sha256(NORM(t).encode()).hexdigest()))
    return out


ROWS = [(3, "a  b"), (1, "a\tb"), (2, "a b "), (4, None), (5, ""), (None, "a\nb"), (None, "only null ids"), (None, "only null ids"), (7, "é " * 5000), (8, "é "), (9, "é " * 5000),
        (1, "a b"), (10, "\x0b\x0c"), (11, " ")] + [(100 + i, f"copy {i % 3}") for i in range(60)]


@pytest.mark.parametrize("weak", [False, True])
def test_exact(spark, weak):
    digest = (lambda t: F.unhex(F.lpad(F.hex(F.pmod(F.crc32(t.cast("binary")), F.lit(3))), 2, "0"))) if weak else None
    df = frame(spark, ROWS).repartition(5)
    got = [(r.doc_id, r._keep_id, r._group_size, r._kept, r._text_sha256) for r in exact_dedup(df, digest).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_exact(ROWS)))
    assert exact_dedup(df.limit(0)).count() == 0


def test_index_levels(spark, tmp_path):
    """Three levels, one row a digest whatever is compacted; a compaction passes what no other run's filter knows."""
    index = DigestIndex(spark, str(tmp_path), fanout=2, memtables=3)
    rows = [[(b"k1", 5), (b"k2", 9), (b"k1", 7)], [(b"k1", 3)], [(b"k3", 1), (b"k1", 4)], [(b"k2", 2)], [(b"k9", 6)]]
    for batch in rows:
        run = index.flush(spark.createDataFrame([(k, d, 1) for k, d in batch], "digest binary, doc_id long, copies long").repartition(3))
        assert not index.levels[0] and run.entries().count() == len({k for k, _ in batch})
    assert [len(x) for x in index.levels] == [0, 1, 0, 1]
    assert {(bytes(r.digest), r.doc_id, r.copies) for r in index.entries().collect()} == {(b"k1", 3, 4), (b"k2", 2, 2), (b"k3", 1, 1), (b"k9", 6, 1)}
    asked = spark.createDataFrame([(b"k1",), (b"k4",), (b"k9",)], "digest binary")
    assert sorted(bytes(r.digest) for r in index.find(index.runs(), asked).collect()) == [b"k1", b"k9"]
    many = spark.range(2000).selectExpr("unhex(sha2(cast(id as string), 256)) as digest")
    assert index.runs()[0].mark(many, "digest", "may").where("may").count() < 40
    assert index.flush(spark.createDataFrame([], "digest binary, doc_id long, copies long")) is None


@pytest.mark.parametrize("weak", [False, True])
def test_batches_through_one_index(spark, tmp_path, weak):
    """Each batch is answered as if the batches up to it were one table."""
    digest = (lambda t: F.unhex(F.lpad(F.hex(F.pmod(F.crc32(t.cast("binary")), F.lit(3))), 2, "0"))) if weak else None
    index = DigestIndex(spark, str(tmp_path), fanout=2)
    batches = [[(1, "x y"), (9, "only here"), (8, None)], [(3, "x  y"), (2, "new"), (4, "new")], [], [(0, "x\ty"), (5, ""), (None, "new")] + [(50 + i, "new") for i in range(20)]]
    seen = []
    for rows in batches:
        seen += rows
        want = brute_exact(seen)[len(seen) - len(rows):]
        df = frame(spark, rows or [(1, "")]).where(F.lit(bool(rows)))
        got = [(r.doc_id, r._keep_id, r._group_size, r._kept, r._text_sha256) for r in exact_dedup(df, digest, index).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))


def brute_lines(rows, n):
    """Windows of n characters that also stand earlier, and what is left of each text; rows with equal id and text are one."""
    order = sorted(set((d is None, d or 0, hashlib.md5((t or "").encode()).digest(), t or "") for d, t in rows))
    seen, gone = set(), {}
    for null, d, _, t in order:
        lines, out = t.split("\n"), set()
        full = [(i, x, len(re.sub("[\x20\x09-\x0d]", "", x))) for i, x in enumerate(lines)]
        full = [x for x in full if x[2]]
        for p in range(len(full)):
            total, e = 0, p
            while e < len(full) and total < n:
                total, e = total + full[e][2], e + 1
            if total >= n:
                w = tuple(x[1] for x in full[p:e])
                if w in seen:
                    out |= set(range(full[p][0], full[e - 1][0] + 1))
                seen.add(w)
        gone[null, d, t] = out
    res = []
    for d, t in rows:
        out, lines = gone[d is None, d or 0, t or ""], (t or "").split("\n")
        runs = sum(i in out and i - 1 not in out for i in range(len(lines)))
        res.append((d, "\n".join(x for i, x in enumerate(lines) if i not in out), len(lines), len(out), runs))
    return res


def texts(seed):
    rng = random.Random(seed)
    line = lambda: rng.choice(["a", "b", "c", "dd", "ee e", " ", "", "\tf", "gggg"])
    return [(None if i == 7 else i // 2 if i % 9 == 0 else i, "\n".join(line() for _ in range(rng.randint(0, 14)))) for i in range(60)] + [
        (200, None), (201, ""), (202, "\n\n\n\n\n\n"), (203, "a\n" * 2000), (204, "long " * 20_000), (205, "long " * 20_000), (1, "x\ny\nz"), (1, "x\ny\nz"), (300, "x\ny\nz"),
        (206, "b\n \n\n" * 50), (207, "b\n \n\n" * 60)]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 40])
def test_lines(spark, n):
    rows = texts(n)
    got = [(r.doc_id, r._kept_text, r._n_lines, r._n_removed, r._n_runs) for r in line_dedup(frame(spark, rows), n).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_lines(rows, n)))


def test_lines_edges(spark):
    none = frame(spark, [(1, "a")]).limit(0)
    assert line_dedup(none).count() == 0 and repeated_runs(none).count() == 0
    two = frame(spark, [(1, "a\nb\n\nc\nd"), (2, "a\nb\n\nc\nd")])
    starts = later_copies(two, 3).collect()
    assert sorted((r._ord, r.line, r.last, r.k) for r in starts) == [(2, 0, 3, 3), (2, 1, 4, 3)]
    assert [(r._ord, r.start, r.n_lines) for r in repeated_runs(two, 3).collect()] == [(2, 0, 5)]
    assert repeated_runs(two, 5).count() == 0


def test_sequences(spark):
    """How many lines a suffix asks for, up to as many as characters."""
    rows = sequences(frame(spark, [(1, "ab\n\n c \nabcd\ne")]), 4).orderBy("i").collect()
    assert [(r.i, r.line, r.last, r.k) for r in rows] == [(0, 0, 3, 3), (1, 2, 3, 2), (2, 3, 3, 1), (3, 4, None, None)]


def test_hot_lines_are_dealt(spark):
    """One line in every document, over HOT of them; it stays in the first."""
    rows = [(i, f"{'very common ' * 5}\nown line {i} {'x' * 40}\nshort\nlines\n{'and a' * 8}") for i in range(2_500)]
    out = line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("_n_removed").count().collect()
    assert {(r[0], r[1]) for r in out} == {(0, 1), (4, 2_499)}


def test_ranks_are_places_in_the_suffix_array(spark):
    classes = spark.createDataFrame([(k, n) for k, n in zip("cabed", (2, 5, 3, 2, 9))], "k1 string, n long")
    assert {r.k1: r["rank"] for r in ranked(classes, ["k1"]).collect()} == {"a": 0, "b": 5, "c": 8, "d": 10, "e": 19}


def test_the_suffix_array_is_whole(spark):
    """Every suffix has its place, however many lines it takes to tell it, and every place its common prefix with the one in front."""
    rng = random.Random(4)
    long = [f"{i % 7}{'x' * 50}" for i in range(70)]  # windows of one line, common prefixes of up to 70
    made = [long, long[:40] + ["other"], ["own"] + long, long[35:], ["a"] * 33, [], ["once"], long] + [[rng.choice("ab") * 45 for _ in range(rng.randint(1, 20))] for _ in range(12)]
    rows = [(i, "\n".join(x)) for i, x in enumerate(made)]
    array, prefixes = suffix_array(sequences(frame(spark, rows + rows[:1]), 40).localCheckpoint())
    ids = lambda x: [hashlib.md5(y.encode()).digest() for y in x]
    want = sorted((ids(x)[i:], d, i) for d, x in enumerate(made) for i in range(len(x)))
    got = array.orderBy("rank", "_ord", "i").collect()
    assert [(r._ord, r.i) for r in got] == [x[1:] for x in want] and max(r.h for r in got) == 128
    common = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    equal = [p > 0 and want[p][0] == want[p - 1][0] for p in range(len(want))]
    assert [r.head for r in got] == [not x for x in equal]
    lcp, heads = {r["rank"]: r.lcp for r in prefixes.collect()}, [p for p in range(len(want)) if p and not equal[p]]
    assert [lcp.get(got[p]["rank"], 0) for p in heads] == [common(want[p - 1][0], want[p][0]) for p in heads]


def test_numbers_within_a_group_that_spans_partitions(spark):
    rng = random.Random(2)
    rows = sorted((g, k, rng.randint(1, 5)) for g, size in enumerate((1, 400, 3, 250, 1, 90)) for k in range(size))
    dealt = spark.createDataFrame([(*r, n // 150) for n, r in enumerate(rows)], "g int, k int, n int, _part int").selectExpr("*", "struct(g, k) as first")
    got = {(r.g, r.k): (r["rank"], r.before and tuple(r.before)) for r in numbered(dealt, ["g", "k"], "g").collect()}
    assert got == {(g, k): (sum(n for a, b, n in rows if a == g and b < k), (g, k - 1) if k else None) for g, k, _ in rows}
