"""Profiles from sketches, one scan each; inclusions of many pairs at once; capped children and reverse indexes by their plans."""

import random

import pytest
from pyspark.sql import functions as F

from rowcloak.model import ForeignKey, RelationalModel, TableSpec
from rowcloak.operators.closure import capped, child_keys, closure, keyset_counts, root_keys
from rowcloak.operators.integrity import inclusion_profile, inclusions
from rowcloak.operators.profile import ProfileStore, profile_frame
from rowcloak.operators.scan import scan_frame
from rowcloak.sources.indexes import build_indexes, open_indexes


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(500).selectExpr("id", "cast(id % 7 as string) as s", "id / 3 as x", "if(id % 2 = 0, null, id) as gap", "array(id % 5) as a", "concat('u', id, '@mail.org') as t").write.parquet(path)
    df = spark.read.parquet(path)
    facts = profile_frame(df, "t")
    assert plan(facts).count("FileScan") == 1
    assert {r.column_name: (r.n_rows, r.n_null, r.n_distinct, r.max_length) for r in facts.collect()} == {
        "id": (500, 0, 500, None), "s": (500, 0, 7, 1), "x": (500, 0, 500, None), "gap": (500, 250, 250, None), "a": (500, 0, 5, None), "t": (500, 0, 500, 13)}
    assert [tuple(r) for r in profile_frame(df.limit(0), "t").select("n_rows", "n_null", "n_distinct").distinct().collect()] == [(0, 0, 0)]
    found = scan_frame(df, "t", ["id"], sample=3)
    assert plan(found).count("FileScan") == 1
    assert [tuple(r) for r in found.collect()] == [("t", "t", "email", 3, "u0@*****org")]
    assert scan_frame(df, "t", ["id"], sample=10_000).first().matches == 500


def test_store_reads_new_files_only(spark, tmp_path):
    path, store = str(tmp_path / "t"), ProfileStore(str(tmp_path / "store"))
    rows = spark.range(6_000).selectExpr("id", "cast(id % 13 as double) as x", "if(id % 10 = 0, null, cast(id % 900 as string)) as s", "cast(id % 100 as byte) as b", "named_struct('k', id % 3) as n", "date_add(date'2020-01-01', cast(id % 40 as int)) as d")
    with pytest.raises(ValueError, match="nothing on t"):
        store.profile(rows, "t")
    rows.where("id < 4000").repartition(3).write.parquet(path)
    assert len(store.update(spark.read.parquet(path), "t")) == 3
    rows.where("id >= 4000").coalesce(1).write.mode("append").parquet(path)
    df = spark.read.parquet(path)
    assert len(store.update(df, "t")) == 1 and store.update(df, "t") == []
    got = {r.column_name: r for r in store.profile(df, "t").collect()}
    exact = {r.column_name: r for r in profile_frame(df, "t").collect()}
    for c, r in exact.items():
        assert (got[c].n_rows, got[c].n_null, got[c].max_length, got[c].type) == (r.n_rows, r.n_null, r.max_length, r.type)
        assert abs(got[c].n_distinct - r.n_distinct) <= 0.05 * r.n_distinct + 1
    assert abs(got["id"].quartiles[1] - 3000) < 150 and got["x"].quartiles[1] in (5.0, 6.0, 7.0) and got["s"].quartiles is None
    one = spark.read.parquet(df.inputFiles()[0])
    assert {r.n_rows for r in store.profile(one, "t").collect()} == {one.count()}  # of those files alone


def test_inclusions_like_single_ones(spark):
    a = spark.range(60).selectExpr("id", "id % 11 as x", "cast(id % 20 as double) as y", "if(id < 0, id, null) as never", "cast(id % 4 as string) as t")
    p, q = spark.range(5, 30).selectExpr("cast(id as int) as k"), spark.range(3).selectExpr("cast(id as string) as k")
    m = RelationalModel([TableSpec("a", a, ("id",)), TableSpec("p", p, ("k",)), TableSpec("q", q, ("k",)), TableSpec("r", spark.range(9), ("id",))])
    pairs = [("a", "x", "p", "k"), ("a", "x", "r", "id"), ("a", "y", "p", "k"), ("a", "t", "q", "k"), ("a", "never", "p", "k"), ("p", "k", "a", "id")]
    out = inclusions(m, pairs)
    assert plan(out).count("Join") <= 1
    got = {(r.table_name, r.column_name, r.guess): (r.n_distinct, r.n_contained) for r in out.collect()}
    want = {}
    for c, col, g, ref in pairs:
        for r in inclusion_profile(m, c, col, g, ref).collect():
            want[c, col, g] = (r.n_distinct, r.n_contained)
    assert got == want and len(got) == 5 and inclusions(m, []).count() == 0


def test_capped_children(spark):
    rng = random.Random(4)
    data = [(rng.choice([0, 0, 0, 0, 1, 2, rng.randrange(3, 40)]), i * 7919 % 1009) for i in range(700)]
    df = spark.createDataFrame(data, "v long, k long")
    for limit in (1, 5, 300, 10_000):
        want = sorted((v, k) for v in {v for v, _ in data} for k in sorted(k for w, k in data if w == v)[:limit])
        assert sorted(map(tuple, capped(df, ["v"], ["k"], limit).collect())) == want
    assert capped(df, ["v"], ["k"], None) is df and capped(df, ["v"], ["k"], 0).count() == 700
    hot = spark.range(40_000).selectExpr("id % 2 as v", "id as k")
    assert "Window" not in plan(capped(hot, ["v"], ["k"], 50_000))
    kept = capped(hot, ["v"], ["k"], 900)
    assert {r.v: (r.n, r.m) for r in kept.groupBy("v").agg(F.count("*").alias("n"), F.max("k").alias("m")).collect()} == {0: (900, 1798), 1: (900, 1799)}


def test_index_leaves_its_table_where_it_is(spark, tmp_path):
    p = spark.range(300)
    c = spark.range(9_000).selectExpr("id", "if(id % 3 = 0, 7, id % 300) as p_id", "if(id % 2 = 0, 'x', 'y') as kind")
    fks = [ForeignKey("c", ("p_id",), "p", ("id",), when="kind = 'x'"), ForeignKey("c", ("id",), "p", ("id",))]
    m = RelationalModel([TableSpec("p", p, ("id",)), TableSpec("c", c, ("id",))], fks)
    folder = str(tmp_path / "index")
    build_indexes(m, folder, [m.fks[0], m.fks[1]], rows=1_000)
    index = open_indexes(spark, m, folder)
    roots = root_keys(m, "p", "id in (5, 7, 250)")
    plain, fast = (closure(m, "p", roots, 1, child_limit=limit, index=i) for limit, i in ((None, None), (None, index)))
    counts = lambda k: {r.table_name: r.n_keys for r in keyset_counts(k).collect()}
    assert counts(plain) == counts(fast) and plain["c"].select("id").exceptAll(fast["c"].select("id")).isEmpty()
    by = next(f for f in m.fks if f.when)
    cool, hot = index.children(by)
    assert hot.select("p_id").distinct().collect() == [(7,)] and cool.where("p_id = 7").isEmpty() and cool.count() + hot.count() == 4_500
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        asked = spark.range(200).selectExpr("id as _r0").distinct()
        joined = plan(cool.join(asked, F.col("p_id") == F.col("_r0"), "left_semi"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan_side = joined.split("SortMergeJoin")[1] if "SortMergeJoin" in joined else joined
    assert "SelectedBucketsCount" in joined and scan_side.count("Exchange") <= 1  # the asked values alone
    assert open_indexes(spark, RelationalModel([TableSpec("p", p, ("id",)), TableSpec("c", c.withColumn("more", F.lit(1)), ("id",))], [*fks, ForeignKey("c", ("more",), "p", ("id",))]), folder).parts == {}


def test_child_keys_of_a_hot_parent(spark):
    m = RelationalModel([TableSpec("p", spark.range(2), ("id",)), TableSpec("c", spark.range(50_000).selectExpr("id", "0 as p_id"), ("id",))], [ForeignKey("c", ("p_id",), "p", ("id",))])
    assert child_keys(m, m.fks[0], root_keys(m, "p"), 20_000).agg(F.count("*"), F.max("id")).first() == (20_000, 19_999)


def test_filters_leave_rows_out_before_the_shuffle(spark, monkeypatch):
    from rowcloak.operators import filters
    from rowcloak.operators.filters import ValueFilter

    big = spark.range(200_000).selectExpr("if(id % 50 = 0, null, id) as v", "cast(id % 3 as string) as w")
    asked = spark.range(0, 200_000, 100).selectExpr("id + 1 as _r0", "cast((id + 1) % 3 as string) as _r1")
    kept = ValueFilter(asked, ["_r0", "_r1"], 2_000).keep(big, ["v", "w"])
    assert kept.columns == ["v", "w"] and "SortMergeJoin" not in plan(kept)
    n = kept.count()
    assert 2_000 <= n < 2_000 + 200_000 / 8 and kept.join(asked, (F.col("v") == F.col("_r0")) & (F.col("w") == F.col("_r1"))).count() == 2_000
    assert ValueFilter(asked.where("false"), ["_r0"], 0).keep(big, ["v"]).count() == 0
    p, c = spark.range(500), spark.range(5_000).selectExpr("id", "if(id % 9 = 0, null, id % 500) as p_id", "id % 7 as q")
    m = RelationalModel([TableSpec("p", p, ("id",)), TableSpec("c", c, ("id",))], [ForeignKey("c", ("p_id",), "p", ("id",))])
    roots = root_keys(m, "p", "id < 40", limit=None)
    plain = closure(m, "p", roots, 1)["c"].select("id", "depth", "via")
    monkeypatch.setattr(filters, "FEW", 0)
    filtered = closure(m, "p", roots, 1)["c"].select("id", "depth", "via")
    assert plain.exceptAll(filtered).isEmpty() and plain.count() == filtered.count() > 300


def test_columns_are_counted_apart(spark):
    """No row goes on once for each column (an Expand), with nulls, an empty table and a nested column."""
    from rowcloak.operators.profile import profile

    df = spark.createDataFrame([(1, "ab", [1]), (2, None, [1]), (2, "b", None)], "a long, t string, xs array<int>")
    out = profile(RelationalModel([TableSpec("x", df)]))
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
    facts = lambda o: {r.column_name: tuple(r)[3:] for r in o.collect()}
    assert facts(out) == {"a": (3, 0, 2, None), "t": (3, 1, 2, 2), "xs": (3, 1, 1, None)}
    assert facts(profile(RelationalModel([TableSpec("x", df.where("a > 9"))]))) == {"a": (0, 0, 0, None), "t": (0, 0, 0, None), "xs": (0, 0, 0, None)}
