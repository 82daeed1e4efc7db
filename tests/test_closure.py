import pytest
from fixtures import CANARIES, RULES, kitchen_sink

from rowcloak.model import ForeignKey, ModelError, RelationalModel, TableSpec
from rowcloak.operators.closure import closure, fit_preset, in_sample, keyset_counts, load_keys, preset_estimates, read_slice, root_keys, save_keys
from rowcloak.operators.integrity import assert_referential, orphan_counts
from rowcloak.operators.masking import Classifier
from rowcloak.operators.scan import canary_counts, scan
from rowcloak.operators.slicing import slice_model, sliced
from rowcloak.scratch import scratch_path
from rowcloak.sources.tables import star_model


@pytest.fixture(scope="module")
def model(spark):
    return kitchen_sink(spark)


def counts(keys):
    return {r.table_name: r.n_keys for r in keyset_counts(keys).collect()}


def test_depths_of_a_cyclic_schema(spark, model):
    one = root_keys(model, "users", "id = 5")
    assert counts(closure(model, "users", one, 0)) == {"users": 2, "companies": 2}  # company, its owner, manager, and theirs
    keys = closure(model, "users", one, 1)
    assert counts(keys)["users"] == 12 and counts(keys)["events"] == 2 and counts(keys)["comments"] == 2
    depth = {r.id: r.depth for r in keys["users"].collect()}
    assert depth[5] == depth[1] == 0 and depth[6] == 1
    again = closure(model, "users", keys["users"], 0)
    assert counts(again)["users"] == 12


def test_sizes_over_the_star_schema(spark):
    m = star_model(spark, "/root/testdata/sf0.01")
    # measured sizes of the supplied data: customers 0-4 at depth 0 and 1
    assert counts(closure(m, "customer", root_keys(m, "customer", limit=5), 0)) == {"region": 4, "nation": 4, "customer": 5}
    assert counts(closure(m, "customer", root_keys(m, "customer", limit=5), 1)) == {"region": 4, "nation": 20, "customer": 274, "supplier": 17, "orders": 50, "events": 331}


def test_a_slice_is_referential_and_masked(spark, model):
    frames = slice_model(model, "users", "seed", where="id in (2, 7)", child_depth=2, classifier=Classifier(RULES), strict=True)
    cut = sliced(model, frames)
    assert_referential(cut)
    assert sum(r.n_rows for r in canary_counts(cut, CANARIES).collect()) == 0
    assert sum(r.n_rows for r in canary_counts(model, CANARIES).collect()) > 20
    assert scan(cut).isEmpty() and not scan(model).isEmpty()
    users = cut.table("users").df.collect()
    assert len({u.email for u in users}) == len(users)
    assert all(u.full_name == " ".join(x for x in (u.first_name, u.last_name) if x) for u in users)
    assert [u.first_name for u in users if u.id == 12] in ([], [None])
    strict = pytest.raises(ModelError, slice_model, model, "users", "seed", strict=True)
    assert "comments.body" in str(strict.value)


def test_root_selection(spark, model):
    assert [r.id for r in root_keys(model, "users", "id > 3", limit=2).collect()] == [4, 5]
    assert root_keys(model, "users", limit=0).count() == 12
    with pytest.raises(ModelError):
        root_keys(model, "users", "id < 0", required=True)
    with pytest.raises(ValueError):
        in_sample(["id"], 101)
    full = spark.range(20_000).where(in_sample(["id"], 12.5)).count()
    assert 2200 < full < 2800


def test_child_cap_is_per_parent(spark):
    p, c = spark.range(3), spark.range(30).selectExpr("id", "id % 3 as p_id")
    m = RelationalModel([TableSpec("p", p, ("id",)), TableSpec("c", c, ("id",))], [ForeignKey("c", ("p_id",), "p", ("id",))])
    keys = closure(m, "p", root_keys(m, "p"), 1, child_limit=2)
    assert sorted(r.id for r in keys["c"].collect()) == [0, 1, 2, 3, 4, 5]


def test_keyless_rows_and_null_references(spark):
    p = spark.range(2)
    c = spark.createDataFrame([(0, "a"), (0, "a"), (None, "b"), (1, "c")], "p_id long, v string")
    m = RelationalModel([TableSpec("p", p, ("id",)), TableSpec("c", c)], [ForeignKey("c", ("p_id",), "p", ("id",))])
    frames = slice_model(m, "p", "s", where="id = 0", child_depth=1, strict=False)
    with pytest.raises(ModelError, match="c.v"):
        slice_model(m, "p", "s", where="id = 0", child_depth=1)
    assert [tuple(r) for r in frames["c"].collect()] == [(0, "a"), (0, "a")]
    assert orphan_counts(m).first().n_orphans == 0


def test_saved_keys(spark, model, tmp_path):
    keys = closure(model, "users", root_keys(model, "users", "id = 1"), 0)
    save_keys(keys, str(tmp_path))
    assert counts(load_keys(spark, str(tmp_path), list(keys))) == counts(keys)


def test_model_errors(spark):
    t = TableSpec("t", spark.range(1), ("id",))
    for fks in ([ForeignKey("t", ("x",), "t", ("id",))], [ForeignKey("t", ("id",), "u", ("id",))], [ForeignKey("t", ("id",), "t", ())]):
        with pytest.raises(ModelError):
            RelationalModel([t], fks)
    with pytest.raises(ModelError):
        RelationalModel([TableSpec("t", spark.range(1), ("no",))])


def test_names_without_a_schema(spark):
    t = lambda n: TableSpec(n, spark.range(3).selectExpr("id", "id as u_id"), ("id",))
    m = RelationalModel([t("a.users"), t("a.posts"), t("b.posts")], [ForeignKey("a.posts", ("u_id",), "users", ("id",), virtual=True)])
    assert m.fks[0].parent == "a.users" and m.table("users").name == "a.users"
    assert counts(closure(m, "users", root_keys(m, "users", "id = 1"), 1)) == {"a.users": 1, "a.posts": 1}
    with pytest.raises(ModelError, match="may be any of"):
        m.table("posts")


def test_presets_fit(spark):
    p, c = spark.range(2_000), spark.range(20_000).selectExpr("id", "id % 2000 as p_id")
    m = RelationalModel([TableSpec("p", p, ("id",)), TableSpec("c", c, ("id",))], [ForeignKey("c", ("p_id",), "p", ("id",))])
    assert {r.preset: (r.root_rows, r.estimated_rows) for r in preset_estimates(m, "p").collect()} == {"small": (1_000, 11_000), "medium": (2_000, 22_000), "large": (2_000, 22_000)}
    assert [fit_preset(m, "p", n) for n in (10, 11_000, 21_999, 10**6)] == ["small", "small", "small", "large"]


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf(dict):
        def get(self, key, default=None):
            return super().get(key, default)

    class Session:
        conf = Conf({"spark.master": "yarn"})

    with pytest.raises(ValueError, match="checkpoint"):
        scratch_path(Session, "x")


def test_load_order_and_partitions(model):
    order = model.load_order([f for f in model.fks if f.child == "companies"])
    assert order.index("companies") < order.index("users") < order.index("events")
    assert len([f for f in model.fks if f.child == "events"]) == 1  # the leaf's constraint is its parent's
    assert model.cycles() == [["companies", "users"]]
    assert model.key_columns("comments") == {"id", "commentable_id"}


def test_provenance_against_a_walk(spark):
    """closure_via has no SQL: a plain breadth-first walk over collected rows says the same."""
    from rowcloak.plans.selection import ROOT, closure_via

    m = star_model(spark, "/root/testdata/sf0.001")
    rows = {t: [r.asDict() for r in m.table(t).rows().collect()] for t in m.tables}
    key = {t: m.table(t).key[0] for t in m.tables}
    roots = {r.c_custkey for r in m.table("customer").df.where(ROOT).collect()}
    found = {"customer": {k: (0, "root") for k in roots}}

    def add(new, depth):
        out = {}
        for (t, k), via in new.items():
            if k not in found.setdefault(t, {}):
                found[t][k] = depth, via
                out.setdefault(t, set()).add(k)
        return out

    frontier = {"customer": roots}
    for depth in (0, 1):
        level = {}
        while frontier:
            new = {}
            for t, ks in frontier.items():
                level.setdefault(t, set()).update(ks)
                for fk in m.parents(t):
                    refs = {r[fk.columns[0]] for r in rows[t] if r[key[t]] in ks}
                    for r in rows[fk.parent]:
                        if r[fk.ref_columns[0]] in refs:
                            k = fk.parent, r[key[fk.parent]]
                            new[k] = min(new.get(k, fk.name), fk.name)
            frontier = add(new, depth)
        if depth == 0:
            new = {}
            for t, ks in level.items():
                for fk in m.children(t):
                    for r in rows[fk.child]:
                        if r[fk.columns[0]] in ks:
                            k = fk.child, r[key[fk.child]]
                            new[k] = min(new.get(k, fk.name), fk.name)
            frontier = add(new, 1)
    want = {}
    for keys in found.values():
        for d, via in keys.values():
            n, low = want.get(via, (0, d))
            want[via] = n + 1, min(low, d)
    assert {r.via: (r.n_keys, r.min_depth) for r in closure_via(spark, "/root/testdata/sf0.001").collect()} == want


def test_many_keys_are_told_in_the_scan(spark, monkeypatch):
    """With more keys than a broadcast takes, rows outside the slice don't reach the join; repeated rows all come."""
    from rowcloak.operators import filters

    used = []
    keep = filters.ValueFilter.keep
    monkeypatch.setattr(filters, "FEW", 10)
    monkeypatch.setattr(filters.ValueFilter, "keep", lambda self, rows, columns: used.append(columns) or keep(self, rows, columns))
    rows = spark.range(3000).selectExpr("id % 1000 as a", "if(id % 5 = 0, null, id % 1000) as b")
    m = RelationalModel([TableSpec("t", rows)])
    keys = m.table("t").rows().where("a < 40").select("_row_id").distinct()
    got = read_slice(m, keys, "t")
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.where("a < 40").collect())) and used == [["_row_id"]]


def test_indexes_of_hot_values_and_of_nothing(spark, tmp_path):
    """Rows of a value with more of them than a bucket holds lie apart; the others, and an empty child's none, in buckets."""
    from rowcloak.sources.indexes import build_indexes, open_indexes

    parents = spark.range(50).selectExpr("id as p")
    for i, rows in enumerate((spark.range(600).selectExpr("id as c", "if(id < 200, 7, if(id < 220, null, id % 50)) as of"), spark.range(0).selectExpr("id as c", "id as of"))):
        fk = ForeignKey("child", ("of",), "parent", ("p",))
        m = RelationalModel([TableSpec("parent", parents, ("p",)), TableSpec("child", rows, ("c",))], [fk])
        build_indexes(m, str(tmp_path / str(i)), rows=50)
        cool, hot = open_indexes(spark, m, str(tmp_path / str(i))).children(m.fks[0])
        assert sorted(map(tuple, cool.unionByName(hot).select("c", "of").collect())) == sorted(map(tuple, rows.where("of is not null").collect()))
        assert {r["of"] for r in hot.collect()} == ({7} if i == 0 else set())
