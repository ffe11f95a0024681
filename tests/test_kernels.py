import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.operators import tables as T
from gaugework.plans import kernels as K
from gaugework.plans import neighbors as N
from gaugework.schema import ColumnMetadata, ColumnType, Metadata, MetadataError

NUM, CAT = ColumnType.NUMERIC, ColumnType.CATEGORICAL


def meta(**kinds):
    return Metadata({n: ColumnMetadata(n, k) for n, k in kinds.items()})


def pair(spark, rows, schema):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"id long, _side string, {schema}")


def test_ecdf_against_numpy(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=700).round(1), rng.normal(0.3, 1.2, 500).round(1)
    df = pair(spark, [("r", float(x)) for x in a] + [("s", float(x)) for x in b] + [("s", None), ("r", math.nan)], "x double")
    got = K.ks_w1(K.numeric_long(df, ["x"])).first()
    grid = np.unique(np.concatenate([a, b]))
    fr, fs = (np.searchsorted(np.sort(v), grid, side="right") / len(v) for v in (a, b))
    assert (got["n_r"], got["n_s"]) == (700, 500)
    assert got["ks"] == pytest.approx(np.abs(fr - fs).max())
    assert got["w1"] == pytest.approx((np.abs(fr - fs)[:-1] * np.diff(grid)).sum())


def test_quantiles_against_numpy(spark):
    x = np.random.default_rng(1).exponential(size=333)
    df = pair(spark, [("r", float(v)) for v in x], "x double")
    q = K.quantiles(K.numeric_long(df, ["x"]), [0.0, 0.05, 0.5, 0.9, 1.0]).first()["q"]
    assert q == pytest.approx(np.quantile(x, [0.0, 0.05, 0.5, 0.9, 1.0]).tolist())


def test_empty_and_null_columns_give_no_rows(spark):
    df = pair(spark, [("r", None, None), ("s", None, None)], "x double, g string")
    assert T.ks(df, ["x"]).count() == 0
    assert T.quantile_mse(df, ["x"]).count() == 0
    assert T.standardised_means(df, ["x"]).count() == 0
    assert T.tvd(df, ["g"]).first()["tvd"] == 0  # all missing on both sides
    assert T.rare_categories(df, ["g"]).count() == 0


@pytest.mark.parametrize("gower", [False, True])
def test_knn_against_brute_force(spark, gower):
    rng = np.random.default_rng(2)
    rows = [("r" if i % 2 else "s", float(rng.integers(0, 9)) if i % 11 else None, float(rng.normal()), "abc"[i % 3] if i % 7 else None) for i in range(160)]
    df = pair(spark, rows, "x double, y double, g string")
    m = meta(x=NUM, y=NUM, g=CAT)
    enc, space = (N.gower if gower else N.encode)(df, m, "id")
    got = {r["_id"]: r for r in N.knn(enc.where("_side = 's'"), enc.where("_side = 'r'"), space, 3, block=32).collect()}
    e = {r["_id"]: r for r in enc.collect()}
    for i, r in e.items():
        if r["_side"] != "s":
            continue
        d = []
        for j, o in e.items():
            if o["_side"] == "r":
                parts = []
                for c, f in enumerate(space.numeric):
                    gap = None if r[f] is None or o[f] is None else abs(r[f] - o[f])
                    parts.append(0.0 if gap is None else min(gap / space.ranges[c], 1) if gower else gap**2)
                parts.append((1.0 if gower else 2.0) * (r["g0"] != o["g0"]))
                d.append((sum(parts) / 3 if gower else math.sqrt(sum(parts)), j))
        d.sort()
        assert got[i]["d"] == pytest.approx([x for x, _ in d[:3]])
        assert got[i]["nn"] in [j for x, j in d if x == pytest.approx(d[0][0])]


def test_knn_leaves_the_row_itself_out(spark):
    df = pair(spark, [("r", 1.0), ("r", 1.0), ("r", 5.0)], "x double")
    enc, space = N.encode(df, meta(x=NUM), "id")
    got = {r["_id"]: r["d"][0] for r in N.knn(enc, enc, space, 1, exclude_self=True).collect()}
    assert got[0] == got[1] == 0 and got[2] > 0


@pytest.mark.parametrize("gower", [False, True])
def test_knn_over_parts_with_copies_ties_and_nulls(spark, gower):
    """Many parts, a point of 300 copies, ties and nulls: distances, their counts and the least nearest id, also of a table to itself."""
    rng = np.random.default_rng(8)
    rows = [("rs"[i % 2], None if i % 9 == 0 else float(rng.integers(0, 12)), float(rng.normal()) if i % 3 else 2.0, "abcd"[int(rng.integers(0, 4))]) for i in range(700)]
    rows += [("r", 3.0, 2.0, "a")] * 300
    enc, space = (N.gower if gower else N.encode)(pair(spark, rows, "x double, y double, g string"), meta(x=NUM, y=NUM, g=CAT), "id")
    e = enc.orderBy("_id").toPandas()
    side = {s: e[e._side == s] for s in "rs"}
    for a, b in (("s", "r"), ("r", "r")):
        part = lambda x: {"_id": x._id.values, **{c: x[c].values.astype(float) for c in space.numeric}, **{c: x[c].values for c in space.categorical}}
        d = N.distances(space, part(side[a]), part(side[b]), 0, len(side[a]))
        if a == b:
            np.fill_diagonal(d, np.inf)
        got = {r["_id"]: r for r in N.knn(enc.where(F.col("_side") == a), enc.where(F.col("_side") == b), space, 4, exclude_self=a == b, block=40).collect()}
        assert len(got) == len(d)
        for i, line in zip(side[a]._id, d, strict=True):
            assert got[i]["d"] == sorted(line)[:4]
            assert got[i]["nn"] == side[b]._id.values[line.argmin()]


def test_knn_takes_few_of_all_pairs(monkeypatch):
    """The work of a part grows in proportion to its rows, and the result is that of all pairs."""
    rng, space = np.random.default_rng(9), N.Space(("f0", "f1"), ("g0",))
    of = lambda n: {"_id": np.arange(n), "_n": np.ones(n, np.int64), "f0": rng.normal(size=n), "f1": rng.normal(size=n), "g0": rng.integers(0, 5, n)}
    a, b, pairs, plain = of(4000), of(8000), [], N.distances
    monkeypatch.setattr(N, "distances", lambda s, x, y, lo, hi: pairs.append((hi - lo) * len(y["_id"])) or plain(s, x, y, lo, hi))
    d, ids, _ = N._search(space, a, b, 3, np.full(4000, np.inf), False)
    whole = plain(space, a, b, 0, 4000)
    assert (d == np.sort(whole, axis=1)[:, :3]).all() and (ids[:, 0] == whole.argmin(axis=1)).all()
    assert sum(pairs) < 4000 * 8000 / 4


def test_gower_worked_example(spark):
    df = pair(spark, [("r", 0.0, "x"), ("r", 10.0, "y"), ("s", 10.0, "y"), ("s", 5.0, "x")], "num double, cat string")
    enc, space = N.gower(df, meta(num=NUM, cat=CAT), "id")
    got = {r["_id"]: r for r in N.knn(enc.where("_side = 's'"), enc.where("_side = 'r' and _id = 0"), space, 1).collect()}
    assert got[2]["d"][0] == 1.0 and got[3]["d"][0] == 0.25


def test_auc_counts_ties_half(spark):
    rows = [(0.1, True), (0.5, True), (0.5, False), (0.9, False), (0.9, True)]
    df = spark.createDataFrame(rows, "p double, pos boolean")
    want = np.mean([(a > b) + 0.5 * (a == b) for (a, x), (b, y) in itertools.product(rows, rows) if x and not y])
    assert N.auc(df, "p", "pos").first()["auc"] == pytest.approx(want)


def test_row_matching_is_null_safe_and_by_value(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, 2.0, None)], "k_id long, n double, g string")
    b = spark.createDataFrame([(9, math.nan, "x"), (8, 2.0, None), (7, 3.0, None), (6, 2.0, None)], "k_id long, n double, g string")
    r = K.matches(a, b, Metadata.infer(a)).first()
    assert (r["n"], r["matched"]) == (4, 3)


def test_associations_are_undefined_on_constants(spark):
    rows = [("r", float(i % 5), float(i), "ab"[i % 2], "c") for i in range(40)] + [("s", 1.0, float(i), "ab"[i % 2], "c") for i in range(40)]
    df = pair(spark, rows, "x double, y double, g string, h string")
    got = {(r["a"], r["b"]): r["abs_corr_diff"] for r in T.associations(df, ["x", "y", "g", "h"], meta(x=NUM, y=NUM, g=CAT, h=CAT)).collect()}
    assert got["x", "y"] is None and got["g", "h"] is None and got["y", "g"] == pytest.approx(0)


def test_roles(spark):
    df = spark.createDataFrame([(1, 1.0, "a", True)], "user_id long, x double, g string, f boolean")
    m = Metadata.infer(df)
    assert [c.dtype for c in m] == [ColumnType.ID, NUM, CAT, ColumnType.BOOLEAN]
    assert Metadata.from_dict(m.to_dict()) == m
    with pytest.raises(MetadataError):
        m.override("nope", sensitive=True)
    with pytest.raises(MetadataError):
        m.override("g", dtype="numeric").validate_against(df)
    with pytest.raises(MetadataError):
        Metadata.infer(df.withColumn("a", F.array(F.lit(1))))


def test_mmd_of_all_rows_against_brute_force(spark):
    from gaugework.operators.columns import mmd_of

    rng = np.random.default_rng(4)
    rows = [("r" if i % 2 else "s", float(rng.normal(0.4 * (i % 2))), "abc"[i % 3]) for i in range(1301)]
    enc, space = N.encode(pair(spark, rows, "x double, g string"), meta(x=NUM, g=CAT), "id")
    e = enc.toPandas()
    d = np.sqrt((e.f0.values[:, None] - e.f0.values) ** 2 + 2.0 * (e.g0.values[:, None] != e.g0.values))
    upper = d[np.triu_indices(len(d), 1)]
    gamma = 1 / (2 * np.median(upper[upper > 0]) ** 2 + 1e-12)
    w = np.where(e._side == "r", 1 / (e._side == "r").sum(), -1 / (e._side == "s").sum())
    want = math.sqrt(w @ np.exp(-gamma * d * d) @ w)
    assert mmd_of(enc, space, None, 42) == pytest.approx(want, abs=1e-9)
    assert mmd_of(enc, space, None, 42, block=300) == pytest.approx(want, abs=1e-9)
    assert mmd_of(enc, space, 500, 42) != pytest.approx(want, abs=1e-9)


def test_mmd_compares_copies_once_with_their_weight(spark):
    from gaugework.operators.columns import mmd_of

    rng = np.random.default_rng(5)
    base = [("rs"[i % 3 == 0], round(float(rng.normal()), 1), "ab"[i % 2]) for i in range(60)]
    rows = [r for i, r in enumerate(base) for _ in range(1 + i % 7)]
    enc, space = N.encode(pair(spark, rows, "x double, g string"), meta(x=NUM, g=CAT), "id")
    points, sizes = N.pooled(enc, space)
    assert points.count() == len({r[1:] for r in rows}) and sum(sizes.values()) == len(rows) == points.agg(F.sum("_n")).first()[0]
    e = enc.toPandas()
    d = np.sqrt((e.f0.values[:, None] - e.f0.values) ** 2 + 2.0 * (e.g0.values[:, None] != e.g0.values))
    upper = d[np.triu_indices(len(d), 1)]
    gamma = 1 / (2 * np.median(upper[upper > 0]) ** 2 + 1e-12)
    w = np.where(e._side == "r", 1 / (e._side == "r").sum(), -1 / (e._side == "s").sum())
    assert mmd_of(enc, space, None, 42, block=20) == pytest.approx(math.sqrt(w @ np.exp(-gamma * d * d) @ w), abs=1e-9)


def test_mmd_of_one_number_and_labels_visits_no_pairs(spark, monkeypatch):
    from gaugework.operators.columns import mmd_of

    rng = np.random.default_rng(6)
    rows = [("r" if i % 2 else "s", float(rng.normal(0.4 * (i % 2))), "abc"[i % 3], "xy"[i % 5 % 2]) for i in range(901)]
    enc, space = N.encode(pair(spark, rows, "x double, g string, h string"), meta(x=NUM, g=CAT, h=CAT), "id")
    e = enc.toPandas()
    d = np.sqrt((e.f0.values[:, None] - e.f0.values) ** 2 + 2.0 * (e.g0.values[:, None] != e.g0.values) + 2.0 * (e.g1.values[:, None] != e.g1.values))
    upper = d[np.triu_indices(len(d), 1)]
    gamma = 1 / (2 * np.median(upper[upper > 0]) ** 2 + 1e-12)
    w = np.where(e._side == "r", 1 / (e._side == "r").sum(), -1 / (e._side == "s").sum())

    def grid(*_):
        raise AssertionError("pairs of rows are visited")

    monkeypatch.setattr(N, "_grid", grid)
    assert mmd_of(enc, space, None, 42, block=300) == pytest.approx(math.sqrt(w @ np.exp(-gamma * d * d) @ w), abs=1e-9)


@pytest.mark.parametrize("kind", ["labels", "copies", "tail", "no number", "even", "wrong guess"])
def test_sums_along_lines_are_those_of_all_pairs(spark, monkeypatch, kind):
    from gaugework.plans import line as L

    rng, side = np.random.default_rng(7), ["r", "s", "s"]
    schema, m, block = "x double, g string, h string", meta(x=NUM, g=CAT, h=CAT), 40
    rows = [(side[i % 3], float(rng.exponential()), "abcd"[i % 4], "abc"[i % 7 % 3]) for i in range(400)]
    if kind == "copies":
        rows = [(s, round(x, 1), g, h) for s, x, g, h in rows]
    if kind in ("tail", "even"):
        schema, m, block = "x double", meta(x=NUM), 16
        rows = [(side[i % 3], float(np.exp(4 * rng.normal()))) for i in range(300)] if kind == "tail" else [("r", 1.0), ("s", 2.0), ("s", 5.0), ("r", 9.0)]
    if kind == "no number":
        schema, m, block = "g string, h string", meta(g=CAT, h=CAT), 4
        rows = [(s, g, h) for s, _, g, h in rows]
    if kind == "wrong guess":
        monkeypatch.setattr(L, "_guess", lambda *_: (0.25, 0.5))
    enc, space = N.encode(pair(spark, rows, schema), m, "id")
    pool = N.pooled(enc, space)[0].cache()
    n = pool.count()
    assert L.on_a_line(pool, space)
    want = N.pooled_median(pool, space, n, 4096)
    assert L.median(pool, space, n, block) == want
    gamma = 1 / (2 * want * want + 1e-12)
    assert L.kernel_sum(pool, space, gamma) == pytest.approx(N.kernel_sum(pool, space, n, gamma, 4096), abs=1e-13)


def test_a_sweep_sends_only_its_cuts_to_all_tasks(spark):
    long = K.numeric_long(pair(spark, [("rs"[i % 2], float(i)) for i in range(500)], "x double"), ["x"])
    for d in (K.ks_w1(long), K.both_quantiles(long, [0.1, 0.5]), K.quantiles(long, [0.5], "s")):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "BuildLeft" not in plan


def test_quantiles_of_both_sides_against_numpy(spark):
    rng, probs = np.random.default_rng(3), [0.0, *T.GRID, 1.0]
    x, y = rng.integers(0, 40, 300).astype(float), rng.normal(size=211)
    df = pair(spark, [("r", float(v), None) for v in x] + [("s", float(v), float(v)) for v in y] + [("h", 99.0, 1.0)], "x double, y double")
    got = {r["column"]: r for r in K.both_quantiles(K.numeric_long(df.where("_side <> 'h'"), ["x", "y"]), probs).collect()}
    assert got["x"]["q_r"] == pytest.approx(np.quantile(x, probs).tolist()) and got["x"]["q_s"] == pytest.approx(np.quantile(y, probs).tolist())
    assert got["y"]["q_r"] is None and got["y"]["q_s"] == pytest.approx(np.quantile(y, probs).tolist())
    one = K.both_quantiles(K.numeric_long(pair(spark, [("r", 5.0), ("s", 7.0)], "x double"), ["x"]), probs).first()
    assert one["q_r"] == [5.0] * len(probs) and one["q_s"] == [7.0] * len(probs)
