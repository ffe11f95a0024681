import json
import math

import numpy as np
import pytest

import gaugework as g
from gaugework.cli import main, metric_options
from gaugework.leaderboard import BenchmarkResult
from gaugework.render import leaderboard_html, scorecard_html
from gaugework.streaming.rescore import RunningTvd


def people(spark, n, seed, shift=0.0):
    rng = np.random.default_rng(seed)
    age = np.clip(np.round(rng.normal(40 + shift, 12, n)), 18, 90)
    rows = [(int(a), str(rng.choice(["m", "f"])), str(rng.choice(["hs", "ba", "ma", "phd"], p=[0.4, 0.35, 0.23, 0.02])), float(600 * a + rng.normal(0, 8000))) for a in age]
    return spark.createDataFrame(rows, "age long, sex string, education string, income double")


META = {"age": "numeric", "sex": "categorical", "education": "categorical", "income": "numeric"}


@pytest.fixture(scope="module")
def tables(spark):
    return {"real": people(spark, 300, 1).cache(), "good": people(spark, 300, 2).cache(), "bad": people(spark, 300, 3, 25).cache()}


@pytest.fixture(scope="module")
def meta(tables):
    m = g.Metadata.infer(tables["real"])
    return m.override("income", sensitive=True).override("age", quasi_identifier=True).override("sex", quasi_identifier=True)


@pytest.fixture(scope="module")
def report(tables, meta):
    options = {"pmse": {"n_permutations": 2}}
    return g.evaluate(tables["real"], tables["good"], meta, tiers=("core", "extended"), run_fairness=True, holdout=people(tables["real"].sparkSession, 100, 9), metric_options=options, fairness_specs=[g.FairnessSpec("sex", "education", "ba")], subgroup_specs=[g.SubgroupSpec("young", {"age": (None, 35)})], tasks=[g.UtilityTask("sex")], dp_ledger={"epsilon": 1.0, "delta": 1e-6})


def test_nothing_fails(report):
    assert {r.spec.name: r.error for r in report.results if r.error} == {}
    assert {r.spec.name for r in report.results if r.skip_reason} == set()
    assert len(report.results) == 43 - 5  # utility is off


def test_scores_lie_in_the_unit_interval(report):
    for r in report.results:
        if r.spec.scoring:
            assert 0 <= r.scalars["score"] <= 1, r.spec.name
    assert set(report.aggregated) == {"congruence", "coverage", "compliance", "fairness", "preservation"}


def test_json_round_trip(report):
    again = g.Report.from_json(report.to_json())
    assert again.aggregated == report.aggregated
    assert json.loads(report.to_json())["aggregated"] == pytest.approx(report.aggregated)
    assert "NaN" not in report.to_json()


def test_html(report):
    for mode in ("normalized", "actual"):
        page = scorecard_html(report, mode)
        assert page.count("<tr") > 43 and "ks_statistic" in page and "<svg" in page
    assert scorecard_html(report, fragment=True).startswith("<h1>")


def test_identity_is_ideal_and_shift_is_not(tables, meta):
    names = ["ks_statistic", "wasserstein", "tvd", "hellinger", "jsd", "quantile_mse", "dimension_wise_means", "ci_overlap", "correlation_difference", "range_coverage", "category_coverage", "entropy_ratio", "mutual_information_difference", "sliced_wasserstein", "mmd"]
    known = g.registry.subset(names)
    same = g.evaluate_with(known, tables["real"], tables["real"], meta, tiers=("core", "extended"))
    moved = g.evaluate_with(known, tables["real"], tables["bad"], meta, tiers=("core", "extended"))
    for n in names:
        assert same.result(n).scalars["score"] == pytest.approx(1, abs=1e-6), n
    for n in ("ks_statistic", "wasserstein", "dimension_wise_means", "ci_overlap"):
        assert moved.result(n).scalars["score"] < 0.75


def test_copies_have_no_privacy(tables, meta):
    r = g.evaluate_with(g.registry.subset(["dcr", "nndr", "identical_match_rate", "novelty_rate", "hitting_rate", "epsilon_identifiability"]), tables["real"], tables["real"], meta, tiers=("core", "extended"))
    for n in ("dcr", "identical_match_rate", "novelty_rate", "hitting_rate", "epsilon_identifiability"):
        assert r.result(n).scalars["score"] == 0


def test_gower_cap_is_noted(tables, meta):
    ctx = g.registry.get("dcr")
    from gaugework.registry import Context

    c = Context(tables["real"], tables["good"], meta, distance="gower", cap=50)
    out = ctx(c).compute(tables["real"], tables["good"], meta)
    assert out.notes == ["capped for gower"] and 0 <= out.scalars["score"] <= 1


def test_skips_and_errors(spark, tables, meta):
    text = tables["real"].select("sex")
    r = g.evaluate(text, text, tiers=("core",))
    assert r.result("ks_statistic").skip_reason and r.result("tvd").scalars
    with pytest.raises(g.MetadataError):
        g.evaluate(tables["real"], text)
    with pytest.raises(g.GaugeError):
        g.evaluate(tables["real"].limit(0), tables["good"])
    with pytest.raises(g.MetricError):
        g.evaluate(tables["real"], tables["good"], metric_options={"ks_statistic": {"nope": 1}})
    only = g.evaluate(None, tables["good"], meta)
    assert [x.spec.name for x in only.results] == ["k_anonymity"]


def test_a_failing_metric_is_isolated(tables, meta):
    known = g.MetricRegistry()

    @known.register
    class Broken(g.Metric):
        spec = g.MetricSpec("broken", "congruence", "custom")

        def measure(self, ctx, out):
            raise RuntimeError("no")

    @known.register
    class Odd(g.Metric):
        spec = g.MetricSpec("odd", "congruence", "custom")

        def measure(self, ctx, out):
            out.scalars = {"score": math.nan}

    r = g.evaluate_with(known, tables["real"], tables["good"], meta, tiers=("custom",))
    assert all(x.error for x in r.results) and r.aggregated == {} and r.overall == 0.0


def test_utility(tables, meta):
    known = g.registry.subset(["tstr_suite", "feature_importance_spearman", "discriminative_score"])
    r = g.evaluate_with(known, tables["real"], tables["good"], meta, tiers=("core", "extended"), run_utility=True, tasks=[g.UtilityTask("income")])
    assert {x.spec.name: x.error for x in r.results if x.error} == {}
    assert r.result("tstr_suite").scalars["trtr_income"] > 0.2


def test_benchmark(tables, meta, tmp_path, spark):
    known = {"tiers": ("core",), "cs": ("congruence", "coverage"), "metric_options": {"pmse": {"n_permutations": 1}}}
    b = g.benchmark(tables["real"], {"good": tables["good"], "bad": tables["bad"]}, meta, **known)
    for mode in ("absolute", "linear", "normal", "quantile"):
        assert [n for _, n, _ in b.ranking(mode=mode)] == ["good", "bad"]
    assert b.ranking("congruence")[0][:2] == (1, "good") == b.ranking("ks_statistic", "normal")[0][:2]
    again = BenchmarkResult.from_json(b.to_json())
    assert [n for _, n, _ in again.ranking()] == ["good", "bad"]
    assert "Leaderboard" in leaderboard_html(b)
    from gaugework.operators.ranking import leaderboard

    table = leaderboard(b.frame(spark)).orderBy("place").collect()
    assert [r["candidate"] for r in table] == ["good", "bad"]
    assert table[0]["overall"] == pytest.approx(b.overall()["good"])


def test_cli(tables, tmp_path, spark, capsys):
    for n in ("real", "good"):
        tables[n].write.parquet(str(tmp_path / f"{n}.parquet"))
    (tmp_path / "meta.json").write_text(json.dumps({"columns": {n: {"dtype": k} for n, k in META.items()}}))
    args = ["evaluate", "--real", str(tmp_path / "real.parquet"), "--synthetic", str(tmp_path / "good.parquet"), "--metadata", str(tmp_path / "meta.json"), "--metric-option", "pmse.n_permutations=1", "--html", str(tmp_path / "o.html"), "--json", str(tmp_path / "o.json")]
    assert main(args, spark) == 0
    assert g.Report.from_json((tmp_path / "o.json").read_text()).aggregated
    assert "congruence" in capsys.readouterr().out
    assert main(["evaluate", "--real", "x.txt", "--synthetic", "y.txt"], spark) == 2
    assert metric_options(["a.b=1", "a.c=x"]) == {"a": {"b": 1, "c": "x"}}
    with pytest.raises(g.GaugeError):
        metric_options(["ab"])


def test_running_tvd(spark, tables):
    r = RunningTvd(tables["real"], ["sex", "education"])
    r.update(tables["good"].limit(50), 0)
    r.update(tables["real"], 1)
    r.update(tables["real"], 1)  # delivered again
    both = tables["good"].limit(50).unionByName(tables["real"])
    from gaugework.operators.tables import tvd
    from gaugework.plans.kernels import tag

    want = {x["column"]: x["tvd"] for x in tvd(tag(tables["real"], both), ["sex", "education"]).collect()}
    assert {x["column"]: x["tvd"] for x in r.table().collect()} == pytest.approx(want)


def test_running_scores_survive_a_restart(tables, tmp_path):
    state = f"file://{tmp_path}/state"
    first = RunningTvd(tables["real"], ["sex"], state=state)
    for epoch in range(4):
        first.update(tables["good"], epoch)
    again = RunningTvd(tables["real"], ["sex"], state=state)
    assert again.done == 3 and again.table().first()["tvd"] == pytest.approx(first.table().first()["tvd"])
    again.update(tables["bad"], 3)  # delivered before the restart
    again.update(tables["bad"], 4)
    assert again.counts.where("_side = 's'").groupBy().sum("n").first()[0] == 1500
    assert sorted(int(p.name) for p in (tmp_path / "state").iterdir()) == [3, 4]


def test_tables_may_be_pandas_ones(spark):
    import pandas as pd

    real = pd.DataFrame({"x": [1.0, 2.0, 3.0, 4.0], "k": ["a", "b", "a", "b"]})
    r = g.evaluate(real, real, cs=("coverage",))
    assert r.result("range_coverage").scalars["score"] == 1.0
    with pytest.raises(g.MetricError):
        df = spark.createDataFrame(real)
        from gaugework.registry import Context

        g.registry.get("tvd")(Context(df, df, g.Metadata.infer(df))).compute(spark.createDataFrame(real), df, g.Metadata.infer(df))


def test_band_join_against_all_pairs(spark):
    from gaugework.operators import tables as T

    rng = np.random.default_rng(4)
    rows = [(i, "rs"[i % 2], *[float(v) for v in np.round(rng.normal(0, 1, 3), 1)], str(rng.choice(["a", "b"]))) for i in range(400)]
    df = spark.createDataFrame([*rows, (900, "r", None, 0.0, 0.0, "a")], "i long, _side string, x double, y double, z double, k string")
    limits = {"x": 0.5, "y": 0.2, "z": 0.0}
    got = T.hits(df, ["x", "y", "z"], ["k"], limits, "i").first()
    near = lambda a, b: all(abs(a[2 + j] - b[2 + j]) <= t for j, t in enumerate(limits.values())) and a[5] == b[5]
    want = sum(any(near(a, b) for b in rows if b[1] == "s") for a in rows if a[1] == "r")
    assert (got["n_real"], got["n_hit"]) == (201, want)


def test_subgroup_predicates(spark):
    df = spark.createDataFrame([(1, "m", True), (50, None, False), (None, "f", None)], "age int, sex string, flag boolean")
    count = lambda **c: df.where(g.SubgroupSpec("s", c).column()).count()
    assert count(age=(1, 50)) == 2 and count(age=(2, None)) == 1 and count(sex=["m", "f"]) == 2 and count(flag=[True]) == 1
    m = g.Metadata.infer(df)
    assert g.SubgroupSpec("s", {"sex": (1, 2)}).validate(m) and g.SubgroupSpec("s", {"x": ["a"]}).validate(m)
    assert g.SubgroupSpec("s", {"age": (1, 2)}).validate(m) is None


def test_capped_privacy_risk_is_weighted(tables, meta):
    from gaugework.registry import Context

    specs = [g.SubgroupSpec("young", {"age": (None, 30)})]
    cls = g.registry.get("minority_privacy_risk")
    whole, part = (cls(Context(tables["real"], tables["good"], meta), subgroup_specs=specs, cap=c).compute(None, None, meta) for c in (None, 150))
    assert part.notes == ["150 real rows"] and 0 <= part.scalars["score"] <= 1
    assert part.per_column["young"]["median_dcr_rest"] == pytest.approx(whole.per_column["young"]["median_dcr_rest"], rel=0.8)


def test_hitting_rate_compares_all_rows(spark, meta):
    """2500 copied rows, each with a label of its own: every one is a hit, however many there are."""
    rows = spark.range(2500).selectExpr("cast(id as double) as age", "cast(id as string) as sex")
    m = g.Metadata.infer(rows).override("age", dtype=g.ColumnType.NUMERIC).override("sex", dtype=g.ColumnType.CATEGORICAL)
    names = g.registry.subset(["hitting_rate"])
    whole, part = (g.evaluate_with(names, rows, rows, m, metric_options=o).result("hitting_rate") for o in ({}, {"hitting_rate": {"cap": 2000}}))
    assert whole.scalars["hit_rate"] == 1 and not whole.notes
    assert part.notes == ["2000 rows a side"]


def test_the_scorecard_permutes_as_often_as_the_operator(spark, monkeypatch):
    from types import SimpleNamespace

    from gaugework import runner
    from gaugework.plans import catalogue

    seen = {}
    monkeypatch.setattr(runner, "evaluate", lambda *a, **k: seen.update(k) or SimpleNamespace(frame=lambda spark: None))
    catalogue.flagship(spark, "/root/testdata/sf0.001")
    assert seen["holdout"] is not None and "n_permutations" not in (seen.get("metric_options") or {}).get("pmse", {})
    assert g.registry.get("pmse").n_permutations == 20


def shifted(spark, move):
    """y tells x > 0 in group A and x > 5 in group B; ``move`` is added to x in group B."""
    rows = [("A", float(2 * (i % 2) - 1), str(i % 2)) for i in range(280)] + [("B", 4.0 + 2 * (i % 2) + move, str(i % 2)) for i in range(120)]
    return spark.createDataFrame(rows, "g string, x double, y string")


def test_minority_utility_gap(spark):
    real = shifted(spark, 0.0)
    meta = g.Metadata.infer(real)
    options = {"tasks": [g.UtilityTask("y", "classification")], "subgroup_specs": [g.SubgroupSpec("b-group", {"g": ["B"]})]}
    cls = g.registry.get("minority_utility_gap")
    same = cls(**options).compute(real, real, meta)
    assert same.scalars["score"] > 0.95 and set(same.per_column) == {"b-group|y"}
    moved = cls(**options).compute(real, shifted(spark, -4.0), meta)
    assert moved.scalars["score"] < 0.85 and moved.per_column["b-group|y"]["excess_gap"] > 0.1
    one_class = cls(**options).compute(real, shifted(spark, 0.0).where("y = '1'"), meta)
    assert one_class.skip_reason and "fewer than two classes" in one_class.notes[0]
    options["subgroup_specs"] = [g.SubgroupSpec("right", {"x": (5.0, None)})]
    assert cls(**options).compute(real, real, meta).skip_reason  # a single class inside


def test_outcomes_are_compared_by_value(spark):
    rows = [("a", 1.0)] * 8 + [("a", 0.0)] * 2 + [("b", 1.0)] * 4 + [("b", 0.0)] * 6
    real = spark.createDataFrame(rows, "grp string, approved double")
    fair = real.withColumn("approved", (real.approved > 2).cast("double"))
    cls, meta = g.registry.get("statistical_parity"), g.Metadata.infer(real)
    got = [cls(specs=[g.FairnessSpec("grp", "approved", v)]).compute(real, fair, meta).scalars for v in (1, 1.0, None)]
    assert got[0] == got[1] == got[2] and got[0]["spd_real"] == pytest.approx(0.4) and got[0]["score"] == pytest.approx(0.6)
    codes = spark.createDataFrame([(1.0,), (2.0,), (None,)], "code double")
    assert codes.where(g.SubgroupSpec("one", {"code": [1]}).column()).count() == 1


def test_splits_are_stratified(spark):
    from gaugework.plans import models as M

    df = spark.range(1000).selectExpr("id as _row", "case when id % 10 = 0 then 'rare' when id % 7 = 0 then null else 'often' end as y")
    train, test = M.split(df, "y", 0.7, 3)
    whole = {r.y: r["count"] for r in df.groupBy("y").count().collect()}
    for part, share in ((train, 0.7), (test, 0.3)):
        assert all(abs(r["count"] - share * whole[r.y]) <= 1 for r in part.groupBy("y").count().collect())
    assert train.join(test, "_row").count() == 0 and train.count() + test.count() == 1000
    sizes = {(r.y, r.fold): r["count"] for r in M.folds(df, 5, 1, "y").groupBy("y", "fold").count().collect()}
    assert len(sizes) == 15 and all(abs(n - whole[y] / 5) <= 1 for (y, _), n in sizes.items())
    assert M.permuted(df, 5, 333, 1000).where("y = 1").count() == 333
    assert M.classes_of(df, "y") == ["often", "rare"]
    notes = []
    assert M.classes_of(df, "_row", notes, 10) is None and notes


def test_panel_names_its_models_and_averages_ratios(tables, meta):
    cls = g.registry.get("model_panel_utility")
    r = cls(tasks=[g.UtilityTask("income", "regression", ("age",))]).compute(tables["real"], tables["good"], meta)
    assert {k for k in r.scalars if k.startswith("ratio_")} == {"ratio_linear", "ratio_random_forest", "ratio_hist_gbdt", "ratio_spread"}
    assert set(r.per_column) == {f"income/{m}" for m in ("linear", "random_forest", "hist_gbdt")}
    assert r.scalars["score"] == pytest.approx(np.mean([x["ratio"] for x in r.per_column.values()]))


@pytest.mark.parametrize("classes", ["ab", "abc"])
def test_models_on_rows_alike_score_as_on_all_rows(spark, monkeypatch, classes):
    """Training on distinct rows with their counts: the same linear model, forests and boosted trees as good."""
    from gaugework.plans import models as M

    rng = np.random.default_rng(6)
    rows = []
    for _ in range(3000):
        x, k = int(rng.integers(0, 8)), "uv"[int(rng.integers(0, 2))]
        rows.append((float(x), k, classes[min(len(classes) - 1, int(x + 2 * (k == "u") + rng.normal(0, 2) > 4) + int(x > 6))]))
    df = spark.createDataFrame(rows, "x double, k string, y string")
    meta, task, names = g.Metadata.infer(df), g.UtilityTask("y", "classification"), ("linear", "forest", "boosted")
    got = {}
    for most in (0, 100):
        monkeypatch.setattr(M, "COMPACT", most)
        got[most] = M.fit_and_score(df, df, task, meta, names, 1, list(classes))
    few = M.compacted(df.withColumn("_y", M.class_index("y", list(classes))), ["x", "k"])
    assert few.count() <= 48 and few.agg({"_w": "sum"}).first()[0] == 3000
    assert got[100]["linear"] == pytest.approx(got[0]["linear"], abs=1e-3)
    assert all(got[100][n] == pytest.approx(got[0][n], abs=0.02) for n in names) and got[0]["forest"] > 0.6


def test_pmse_fits_permutations_side_by_side(tables, meta, monkeypatch):
    """Several at a time, each of its own seed, and averaged as they are one by one."""
    import threading
    import time

    from gaugework.plans import models as M

    running, most, lock, seeds = [0], [0], threading.Lock(), []

    def slow(data, share, n):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.2)
        with lock:
            running[0] -= 1
        return 0.01 if data != "permuted" else 0.02

    monkeypatch.setattr(M, "propensity_mse", slow)
    monkeypatch.setattr(M, "permuted", lambda data, seed, ones, n: seeds.append(seed) or "permuted")
    r = g.registry.get("pmse")(n_permutations=6).compute(tables["real"], tables["good"], meta)
    assert most[0] > 1 and sorted(seeds) == [42 + i for i in range(6)] and r.scalars["pmse_null"] == pytest.approx(0.02)


def test_pmse_fits_all_labels_in_the_same_passes(spark, monkeypatch):
    """Tables of many rows: a few passes in place of 21 fits, the same values; the true share of each label is met."""
    from gaugework.plans import models as M

    real, other = people(spark, 1500, 1).cache(), people(spark, 1200, 2, 3).cache()
    pmse = lambda: g.registry.get("pmse")(n_permutations=4).compute(real, other, g.Metadata.infer(real)).scalars
    with monkeypatch.context() as m:
        m.setattr(M, "MANY", 10**9)
        one_by_one = pmse()
    passes, own = [], M._newton_sums
    monkeypatch.setattr(M, "logistic", None)
    monkeypatch.setattr(M, "_newton_sums", lambda *a: passes.append(len(a[1])) or own(*a))
    got = pmse()
    assert passes[0] == 5 and len(passes) <= 8
    assert got["pmse"] == pytest.approx(one_by_one["pmse"], rel=1e-3) and got["pmse_null"] == pytest.approx(one_by_one["pmse_null"], rel=1e-2)
    assert got["score"] == pytest.approx(one_by_one["score"], abs=1e-5)


def test_newton_sums_of_sparse_dense_and_constant_features(spark):
    from pyspark.ml.linalg import Vectors
    from pyspark.sql import functions as F

    from gaugework.plans import models as M

    rng = np.random.default_rng(6)
    x = np.column_stack([rng.normal(size=90), rng.integers(0, 2, 90), np.full(90, 4.0)])
    x[::5] = [0, 0, 4]
    y = rng.integers(0, 2, 90).astype(float)
    rows = [(float(b), Vectors.dense(v) if i % 2 else Vectors.sparse(3, [(j, e) for j, e in enumerate(v) if e])) for i, (v, b) in enumerate(zip(x, y, strict=True))]
    data = spark.createDataFrame(rows, ["y", "features"]).repartition(3)
    mean, sd = x.mean(axis=0), x.std(axis=0, ddof=1)
    sd[2] = 0
    at = rng.normal(size=(2, 4))
    got = M._newton_sums(data, [F.col("y") > 0, F.col("y") == 0], at, 0.3, mean, sd)
    z = np.column_stack([(x[:, 0] - mean[0]) / sd[0], (x[:, 1] - mean[1]) / sd[1], np.zeros(90), np.ones(90)])
    for (loss, gap, slope, curve), b, t in zip(got, at, (y, 1 - y), strict=True):
        p = 1 / (1 + np.exp(-z @ b))
        assert loss == pytest.approx(-(t * np.log(p) + (1 - t) * np.log(1 - p)).sum()) and gap == pytest.approx(((p - 0.3) ** 2).sum())
        assert slope == pytest.approx(z.T @ (p - t)) and curve == pytest.approx((z * (p * (1 - p))[:, None]).T @ z)


def test_labels_are_dealt_by_exact_ranks(spark):
    from pyspark.sql import functions as F

    from gaugework.plans import models as M

    n, hashes = 5000, [F.shiftright(F.xxhash64(F.lit(s), "id"), 11) for s in (1, 2)] + [F.col("id")]  # the last is not spread evenly
    for ones in (1, 1777, 4999):
        cuts = M._cuts(spark.range(n), hashes, ones, n)
        assert [spark.range(n).where(h <= c).count() for h, c in zip(hashes, cuts, strict=True)] == [ones] * 3


def test_the_scorecard_searches_the_real_table_once(spark, tables, meta, monkeypatch):
    """dcr and nndr take one search of the synthetic and the holdout rows together, and its values are those of single ones."""
    from gaugework.plans import neighbors as N
    from gaugework.registry import Context

    asked, own, holdout = [], N.knn, people(spark, 100, 9)
    monkeypatch.setattr(N, "knn", lambda *a, **k: asked.append(a[3]) or own(*a, **k))
    r = g.evaluate_with(g.registry.subset(["dcr", "nndr"]), tables["real"], tables["good"], meta, holdout=holdout)
    assert asked == [2] and not [x.error for x in r.results if x.error]
    ctx = Context(tables["real"], tables["good"], meta, holdout=holdout)
    rows, space = ctx.shared
    side = {s: rows.where(rows["_side"] == s) for s in "rsh"}
    for a, b, k in (("s", "r", 1), ("h", "r", 2), ("r", "r", 1), ("r", "s", 2), ("r", "r", 3)):
        want = {x["_id"]: (x["d"], x["nn"]) for x in own(side[a], side[b], space, k, exclude_self=a == b).collect()}
        assert {x["_id"]: (x["d"], x["nn"]) for x in ctx.near(a, b, k).collect()} == want
