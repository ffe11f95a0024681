"""Metrics over columns and pairs of columns: congruence and coverage."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import functions as F

from ..functions.scores import clip, ks_p_value, mean
from ..functions.storage import saved
from ..plans import kernels as K
from ..plans import line as L
from ..plans import models as M
from ..plans import neighbors as N
from ..registry import Context, Metric, MetricResult, MetricSpec, Skip, registry
from ..schema import ColumnType
from . import tables as T


def rows_of(df, order: list[str], key: str = "column") -> dict[str, dict]:
    """Small table -> {column: row} in metadata order."""
    got = {r[key]: r.asDict() for r in df.collect()}
    return {c: got[c] for c in order if c in got}


def need(columns: list[str], what: str) -> list[str]:
    if not columns:
        raise Skip(f"no {what} column")
    return columns


def left_out(out: MetricResult, wanted: list[str], got) -> None:
    out.notes += [f"{c}: not measurable on both sides" for c in wanted if c not in got]


def averaged(out: MetricResult, rows: dict[str, dict], value: str, scalar: str, shown: tuple[str, ...] | None = None, score=lambda m: 1 - clip(m)) -> float:
    if not rows:
        raise Skip("no column could be measured")
    out.per_column = {c: {k: float(r[k]) for k in shown or (value,)} for c, r in rows.items()}
    m = mean(r[value] for r in rows.values())
    out.scalars = {"score": score(m), scalar: m}
    return m


@registry.register
class CiOverlap(Metric):
    spec = MetricSpec("ci_overlap", "congruence")
    options = ("use_real_se",)
    use_real_se = False

    def measure(self, ctx: Context, out: MetricResult) -> None:
        cols = need(ctx.meta.numeric, "numeric")
        rows = rows_of(T.ci_overlap(ctx.pair, cols, self.use_real_se, ctx.moments), cols)
        left_out(out, cols, rows)
        averaged(out, rows, "ci_overlap", "mean_ci_overlap", score=clip)


@registry.register
class CorrelationDifference(Metric):
    spec = MetricSpec("correlation_difference", "congruence", scope="pair")

    def measure(self, ctx: Context, out: MetricResult) -> None:
        cols = [c.name for c in ctx.meta if c.dtype in (ColumnType.NUMERIC, ColumnType.CATEGORICAL)]
        if len(cols) < 2:
            raise Skip("fewer than two numeric or categorical columns")
        place = {c: i for i, c in enumerate(cols)}
        rows = sorted(T.associations(ctx.pair, cols, ctx.meta).collect(), key=lambda r: (place[r["a"]], place[r["b"]]))
        for r in rows:
            if r["abs_corr_diff"] is None:
                out.notes.append(f"{r['a']}|{r['b']}: association is undefined on the {'real' if r['real'] is None else 'synthetic'} side")
        averaged(out, {f"{r['a']}|{r['b']}": r.asDict() for r in rows if r["abs_corr_diff"] is not None}, "abs_corr_diff", "mean_abs_corr_diff")


@registry.register
class DimensionWiseMeans(Metric):
    spec = MetricSpec("dimension_wise_means", "congruence")

    def measure(self, ctx: Context, out: MetricResult) -> None:
        cols = need(ctx.meta.numeric, "numeric")
        rows = rows_of(T.standardised_means(ctx.pair, cols, ctx.moments), cols)
        left_out(out, cols, rows)
        averaged(out, rows, "std_mean_diff", "mean_abs_std_diff")


@registry.register
class Hellinger(Metric):
    spec = MetricSpec("hellinger", "congruence")

    def measure(self, ctx: Context, out: MetricResult) -> None:
        cols = [c.name for c in ctx.meta if c.dtype in (ColumnType.NUMERIC, ColumnType.CATEGORICAL)]
        rows = rows_of(T.hellinger(ctx.pair, ctx.meta.numeric, ctx.meta.categorical, 20, ctx.moments if ctx.meta.numeric else None, ctx.labels if ctx.meta.categorical else None), cols)
        averaged(out, {c: r for c, r in rows.items() if r["hellinger"] is not None}, "hellinger", "mean_hellinger")


@registry.register
class KsStatistic(Metric):
    spec = MetricSpec("ks_statistic", "congruence")

    def measure(self, ctx: Context, out: MetricResult) -> None:
        cols = need(ctx.meta.numeric, "numeric")
        rows = rows_of(T.ks(ctx.pair, cols, ctx.sweep), cols)
        left_out(out, cols, rows)
        for r in rows.values():
            r["p_value"] = ks_p_value(r["ks_statistic"], r["n_r"], r["n_s"])
        averaged(out, rows, "ks_statistic", "mean_ks_statistic", ("ks_statistic", "p_value"))
        worst = max(rows, key=lambda c: rows[c]["ks_statistic"])
        m = {r["column"]: r for r in ctx.moments.collect()}[worst]
        lo, hi = min(m.lo_r, m.lo_s), max(m.hi_r, m.hi_s)
        edges = K.bins(lo, hi, 30) if hi > lo else [lo, lo + 1]
        counts = {(r["_side"], int(r["label"])): r["n"] for r in K.histogram(ctx.pair.where("_side <> 'h'"), {worst: edges}).groupBy("_side", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
        out.plot_payload = {"kind": "histogram", "column": worst, "edges": edges, "real": [counts.get(("r", i), 0) for i in range(1, len(edges))], "synthetic": [counts.get(("s", i), 0) for i in range(1, len(edges))]}


@registry.register
class Pmse(Metric):
    spec = MetricSpec("pmse", "congruence", scope="table")
    options = ("n_permutations",)
    n_permutations = 20

    def measure(self, ctx: Context, out: MetricResult) -> None:
        if not (ctx.sizes["r"] and ctx.sizes["s"]):
            raise Skip("a table is empty")
        data, width = M.vectors(ctx.pair.where("_side <> 'h'"), ctx.meta)
        n = ctx.sizes["r"] + ctx.sizes["s"]
        if width + 1 >= n:
            raise Skip("as many encoded features as rows")
        share = ctx.sizes["s"] / n
        if n >= M.MANY and width <= M.NARROW:
            value, permuted = M.propensity_mses(data, share, n, ctx.sizes["s"], [ctx.random_state + i for i in range(self.n_permutations)])
            null = mean(permuted)
        else:
            data = M.standardised(data).persist()
            value = M.propensity_mse(data, share, n)
            with ThreadPoolExecutor(3) as pool:  # one fit leaves cores idle between its short jobs
                null = mean(pool.map(lambda i: M.propensity_mse(M.permuted(data, ctx.random_state + i, ctx.sizes["s"], n), share, n), range(self.n_permutations)))
            data.unpersist()
        worst = share * (1 - share)
        score = clip(1 - (value - null) / (worst - null)) if worst > null else 1.0
        out.scalars = {"score": score, "pmse": value, "pmse_null": null, "pmse_ratio": value / null if null else math.nan}


@registry.register
class QuantileMse(Metric):
    spec = MetricSpec("quantile_mse", "congruence")

    def measure(self, ctx: Context, out: MetricResult) -> None:
        cols = need(ctx.meta.numeric, "numeric")
        rows = rows_of(T.quantile_mse(ctx.pair, cols, ctx.moments), cols)
        left_out(out, cols, rows)
        averaged(out, rows, "quantile_mse", "mean_quantile_mse", score=lambda m: clip(1 - math.sqrt(m)))


@registry.register
class Tvd(Metric):
    spec = MetricSpec("tvd", "congruence")

    def measure(self, ctx: Context, out: MetricResult) -> None:
        cols = need(ctx.meta.categorical, "categorical")
        rows = rows_of(T.tvd(ctx.pair, cols, True, ctx.labels), cols)
        averaged(out, rows, "tvd", "mean_tvd")
        worst = max(rows, key=lambda c: rows[c]["tvd"])
        f = ctx.labels.where(F.col("column") == worst).orderBy(F.desc("n_r"), "label").limit(30).collect()
        out.plot_payload = {"kind": "bars", "column": worst, "labels": [r["label"] for r in f], "real": [r["p_r"] for r in f], "synthetic": [r["p_s"] for r in f]}


@registry.register
class Wasserstein(Metric):
    spec = MetricSpec("wasserstein", "congruence")

    def measure(self, ctx: Context, out: MetricResult) -> None:
        out.notes += [f"{c.name}: not numeric" for c in ctx.meta if c.dtype is not ColumnType.NUMERIC]
        cols = need(ctx.meta.numeric, "numeric")
        averaged(out, rows_of(T.wasserstein(ctx.pair, cols, ctx.sweep, ctx.moments), cols), "normalised", "mean_wasserstein", ("wasserstein",))


@registry.register
class C2st(Metric):
    spec = MetricSpec("c2st", "congruence", "extended", scope="table")

    def measure(self, ctx: Context, out: MetricResult) -> None:
        if min(ctx.sizes["r"], ctx.sizes["s"]) < 5:
            raise Skip("fewer than 5 rows on a side")
        data, _ = M.vectors(ctx.pair.where("_side <> 'h'"), ctx.meta)
        folds = M.folds(data, 5, ctx.random_state, "y")
        areas = []
        for i in range(5):
            model = M.logistic(folds.where(f"fold <> {i}"), "y", ctx.sizes["r"] + ctx.sizes["s"] - (ctx.sizes["r"] + ctx.sizes["s"]) // 5)
            areas.append(M.area(model.transform(folds.where(f"fold = {i}")), "y"))
        a = mean(areas)
        out.scalars = {"score": max(0.0, 1 - 2 * abs(a - 0.5)), "c2st_auc": a}


@registry.register
class Jsd(Metric):
    spec = MetricSpec("jsd", "congruence", "extended")

    def measure(self, ctx: Context, out: MetricResult) -> None:
        if not (ctx.sizes["r"] and ctx.sizes["s"]):
            raise Skip("a table is empty")
        cols = need(ctx.meta.categorical, "categorical")
        averaged(out, rows_of(T.jsd(ctx.pair, cols, ctx.labels), cols), "jsd", "mean_jsd", score=lambda m: 1 - m)


def mmd_of(rows, space: N.Space, cap: int | None, seed: int, block: int = 4096) -> float:
    """Biased maximum mean discrepancy of all rows, or of at most ``cap`` rows a side: along lines if there is one number at most, else over a grid of blocks."""
    sides = [N.cap(T.side(rows, s), cap, seed) if cap else T.side(rows, s) for s in "rs"]
    pool = saved(N.pooled(sides[0].unionByName(sides[1]), space)[0], "mmd")
    n = pool.count()
    line = n > block and L.on_a_line(pool, space)
    width = L.median(pool, space, n) if line else N.pooled_median(pool, space, n, block)
    gamma = 1 / (2 * width * width + 1e-12)
    return math.sqrt(max(0.0, L.kernel_sum(pool, space, gamma) if line else N.kernel_sum(pool, space, n, gamma, block)))


@registry.register
class Mmd(Metric):
    spec = MetricSpec("mmd", "congruence", "extended", scope="table")
    options = ("cap",)
    cap: int | None = None  # rows are compared in blocks, so nothing has to be left out; a number samples each side

    def measure(self, ctx: Context, out: MetricResult) -> None:
        if not (ctx.sizes["r"] and ctx.sizes["s"]):
            raise Skip("a table is empty")
        value = mmd_of(*ctx.space("euclidean"), self.cap, ctx.random_state)
        if self.cap and max(ctx.sizes["r"], ctx.sizes["s"]) > self.cap:
            out.notes.append(f"{self.cap} rows a side")
        out.scalars = {"score": 1 - clip(value), "mmd": value}


@registry.register
class MutualInformationDifference(Metric):
    spec = MetricSpec("mutual_information_difference", "congruence", "extended", scope="pair")

    def measure(self, ctx: Context, out: MetricResult) -> None:
        if len(ctx.meta.numeric) + len(ctx.meta.labelled) < 2:
            raise Skip("fewer than two columns")
        m = mean(r["abs_mi_diff"] for r in T.mutual_information(ctx.pair, ctx.meta.numeric, ctx.meta.labelled).collect())
        out.scalars = {"score": 1 - clip(m), "mean_mi_diff": m}


def random_directions(n: int, width: int, seed: int) -> list[list[float]]:
    x = np.random.default_rng(seed).normal(size=(n, width))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).tolist()


@registry.register
class SlicedWasserstein(Metric):
    spec = MetricSpec("sliced_wasserstein", "congruence", "extended", scope="table")

    def measure(self, ctx: Context, out: MetricResult) -> None:
        cols = self.usable(ctx, need(ctx.meta.numeric, "numeric"), out)
        w = mean(r["w1"] for r in T.sliced(ctx.pair.where("_side <> 'h'"), cols, random_directions(50, len(cols), ctx.random_state)).collect())
        out.scalars = {"score": max(0.0, 1 - w / 3), "sliced_wasserstein": w}

    @staticmethod
    def usable(ctx: Context, cols: list[str], out: MetricResult) -> list[str]:
        """Drop columns that are empty on a side or constant on the real one among complete rows, until none is."""
        pair = ctx.pair.where("_side <> 'h'")
        while True:
            ok = F.lit(True)
            for c in cols:
                ok &= T.number(c).isNotNull() & (F.abs(T.number(c)) < F.lit(float("inf")))
            m = {r["column"]: r for r in K.moments(pair.where(ok), cols).collect()}
            if len(m) == len(cols) and all(m[c].n_r and m[c].n_s for c in cols):
                keep = [c for c in cols if m[c].lo_r < m[c].hi_r]
            else:  # no complete row is left on a side: drop what has the fewest values
                n = {r["column"]: min(r.n_r or 0, r.n_s or 0) for r in K.moments(pair, cols).collect()}
                keep = [c for c in cols if c != min(cols, key=lambda c: n.get(c, 0))]
            out.notes += [f"{c}: constant or without finite values" for c in cols if c not in keep]
            if not keep:
                raise Skip("no numeric column varies on complete rows")
            if keep == cols:
                return cols
            cols = keep


# ---- coverage --------------------------------------------------------------------------------


@registry.register
class CategoryCoverage(Metric):
    spec = MetricSpec("category_coverage", "coverage")

    def measure(self, ctx: Context, out: MetricResult) -> None:
        out.notes += [f"{c.name}: not categorical" for c in ctx.meta if c.dtype is not ColumnType.CATEGORICAL]
        cols = need(ctx.meta.categorical, "categorical")
        averaged(out, rows_of(T.category_coverage(ctx.pair, cols, ctx.labels), cols), "coverage", "mean_coverage", score=clip)


@registry.register
class EntropyRatio(Metric):
    spec = MetricSpec("entropy_ratio", "coverage")

    def measure(self, ctx: Context, out: MetricResult) -> None:
        cols = need(ctx.meta.categorical, "categorical")
        rows = rows_of(T.entropy_ratio(ctx.pair, cols, ctx.labels), cols)
        left_out(out, cols, rows)
        averaged(out, rows, "ratio", "score", ("ratio", "entropy_real", "entropy_synthetic"), score=clip)


@registry.register
class NoveltyRate(Metric):
    spec = MetricSpec("novelty_rate", "coverage", scope="table")

    def measure(self, ctx: Context, out: MetricResult) -> None:
        if not ctx.sizes["s"]:
            raise Skip("the synthetic table is empty")
        r = K.matches(ctx.real, ctx.synthetic, ctx.meta).first()
        rate = 1 - r["matched"] / r["n"]
        out.scalars = {"score": rate, "novelty_rate": rate, "duplicates": float(r["matched"])}


@registry.register
class RangeCoverage(Metric):
    spec = MetricSpec("range_coverage", "coverage")

    def measure(self, ctx: Context, out: MetricResult) -> None:
        cols = need(ctx.meta.numeric, "numeric")
        rows = rows_of(T.range_coverage(ctx.pair, cols, ctx.moments), cols)
        out.notes += [f"{c}: constant in the real table" for c, r in rows.items() if r["constant"]]
        averaged(out, rows, "coverage", "mean_coverage", score=clip)


@registry.register
class AlphaPrecisionBetaRecall(Metric):
    spec = MetricSpec("alpha_precision_beta_recall", "coverage", "extended", scope="table")

    def measure(self, ctx: Context, out: MetricResult) -> None:
        n = min(ctx.sizes["r"], ctx.sizes["s"])
        if n < 2:
            raise Skip("fewer than two rows on a side")
        k = max(1, min(5, n - 1))
        alpha, beta = (T.first_quantile(N.kth(ctx.near(s, s, k), k), [0.9]).first()["q"][0] for s in "rs")
        share = lambda a, b, limit: ctx.near(a, b).agg(F.avg((F.element_at("d", 1) <= F.lit(limit)).cast("double"))).first()[0]
        p, r = share("s", "r", alpha), share("r", "s", beta)
        out.scalars = {"score": (p + r) / 2, "alpha_precision": p, "beta_recall": r}
        out.notes += ctx.capped()


@registry.register
class Authenticity(Metric):
    spec = MetricSpec("authenticity", "coverage", "extended", scope="table")

    def measure(self, ctx: Context, out: MetricResult) -> None:
        if ctx.sizes["r"] < 2 or not ctx.sizes["s"]:
            raise Skip("fewer than two real rows or no synthetic row")
        limit = 0.05 * T.first_quantile(N.kth(ctx.near("r", "r"), 1), [0.5]).first()["q"][0]
        rate = ctx.near("s", "r").agg(F.avg((F.element_at("d", 1) > F.lit(limit)).cast("double"))).first()[0]
        out.scalars = {"score": rate, "authenticity": rate}
        out.notes += ctx.capped()


@registry.register
class NnAdversarialAccuracy(Metric):
    spec = MetricSpec("nn_adversarial_accuracy", "coverage", "extended", scope="table")

    def measure(self, ctx: Context, out: MetricResult) -> None:
        if min(ctx.sizes["r"], ctx.sizes["s"]) < 2:
            raise Skip("fewer than two rows on a side")

        def beyond(a: str, b: str) -> float:
            x, y = N.kth(ctx.near(a, b), 1).withColumnRenamed("d", "x"), N.kth(ctx.near(a, a), 1).withColumnRenamed("d", "y")
            return x.join(y, "_id").agg(F.avg((F.col("x") > F.col("y")).cast("double"))).first()[0]

        aa = (beyond("r", "s") + beyond("s", "r")) / 2
        out.scalars = {"score": clip(1 - 2 * abs(aa - 0.5)), "nn_adversarial_accuracy": aa}
        out.notes += ctx.capped()


@registry.register
class PcaScatter(Metric):
    spec = MetricSpec("pca_scatter", "coverage", "extended", scope="table", scoring=False)

    def measure(self, ctx: Context, out: MetricResult) -> None:
        data, width = M.vectors(ctx.pair.where("_side <> 'h'"), ctx.meta)
        if width < 2:
            raise Skip("fewer than two encoded columns")
        points = M.principal(data, 2).orderBy(F.md5(F.col("_row").cast("string").cast("binary"))).limit(1000).collect()
        out.plot_payload = {"kind": "scatter", "real": [list(r["p"]) for r in points if not r["y"]], "synthetic": [list(r["p"]) for r in points if r["y"]]}
