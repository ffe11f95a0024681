"""Metrics over rows, groups and models: compliance, fairness, preservation and utility."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import saved
from ..functions.scores import clip, mean, spearman, weighted_median
from ..plans import kernels as K
from ..plans import models as M
from ..plans import neighbors as N
from ..registry import Context, Metric, MetricResult, MetricSpec, Skip, registry
from ..schema import ColumnType, Metadata, MetricError, label, number, plain_label
from . import tables as T
from .columns import averaged, need, rows_of


@dataclass(frozen=True)
class FairnessSpec:
    protected_attribute: str
    outcome: str
    favourable_outcome: Any = None


def is_number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def as_label(x: Any) -> str:
    return str(x).lower() if isinstance(x, bool) else str(x)


def one_of(column: str, values: list) -> Column:
    """The column is one of some values: numbers by value (1 is 1.0), others as labels."""
    out = plain_label(column).isin([as_label(x) for x in values])
    if numbers := [float(x) for x in values if is_number(x)]:
        out |= F.coalesce(number(column).isin(numbers), F.lit(False))
    return out


@dataclass(frozen=True)
class SubgroupSpec:
    """AND-ed conditions: a list means one of these labels, a pair (lo, hi) an inclusive range with open ends."""

    name: str
    conditions: dict[str, list | tuple] = field(default_factory=dict)

    def validate(self, meta: Metadata) -> str | None:
        for c, v in self.conditions.items():
            if c not in meta.columns:
                return f"{self.name}: unknown column {c!r}"
            if isinstance(v, tuple) != (meta.columns[c].dtype is ColumnType.NUMERIC):
                return f"{self.name}: column {c!r} needs {'a list' if isinstance(v, tuple) else 'a range'}"
        return None

    def column(self) -> Column:
        out = F.lit(True)
        for c, v in self.conditions.items():
            if isinstance(v, tuple):
                lo, hi = v
                x = number(c)
                out &= x.isNotNull()
                out &= F.lit(True) if lo is None else x >= F.lit(float(lo))
                out &= F.lit(True) if hi is None else x <= F.lit(float(hi))
            else:
                out &= one_of(c, v)
        return F.coalesce(out, F.lit(False))


def runnable(specs: list[SubgroupSpec], meta: Metadata, out: MetricResult) -> list[SubgroupSpec]:
    good = []
    for s in specs:
        if why := s.validate(meta):
            out.notes.append(why)
        else:
            good.append(s)
    if not good:
        raise Skip("no subgroup can be evaluated")
    return good


def q(d: DataFrame, probs: list[float]) -> list[float]:
    return T.first_quantile(d, probs).first()["q"]


# ---- compliance ------------------------------------------------------------------------------


@registry.register
class Dcr(Metric):
    spec = MetricSpec("dcr", "compliance", scope="table")

    def measure(self, ctx: Context, out: MetricResult) -> None:
        if not (ctx.sizes["r"] and ctx.sizes["s"]):
            raise Skip("a table is empty")
        p05, median = q(N.kth(ctx.near("s", "r"), 1), [0.05, 0.5])
        out.scalars = {"median_dcr": median, "p05_dcr": p05}
        out.notes += ctx.capped()
        if ctx.sizes["h"]:
            h05, hmed = q(N.kth(ctx.near("h", "r"), 1), [0.05, 0.5])
            out.scalars |= {"score": clip(p05 / (h05 + 1e-12)), "median_dcr_holdout": hmed, "p05_dcr_holdout": h05}
            return
        if ctx.sizes["r"] < 2:
            raise Skip("fewer than two real rows and no holdout")
        base = q(N.kth(ctx.near("r", "r"), 1), [0.05])[0]
        if base == 0 and p05 == 0:
            raise Skip("no distance baseline: real rows repeat")
        out.scalars |= {"score": 1.0 if base == 0 else min(1.0, p05 / base), "p05_dcr_real": base}


@registry.register
class HittingRate(Metric):
    spec = MetricSpec("hitting_rate", "compliance", scope="table")
    options = ("cap",)
    cap: int | None = None  # the band join compares all rows; a number samples each side

    def measure(self, ctx: Context, out: MetricResult) -> None:
        num, cat = ctx.meta.numeric, ctx.meta.categorical
        if not num and not cat:
            raise Skip("no numeric or categorical column")
        if not ctx.sizes["r"]:
            raise Skip("a table is empty")
        m = {r["column"]: r for r in K.profile(ctx.pair.where("_side = 'r'"), num).collect()} if num else {}
        limits = {c: ((m[c]["hi"] - m[c]["lo"]) / 30 if m[c]["lo"] is not None else 0.0) for c in num}
        pair = ctx.pair
        if self.cap and max(ctx.sizes["r"], ctx.sizes["s"]) > self.cap:
            sides = [N.cap(pair.where(F.col("_side") == s).withColumn("_id", F.col("_row")), self.cap, ctx.random_state).drop("_id") for s in "rs"]
            pair = sides[0].unionByName(sides[1])
            out.notes.append(f"{self.cap} rows a side")
        r = T.hits(pair, num, cat, limits, "_row").first()
        rate = r["n_hit"] / r["n_real"]
        out.scalars = {"score": 1 - rate, "hit_rate": rate}


@registry.register
class IdenticalMatchRate(Metric):
    spec = MetricSpec("identical_match_rate", "compliance", scope="table")

    def measure(self, ctx: Context, out: MetricResult) -> None:
        r = K.matches(ctx.real, ctx.synthetic, ctx.meta).first()
        rate = r["matched"] / r["n"] if r["n"] else 0.0
        out.scalars = {"score": 1 - rate, "identical_match_rate": rate, "identical_matches": float(r["matched"])}


@registry.register
class KAnonymity(Metric):
    spec = MetricSpec("k_anonymity", "compliance", requires_real=False, scope="table")

    def measure(self, ctx: Context, out: MetricResult) -> None:
        if not ctx.meta.quasi_identifiers:
            raise Skip("no quasi-identifier is declared")
        r = K.group_sizes(ctx.synthetic, ctx.meta.quasi_identifiers).agg(F.min("n").alias("k"), F.count(F.lit(1)).alias("g")).first()
        out.scalars = {"score": min(1.0, (r["k"] or 0) / 5), "min_k": float(r["k"] or 0), "unique_groups": float(r["g"])}


@registry.register
class Nndr(Metric):
    spec = MetricSpec("nndr", "compliance", scope="table")

    def measure(self, ctx: Context, out: MetricResult) -> None:
        if ctx.sizes["r"] < 2 or not ctx.sizes["s"]:
            raise Skip("fewer than two real rows or no synthetic row")
        ratio = F.when(F.element_at("d", 2) == 0, F.lit(0.0)).otherwise(F.try_divide(F.element_at("d", 1), F.element_at("d", 2)))
        median = lambda a: q(ctx.near(a, "r", 2).select("_id", ratio.alias("d")), [0.5])[0]
        s = median("s")
        out.scalars = {"score": clip(s), "nndr_median": s}
        out.notes += ctx.capped()
        if ctx.sizes["h"]:
            h = median("h")
            out.scalars |= {"score": clip(s / (h + 1e-12)), "nndr_median_holdout": h}


def disclosure(rows: DataFrame, space: N.Space, pair: DataFrame, sensitive: list[str], limits: dict[str, float], id_column: str, meta: Metadata) -> DataFrame:
    """-> disclosure_rate: all sensitive values of the nearest synthetic row are right (numbers within their limits)."""
    near = T.near(rows, space, "r", "s", 1).select("_id", "nn")
    value = lambda c: number(c) if meta.columns[c].dtype is ColumnType.NUMERIC else label(c)
    take = lambda s, p: pair.where(F.col("_side") == s).select(F.col(f"`{id_column}`").cast("long").alias(f"{p}_id"), *[value(c).alias(f"{p}{i}") for i, c in enumerate(sensitive)])
    got = near.join(take("r", "a"), F.col("_id") == F.col("a_id")).join(take("s", "b"), F.col("nn") == F.col("b_id"))
    right = F.lit(True)
    for i, c in enumerate(sensitive):
        right &= F.coalesce(F.abs(F.col(f"a{i}") - F.col(f"b{i}")) <= F.lit(limits[c]), F.lit(False)) if c in limits else F.col(f"a{i}") == F.col(f"b{i}")
    return got.agg(F.avg(right.cast("double")).alias("disclosure_rate"))


@registry.register
class AttributeDisclosure(Metric):
    spec = MetricSpec("attribute_disclosure", "compliance", "extended", scope="table")

    def measure(self, ctx: Context, out: MetricResult) -> None:
        meta = ctx.meta
        sensitive = meta.sensitive
        linkable = [c.name for c in meta if c.dtype in (ColumnType.NUMERIC, ColumnType.CATEGORICAL) and not c.sensitive]
        if meta.quasi_identifiers:
            linkable = [c for c in linkable if c in meta.quasi_identifiers]
        if not sensitive or not linkable:
            raise Skip("no sensitive column or no usable quasi-identifier")
        if not ctx.sizes["s"] or not ctx.sizes["r"]:
            raise Skip("a table is empty")
        rows, space = ctx.space(None, [c for c in meta.numeric if c in linkable], [c for c in meta.categorical if c in linkable], capped=False)
        numbers = [c for c in sensitive if meta.columns[c].dtype is ColumnType.NUMERIC]
        limits = {r["column"]: ((r["hi"] - r["lo"]) / 30 if r["lo"] is not None else 0.0) for r in K.profile(ctx.pair.where("_side = 'r'"), numbers).collect()} if numbers else {}
        rate = disclosure(rows, space, ctx.pair, sensitive, limits, "_row", meta).first()[0]
        out.scalars = {"score": 1 - rate, "disclosure_rate": rate}


@registry.register
class DpLedger(Metric):
    """The privacy budget that the generator's maker states: evaluate(..., dp_ledger={'epsilon': e, 'delta': d})."""

    spec = MetricSpec("dp_ledger", "compliance", "extended", requires_real=False, scope="table", scoring=False)
    options = ("ledger",)
    ledger: dict | None = None

    def measure(self, ctx: Context, out: MetricResult) -> None:
        if not self.ledger:
            raise Skip("no ledger is given")
        out.scalars = {k: float(self.ledger[k]) for k in ("epsilon", "delta") if k in self.ledger}


@registry.register
class EpsilonIdentifiability(Metric):
    spec = MetricSpec("epsilon_identifiability", "compliance", "extended", scope="table")

    def measure(self, ctx: Context, out: MetricResult) -> None:
        if ctx.sizes["r"] < 2 or not ctx.sizes["s"]:
            raise Skip("fewer than two real rows or no synthetic row")
        a, b = N.kth(ctx.near("r", "s"), 1).withColumnRenamed("d", "x"), N.kth(ctx.near("r", "r"), 1).withColumnRenamed("d", "y")
        risk = a.join(b, "_id").agg(F.avg((F.col("x") <= F.col("y")).cast("double"))).first()[0]
        out.scalars = {"score": 1 - risk, "identifiability_risk": risk}
        out.notes += ctx.capped()


@registry.register
class MiaAuc(Metric):
    spec = MetricSpec("mia_auc", "compliance", "extended", scope="table")

    def measure(self, ctx: Context, out: MetricResult) -> None:
        if ctx.holdout is None:
            raise Skip("no holdout")
        if not all(ctx.sizes.values()):
            raise Skip("a table is empty")
        shared = ctx.shared if ctx.distance == "euclidean" else ctx.space("euclidean")
        sides = [N.kth(ctx.near(s, "s", 1, shared), 1).select((-F.col("d")).alias("p"), F.lit(s == "r").alias("pos")) for s in "rh"]
        a = N.auc(sides[0].unionAll(sides[1]), "p", "pos").first()["auc"]
        out.scalars = {"score": 1 - 2 * max(0.0, a - 0.5), "mia_auc": a}


# ---- fairness --------------------------------------------------------------------------------


@registry.register
class StatisticalParity(Metric):
    spec = MetricSpec("statistical_parity", "fairness", "extended", scope="table")
    options = ("specs",)
    specs: list[FairnessSpec] = []

    def measure(self, ctx: Context, out: MetricResult) -> None:
        first = None
        for s in self.specs:
            if bad := [c for c in (s.protected_attribute, s.outcome) if c not in ctx.meta.columns]:
                out.notes.append(f"unknown column {bad[0]!r}")
                continue
            good, by_value = s.favourable_outcome, ctx.meta.columns[s.outcome].dtype is ColumnType.NUMERIC
            if good is None:  # the largest outcome
                good = ctx.pair.where("_side <> 'h'").agg(F.max(number(s.outcome) if by_value else plain_label(s.outcome))).first()[0]
            r = T.parity(ctx.pair, s.protected_attribute, s.outcome, float(good) if by_value and is_number(good) else as_label(good)).first()
            out.per_column[f"{s.protected_attribute}|{s.outcome}"] = r.asDict()
            first = first or r.asDict()
        if first is None:
            raise Skip("no fairness specification can be evaluated")
        out.scalars = {"score": clip(1 - mean(r["parity_drift"] for r in out.per_column.values()))} | first


# ---- preservation ----------------------------------------------------------------------------


@registry.register
class RareCategoryRetention(Metric):
    spec = MetricSpec("rare_category_retention", "preservation", "extended")
    options = ("rare_threshold",)
    rare_threshold = 0.05

    def measure(self, ctx: Context, out: MetricResult) -> None:
        cols = need(ctx.meta.labelled, "categorical")
        rows = rows_of(T.rare_categories(ctx.pair, cols, self.rare_threshold), cols)
        if not rows:
            raise Skip("no rare category")
        n = sum(r["n_rare"] for r in rows.values())
        out.per_column = {c: {"retention": r["retention"]} for c, r in rows.items()}
        out.scalars = {"score": sum(r["kept"] for r in rows.values()) / n, "n_rare_categories": float(n), "pct_rare_missing": sum(r["n_missing"] for r in rows.values()) / n}


@registry.register
class TailCoverage(Metric):
    spec = MetricSpec("tail_coverage", "preservation", "extended")
    options = ("tail_quantile",)
    tail_quantile = 0.05

    def measure(self, ctx: Context, out: MetricResult) -> None:
        if not 0 < self.tail_quantile < 0.5:
            raise MetricError("tail_quantile must lie between 0 and 0.5")
        cols = need(ctx.meta.numeric, "numeric")
        rows = rows_of(T.tail_coverage(ctx.pair, cols, self.tail_quantile), cols)
        tails = {c: [r[k] for k in ("lower", "upper") if r[k] is not None] for c, r in rows.items()}
        every = [x for t in tails.values() for x in t]
        if not every:
            raise Skip("no tail can be measured")
        out.per_column = {c: {"tail_coverage": mean(t)} for c, t in tails.items() if t}
        out.scalars = {"score": mean(every)}
        for k in ("lower", "upper"):
            if got := [r[k] for r in rows.values() if r[k] is not None]:
                out.scalars[f"{k}_tail_coverage"] = mean(got)


@registry.register
class MinorityClassDensity(Metric):
    spec = MetricSpec("minority_class_density", "preservation", "extended")

    def measure(self, ctx: Context, out: MetricResult) -> None:
        cols = need(ctx.meta.labelled, "categorical")
        rows = rows_of(T.minority_density(ctx.pair, cols), cols)
        averaged(out, rows, "density_ratio", "score", score=clip)
        out.scalars["worst_density_ratio"] = min(r["density_ratio"] for r in rows.values())


@registry.register
class SubgroupFidelity(Metric):
    spec = MetricSpec("subgroup_fidelity", "preservation", "extended", scope="table")
    options = ("subgroup_specs", "min_rows")
    subgroup_specs: list[SubgroupSpec] = []
    min_rows = 10

    def measure(self, ctx: Context, out: MetricResult) -> None:
        specs = runnable(self.subgroup_specs, ctx.meta, out)
        where = {s.name: s.column() for s in specs}
        rows = rows_of(T.subgroup_shapes(ctx.pair.where("_side <> 'h'"), where, ctx.meta.numeric, ctx.meta.labelled), list(where), "subgroup")
        for s in specs:
            r = rows.get(s.name)
            if r is None or r["n_real"] < self.min_rows:
                out.notes.append(f"{s.name}: fewer than {self.min_rows} real rows")
                continue
            drift = abs((r["share_real"] or 0.0) - (r["share_syn"] or 0.0))
            if not r["n_syn"]:
                shape = score = 0.0
            else:
                shape = 1.0 if r["shape_score"] is None else r["shape_score"]
                ratio = min(r["share_real"], r["share_syn"]) / max(r["share_real"], r["share_syn"])
                score = (shape + ratio) / 2
            out.per_column[s.name] = {"share_real": r["share_real"], "share_syn": r["share_syn"] or 0.0, "shape_score": shape, "score": score, "drift": drift}
        if not out.per_column:
            raise Skip("no subgroup could be measured")
        got = out.per_column.values()
        out.scalars = {"score": mean(r["score"] for r in got), "worst_subgroup_score": min(r["score"] for r in got), "mean_share_drift": mean(r.pop("drift") for r in got)}


@registry.register
class MinorityUtilityGap(Metric):
    spec = MetricSpec("minority_utility_gap", "preservation", "extended", scope="table")
    options = ("tasks", "subgroup_specs", "min_rows")
    tasks: list[M.UtilityTask] = []
    subgroup_specs: list[SubgroupSpec] = []
    min_rows = 10

    def accuracies(self, train: DataFrame, test: DataFrame, task: M.UtilityTask, meta: Metadata, classes: list[str], inside: list[Column]) -> list[dict[str, float]] | None:
        """Balanced accuracy over all of ``test`` and in each subgroup, with its rows and classes; None if there is nothing to learn."""
        train, test = (d.withColumn("_y", M.class_index(task.target, classes)).where("_y >= 0") for d in (train, test))
        s = train.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("_y").alias("k")).first()
        if s["k"] < 2:
            return None
        ready = M.prepare(train, M.feature_columns(task, meta), meta)
        parts = [F.lit(True), *inside]
        rows = test.withColumns({f"_in{i}": x for i, x in enumerate(parts)})
        got = M.estimator("linear", "classification", s["n"], len(classes), 1.0, 0).fit(ready.apply(train)).transform(ready.apply(rows))
        hit = F.col("_y") == F.col("prediction")
        counts = [f(i) for i in range(len(parts)) for f in (lambda i: F.count_if(f"_in{i}").alias(f"n{i}"), lambda i: F.count_if(F.col(f"_in{i}") & hit).alias(f"k{i}"))]
        table = got.groupBy("_y").agg(*counts).collect()  # a row a class
        out = []
        for i in range(len(parts)):
            there = [r for r in table if r[f"n{i}"]]
            out.append({"n": sum(r[f"n{i}"] for r in there), "classes": len(there), "accuracy": mean(r[f"k{i}"] / r[f"n{i}"] for r in there) if there else 0.0})
        return out

    def measure(self, ctx: Context, out: MetricResult) -> None:
        """The gap of a model is its balanced accuracy over all test rows less that inside the subgroup."""
        tasks = []
        for t in self.tasks:
            if t.target in ctx.meta.columns and M.task_type(t, ctx.meta) == "classification":
                tasks.append(t)
            else:
                out.notes.append(f"{t.target}: only classification is measured")
        if not tasks:
            raise Skip("no classification task")
        specs = runnable(self.subgroup_specs, ctx.meta, out)
        real, inside = ctx.pair.where("_side = 'r'"), [s.column() for s in specs]
        for t in tasks:
            train, test = (real, ctx.pair.where("_side = 'h'")) if ctx.sizes["h"] else M.split(real, None, 0.5, ctx.random_state)
            if (classes := M.classes_of(real, t.target, out.notes)) is None:
                continue
            of_syn, of_real = (self.accuracies(d, test, t, ctx.meta, classes, inside) for d in (ctx.pair.where("_side = 's'"), train))
            if of_syn is None or of_real is None:
                out.notes.append(f"{t.target}: its training rows have fewer than two classes")
                continue
            for i, s in enumerate(specs, 1):
                if of_real[i]["n"] < self.min_rows or of_real[i]["classes"] < 2:
                    out.notes.append(f"{s.name}|{t.target}: {of_real[i]['n']} test rows of {of_real[i]['classes']} classes")
                    continue
                syn, own = (a[0]["accuracy"] - a[i]["accuracy"] for a in (of_syn, of_real))
                out.per_column[f"{s.name}|{t.target}"] = {"gap_synthetic": syn, "gap_real": own, "excess_gap": max(0.0, syn - own)}
        if not out.per_column:
            raise Skip("no pair of task and subgroup could be evaluated")
        got = list(out.per_column.values())
        out.scalars = {"score": mean(clip(1 - r["excess_gap"]) for r in got), "worst_excess_gap": max(r["excess_gap"] for r in got), "mean_gap_synthetic": mean(r["gap_synthetic"] for r in got), "mean_gap_real": mean(r["gap_real"] for r in got)}


@registry.register
class MinorityPrivacyRisk(Metric):
    spec = MetricSpec("minority_privacy_risk", "preservation", "extended", scope="table")
    options = ("subgroup_specs", "min_rows", "cap")
    subgroup_specs: list[SubgroupSpec] = []
    min_rows = 10
    cap: int | None = None  # rows are compared in blocks, so nothing has to be left out; a number samples the real rows

    def measure(self, ctx: Context, out: MetricResult) -> None:
        specs = runnable(self.subgroup_specs, ctx.meta, out)
        if not (ctx.sizes["r"] and ctx.sizes["s"]):
            raise Skip("a table is empty")
        rows, space = ctx.space(None, capped=False)
        member = F.lit(False)
        for s in specs:
            member |= s.column()
        real = ctx.pair.where("_side = 'r'").withColumn("_id", F.col("_row")).withColumn("_member", member).withColumn("_w", F.lit(1.0))
        if self.cap and ctx.sizes["r"] > self.cap:
            real = self.sampled(real, ctx.random_state)
            rows = rows.where("_side <> 'r'").unionByName(rows.where("_side = 'r'").join(real.select("_id"), "_id", "left_semi").select(*rows.columns))
            out.notes.append(f"{self.cap} real rows")
        d = N.kth(ctx.near("r", "s", 1, (rows, space)), 1)
        real = real.join(d, "_id")
        for s in specs:
            inside, rest = real.where(s.column()).select("d"), real.where(~s.column()).select("d")
            n, m = inside.count(), rest.count()
            if min(n, m) < self.min_rows:
                out.notes.append(f"{s.name}: {n} rows inside and {m} outside, of which {self.min_rows} are needed")
                continue
            a = q(inside, [0.5])[0]
            if self.cap:  # the sample is bounded, so its weighted medians are taken here
                b, whole = (weighted_median([(r["d"], r["_w"]) for r in x.select("d", "_w").collect()]) for x in (real.where(~s.column()), real))
            else:
                b, whole = q(rest, [0.5])[0], q(real.select("d"), [0.5])[0]
            if b < 1e-12:
                out.notes.append(f"{s.name}: the rest lies on synthetic rows")
            out.per_column[s.name] = {"risk_ratio": 1.0 if b < 1e-12 else a / b, "median_dcr_subgroup": a, "median_dcr_rest": b, "median_dcr_overall": whole}
        if not out.per_column:
            raise Skip("no subgroup could be measured")
        ratios = [r["risk_ratio"] for r in out.per_column.values()]
        out.scalars = {"score": min(clip(x) for x in ratios), "mean_risk_ratio": mean(ratios), "worst_risk_ratio": min(ratios)}

    def sampled(self, real: DataFrame, seed: int) -> DataFrame:
        """At most ``cap`` rows, half of them kept for members of any subgroup, weighted by what they stand for."""
        n = {bool(r["_member"]): r["count"] for r in real.groupBy("_member").count().collect()}
        m, o = n.get(True, 0), n.get(False, 0)
        take_m = min(m, max(self.cap // 2, self.cap - o))
        parts = [(True, m, take_m), (False, o, min(o, self.cap - take_m))]
        frames = [N.cap(real.where(F.col("_member") == k), t, seed).withColumn("_w", F.lit(size / t)) for k, size, t in parts if t]
        return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])


# ---- utility ---------------------------------------------------------------------------------


def utility_ratio(trtr: float | None, tstr: float | None) -> float | None:
    return None if trtr is None or tstr is None or trtr <= 0 else clip(tstr / trtr)


def task_scores(ctx: Context, task: M.UtilityTask, models: tuple[str, ...], notes: list[str]) -> dict[str, dict[str, float]]:
    """model -> trtr and tstr (trained on real and on synthetic rows, tested on the same real rows or the holdout), and their ratio where trtr is above 0."""
    if task.target not in ctx.meta.columns or not M.feature_columns(task, ctx.meta):
        notes.append(f"{task.target}: unknown or without features")
        return {}
    real, syn = ctx.pair.where("_side = 'r'"), ctx.pair.where("_side = 's'")
    classes: list[str] | None = []
    if M.task_type(task, ctx.meta) == "classification" and (classes := M.classes_of(real, task.target, notes)) is None:
        return {}
    train, test = (real, ctx.pair.where("_side = 'h'")) if ctx.sizes["h"] else M.split(real, task.target if classes else None, 0.7, ctx.random_state)
    keep = [F.col(f"`{c}`") for c in (*M.feature_columns(task, ctx.meta), task.target)]
    train, test = (saved(d.select(*keep), "task") for d in (train, test))  # a split is made once
    of_real, of_syn = (M.fit_and_score(d, test, task, ctx.meta, models, ctx.random_state, classes) for d in (train, syn))
    out = {}
    for m in models:
        trtr, tstr = of_real[m], of_syn[m]
        if trtr is None or tstr is None:
            notes.append(f"{task.target}: too few rows for {m}")
            continue
        out[m] = {"trtr": trtr, "tstr": tstr}
        if (ratio := utility_ratio(trtr, tstr)) is None:
            notes.append(f"{task.target}: the {m} model trained on real rows scores {trtr:.4g}, so no ratio can be given")
        else:
            out[m]["ratio"] = ratio
    return out


@registry.register
class TstrSuite(Metric):
    spec = MetricSpec("tstr_suite", "utility", scope="table")
    options = ("tasks",)
    tasks: list[M.UtilityTask] = []

    def measure(self, ctx: Context, out: MetricResult) -> None:
        for t in self.tasks:
            out.per_column |= {t.target: r for r in task_scores(ctx, t, ("forest",), out.notes).values()}
        ratios = [r["ratio"] for r in out.per_column.values() if "ratio" in r]
        if not ratios:
            raise Skip("no task could be evaluated")
        out.scalars = {"score": mean(ratios)}
        for name, r in out.per_column.items():
            out.scalars |= {f"{'utility_ratio' if k == 'ratio' else k}_{name}": v for k, v in r.items()}


@registry.register
class MultiTargetUtility(Metric):
    """TSTR over every usable target. Where no target can be evaluated it is skipped rather than scored 1."""

    spec = MetricSpec("multi_target_utility", "utility", "extended", scope="table")

    def measure(self, ctx: Context, out: MetricResult) -> None:
        inner = TstrSuite(ctx, tasks=M.suggest_tasks(ctx.meta)).compute(ctx.real, ctx.synthetic, ctx.meta)
        if inner.skip_reason:
            raise Skip(inner.skip_reason)
        out.scalars, out.per_column, out.notes = inner.scalars, inner.per_column, inner.notes


@registry.register
class ModelPanelUtility(Metric):
    spec = MetricSpec("model_panel_utility", "utility", "extended", scope="table")
    options = ("tasks",)
    tasks: list[M.UtilityTask] = []
    #: Name in the result -> model.
    models = {"linear": "linear", "random_forest": "forest", "hist_gbdt": "boosted"}

    def measure(self, ctx: Context, out: MetricResult) -> None:
        named = {v: k for k, v in self.models.items()}
        for t in self.tasks:
            out.per_column |= {f"{t.target}/{named[m]}": r for m, r in task_scores(ctx, t, tuple(named), out.notes).items()}
        by = {m: [r["ratio"] for key, r in out.per_column.items() if key.endswith(f"/{m}") and "ratio" in r] for m in self.models}
        means = {m: mean(v) for m, v in by.items() if v}
        if not means:
            raise Skip("no task could be evaluated")
        score, centre = mean(x for v in by.values() for x in v), mean(means.values())
        out.scalars = {"score": score, "utility_ratio_mean": score} | {f"ratio_{m}": v for m, v in means.items()} | {"ratio_spread": math.sqrt(mean((v - centre) ** 2 for v in means.values()))}


@registry.register
class FeatureImportanceSpearman(Metric):
    spec = MetricSpec("feature_importance_spearman", "utility", "extended", scope="table")
    options = ("tasks",)
    tasks: list[M.UtilityTask] = []

    def measure(self, ctx: Context, out: MetricResult) -> None:
        real, syn = ctx.pair.where("_side = 'r'"), ctx.pair.where("_side = 's'")
        for t in self.tasks:
            cols = M.feature_columns(t, ctx.meta) if t.target in ctx.meta.columns else []
            if cols:
                k = ctx.pair.where("_side <> 'h'").groupBy("_side").agg(*[F.countDistinct(plain_label(c)).alias(f"n{i}") for i, c in enumerate(cols)]).collect()
                cols = [c for i, c in enumerate(cols) if any(r[f"n{i}"] > 1 for r in k)]
            if len(cols) < 2:
                out.notes.append(f"{t.target}: fewer than two informative features")
                continue
            labels = M.classes_of(real, t.target, out.notes) if M.task_type(t, ctx.meta) == "classification" else []
            if labels is None:
                continue
            a, b = (M.importances(d, t, ctx.meta, cols, labels, ctx.random_state) for d in (real, syn))
            rho = spearman([a[c] for c in cols], [b[c] for c in cols])
            if math.isnan(rho):
                rho = 0.0
                out.notes.append(f"{t.target}: importances are constant")
            out.per_column[t.target] = {"spearman_rho": rho, "n_features": float(len(cols))}
        if not out.per_column:
            raise Skip("no task could be evaluated")
        rho = mean(r["spearman_rho"] for r in out.per_column.values())
        out.scalars = {"score": (rho + 1) / 2, "spearman_rho": rho}


@registry.register
class DiscriminativeScore(Metric):
    spec = MetricSpec("discriminative_score", "utility", "extended", scope="table")

    def measure(self, ctx: Context, out: MetricResult) -> None:
        if min(ctx.sizes["r"], ctx.sizes["s"]) < 2:
            raise Skip("fewer than two rows on a side")
        data, _ = M.vectors(ctx.pair.where("_side <> 'h'"), ctx.meta)
        parts = M.folds(data, 10, ctx.random_state, "y")
        train = parts.where("fold < 7").withColumnRenamed("y", "_y")
        model = M.estimator("forest", "classification", 1, 2, 1.0, ctx.random_state).fit(train)
        a = M.area(model.transform(parts.where("fold >= 7")), "y")
        out.scalars = {"score": max(0.0, 1 - 2 * abs(a - 0.5)), "auc": a}
