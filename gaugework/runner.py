"""evaluate(): from tables to a report."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .operators import columns, rows  # noqa: F401  (registers the built-in metrics)
from .operators.rows import FairnessSpec, SubgroupSpec
from .plans.models import UtilityTask
from .registry import Context, MetricRegistry, MetricResult, registry
from .report import Report, RunInfo, now, reject_non_finite
from .schema import GaugeError, Metadata, MetadataError, MetricError
from .sources.tables import as_frame

SUBGROUP = ("subgroup_fidelity", "minority_utility_gap", "minority_privacy_risk")


@dataclass(frozen=True)
class Preset:
    tiers: tuple[str, ...] = ("core",)
    cs: tuple[str, ...] | None = None
    run_utility: bool = False
    run_fairness: bool = False
    distance: str = "euclidean"
    metric_options: dict[str, dict[str, Any]] = field(default_factory=dict)


PRESETS = {
    "fast": Preset(),
    "full": Preset(("core", "extended"), run_utility=True, run_fairness=True),
    "privacy": Preset(("core", "extended"), cs=("compliance",)),
}


def check_columns(real: DataFrame, other: DataFrame, what: str) -> None:
    a, b = set(real.columns), set(other.columns)
    if a != b:
        raise MetadataError(f"{what} has other columns: extra {sorted(b - a)}, missing {sorted(a - b)}")


def check_options(options: dict[str, dict[str, Any]], known: MetricRegistry) -> None:
    for name, given in options.items():
        cls = known.get(name)
        for k, v in given.items():
            if k not in cls.options or k in ("tasks", "specs", "subgroup_specs", "ledger"):
                raise MetricError(f"{name} has no option {k!r}")
            try:
                json.dumps(v, allow_nan=False)
            except (TypeError, ValueError) as e:
                raise MetricError(f"{name}.{k}: only JSON values are allowed") from e


def evaluate_with(known: MetricRegistry, real: DataFrame | None, synthetic: DataFrame, metadata: Metadata | None = None, *, preset: str | Preset | None = None, tiers: tuple[str, ...] | None = None, cs: tuple[str, ...] | None = None, holdout: DataFrame | None = None, distance: str | None = None, random_state: int = 42, run_utility: bool | None = None, run_fairness: bool | None = None, tasks: list[UtilityTask] | None = None, fairness_specs: list[FairnessSpec] | None = None, subgroup_specs: list[SubgroupSpec] | None = None, metric_options: dict[str, dict[str, Any]] | None = None, dp_ledger: dict[str, float] | None = None, data_type: str = "static") -> Report:
    """Run the metrics of a registry. Explicit arguments win over the preset, the preset over the defaults.

    Tables may be pandas ones; they become Spark's.
    """
    if isinstance(preset, str) and preset not in PRESETS:
        raise GaugeError(f"unknown preset {preset!r}")
    p = PRESETS[preset] if isinstance(preset, str) else preset or Preset()
    options = {n: dict(o) for n, o in p.metric_options.items()}
    for n, o in (metric_options or {}).items():
        options.setdefault(n, {}).update(o)
    check_options(options, known)
    spark = SparkSession.builder.getOrCreate()
    real, synthetic, holdout = (t if t is None else as_frame(spark, t) for t in (real, synthetic, holdout))
    for table, what in ((synthetic, "the synthetic table"), (holdout, "the holdout")):
        if table is not None and real is not None:
            check_columns(real, table, what)
    for table, what in ((real, "the real table"), (synthetic, "the synthetic table"), (holdout, "the holdout")):
        if table is not None and table.isEmpty():
            raise GaugeError(f"{what} is empty")
    meta = metadata or Metadata.infer(real if real is not None else synthetic)
    for table, what in ((synthetic, "synthetic"), (real, "real"), (holdout, "holdout")):
        if table is not None:
            try:
                meta.validate_against(table)
            except MetadataError as e:
                raise MetadataError(f"{what}: {e}") from e
    info = RunInfo.capture(random_state, options, synthetic.sparkSession)
    utility = p.run_utility if run_utility is None else run_utility
    fairness = p.run_fairness if run_fairness is None else run_fairness
    chosen = [
        m
        for m in known.select(tiers or p.tiers, data_type, cs or p.cs)
        if not (real is None and m.spec.requires_real) and (utility or m.spec.c != "utility") and (fairness or m.spec.c != "fairness") and (subgroup_specs or m.spec.name not in SUBGROUP)
    ]
    if not chosen:
        raise GaugeError("no metric is left to run")
    ctx = Context(real, synthetic, meta, holdout=holdout, distance=distance or p.distance, random_state=random_state)
    injected = {"tasks": tasks, "specs": fairness_specs, "subgroup_specs": subgroup_specs, "ledger": dp_ledger}
    results = []
    for cls in chosen:
        given = {k: v for k, v in injected.items() if k in cls.options and v is not None} | options.get(cls.spec.name, {})
        try:
            r = cls(ctx, **given).compute(real, synthetic, meta)
            reject_non_finite(r)
        except Exception as e:  # one metric's failure is its own
            r = MetricResult(cls.spec, error=f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
        results.append(r)
    info.finished_at = now()
    return Report(meta, results, info)


def evaluate(real: DataFrame | None, synthetic: DataFrame, metadata: Metadata | None = None, **options) -> Report:
    """Score a synthetic table against the real one it imitates; see evaluate_with for the options."""
    return evaluate_with(registry, real, synthetic, metadata, **options)
