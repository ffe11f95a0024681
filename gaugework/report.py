"""Reports: scoring of results, aggregation, and strict JSON both ways."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from importlib.metadata import PackageNotFoundError, version
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .functions.scores import clip, mean, verdict
from .registry import DIMENSIONS, MetricResult, MetricSpec
from .schema import Metadata, MetricError


def normalised_score(r: MetricResult) -> float:
    """The clipped score; without one, 1 less the clipped first scalar."""
    s = r.scalars or {}
    return clip(s["score"]) if "score" in s else 1 - clip(next(iter(s.values())))


def counted_value(r: MetricResult) -> float:
    s = r.scalars or {}
    return s["score"] if "score" in s else next(iter(s.values()))


def is_scored(r: MetricResult) -> bool:
    return bool(r.spec.scoring and r.scalars and not r.error and math.isfinite(counted_value(r)))


def reject_non_finite(r: MetricResult) -> None:
    """A value that would be aggregated must be finite; others may be NaN."""
    if r.spec.scoring and r.scalars and not r.error and not math.isfinite(counted_value(r)):
        raise MetricError(f"{r.spec.name} gave a score that is not finite")


@dataclass
class RunInfo:
    seed: int
    started_at: str = ""
    finished_at: str = ""
    versions: dict[str, str] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    metric_options: dict[str, dict[str, Any]] = field(default_factory=dict)
    conf: dict[str, str] = field(default_factory=dict)

    @classmethod
    def capture(cls, seed: int, options: dict[str, dict[str, Any]], spark: SparkSession | None = None) -> RunInfo:
        found = {}
        for name in ("pyspark", "numpy", "pyarrow", "pandas"):
            try:
                found[name] = version(name)
            except PackageNotFoundError:
                continue
        conf = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.ansi.enabled")} if spark else {}
        return cls(seed, now(), "", found, [], options, conf)


def now() -> str:
    return datetime.now(UTC).isoformat()


def strict(x: Any) -> Any:
    """NaN and infinities become null, as RFC 8259 asks."""
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if isinstance(x, dict):
        return {str(k): strict(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [strict(v) for v in x]
    return x


def loose(x: dict[str, float | None] | None) -> dict[str, float] | None:
    return None if x is None else {k: math.nan if v is None else v for k, v in x.items()}


@dataclass
class Report:
    metadata: Metadata
    results: list[MetricResult]
    run_info: RunInfo

    def by_c(self) -> dict[str, list[MetricResult]]:
        out: dict[str, list[MetricResult]] = {}
        for r in self.results:
            out.setdefault(r.spec.c, []).append(r)
        return {c: out[c] for c in DIMENSIONS if c in out}

    @property
    def aggregated(self) -> dict[str, float]:
        """Mean normalised score of each dimension."""
        got = {c: [normalised_score(r) for r in rs if is_scored(r)] for c, rs in self.by_c().items()}
        return {c: mean(v) for c, v in got.items() if v}

    @property
    def overall(self) -> float:
        a = self.aggregated
        return mean(a.values()) if a else 0.0

    def result(self, name: str) -> MetricResult:
        return next(r for r in self.results if r.spec.name == name)

    def frame(self, spark: SparkSession) -> DataFrame:
        """Long form: metric, c, key, name, value; key is empty for scalars."""
        rows = []
        for r in self.results:
            rows += [(r.spec.name, r.spec.c, "", k, float(v)) for k, v in (r.scalars or {}).items()]
            rows += [(r.spec.name, r.spec.c, key, k, float(v)) for key, vals in r.per_column.items() for k, v in vals.items() if v is not None]
        return spark.createDataFrame(rows, "metric string, c string, key string, name string, value double")

    def to_dict(self) -> dict:
        return {"metadata": self.metadata.to_dict(), "results": [asdict(r) for r in self.results], "aggregated": self.aggregated, "run_info": asdict(self.run_info)}

    def to_json(self) -> str:
        return json.dumps(strict(self.to_dict()), indent=2, allow_nan=False)

    @classmethod
    def from_dict(cls, d: dict) -> Report:
        results = []
        for r in d["results"]:
            spec = MetricSpec(**(r["spec"] | {"data_types": tuple(r["spec"]["data_types"])}))
            made = MetricResult(spec, loose(r["scalars"]), {k: loose(v) or {} for k, v in r["per_column"].items()}, r["plot_payload"], r["notes"], r["error"], r["skip_reason"])
            try:
                reject_non_finite(made)
            except MetricError as e:
                made.error = str(e)
            results.append(made)
        return cls(Metadata.from_dict(d["metadata"]), results, RunInfo(**d["run_info"]))

    @classmethod
    def from_json(cls, text: str) -> Report:
        return cls.from_dict(json.loads(text))

    def verdicts(self) -> dict[str, str]:
        return {r.spec.name: verdict(normalised_score(r)) for r in self.results if is_scored(r)}
