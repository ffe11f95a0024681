"""Metric specifications, results, the metric protocol and its registry."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.storage import saved
from .plans import kernels as K
from .plans import neighbors as N
from .schema import Metadata, MetricError

DIMENSIONS = ("congruence", "coverage", "compliance", "fairness", "preservation", "utility")
TIERS = ("core", "extended", "custom")


@dataclass(frozen=True)
class MetricSpec:
    name: str
    c: str
    tier: str = "core"
    data_types: tuple[str, ...] = ("static",)
    requires_real: bool = True
    scope: str = "column"
    scoring: bool = True


@dataclass
class MetricResult:
    spec: MetricSpec
    scalars: dict[str, float] | None = None
    per_column: dict[str, dict[str, float]] = field(default_factory=dict)
    plot_payload: dict[str, Any] | None = None
    notes: list[str] = field(default_factory=list)
    error: str | None = None
    skip_reason: str | None = None


class Skip(Exception):
    """Raised by a metric that cannot run on its input; the text becomes the skip reason."""


class Context:
    """What the metrics of one run share: the tagged pair, written once, and its encodings."""

    def __init__(self, real: DataFrame | None, synthetic: DataFrame, meta: Metadata, *, holdout: DataFrame | None = None, distance: str = "euclidean", random_state: int = 42, cap: int | None = None):
        if distance not in ("euclidean", "gower"):
            raise MetricError(f"unknown distance {distance!r}")
        self.real, self.synthetic, self.holdout, self.meta = real, synthetic, holdout, meta
        self.distance, self.random_state, self.cap, self.notes = distance, random_state, cap, []
        self._near: dict[tuple[tuple[str, ...], str], tuple[int, DataFrame]] = {}

    @cached_property
    def pair(self) -> DataFrame:
        names = list(self.meta.columns)
        sides = [d.select(*[f"`{c}`" for c in names]) if d is not None else None for d in (self.real, self.synthetic, self.holdout)]
        return saved(K.tag(*sides).withColumn("_row", F.monotonically_increasing_id()), "pair")

    @cached_property
    def sizes(self) -> dict[str, int]:
        return {"r": 0, "s": 0, "h": 0} | {r["_side"]: r["count"] for r in self.pair.groupBy("_side").count().collect()}

    @cached_property
    def moments(self) -> DataFrame:
        """Moments of every numeric column on both sides, a row a column: one aggregation for all metrics."""
        return saved(K.moments(self.pair, self.meta.numeric), "moments")

    @cached_property
    def sweep(self) -> DataFrame:
        """Distances of the two distributions of every numeric column, from one sweep over all values."""
        return saved(K.ks_w1(K.numeric_long(self.pair.where("_side <> 'h'"), self.meta.numeric), cuts=K.cuts_for(self.sizes["r"] + self.sizes["s"])), "sweep")

    @cached_property
    def labels(self) -> DataFrame:
        """Frequencies of the labels of every categorical and boolean column, null being a label."""
        return saved(K.frequencies(K.label_long(self.pair, self.meta.labelled)), "labels")

    def space(self, distance: str | None = None, numeric: list[str] | None = None, categorical: list[str] | None = None, capped: bool = True) -> tuple[DataFrame, N.Space]:
        """Encoded rows of all sides. Only gower frames can be capped, if ``cap`` is given; the metric then says so."""
        distance = distance or self.distance
        make = N.encode if distance == "euclidean" else N.gower
        rows, space = make(self.pair, self.meta, "_row", numeric, categorical)
        if not space.width:
            raise Skip("no numeric or categorical column to compare")
        if distance == "gower" and capped and self.cap and max(self.sizes.values()) > self.cap:
            parts = [N.cap(rows.where(F.col("_side") == s), self.cap, self.random_state) for s in "rsh" if self.sizes[s]]
            rows = parts[0]
            for p in parts[1:]:
                rows = rows.unionByName(p)
        return saved(rows, "encoded"), space

    @cached_property
    def shared(self) -> tuple[DataFrame, N.Space]:
        return self.space()

    def capped(self) -> list[str]:
        return ["capped for gower"] if self.distance == "gower" and self.cap and max(self.sizes.values()) > self.cap else []

    def near(self, a: str, b: str, k: int = 1, shared: tuple[DataFrame, N.Space] | None = None) -> DataFrame:
        """The k nearest rows of side b for each row of side a.

        In the shared space the other sides are searched for in the real one together, and two neighbours at least, once a run.
        """
        rows, space = shared or self.shared
        mine, target = F.col("_side") == a, rows.where(F.col("_side") == b)
        if shared is not None:
            return saved(N.knn(rows.where(mine), target, space, k, exclude_self=a == b), "near")
        asked, most = ("s", "h") if b == "r" != a else (a,), max(k, 2)
        if self._near.get((asked, b), (0,))[0] < most:
            found = N.knn(rows.where(F.col("_side").isin(*asked)), target, space, most, exclude_self=a == b, keep=("_side",))
            self._near[asked, b] = most, saved(found, "near")
        return self._near[asked, b][1].where(mine).select("_id", F.slice("d", 1, k).alias("d"), "nn")


class Metric:
    """Base of all metrics. Subclasses set ``spec``, declare options as class attributes and define ``measure``."""

    spec: MetricSpec
    options: tuple[str, ...] = ()

    def __init__(self, context: Context | None = None, **options: Any):
        if bad := [k for k in options if k not in self.options]:
            raise MetricError(f"{self.spec.name} has no option {bad[0]!r}")
        self.context = context
        for k, v in options.items():
            setattr(self, k, v)

    def compute(self, real: DataFrame | None, synthetic: DataFrame, meta: Metadata) -> MetricResult:
        ctx = self.context or Context(real, synthetic, meta)
        if any(given is not None and given is not own for given, own in ((real, ctx.real), (synthetic, ctx.synthetic), (meta, ctx.meta))):
            raise MetricError(f"{self.spec.name} was given a context of other tables")
        result = MetricResult(self.spec)
        try:
            self.measure(ctx, result)
        except Skip as e:
            result.scalars, result.skip_reason = None, str(e)
        return result

    def measure(self, ctx: Context, out: MetricResult) -> None:
        raise NotImplementedError


class MetricRegistry:
    def __init__(self):
        self._metrics: dict[str, type[Metric]] = {}

    def register(self, cls: type[Metric]) -> type[Metric]:
        if cls.spec.name in self._metrics and self._metrics[cls.spec.name] is not cls:
            raise MetricError(f"a metric named {cls.spec.name!r} is registered already")
        if cls.spec.c not in DIMENSIONS:
            raise MetricError(f"unknown dimension {cls.spec.c!r}")
        self._metrics[cls.spec.name] = cls
        return cls

    def metrics(self) -> list[type[Metric]]:
        return list(self._metrics.values())

    def get(self, name: str) -> type[Metric]:
        if name not in self._metrics:
            raise MetricError(f"unknown metric {name!r}")
        return self._metrics[name]

    def select(self, tiers: tuple[str, ...] = ("core",), data_type: str = "static", cs: tuple[str, ...] | None = None) -> list[type[Metric]]:
        if data_type in ("longitudinal", "relational"):
            raise NotImplementedError(f"{data_type} data is not supported")
        if bad := [t for t in tiers if t not in TIERS]:
            raise MetricError(f"unknown tier {bad[0]!r}")
        if bad := [c for c in cs or () if c not in DIMENSIONS]:
            raise MetricError(f"unknown dimension {bad[0]!r}")
        return [m for m in self._metrics.values() if m.spec.tier in tiers and data_type in m.spec.data_types and (cs is None or m.spec.c in cs)]

    def subset(self, names: list[str]) -> MetricRegistry:
        out = MetricRegistry()
        for n in names:
            out.register(self.get(n))
        return out


registry = MetricRegistry()
