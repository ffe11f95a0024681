"""A Spark-first engine that scores synthetic tables against the real ones they imitate."""

from .leaderboard import BenchmarkResult, benchmark
from .operators.rows import FairnessSpec, SubgroupSpec
from .plans.models import UtilityTask
from .registry import Metric, MetricRegistry, MetricResult, MetricSpec, registry
from .report import Report
from .runner import PRESETS, Preset, evaluate, evaluate_with
from .schema import ColumnMetadata, ColumnType, GaugeError, Metadata, MetadataError, MetricError

__all__ = ["PRESETS", "BenchmarkResult", "ColumnMetadata", "ColumnType", "FairnessSpec", "GaugeError", "Metadata", "MetadataError", "Metric", "MetricError", "MetricRegistry", "MetricResult", "MetricSpec", "Preset", "Report", "SubgroupSpec", "UtilityTask", "benchmark", "evaluate", "evaluate_with", "registry"]
