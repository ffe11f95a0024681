"""Column roles, metadata, and their inference and validation."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class GaugeError(Exception):
    """Any error the library raises on purpose."""


class MetadataError(GaugeError):
    pass


class MetricError(GaugeError):
    pass


class ColumnType(str, Enum):
    NUMERIC = "numeric"
    CATEGORICAL = "categorical"
    DATETIME = "datetime"
    BOOLEAN = "boolean"
    ID = "id"


#: Fixed: names that mark a column as an identifier, in any case.
ID_NAME = re.compile(r"^(id|.*_id|.*_key)$", re.IGNORECASE)
#: Fixed: the label that stands for a missing category.
MISSING = "__NA__"


@dataclass(frozen=True)
class ColumnMetadata:
    name: str
    dtype: ColumnType
    sensitive: bool = False
    quasi_identifier: bool = False
    categories: tuple[str, ...] | None = None
    value_range: tuple[float, float] | None = None


def role_of(f: T.StructField) -> ColumnType:
    if ID_NAME.match(f.name):
        return ColumnType.ID
    if isinstance(f.dataType, T.BooleanType):
        return ColumnType.BOOLEAN
    if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return ColumnType.DATETIME
    if isinstance(f.dataType, T.NumericType):
        return ColumnType.NUMERIC
    if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
        raise MetadataError(f"column {f.name!r} has type {f.dataType.simpleString()}, which no metric measures; drop it first")
    return ColumnType.CATEGORICAL


@dataclass
class Metadata:
    columns: dict[str, ColumnMetadata] = field(default_factory=dict)
    primary_key: str | None = None

    @classmethod
    def infer(cls, df: DataFrame) -> Metadata:
        return cls({f.name: ColumnMetadata(f.name, role_of(f)) for f in df.schema.fields})

    def override(self, name: str, **changes) -> Metadata:
        """A copy in which one column is declared otherwise."""
        if name not in self.columns:
            raise MetadataError(f"unknown column {name!r}")
        if "dtype" in changes:
            changes["dtype"] = ColumnType(changes["dtype"])
        return Metadata(self.columns | {name: replace(self.columns[name], **changes)}, self.primary_key)

    def validate_against(self, df: DataFrame) -> None:
        types = {f.name: f for f in df.schema.fields}
        if missing := [c for c in self.columns if c not in types]:
            raise MetadataError(f"columns are missing: {missing}")
        for name, c in self.columns.items():
            if c.dtype is ColumnType.NUMERIC and not isinstance(types[name].dataType, T.NumericType):
                raise MetadataError(f"column {name!r} is declared numeric but is {types[name].dataType.simpleString()}")
        if self.primary_key is not None and self.primary_key not in types:
            raise MetadataError(f"primary key {self.primary_key!r} is not a column")

    def names(self, *kinds: ColumnType) -> list[str]:
        return [c.name for c in self if c.dtype in kinds]

    @property
    def numeric(self) -> list[str]:
        return self.names(ColumnType.NUMERIC)

    @property
    def categorical(self) -> list[str]:
        return self.names(ColumnType.CATEGORICAL)

    @property
    def labelled(self) -> list[str]:
        """Categorical and boolean columns."""
        return self.names(ColumnType.CATEGORICAL, ColumnType.BOOLEAN)

    @property
    def quasi_identifiers(self) -> list[str]:
        return [c.name for c in self if c.quasi_identifier]

    @property
    def sensitive(self) -> list[str]:
        return [c.name for c in self if c.sensitive]

    def __iter__(self) -> Iterator[ColumnMetadata]:
        return iter(self.columns.values())

    def to_dict(self) -> dict:
        return {
            "primary_key": self.primary_key,
            "columns": {c.name: {"dtype": c.dtype.value, "sensitive": c.sensitive, "quasi_identifier": c.quasi_identifier, "categories": c.categories, "value_range": c.value_range} for c in self},
        }

    @classmethod
    def from_dict(cls, d: dict) -> Metadata:
        made = {
            n: ColumnMetadata(n, ColumnType(c["dtype"]), bool(c.get("sensitive")), bool(c.get("quasi_identifier")), tuple(c["categories"]) if c.get("categories") else None, tuple(c["value_range"]) if c.get("value_range") else None)
            for n, c in d.get("columns", {}).items()
        }
        return cls(made, d.get("primary_key"))


# ---- expressions -----------------------------------------------------------------------------


def number(name: str):
    """The column as a double; what is not a number, NaN included, is null."""
    x = F.col(f"`{name}`").try_cast("double")
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def label(name: str):
    """The column as a label; null is a label of its own."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(MISSING))


def plain_label(name: str):
    """The column as a label or null."""
    return F.col(f"`{name}`").cast("string")
