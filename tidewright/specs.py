"""Table specifications: plain metadata that drives the Spark jobs."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

TEXT_TYPES = ("VARCHAR", "TEXT", "CHAR", "STRING")


@dataclass(frozen=True)
class ColumnSpec:
    """One column. ``nullable`` is a bool, or a bool per context (for instance per region)."""

    name: str
    type: str = "VARCHAR"
    length: int | None = None
    precision: int = 10
    scale: int = 2
    dimension: int | None = None
    bits: int = 32
    format: str | None = None
    nullable: bool | dict[str, bool] = True
    aliases: tuple[str, ...] = ()
    canonical: str | None = None
    domain: str | None = None
    description: str | None = None
    expression: str | None = None
    default: Any = None
    null_output: str | None = None

    @property
    def kind(self) -> str:
        return self.type.upper()

    @property
    def spark_type(self) -> T.DataType:
        kind = self.kind
        if kind in TEXT_TYPES:
            return T.StringType()
        if kind == "INTEGER":
            return T.LongType() if self.bits == 64 else T.IntegerType()
        if kind == "BIGINT":
            return T.LongType()
        if kind == "SMALLINT":
            return T.ShortType()
        if kind == "TINYINT":
            return T.ByteType()
        if kind == "DECIMAL":
            return T.DecimalType(self.precision, self.scale)
        if kind in ("FLOAT", "DOUBLE"):
            return T.DoubleType()
        if kind == "BOOLEAN":
            return T.BooleanType()
        if kind == "DATE":
            return T.DateType()
        if kind in ("DATETIME", "TIMESTAMP"):
            return T.TimestampNTZType()
        if kind == "EMBEDDING":
            return T.ArrayType(T.FloatType())
        raise ValueError(f"unknown column type {self.type!r} for {self.name!r}")

    @property
    def required(self) -> bool:
        """NOT NULL iff some context forbids NULL."""
        if isinstance(self.nullable, dict):
            return not all(self.nullable.values())
        return not self.nullable

    @property
    def required_contexts(self) -> list[str]:
        if isinstance(self.nullable, dict):
            return [context for context, allowed in self.nullable.items() if not allowed]
        return []


@dataclass(frozen=True)
class TableDef:
    name: str
    columns: tuple[ColumnSpec, ...]
    primary_key: tuple[str, ...] = ()
    mode: str = "snapshot"  # or "incremental"
    order_by: tuple[str, ...] = ("_load_ts",)
    context_column: str | None = None
    checks: tuple[Any, ...] = ()

    def column(self, name: str) -> ColumnSpec:
        for column in self.columns:
            if column.name == name:
                return column
        raise KeyError(f"{self.name} has no column {name!r}")

    @property
    def schema(self) -> T.StructType:
        return T.StructType(
            [T.StructField(c.name, c.spark_type, not c.required) for c in self.columns]
        )


def spec_of_schema(name: str, schema: T.StructType, **more: Any) -> TableDef:
    """Reflect a specification from a Spark schema; 64-bit integers stay 64-bit."""
    columns = []
    for f in schema.fields:
        facts: dict[str, Any] = {"name": f.name, "nullable": f.nullable}
        dt = f.dataType
        if isinstance(dt, T.DecimalType):
            facts |= {"type": "DECIMAL", "precision": dt.precision, "scale": dt.scale}
        elif isinstance(dt, T.LongType):
            facts |= {"type": "INTEGER", "bits": 64}
        elif isinstance(dt, (T.IntegerType, T.ShortType, T.ByteType)):
            facts["type"] = "INTEGER"
        elif isinstance(dt, (T.FloatType, T.DoubleType)):
            facts["type"] = "FLOAT"
        elif isinstance(dt, T.BooleanType):
            facts["type"] = "BOOLEAN"
        elif isinstance(dt, T.DateType):
            facts["type"] = "DATE"
        elif isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
            facts["type"] = "TIMESTAMP"
        elif isinstance(dt, T.ArrayType) and isinstance(dt.elementType, (T.FloatType, T.DoubleType)):
            facts["type"] = "EMBEDDING"
        else:
            facts["type"] = "VARCHAR"
        columns.append(ColumnSpec(**facts))
    return TableDef(name=name, columns=tuple(columns), **more)


@dataclass(frozen=True)
class Check:
    """One data-quality expectation: a type, its parameters and how grave a failure is."""

    type: str
    column: str | None = None
    params: dict[str, Any] = field(default_factory=dict)
    severity: str = "warning"
    blocking: bool = False
    stage: str | None = None
    where: str | None = None
    mostly: float = 1.0
    id: str | None = None
    position: int = 0  # place in the suite that runs it
    tags: tuple[str, ...] = ()
    description: str | None = None

    @property
    def check_id(self) -> str:
        return self.id or (f"{self.type}:{self.column}" if self.column else self.type)
