"""Record types of a pipeline: declared field types and what they are in Spark."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Spellings of the scalar types.
SPELLINGS = {
    "string": "string", "str": "string",
    "f64": "f64", "float": "f64", "double": "f64",
    "f32": "f32", "float32": "f32",
    "u64": "u64", "uint64": "u64",
    "u32": "u32", "uint32": "u32", "uint": "u32",
    "s64": "s64", "int64": "s64", "int": "s64",
    "s32": "s32", "int32": "s32",
    "bool": "bool", "boolean": "bool",
}
SPARK = {
    "string": T.StringType(), "f64": T.DoubleType(), "f32": T.FloatType(), "u64": T.DecimalType(20, 0), "u32": T.LongType(),
    "s64": T.LongType(), "s32": T.IntegerType(), "bool": T.BooleanType(),
}
DEFAULTS = {"string": "''", "f64": "0D", "f32": "0F", "u64": "0BD", "u32": "0L", "s64": "0L", "s32": "0", "bool": "false"}


class TypeError_(ValueError):
    """A declared type that can't be used."""


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    optional: bool = False

    @property
    def spark(self) -> T.DataType:
        return SPARK[self.kind]


def snake(name: str) -> str:
    return name.replace("-", "_")


def kebab(name: str) -> str:
    return name.replace("_", "-")


def field(name: str, declared: str) -> Field:
    """A field of a declared type such as ``f64`` or ``string?``."""
    text = declared.strip()
    optional = text.endswith("?")
    base = text.removesuffix("?").strip()
    if base not in SPELLINGS:
        raise TypeError_(f"field {name}: unknown type {declared!r}; only scalars are supported")
    return Field(snake(name), SPELLINGS[base], optional)


@dataclass(frozen=True)
class Record:
    name: str
    fields: tuple[Field, ...]

    @classmethod
    def of(cls, name: str, declared: dict[str, str]) -> Record:
        return cls(name, tuple(field(k, str(v)) for k, v in declared.items()))

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.spark, f.optional) for f in self.fields])

    def __getitem__(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)


# The record that stages have when no types are declared; every field may be absent.
EVENT = Record.of(
    "event",
    dict.fromkeys(["event-id", "sensor-id"], "string?") | {"value": "f64?", "unit": "string?"} | dict.fromkeys(["ts", "ts-in", "ts-fn-a", "ts-fn-b", "ts-fn-c"], "f64?")
    | {"fn": "string?", "reactor-count": "u64?", "anomaly": "bool?", "severity": "string?"} | dict.fromkeys(["latency-a-to-b-ms", "latency-b-to-c-ms", "e2e-latency-ms"], "f64?")
    | {"status": "string?", "filtered": "bool?", "reason": "string?"},
)

HOP = "struct<stage:string,enter_ts:double,exit_ts:double>"
BENCH = f"bench_ts_wall double, bench_ts double, bench_seq decimal(20,0), bench_hops array<{HOP}>"


def missing_fields(out: Record, into: Record) -> list[str]:
    """What keeps records of ``out`` from being read as ``into``: required fields that are absent, optional or of another type."""
    found = []
    for f in into.fields:
        given = out[f.name]
        if given is None:
            if not f.optional:
                found.append(f"{f.name} is required but absent")
        elif given.kind != f.kind:
            found.append(f"{f.name} is {given.kind}, not {f.kind}")
        elif given.optional and not f.optional:
            found.append(f"{f.name} may be absent but is required")
    return found
