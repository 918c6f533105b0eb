"""JSON events to typed records and back, by the pipeline's own rules.

A required field that is absent, null or of another JSON type has its kind's default; an optional one is null when absent
or null, but has the default when of another type. Whole numbers are read as floating point where that is declared;
negative or fractional numbers aren't unsigned ones. Any JSON value that isn't an object gives a record of defaults;
text that isn't JSON gives no record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamstage.types import DEFAULTS, Field, Record


def _decoded(payload: str, f: Field) -> Column:
    at = f"try_variant_get({payload}, '$.{f.name}')"
    kind = f"schema_of_variant({at})"
    as_double = f"try_variant_get({payload}, '$.{f.name}', 'double')"
    whole = f"({kind} = 'BIGINT' or {kind} rlike '^DECIMAL[(](19|[23][0-9]),0[)]$')"  # shorter decimals come from text such as 2.0
    number = f"({kind} = 'BIGINT' or {kind} = 'DOUBLE' or {kind} like 'DECIMAL%')"
    integer = f"try_variant_get({payload}, '$.{f.name}', 'decimal(38,0)')"
    wrap = lambda bits: f"pmod({integer}, {1 << bits}BD)"
    value = {
        "string": f"case when {kind} = 'STRING' then try_variant_get({payload}, '$.{f.name}', 'string') end",
        "f64": f"case when {number} then {as_double} end",
        "f32": f"case when {number} then cast({as_double} as float) end",
        "u64": f"case when {whole} and {integer} between 0 and {(1 << 64) - 1}BD then cast({integer} as decimal(20,0)) end",
        "u32": f"case when {whole} and {integer} between 0 and {(1 << 64) - 1}BD then cast({wrap(32)} as bigint) end",
        "s64": f"case when {whole} and {integer} between {-(1 << 63)}BD and {(1 << 63) - 1}BD then cast({integer} as bigint) end",
        "s32": f"case when {whole} and {integer} between {-(1 << 63)}BD and {(1 << 63) - 1}BD then cast(case when {wrap(32)} >= {1 << 31}BD then {wrap(32)} - {1 << 32}BD else {wrap(32)} end as int) end",
        "bool": f"case when {kind} = 'BOOLEAN' then try_variant_get({payload}, '$.{f.name}', 'boolean') end",
    }[f.kind]
    default = f"cast({DEFAULTS[f.kind]} as {f.spark.simpleString()})"
    if not f.optional:
        return F.expr(f"coalesce({value}, {default})").alias(f.name)
    return F.expr(f"case when {kind} is null or {kind} = 'VOID' then null else coalesce({value}, {default}) end").alias(f.name)


def decode(events: DataFrame, record: Record, payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed columns of ``record`` from JSON text; rows of which the text isn't JSON (or is empty or null) go."""
    parsed = events.withColumn("__v", F.expr(f"try_parse_json({payload})")).where("__v IS NOT NULL")
    return parsed.select(*keep, *[_decoded("__v", f) for f in record.fields])


def malformed(events: DataFrame, payload: str = "payload") -> DataFrame:
    """The rows that ``decode`` drops."""
    return events.where(F.expr(f"try_parse_json({payload})").isNull())


def encode(record: Record, name: str = "payload") -> Column:
    """JSON of the record's columns; absent values are left out, and so are numbers that JSON can't hold."""

    def value(f: Field) -> Column:
        c = F.col(f.name)
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c) if f.kind in ("f64", "f32") else c

    return F.to_json(F.struct(*[value(f).alias(f.name) for f in record.fields])).alias(name)


def wire_fields(into: Record, out: Record) -> list[Field]:
    """Fields that survive a stage whose output is written through its input type: those in both, equally optional."""
    return [f for f in into.fields if (g := out[f.name]) is not None and g.optional == f.optional]


def wire(df: DataFrame, into: Record, out: Record, keep: tuple[str, ...] = ()) -> DataFrame:
    """``df`` cut to what survives on the wire; the choice is made when the plan is made."""
    return df.select(*keep, *[f.name for f in wire_fields(into, out)])


def read_as(df: DataFrame, into: Record, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns of ``into``: those that ``df`` has, defaults (or null) for the others."""
    have = set(df.columns)
    blank = lambda f: F.lit(None).cast(f.spark) if f.optional else F.expr(f"cast({DEFAULTS[f.kind]} as {f.spark.simpleString()})")
    return df.select(*keep, *[(F.col(f.name) if f.name in have else blank(f)).alias(f.name) for f in into.fields])


def typed(df: DataFrame, record: Record, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``record`` from a source that has them already; an error if a required one is absent. Nulls in
    required columns become defaults."""
    lacking = [f.name for f in record.fields if not f.optional and f.name not in df.columns]
    if lacking:
        raise ValueError(f"the source has no {', '.join(lacking)} (it has {', '.join(df.columns)}); give `columns:` or a `payload` of JSON")
    value = lambda f: F.col(f.name).cast(f.spark) if f.optional else F.coalesce(F.col(f.name).cast(f.spark), F.expr(f"cast({DEFAULTS[f.kind]} as {f.spark.simpleString()})"))
    return read_as(df.select(*keep, *[value(f).alias(f.name) for f in record.fields if f.name in df.columns]), record, keep)


def append_hop(hops: str, stage: str, enter: Column, exit_: Column) -> Column:
    """The hop list with one more hop."""
    hop = F.struct(F.lit(stage).alias("stage"), enter.alias("enter_ts"), exit_.alias("exit_ts"))
    return F.concat(F.coalesce(F.col(hops), F.array().cast("array<struct<stage:string,enter_ts:double,exit_ts:double>>")), F.array(hop))


def hops_to_wire(hops: str) -> Column:
    """Hops as JSON arrays [stage, enter, exit]."""
    return F.expr(f"concat('[', array_join(transform({hops}, h -> concat('[', to_json(struct(h.stage as s)), ',', h.enter_ts, ',', h.exit_ts, ']')), ','), ']')")


def valid_hops(hops: str) -> Column:
    """Hops with a stage and both times, of which the exit isn't before the entry."""
    return F.expr(f"filter({hops}, h -> h.stage is not null and h.enter_ts is not null and h.exit_ts is not null and h.exit_ts >= h.enter_ts)")
