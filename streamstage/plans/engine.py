"""A pipeline file compiled to DataFrames: for a batch, or for a stream with the same stages."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamstage.functions.codec import decode, read_as, typed, wire
from streamstage.operators import signal, stages
from streamstage.spec import PipelineSpec, SpecError, Stage


@dataclass(frozen=True)
class Step:
    """A stage's plan for batches and, where it keeps state, another one for streams."""

    batch: Callable[[DataFrame], DataFrame]
    stream: Callable[[DataFrame], DataFrame] | None = None


REGISTRY: dict[str, Step] = {}


def stage(name: str, stream: Callable[[DataFrame], DataFrame] | None = None):
    """Register a function of a DataFrame as the stage ``name``; ``stream`` is its plan for streams if it keeps state."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        REGISTRY[name] = Step(f, stream)
        return f

    return add


def _stream(name: str) -> Callable[[DataFrame], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        return getattr(importlib.import_module("streamstage.streaming.stateful"), name)(df)

    return run


for _name, _step in {
    "warmup": Step(stages.identity), "normalize": Step(stages.normalize), "detect": Step(stages.detect), "finalize": Step(stages.finalize), "attest": Step(stages.attest),
    "denoise": Step(signal.denoise, _stream("denoise")), "featurize": Step(signal.featurize, _stream("featurize")),
}.items():
    REGISTRY[_name] = _step


def step_of(s: Stage) -> Step:
    """The stage's plan: ``src: module:function``, or a registered stage named as the stage or as its source file."""
    if s.binary:
        raise SpecError(f"stage {s.name}: prebuilt binaries can't run in Spark; give `src: module:function`")
    if ":" in s.src:
        module, _, name = s.src.partition(":")
        return Step(getattr(importlib.import_module(module), name))
    for name in (s.name, Path(s.src).stem):
        if name in REGISTRY:
            return REGISTRY[name]
    raise SpecError(f"stage {s.name}: no stage of that name is registered; give `src: module:function`")


def compile_pipeline(spec: PipelineSpec, events: DataFrame, mode: str = "contract", keep: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The stages of this host over typed ``events``, in order.

    ``contract`` gives each stage's declared output; ``wire`` cuts each output to the fields that its input type has
    too, as equally optional, and the next stage reads defaults for the others. ``keep`` are columns beside the record
    (order, bench fields), carried along.
    """
    if mode not in ("contract", "wire"):
        raise ValueError(f"unknown mode {mode!r}")
    df = events
    beside = tuple(c for c in keep if c in events.columns)
    for s in spec.here():
        step, into, out = step_of(s), spec.record(s.input_type), spec.record(s.output_type)
        df = (step.stream if df.isStreaming and step.stream else step.batch)(read_as(df, into, beside))
        df = wire(df, into, out, beside) if mode == "wire" else read_as(df, out, beside)
    return df


def first_input(spec: PipelineSpec, events: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ("seq",)) -> DataFrame:
    """A source's events as records of the first stage's input: decoded where there is a column ``payload`` of JSON
    text, else taken from the columns, of which the required ones must be there."""
    record = spec.record(spec.here()[0].input_type)
    beside = tuple(c for c in keep if c in events.columns)
    if payload in events.columns:
        return decode(events.withColumn(payload, F.col(payload).cast("string")), record, payload, beside)
    return typed(events, record, beside)


def run_batch(spec: PipelineSpec, payloads: DataFrame, mode: str = "contract", payload: str = "payload", keep: tuple[str, ...] = ("seq",)) -> DataFrame:
    """JSON events through the pipeline."""
    return compile_pipeline(spec, first_input(spec, payloads, payload, keep), mode, keep)


def with_bench(df: DataFrame, stage_name: str, enter: str, exit_: str) -> DataFrame:
    """A logged stage's hop appended to ``bench_hops``."""
    from streamstage.functions.codec import append_hop

    return df.withColumn("bench_hops", append_hop("bench_hops", stage_name, F.col(enter), F.col(exit_)))
