"""Command line: validate, build (show the plan), run, clean and bootstrap a pipeline file."""

from __future__ import annotations

import argparse
import shutil
import sys

from streamstage.spec import PipelineSpec, SpecError, load


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("streamstage").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _checked(path: str) -> PipelineSpec:
    from streamstage.plans.engine import step_of

    spec = load(path)
    for s in spec.here():
        step_of(s)
    return spec


def _events(spark, spec: PipelineSpec):
    """The source's events as records of the first stage's input."""
    from pyspark.sql import functions as F

    from streamstage.plans.engine import first_input
    from streamstage.sources.files import open_source

    if spec.source is None:
        raise SpecError("the file has no `source:` to run from")
    df = open_source(spark, spec.source.kind, spec.source.params)
    if "bench_seq" in df.columns and "seq" not in df.columns:
        df = df.withColumn("seq", F.col("bench_seq"))
    return first_input(spec, df)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="streamstage", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("validate", "build", "run", "clean", "bootstrap"):
        one = commands.add_parser(name)
        one.add_argument("--config", default="pipeline.yaml")
        one.add_argument("--log-dir", default="logs")
        one.add_argument("--mode", choices=["contract", "wire"], default="contract")
        one.add_argument("--seconds", type=int, default=None, help="stop a stream after so long; without, it runs until what it reads ends")
    told = parser.parse_args(args)
    try:
        if told.command == "clean":
            shutil.rmtree(told.log_dir, ignore_errors=True)
            return 0
        if told.command == "bootstrap":
            _session().range(1).count()
            return 0
        spec = _checked(told.config)
        for w in spec.warnings:
            print(f"warning: {w}", file=sys.stderr)
        if told.command == "validate":
            print(f"{told.config}: {' -> '.join(s.name for s in spec.ordered())}")
            return 0
        from streamstage.plans.engine import compile_pipeline

        events = _events(_session(), spec)
        if told.command == "build":
            compile_pipeline(spec, events, told.mode).explain("formatted")
        elif events.isStreaming:
            from streamstage.streaming.runner import run_stream

            once = spec.source.kind not in ("rate", "socket")  # these have no end that could be reached
            query = run_stream(spec, events, f"{told.log_dir}/events", f"{told.log_dir}/checkpoint", told.mode, once=once)
            if not query.awaitTermination(told.seconds) and told.seconds is not None:
                query.stop()
        else:
            compile_pipeline(spec, events, told.mode).write.mode("overwrite").parquet(f"{told.log_dir}/events")
        return 0
    except (SpecError, ValueError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
