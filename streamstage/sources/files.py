"""Readers of logs, summaries and exports, and of what file names tell."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamstage.sources.generator import sensor_readings, sensor_stream

#: The places at which run summaries have had their event rows.
EVENT_ROWS = ("events.rows", "per_event_log", "events")
SUMMARY_KEYS = ("counters", "throughput", "latency_ms")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; blank and broken lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A structured log: ts, level, component, msg and a map of all further fields, which are strings."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("__m", F.from_json("value", "map<string,string>")).where("__m IS NOT NULL AND size(__m) > 0")
    named = ["ts", "level", "component", "msg"]
    return lines.select(F.expr("try_cast(__m['ts'] as double)").alias("ts"), *[F.col("__m")[n].alias(n) for n in named[1:]], F.map_filter("__m", lambda k, v: ~k.isin(named)).alias("fields"))


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """Run summaries, one a file; an error if a block is missing. ``rows`` has the event rows, wherever they stand."""
    df = spark.read.option("multiLine", True).json(path)
    lacking = [k for k in SUMMARY_KEYS if k not in df.columns]
    if lacking:
        raise ValueError(f"{path}: no {', '.join(lacking)} in the summary")
    found = []
    for place in EVENT_ROWS:
        head, _, rest = place.partition(".")
        if head in df.columns and (not rest or df.schema[head].dataType.typeName() == "struct" and rest in df.schema[head].dataType.names) and (rest or df.schema[head].dataType.typeName() == "array"):
            found.append(F.to_json(F.col(place)))
    return df.withColumn("rows", F.coalesce(*found) if found else F.lit(None).cast("string"))


def read_csv(spark: SparkSession, path: str, schema: str, relabel: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """CSV with a header; ``relabel`` has new values by column."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    for column, names in (relabel or {}).items():
        df = df.replace(names, subset=[column])
    return df


def file_path() -> Column:
    return F.col("_metadata.file_path")


def filename_columns(path: Column) -> dict[str, Column]:
    """mode, iteration, rate (60k is 60000) and credit window as far as the path names them."""
    name = F.element_at(F.split(path, "/"), -1)
    found = lambda pattern: F.when(F.regexp_extract(path, pattern, 1) != "", F.regexp_extract(path, pattern, 1))
    rate = F.when(F.regexp_extract(name, "([0-9]+)(k?)(?:eps|evs|_rate)", 1) != "", F.regexp_extract(name, "([0-9]+)(k?)(?:eps|evs|_rate)", 1).cast("long") * F.when(F.regexp_extract(name, "([0-9]+)(k?)(?:eps|evs|_rate)", 2) == "k", 1000).otherwise(1))
    return {"mode": F.upper(F.regexp_extract(name, "(?i)(aot|jit)", 1)), "iteration": found("(?:iter|run)[_-]?([0-9]+)").cast("long"), "rate": rate, "window": found("cw[_-]?([0-9]+)").cast("long")}


def resolved(*choices: Column) -> Column:
    """The first choice that is known; an error for a row where none is."""
    return F.coalesce(*choices, F.raise_error(F.lit("no source tells this value")))


def latest_files(spark: SparkSession, path: str) -> DataFrame:
    """(folder, file): the file last changed in each folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime")
    return files.groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("file"))


def _sensors(spark: SparkSession, params: dict[str, Any]) -> DataFrame:
    rate, seconds = int(params.get("rate", 500)), int(params.get("duration", 2))
    return sensor_readings(spark, int(params.get("count", rate * seconds)), int(params.get("sensors", 10)), int(params.get("seed", 1)))


def _stream(spark: SparkSession, kind: str, given: dict[str, Any]) -> DataFrame:
    reader = spark.readStream.format(kind)
    for k, v in given.items():
        reader = reader.option(k, v)
    return reader.load()


#: Sources that a pipeline file can name: kind -> DataFrame by the parameters. Text and messages come as ``payload``.
SOURCES: dict[str, Callable[[SparkSession, dict[str, Any]], DataFrame]] = {
    "loadgen": _sensors,
    "sensors": _sensors,
    "parquet": lambda spark, p: spark.read.parquet(p["path"]),
    "json": lambda spark, p: spark.read.schema(p["schema"]).json(p["path"]),
    "csv": lambda spark, p: read_csv(spark, p["path"], p["schema"]),
    "text": lambda spark, p: spark.read.text(p["path"]).select(F.col("value").alias("payload")),
    "text-stream": lambda spark, p: _stream(spark, "text", {"path": p["path"]}).select(F.col("value").alias("payload")),
    "rate": lambda spark, p: _stream(spark, "rate", {"rowsPerSecond": p.get("rate", 1)}).select("timestamp", F.col("value").alias("seq")),
    "rate-micro-batch": lambda spark, p: _stream(spark, "rate-micro-batch", {"rowsPerBatch": p.get("rate", 1)}).select("timestamp", F.col("value").alias("seq")),
    "sensor-stream": lambda spark, p: sensor_stream(spark, p),
    "socket": lambda spark, p: _stream(spark, "socket", {"host": p["host"], "port": p["port"]}).select(F.col("value").alias("payload")),
    "kafka": lambda spark, p: _stream(spark, "kafka", {"kafka.bootstrap.servers": p["servers"], "subscribe": p["topic"], "startingOffsets": p.get("from", "earliest")}).selectExpr("cast(value as string) as payload"),
}


def open_source(spark: SparkSession, kind: str, params: dict[str, Any]) -> DataFrame:
    """The source's events, with further ``columns`` (name -> SQL) that the parameters ask for."""
    if kind not in SOURCES:
        raise ValueError(f"unknown source kind {kind!r}; known: {', '.join(sorted(SOURCES))}")
    df = SOURCES[kind](spark, params)
    return df.selectExpr("*", *[f"{sql} AS `{name}`" for name, sql in (params.get("columns") or {}).items()])


def source_flags(params: dict[str, Any]) -> list[str]:
    """Parameters as command-line flags of a generator."""
    return [x for k, v in params.items() for x in (f"--{k.replace('_', '-')}", str(v).lower() if isinstance(v, bool) else str(v))]
