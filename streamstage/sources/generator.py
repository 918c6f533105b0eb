"""Synthetic sensors as a Spark data source, for batches and streams."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# Kinds of sensors (unit, mean, deviation, drift a reading, size of anomalies), places, chance of an anomaly.
SENSORS = [
    ("temperature", "°C", 22.0, 0.5, 0.002, 15.0),
    ("vibration", "mm/s", 1.2, 0.3, 0.001, 12.0),
    ("pressure", "kPa", 101.3, 0.2, 0.001, 8.0),
    ("humidity", "%", 45.0, 2.0, 0.005, 25.0),
    ("current", "A", 3.5, 0.4, 0.003, 6.0),
]
PLACES = ["zone-A", "zone-B", "zone-C", "zone-D"]
ANOMALY = 0.002
SCHEMA = "bench_ts double, bench_ts_wall double, bench_seq bigint, sensor_id string, sensor_type string, location string, unit string, value double, is_anomaly boolean"


#: Readings of a sensor that are made together.
TOGETHER = 1 << 16


class Sensor:
    """A seeded random walk with drift and rare anomalies; equal seeds and indexes give equal readings.

    Each reading takes the same number of draws and the drift is a wave in closed form, so that readings are made many at
    once, and from any place on if the value before it is known.
    """

    def __init__(self, index: int, seed: int):
        self.index, self.seed, (self.kind, self.unit, self.mean, self.std, self.drift, self.jump) = index, seed, SENSORS[index % len(SENSORS)]
        first = np.random.default_rng([seed, index, 0]).random(2)
        self.value, self.at = self.mean + first[0] * self.std, 0
        self.direction = 1.0 if first[1] < 0.5 else -1.0

    def _drift(self, i: np.ndarray) -> np.ndarray:
        """The drift at readings ``i`` (from 1): up to three deviations, down to minus as many, and so on."""
        top = int(3 * self.std / self.drift) + 1
        j = i % (4 * top)
        return self.direction * self.drift * np.where(j <= top, j, np.where(j <= 3 * top, 2 * top - j, j - 4 * top))

    def readings(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        """The next ``count`` values, rounded to four places, and which of them are anomalies."""
        bits = np.random.PCG64([self.seed, self.index, 1]).advance(4 * self.at)
        noise, chance, sign, size = np.random.Generator(bits).random((count, 4)).T
        odd = chance < ANOMALY
        steps = self._drift(np.arange(self.at + 1, self.at + count + 1)) + noise * (self.std * 0.3) + odd * np.where(sign < 0.5, 1.0, -1.0) * self.jump * (0.8 + 0.4 * size)
        steps[:1] += self.value
        values = np.cumsum(steps)
        if count:
            self.value, self.at = float(values[-1]), self.at + count
        return np.floor(np.abs(values) * 1e4 + 0.5) / 1e4 * np.sign(values), odd


class _Part(InputPartition):
    """Every ``step``-th sensor from ``first`` on; of their readings those numbered from ``low`` up to ``high``."""

    def __init__(self, first: int, step: int, low: int, high: int):
        super().__init__(first)
        self.first, self.step, self.low, self.high = first, step, low, high


#: Sensors as they stand after what a worker read last, so that the next batch of a stream goes on from there.
_known: dict[tuple[int, int], Sensor] = {}


def _sensor_at(index: int, seed: int, place: int) -> Sensor:
    """A sensor that stands at reading ``place`` (from 0); if the worker doesn't know it, from the first reading on."""
    sensor = _known.get((index, seed))
    if sensor is None or sensor.at > place:
        sensor = Sensor(index, seed)
    while sensor.at < place:
        sensor.readings(min(place - sensor.at, TOGETHER))
    return sensor


class _Settings:
    def __init__(self, options):
        self.count, self.sensors, self.seed, self.rate = int(options.get("count", 1000)), int(options.get("sensors", 10)), int(options.get("seed", 1)), float(options.get("rate", 500))
        self.parts = max(1, min(int(options.get("partitions", 8)), self.sensors))

    def dealt(self, low: int, high: int) -> list[_Part]:
        return [_Part(i, self.parts, low, high) for i in range(self.parts)]

    def rows(self, part: _Part):
        for s in range(part.first, self.sensors, part.step):
            places = range(-(-(part.low - s) // self.sensors) if part.low > s else 0, max(-(-(part.high - s) // self.sensors), 0))
            if not places:
                continue
            sensor = _sensor_at(s, self.seed, places[0])
            for begin in range(places[0], places[-1] + 1, TOGETHER):
                values, odd = sensor.readings(min(TOGETHER, places[-1] + 1 - begin))
                for k, (value, is_odd) in enumerate(zip(values.tolist(), odd.tolist(), strict=True), begin):
                    seq = s + k * self.sensors
                    at = seq / self.rate
                    yield (at, at, seq, f"sensor-{s:04d}", sensor.kind, PLACES[s % len(PLACES)], sensor.unit, value, is_odd)
            if len(_known) >= 100_000:
                _known.clear()
            _known[s, self.seed] = sensor


class _Reader(DataSourceReader):
    """A partition makes every ``parts``-th sensor's readings, from the first on."""

    def __init__(self, options):
        self.settings = _Settings(options)

    def partitions(self):
        return self.settings.dealt(0, self.settings.count)

    def read(self, part):
        return self.settings.rows(part)


class _StreamReader(DataSourceStreamReader):
    """``rowsPerBatch`` events a batch until ``count`` is reached, made by the executors. Any range of offsets gives the
    same rows again."""

    def __init__(self, options):
        self.settings, self.rows, self.at = _Settings(options), int(options.get("rowsPerBatch", 1000)), 0

    def initialOffset(self):
        return {"seq": 0}

    def latestOffset(self):
        self.at = min(self.at + self.rows, self.settings.count)
        return {"seq": self.at}

    def partitions(self, start, end):
        self.at = max(self.at, end["seq"])
        return self.settings.dealt(start["seq"], end["seq"]) if end["seq"] > start["seq"] else self.settings.dealt(0, 0)

    def read(self, part):
        return self.settings.rows(part)

    def commit(self, end):
        self.at = max(self.at, end["seq"])


class SensorSource(DataSource):
    """``spark.read.format("sensors")``: options count, sensors, seed, rate, partitions, rowsPerBatch."""

    @classmethod
    def name(cls):
        return "sensors"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)


def sensor_readings(spark, count: int, sensors: int, seed: int = 1, **options):
    """A batch of readings, ``count`` in all, dealt over the sensors in turn."""
    spark.dataSource.register(SensorSource)
    reader = spark.read.format("sensors").option("count", count).option("sensors", sensors).option("seed", seed)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def sensor_stream(spark, params: dict):
    """A stream of readings; parameters as those of the data source."""
    spark.dataSource.register(SensorSource)
    reader = spark.readStream.format("sensors")
    for k in ("count", "sensors", "seed", "rate", "partitions", "rowsPerBatch"):
        if k in params:
            reader = reader.option(k, params[k])
    return reader.load()


def end_mark(sent: int, expected: int, done_s: float, marker: str = "eos") -> str:
    """The event that ends a bounded stream."""
    return json.dumps({marker: True, "loadgen_sent": sent, "expected_count": expected, "loadgen_done_ts": done_s})
