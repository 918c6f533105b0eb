"""Load profiles as column expressions of the elapsed seconds, and token-bucket emission."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamstage.operators.keyed import recurrence


@dataclass(frozen=True)
class Profile:
    kind: str = "steady"
    rate: int = 500
    ramp_start: int = 0
    ramp_time: int = 30
    burst_base_rate: int = 100
    burst_interval: int = 10
    burst_duration: int = 2
    wave_min: int = 200
    wave_period: int = 60

    def target(self, t: Column) -> Column:
        """Events a second at ``t``, a whole number."""
        t = t.cast("double")
        if self.kind == "ramp":
            climb = F.lit(float(self.ramp_start)) + F.lit(float(self.rate - self.ramp_start)) * t / F.lit(float(self.ramp_time))
            return F.when(t >= self.ramp_time, F.lit(self.rate).cast("long")).otherwise(F.floor(climb))
        if self.kind == "burst":
            return F.when(t % F.lit(float(self.burst_interval)) < self.burst_duration, self.rate).otherwise(self.burst_base_rate).cast("long")
        if self.kind == "wave":
            share = (F.sin(F.lit(2.0) * F.pi() * t / F.lit(float(self.wave_period))) + 1.0) / 2.0
            return F.floor(F.lit(float(self.wave_min)) + F.lit(float(self.rate - self.wave_min)) * share)
        if self.kind in ("steady", "tp"):
            return F.lit(self.rate).cast("long")
        raise ValueError(f"unknown profile {self.kind!r}")


def profile_rates(spark, profile: Profile, seconds: int) -> DataFrame:
    return spark.range(seconds).select(F.col("id").alias("t"), profile.target(F.col("id")).alias("rate"))


def token_bucket(ticks: DataFrame, order: str = "tick", key: str = "run") -> DataFrame:
    """(key, tick, emitted, dropped): each tick adds target * dt tokens, target at most (and at least 1); whole tokens
    leave. ``ticks`` may have ``room``: how many events can be sent at the tick; those over it are dropped."""

    def fold():
        tokens = 0.0

        def step(tick, target, dt, room):
            nonlocal tokens
            target = max(target, 1.0)
            tokens = min(tokens + target * dt, target)
            out = int(tokens)
            tokens -= out
            sent = out if room is None else min(out, room)
            return [(tick, sent, out - sent)]

        return step, lambda: ()

    room = F.col("room").cast("long") if "room" in ticks.columns else F.lit(None).cast("long")
    rows = ticks.select(key, F.col(order).cast("long").alias("__tick"), "target", "dt", room.alias("room"))
    return recurrence(rows, key, "__tick", ["target", "dt", "room"], f"{order} bigint, emitted bigint, dropped bigint", fold)


def round_robin(spark, events: int, sensors: int) -> DataFrame:
    """(seq, sensor): which sensor each event comes from."""
    return spark.range(events).select(F.col("id").alias("seq"), (F.col("id") % sensors).alias("sensor"))
