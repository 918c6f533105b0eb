"""Flow control and scaling as models: what credit windows grant, what they yield, how votes scale a stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamstage.operators.keyed import recurrence


def credit_grant(message: Column) -> Column:
    """Credits that a worker's message grants: its ``n_credits``; 1 for a message that has none or isn't JSON."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(message), "$.n_credits", "bigint"), F.lit(1).cast("long"))


def refill_threshold(window: Column) -> Column:
    """Events after which a worker grants anew."""
    return F.greatest(F.floor(window / 2), F.lit(1)).cast("long")


def capacity_eps(rtt_us: Column, amortized: Column, work_us: Column) -> Column:
    """Events a second of one worker: a round trip shared by ``amortized`` events, plus the work."""
    return F.lit(1e6) / (rtt_us / amortized + work_us)


def dispatch(trace: DataFrame, key: str = "stage", order: str = "tick", buffer: int = 5000, batch: int = 256) -> DataFrame:
    """Events against credits, turn by turn: (key, dispatched, queued, waiting, idle_credits, purged, most_queued).

    ``trace`` has arrivals, credits and lost (credits of workers that went) per turn. In a turn, up to ``batch`` events
    leave, each for a credit; then credits come and those of lost workers are purged; then as many arrivals are taken as
    the buffer has room for, the others wait where they come from, as nothing is polled from there; then up to ``batch``
    events leave again. An event leaves only for a worker that is there, so none is lost with one.
    """

    def fold():
        held = dict.fromkeys(("dispatched", "queued", "waiting", "idle_credits", "purged", "most_queued"), 0)

        def leave():
            n = min(held["queued"], held["idle_credits"], batch)
            for name, change in (("dispatched", n), ("queued", -n), ("idle_credits", -n)):
                held[name] += change

        def step(_, arrivals, credits, lost):
            leave()
            gone = min(held["idle_credits"] + credits, lost)
            held["idle_credits"] += credits - gone
            held["purged"] += gone
            taken = min(held["waiting"] + arrivals, max(buffer - held["queued"], 0))
            held["waiting"] += arrivals - taken
            held["queued"] += taken
            held["most_queued"] = max(held["most_queued"], held["queued"])
            leave()
            return ()

        return step, lambda: [tuple(held.values())]

    rows = trace.select(key, order, *[F.col(c).cast("long").alias(c) for c in ("arrivals", "credits", "lost")])
    return recurrence(rows, key, order, ["arrivals", "credits", "lost"], "dispatched bigint, queued bigint, waiting bigint, idle_credits bigint, purged bigint, most_queued bigint", fold)


def autoscale(trace: DataFrame, key: str = "stage", order: str = "tick", depth: str = "qd", queue_up: float = 50, queue_down: float = 0, up_ticks: int = 100, down_ticks: int = 5000, least: int = 0, most: int = 2, settle: int = 3) -> DataFrame:
    """Votes on queue depths (whole numbers) in order: (key, replicas, ups, downs, cold_starts, breaches).

    A depth above ``queue_up`` votes up and clears the votes down; one at or below ``queue_down`` does the reverse; any
    other takes one from both. Then the first of these rules that holds acts: surplus over ``most`` goes;
    without a replica and with a queue one starts cold; below ``least`` one is added; enough votes up and ``settle``
    ticks since the last start add one; enough votes down take one and clear them. ``breaches`` counts the ticks at which a
    full stage would be reported as too slow.
    """

    def fold():
        n, up, down, since, ups, downs, colds, breaches = least, 0, 0, 0, 0, 0, 0, 0

        def step(_, qd):
            nonlocal n, up, down, since, ups, downs, colds, breaches
            before = down
            up, down = (up + 1, 0) if qd > queue_up else (0, down + 1) if qd <= queue_down else (max(up - 1, 0), max(down - 1, 0))
            late, since = qd > queue_up and n >= most and up in (0, max(up_ticks - 1, 0)), since + 1
            if n > most:
                downs, n, up, down = downs + n - most, most, 0, before
            elif n == 0 and qd > 0 and most > 0:
                n, up, since, ups, colds = 1, 0, 0, ups + 1, colds + 1
            elif n < least:
                n, since, ups = n + 1, 0, ups + 1
            elif up >= up_ticks and since >= settle and n < most:
                n, up, since, ups = n + 1, 0, 0, ups + 1
            else:
                breaches += late
                if down >= down_ticks and n > least:
                    n, downs, down = n - 1, downs + 1, 0
            return ()

        return step, lambda: [(n, ups, downs, colds, breaches)]

    rows = trace.select(key, order, F.col(depth).cast("long").alias("depth"))
    return recurrence(rows, key, order, ["depth"], "replicas bigint, ups bigint, downs bigint, cold_starts bigint, breaches bigint", fold)


def queue_series(trace: DataFrame, period_s: float = 1e-3) -> DataFrame:
    """(stage, t_s, depth): times to three places."""
    return trace.select("stage", F.round(F.col("tick") * period_s, 3).alias("t_s"), F.col("qd").alias("depth"))
