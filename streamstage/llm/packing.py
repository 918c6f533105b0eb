"""Packing of token sequences into as few bins as possible, over the histogram of their lengths."""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamstage.llm.common import chunks, cut, schema_of, texts
from streamstage.llm.tokens import Encoder, vocabulary

CAPACITY = 2048
#: Lengths tried in one place, and fillings looked at around one largest piece, by the quick search for a filling.
WIDE, FILLINGS = 6, 4000
#: Fillings the search over several bins tries before the fewest bins found so far are taken.
TRIES = 20_000
#: Sub-groups among which the pieces of one length are numbered apart.
SALTS = 64


def fillings(counts: dict[int, int], first: int, capacity: int, waste: int):
    """All undominated fillings around a piece of ``first`` that leave ``waste`` at most: lists of lengths, fullest first.

    A filling to which a further piece could be added is dominated by the one with it. So with a gap left, all pieces
    that would fit into the gap are in the filling, and the others are larger than it. Which sums these reach is known
    exactly (a bit for each sum, for each number of lengths), so no branch is entered that leads to no filling.
    """
    left = {x: n for x, n in sorted(counts.items()) if n and x <= capacity - first}
    if first in left:
        left[first] -= 1
    room = capacity - first
    known = None
    for gap in range(min(room, waste) + 1):
        if (rest := room - gap - sum(x * n for x, n in left.items() if x <= gap)) < 0:
            break
        forced = [x for x, n in left.items() if x <= gap for _ in range(n)]
        if known != len(forced):
            known = len(forced)
            lengths = [x for x, n in left.items() if x > gap and n]
            reach = [1]
            for x in lengths:
                bits, n, step = reach[-1], min(left[x], room // x), 1
                while n > 0:
                    bits |= bits << min(step, n) * x
                    n, step = n - step, 2 * step
                reach.append(bits & (1 << room + 1) - 1)

        def compose(total: int, top: int):
            if not total:
                yield []
                return
            for i in range(min(top, bisect.bisect_right(lengths, total)) - 1, -1, -1):
                if not reach[i + 1] >> total & 1:
                    break
                x = lengths[i]
                for n in range(min(left[x], total // x), 0, -1):
                    if reach[i] >> total - n * x & 1:
                        for more in compose(total - n * x, i):
                            yield [x] * n + more

        for chosen in compose(rest, len(lengths)):
            yield sorted(chosen + forced, reverse=True)


def replaceable(chosen: list[int], outside: dict[int, int], gap: int) -> bool:
    """Whether a piece of ``outside`` could stand for a smaller chosen one, or for several chosen ones of no larger sum,
    and still fit: then the filling is dominated by the one with that piece, as what it stands for fits in its old place."""
    single = several = 0
    for x in chosen:
        several |= several << x | single << x
        single |= 1 << x
    taken = several
    for g in range(1, gap + 1):
        taken |= several << g | single << g
    return any(n and taken >> x & 1 for x, n in outside.items())


def quick_filling(counts: dict[int, int], first: int, capacity: int) -> list[int]:
    """A full bin's filling, or else the fullest one, among the few that ``WIDE`` and ``FILLINGS`` allow: largest piece
    that fits first, and none smaller than one that ends a filling no fuller than the best, so that small pieces are
    spared. Better fillings may be passed over, so this is only a start for bin_completion."""
    left = {x: n for x, n in sorted(counts.items()) if x <= capacity - first}
    if first in left:
        left[first] -= 1
    lengths = list(left)
    best: list[int] = []
    seen, full, chosen = 0, 0, []

    def search(room: int, top: int):
        nonlocal best, seen, full
        at, tries = bisect.bisect_right(lengths, min(room, top)) - 1, 0
        while at >= 0 and tries < WIDE and seen < FILLINGS and full < capacity - first:
            x = lengths[at]
            at -= 1
            if left[x]:
                if full and room - x < next(s for s in lengths if left[s]) and capacity - first - room + x <= full:
                    tries += 1
                    break
                left[x] -= 1
                chosen.append(x)
                search(room - x, x)
                chosen.pop()
                left[x] += 1
                tries += 1
        if not tries:
            seen += 1
            if capacity - first - room > full:
                best, full = list(chosen), capacity - first - room

    search(capacity - first, capacity - first)
    return best


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Martello and Toth's bound: pieces over half a bin are in bins of their own, and the others, down to each length,
    have no more room than these bins leave and new ones."""
    of = np.zeros(capacity + 1, np.int64)
    for x, n in histogram.items():
        of[x] = n
    number, size = (np.concatenate([[0], np.cumsum(v)]) for v in (of, of * np.arange(capacity + 1)))  # of lengths below
    half, out = capacity // 2 + 1, 0
    for t in range(half):
        large, small = number[-1] - number[half], size[half] - size[t]
        beside = number[capacity - t + 1] - number[half]
        free = beside * capacity - (size[capacity - t + 1] - size[half])
        out = max(out, int(large + max(0, -(-(small - free) // capacity))))
    return out


def fewer_bins(histogram: dict[int, int], capacity: int, bins: int, tries: int) -> tuple[list[tuple[list[int], int]] | None, int]:
    """(patterns that pack the histogram into ``bins`` bins, or None; tries left).

    Depth first over bins, each around the largest length left, by all its undominated fillings whose waste leaves the
    others room enough. A filling is tried as often as it goes, and then once, which leaves no packing out. None with
    tries left proves that there is none.
    """
    start = {x: n for x, n in histogram.items() if n}
    path: list[tuple[list[int], int]] = []
    dead: set = set()

    def ways(counts: dict[int, int], bins: int, slack: int):
        for rest in fillings(counts, max(counts), capacity, slack):
            pattern = [max(counts), *rest]
            waste = capacity - sum(pattern)
            if replaceable(rest, {x: n - pattern.count(x) for x, n in counts.items()}, waste):
                continue
            most = min(counts[x] // pattern.count(x) for x in set(pattern))
            most = min(most, slack // waste) if waste else most
            for times in (most, 1)[: 1 + (most > 1)]:
                after = dict(counts)
                for x in set(pattern):
                    after[x] -= times * pattern.count(x)
                    if not after[x]:
                        del after[x]
                yield (pattern, times), after, bins - times, slack - times * waste

    slack = bins * capacity - sum(k * v for k, v in start.items())
    if slack < 0:
        return None, tries
    stack = [(ways(start, bins, slack), None)] if start else []
    while stack:
        if not tries:
            return None, 0
        step = next(stack[-1][0], None)
        if step is None:
            dead.add(stack.pop()[1])
            if path:
                path.pop()
            continue
        tries -= 1
        done, counts, rest, slack = step
        # What is left and the bins left say all; large states are not kept, as they hardly come again.
        state = (rest, tuple(sorted(counts.items()))) if len(counts) <= 64 else None
        if state is not None and state in dead:
            continue
        path.append(done)
        if not counts:
            return path, tries
        stack.append((ways(counts, rest, slack), state))
    return ([], tries) if not start else (None, tries)


@dataclass(frozen=True)
class Packing:
    """``patterns`` (lengths, largest first, and how many bins are filled so) of ``bins`` bins. There is none with fewer
    than ``bound`` bins. ``tries`` fillings were searched; ``proved`` tells whether that, or the bound, rules out fewer bins."""

    patterns: list[tuple[list[int], int]]
    bins: int
    bound: int
    tries: int
    proved: bool


def greedy(histogram: dict[int, int], capacity: int, fill=None) -> list[tuple[list[int], int]]:
    """A packing around the largest length left at a time, by best fit or by ``fill``. A pattern fills as many bins as the
    counts allow, so the steps grow with the number of different lengths (capacity at most), not of pieces."""
    counts = {k: v for k, v in histogram.items() if v}
    lengths = sorted(counts)
    out = []
    while lengths:
        first = lengths[-1]
        rest: list[int] = []
        if fill:
            rest = fill(counts, first, capacity)
        else:
            room, left = capacity - first, dict(counts)
            left[first] -= 1
            while (at := bisect.bisect_right(lengths, room) - 1) >= 0:
                while at >= 0 and not left[lengths[at]]:
                    at -= 1
                if at < 0:
                    break
                rest.append(lengths[at])
                left[lengths[at]] -= 1
                room -= lengths[at]
        pattern = [first, *rest]
        times = min(counts[x] // pattern.count(x) for x in set(pattern))
        out.append((pattern, times))
        for x in set(pattern):
            counts[x] -= times * pattern.count(x)
            if not counts[x]:
                del counts[x]
                lengths.pop(bisect.bisect_left(lengths, x))
    return out


def bin_completion(histogram: dict[int, int], capacity: int = CAPACITY, tries: int = TRIES) -> Packing:
    """A packing of the whole histogram by branch and bound over bins.

    Best fit gives the incumbent; where it is above the lower bound, so do quick fillings and the fullest ones. At the
    root, an incumbent on the bound ends the search. Else the undominated fillings of all bins are searched for a packing
    with one bin less than the incumbent, which takes its place, until there is none (the incumbent is proved to be best)
    or ``tries`` fillings are tried (then bins - bound is the most that it can be above the best).
    """
    number = lambda p: sum(n for _, n in p)
    bound, left = lower_bound(histogram, capacity), tries
    best = greedy(histogram, capacity)
    for fill in (quick_filling, lambda *bin: next(fillings(*bin, capacity))):
        if number(best) > bound:
            best = min(greedy(histogram, capacity, fill), best, key=number)
    while number(best) > bound:
        found, left = fewer_bins(histogram, capacity, number(best) - 1, left)
        if found is None:
            break
        best = found
    return Packing(best, number(best), bound, tries - left, number(best) == bound or left > 0)


def placements(patterns: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, pieces per bin, first bin, first offset): where its pieces go, by rank."""
    out: dict[int, list] = {}
    used: dict[int, int] = {}
    bins = 0
    for pattern, times in patterns:
        offset = 0
        for x in sorted(set(pattern), reverse=True):
            k = pattern.count(x)
            out.setdefault(x, []).append((used.get(x, 0), k, bins, offset))
            used[x] = used.get(x, 0) + k * times
            offset += k * x
        bins += times
    return {x: np.array(rows, np.int64) for x, rows in out.items()}


def pieces(docs: DataFrame, vocab: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) of every text's ids with ``end_id``; only texts longer than
    ``capacity`` have more than one. Null texts count as empty and give the one id."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def encode(batches):
        encoder = Encoder.of(vocabulary(vocab))
        end = np.array([end_id], "<u4").tobytes()
        for batch in chunks(batches, "__text"):
            rows = []
            for i, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts(batch, "__text")), strict=True):
                ids = ids + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    rows.append((i, k, k * capacity, len(piece) // 4, zlib.crc32(piece)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema_of(schema).types, strict=True)], schema=schema_of(schema))

    return docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")).mapInArrow(encode, schema)


def pack(docs: DataFrame, vocab: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """Pieces of all texts with sequence_id and offset: sequences of at most ``capacity`` ids, as few as can be found.
    Beside them, alike in all rows: ``sequences`` (how many), ``least_sequences`` (there can't be fewer), ``fillings_tried``
    and ``proved`` (no packing has fewer), see bin_completion.

    The driver sees only the histogram of lengths by salt, of at most ``capacity`` x ``salts`` rows whatever the input.
    Pieces of one length are interchangeable: each gets a rank among them (its salt's first rank plus its place within
    the salt), and the rank gives its bin. Rows that repeat an id are packed as documents of their own; an empty table
    gives an empty result; columns of ``docs`` other than the two are ignored, whatever their names.
    """
    spark = docs.sparkSession
    cut_pieces = cut(pieces(docs, vocab, capacity, 0, id_col, text_col).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int")))
    found = cut_pieces.groupBy("length", "salt").count().collect()
    histogram: dict[int, int] = {}
    first: dict[tuple[int, int], int] = {}
    for row in sorted(found):
        first[row["length"], row["salt"]] = histogram.get(row["length"], 0)
        histogram[row["length"]] = histogram.get(row["length"], 0) + row["count"]
    best = bin_completion(histogram, capacity)
    plan = spark.sparkContext.broadcast((first, placements(best.patterns)))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches):
        """Rows come sorted by (length, salt), each group whole within the partition."""
        first, where = plan.value
        group, rank = None, 0
        for batch in batches:
            key = list(zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True))
            ranks = []
            for k in key:
                group, rank = (k, rank + 1) if k == group else (k, first[k])
                ranks.append(rank)
            lengths, ranks = np.array([k[0] for k in key]), np.array(ranks)
            bins, offsets = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
            for x in np.unique(lengths):
                own, rows = lengths == x, where[int(x)]
                at = rows[np.searchsorted(rows[:, 0], ranks[own], "right") - 1]
                inside = ranks[own] - at[:, 0]
                bins[own], offsets[own] = at[:, 2] + inside // at[:, 1], at[:, 3] + inside % at[:, 1] * x
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bins), pa.array(offsets)], schema=schema_of(schema))

    dealt = cut_pieces.repartition("length", "salt").sortWithinPartitions("length", "salt", "doc_id", "piece", "ids_crc32")
    told = {"sequences": F.lit(best.bins).cast("long"), "least_sequences": F.lit(best.bound).cast("long"), "fillings_tried": F.lit(best.tries).cast("long"), "proved": F.lit(best.proved)}
    return dealt.mapInArrow(place, schema).withColumnRenamed("doc_id", id_col).withColumns(told)
