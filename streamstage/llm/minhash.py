"""Near-duplicates by SetSketch registers: banded, estimated by likelihood, verified on full shingle sets."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamstage.llm.common import chunks, cut, each_salt, fresh, salts_of, schema_of, sweep, texts
from streamstage.llm.graph import components

#: Bands of so many registers. A pair at similarity 0.8 shares no band with probability (1 - 0.8^5)^36 < 1e-6.
BANDS, ROWS = 36, 5
REGISTERS = BANDS * ROWS
# Parameters of the sketch: base and rate of the exponential spacing, largest register.
BASE, RATE, LAST = 1.001, 20.0, (1 << 16) - 2
#: Standard deviations below the threshold at which an estimate still sends a pair to verification.
MARGIN = 6.0
#: A bucket's members are compared with each other in blocks of at most so many members and so many shingles.
BLOCK_NODES, BLOCK_SHINGLES = 1024, 1 << 21
SALTS = 64
#: Bits of the filter that keeps texts out of a shuffle.
FILTER_BITS = 1 << 26

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_rng = np.random.default_rng(20240607)
_MULTIPLY = _rng.integers(0, 1 << 64, REGISTERS, np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 64, REGISTERS, np.uint64)
_BAND = _rng.integers(0, 1 << 64, (BANDS, ROWS + 1), np.uint64) | np.uint64(1)
_PLACE = _rng.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)
#: Words of which a worker remembers the hash; then it starts anew.
REMEMBERED = 250_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_words = _Words()


def normal_words(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8").translate(_LOWER).split()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(29)


def shingle_set(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``k`` words; of the whole sequence if shorter; none without words.
    These stand for the shingles everywhere, full sets included: two shingles of a pair of texts of 10,000 words have one
    hash with a chance of 1 in 10^11. Sets are equal if a 128-bit digest of them is."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    short = len(h) < k
    n = len(h) if short else k
    out = np.full(len(h) - n + 1, n if short else 0, np.uint64) * _PLACE[-1]
    for i in range(n):
        out += h[i : len(h) - n + 1 + i] * _PLACE[i]
    return np.unique(_mix(out))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers of a set: floor(1 - log_BASE of the least exponential variate), cut to 0..LAST + 1. The sketch of a
    union is the maximum of sketches."""
    least = np.full(REGISTERS, (1 << 32) - 1, np.uint64)
    for at in range(0, len(shingles), 1024):
        mixed = shingles[at : at + 1024, None] * _MULTIPLY + _ADD
        least = np.minimum(least, mixed.min(axis=0) >> np.uint64(32))
    if not len(shingles):
        return np.zeros(REGISTERS, np.uint16)
    variate = -np.log1p(-(least.astype(np.float64) + 0.5) / (1 << 32)) / RATE
    return np.clip(np.floor(1 - np.log(variate) / np.log(BASE)), 0, LAST + 1).astype(np.uint16)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band's registers and place."""
    r = registers.reshape(BANDS, ROWS).astype(np.uint64)
    return _mix((r * _BAND[:, :ROWS]).sum(axis=1, dtype=np.uint64) + _BAND[:, ROWS]).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 100) -> np.ndarray:
    """Most likely similarity of pairs of sketches (rows of a and b) of sets of known size, by the joint likelihood of
    how many registers are larger, smaller and equal."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    top = np.minimum(u / v, v / u)
    j = np.linspace(0, 1, steps + 1)[None, :] * top[:, None]
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    p, q = chance(u[:, None] - v[:, None] * j), chance(v[:, None] - u[:, None] * j)
    tiny = 1e-12
    likely = more[:, None] * np.log(p + tiny) + less[:, None] * np.log(q + tiny) + equal[:, None] * np.log(np.maximum(1 - p - q, tiny))
    return j[np.arange(len(j)), likely.argmax(axis=1)]


def _sketches(docs: DataFrame, k: int) -> DataFrame:
    """(node, n, digest, keys, registers) of rows (node, text)."""
    ddl = "node long, n long, digest binary, keys array<long>, registers binary"

    def compute(batches):
        import xxhash

        for batch in chunks(batches, "text"):
            n, digests, keys, registers = [], [], [], []
            for text in texts(batch, "text"):
                s = shingle_set(normal_words(text), k)
                n.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                r = sketch(s)
                keys.append(band_keys(r) if len(s) else [])
                registers.append(r.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, t) for x, t in zip((n, digests, keys, registers), schema_of(ddl).types[1:], strict=True)]], schema=schema_of(ddl))

    return docs.mapInArrow(compute, ddl)


def _representatives(rows: DataFrame) -> DataFrame:
    """(node, digest, rep): the smallest node with the same set. Salted: a hot set's rows never meet in one task."""
    salted = rows.select("node", "digest", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt"))
    part = salted.groupBy("digest", "salt").agg(F.min("node").alias("rep"))
    whole = part.groupBy("digest").agg(F.min("rep").alias("rep"), salts_of("salt").alias("salts"))
    return salted.join(whole.select("digest", "rep", each_salt("salts").alias("salt")), ["digest", "salt"]).select("node", "digest", "rep")


def _likely(pairs: DataFrame, known: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) of which sizes and sketches don't rule out the similarity."""
    side = lambda x: known.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").where(F.lit(100) * F.least("n_a", "n_b") >= F.lit(least) * F.greatest("n_a", "n_b"))
    floor = least / 100 - MARGIN * (0.2 * 0.8 / REGISTERS) ** 0.5

    def compute(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, n_a, n_b, r_a, r_b = batch.columns
            registers = [np.frombuffer(b"".join(x.to_pylist()), np.uint16).reshape(-1, REGISTERS) for x in (r_a, r_b)]
            keep = estimate(*registers, *[np.array(x.to_pylist(), np.float64) for x in (n_a, n_b)]) >= floor
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep)), b.filter(pa.array(keep))], names=["a", "b"])

    return rows.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(compute, "a long, b long").distinct()


def _verified(pairs: DataFrame, bodies: DataFrame, k: int, least: int) -> DataFrame:
    """The pairs of which the full sets are as similar as asked."""
    side = lambda x: bodies.select(F.col("node").alias(x), F.col("body").alias(f"t_{x}"))
    rows = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "t_a", "t_b")

    def compute(batches):
        last: dict[int, np.ndarray] = {}
        for batch in batches:
            keep = []
            for i, x, y in zip(*[batch.column(c).to_pylist() for c in (0, 2, 3)], strict=True):
                if i not in last:
                    last = {i: shingle_set(zlib.decompress(x).split(), k)}
                s, t = last[i], shingle_set(zlib.decompress(y).split(), k)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= least * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(compute, "a long, b long")


def _marked(nodes: DataFrame) -> np.ndarray:
    """A bit for the hash of each node, of FILTER_BITS: as large for any input. The more nodes, the more others pass."""
    at = F.pmod(F.xxhash64("node"), F.lit(FILTER_BITS))
    rows = nodes.groupBy((F.shiftright(at, 15)).alias("part")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit((1 << 15) - 1))).alias("bits")).collect()
    out = np.zeros((FILTER_BITS >> 15, 1 << 12), np.uint8)
    for r in rows:
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _bodies(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, body) of the nodes: words in normal form, compressed. A filter of fixed size keeps most other texts from
    being shuffled; the join is exact."""
    marks = docs.sparkSession.sparkContext.broadcast(_marked(nodes))

    def compute(batches):
        for batch in batches:
            at = batch.column(2).to_numpy()
            hit = batch.filter(pa.array((marks.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            for part in chunks([hit], "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([zlib.compress(b" ".join(normal_words(x)), 1) for x in texts(part, "text")], pa.binary())], names=["node", "body"])

    some = docs.where("node IS NOT NULL").select("node", "text", F.pmod(F.xxhash64("node"), F.lit(FILTER_BITS)).alias("at"))
    return some.mapInArrow(compute, "node long, body binary").join(nodes, "node", "left_semi")


def _candidates(group: list[tuple], least: int):
    """(row, rows that it may be linked with) among one block pair's rows (key, band, one, two, own, node, component, n,
    registers, ...): pairs of different components whose sizes and sketches don't rule out the similarity.

    A pair is looked at in the first band that it shares only.
    """
    band, first, second = group[0][1], group[0][2], group[0][3]
    side = np.array([r[4] for r in group])
    comp = np.array([r[6] for r in group])
    n = np.array([r[7] for r in group], np.float64)
    registers = np.frombuffer(b"".join(r[8] for r in group), np.uint16).reshape(-1, REGISTERS)
    rows = np.flatnonzero(side == first)
    columns = rows if first == second else np.flatnonzero(side == second)
    floor = least / 100 - MARGIN * (0.2 * 0.8 / REGISTERS) ** 0.5
    turned = np.ascontiguousarray(registers[columns].T)
    for i in rows.tolist():
        close = (comp[columns] != comp[i]) & (100 * np.minimum(n[columns], n[i]) >= least * np.maximum(n[columns], n[i]))
        if first == second:
            close &= columns > i
        at = np.flatnonzero(close)
        if not len(at):
            continue
        equal = (turned if len(at) == len(columns) else turned[:, at]) == registers[i][:, None]
        enough = np.flatnonzero(np.count_nonzero(equal, axis=0) >= floor * REGISTERS)
        if not len(enough):
            continue
        whole = equal[:, enough].reshape(BANDS, ROWS, -1).all(axis=1)
        at = at[enough[whole.argmax(axis=0) == band]]
        if not len(at):
            continue
        other = columns[at]
        near = estimate(np.broadcast_to(registers[i], (len(at), REGISTERS)), registers[other], np.full(len(at), n[i]), n[other])
        yield i, other[near >= floor].tolist()


def _compared(group: list[tuple], k: int, least: int) -> list[tuple[int, int]]:
    """Links among one block pair's rows (..., body). Once a link joins two components, their other pairs are skipped: one
    link is enough."""
    nodes, root = [r[5] for r in group], {r[6]: r[6] for r in group}

    def up(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    sets: dict[int, np.ndarray] = {}

    def shingles(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingle_set(zlib.decompress(group[i][9]).split(), k)
        return sets[i]

    out = []
    for i, others in _candidates(group, least):
        for j in others:
            x, y = up(group[i][6]), up(group[j][6])
            if x == y:
                continue
            s, t = shingles(i), shingles(j)
            both = len(np.intersect1d(s, t, assume_unique=True))
            if 100 * both >= least * (len(s) + len(t) - both):
                root[max(x, y)] = min(x, y)
                out.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
    return out


def _by_block_pair(rows: DataFrame, ddl: str, look) -> DataFrame:
    """``look`` at all rows (key, band, one, two, own, node, ...) of each block pair together."""
    dealt = rows.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two", "node")
    schema = schema_of(ddl)

    def table(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema)

    def compute(batches):
        group: list[tuple] = []
        for batch in batches:
            found = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if group and (group[0][0], *group[0][2:4]) != (row[0], *row[2:4]):
                    found += look(group) if len(group) > 1 else []
                    group = []
                group.append(row)
            if found:
                yield table(found)
        if len(group) > 1 and (found := look(group)):
            yield table(found)

    return dealt.mapInArrow(compute, ddl)


def _rest(shared: DataFrame, comps: DataFrame, held: DataFrame, k: int, least: int) -> DataFrame:
    """Links (a, b) between nodes of different components that share a bucket: each such pair is looked at.

    Buckets with members of one component only are done with, and of buckets with the same members one is enough (that
    of the lowest band). Members are dealt into blocks; a task compares two blocks at a time and gives links only, so
    that memory doesn't grow with the bucket. A member of a bucket of several blocks travels to each of them, at first
    as its sketch alone; its text follows only to those in which the sketches leave it a partner.
    """
    sizes = held.select("node", "n")
    placed = cut(shared.join(comps, "node").join(sizes, "node"))
    buckets = placed.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"), F.min("band").alias("band"), F.bit_xor(F.xxhash64("node")).alias("who")
    )
    buckets = buckets.where("low < high").groupBy("who", "members").agg(F.min_by(F.struct("key", "shingles"), "band").alias("b"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_NODES), F.ceil(F.col("b.shingles") / BLOCK_SHINGLES)).cast("int")
    buckets = cut(buckets.select("b.key", blocks.alias("blocks")))
    left = placed.join(buckets, "key")
    own = F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int")
    left = left.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.select("key", "band", F.least("own", "with").alias("one"), F.greatest("own", "with").alias("two"), "own", "node", "component", "blocks")
    names = ["key", "band", "one", "two", "own", "node", "component", "n", "registers"]
    if not buckets.where("blocks > 1").isEmpty():
        large = left.where("blocks > 1")
        some = _by_block_pair(large.join(held.drop("body"), "node").select(*names), "key long, one int, two int, node long", lambda group: _with_partner(group, least)).distinct()
        left = left.where("blocks = 1").unionByName(large.join(some, ["key", "one", "two", "node"], "left_semi"))
    full = left.join(held, "node").select(*names, "body")
    return _by_block_pair(full, "a long, b long", lambda group: _compared(group, k, least)).distinct()


def _with_partner(group: list[tuple], least: int) -> list[tuple[int, int, int, int]]:
    """(key, one, two, node) of a block pair's rows that are in any candidate pair."""
    hit = {j for i, others in _candidates(group, least) if others for j in (i, *others)}
    return [(*[group[j][c] for c in (0, 2, 3)], group[j][5]) for j in sorted(hit)]


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """The components after the links (a, b) of nodes."""
    side = lambda x, c: comps.select(F.col("node").alias(x), F.col("component").alias(c))
    moved = components(links.join(side("a", "c"), "a").join(side("b", "d"), "b").select(F.col("c").alias("a"), F.col("d").alias("b")))
    after = comps.join(moved.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    return cut(after.select("node", F.coalesce("to", "component").alias("component")))


def near_groups(docs: DataFrame, k: int = 5, least: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |intersection| >= ``least`` * |union| of their sets of ``k``-word shingles;
    component_id is the smallest id that links lead to. Rows with one set count as one node. Nodes that share a band of
    registers are candidates. First each node meets two leaders of its buckets, which joins large groups by few
    comparisons; then all candidate pairs that still are in different components are compared, in blocks. Sketches rule
    out what can't be similar; what is left is verified on whole sets.

    Null texts count as empty; empty sets have no links. A row without an id stays alone: its component_id is null and
    it is kept. Rows that repeat an id count as one document, and are all kept if it is.
    """
    sweep(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("node"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = cut(_sketches(plain, k))
    alike = cut(_representatives(rows.where("n > 0 AND node IS NOT NULL")))
    known = rows.where("n > 0").join(alike.where("node = rep").select("node", "digest").distinct(), ["node", "digest"], "left_semi").select("node", "n", "keys", "registers")
    banded = known.select("node", F.posexplode("keys").alias("band", "key"))
    # The leaders' table is written first, so that both sides of the join are dealt anew and a hot bucket can be split.
    leaders = cut(banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min_by("node", F.struct(F.xxhash64("node"), "node")).alias("lead")).where("n > 1").select("key", "lead"))
    shared = cut(banded.join(leaders, "key").select("key", "band", "node", "lead").distinct())
    nodes = cut(shared.select("node").distinct())
    held = cut(known.join(nodes, "node", "left_semi").select("node", "n", "registers").join(_bodies(plain, nodes), "node"))
    comps = nodes.select("node", F.col("node").alias("component"))
    met = shared.where("node <> lead").groupBy("node", "lead").agg(F.count(F.lit(1)).alias("bands")).groupBy("node").agg(
        F.max_by("lead", F.struct("bands", "lead")).alias("often"), F.min_by("lead", F.struct(F.xxhash64("lead"), "lead")).alias("first")
    )
    pairs = met.select("node", F.explode(F.array("often", "first")).alias("to")).select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")).distinct()
    comps = _joined(comps, cut(_verified(_likely(pairs, held, least), held, k, least)))
    sweep(docs.sparkSession)
    comps = _joined(comps, cut(_rest(shared.drop("lead"), comps, held, k, least)))
    reps = alike.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").select("node", F.coalesce("component", "rep").alias("component"))
    reps = reps.groupBy("node").agg(F.min("component").alias("component_id"))
    out = rows.select("node", F.col("n").alias("n_shingles")).join(reps, "node", "left")
    out = out.select(F.col("node").alias(id_col), "n_shingles", F.coalesce("component_id", "node").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def near_dedup(docs: DataFrame, k: int = 5, least: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, the one with the smallest id; all columns as they were. Rows without an id stay.

    Where ids repeat, rows (not ids) are what is compared, so that a row never goes for what another of its id says; of
    a group's rows with the smallest id, one stays.
    """
    who = fresh(docs, "__gone")
    if docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty():
        gone = near_groups(docs, k, least, id_col, text_col).where("NOT kept").select(F.col(id_col).alias(who)).distinct()
        return docs.join(gone, F.col(id_col).eqNullSafe(F.col(who)), "left_anti")
    row = fresh(docs, "__row")
    numbered = cut(docs.withColumn(row, F.when(F.col(id_col).isNotNull(), F.monotonically_increasing_id())))
    grouped = near_groups(numbered, k, least, row, text_col).where(F.col(row).isNotNull())
    grouped = grouped.join(numbered.select(row, F.col(id_col).alias(who)), row).select(row, who, "component_id")
    stays = grouped.groupBy("component_id").agg(F.min(F.struct(who, row)).alias("least")).select(F.col(f"least.{row}").alias(who))
    gone = grouped.select(row).join(stays, F.col(row) == F.col(who), "left_anti").withColumnRenamed(row, who)
    return numbered.join(gone, F.col(row) == F.col(who), "left_anti").drop(row)
