"""Sampled SentencePiece segmentations: forward filtering, backward sampling over each word's lattice of pieces.

A piece of rank r in the vocabulary weighs (r + 2) ** -THETA; a byte piece weighs BYTE. A segmentation's chance is the
product of its pieces' weights over the sum for all segmentations. Sampling a text works on each of its words (a word
starts with the space before it) whole, however long, which is exact, as no piece but runs of spaces crosses a space.
"""

from __future__ import annotations

import math
import re
import zlib
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamstage.llm.common import chunks, schema_of, texts
from streamstage.llm.tokens import vocabulary

#: How much a piece's rank weighs against it. Larger: fewer, more usual pieces.
THETA = 1.0
#: Weight of a byte piece, below that of any other.
BYTE = 1e-7
SEED = 17
#: Bytes of text that are sampled together.
TOGETHER = 2 << 20
#: Characters of filtered words that a worker keeps for the texts to come. Chances are the same without.
KNOWN = 3 << 20
#: Characters of words that are filtered side by side, and words that are sampled so; few enough for a core's own memory.
SIDE_BY_SIDE, WORDS = 1 << 15, 1 << 14
SPACE = "▁"
_WORD = re.compile("[ ]*[^ ]+|[ ]+")
#: Words longer than this are filtered one by one instead of side by side, in blocks of that many characters.
LONG, BLOCK = 512, 1 << 15
#: Sums of that many characters stay within floating point; in longer words they are rescaled each RESCALE characters.
SAFE, RESCALE = 48, 16

_models: dict[str, "Lattice"] = {}


def _uniform(keys: np.ndarray, turn: np.ndarray | int) -> np.ndarray:
    """Numbers in [0, 1) that depend on key and turn alone (SplitMix64)."""
    z = keys + np.asarray(turn, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return ((z ^ z >> np.uint64(31)) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _portions(text_list: list[str]):
    """Lists of (text, number of its first word, words) with about TOGETHER characters each."""
    portion, size = [], 0
    for d, text in enumerate(text_list):
        found, n = (m[0] for m in _WORD.finditer(text)), 0
        while words := list(islice(found, TOGETHER // 8)) if len(text) > TOGETHER else not n and _WORD.findall(text):
            portion.append((d, n, words))
            n += len(words)
            size += sum(map(len, words))
            if size >= TOGETHER:
                yield portion
                portion, size = [], 0
    if portion:
        yield portion


class _Growing:
    """An array that is added to."""

    def __init__(self, dtype):
        self.data, self.size = np.empty(1 << 12, dtype), 0

    def add(self, more: np.ndarray) -> None:
        if (end := self.size + len(more)) > len(self.data):
            self.data = np.concatenate([self.data[: self.size], np.empty(max(end, 2 * self.size) - self.size, self.data.dtype)])
        self.data[self.size : end] = more
        self.size = end


class Lattice:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte = np.zeros(256, np.int64)
        self.piece: dict[str, int] = {}
        self.text: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.text.append(b"")
            else:
                self.text.append(piece.replace(SPACE, " ").encode("utf-8"))
                self.piece[piece.replace(SPACE, " ")] = i
        self.weight = (np.arange(model.get_piece_size()) + 2.0) ** -THETA
        self.weight[self.byte] = BYTE
        self.longest = max(map(len, self.piece))
        # Hashes of all pieces' prefixes by length, sorted, to look up all substrings of one length at once: (hash, id or -1).
        rng = np.random.default_rng(7)
        self.base = int(rng.integers(1 << 62) * 2 + 1)
        found: list[dict[int, int]] = [{} for _ in range(self.longest)]
        for piece, i in self.piece.items():
            for n in range(1, len(piece) + 1):
                h = self._hash(piece[:n])
                found[n - 1][h] = i if n == len(piece) else found[n - 1].get(h, -1)
        self.tables = [(np.array(sorted(x), np.uint64), np.array([x[h] for h in sorted(x)], np.int64)) for x in found]
        # What a character on its own weighs: as a piece, or else as bytes.
        self.alone = {ord(c): self.weight[i] for c, i in self.piece.items() if len(c) == 1}
        self.forget()

    @classmethod
    def of(cls, path: str) -> Lattice:
        if path not in _models:
            _models[path] = cls(path)
        return _models[path]

    def _hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * self.base + ord(c) * 0x2545F4914F6CDD1D) % (1 << 64)
        return h

    def _alone(self, chars: np.ndarray) -> np.ndarray:
        kinds, which = np.unique(chars, return_inverse=True)
        return np.array([self.alone.get(c) or BYTE ** len(chr(c).encode("utf-8", "surrogatepass")) for c in kinds.tolist()])[which]

    def _found(self, chars: np.ndarray, left: np.ndarray, most: int):
        """(length, first characters, ids, relative weights) of all pieces in ``chars``, of which ``left`` belong together."""
        alone = self._alone(chars)
        hashes, product = np.zeros(len(chars), np.uint64), np.ones(len(chars))
        mixed = chars.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
        live = np.arange(len(chars))
        for n in range(1, most + 1):
            live = live[left[live] >= n]
            h = hashes[live] * np.uint64(self.base) + mixed[live + n - 1]
            keys, own = self.tables[n - 1]
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            live, h, at = live[hit], h[hit], at[hit]
            hashes[live] = h
            product[live] *= alone[live + n - 1]
            whole = own[at] >= 0
            start, i = live[whole], own[at[whole]]
            yield n, start, i, self.weight[i] / product[start]

    def prepare(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Forward filtering of all words (longest first) side by side.

        Returns (each word's last node, each node's place in its word, number of arcs of each node, the arcs' cumulated
        chances, lengths and ids, the characters). Nodes are characters; arcs are those that end at a node, shortest
        first; id -1 is a character's bytes. A node's chances come from its word alone, whatever words stand beside it.

        Weights are taken relative to those of the characters alone. This multiplies all segmentations of a word by
        the same number. Sums are rescaled along a word with all that are still needed, which leaves chances as they are.
        """
        sizes = np.array([len(w) for w in words], np.int64)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        first = np.cumsum(sizes) - sizes
        place = np.arange(len(chars)) - np.repeat(first, sizes)
        left = np.repeat(sizes, sizes) - place
        most = min(self.longest, int(sizes.max(initial=1)))
        weight, ids = np.zeros((most + 1, len(chars))), np.full((most + 1, len(chars)), -2, np.int32)  # by length and last character
        weight[1], ids[1] = 1.0, -1  # a character that is a piece, or its bytes
        for n, start, i, w in self._found(chars, left, most):
            ids[n, start + n - 1] = i
            weight[n, start + n - 1] = w
        alpha = np.zeros(len(chars))
        sums = alpha if sizes.max(initial=0) <= SAFE else np.zeros(len(chars))
        for p in range(int(sizes.max(initial=0))):
            nodes = first[: np.searchsorted(-sizes, -p, "left")] + p
            if p >= SAFE and p % RESCALE == 0:  # sums never fall, so the last one is the largest
                for n in range(min(p, most), 0, -1):
                    alpha[nodes - n] /= alpha[nodes - 1]
            total = np.zeros(len(nodes))
            for n in range(1, min(p + 1, most) + 1):
                w = weight[n, nodes]
                if n <= p:
                    w = w * alpha[nodes - n]
                total += w
                weight[n, nodes] = total
            alpha[nodes] = sums[nodes] = total
        at = np.flatnonzero(np.ascontiguousarray(ids[1:].T).ravel() > -2)
        end = at // most
        length = at - end * most + 1
        arcs = np.bincount(end, minlength=len(chars))
        share = weight[length, end] / sums[end]
        share[np.cumsum(arcs) - 1] = 1.0
        return first + sizes - 1, place, arcs, share, length, ids[length, end], chars

    def _learn(self, words: list[str]) -> None:
        """Filter words (longest first) and keep what sampling needs beside that of the words before."""
        begin = size = 0
        for end, word in enumerate(words, 1):
            size += len(word)
            if size >= SIDE_BY_SIDE or end == len(words):
                last, place, arcs, share, length, ids, chars = self.prepare(words[begin:end])
                self.known.update(zip(words[begin:end], (last + self.kept).tolist(), strict=True))
                self.first.add(self.first.data[self.first.size - 1] + np.cumsum(arcs))
                for kept, new in zip((self.place, self.char, self.share, self.length, self.ids), (place, chars, share, length, ids), strict=True):
                    kept.add(new)
                self.kept += size
                begin, size = end, 0

    def forget(self) -> None:
        self.known: dict[str, int] = {}  # each word's last node
        self.kept = 0
        self.first = _Growing(np.int64)  # first arc of each node
        self.first.add(np.zeros(1, np.int64))
        self.place, self.char = _Growing(np.int16), _Growing(np.int32)  # of nodes
        self.share, self.length, self.ids = _Growing(np.float64), _Growing(np.int8), _Growing(np.int32)  # of arcs

    def sample_long(self, word: str, keys: np.ndarray) -> list[np.ndarray]:
        """Samples of one long word, by a key each. Only the logarithms of the forward sums are kept for the whole word;
        arcs are looked up again block by block, with the characters before it that its first arcs reach back to."""
        chars = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        held: dict = {}

        def arcs(block: int):
            """First arc of each of the block's characters, lengths, weights and ids, by last character."""
            if block not in held:
                a, b = block * BLOCK, min((block + 1) * BLOCK, len(chars))
                low = max(0, a - self.longest + 1)
                found = list(self._found(chars[low:b], np.arange(b - low, 0, -1), self.longest))
                own = np.full(b - a, -1, np.int64)  # the arcs of one character: its piece, or its bytes
                n, start, i, _ = found[0]
                own[start[start >= a - low] + low - a] = i[start >= a - low]
                end = np.concatenate([np.arange(b - a), *[start + n - 1 + low - a for n, start, _, _ in found[1:]]])
                length = np.concatenate([np.ones(b - a, np.int64), *[np.full(len(start), n) for n, start, _, _ in found[1:]]])
                ids = np.concatenate([own, *[i for _, _, i, _ in found[1:]]])
                weight = np.concatenate([np.ones(b - a), *[w for _, _, _, w in found[1:]]])
                order = np.lexsort((length, end))
                order = order[end[order] >= 0]
                held.clear()
                held[block] = np.searchsorted(end[order], np.arange(b - a + 1)).tolist(), length[order].tolist(), weight[order].tolist(), ids[order].tolist()
            return held[block]

        log = np.zeros(len(chars) + 1)  # before each character, and at the end
        recent, scale = [0.0] * (self.longest - 1) + [1.0], 0.0
        for block in range(-(-len(chars) // BLOCK)):
            first, length, weight, _ = arcs(block)
            sums = recent
            for p in range(len(first) - 1):
                total = sum([weight[k] * sums[-length[k]] for k in range(first[p], first[p + 1])])
                if total > 1e100:
                    scale += math.log(total)
                    sums = [x / total for x in sums[-self.longest :]]
                    total = 1.0
                sums.append(total)
                log[block * BLOCK + p + 1] = math.log(total) + scale
            recent = sums[-self.longest :]
        out = []
        for key in keys:
            node, turn, got, draws = len(chars), 0, [], []
            while node:
                if turn % 4096 == 0:
                    draws = _uniform(np.full(4096, key, np.uint64), np.arange(turn, turn + 4096)).tolist()
                block, p = divmod(node - 1, BLOCK)
                first, length, weight, ids = arcs(block)
                draw = draws[turn % 4096]
                for k in range(first[p], first[p + 1]):
                    draw -= weight[k] * math.exp(log[node - length[k]] - log[node])
                    if draw < 0:
                        break
                if ids[k] >= 0:
                    got.append(ids[k])
                else:
                    got += self.byte[list(chr(chars[node - 1]).encode("utf-8", "surrogatepass"))].tolist()[::-1]
                node -= length[k]
                turn += 1
            out.append(np.array(got[::-1], np.int64))
        return out

    def sample(self, text_list: list[str], keys: list[int], seed: int = SEED) -> list[np.ndarray]:
        """A sampled segmentation (ids) of each text, by its key and the seed alone."""
        out: list[list[np.ndarray]] = [[] for _ in text_list]
        mixed = np.array([k & (1 << 64) - 1 for k in keys], np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed)
        mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        for portion in _portions(text_list):
            for (d, _, _), ids in zip(portion, self._sample(portion, mixed), strict=True):
                out[d].append(ids)
        return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]

    def _sample(self, portion: list[tuple[int, int, list[str]]], mixed: np.ndarray) -> list[np.ndarray]:
        """Ids of each part (text, number of its first word, words) of a portion."""
        split = [words for _, _, words in portion]
        flat = list(chain.from_iterable(split))
        own = set(flat)
        long = {w: -1 - i for i, w in enumerate(w for w in own if len(w) > LONG)}
        new = own - self.known.keys() - long.keys()
        if sum(map(len, new)) + self.kept > KNOWN:
            self.forget()
            new = own - long.keys()
        self._learn(sorted(new, key=len, reverse=True))
        first, place, chars, share, length, ids = (x.data for x in (self.first, self.place, self.char, self.share, self.length, self.ids))
        counts = np.array([len(x) for x in split], np.int64)
        doc = np.repeat(np.arange(len(split)), counts)
        last = np.fromiter(map((self.known | long if long else self.known).__getitem__, flat), np.int64, len(flat))
        nth = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts - np.array([n for _, n, _ in portion]), counts)
        key = mixed[[d for d, _, _ in portion]][doc] + nth.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        live = np.argsort(last, kind="stable")  # equal words side by side look up the same places
        one_by_one, live = np.split(live, [int((last < 0).sum()) if long else 0])
        taken = np.zeros(len(flat), np.int64)
        got = []
        for begin in range(0, len(live), WORDS):
            who, turn = live[begin : begin + WORDS], 0
            node, own = last[who], key[who]
            while len(who):
                draw = _uniform(own, turn)
                at, low = first[node + 1] - 1, first[node]
                high = np.flatnonzero((at > low) & (draw < share[np.maximum(at - 1, 0)]))  # the longest arc is the likeliest
                while len(high):
                    at[high] -= 1
                    k = at[high]
                    high = high[(k > low[high]) & (draw[high] < share[np.maximum(k - 1, 0)])]
                got.append((turn, who, ids[at], chars[node]))
                turn += 1
                step = length[at]
                more = place[node] >= step
                taken[who[~more]] = turn
                who, node, own = who[more], (node - step)[more], own[more]
        # The pieces came from back to front.
        ends = np.cumsum(taken)
        got_word = np.repeat(np.arange(len(flat)), taken)
        got_id, got_char = np.empty(len(got_word), np.int64), np.empty(len(got_word), np.int64)
        for turn, who, i, c in got:
            at = ends[who] - 1 - turn
            got_id[at], got_char[at] = i, c
        if (got_id < 0).any():  # characters as bytes
            raw = [self.byte[np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), np.uint8)] for c in got_char[got_id < 0].tolist()]
            wide = np.ones(len(got_id), np.int64)
            wide[got_id < 0] = [len(x) for x in raw]
            flat = np.repeat(got_id, wide)
            flat[np.repeat(got_id < 0, wide)] = np.concatenate(raw)
            got_word, got_id = np.repeat(got_word, wide), flat
        if len(one_by_one):
            ids_of = []
            for same in np.split(one_by_one, np.flatnonzero(np.diff(last[one_by_one])) + 1):
                ids_of += self.sample_long(flat[same[0]], key[same])
            got_word = np.concatenate([got_word, np.repeat(one_by_one, [len(x) for x in ids_of])])
            order = np.argsort(got_word, kind="stable")
            got_word, got_id = got_word[order], np.concatenate([got_id, *ids_of])[order]
        ends = np.searchsorted(doc[got_word], np.arange(len(split) + 1))
        return [got_id[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.text.__getitem__, ids.tolist())).decode("utf-8")


def sample_segmentations(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """(id, ids, text): for each row a sampled segmentation as binary uint32 ids, and the text decoded from them.

    The sample depends on the row's id, its text and the seed, not on partitions or neighbours: a task that is run again
    gives the same, and so do rows that repeat. Null texts count as empty (no pieces), a null id as -1. No row is
    shuffled; columns other than the two are ignored, whatever their names.
    """

    def run(batches):
        lattice = Lattice.of(vocabulary(vocab))
        for batch in chunks(batches, "__text", TOGETHER):
            who = batch.column(0).to_pylist()
            got = lattice.sample(texts(batch, "__text"), [-1 if i is None else i for i in who], seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype("<u4").tobytes() for x in got], pa.binary()), pa.array([lattice.decode(x) for x in got], pa.string())], schema=schema_of("id long, ids binary, text string"))

    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(run, "id long, ids binary, text string").withColumnRenamed("id", id_col)


def segmentation_report(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """Per row: id, n_pieces, ids_crc32 and the sha256 of the decoded text."""
    ddl = "id long, n_pieces long, ids_crc32 long, decoded_sha256 string"

    def run(batches):
        import hashlib

        lattice = Lattice.of(vocabulary(vocab))
        for batch in chunks(batches, "__text", TOGETHER):
            who = batch.column(0).to_pylist()
            got = lattice.sample(texts(batch, "__text"), [-1 if i is None else i for i in who], seed)
            rows = [(len(x), zlib.crc32(x.astype("<u4").tobytes()), hashlib.sha256(lattice.decode(x).encode("utf-8")).hexdigest()) for x in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema_of(ddl).types[1:], strict=True)]], schema=schema_of(ddl))

    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(run, ddl).withColumnRenamed("id", id_col)
