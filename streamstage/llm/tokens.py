"""Token ids of whole texts, and their binary files.

File format (all integers little-endian). A file holds blocks; each block holds the ids of whole documents:

    magic "SVB1", uint32 number of documents, uint32 number of distinct ids, uint64 number of ids, uint64 data bytes
    int64 document ids; uint32 ids per document
    uint32 table: the block's distinct ids, most frequent first (equally frequent ones by id)
    control bytes: two bits per id, four ids a byte, lowest bits first: bytes of the id's rank, less one
    data bytes: the ranks, each in as few bytes as it needs
    uint32 crc32 of all that follows the magic

Control bytes stand apart from data, so that a reader finds all lengths by table lookup and all positions by a
cumulative sum, without a branch per id.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamstage.llm.common import chunks, cut, filesystem, new_folder, schema_of, texts

MAGIC = b"SVB1"
_HEAD = struct.Struct("<IIQQ")
#: Ids after which a block ends (at a document's end).
BLOCK_IDS = 4 << 20
#: Words of which an encoder remembers the ids; then it starts anew.
REMEMBERED = 500_000

_SPACES = str.maketrans("\t\n\r", "   ")
_encoders: dict[str, "Encoder"] = {}

# The normalizer and pre-tokenizer for which the short way below holds.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts of these characters only are already NFC, and lower-case letter by letter.
_NOT_PLAIN = re.compile("[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]")
#: The pre-tokenizer's pieces of a lower-cased plain text.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\t-\r a-z\u00df-\u00f6\u00f8-\u00ff0-9]+")


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next one from U+0100."""
    printable = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


class _Pieces(dict):
    """piece -> its ids, asked of the tokenizer's model once."""

    def __init__(self, model):
        self.model, self.characters = model, byte_characters()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        raw = piece.encode("utf-8").decode("latin-1").translate(self.characters)
        found = self[piece] = struct.pack(f"<{len(t := self.model.tokenize(raw))}I", *[x.id for x in t])
        return found


class Encoder:
    """Ids of texts by a tokenizer file of which the pre-tokenizer drops white space, so that ids of space-separated
    parts, strung together, are the ids of the text. Parts are looked up once each and remembered. Texts of ASCII and
    Latin-1 letters are cut into the pre-tokenizer's own pieces here and only the pieces go to the tokenizer's model."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        a, b, both = (self.tokenizer.encode(x, add_special_tokens=False).ids for x in ("one", "two", "one \n two"))
        if a + b != both:
            raise ValueError(f"{path}: ids of parts differ from ids of the whole")
        told = json.loads(self.tokenizer.to_str())
        steps = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.special = [x["content"] for x in told.get("added_tokens", [])]
        plain = told.get("normalizer") == _NORMALIZER and len(steps) == 2 and steps[0].get("pattern") == {"Regex": _SPLIT} and steps[1].get("type") == "ByteLevel"
        self.pieces = _Pieces(self.tokenizer.model) if plain else None

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One encoder per worker process and file."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def encode(self, text_list: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian uint32."""
        for text in text_list:
            if self.pieces is not None and not _NOT_PLAIN.search(text) and not any(x in text for x in self.special):
                yield b"".join(map(self.pieces.__getitem__, _PIECES.findall(text.lower())))
            else:
                yield self._by_parts(text)

    def _by_parts(self, text: str) -> bytes:
        parts, known = text.translate(_SPACES).split(" "), self.known
        if new := {w for w in parts if w not in known}:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = set(parts)
            new = list(new)
            for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, "<u4").tobytes()
        return b"".join([known[w] for w in parts])


def vocabulary(path: str) -> str:
    """The tokenizer's place on this machine: a path, or the name of a file of the installed vocabularies."""
    if "/" in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


def pack_block(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A block of the file format from ids (uint32) of whole documents."""
    n = np.bincount(ids)
    table = np.flatnonzero(n)
    order = np.lexsort((table, -n[table]))
    rank_of = np.zeros(len(n), np.uint32)
    rank_of[table[order]] = np.arange(len(table), dtype=np.uint32)
    ranks = rank_of[ids]
    sizes = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    control = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
    control[: len(ids)] = sizes - 1
    control = control.reshape(-1, 4)
    control = control[:, 0] | control[:, 1] << 2 | control[:, 2] << 4 | control[:, 3] << 6
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = raw[np.arange(4, dtype=np.uint8) < sizes[:, None]]
    body = b"".join([_HEAD.pack(len(doc_ids), len(table), len(ids), len(data)), doc_ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), table[order].astype("<u4").tobytes(), control.tobytes(), data.tobytes()])
    return MAGIC + body + struct.pack("<I", zlib.crc32(body))


#: For each control byte, the bytes of its four ranks.
_SIZES = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
_MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def read_blocks(file) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document ids, ids per document, ids) of each block of an open file."""
    while magic := file.read(4):
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        head = file.read(_HEAD.size)
        n_docs, n_table, n_ids, n_data = _HEAD.unpack(head)
        n_control = -(-n_ids // 4)
        rest = file.read(12 * n_docs + 4 * n_table + n_control + n_data)
        if struct.unpack("<I", file.read(4))[0] != zlib.crc32(rest, zlib.crc32(head)):
            raise ValueError("a block of token ids is damaged")
        at = [8 * n_docs, 12 * n_docs, 12 * n_docs + 4 * n_table, 12 * n_docs + 4 * n_table + n_control]
        table = np.frombuffer(rest[at[1] : at[2]], "<u4")
        sizes = _SIZES[np.frombuffer(rest[at[2] : at[3]], np.uint8)].reshape(-1)[:n_ids]
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        data = np.frombuffer(rest[at[3] :] + b"\0\0\0", np.uint8)
        words = np.lib.stride_tricks.sliding_window_view(data, 4)[starts] if n_ids else np.zeros((0, 4), np.uint8)
        ranks = np.ascontiguousarray(words).view("<u4").reshape(-1) & _MASKS[sizes - 1]
        yield np.frombuffer(rest[: at[0]], "<i8"), np.frombuffer(rest[at[0] : at[1]], "<u4"), table[ranks]


def write_token_files(docs: DataFrame, vocab: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Encode every text, append ``end_id``, and write the ids to files in ascending order of ``id_col``.

    Returns (path, part, n_ids, n_docs), a row per file, in ``part``'s order; an empty table writes no file. Texts are
    dealt by ranges of ids, so files follow each other. A task that is run again writes the same bytes to a name of its
    own and renames the file in one step. Null texts count as empty, a null id sorts first and is written as -2^63;
    rows that repeat an id stand side by side, shorter texts first. Columns other than the two are ignored, whatever their
    names.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")

    def write(batches):
        part = TaskContext.get().partitionId()
        encoder, fs, base = Encoder.of(vocabulary(vocab)), *filesystem(folder)
        end = np.array([] if end_id is None else [end_id], "<u4").tobytes()
        path, n_ids, n_docs, out = f"{base}/part-{part:06d}.svb", 0, 0, None
        ids, held, size = [], [], 0

        def flush():
            flat = np.frombuffer(b"".join(held), "<u4")
            out.write(pack_block(np.array(ids, np.int64), np.array([len(x) // 4 for x in held], np.uint32), flat))
            ids.clear()
            held.clear()

        for batch in chunks(batches, "__text"):
            if out is None:
                fs.create_dir(base, recursive=True)
                temp = f"{base}/.part-{part:06d}-{TaskContext.get().taskAttemptId()}"
                out = fs.open_output_stream(temp)
            for i, x in zip(batch.column(0).to_pylist(), encoder.encode(texts(batch, "__text")), strict=True):
                ids.append(-(1 << 63) if i is None else i)
                held.append(x + end)
                size += len(held[-1]) // 4
                n_ids += len(held[-1]) // 4
                n_docs += 1
                if size >= BLOCK_IDS:
                    flush()
                    size = 0
        if out is not None:
            if held:
                flush()
            out.close()
            fs.move(temp, path)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (f"{folder}/part-{part:06d}.svb", part, n_ids, n_docs)], schema=schema_of("path string, part long, n_ids long, n_docs long"))

    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    dealt = rows.repartitionByRange("__id").sortWithinPartitions("__id", F.length(F.coalesce("__text", F.lit(""))), "__text")
    return cut(dealt.mapInArrow(write, "path string, part long, n_ids long, n_docs long"))


def read_token_files(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """From the files: each document's id, start (ids before it in all files), n_tokens and the crc32 of its ids."""
    from pyspark.sql import Window

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, place = filesystem(path)
                with fs.open_input_stream(place) as file:
                    for doc_ids, counts, ids in read_blocks(file):
                        ends = np.cumsum(counts, dtype=np.int64)
                        raw = memoryview(ids.astype("<u4").tobytes())
                        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                        who = pa.array([None if x == -(1 << 63) else x for x in doc_ids.tolist()], pa.int64())
                        yield pa.RecordBatch.from_arrays([who, pa.array(start + ends - counts), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        start += int(ends[-1]) if len(ends) else 0

    # A row per file, not per document: one task orders them.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    dealt = placed.repartition(max(1, files.rdd.getNumPartitions()))
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("doc_id", id_col)
