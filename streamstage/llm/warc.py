"""WARC records in ZIP-packaged archives: members are stored, so that a record is read by its byte range alone.

An archive holds pairs of members, ``data/NNNNN.warc.gz`` (one gzip member per record) and ``index/NNNNN.cdx`` (a line
per record: id, offset, length, type). Both are stored, not deflated. Sizes and offsets stand in ZIP64 fields, and the
directory ends with ZIP64 records, however small the archive is.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamstage.llm.common import chunks, cut, each_salt, filesystem, new_folder, salts_of, schema_of

#: Payloads of fewer bytes are never written as revisits.
REVISIT_BYTES = 1000
#: Bytes of records after which a member ends.
MEMBER_BYTES = 32 << 20
#: A fixed date, so that equal input gives equal archives.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_LOCAL = struct.Struct("<4s5H3L2H")
_CENTRAL = struct.Struct("<4s6H3L5H2L")
_END64 = struct.Struct("<4sQ2H2L4Q")
_LOCATOR64 = struct.Struct("<4sLQL")
_END = struct.Struct("<4s4H2LH")
_MAX = 0xFFFFFFFF


class Damaged(ValueError):
    """An archive that isn't what its directory or digests say."""


@dataclass
class Member:
    name: str
    size: int
    crc: int
    header: int  #: where the local header begins


def record(record_id: str, uri: str, kind: str, payload: bytes, digest: bytes, size: int, refers_to: str | None = None) -> bytes:
    """One gzipped WARC record. A revisit has no payload; its digest and length are those of the full payload."""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", "Content-Type: text/html; charset=utf-8",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", f"WARC-Payload-Length: {size}", f"Content-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress("\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + payload + b"\r\n\r\n") + made.flush()


def read_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one gzipped record."""
    plain = zlib.decompress(raw, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/1."):
        raise Damaged("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(headers["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise Damaged("a record's length is wrong")
    return headers, rest[:size]


class ArchiveWriter:
    """Writes a ZIP64 archive of stored members front to back to a file object."""

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        crc, raw = zlib.crc32(data), name.encode("utf-8")
        self.members.append(Member(name, len(data), crc, self.at))
        extra = struct.pack("<2H2Q", 1, 16, len(data), len(data))
        self._write(_LOCAL.pack(b"PK\3\4", 45, 0x800, 0, 0, 0x21, crc, _MAX, _MAX, len(raw), len(extra)) + raw + extra)
        self._write(data)

    def close(self) -> None:
        begin = self.at
        for m in self.members:
            raw, extra = m.name.encode("utf-8"), struct.pack("<2H3Q", 1, 24, m.size, m.size, m.header)
            self._write(_CENTRAL.pack(b"PK\1\2", 45, 45, 0x800, 0, 0, 0x21, m.crc, _MAX, _MAX, len(raw), len(extra), 0, 0, 0, 0, _MAX) + raw + extra)
        end, n = self.at, len(self.members)
        self._write(_END64.pack(b"PK\6\6", 44, 45, 45, 0, 0, n, n, end - begin, begin))
        self._write(_LOCATOR64.pack(b"PK\6\7", 0, end, 1))
        self._write(_END.pack(b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, _MAX, _MAX, 0))


class ArchiveReader:
    """Reads the directory (ZIP64 or not) of a seekable file and byte ranges of its stored members."""

    def __init__(self, file, size: int):
        self.file = file
        tail = self._range(max(0, size - 65_557), min(size, 65_557))
        at = tail.rfind(b"PK\5\6")
        if at < 0:
            raise Damaged("no end of a ZIP directory")
        _, _, _, _, n, length, begin, _ = _END.unpack_from(tail, at)
        locator = at - _LOCATOR64.size
        if locator >= 0 and tail[locator : locator + 4] == b"PK\6\7":
            place = _LOCATOR64.unpack_from(tail, locator)[2]
            signature, *_, n, length, begin = _END64.unpack(self._range(place, _END64.size))
            if signature != b"PK\6\6":
                raise Damaged("no ZIP64 directory where its locator says")
        self.members = {m.name: m for m in self._directory(self._range(begin, length), n)}

    def _range(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(size)
        if len(data) != size:
            raise Damaged("the archive is cut short")
        return data

    @staticmethod
    def _directory(raw: bytes, n: int) -> Iterator[Member]:
        at = 0
        for _ in range(n):
            signature, _, _, _, method, _, _, crc, packed, size, names, extras, notes, _, _, _, header = _CENTRAL.unpack_from(raw, at)
            if signature != b"PK\1\2":
                raise Damaged("an entry of the directory is broken")
            at += _CENTRAL.size
            name, extra = raw[at : at + names].decode("utf-8"), raw[at + names : at + names + extras]
            at += names + extras + notes
            while len(extra) >= 4:
                kind, length = struct.unpack_from("<2H", extra)
                if kind == 1:  # only the fields that are full in the entry follow, in this order
                    wide = iter(struct.unpack(f"<{length // 8}Q", extra[4 : 4 + length // 8 * 8]))
                    size = next(wide) if size == _MAX else size
                    packed = next(wide) if packed == _MAX else packed
                    header = next(wide) if header == _MAX else header
                extra = extra[4 + length :]
            if method == 0 and packed == size:
                yield Member(name, size, crc, header)

    def start(self, name: str) -> int:
        """Where a stored member's bytes begin."""
        at = self.members[name].header
        signature, *_, names, extras = _LOCAL.unpack(self._range(at, _LOCAL.size))
        if signature != b"PK\3\4":
            raise Damaged("no member where the directory says")
        return at + _LOCAL.size + names + extras

    def read(self, name: str, offset: int = 0, size: int | None = None) -> bytes:
        """A range of a stored member; the whole member is held against its CRC."""
        data = self._range(self.start(name) + offset, self.members[name].size if size is None else size)
        if size is None and zlib.crc32(data) != self.members[name].crc:
            raise Damaged(f"{name}: wrong CRC")
        return data


def record_types(pages: DataFrame, id_col: str, payload_col: str, salts: int = 64) -> DataFrame:
    """(id, __d, refers_to) of the records that revisit another: payloads (by their SHA-256 __d) of REVISIT_BYTES at least
    that a larger id has too.

    Only digests and ids are shuffled, the salted groups of a hot payload apart from each other.
    """
    rows = pages.select(F.col(id_col).alias("__id"), F.coalesce(F.col(payload_col), F.lit("")).alias("__p")).where(F.octet_length("__p") >= REVISIT_BYTES)
    rows = rows.select("__id", F.sha2("__p", 256).alias("__d"), F.pmod(F.xxhash64("__id"), F.lit(salts)).cast("int").alias("__salt"))
    salted = rows.groupBy("__d", "__salt").agg(F.max("__id").alias("__top"), F.count(F.lit(1)).alias("__n"))
    tops = salted.groupBy("__d").agg(F.max("__top").alias("refers_to"), salts_of("__salt").alias("__salts"), F.sum("__n").alias("__n")).where("__n > 1")
    found = cut(tops.select("__d", "refers_to", each_salt("__salts").alias("__salt")))
    return rows.join(found, ["__d", "__salt"]).where("__id < refers_to").select(F.col("__id").alias(id_col), "__d", "refers_to").distinct()


def write_archives(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", folder: str | None = None) -> DataFrame:
    """A WARC record per row, in one archive per task: returns (path, size, records), a row per archive.

    Null payloads count as empty, null URIs as ``urn:none``; a null id is written as such and never revisits; rows that
    repeat an id get a record each, and each is a response or revisit by its own payload. Payloads are equal if their
    SHA-256 is. A task that is run again writes the same bytes to a name of its own and renames it in one step. An empty
    table writes no archive; columns other than the three are ignored, whatever their names.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("__id"), F.col(uri_col).cast("string").alias("__uri"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("__p"))
    revisits = record_types(rows, "__id", "__p")
    joined = rows.withColumn("__d", F.when(F.octet_length("__p") >= REVISIT_BYTES, F.sha2("__p", 256))).join(revisits, ["__id", "__d"], "left")

    def write(batches):
        part = TaskContext.get().partitionId()
        fs, base = filesystem(folder)
        out = archive = None
        body, index, size, records, member = [], [], 0, 0, 0

        def flush():
            nonlocal size, member
            archive.add(f"data/{member:05d}.warc.gz", b"".join(body))
            archive.add(f"index/{member:05d}.cdx", "".join(index).encode("ascii"))
            body.clear()
            index.clear()
            size, member = 0, member + 1

        for batch in chunks(batches, "__p"):
            if out is None:
                fs.create_dir(base, recursive=True)
                temp = f"{base}/.part-{part:06d}-{TaskContext.get().taskAttemptId()}"
                out = fs.open_output_stream(temp)
                archive = ArchiveWriter(out)
            for i, uri, text, top in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                payload = text.encode("utf-8")
                again = top is not None and len(payload) >= REVISIT_BYTES
                kind = "revisit" if again else "response"
                clean = " ".join((uri or "urn:none").split())
                made = record(f"urn:page:{i}", clean, kind, b"" if again else payload, hashlib.sha1(payload).digest(), len(payload), f"urn:page:{top}" if again else None)
                index.append(f"{i} {size} {len(made)} {kind}\n")
                body.append(made)
                size += len(made)
                records += 1
                if size >= MEMBER_BYTES:
                    flush()
        if out is not None:
            if body:
                flush()
            archive.close()
            out.close()
            path = f"{base}/part-{part:06d}.zip"
            fs.move(temp, path)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (f"{folder}/part-{part:06d}.zip", archive.at, records)], schema=schema_of("path string, size long, records long"))

    return cut(joined.select("__id", "__uri", "__p", "refers_to").mapInArrow(write, "path string, size long, records long"))


def _page(urn: str) -> int | None:
    last = urn.strip("<>").rpartition(":")[2]
    return None if last == "None" else int(last)


def read_archives(archives: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Every record of the archives, found by directory and index and read by its range: id, payload_bytes,
    payload_digest (hex SHA-1), record_type, refers_to. A response's digest and length are those of the bytes read."""
    ddl = "id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def read(batches):
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, place = filesystem(path)
                with fs.open_input_file(place) as file:
                    archive = ArchiveReader(file, size)
                    for name in sorted(x for x in archive.members if x.startswith("index/")):
                        data = "data/" + name[len("index/") : -len("cdx")] + "warc.gz"
                        start, rows = archive.start(data), []
                        for line in archive.read(name).decode("ascii").splitlines():
                            i, offset, length, kind = line.split(" ")
                            headers, payload = read_record(archive._range(start + int(offset), int(length)))
                            told = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                            n, digest = (len(payload), hashlib.sha1(payload).hexdigest()) if kind == "response" else (int(headers["warc-payload-length"]), told)
                            if digest != told or headers["warc-type"] != kind:
                                raise Damaged(f"{path}: record {i} isn't what its header or the index says")
                            rows.append((_page(headers["warc-record-id"]), n, digest, kind, _page(headers["warc-refers-to"]) if kind == "revisit" else None))
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema_of(ddl).types, strict=True)], schema=schema_of(ddl))

    dealt = archives.select("path", "size").repartition(max(1, archives.rdd.getNumPartitions()))
    return dealt.mapInArrow(read, ddl).withColumnRenamed("id", id_col)
