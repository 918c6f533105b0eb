"""FLAC media columns: 8-bit mono streams, all frames of a batch coded and decoded side by side in numpy.

The decoder takes constant, verbatim, fixed and LPC subframes with partitioned Rice residuals of both kinds; it finds
frames by the stream's seek table, which the encoder writes with a point for each frame, or else by their headers. Header
CRC-8, frame CRC-16, frame numbers and the MD5 of the samples are verified.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamstage.llm.common import chunks, schema_of, texts

BLOCK = 576
#: Texts are padded with this byte to a positive multiple of UNIT.
PAD, UNIT = b" ", 192
LPC_ORDER, LPC_BITS = 4, 8
#: Bytes of samples that are coded side by side, and the frames with so many.
SIDE_BY_SIDE = 2 << 20
SLAB = SIDE_BY_SIDE // BLOCK
#: Most bytes of seek points in one metadata block.
SEEK_BYTES = 18 * 900_000
# Fixed values of the format: predictors by order, block size codes.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]
BLOCK_CODES = {1: 192, **{i: 144 << i for i in range(2, 6)}, **{i: 1 << i for i in range(8, 16)}}


class Damaged(ValueError):
    """A stream that isn't what its checksums say, or not in the format."""


def _table(poly: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        out = np.where(out >> (bits - 1) & 1, out << 1 ^ poly, out << 1) & ((1 << bits) - 1)
    return out


CRC8, CRC16 = _table(0x07, 8), _table(0x8005, 16)
_CRC8 = CRC8.tolist()
#: Leading zeros of each 16-bit number.
ZEROS = 16 - np.ceil(np.log2(np.arange(1 << 16) + 1)).astype(np.int64)
WINDOW = np.uint64((1 << 40) - 1)


def crc8(data: bytes) -> int:
    crc = 0
    for x in data:
        crc = _CRC8[crc ^ x]
    return crc


def crc16(frames: list[bytes]) -> np.ndarray:
    """Of each; leading zeros change nothing, so that all are put flush right in one table."""
    sizes = np.array([len(x) for x in frames])
    wide = int(sizes.max(initial=0))
    cells = np.zeros((len(frames), wide), np.uint8)
    cells[np.arange(wide) >= (wide - sizes)[:, None]] = np.frombuffer(b"".join(frames), np.uint8)
    cells, crc = np.ascontiguousarray(cells.T), np.zeros(len(frames), np.uint32)
    for row in cells:
        crc = (crc << 8 & 0xFFFF) ^ CRC16[crc >> 8 ^ row]
    return crc


def _number(n: int) -> bytes:
    """A frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    out: list[int] = []
    room = 6
    while n >= 1 << room:
        out.append(0x80 | n & 0x3F)
        n >>= 6
        room -= 1
    return bytes([(0xFF << (room + 1) & 0xFF) | n, *reversed(out)])


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1 ^ r >> 31).astype(np.uint32)


def _rice(u: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(bits, parameter) of the residuals after ``order`` first samples, per frame."""
    u = u[:, order:]
    mean = u.mean(axis=1)
    k = np.clip(np.floor(np.log2(np.maximum(mean, 1e-9))), 0, 13).astype(np.uint32)
    bits = [(u >> (k + d)[:, None]).sum(axis=1) + (k + d + 1) * u.shape[1] for d in (0, 1)]
    better = bits[1] < bits[0]
    return np.where(better, bits[1], bits[0]).astype(np.int64), k + better


def _lpc(x: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantized coefficients (frames, order) and shifts by Levinson-Durbin, all frames at once."""
    f = x.astype(np.float64)
    auto = np.stack([(f[:, : f.shape[1] - j] * f[:, j:]).sum(axis=1) for j in range(order + 1)], axis=1)
    auto[:, 0] += 1e-6 + auto[:, 0] * 1e-9
    a, err = np.zeros((len(x), order)), auto[:, 0].copy()
    for i in range(order):
        k = (auto[:, i + 1] - (a[:, :i] * auto[:, i:0:-1]).sum(axis=1)) / err
        a[:, :i], a[:, i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1], k
        err = np.maximum(err * (1 - k * k), 1e-9)
    most = np.abs(a).max(axis=1)
    shift = np.clip(LPC_BITS - 2 - np.ceil(np.log2(np.maximum(most, 1e-9))), 0, 14).astype(np.int32)
    edge = 1 << (LPC_BITS - 1)
    return np.clip(np.rint(a * (1 << shift)[:, None]), -edge, edge - 1).astype(np.int32), shift


def _predict_error(x: np.ndarray, coefs: np.ndarray, shift: np.ndarray) -> np.ndarray:
    order, n = coefs.shape[1], x.shape[1]
    out = x.copy()
    guess = sum(coefs[:, j : j + 1] * x[:, order - 1 - j : n - 1 - j] for j in range(order))
    out[:, order:] -= guess >> shift[:, None]
    return out


def _joined(codes: list[np.ndarray], widths: list[np.ndarray]) -> list[bytes]:
    """Each row's codes (value and width of each column's entry), one after another, padded to whole bytes."""
    value = np.column_stack(codes).astype(np.uint32)
    width = np.column_stack(widths).astype(np.uint8)
    size = width.sum(axis=1, dtype=np.int64)
    value, width = np.column_stack([value, np.zeros(len(size), np.uint32)]), np.column_stack([width, (-size % 8).astype(np.uint8)])
    room = 16 if width.max() <= 16 else 32
    cells = (value << (room - width)).astype(f">u{room // 8}").view(np.uint8)
    kept = np.arange(room, dtype=np.uint8) < width.reshape(-1, 1)
    packed = np.packbits(np.unpackbits(cells).reshape(-1, room)[kept]).tobytes()
    ends = np.cumsum(-(-size // 8)).tolist()
    return [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _subframes(x: np.ndarray) -> list[bytes]:
    """Each frame's subframe, padded to whole bytes. ``x``: int32 (frames, samples)."""
    frames, n = x.shape
    coefs, shift = _lpc(x, LPC_ORDER)
    zero = np.zeros(frames, np.int32)
    choices = [  # (kind, order, residuals, extra bits)
        (8, 0, _zigzag(x), 0),
        (9, 1, _zigzag(_predict_error(x, np.ones((frames, 1), np.int32), zero)), 0),
        (32 + LPC_ORDER - 1, LPC_ORDER, _zigzag(_predict_error(x, coefs, shift)), 9 + LPC_ORDER * LPC_BITS),
    ]
    cost, k, ok = [], [], []
    for _, order, u, extra in choices:
        bits, param = _rice(u, order)
        cost.append(bits + 8 + 10 + 8 * order + extra)
        k.append(param)
        ok.append((u[:, order:].max(axis=1) >> param) + 1 + param <= 32)
    total = np.where(np.stack(ok), np.stack(cost), 1 << 40)
    pick = total.argmin(axis=0)
    pick = np.where((x == x[:, :1]).all(axis=1), -1, np.where(total.min(axis=0) >= 8 + 8 * n, -2, pick))
    out: list[bytes] = [b""] * frames

    def put(own: np.ndarray, columns: list[tuple[np.ndarray | int, np.ndarray | int]]) -> None:
        """columns: (values, widths), each a number, a column or a table for the frames ``own``."""
        spread = lambda c, like: np.broadcast_to(np.asarray(c).reshape(len(own) if np.ndim(c) else 1, -1), (len(own), like))
        wide = [max(np.shape(c)[1] if np.ndim(c) == 2 else 1 for c in pair) for pair in columns]
        made = _joined([spread(v, n) for (v, _), n in zip(columns, wide, strict=True)], [spread(w, n) for (_, w), n in zip(columns, wide, strict=True)])
        for i, one in zip(own.tolist(), made, strict=True):
            out[i] = one

    if len(own := np.flatnonzero(pick == -1)):
        put(own, [(0, 8), (x[own, :1] & 0xFF, 8)])
    if len(own := np.flatnonzero(pick == -2)):
        put(own, [(2, 8), (x[own] & 0xFF, 8)])
    for c, (kind, order, u, _) in enumerate(choices):
        high = (u[:, order:].max(axis=1) >> k[c]) + 1 + k[c] > 16  # few frames need wide codes
        for own in (np.flatnonzero((pick == c) & high), np.flatnonzero((pick == c) & ~high)):
            if not len(own):
                continue
            columns: list = [(kind << 1, 8)] + ([(x[own, :order] & 0xFF, 8)] if order else [])
            if kind >= 32:
                columns += [(LPC_BITS - 1, 4), (shift[own], 5), (coefs[own] & ((1 << LPC_BITS) - 1), LPC_BITS)]
            own_k = k[c][own][:, None].astype(np.uint32)
            v = u[own, order:]
            columns += [(0, 6), (own_k, 4), (np.uint32(1) << own_k | v & ((np.uint32(1) << own_k) - np.uint32(1)), (v >> own_k) + 1 + own_k)]
            put(own, columns)
    return out


def _frames(payloads: list[bytes], cuts: list[tuple[int, int, int]]) -> list[bytes]:
    """The frames of cuts (payload, first sample, samples)."""
    bodies: list[bytes] = [b""] * len(cuts)
    for n in {c[2] for c in cuts}:
        own = [j for j, c in enumerate(cuts) if c[2] == n]
        x = np.frombuffer(b"".join(payloads[cuts[j][0]][cuts[j][1] : cuts[j][1] + n] for j in own), np.uint8).reshape(-1, n).astype(np.int32) - 128
        for j, body in zip(own, _subframes(x), strict=True):
            bodies[j] = body
    codes = {v: k for k, v in BLOCK_CODES.items()}
    frames = []
    for (_, at, n), body in zip(cuts, bodies, strict=True):
        head = bytes([0xFF, 0xF8, codes.get(n, 7) << 4 | 4, 0 << 4 | 1 << 1]) + _number(at // BLOCK) + (b"" if n in codes else struct.pack(">H", n - 1))
        frames.append(head + bytes([crc8(head)]) + body)
    return [f + struct.pack(">H", c) for f, c in zip(frames, crc16(frames).tolist(), strict=True)]


def encode_flac(payloads: list[bytes], rate: int = 8000) -> list[bytes]:
    """A FLAC stream for each payload of at least one byte; byte b is the sample b - 128. At most SLAB frames are coded
    at a time, so that memory beside payloads and streams is bounded. Seek points beyond SEEK_BYTES (payloads of over
    half a GB) go on in further seek tables, which only this reader joins."""
    cuts = ((i, at, min(BLOCK, len(p) - at)) for i, p in enumerate(payloads) for at in range(0, len(p), BLOCK))
    bodies, seek, least, most = ([bytearray() for _ in payloads], [bytearray() for _ in payloads], [1 << 24] * len(payloads), [0] * len(payloads))
    while slab := list(islice(cuts, SLAB)):
        for (i, at, n), f in zip(slab, _frames(payloads, slab), strict=True):
            seek[i] += struct.pack(">QQH", at, len(bodies[i]), n)
            bodies[i] += f
            least[i], most[i] = min(least[i], len(f)), max(most[i], len(f))
    out = []
    for i, p in enumerate(payloads):
        info = struct.pack(">HH", BLOCK, BLOCK) + least[i].to_bytes(3, "big") + most[i].to_bytes(3, "big") + (rate << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + _md5(p).digest()
        head, table = b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info, b""
        for at in range(0, len(seek[i]), SEEK_BYTES):  # a block's length has 24 bits
            part = bytes(seek[i][at : at + SEEK_BYTES])
            table += bytes([0x83 if at + SEEK_BYTES >= len(seek[i]) else 0x03]) + len(part).to_bytes(3, "big") + part
        out.append(b"".join((head, table, bodies[i])))
        bodies[i] = seek[i] = bytearray()
    return out


def _md5(pcm: bytes, so_far=None):
    """The MD5 of signed samples, carried on from ``so_far``."""
    so_far = so_far or hashlib.md5()
    for at in range(0, len(pcm), SIDE_BY_SIDE):
        so_far.update((np.frombuffer(pcm[at : at + SIDE_BY_SIDE], np.uint8) - np.uint8(128)).tobytes())
    return so_far


def _index(stream: bytes) -> tuple[int, bytes, list[tuple[int, int, int, int]]]:
    """(samples, md5, [(first sample, samples, begin, end)] of the frames) by the metadata."""
    if stream[:4] != b"fLaC":
        raise Damaged("not a FLAC stream")
    at, last, info, points = 4, False, b"", b""
    while not last:
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        info, points = body if kind == 0 else info, points + body if kind == 3 else points
        at += 4 + size
    told = int.from_bytes(info[10:18], "big")
    if told >> 36 & 0x1F != 7 or told >> 41 & 7:
        raise Damaged("not 8-bit mono")
    total = told & (1 << 36) - 1
    seek = [x for x in struct.iter_unpack(">QQH", points) if x[0] != (1 << 64) - 1]
    if sum(x[2] for x in seek) != total:  # a point for some frames only, or none, as other writers have it
        return total, info[18:34], _found(stream, at, total)
    ends = [x[1] for x in seek[1:]] + [len(stream) - at]
    return total, info[18:34], [(first, n, at + begin, at + end) for (first, begin, n), end in zip(seek, ends, strict=True)]


def _found(stream: bytes, at: int, total: int) -> list[tuple[int, int, int, int]]:
    """The frames from ``at`` on without a seek table: a frame ends where the next header, of the next number and with a
    right CRC-8, begins and the CRC-16 so far is right."""
    out, first, begin = [], 0, at
    while first < total:
        size, number, _ = _head(stream[begin : begin + 32])
        if number != len(out):
            raise Damaged("a frame stands where another should")
        end = len(stream) if first + size >= total else stream.find(b"\xff\xf8", begin + 2)
        while end >= 0 and (crc16([stream[begin:end]])[0] or end < len(stream) and not _starts(stream[end : end + 32], len(out) + 1)):
            end = stream.find(b"\xff\xf8", end + 1) if end < len(stream) else -1
        if end < 0:
            raise Damaged("a frame's CRC-16 is wrong")
        out.append((first, size, begin, end))
        first, begin = first + size, end
    return out


def _starts(head: bytes, number: int) -> bool:
    try:
        return _head(head)[1] == number
    except (Damaged, IndexError, KeyError):
        return False


def _head(frame: bytes) -> tuple[int, int, int]:
    """(block size, frame number, header bytes) of a frame, its CRC-8 verified."""
    if len(frame) < 9 or frame[0] != 0xFF or frame[1] != 0xF8:
        raise Damaged("no frame where the seek table says")
    more = 0
    while more < 7 and frame[4] << more & 0x80:
        more += 1
    more = max(more, 1)
    number = frame[4] & (0x7F >> more if more > 1 else 0x7F)
    for x in frame[5 : 4 + more]:
        number = number << 6 | x & 0x3F
    at, code = 4 + more, frame[2] >> 4
    if code in (6, 7):
        size = int.from_bytes(frame[at : at + code - 5], "big") + 1
        at += code - 5
    else:
        size = BLOCK_CODES[code]
    at += {12: 1, 13: 2, 14: 2}.get(frame[2] & 15, 0)
    if crc8(frame[:at]) != frame[at]:
        raise Damaged("a frame header's CRC-8 is wrong")
    return size, number, at + 1


def _decode(frames: list[bytes], skip: list[int], n: int) -> np.ndarray:
    """Samples (frames, n) of frames of one block size; ``skip``: bytes of each header."""
    count = len(frames)
    raw = np.frombuffer(b"".join(frames) + b"\0" * 8, np.uint8)
    sizes = np.array([len(f) for f in frames], np.int64)
    at = (np.cumsum(sizes) - sizes + np.array(skip)) * 8
    words = np.zeros(len(raw), np.uint64)
    for i in range(5):
        words[: len(raw) - i] |= raw[i:].astype(np.uint64) << np.uint64(32 - 8 * i)
    def bits(at, width):
        """``width`` (an array or number, 32 at most) bits from ``at``."""
        width = np.asarray(width, np.uint64)
        got = words[at >> 3] << (at & 7).astype(np.uint64) & WINDOW
        return (got >> (np.uint64(40) - width)).astype(np.int64)

    def signed(value, width):
        return value - ((value >> (np.maximum(width, 1) - 1) & 1) << width)

    kind = bits(at, 8)
    if (kind & 0x81).any():
        raise Damaged("wasted bits or a reserved bit in a subframe")
    kind, at = kind >> 1, at + 8
    x = np.zeros((count, n), np.int64)
    constant, verbatim = kind == 0, kind == 1
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | verbatim | fixed | lpc).all():
        raise Damaged("a reserved kind of subframe")
    x[constant] = signed(bits(at[constant], 8), 8)[:, None]
    x[verbatim] = signed(bits(at[verbatim, None] + 8 * np.arange(n), 8), 8)
    own = np.flatnonzero(fixed | lpc)
    if not len(own):
        return x
    at, kind, lpc = at[own], kind[own], lpc[own]
    order = np.where(lpc, kind - 31, kind - 8)
    most = max(int(order.max()), 1)
    y = np.zeros((most + n, len(own)), np.int64)  # samples before the first count as 0
    for i in range(int(order.max())):
        has = order > i
        y[most + i, has] = signed(bits(at[has], 8), 8)
        at = at + 8 * has
    coefs, shift = np.zeros((most, len(own)), np.int64), np.zeros(len(own), np.int64)
    for o in range(1, min(most, 4) + 1):
        coefs[:o, ~lpc & (order == o)] = np.array(FIXED[o])[:, None]
    width = np.where(lpc, bits(at, 4) + 1, 0)
    shift[lpc] = signed(bits(at[lpc] + 4, 5), 5)
    at = at + 9 * lpc
    for i in range(most):
        has = lpc & (order > i)
        coefs[i, has] = signed(bits(at[has], width[has]), width[has])
        at = at + np.where(has, width, 0)
    method, parts = bits(at, 2), 1 << bits(at + 2, 4)
    wide = np.where(method == 0, 4, 5)
    at = at + 6
    k, plain = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
    length = n // parts
    escaped = False
    every = bool((parts == 1).all())
    begin = order
    for i in range(int(order.min()), n):
        new = (begin == i) if every else (i >= order) & ((i == order) | (i % length == 0))
        if (i <= order.max() or not every) and new.any():
            k = np.where(new, bits(at, wide), k)
            at = at + np.where(new, wide, 0)
            esc = new & (k == (1 << wide) - 1)
            plain = np.where(new, np.where(esc, bits(at, 5), 0), plain)
            at = at + 5 * esc
            escaped = bool((k == (1 << wide) - 1).any())
        live = i >= order
        window = words[at >> 3] << (at & 7).astype(np.uint64) & WINDOW
        q = ZEROS[window >> np.uint64(24)]
        short = q < 16
        if short.all():
            low = (window >> (39 - q - k).astype(np.uint64)).astype(np.int64) & (1 << k) - 1
        else:
            q = q.copy()
            while not short.all():
                more = np.flatnonzero(~short)
                step = ZEROS[bits(at[more] + q[more], 16)]
                q[more] += step
                short[more] = (step < 16) | (at[more] + q[more] >= 8 * len(raw) - 64)
            low = bits(at + q + 1, k)
        u = q << k | low
        r = u >> 1 ^ -(u & 1)
        after = at + q + 1 + k
        if escaped:
            esc = k == (1 << wide) - 1
            r, after = np.where(esc, signed(bits(at, plain), plain), r), np.where(esc, at + plain, after)
        guess = (coefs * y[i + most - 1 : i - 1 if i else None : -1][:most]).sum(axis=0) >> shift
        if i >= order.max():
            y[most + i], at = r + guess, after
        else:
            y[most + i], at = np.where(live, r + guess, y[most + i]), np.where(live, after, at)
    x[own] = y[most:].T
    return x


def read_blocks(streams: list[bytes], ranges: list[tuple[int, int]] | None = None) -> Iterator[tuple[int, int, bytes]]:
    """(stream, offset of the first sample, PCM): blocks of each stream in order, found by the seek table; with ``ranges``
    (first sample, samples), only these samples, from the frames that hold them. At most SLAB frames are decoded at a
    time, a stream's next to each other as one block.

    Each frame must have both its CRCs right and the number that its place in the stream asks for; a stream read whole,
    the MD5 of its samples.
    """

    told: dict[int, tuple[int, bytes]] = {}

    def jobs():
        for i, s in enumerate(streams):
            total, md5, index = _index(s)
            told[i] = total, md5
            first, n = ranges[i] if ranges else (0, total)
            for k, (x_first, x_n, begin, end) in enumerate(index):
                if x_first < first + n and x_first + x_n > first:
                    yield i, k, x_first, x_n, s[begin:end], max(first - x_first, 0), min(first + n - x_first, x_n)

    sums: dict = {}
    todo = jobs()
    while slab := list(islice(todo, SLAB)):
        frames = [j[4] for j in slab]
        if any(crc16(frames).tolist()):
            raise Damaged("a frame's CRC-16 is wrong")
        heads = [_head(f) for f in frames]
        if any(h[1] != j[1] for h, j in zip(heads, slab, strict=True)):
            raise Damaged("a frame stands where another should")
        if any(h[0] != j[3] for h, j in zip(heads, slab, strict=True)):
            raise Damaged("the seek table and a frame disagree")
        pcm: list[bytes] = [b""] * len(slab)
        for size in {h[0] for h in heads}:
            own = [j for j, h in enumerate(heads) if h[0] == size]
            x = _decode([frames[j] for j in own], [heads[j][2] for j in own], size)
            for j, row in zip(own, (x + 128).astype(np.uint8), strict=True):
                pcm[j] = row.tobytes()[slab[j][5] : slab[j][6]]
        for i, group in groupby(range(len(slab)), lambda j: slab[j][0]):
            own = list(group)
            block = b"".join(pcm[j] for j in own)
            if not ranges:
                sums[i] = _md5(block, sums.get(i))
                if slab[own[-1]][2] + slab[own[-1]][3] == told[i][0] and sums.pop(i).digest() != told[i][1]:
                    raise Damaged("the samples' MD5 is wrong")
            yield i, slab[own[0]][2] + slab[own[0]][5], block


def decode_flac(streams: list[bytes], ranges: list[tuple[int, int]] | None = None) -> list[bytes]:
    """Each stream's payload; with ``ranges`` (first sample, samples), only these samples, see read_blocks."""
    out: list[list[bytes]] = [[] for _ in streams]
    for i, _, block in read_blocks(streams, ranges):
        out[i].append(block)
    return [b"".join(x) for x in out]


def payload_of(text: str) -> bytes:
    return padded(text.encode("utf-8"))


def padded(raw: bytes) -> bytes:
    return raw + PAD * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


class Reading:
    """What is told of a payload, from its PCM blocks one after another: digests, last bytes, energy, zero crossings, peak."""

    def __init__(self):
        self.size, self.sha, self.tail, self.energy, self.crossings, self.peak, self.last = 0, hashlib.sha256(), b"", 0, 0, 0, None

    def add(self, offset: int, pcm: bytes) -> None:
        if offset != self.size:
            raise Damaged("blocks out of order")
        self.size += len(pcm)
        self.sha.update(pcm)
        self.tail = (self.tail + pcm[-16:])[-16:]
        for at in range(0, len(pcm), SIDE_BY_SIDE):
            x = np.frombuffer(pcm[at : at + SIDE_BY_SIDE], np.uint8).astype(np.int32) - 128
            sign = x < 0
            self.energy += int((x * x).sum(dtype=np.int64))
            self.crossings += int((sign[1:] != sign[:-1]).sum()) + int(self.last is not None and self.last != bool(sign[0]))
            self.peak = max(self.peak, int(np.abs(x).max()))
            self.last = bool(sign[-1])

    def feature(self) -> str:
        """energy:zero crossings:peak of the samples."""
        return f"{self.energy}:{self.crossings}:{self.peak}"


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every text's payload as a FLAC stream. Null texts count as empty; rows that repeat give a row
    each; columns other than the two are ignored, whatever their names."""

    def encode(batches):
        for batch in chunks(batches, "__text", SIDE_BY_SIDE):
            raw = [x.encode("utf-8") for x in texts(batch, "__text")]
            n = [len(x) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(encode_flac([padded(x) for x in raw]), pa.binary())], schema=schema_of("id long, n_bytes long, media binary"))

    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(encode, "id long, n_bytes long, media binary").withColumnRenamed("id", id_col)


def _read(batches: Iterator[pa.RecordBatch]):
    """(batch, streams, their blocks) of batches with a column media."""
    for batch in chunks(batches, "media", SIDE_BY_SIDE):
        media = batch.column(batch.schema.get_field_index("media")).to_pylist()
        yield batch, media, read_blocks(media)


def media_report(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads the streams back block by block: sizes, digests and features of payload and stored form."""
    ddl = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def read(batches):
        for batch, stored, blocks in _read(batches):
            got = [Reading() for _ in stored]
            for i, offset, pcm in blocks:
                got[i].add(offset, pcm)
            rows = [(r.size, r.sha.hexdigest(), zlib.crc32(r.tail), len(m), hashlib.sha256(m).hexdigest(), r.feature()) for m, r in zip(stored, got, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema_of(ddl).types[2:], strict=True)]], schema=schema_of(ddl))

    return media.select(F.col(id_col).alias("id"), "n_bytes", "media").mapInArrow(read, ddl).withColumnRenamed("id", id_col)


def pcm_blocks(media: DataFrame, samples: int = 4096, id_col: str = "doc_id") -> DataFrame:
    """(id, block, sample_offset, n_samples, pcm): the decoded samples (unsigned 8-bit) in blocks, any of which can be found by its offset."""
    ddl = "id long, block long, sample_offset long, n_samples long, pcm binary"

    def read(batches):
        for batch, _, blocks in _read(batches):
            ids = batch.column(0).to_pylist()
            rows = []
            for i, parts in groupby(blocks, lambda x: x[0]):
                held, begin, last = b"", 0, False
                for _, _, pcm in chain(parts, [(i, 0, None)]):
                    last, held = pcm is None, held + (pcm or b"")
                    whole = len(held) if last else len(held) // samples * samples
                    for at in range(0, whole, samples):
                        cut = held[at : min(at + samples, whole)]
                        rows.append((ids[i], (begin + at) // samples, begin + at, len(cut), cut))
                        if len(rows) * samples >= SIDE_BY_SIDE:
                            yield _table_of(rows, ddl)
                            rows = []
                    held, begin = held[whole:], begin + whole
            if rows:
                yield _table_of(rows, ddl)

    return media.select(F.col(id_col).alias("id"), "media").mapInArrow(read, ddl).withColumnRenamed("id", id_col)


def _table_of(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema_of(ddl).types, strict=True)], schema=schema_of(ddl))
