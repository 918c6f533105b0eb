"""BLAKE3 (default hash, 32 bytes of output), after its published specification, of many messages side by side.

The state is 16 numpy arrays of 32-bit words, with a lane for each chunk that is compressed at the time. Chunks go block by
block, then all messages' trees level by level.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the specification.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
CHUNK, BLOCK = 1024, 64
#: Bytes of messages that are hashed side by side.
SIDE_BY_SIDE = 4 << 20


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x >> np.uint32(by) | x << np.uint32(32 - by)


def _mix(a, b, c, d, x, y):
    """The mixing step on four lanes of columns (or diagonals) at once."""
    a = a + b + x
    d = _turned(d ^ a, 16)
    c = c + d
    b = _turned(b ^ c, 12)
    a = a + b + y
    d = _turned(d ^ a, 8)
    c = c + d
    return a, _turned(b ^ c, 7), c, d


def _compressed(chain: np.ndarray, words: np.ndarray, counter: np.ndarray, size: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """New chaining values (8, lanes) of ``chain`` (8, lanes) with message blocks ``words`` (16, lanes)."""
    lanes = chain.shape[1]
    a, b = chain[:4], chain[4:]
    c = np.broadcast_to(np.array(IV[:4], np.uint32)[:, None], (4, lanes))
    d = np.stack([(counter & 0xFFFFFFFF).astype(np.uint32), (counter >> 32).astype(np.uint32), size.astype(np.uint32), flags.astype(np.uint32)])
    order = np.arange(16)
    for _ in range(7):
        m = words[order]
        a, b, c, d = _mix(a, b, c, d, m[0:8:2], m[1:8:2])
        b, c, d = b[[1, 2, 3, 0]], c[[2, 3, 0, 1]], d[[3, 0, 1, 2]]  # diagonals as columns
        a, b, c, d = _mix(a, b, c, d, m[8::2], m[9::2])
        b, c, d = b[[3, 0, 1, 2]], c[[2, 3, 0, 1]], d[[1, 2, 3, 0]]
        order = order[list(PERMUTATION)]
    return np.concatenate([a ^ c, b ^ d])


def _hashed(messages: list[bytes]) -> list[str]:
    sizes = np.array([len(x) for x in messages], np.int64)
    chunks = np.maximum(-(-sizes // CHUNK), 1)
    owner = np.repeat(np.arange(len(messages)), chunks)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    left = np.minimum(sizes[owner] - number * CHUNK, CHUNK)
    blocks = np.maximum(-(-left // BLOCK), 1)
    begin = (np.cumsum(sizes) - sizes)[owner] + number * CHUNK
    data = np.frombuffer(b"".join([*messages, bytes(CHUNK)]), np.uint8)
    chain = np.repeat(np.array(IV, np.uint32)[:, None], len(owner), axis=1)
    for k in range(int(blocks.max())):
        live = np.flatnonzero(blocks > k)
        size = np.minimum(left[live] - k * BLOCK, BLOCK)
        cells = data[(begin[live] + k * BLOCK)[:, None] + np.arange(BLOCK)]
        cells[np.arange(BLOCK) >= size[:, None]] = 0
        words = np.ascontiguousarray(cells).view("<u4").T.astype(np.uint32)
        last = blocks[live] == k + 1
        flags = CHUNK_START * (k == 0) + CHUNK_END * last + ROOT * (last & (chunks[owner[live]] == 1))
        chain[:, live] = _compressed(chain[:, live], words, number[live], size, flags)
    # Neighbours are joined level by level; one without a partner goes up as it is. This is the specification's tree, of
    # which each left side has the largest power of two of chunks that leaves the right side some.
    while len(owner) > len(messages):
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        count = np.bincount(owner, minlength=len(messages))[owner]
        lefts = np.flatnonzero((place % 2 == 0) & (place + 1 < count))
        flags = PARENT + ROOT * (count[lefts] == 2)
        words = np.concatenate([chain[:, lefts], chain[:, lefts + 1]])
        key = np.repeat(np.array(IV, np.uint32)[:, None], len(lefts), axis=1)
        chain[:, lefts] = _compressed(key, words, np.zeros(len(lefts), np.int64), np.full(len(lefts), BLOCK), flags)
        kept = place % 2 == 0
        chain, owner = chain[:, kept], owner[kept]
    raw = np.ascontiguousarray(chain.T).astype("<u4").tobytes().hex()
    return [raw[i : i + 64] for i in range(0, len(raw), 64)]


def blake3_hexes(messages: list[bytes]) -> list[str]:
    """The hash of each message, in hex."""
    out: list[str] = []
    group: list[bytes] = []
    size = 0
    for x in messages:
        if group and size + len(x) > SIDE_BY_SIDE:
            out += _hashed(group)
            group, size = [], 0
        group.append(x)
        size += max(len(x), BLOCK)
    return out + (_hashed(group) if group else [])


def blake3_hex(data: bytes) -> str:
    return blake3_hexes([data])[0]
