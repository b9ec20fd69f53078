"""Range asymmetric numeral system over integer arrays, in interleaved lanes.

A static table of frequencies (sum 2**BITS) is shared by all blocks of a file.
A block is a matrix of steps x lanes; every lane is a coder of its own, and the
lanes of a step write their 32-bit words in lane order into the block's one stream.
Every CHECK steps the states of a block's lanes and its place in the stream are kept
as a checkpoint; decoding can start at any of them, and this decoder runs all
checkpoints of a file side by side.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

BITS = 20
LANES = 128
STEPS = 1024
CHECK = 256
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
MASK = np.uint64((1 << BITS) - 1)


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 that add up to 2**BITS, in proportion to counts."""
    total = 1 << BITS
    if len(counts) > total:
        raise ValueError("more symbols than the table has room for")
    share = counts.astype(np.float64) * (total / counts.sum())
    freq = np.maximum(1, np.floor(share)).astype(np.int64)
    over = int(freq.sum()) - total
    order = np.argsort(-freq, kind="stable")
    if over < 0:
        freq[order[0]] -= over
    while over > 0:
        cut = np.minimum(freq[order] - 1, np.maximum(1, freq[order] * over // total + 1))
        room = np.cumsum(cut)
        cut = np.where(room <= over, cut, np.maximum(0, over - (room - cut)))
        freq[order] -= cut
        over = int(freq.sum()) - total
    return freq


@dataclass
class Encoded:
    symbols: np.ndarray  # distinct symbols, ascending
    freq: np.ndarray
    n: int
    steps: int  # of a block
    check: int  # steps between checkpoints
    states: np.ndarray  # block, checkpoint, lane
    starts: np.ndarray  # block, checkpoint: place in the block's words
    sizes: np.ndarray  # words of each block
    sums: np.ndarray  # crc32 of each block's symbols
    words: np.ndarray  # the blocks' words, block after block


def shape(n: int) -> tuple[int, int, int]:
    """Blocks, steps of a block and steps between checkpoints for n symbols."""
    rows = max(1, -(-n // LANES))
    check = min(CHECK, rows)
    steps = min(STEPS, -(-rows // check) * check)
    return -(-rows // steps), steps, check


def distinct(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct symbols, each place's index into them, counts; without a sort for ids of a vocabulary."""
    if int(data.max()) >= 4 * len(data) + (1 << BITS):
        return np.unique(data, return_inverse=True, return_counts=True)
    counts = np.bincount(data)
    symbols = np.flatnonzero(counts)
    index_of = np.zeros(len(counts), dtype=np.int32)
    index_of[symbols] = np.arange(len(symbols))
    return symbols, index_of[data], counts[symbols]


def encode(data: np.ndarray) -> Encoded:
    """Encode a non-empty array of unsigned 32-bit symbols."""
    symbols, index, counts = distinct(data)
    freq = quantise(counts)
    first = np.concatenate([[0], np.cumsum(freq)[:-1]])
    blocks, steps, check = shape(len(data))
    grid = np.full(blocks * steps * LANES, int(np.argmax(freq)), dtype=np.int32)
    grid[: len(data)] = index
    grid = grid.reshape(blocks, steps, LANES)
    f64, c64 = freq.astype(np.uint64), first.astype(np.uint64)
    limit = ((LOW >> np.uint64(BITS)) << WORD) * f64
    x = np.full((blocks, LANES), LOW, dtype=np.uint64)
    states = np.zeros((blocks, steps // check, LANES), dtype=np.uint64)
    out, owners = [], []
    emitted = np.zeros((steps, blocks), dtype=np.int64)
    for t in range(steps - 1, -1, -1):
        s = grid[:, t, :]
        full = x >= limit[s]
        where = np.nonzero(full)
        out.append(x[where].astype(np.uint32))
        owners.append(where[0].astype(np.uint16) if blocks < 1 << 16 else where[0])
        emitted[t] = full.sum(axis=1)
        x = np.where(full, x >> WORD, x)
        f = f64[s]
        q = x // f
        x = (q << np.uint64(BITS)) + (x - q * f) + c64[s]
        if t % check == 0:
            states[:, t // check, :] = x
    flat = np.concatenate(out[::-1])
    owner = np.concatenate(owners[::-1])
    before = np.cumsum(emitted, axis=0) - emitted
    ends = np.minimum(np.arange(1, blocks + 1) * steps * LANES, len(data))
    begins = np.arange(blocks) * steps * LANES
    raw = np.ascontiguousarray(data, dtype="<u4")
    return Encoded(
        symbols.astype(np.uint32), freq.astype(np.uint32), len(data), steps, check, states,
        before[::check].T.copy(), emitted.sum(axis=0),
        np.array([zlib.crc32(raw[a:b]) for a, b in zip(begins, ends, strict=True)], dtype=np.uint32),
        flat[np.argsort(owner, kind="stable")],
    )


def decode(e: Encoded, only: np.ndarray | None = None) -> np.ndarray:
    """The symbols; with ``only``, those of the named blocks.

    Raises ValueError when a block does not give its checksum.
    """
    chosen = np.arange(len(e.sizes)) if only is None else np.asarray(only)
    base = np.concatenate([[0], np.cumsum(e.sizes)[:-1]])
    runs = e.steps // e.check
    x = e.states[chosen].reshape(-1, LANES).copy()
    at = (e.starts[chosen] + base[chosen][:, None]).reshape(-1)
    slot_symbol = np.repeat(np.arange(len(e.freq)), e.freq)
    f64 = e.freq.astype(np.uint64)
    c64 = np.concatenate([[0], np.cumsum(e.freq.astype(np.int64))[:-1]]).astype(np.uint64)
    words = np.append(e.words, np.uint32(0)).astype(np.uint64)
    got = np.empty((len(x), e.check, LANES), dtype=np.uint32)
    for t in range(e.check):
        slot = x & MASK
        s = slot_symbol[slot.astype(np.int64)]
        got[:, t, :] = e.symbols[s]
        x = f64[s] * (x >> np.uint64(BITS)) + slot - c64[s]
        low = x < LOW
        rank = np.cumsum(low, axis=1)
        place = np.minimum(at[:, None] + rank - 1, len(words) - 1)
        x = np.where(low, (x << WORD) | words[place], x)
        at = at + rank[:, -1]
    parts = got.reshape(len(chosen), runs * e.check * LANES)
    out = []
    for block, part in zip(chosen, parts, strict=True):
        part = part[: min(e.n - int(block) * e.steps * LANES, part.size)]
        if zlib.crc32(np.ascontiguousarray(part, dtype="<u4")) != int(e.sums[block]):
            raise ValueError(f"block {int(block)} is damaged")
        out.append(part)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


MAGIC = b"GAPRANS1"
FIELDS = (
    ("symbols", "<u4"), ("freq", "<u4"), ("states", "<u8"), ("starts", "<i8"), ("sizes", "<i8"),
    ("sums", "<u4"), ("words", "<u4"),
)


def dump(e: Encoded, extra: dict[str, np.ndarray]) -> list[bytes]:
    """The file: magic, header length, JSON header with a checksum per array, arrays."""
    import json

    arrays = {k: np.ascontiguousarray(getattr(e, k).astype(kind)) for k, kind in FIELDS}
    arrays |= {k: np.ascontiguousarray(v) for k, v in extra.items()}
    body = [v.tobytes() for v in arrays.values()]
    head = {"n": e.n, "steps": e.steps, "check": e.check, "lanes": LANES, "bits": BITS,
            "arrays": [[k, v.dtype.str, list(v.shape), zlib.crc32(b)] for (k, v), b in zip(arrays.items(), body, strict=True)]}
    text = json.dumps(head).encode()
    return [MAGIC, len(text).to_bytes(4, "little"), zlib.crc32(text).to_bytes(4, "little"), text, *body]


def load(data: bytes) -> tuple[Encoded, dict[str, np.ndarray]]:
    import json

    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    size = int.from_bytes(data[8:12], "little")
    text = data[16 : 16 + size]
    if zlib.crc32(text) != int.from_bytes(data[12:16], "little"):
        raise ValueError("damaged header")
    head = json.loads(text)
    if (head["lanes"], head["bits"]) != (LANES, BITS):
        raise ValueError("written with other settings")
    at, arrays = 16 + size, {}
    for name, kind, dims, check in head["arrays"]:
        count = int(np.prod(dims))
        part = data[at : at + count * np.dtype(kind).itemsize]
        if zlib.crc32(part) != check:
            raise ValueError(f"{name} is damaged")
        arrays[name] = np.frombuffer(part, dtype=kind).reshape(dims)
        at += len(part)
    own = {k: arrays.pop(k) for k, _ in FIELDS}
    return Encoded(n=head["n"], steps=head["steps"], check=head["check"], **own), arrays
