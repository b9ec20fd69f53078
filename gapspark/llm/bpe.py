"""Byte-pair encoding of pre-tokens held as ragged arrays.

All pre-tokens of a batch lie end to end in one symbol array. Each round finds the
lowest-ranked pair of every sequence and merges all its places at once; sequences
without a pair leave the array, and the symbols they are left with are counted.
A merge never makes a pair of lower rank than its own (checked on load), so the
rounds give what merging one place at a time gives.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: Bytes a worker's store of results may take, and those of an entry besides its text.
MEMO_BYTES = 160_000_000
ENTRY_BYTES = 190
NONE = np.iinfo(np.int32).max


@lru_cache(maxsize=2)
def splitter(pattern: str):
    import regex

    return regex.compile(pattern).findall


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Merges:
    """The merge table of a vocabulary file, as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.size = len(vocab)
        symbols = byte_symbols()
        self.of_byte = np.array([vocab[symbols[b]] for b in range(256)], dtype=np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        rank = np.arange(len(pairs), dtype=np.int32)
        first = np.full(self.size, -1, dtype=np.int64)
        first[made[::-1]] = rank[::-1]
        if (np.maximum(first[left], first[right]) >= rank).any():
            raise ValueError("a merge comes before the merge that makes one of its parts")
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of, self.made = keys[order], rank[order], made

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        wanted = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.rank_of[at], NONE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Number of symbols each word ends with."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        result = lengths.copy()
        symbols = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        ids = np.flatnonzero(lengths)
        lengths = lengths[ids]
        rank = np.full(len(symbols), NONE, dtype=np.int32)
        if len(symbols) > 1:
            rank[:-1] = self.ranks(symbols[:-1], symbols[1:])
        while len(ids):
            starts = np.zeros(len(ids), dtype=np.int64)
            np.cumsum(lengths[:-1], out=starts[1:])
            rank[starts + lengths - 1] = NONE
            least = np.minimum.reduceat(rank, starts)
            open_ = least < NONE
            result[ids[~open_]] = lengths[~open_]
            if not open_.any():
                break
            keep = np.repeat(open_, lengths)
            symbols, rank = symbols[keep], rank[keep]
            ids, lengths, least = ids[open_], lengths[open_], least[open_]
            owner = np.repeat(np.arange(len(ids)), lengths)
            hit = rank == least[owner]
            # in a run of touching places of one pair, every second one
            place = np.arange(len(hit))
            run_start = np.maximum.accumulate(np.where(hit, 0, place + 1))
            hit &= (place - run_start) % 2 == 0
            at = np.flatnonzero(hit)
            symbols[at] = self.made[rank[at]]
            rest = np.ones(len(symbols), dtype=bool)
            rest[at + 1] = False
            lengths = lengths - np.bincount(owner[at], minlength=len(ids))
            moved = at - np.arange(len(at))
            symbols, rank = symbols[rest], rank[rest]
            for left in (moved, moved - 1):
                left = left[(left >= 0) & (left < len(symbols) - 1)]
                rank[left] = self.ranks(symbols[left], symbols[left + 1])
        return result


    def counts_in(self, chunks: list[list[str]]) -> list[int]:
        """Symbols of each chunk of pre-tokens; equal pre-tokens are merged once."""
        flat = [w for words in chunks for w in words]
        distinct = list(dict.fromkeys(flat))
        counts = self.counts([w.encode("utf-8") for w in distinct]) if distinct else np.zeros(0, int)
        of = dict(zip(distinct, counts.tolist(), strict=True))
        return [sum([of[w] for w in words]) for words in chunks]


class Memo(dict):
    """Results by chunk; when it is full, new results are used once and not kept."""

    held = 0

    def lookup(self, chunks: list[list], compute) -> list[list]:
        """The result of every chunk, list by list; ``compute`` gets the new ones."""
        new = list(dict.fromkeys([c for words in chunks for c in words if c not in self]))
        made = dict(zip(new, compute(new), strict=True)) if new else {}
        more = 2 * sum(map(len, new)) + ENTRY_BYTES * len(new)
        if self.held + more <= MEMO_BYTES:
            self.update(made)
            self.held += more
            made = {}
        get = self.__getitem__
        if not made:
            return [list(map(get, words)) for words in chunks]
        return [[made[c] if c in made else get(c) for c in words] for words in chunks]


#: White space as Unicode has it, which is what the splitting patterns mean by it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A word with at most one space before it, or white space up to the last before a word.
CHUNK = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall


def chunks_of(texts: list[str], specials: list[str]):
    """Per text the chunks that no pre-token crosses, and how often special strings occur.

    Chunks are coarser than pre-tokens and repeat as often, so results are kept by
    chunk. Special strings are cut out first, as the library does; ``None`` stands
    where one was.
    """
    for text in texts:
        parts = [text]
        for special in specials:
            if special in text:
                parts = [x for part in parts for x in _between(part, special)]
        yield [c for part in parts for c in ([None] if part is None else CHUNK(part))]


def _between(part, special):
    if part is None:
        return [None]
    cut = part.split(special)
    return [x for piece in cut for x in (piece, None)][:-1]
