"""Ids of chunks, kept end to end in one array and gathered for whole texts at once."""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np

from gapspark.llm import bpe

#: Bytes a worker's store may take: keys, table entries and ids.
STORE_BYTES = 160_000_000
#: Bytes of an entry besides its text and ids: two objects and its share of the table.
ENTRY_BYTES = 190
#: Longer chunks are hardly ever met again and are not kept.
LONG = 64
#: New chunks that go through the library in one call.
JOIN = 500
#: Key of the id that ends a document.
END = -1


class ChunkStore(dict):
    """Chunk to the place of its ids.

    Places from 0 are kept for good, negative ones hold for one group of texts: long
    chunks, and all new ones once the store has its bytes. Every chunk goes through
    the tokenizers library. Many are sent as one string: a space before a character
    that is none always starts a pre-token, so the library cuts there, and the ids
    are told apart by the bytes they stand for.
    """

    def __init__(self, path: str, end_id: int | None):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.specials = {t.content: i for i, t in added.items() if t.special}
        if len(self.specials) > 1:
            raise ValueError("one special string at most")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        # a byte-level vocabulary writes one character for each byte
        self.bytes_of = np.zeros(max([*vocabulary.values(), *added]) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)
        self.ids, self.sizes, self.held = np.zeros(0, np.uint32), np.zeros(0, np.int64), 0
        self.new: list[str] = []
        self.once: dict[str, int] = {}
        for key, ids in ((None, list(self.specials.values())), (END, [] if end_id is None else [end_id])):
            self[key] = len(self)
            self._keep(np.array(ids, dtype=np.uint32), np.array([len(ids)]))

    def __missing__(self, chunk: str) -> int:
        if self.held < STORE_BYTES and len(chunk) <= LONG:
            place = self[chunk] = len(self)
            self.new.append(chunk)
            return place
        return self.once.setdefault(chunk, -1 - len(self.once))

    def _keep(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks end to end, and how many each has."""
        joined = [c[0] == " " and not c.isspace() for c in chunks]
        whole = [c for c, j in zip(chunks, joined, strict=True) if not j]
        parts = [c for c, j in zip(chunks, joined, strict=True) if j]
        sent = whole + ["".join(parts[at : at + JOIN]) for at in range(0, len(parts), JOIN)]
        got = [e.ids for e in self.tokenizer.encode_batch_fast(sent, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(got), dtype=np.uint32, count=sum(map(len, got)))
        ends = np.cumsum(self.bytes_of[ids])
        wanted = np.cumsum([len(c.encode("utf-8")) for c in whole + parts], dtype=np.int64)
        last = np.searchsorted(ends, wanted)
        if len(wanted) and (len(ends) != last[-1] + 1 or (ends[last] != wanted).any()):
            raise ValueError("the library's ids do not stand for the bytes of the chunks")
        sizes = np.diff(last + 1, prepend=0)
        # chunks were sent in this order: those on their own, then the joined ones
        back = np.empty(len(chunks), dtype=np.int64)
        back[np.argsort(joined, kind="stable")] = np.arange(len(chunks))
        return gather(ids, sizes, back), sizes[back]

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, each with the end id, and how many each has."""
        flat: list = []
        counts = np.zeros(len(texts), dtype=np.int64)
        for i, parts in enumerate(bpe.chunks_of(texts, list(self.specials))):
            before = len(flat)
            flat += parts
            flat.append(END)
            counts[i] = len(flat) - before
        places = np.fromiter(map(self.__getitem__, flat), dtype=np.int64, count=len(flat))
        if self.new:
            ids, sizes = self._encode(self.new)
            self._keep(ids, sizes)
            self.held += sum(map(len, self.new)) * 2 + ENTRY_BYTES * len(self.new) + ids.nbytes
            self.new = []
        ids, sizes = self.ids, self.sizes
        if self.once:
            more, of = self._encode(list(self.once)[::-1])
            ids, sizes = np.concatenate([ids, more]), np.concatenate([sizes, of])
            self.once = {}
        out = gather(ids, sizes, places)
        ends = np.concatenate([[0], np.cumsum(sizes[places])])[np.cumsum(counts)]
        return out, np.diff(ends, prepend=0)


def gather(flat: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The runs at ``places`` end to end; ``sizes`` cuts ``flat`` into runs."""
    starts = (np.cumsum(sizes) - sizes)[places]
    lengths = sizes[places]
    shift = starts - (np.cumsum(lengths) - lengths)
    return flat[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))]


@lru_cache(maxsize=2)
def store(path: str, end_id: int | None) -> ChunkStore:
    return ChunkStore(path, end_id)
