"""Token counts, token files and the coder."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gapspark.llm import bpe, chunk_store, rans, token_counts, token_files
from gapspark.llm.common import table
from gapspark.session import fresh_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "  \n\n  a  ", "a<|endoftext|>b<|endoftext|><|endoftext|>  x", "aaaaaaaaaaaaaaa", "!'s 's' we'll 've",
    "日本語 テスト 🎉🎉🎉", "x" * 5000, "\x1c\x1d a\x85b\xa0c　d​e", "1234567 ٣٤٥ Ⅷ½", "tab\tend\r\n\r\n   z",
]


def library(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_counts_match_the_library(spark, folder):
    texts = TEXTS + [r.text for r in table(spark, folder, "documents").collect()]
    assert token_counts.count_tokens(texts, PATH, public_tokenizers.PATTERN) == [len(x) for x in library(texts)]


def test_merging_is_one_place_at_a_time():
    merges = bpe.Merges(PATH)
    rank = {(a, b): r for r, (a, b) in enumerate(
        (k // merges.size, k % merges.size) for k in merges.keys[np.argsort(merges.rank_of)].tolist())}
    random = np.random.default_rng(1)
    words = [bytes(random.choice(np.frombuffer(b"aabtheing ", np.uint8), int(n))) for n in random.integers(1, 40, 300)]
    for word, got in zip(words, merges.counts(words), strict=True):
        symbols = [int(merges.of_byte[b]) for b in word]
        while True:
            ranked = [(rank[p], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in rank]
            if not ranked:
                break
            r, i = min(ranked)
            symbols[i : i + 2] = [int(merges.made[r])]
        assert got == len(symbols)


def test_odd_rows_are_counted(odd, none):
    got = token_counts.token_counts(odd, PATH, public_tokenizers.PATTERN).collect()
    assert len(got) == 8
    by = {(r.doc_id, r.n_bytes): r for r in got}
    assert by[2, 0].n_tokens == by[3, 0].n_tokens == 0 and by[5, max(b for _, b in by)].over_limit
    assert token_counts.token_counts(none, PATH, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("n", [1, 2, 127, 129, 5000, 300_000])
def test_coder_round_trip(n):
    data = (np.random.default_rng(n).zipf(1.3, n) % 50_257).astype(np.uint32)
    back, extra = rans.load(b"".join(rans.dump(rans.encode(data), {"more": np.arange(3)})))
    assert (rans.decode(back) == data).all() and extra["more"].tolist() == [0, 1, 2]
    last = len(back.sizes) - 1
    assert (rans.decode(back, only=[last]) == data[last * back.steps * rans.LANES :]).all()


def test_damage_is_found():
    data = np.arange(3000, dtype=np.uint32)
    raw = bytearray(b"".join(rans.dump(rans.encode(data), {})))
    raw[-5] ^= 1
    with pytest.raises(ValueError):
        rans.load(bytes(raw))
    coded = rans.encode(data)
    coded.words[3] ^= 1
    with pytest.raises(ValueError):
        rans.decode(coded)


def test_files_give_all_ids_back(spark, odd, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 500)
    where = fresh_path(spark, "ids")
    manifest = token_files.write_ids(odd, where, PATH, end_id=2)
    got = sorted(token_files.read_ids(manifest, where).collect(), key=lambda r: r.start)
    assert [r.key for r in got] == [None, 1, 1, 2, 3, 4, 5, 6]
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    at = 0
    for r in got:
        ids = [*library([texts[r.key]])[0], 2]
        assert (r.start, r.n_ids, list(r.ids)) == (at, len(ids), ids)
        assert r.crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        at += len(ids)


def test_empty_table_gives_no_file(spark, none):
    where = fresh_path(spark, "ids")
    manifest = token_files.write_ids(none, where, PATH)
    assert manifest.count() == 0 and token_files.read_ids(manifest, where).count() == 0


def test_a_full_store_keeps_nothing_and_gives_the_same_ids(monkeypatch):
    texts = TEXTS + ["a b  c\n d " * 40 + "<|endoftext|>", "word " * 9, " " * 70 + "y" * 90, "", "word a b"] * 3
    want = [[*ids, 2] for ids in library(texts)]
    for room in (0, 2_000, 10**9):
        monkeypatch.setattr(chunk_store, "STORE_BYTES", room)
        store = chunk_store.ChunkStore(PATH, 2)
        for _ in range(2):
            ids, sizes = store.texts(texts)
            assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
        assert room or len(store) == 2
    monkeypatch.setattr(bpe, "MEMO_BYTES", 0)
    memo = bpe.Memo()
    assert memo.lookup([["a", "bb"], ["a"]], lambda new: [len(c) for c in new]) == [[1, 2], [1]] and not memo


def test_distinct_symbols_without_a_sort():
    for data in ([0, 0, 7, 3], [2**32 - 1, 5, 5]):
        got = rans.distinct(np.array(data, dtype=np.uint32))
        for a, b in zip(got, np.unique(data, return_inverse=True, return_counts=True), strict=True):
            assert a.tolist() == b.tolist()
