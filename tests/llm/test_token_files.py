import io
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from newsloom.llm import token_files
from newsloom.llm.token_files import (
    TokenFileError, block_bytes, coded, decoded, read_blocks, read_token_files, token_digests, tokenizer_text,
    write_token_files,
)
from newsloom.session import scratch_path

from .cases import documents, frame


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_str(tokenizer_text())
    found.encode_special_tokens = True
    return found


def expected(rows, tokenizer):
    """Documents in order, with their ids."""
    found = []
    for doc_id, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()
        found.append((doc_id is None, doc_id or 0, zlib.crc32(ids), doc_id, ids))
    at, out = 0, []
    for _, _, crc, doc_id, ids in sorted(found, key=lambda x: x[:3]):
        out.append((doc_id, at, len(ids) // 4, crc, ids))
        at += len(ids) // 4
    return out


def test_round_trip_of_odd_rows(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "LEAST_SHARD_IDS", 1000)
    monkeypatch.setattr(token_files, "BLOCK_IDS", 500)
    files = write_token_files(frame(spark), scratch_path(spark, "tokens"))
    assert files.n_shards > 1
    found = sorted((tuple(r) for r in read_token_files(files, whole=True).collect()), key=lambda r: r[1])
    assert [(*r[:4], bytes(r[4])) for r in found] == expected(documents(), tokenizer)


def test_digests_and_empty_table(spark, tokenizer):
    found = sorted((tuple(r) for r in token_digests(frame(spark)).collect()), key=lambda r: r[1])
    assert found == [r[:4] for r in expected(documents(), tokenizer)]
    assert token_digests(frame(spark, [])).collect() == []


def test_pieces_are_those_of_the_tokenizer(spark, tokenizer):
    """Random strings of separators, apostrophes, letters of many scripts and special tokens."""
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "\x1c", "\x85", " ", "　", "a", "B'll", "'s", "9", "é", "東", "가", "я", "½", "²",
             "<|endoftext|>", "-", "'", " '", "ʰ", "\U0001f600", "٣", "_"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    rows += [(1000 + c, f"a{chr(c)}b {chr(c)}1 {chr(c) * 2} x{chr(c)}") for c in range(0x600)]
    found = token_digests(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in found.collect()), key=lambda r: r[1]) == [r[:4] for r in expected(rows, tokenizer)]


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_numbers_of_every_length(n):
    rng = np.random.default_rng(n)
    values = (rng.integers(0, 1 << 32, n) >> (8 * rng.integers(0, 4, n))).astype(np.uint32)
    control, data = coded(values)
    assert (decoded(control, data, n) == values).all()
    assert len(control) == -(-n // 4)


def test_damaged_blocks_are_noticed():
    data = block_bytes([1, None], [3, 2], np.array([5, 300, 70000, 2, 1], dtype=np.uint32))
    (block,) = read_blocks(io.BytesIO(data))
    assert block.ids == [1, None] and block.values.tolist() == [5, 300, 70000, 2, 1]
    for bad in (data[:-1], data[:30] + bytes([data[30] ^ 1]) + data[31:], b"x" + data[1:]):
        with pytest.raises(TokenFileError):
            list(read_blocks(io.BytesIO(bad)))


def test_frequent_ids_take_one_byte(spark, tokenizer):
    rows = [(i, "the of and " * 200) for i in range(20)]
    files = write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), scratch_path(spark, "tokens"))
    (shard,) = files.shards.collect()
    with open(shard["path"], "rb") as f:
        assert len(f.read()) < 1.4 * shard["n_ids"]
