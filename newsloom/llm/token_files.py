"""Token ids of documents in binary files: ids by frequency rank, in byte-aligned lengths with separate control bytes.

1. Every text is encoded once (a byte-level tokenizer encodes a text's pieces one by one, so a task asks it for a piece
   once for many texts), an end id is appended, and the ids are stored beside the document's id.
2. Ids are counted over all documents; an id is written as its rank, the most frequent first, so that most of them
   take one byte. The table of ranks is bounded by the vocabulary and written once, as ``ranks.bin``.
3. Documents are dealt by range in ascending order of their ids, and a task writes its range as one shard of blocks.
   A block holds whole documents: a header, their ids and lengths, control bytes (two bits for each of four ids:
   their lengths of 1 to 4 bytes), data bytes, and a checksum over all of it. A shard is written under a temporary
   name and moved; the list of shards is what the tasks that succeeded returned, so a task that runs again leaves
   the same shard behind.
4. Shards are read sequentially, a block at a time. A table of 256 rows says for each control byte where its four ids
   start and how long they are, so a block is decoded without a loop over ids.

Null and empty texts have the end id only. Null ids come last; documents that share an id stand by the checksum of their
ids, then as they were read. Repeated rows are documents of their own. An empty table gives no shards and no rows.
Strings of special tokens within a text are ordinary text. Other columns are not looked at.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import types
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.tables import small_batches, stored
from newsloom.session import scratch_path, shared_files

VOCABULARY_FILE = "byte_bpe_50k.json"
END_ID = 2
# Ids of a block (whole documents, so one long document may have more), of a shard, and characters encoded together.
BLOCK_IDS, SHARD_IDS, ENCODED_CHARS = 1 << 16, 64 << 20, 1 << 18
# Pieces whose ids a worker remembers, and new ones that it encodes together.
KNOWN_PIECES, PIECES_AT_ONCE = 1 << 20, 2000
# Shards are not smaller than this unless there is nothing more.
LEAST_SHARD_IDS = 1 << 20
MAGIC, HEADER, HEADER_BYTES = b"TIDB", "<4sIIII", 20

# LENGTH[c, i]: bytes of the i-th id of control byte c; START: where it begins; TOTAL: bytes of all four.
LENGTH = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
START = np.cumsum(LENGTH, axis=1) - LENGTH
TOTAL = LENGTH.sum(axis=1)
KEEP = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


class TokenFileError(ValueError):
    """A shard that is cut off or whose checksum does not match."""


def tokenizer_text(path: str | None = None) -> str:
    """A tokenizer's file, read by the driver; it travels with the tasks. By default the public 50k byte-level BPE."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY_FILE)
    with open(path, encoding="utf-8") as f:
        return f.read()


def coded(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of numbers below 2^32."""
    v = np.zeros(-(-len(values) // 4) * 4, dtype="<u4")
    v[: len(values)] = values
    more = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    control = (more.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= more[:, None]]
    return control.tobytes(), data.tobytes()


def decoded(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The first ``n`` numbers of what ``coded`` returned."""
    c = np.frombuffer(control, dtype=np.uint8)
    total = TOTAL[c]
    at = ((np.cumsum(total) - total)[:, None] + START[c]).ravel()[:n]
    words = np.ndarray((len(data),), dtype="<u4", buffer=data + bytes(3), strides=(1,))
    return words[at] & KEEP[LENGTH[c].ravel()[:n]]


@dataclass
class Block:
    ids: list[int | None]
    counts: np.ndarray
    values: np.ndarray


def block_bytes(ids: list[int | None], counts: list[int], values: np.ndarray) -> bytes:
    control, data = coded(values)
    body = b"".join(
        [
            np.array([i or 0 for i in ids], dtype="<i8").tobytes(),
            np.array([i is None for i in ids], dtype=np.uint8).tobytes(),
            np.array(counts, dtype="<u4").tobytes(),
            control,
            data,
        ]
    )
    head = struct.pack(HEADER, MAGIC, len(ids), len(values), len(control), len(data))
    return head + body + struct.pack("<I", zlib.crc32(body, zlib.crc32(head)))


def _exactly(stream, n: int) -> bytes:
    out = b""
    while len(out) < n:
        part = stream.read(n - len(out))
        if not part:
            raise TokenFileError("shard ends within a block")
        out += part
    return out


def read_blocks(stream) -> Iterator[Block]:
    """The blocks of a shard in order; ``stream`` needs ``read(n)`` only."""
    while head := stream.read(1):
        head += _exactly(stream, HEADER_BYTES - 1)
        magic, n, m, controls, size = struct.unpack(HEADER, head)
        if magic != MAGIC:
            raise TokenFileError("not a block of token ids")
        body = _exactly(stream, 13 * n + controls + size)
        (said,) = struct.unpack("<I", _exactly(stream, 4))
        if said != zlib.crc32(body, zlib.crc32(head)):
            raise TokenFileError("checksum of a block does not match")
        numbers = np.frombuffer(body, dtype="<i8", count=n).tolist()
        missing = body[8 * n : 9 * n]
        counts = np.frombuffer(body, dtype="<u4", count=n, offset=9 * n)
        at = 13 * n
        values = decoded(body[at : at + controls], body[at + controls :], m)
        yield Block([None if none else i for i, none in zip(numbers, missing, strict=True)], counts, values)


# Letters, numbers and white space among characters whose classes have never changed; texts of others go the plain way.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏА-яЁёぁ-ゖァ-ヺ一-龥가-힣"
NUMBERS, SPACES = "0-9²³¹¼½¾", "\t-\r \x85\xa0"
UNSURE = re.compile(rf"[^\x00-ɏ‐-‧‰-⁞{LETTERS}]")
# The pieces of a byte-level tokenizer: fixed by the vocabulary's format.
PIECES = re.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)


def letters_of_bytes() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where Latin-1 shows it, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def without_pieces(text: str) -> str | None:
    """The file of the same tokenizer for texts cut into pieces already; None for one of another kind."""
    config = json.loads(text)
    before = config.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if not plain or config.get("normalizer") is not None or config["model"]["type"] != "BPE":
        return None
    return json.dumps(config | {"pre_tokenizer": None, "post_processor": None, "added_tokens": []})


def remembered(text: str, kind: str) -> dict:
    """What this Python worker keeps from one task to the next about a tokenizer: functions travel by value, and so their
    module's globals are new in every task."""
    held = sys.modules.setdefault("newsloom_token_pieces", types.ModuleType("newsloom_token_pieces"))
    return vars(held).setdefault(f"{zlib.crc32(text.encode())} {kind}", {"pieces": {}})


def _encode(text: str, end_id: int, kind: str):
    from tokenizers import Tokenizer

    bare_text = without_pieces(text)
    vocabulary = Tokenizer.from_str(text).get_vocab()
    letters_in = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)
    for token, i in vocabulary.items():
        letters_in[i] = len(token)

    def step(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        kept = remembered(text, kind)
        end = np.array([end_id], dtype=kind).tobytes()
        known: dict[str, bytes] = kept["pieces"]
        if bare_text and "bare" not in kept:
            kept["bare"] = Tokenizer.from_str(bare_text)
        bare = kept.get("bare")
        letters, size = letters_of_bytes(), np.dtype(kind).itemsize

        def ids_of(texts):
            if not texts:
                return []
            if "whole" not in kept:  # loaded for the first text that needs it
                kept["whole"] = Tokenizer.from_str(text)
                kept["whole"].encode_special_tokens = True
            found = kept["whole"].encode_batch_fast(texts, add_special_tokens=False)
            return [np.array(e.ids, dtype=kind).tobytes() for e in found]

        def learn(pieces):
            """New pieces are encoded together; the letters of an id say how many bytes of them it takes."""
            for i in range(0, len(pieces), PIECES_AT_ONCE):
                part = pieces[i : i + PIECES_AT_ONCE]
                spelt = [p.encode().decode("latin-1").translate(letters) for p in part]
                found = bare.encode_batch_fast([spelt], is_pretokenized=True, add_special_tokens=False)[0].ids
                ids = np.array(found, dtype=kind)
                ends = np.cumsum([len(p) for p in spelt])
                cuts = (size * (np.searchsorted(np.cumsum(letters_in[ids]), ends) + 1)).tolist()
                raw = ids.tobytes()
                known.update((p, raw[a:b]) for p, a, b in zip(part, [0, *cuts], cuts, strict=False))

        def encoded(texts):
            """The ids of each text with the end; pieces are encoded once for many texts."""
            plain = [bare is None or UNSURE.search(t) is not None for t in texts]
            others = iter(ids_of([t for t, p in zip(texts, plain, strict=True) if p]))
            pieces = [[] if p else PIECES.findall(t) for t, p in zip(texts, plain, strict=True)]
            if len(known) > KNOWN_PIECES:
                known.clear()
            learn(list(set().union(*pieces).difference(known)))
            return [
                (next(others) if p else b"".join(map(known.__getitem__, own))) + end
                for p, own in zip(plain, pieces, strict=True)
            ]

        def chunks(texts):
            held, chars = [], 0
            for t in texts:
                held.append(t or "")
                chars += len(held[-1])
                if chars >= ENCODED_CHARS:
                    yield held
                    held, chars = [], 0
            if held:
                yield held

        for batch in batches:
            numbers, at = batch.column("doc_id"), 0
            for part in chunks(batch.column("text").to_pylist()):
                found = encoded(part)
                yield pa.record_batch(
                    [
                        numbers.slice(at, len(part)),
                        pa.array([len(f) // np.dtype(kind).itemsize for f in found], pa.int64()),
                        pa.array([zlib.crc32(np.frombuffer(f, kind).astype("<u4").tobytes()) for f in found], pa.int64()),
                        pa.array(found, pa.binary()),
                    ],
                    names=["doc_id", "n_tokens", "checksum", "ids"],
                )
                at += len(part)

    return step


def _count(kind: str):
    def step(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype=kind)
            found = np.bincount(values, minlength=len(total))
            found[: len(total)] += total
            total = found
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    return step


def _write(folder: str, kind: str, rank_of: np.ndarray):
    def step(batches):
        system, base = shared_files(folder)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        name, temporary = f"{base}/ids-{part:07d}.bin", f"{base}/.ids-{part:07d}-{attempt}"
        sink, documents, written = None, 0, 0
        ids, counts, held, waiting = [], [], [], 0

        def flush():
            nonlocal ids, counts, held, waiting
            sink.write(block_bytes(ids, counts, rank_of[np.concatenate(held)]))
            ids, counts, held, waiting = [], [], [], 0

        for batch in batches:
            for number, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                if sink is None:
                    system.create_dir(base, recursive=True)
                    sink = system.open_output_stream(temporary, compression=None)
                values = np.frombuffer(data.as_buffer(), dtype=kind)
                ids.append(number)
                counts.append(len(values))
                held.append(values)
                waiting += len(values)
                documents += 1
                written += len(values)
                if waiting >= BLOCK_IDS:
                    flush()
        if sink is None:
            return
        if ids:
            flush()
        sink.close()
        system.move(temporary, name)
        yield pa.record_batch(
            [pa.array([part], pa.int64()), pa.array([name]), pa.array([documents]), pa.array([written])],
            names=["shard", "path", "documents", "n_ids"],
        )

    return step


@dataclass
class TokenFiles:
    """What ``write_token_files`` made: the folder, and its shards as ``(shard, path, documents, n_ids)``."""

    folder: str
    shards: DataFrame
    n_shards: int


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> TokenFiles:
    """Writes the ids of ``docs`` (doc_id, text) to ``folder``, which all executors reach."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    text = tokenizer_text(tokenizer)
    size = max(Tokenizer.from_str(text).get_vocab_size(), end_id + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"

    slim = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    columns = "doc_id long, n_tokens long, checksum long, ids binary"
    encoded = slim.mapInArrow(_encode(text, end_id, kind), columns)
    encoded = stored(encoded.withColumn("row", F.monotonically_increasing_id()), "token-ids", "zstd")

    # at most one row for each id of the vocabulary
    seen = encoded.select("ids").mapInArrow(_count(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counted = sorted(((r.id, r.n) for r in seen.collect()), key=lambda x: (-x[1], x[0]))
    by_rank = np.array([i for i, _ in counted], dtype="<u4")
    rank_of = np.zeros(size, dtype="<u4")
    rank_of[by_rank] = np.arange(len(by_rank), dtype="<u4")
    system, base = shared_files(folder)
    system.create_dir(base, recursive=True)
    with system.open_output_stream(f"{base}/ranks.bin", compression=None) as f:
        f.write(by_rank.tobytes())

    total = sum(n for _, n in counted)
    at_once = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // LEAST_SHARD_IDS))
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("checksum"), F.col("row")]
    dealt = encoded.repartitionByRange(max(1, at_once, -(-total // SHARD_IDS)), *order).sortWithinPartitions(*order)
    written = dealt.select("doc_id", "ids").mapInArrow(
        _write(folder, kind, rank_of), "shard long, path string, documents long, n_ids long"
    )
    shards = stored(written, "token-shards")
    return TokenFiles(folder, shards, shards.count())


def _read(folder: str, whole: bool):
    def step(batches):
        system, base = shared_files(folder)
        by_rank = None
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                if by_rank is None:
                    with system.open_input_stream(f"{base}/ranks.bin", compression=None) as f:
                        by_rank = np.frombuffer(f.read(), dtype="<u4")
                with system.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
                    for block in read_blocks(stream):
                        values = by_rank[block.values]
                        ends = np.cumsum(block.counts, dtype=np.int64)
                        begins = ends - block.counts
                        texts = [values[a:b].astype("<u4").tobytes() for a, b in zip(begins, ends, strict=True)]
                        columns = [
                            pa.array(block.ids, pa.int64()),
                            pa.array(begins + start, pa.int64()),
                            pa.array(block.counts.astype(np.int64), pa.int64()),
                            pa.array([zlib.crc32(t) for t in texts], pa.int64()),
                        ]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        if whole:
                            columns.append(pa.array(texts, pa.binary()))
                            names.append("ids")
                        yield pa.record_batch(columns, names=names)
                        start += int(ends[-1])

    return step


def read_token_files(files: TokenFiles, whole: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in the files; with ``whole`` its ids too, as
    little-endian unsigned 32-bit integers. ``start`` counts the ids of all documents before it."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    first = files.shards.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    columns = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if whole else "")
    # as many tasks as shards: rows of paths are too few for the adaptive plan to keep them apart
    dealt = first.repartitionByRange(max(files.n_shards, 1), "shard").select("path", "first")
    return dealt.mapInArrow(_read(files.folder, whole), columns)


def token_digests(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the ids of all documents to the shared folder and reads them back."""
    spark: SparkSession = docs.sparkSession
    files = write_token_files(docs, scratch_path(spark, "token-files"), tokenizer, end_id)
    return read_token_files(files)
