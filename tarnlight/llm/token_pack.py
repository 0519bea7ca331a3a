"""Operator 9, token-ID output: ids packed in the least bits that the vocabulary needs, in blocks with offsets."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tarnlight.llm.common import quoted, read

#: A vocabulary: a token in base64 and its rank on each line; and how a text is cut into words.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ids in each block but the last of a shard.
BLOCK_TOKENS = 65_536
SCHEMA = "shard int, block int, first_token long, n_tokens int, bits int, byte_offset long, doc_ids array<{kind}>, doc_starts array<long>, doc_lengths array<long>, payload binary"


def width(vocabulary_size: int) -> int:
    """Bits that hold every id from 0 to vocabulary_size - 1, at least 1."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Each id in that many bits, lowest bit first, without gaps; the last byte is filled with zeros."""
    ids = np.ascontiguousarray(ids, "<u4")
    if bits < 32 and len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    each = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each, bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """Ids start ... start + count - 1 of a block: only their bytes are read."""
    first = start * bits
    data = np.frombuffer(payload, np.uint8)[first // 8 : -(-(first + count * bits) // 8)]
    each = np.unpackbits(data, bitorder="little")[first % 8 : first % 8 + count * bits].reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = each
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def document(blocks: list, position: int, length: int, block_tokens: int = BLOCK_TOKENS) -> np.ndarray:
    """Ids of the document that starts at token `position` of a shard, from the shard's rows in order of block."""
    parts = []
    while length > 0:
        row = blocks[position // block_tokens]
        start = position - row["first_token"]
        n = min(length, row["n_tokens"] - start)
        parts.append(unpack(row["payload"], row["bits"], start, n))
        position, length = position + n, length - n
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


class Blocks:
    """Cuts one shard's documents into blocks of equal size."""

    def __init__(self, shard: int, bits: int, block_tokens: int, kind: pa.DataType):
        self.shard, self.bits, self.size, self.kind = shard, bits, block_tokens, kind
        self.held: list[np.ndarray] = []
        self.n = self.done = self.block = self.bytes = 0
        self.docs: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.done + self.n, len(ids)))
        self.held.append(ids)
        self.n += len(ids)

    def rows(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """Full blocks, and at the end what is left, even if that is a document without ids."""
        if self.n < self.size and not (last and (self.n or self.docs)):
            return
        ids = np.concatenate(self.held)
        at = 0
        while self.n - at >= self.size or (last and (self.n > at or self.docs)):
            part = ids[at : at + self.size]
            payload = pack(part, self.bits)
            upto = self.done + len(part)
            here = [d for d in self.docs if d[1] < upto or (last and self.n - at <= self.size)]
            self.docs = self.docs[len(here) :]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([self.shard], pa.int32()),
                    pa.array([self.block], pa.int32()),
                    pa.array([self.done], pa.int64()),
                    pa.array([len(part)], pa.int32()),
                    pa.array([self.bits], pa.int32()),
                    pa.array([self.bytes], pa.int64()),
                    pa.array([[d[0] for d in here]], pa.list_(self.kind)),
                    pa.array([[d[1] for d in here]], pa.list_(pa.int64())),
                    pa.array([[d[2] for d in here]], pa.list_(pa.int64())),
                    pa.array([payload], pa.binary()),
                ],
                names=["shard", "block", "first_token", "n_tokens", "bits", "byte_offset", "doc_ids", "doc_starts", "doc_lengths", "payload"],
            )
            at += len(part)
            self.done, self.block, self.bytes = upto, self.block + 1, self.bytes + len(payload)
        self.held, self.n = [ids[at:]], self.n - at


def pack_documents(docs: DataFrame, row_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Every text's ids in packed blocks: one row for each block, one shard for each partition of docs.

    byte_offset is where the block's payload starts in its shard's file, first_token the place of its first id among the
    shard's; blocks follow each other without gaps, and every block but the last of a shard has block_tokens ids, so that any id
    is found by one division. doc_ids, doc_starts and doc_lengths list the documents that start in the block, in order. A null
    or empty text is a document of length 0; null and repeated ids are kept as they are; a long text runs over several blocks.
    Special tokens' strings are ordinary text.
    """
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    bits = width(max(ranks.values()) + 1)
    kind = docs.schema[row_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        out = None
        for b in batches:
            out = out or Blocks(TaskContext.get().partitionId(), bits, block_tokens, b.column(0).type)
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py()
                out.add(doc_id, coder.encode_to_numpy(t, disallowed_special=()) if t else np.zeros(0, np.uint32))
                if out.n >= 4 * block_tokens:
                    yield from out.rows()
        if out is not None:
            yield from out.rows(last=True)

    return docs.select(quoted(row_id), quoted(text)).mapInArrow(run, SCHEMA.format(kind=kind))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
