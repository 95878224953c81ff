"""Byte-level BPE over a corpus by a global shuffle of distinct words.

Encoding. Blocks of documents are exploded into pre-tokens with positions. A block keeps its distinct words once,
dealt by hash into buckets (a row per block and bucket), and the positions as a compressed stream of word
numbers (one body row). The bucket rows of all blocks are shuffled by bucket, where each distinct word is
encoded once, and its ids go back to the blocks that hold it. Bodies and ids then meet by block and documents
are reassembled by position. A word that makes up a third of all tokens is one entry per block. A block's size
is bounded (a single longer text is a block of its own), and there is a bucket for every `BUCKET_BYTES` of input, as Spark
estimates its size (at least 64), so a bucket's share of all blocks' words stays as large as it is however much the input
grows. All blocks that hold a word send it to the same bucket: over the whole table it is encoded once.

Decoding joins ids with the token-byte table. That table has one entry per vocabulary id (its size is fixed by
the vocabulary file, not by the corpus); every task holds it as two arrays and gathers from them.

Defined results: null texts count as empty and give no ids; equal rows give equal rows; an empty table gives an
empty result. Texts are never cut. Columns of the input other than the two named ones are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cellweave.llm.common import staged, table, text_or_empty

BLOCK_CHARS = 16 << 20
LEAST_BUCKETS = 64
BUCKET_BYTES = 64 << 20


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@cache
def encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@cache
def splitter(pattern: str):
    import regex

    return regex.compile(pattern)


@cache
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all tokens by id, offsets): the token-byte table."""
    found = ranks(path)
    parts = [b""] * (max(found.values()) + 1)
    for token, i in found.items():
        parts[i] = token
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def gathered(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices pool[starts[i] : starts[i] + lengths[i]] one after another."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return pool[:0]
    shift = np.repeat(starts - (ends - lengths), lengths)
    return pool[shift + np.arange(ends[-1])]


def decode(ids: np.ndarray, path: str) -> bytes:
    pool, offsets = token_bytes(path)
    ids = ids.astype(np.int64)
    return gathered(pool, offsets[ids], offsets[ids + 1] - offsets[ids]).tobytes()


def squeezed(data: bytes, level: int = 9) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def unsqueezed(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers as compressed byte planes."""
    return squeezed(np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(unsqueezed(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel() if len(raw) else np.zeros(0, "<u4")


def pack_stream(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Numbers below 255 in one byte each, 255 pointing to the rest."""
    return squeezed(np.minimum(numbers, 255).astype(np.uint8).tobytes()), packed(numbers[numbers >= 255] - 255)


def unpack_stream(short: bytes, rest: bytes) -> np.ndarray:
    numbers = np.frombuffer(unsqueezed(short), np.uint8).astype(np.uint32)
    numbers[numbers == 255] = unpacked(rest) + 255
    return numbers


def framed(*parts: bytes) -> bytes:
    return b"".join(len(x).to_bytes(8, "little") + x for x in parts)


def unframed(data: bytes) -> list[bytes]:
    parts, at = [], 0
    while at < len(data):
        end = at + 8 + int.from_bytes(data[at : at + 8], "little")
        parts.append(data[at + 8 : end])
        at = end
    return parts


def pack_words(words: list[str]) -> bytes:
    coded = [w.encode() for w in words]
    return framed(packed(np.fromiter(map(len, coded), np.uint32, len(coded))), squeezed(b"".join(coded)))


def unpack_words(data: bytes) -> list[bytes]:
    sizes, text = unframed(data)
    ends, text = np.cumsum(unpacked(sizes), dtype=np.int64).tolist(), unsqueezed(text)
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def arrow_type(docs: DataFrame) -> pa.DataType:
    return to_arrow_schema(docs.select("doc_id").schema).field(0).type


def pack_ids(ids: list, kind: pa.DataType) -> bytes:
    """Document ids of any type, as an Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("doc_id", kind)])) as out:
        out.write_batch(pa.record_batch([pa.array(ids, kind)], names=["doc_id"]))
    return squeezed(sink.getvalue().to_pybytes())


def unpack_ids(data: bytes) -> pa.ChunkedArray:
    return pa.ipc.open_stream(unsqueezed(data)).read_all().column(0)


BLOCK_ROWS = "block long, bucket long, data binary"


def explode_blocks(docs: DataFrame, pattern: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs(doc_id, text) as block rows: a row per bucket with the block's distinct words, and the body as bucket -1.

    The body holds the ids, the token counts, the stream of word numbers and the bucket of each word.
    """
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # an estimate may be far too large behind joins; a partition read from files holds at most some two buckets' bytes
    n_buckets = max(LEAST_BUCKETS, min(2 * docs.rdd.getNumPartitions(), -(-size // BUCKET_BYTES)))
    kind = arrow_type(docs)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, find = TaskContext.get().partitionId(), 0, splitter(pattern).findall
        words: dict[str, int] = {}
        ids, counts, streams, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            stream = np.concatenate(streams)
            # frequent words get small numbers: the stream packs better
            order = np.argsort(-np.bincount(stream, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words), dtype=np.uint32)
            listed = list(words)
            listed = [listed[i] for i in order.tolist()]
            by_bucket: dict[int, list[str]] = {}
            buckets = np.fromiter((zlib.crc32(w.encode()) % n_buckets for w in listed), np.uint32, len(listed))
            for w, k in zip(listed, buckets.tolist()):
                by_bucket.setdefault(k, []).append(w)
            body = framed(pack_ids(ids, kind), packed(np.array(counts, np.uint32)), *pack_stream(rank[stream]), packed(buckets))
            rows = [(-1, body), *((k, pack_words(by_bucket[k])) for k in sorted(by_bucket))]
            n = len(rows)
            return pa.record_batch(
                {
                    "block": pa.array([(part << 24) + seq] * n, pa.int64()),
                    "bucket": pa.array([k for k, _ in rows], pa.int64()),
                    "data": pa.array([x for _, x in rows], pa.binary()),
                }
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = find(text)
                streams.append(np.fromiter((words.setdefault(w, len(words)) for w in found), np.uint32, len(found)))
                ids.append(doc_id)
                counts.append(len(found))
                held += len(text)
                if held >= block_chars:
                    yield flush()
                    words, ids, counts, streams, held, seq = {}, [], [], [], 0, seq + 1
        if ids:
            yield flush()

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(blocks, BLOCK_ROWS)


def encode_buckets(words: DataFrame, path: str, pattern: str) -> DataFrame:
    """Bucket rows with their words replaced by (token counts, ids)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        encode_word = encoder(path, pattern)._core_bpe.encode_single_piece
        known: dict[bytes, list[int]] = {}
        out = []
        for data in frame["data"]:
            ids = [known[w] if w in known else known.setdefault(w, encode_word(w)) for w in unpack_words(data)]
            lengths = np.fromiter(map(len, ids), np.uint32, len(ids))
            out.append(framed(packed(lengths), packed(np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())))))
        return frame.assign(data=out)

    return words.groupBy("bucket").applyInPandas(run, BLOCK_ROWS)


def encoded_blocks(docs: DataFrame, path: str, pattern: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Block rows with ids instead of words. The exploded blocks are staged, so that both sides see the same blocks."""
    parts = staged(explode_blocks(docs, pattern, block_chars), "blocks")
    return encode_buckets(parts.where("bucket >= 0"), path, pattern).unionByName(parts.where("bucket < 0"))


def reassembled(blocks: DataFrame, each, schema: str) -> DataFrame:
    """each(ids) -> columns after doc_id, for every document of every block whose words' ids have come back."""
    names = StructType.fromDDL(schema).names

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("bucket")
        data = group.column("data").to_pylist()
        ids, counts, short, rest, buckets = unframed(data[0])
        coded = [unframed(x) for x in data[1:]]
        none = [np.zeros(0, np.uint32)]
        sizes = np.concatenate([unpacked(x) for x, _ in coded] or none).astype(np.int64)
        pool = np.concatenate([unpacked(x) for _, x in coded] or none)
        order = np.argsort(unpacked(buckets), kind="stable")
        lengths, starts = np.empty_like(sizes), np.empty_like(sizes)
        lengths[order], starts[order] = sizes, np.cumsum(sizes) - sizes
        stream, at, done = unpack_stream(short, rest), 0, []
        for n in unpacked(counts).tolist():
            own = stream[at : at + n]
            at += n
            done.append(each(gathered(pool, starts[own], lengths[own])))
        return pa.table([unpack_ids(ids), *map(pa.array, zip(*done))], names=names)

    return blocks.groupBy("block").applyInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs(doc_id, text) as (doc_id, ids)."""
    return reassembled(encoded_blocks(docs, path, pattern, block_chars), lambda ids: (ids.astype(np.int32),), f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN

    def digest(ids: np.ndarray) -> tuple:
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decode(ids, path)).hexdigest()

    docs = table(spark, sf_dir, "documents")
    blocks = encoded_blocks(docs, path, pattern)
    return reassembled(blocks, digest, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
