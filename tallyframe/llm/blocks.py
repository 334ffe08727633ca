"""Texts as blocks of dictionary-coded words, and a distinct-word table over all blocks.

A block is a run of documents with about ``BLOCK_BYTES`` of text: the words of
each document as codes, frequent words first, and every distinct word of the
block once. Words go to one of ``BUCKETS`` buckets by hash. Each word leaves a
block once however often it occurs, so no word gathers more rows than there are
blocks, and words travel packed and compressed.

A block is named by a hash of its content, so that making it again, after a lost
executor or for a second use, gives the same name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.words import hash_strings, slices, words_of
from tallyframe.session import materialize

BLOCK_BYTES = 8 << 20
BUCKETS = 512
#: One row per block (bucket -1; data: codes, places: the bucket of each word, more:
#: what ``describe`` says of each word) and one per block and bucket (data: words in
#: the order of their codes, more: how often each counts).
CODED = "block long, bucket int, data binary, places binary, more binary, ids array<long>, counts array<long>"
_CODED_NAMES = [f.split()[0] for f in CODED.split(", ")]
_CODED_TYPES = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]


def pack(values: np.ndarray) -> bytes:
    """Whole numbers, byte by byte of their significance, compressed."""
    raw = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
    top = int(values.max()) if len(values) else 0
    planes = [zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw[:, k]).tobytes())
              for k in range((top.bit_length() + 7) // 8)]
    head = [len(values), *map(len, planes)]
    return np.array([len(head), *head], "<u8").tobytes() + b"".join(planes)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    size, *planes = np.frombuffer(data, "<u8", n, 8).tolist()
    raw, at = np.zeros((size, 8), np.uint8), 8 * (n + 1)
    for k, length in enumerate(planes):
        raw[:, k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(memoryview(data)[at:at + length]), np.uint8)
        at += length
    return raw.reshape(-1).view("<u8").astype(np.int64 if len(planes) < 8 else np.uint64)


def pack_words(words: pa.Array) -> bytes:
    """Words hold no line break, so one separates them."""
    return zstandard.ZstdCompressor(level=3).compress(b"\n".join(words.cast(pa.binary()).to_pylist()))


def unpack_words(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split(b"\n")


def _code(lower: bool, count_in: Callable | None, describe: Callable | None, documents: bool, vocabulary: bool):
    """The mapInArrow function that makes blocks of (doc_id, text)."""
    def code(batches) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", BLOCK_BYTES):
            words = words_of(part.column("text"), lower)
            order = np.argsort(-np.bincount(words.codes, minlength=len(words.vocabulary)), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            codes, texts = rank[words.codes], words.vocabulary.take(pa.array(order))
            hashes, ids, counts = hash_strings(texts), part.column("doc_id").to_pylist(), words.counts
            name = xxhash.xxh3_64(codes.tobytes() + hashes.tobytes() + counts.tobytes() + repr(ids).encode())
            block, bucket = name.intdigest() >> 1, (hashes % np.uint64(BUCKETS)).astype(np.int64)
            rows = []
            if documents:
                more = pack(describe(texts)) if describe else None
                rows.append((block, -1, pack(codes), pack(bucket), more, ids, counts.tolist()))
            if vocabulary:
                if count_in is not None:
                    tally = np.bincount(codes[np.repeat(count_in(part.column("doc_id")), counts)], minlength=len(order))
                by = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[by], np.arange(BUCKETS + 1))
                for b in np.flatnonzero(np.diff(edges)).tolist():
                    own = by[edges[b]:edges[b + 1]]
                    rows.append((block, b, pack_words(texts.take(pa.array(own))), None, pack(tally[own]) if count_in else None, None, None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _CODED_TYPES)], _CODED_NAMES)
    return code


def code_blocks(docs: DataFrame, id_col: str, text_col: str, lower: bool = False, count_in: Callable | None = None,
                describe: Callable | None = None, write: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents by block, words by block and bucket).

    ``count_in(ids)`` marks the documents whose words are counted, and
    ``describe(words)`` gives a whole number for each word. With ``write`` both read
    a table in the shared folder, which pays when they are used several times;
    otherwise each codes the texts for itself, and ``docs`` must then give the same
    rows in the same order each time, as a scan of files does. Blocks that do not
    fit together are noticed.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    if write:
        coded = materialize(rows.mapInArrow(_code(lower, count_in, describe, True, True), CODED), "coded-blocks")
        blocks, words = coded.where("bucket < 0"), coded.where("bucket >= 0")
    else:
        blocks = rows.mapInArrow(_code(lower, None, describe, True, False), CODED)
        words = rows.mapInArrow(_code(lower, count_in, None, False, True), CODED)
    return blocks.drop("bucket"), words.select("block", "bucket", "data", "more")


def by_bucket(words: DataFrame, run: Callable, schema: str, *order: str) -> DataFrame:
    """mapInArrow over the words, all rows of a bucket in one task and next to each other."""
    return words.repartition("bucket").sortWithinPartitions("bucket", *order).mapInArrow(run, schema)


def answer_words(words: DataFrame, make_answer: Callable[[], Callable], *order: str) -> DataFrame:
    """(block, bucket, data): what is known about the words of each row.

    ``make_answer()`` is called for every bucket; its result is given one row at a
    time and returns the data, or None for a row that has no answer.
    """
    def run(batches) -> Iterator[pa.RecordBatch]:
        last, answer = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["bucket"] != last:
                    last, answer = row["bucket"], make_answer()
                data = answer(row)
                if data is not None:
                    out.append((row["block"], row["bucket"], data))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary()))],
                                                 ["block", "bucket", "data"])
    return by_bucket(words, run, "block long, bucket int, data binary", *order)


def finish_blocks(blocks: DataFrame, answers: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """Brings every block's documents and answers together.

    ``finish(row, codes, answers)`` returns an Arrow table. Laid end to end, the
    answers follow the words in the order that ``codes`` number them.
    """
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        told = dict(zip(right.column("bucket").to_pylist(), right.column("data").to_pylist()))
        tables = []
        for row in left.to_pylist():
            places = unpack(row["places"])
            if set(np.unique(places).tolist()) != told.keys():
                raise ValueError("the documents changed between two readings")
            spot = np.empty(len(places), np.int64)
            spot[np.argsort(places, kind="stable")] = np.arange(len(places))
            tables.append(finish(row, spot[unpack(row["data"])], [told[b] for b in sorted(told)]))
        return pa.concat_tables(tables)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def ragged(values: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of the runs numbered ``at``, one after another."""
    starts = np.concatenate([[0], np.cumsum(lengths)])
    n = lengths[at]
    ends = np.cumsum(n)
    index = np.repeat(starts[at] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
    return values[index], n
