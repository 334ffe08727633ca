"""Words, word hashes and shingles of Arrow text columns, inside tasks.

A word is a run of characters other than space and the controls U+0009 to
U+000D. Everything here works on one slice of a batch at a time, so memory is
bounded by ``SLICE_BYTES`` or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20
BATCH_BYTES = 8 << 20
MAX_TEXTS = 1 << 16
SHINGLE = 5
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Words:
    """Words of several texts: text i owns codes[offsets[i]:offsets[i + 1]]."""
    codes: np.ndarray
    offsets: np.ndarray
    vocabulary: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits of a row's id and text: rows of one or no id are told apart by their texts."""
    doc_id, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (id_col, text_col))
    return F.unhex(F.md5(F.concat(doc_id, F.lit(":"), text).cast("binary")))


def bound_batches(spark: SparkSession, max_bytes: int = BATCH_BYTES) -> None:
    """Let Arrow batches of this session end after ``max_bytes``, so that long texts do not come by the ten thousand."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > max_bytes:
        spark.conf.set(key, str(max_bytes))


def slices(batches, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of a slice stay near ``max_bytes``."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, first = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > first and (total + n > max_bytes or i - first >= MAX_TEXTS):
                yield batch.slice(first, i - first)
                total, first = 0, i
            total += n
        if len(sizes) > first:
            yield batch.slice(first)


def words_of(texts: pa.Array, lower: bool = True) -> Words:
    """Dictionary-coded words of each text; null counts as empty."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    offsets -= offsets[0]
    codes, vocabulary = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    blank = pc.index(vocabulary, "").as_py()
    if blank >= 0:
        keep = codes != blank
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
        codes -= codes > blank
        vocabulary = pa.concat_arrays([vocabulary.slice(0, blank), vocabulary.slice(blank + 1)])
    return Words(codes, offsets, vocabulary)


def hash_strings(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string."""
    return np.fromiter((xxhash.xxh64_intdigest(v) for v in values.cast(pa.binary()).to_pylist()),
                       np.uint64, len(values))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles_of(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(48-bit hashes, offsets) of the word windows of each text, repeats included.

    A text of fewer than ``size`` words has one shingle, all its words; one
    without words has none.
    """
    h = hash_strings(words.vocabulary)[words.codes]
    counts, starts, ends = words.counts, words.offsets[:-1], words.offsets[1:]
    rolled = h.copy()
    for j in range(1, size):
        rolled *= _MULTIPLIER
        rolled[:max(0, len(h) - j)] += h[j:]
    keep = np.ones(len(h), bool)
    for j in range(1, size):
        keep[(ends - j)[counts >= j]] = False
    for n in range(1, size):
        at = starts[counts == n]
        short = np.full(len(at), n, np.uint64)
        for j in range(n):
            short = short * _MULTIPLIER + h[at + j]
        rolled[at], keep[at] = short, True
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    return mix(rolled[keep]) >> np.uint64(16), np.concatenate([[0], np.cumsum(n)])


def distinct_shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, counts, offsets): each text's distinct shingles, ascending.

    At most 65,536 texts at a time: text number and hash share one sorted word.
    """
    h, offsets = shingles_of(words, size)
    texts = len(offsets) - 1
    key = np.sort((np.repeat(np.arange(texts), np.diff(offsets)).astype(np.uint64) << np.uint64(48)) | h)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    key = key[first]
    per_text = np.bincount((key >> np.uint64(48)).astype(np.int64), minlength=texts)
    return (key & np.uint64((1 << 48) - 1), np.diff(np.append(first, len(new))),
            np.concatenate([[0], np.cumsum(per_text)]))
