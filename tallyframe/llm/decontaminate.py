"""Benchmark items inside documents: size-partitioned MinHash containment search.

Items are grouped by size (powers of two of their distinct five-word shingles).
The sketch of an item is its p smallest shingle hashes, with p taken from the
exact bound: a document that holds at least ``threshold`` of an item's n shingles
misses at most n - ceil(threshold * n) of them, so it holds one of any p =
n - ceil(threshold * n) + 1. Each size class keeps its own sketch table, a
document is looked up only in classes it is large enough for, and every hit is
verified by exact containment of all shingles. The search loses no item.

Items are taken in blocks of at most ``ITEM_BLOCK`` shingles, the only thing that
is broadcast; documents are streamed against each block and never shuffled.

An item of fewer than five words is one window of its own length: it is looked up
among the windows of that many words, each length with a table of its own.

Defined results: null and empty texts and items hold no shingle and match
nothing; an item of one to four words is found wherever its words stand side by
side; repeated rows of documents give repeated rows; repeated items count once; extra columns are
ignored; a null id is returned as null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.words import SHINGLE, distinct_shingles, row_key, shingles_of, slices, words_of

THRESHOLD = 0.8
ITEM_BLOCK = 2_000_000
_PREFIX_BITS = 16


def needed(n, threshold: float):
    """How many of n shingles make up the threshold."""
    return np.ceil(np.asarray(n) * threshold - 1e-9).astype(np.int64)


@dataclass
class SizeClass:
    """Items of one size: sorted sketch hashes and the items they come from."""
    smallest: int
    hashes: np.ndarray
    owners: np.ndarray
    present: np.ndarray

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in h, item) of every shingle hash found in the sketches."""
        maybe = np.flatnonzero(self.present[(h >> np.uint64(48 - _PREFIX_BITS)).astype(np.int64)])
        left = np.searchsorted(self.hashes, h[maybe], "left")
        n = np.searchsorted(self.hashes, h[maybe], "right") - left
        at = np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(maybe, n), self.owners[at]


def size_classes(items: list[np.ndarray], threshold: float) -> list[SizeClass]:
    by_class: dict[int, list[int]] = {}
    for i, h in enumerate(items):
        if len(h):
            by_class.setdefault(len(h).bit_length(), []).append(i)
    out = []
    for members in by_class.values():
        sketches = [items[i][:len(items[i]) - int(needed(len(items[i]), threshold)) + 1] for i in members]
        hashes = np.concatenate(sketches)
        owners = np.repeat(np.array(members), [len(s) for s in sketches])
        order = np.argsort(hashes, kind="stable")
        present = np.zeros(1 << _PREFIX_BITS, bool)
        present[(hashes >> np.uint64(48 - _PREFIX_BITS)).astype(np.int64)] = True
        smallest = int(needed(min(len(items[i]) for i in members), threshold))
        out.append(SizeClass(smallest, hashes[order], owners[order], present))
    return out


def _shingle_rows(batches) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        words = words_of(part.column("text"))
        h, _, offsets = distinct_shingles(words)
        rows = [h[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
        for n in range(1, SHINGLE):
            own, cuts = shingles_of(words, n)
            for i in np.flatnonzero(words.counts == n):
                rows[i] = own[cuts[i]:cuts[i + 1]].tobytes()
        yield pa.RecordBatch.from_arrays(
            [part.column("item_id"), pa.array(rows, pa.binary()), pa.array(np.diff(offsets), pa.int64()),
             pa.array(np.minimum(words.counts, SHINGLE), pa.int64())], ["item_id", "hashes", "n", "words"])


def _matcher(ids: list, items: list[np.ndarray], words: list[int], threshold: float):
    """The mapInArrow function that finds one block of items in documents."""
    by_words = {}
    for size in sorted(set(words)):
        members = [i for i, n in enumerate(words) if n == size]
        by_words[size] = np.array(members), size_classes([items[i] for i in members], threshold)

    def match(batches) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts, rows = words_of(part.column("text")), []
            for size, (members, classes) in by_words.items():
                h, offsets = shingles_of(texts, size)
                sizes = np.diff(offsets)
                pairs = set()
                for c in classes:
                    at, item = c.hits(h)
                    doc = np.searchsorted(offsets, at, "right") - 1
                    large = sizes[doc] >= c.smallest
                    pairs.update(zip(doc[large].tolist(), members[item[large]].tolist()))
                own, last = None, -1
                for doc, item in sorted(pairs):
                    if doc != last:
                        own, last = np.unique(h[offsets[doc]:offsets[doc + 1]]), doc
                    at = np.minimum(np.searchsorted(own, items[item]), len(own) - 1)
                    shared = int((own[at] == items[item]).sum())
                    if shared >= needed(len(items[item]), threshold):
                        rows.append((doc, ids[item], shared, len(items[item])))
            if rows:
                docs, found, shared, n = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(docs)), pa.array(found, pa.int64()),
                     pa.array(shared, pa.int64()), pa.array(n, pa.int64())],
                    ["doc_id", "item_id", "n_shared", "n_item"])
    return match


def find_items(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", threshold: float = THRESHOLD,
               item_block: int = ITEM_BLOCK) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for each item found in a document."""
    texts = docs.select(F.col(f"`{doc_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return _find(texts, items, item_col, threshold, item_block)


def _find(texts: DataFrame, items: DataFrame, item_col: str = "item_id", threshold: float = THRESHOLD,
          item_block: int = ITEM_BLOCK) -> DataFrame:
    """``find_items`` in texts (doc_id, text); doc_id may be of any type."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    shingled = (items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col("text")).distinct()
                .mapInArrow(_shingle_rows, "item_id long, hashes binary, n long, words long").where("n > 0"))
    total = shingled.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // item_block))
    out = None
    for b in range(blocks):
        rows = shingled.where(F.pmod(F.xxhash64("hashes"), F.lit(blocks)) == b).collect()
        match = _matcher([r.item_id for r in rows], [np.frombuffer(r.hashes, np.uint64) for r in rows], [r.words for r in rows], threshold)
        found = texts.mapInArrow(match, f"doc_id {kind}, item_id long, n_shared long, n_item long")
        out = found if out is None else out.unionAll(found)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def decontaminate(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text",
                  per_row: bool = False, **options) -> DataFrame:
    """The documents that hold no benchmark item; an id goes with all its rows, with ``per_row`` only the rows that hold one."""
    key = row_key(doc_col, text_col) if per_row else F.col(f"`{doc_col}`").cast("long")
    found = _find(docs.select(key.alias("doc_id"), F.col(f"`{text_col}`").alias("text")), items, **options)
    found = found.select(F.col("doc_id").alias("_found")).distinct()
    return docs.withColumn("_row", key).join(found, F.col("_row").eqNullSafe(F.col("_found")), "left_anti").drop("_row")
