"""Alignment of the tokens of two tokenizers, and how often their ids meet in a corpus.

Texts are cut into units ahead of spaces and line ends that follow other characters:
neither tokenizer joins bytes across such a place, so the tokens of a text are those of
its units, groups never cross units, and every distinct unit is encoded and aligned
once. Its links come from products of token-byte and token-group incidence matrices
(``incidence``).

Texts are worked on in blocks. A block keeps its distinct linked id pairs, how many of
its documents hold each, and each document's pairs as places in that list. Counts over
the corpus are sums of those over blocks; a second pass joins them back to the blocks'
pairs, so a pair is shuffled once a block, however many documents hold it.

Defined results: null and empty texts, and texts whose joined token bytes differ from
space and text for either tokenizer, have no tokens, zeros and no groups; rows that
share a doc_id, null included, are documents of their own; other columns are ignored;
an empty table gives no rows. A stretch without spaces is encoded in one piece.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.incidence import Csr, intervals, members, product, ranges, transpose
from tallyframe.llm.words import bound_batches, slices
from tallyframe.session import materialize

BLOCK_BYTES = 8 << 20
PIECE_CHARS = 1 << 20
TABLE_UNITS = 200_000
ALIGN_BYTES = 1 << 20
_UNIT = re.compile(r"\s*\S+(?:[^\S \n]\s*+\S*+)*+|\s+")
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
_ZSTD = 3


def byte_alphabet() -> dict[str, int]:
    """The characters of byte-level vocabularies: printable bytes stand for themselves, others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers: ids of units, and the bytes of every id."""

    def __init__(self, byte_level_path: str, piece_path: str):
        import sentencepiece
        import tokenizers
        with open(byte_level_path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        alphabet = byte_alphabet()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            if all(c in alphabet for c in entry):
                self.a_bytes[i] = bytes(alphabet[c] for c in entry)
        self.a = tokenizers.Tokenizer.from_file(byte_level_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id("▁")
        # Units are exact only if no piece joins other characters with a later space, or holds a line end.
        for i, p in enumerate(pieces):
            if not self.b.is_byte(i) and ("\n" in p or re.search("[^▁]▁", p)):
                raise ValueError(f"piece {p!r} crosses the places where texts are cut")
        self.a_size = np.array([len(x) for x in self.a_bytes])
        self.b_size = np.array([len(x) for x in self.b_bytes])

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both for units of a text that a space leads."""
        a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        b = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        for i, unit in enumerate(units):
            if unit[0] != " ":
                if b[i][0] != self.space:
                    raise ValueError(f"unit {unit[:20]!r} does not begin with the added space")
                del b[i][0]
            elif len(unit) == 1:
                b[i] = [self.space]
        return a, b

    def whole(self, unit: str, a: list[int], b: list[int]) -> bool:
        data = unit.encode()
        return data == b"".join(map(self.a_bytes.__getitem__, a)) and data == b"".join(map(self.b_bytes.__getitem__, b))


@lru_cache(maxsize=2)
def load(byte_level_path: str, piece_path: str) -> Pair:
    return Pair(byte_level_path, piece_path)


def align(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, Csr, Csr]:
    """Groups of the tokens of both sides, their number, the overlap links and the links within groups."""
    a, b = intervals(a_sizes), intervals(b_sizes)
    ends = np.intersect1d(a.indptr[1:], b.indptr[1:], assume_unique=True)
    a_group, b_group = np.searchsorted(ends, a.indptr[1:]), np.searchsorted(ends, b.indptr[1:])
    overlaps = product(a, transpose(b))
    shared = product(members(a_group, len(ends)), transpose(members(b_group, len(ends))))
    return a_group, b_group, len(ends), overlaps, shared


class Units:
    """Distinct units by number: their tokens, groups as text and links as id pairs."""

    def __init__(self, pair: Pair):
        self.pair, self.index = pair, {}
        self.strings: list[str] = []
        #: a column a measure: valid, tokens of A, tokens of B, groups, links, links within groups
        self.measures = np.empty((0, 6), np.int64)
        self.links, self.link_ptr = np.empty(0, np.int64), np.zeros(1, np.int64)

    def codes(self, text: str) -> Iterator[np.ndarray]:
        """Numbers of the units of space and text, a piece of it at a time."""
        stream, at, index = " " + text, 0, self.index
        while at < len(stream):
            cut = _CUT.search(stream, at + PIECE_CHARS)
            end = cut.start() if cut else len(stream)
            found = _UNIT.findall(stream, at, end)
            yield np.fromiter((index.setdefault(u, len(index)) for u in found), np.int64, len(found))
            at = end

    def learn(self) -> None:
        """Encodes and aligns the units that are new since the last call."""
        known = len(self.strings)
        names = list(self.index)[known:]
        measures, links, counts = [self.measures], [self.links], [np.diff(self.link_ptr)]
        at = 0
        while at < len(names):
            size, end = 0, at
            while end < len(names) and (end == at or size + 4 * len(names[end]) <= ALIGN_BYTES):
                size += 4 * len(names[end])
                end += 1
            for out, part in zip((measures, links, counts), self._learn(names[at:end])):
                out.append(part)
            at = end
        self.measures, self.links = np.concatenate(measures), np.concatenate(links)
        self.link_ptr = np.concatenate([[0], np.cumsum(np.concatenate(counts))])

    def _learn(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.pair.encode(units)
        valid = np.array([self.pair.whole(u, x, y) for u, x, y in zip(units, a, b)], bool)
        for i in np.flatnonzero(~valid):
            a[i], b[i] = [], []
        a_unit, b_unit = (np.repeat(np.arange(len(units)), [len(x) for x in side]) for side in (a, b))
        a_ids, b_ids = (np.fromiter((i for x in side for i in x), np.int64) for side in (a, b))
        a_group, b_group, groups, overlaps, shared = align(self.pair.a_size[a_ids], self.pair.b_size[b_ids])
        unit_of_group = np.zeros(groups, np.int64)
        unit_of_group[a_group] = a_unit
        per_token, per_shared = np.diff(overlaps.indptr), np.diff(shared.indptr)
        count = len(units)
        measures = np.stack([valid.astype(np.int64), np.bincount(a_unit, minlength=count), np.bincount(b_unit, minlength=count),
                             np.bincount(unit_of_group, minlength=count),
                             np.bincount(a_unit, per_token, minlength=count).astype(np.int64),
                             np.bincount(a_unit, per_shared, minlength=count).astype(np.int64)], axis=1)
        self.strings += _group_texts(a_ids, a_group, b_ids, b_group, unit_of_group, count)
        pairs = np.repeat(a_ids, per_token) << 32 | b_ids[overlaps.indices]
        return measures, pairs, measures[:, 4]


def _group_texts(a_ids, a_group, b_ids, b_group, unit_of_group, units: int) -> list[str]:
    """``a1,a2|b1;a3|b2`` of each unit."""
    sides = []
    for ids, group in ((a_ids, a_group), (b_ids, b_group)):
        bounds = np.searchsorted(group, np.arange(len(unit_of_group) + 1)).tolist()
        names = list(map(str, ids.tolist()))
        sides.append([",".join(names[s:e]) for s, e in zip(bounds, bounds[1:])])
    texts = [f"{x}|{y}" for x, y in zip(*sides)]
    bounds = np.searchsorted(unit_of_group, np.arange(units + 1)).tolist()
    return [";".join(texts[s:e]) for s, e in zip(bounds, bounds[1:])]


def _packed(x: np.ndarray) -> bytes:
    """Small whole numbers, a plane a byte, compressed."""
    return zstandard.ZstdCompressor(_ZSTD).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


_HEAD = pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                   ("n_shared", pa.int64()), ("groups_sha256", pa.string())])
_HEAD_DDL = ("array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,n_shared:long,groups_sha256:string>>")
_BLOCK = f"block long, heads {_HEAD_DDL}, pairs array<long>, held array<int>, sizes binary, steps binary, times binary"


def _block(units: Units, ids: list, texts: list[str]) -> list:
    """The columns of one block after its number."""
    codes = [list(units.codes(t)) if t else [] for t in texts]
    units.learn()
    heads, doc_of, unit_of, times = [], [], [], []
    for doc, (doc_id, parts) in enumerate(zip(ids, codes)):
        total = np.sum([units.measures[c].sum(axis=0) for c in parts], axis=0) if parts else np.zeros(6, np.int64)
        if not parts or total[0] < sum(map(len, parts)):
            heads.append((doc_id, 0, 0, 0, 0, 0, ""))
            continue
        digest, names = hashlib.sha256(), units.strings
        for i, part in enumerate(parts):
            digest.update((";" if i else "").encode() + ";".join([names[c] for c in part.tolist()]).encode())
        heads.append((doc_id, *total[1:].tolist(), digest.hexdigest()))
        distinct, counts = np.unique(np.concatenate(parts), return_counts=True)
        doc_of.append(np.full(len(distinct), doc))
        unit_of.append(distinct)
        times.append(counts)
    if not doc_of:
        empty = _packed(np.empty(0, np.int64))
        return [heads, np.empty(0, np.int64), np.empty(0, np.int32), _packed(np.zeros(len(ids))), empty, empty]
    doc_of, unit_of, times = np.concatenate(doc_of), np.concatenate(unit_of), np.concatenate(times)
    # The block's distinct pairs, and each of its units' links as places among them.
    used, place = np.unique(unit_of, return_inverse=True)
    sizes = units.link_ptr[used + 1] - units.link_ptr[used]
    pairs, link = np.unique(units.links[ranges(units.link_ptr[used], sizes)], return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    each = sizes[place]
    key = np.repeat(doc_of, each) * len(pairs) + link[ranges(starts[place], each)]
    order = np.argsort(key, kind="stable")
    key, weight = key[order], np.repeat(times, each)[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key, weight = key[first], np.add.reduceat(weight, first)
    doc, pair = key // len(pairs), key % len(pairs)
    step = np.diff(pair, prepend=0)
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    step[new] = pair[new]
    return [heads, pairs, np.bincount(pair, minlength=len(pairs)).astype(np.int32),
            _packed(np.bincount(doc, minlength=len(ids))), _packed(step), _packed(weight)]


def _blocks(a_path: str, b_path: str, block_bytes: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        pair = load(a_path, b_path)
        units, number = Units(pair), TaskContext.get().partitionId() << 32
        for part in slices(_joined(batches, block_bytes), "text", block_bytes):
            if len(units.index) > TABLE_UNITS:
                units = Units(pair)
            heads, *rest = _block(units, part.column("doc_id").to_pylist(), part.column("text").to_pylist())
            heads = pa.array([dict(zip((f.name for f in _HEAD), h)) for h in heads], _HEAD)
            columns = [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(heads)], pa.int32()), heads)]
            for x in rest:
                columns.append(pa.array([x], pa.binary()) if isinstance(x, bytes) else
                               pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)))
            yield pa.RecordBatch.from_arrays(columns, ["block", "heads", "pairs", "held", "sizes", "steps", "times"])
            number += 1
    return run


def _joined(batches, least: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold ``least`` bytes."""
    waiting, size = [], 0
    for batch in batches:
        waiting.append(batch)
        size += batch.nbytes
        if size >= least:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
            waiting, size = [], 0
    if waiting:
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()


def blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Aligned texts by blocks, written to the shared folder."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return materialize(texts.mapInArrow(_blocks(a_path, b_path, block_bytes), _BLOCK), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, pair, documents, best): id pairs, how many documents hold them linked, and whether that is the most of a."""
    counted = (aligned.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).groupBy(F.col("x.pairs").alias("pair"))
               .agg(F.sum("x.held").alias("documents")))
    named = counted.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "pair", "documents")
    # A group holds at most one row an id of the other vocabulary.
    return named.withColumn("best", F.col("documents") == F.max("documents").over(Window.partitionBy("a")))


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, n_best long, count_sum long"


def _finish(block: pa.Table, found: pa.Table) -> pa.Table:
    """Counts of a block's pairs, summed over each document's links."""
    order = np.argsort(found.column("pair").to_numpy())
    score = found.column("score").to_numpy()[order]
    parts = []
    for row in range(block.num_rows):
        heads = block.column("heads").combine_chunks()[row].values
        sizes, steps, times = (_unpacked(block.column(c)[row].as_py()) for c in ("sizes", "steps", "times"))
        ends = np.cumsum(sizes)
        total = np.cumsum(steps)
        before = np.concatenate([[0], total])[ends - sizes]  # what the documents ahead add to the running place
        place = total - np.repeat(before, sizes)
        sums = [np.concatenate([[0], np.cumsum(times * x[place])]) if len(place) else np.zeros(1, np.int64) for x in (score & 1, score >> 1)]
        columns = [heads.field(i) for i in range(heads.type.num_fields)] + [pa.array(s[ends] - s[ends - sizes], pa.int64()) for s in sums]
        parts.append(pa.Table.from_arrays(columns, [f.name for f in _HEAD] + ["n_best", "count_sum"]))
    return pa.concat_tables(parts) if parts else pa.table({c.split()[0]: pa.array([], pa.string() if "string" in c else pa.int64())
                                                           for c in _RESULT.split(", ")})


def align_texts(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a document: tokens, groups and links of both tokenizers, and the corpus counts of its links.

    n_links are overlapping occurrences, n_shared pairs of one group; n_best and
    count_sum read ``pair_counts``.
    """
    aligned = blocks(docs, a_path, b_path, id_col, text_col, block_bytes)
    scores = pair_counts(aligned).select("pair", (F.col("documents") * 2 + F.col("best").cast("long")).alias("score"))
    wanted = aligned.select("block", F.explode("pairs").alias("pair"))
    found = wanted.join(scores, "pair").select(F.col("block").alias("of"), "pair", "score")
    bodies = aligned.select("block", "heads", "sizes", "steps", "times")
    return bodies.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(_finish, _RESULT)
