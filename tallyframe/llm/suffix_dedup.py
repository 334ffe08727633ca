"""Repeated passages: every byte covered by a string of ``WINDOW`` bytes that also starts earlier.

Earlier means a smaller doc_id, or an earlier start in the same document. All
whole texts are judged as given, overlaps included, in these steps:

1. Texts become blocks. The smallest hash of the ``GRAM``-byte strings inside a
   window of ``WINDOW`` bytes is the same wherever the window occurs, and is shared
   by runs of neighbouring windows. Each block reports its distinct hashes, and
   only hashes that occur twice can belong to repeated windows.
2. Whole copies of an earlier text are settled by their hashes. Of the other texts,
   the bytes of runs with such a hash, each distinct string of a block once and
   packed by shard, go to the shard of their hash, so equal windows meet there.
3. Every shard builds the suffix array of its strings by Larsson-Sadakane
   refinement and common prefixes by Kasai; suffixes that share ``WINDOW`` bytes are
   one window, and all but its first occurrence are removed.
4. A hash found in many blocks is spread over several shards. Each sends the
   fingerprints of its windows in sorted order, cut into ranges, and the ranges of
   all shards are merged by binary search.
5. Removed windows go back to their block, which cuts the covered bytes.

Defined results: null and empty texts have no bytes; a null doc_id comes before
all others; rows that share doc_id and text are one document and lose the same
bytes; of different texts with one doc_id an arbitrary but fixed one comes first;
other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.llm.blocks import pack, unpack
from tallyframe.llm.suffix_arrays import common_prefixes, lay_out, suffix_array
from tallyframe.llm.words import mix, slices
from tallyframe.session import materialize

WINDOW, GRAM = 100, 32
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 4 << 20
#: An h that more blocks than this share is spread over several shards.
BLOCKS_PER_SHARD = 256
_PIECE = 1 << 19
_RUN = 256
_SORT_BYTES = 1 << 20
_SPAN = WINDOW - GRAM + 1
_NO_ID = -(1 << 63)
_TABLES = [mix(np.arange(256, dtype=np.uint64) + np.uint64(256 * k + 1)) for k in (1, 2)]
_FACTORS = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
_BLOCK = "block long, ids array<long>, ties array<long>, others array<long>, sizes array<long>, data binary"
_RUNS = "shard long, salt int, block long, data binary, texts binary"
_REMOVED = "block long, data binary, h long, part int, firsts binary"


def pack_arrays(*arrays: np.ndarray) -> bytes:
    parts = [pack(a) for a in arrays]
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unpack_arrays(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at:at + 8], "little")
        out.append(unpack(data[at + 8:at + 8 + n]))
        at += 8 + n
    return out


def string_hashes(data: np.ndarray, length: int, kind: int = 0) -> np.ndarray:
    """Hash of the ``length`` bytes from every position that has so many."""
    factor, word = _FACTORS[kind], (1 << 64) - 1
    have, powers = {1: _TABLES[kind][data]}, {1: factor}
    size = 1
    while size * 2 <= length:
        a = have[size]
        have[size * 2] = a[:-size] * np.uint64(powers[size]) + a[size:]
        powers[size * 2] = powers[size] * powers[size] & word
        size *= 2
    out, done = np.zeros(max(0, len(data) - length + 1), np.uint64), 0
    for size in sorted(have, reverse=True):
        while length - done >= size:
            out = out * np.uint64(powers[size]) + have[size][done:done + len(out)]
            done += size
    return out


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` neighbours."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while have * 2 <= width:
        out, have = pick(out[:-have], out[have:]), have * 2
    rest = width - have
    return pick(out[:len(out) - rest], out[rest:]) if rest else out


def window_runs(data: np.ndarray, sizes: np.ndarray, points: bool = True) -> tuple[np.ndarray, ...]:
    """(first position, windows, hash) of runs of windows with one smallest hash; with
    ``points`` also the hashes that are smallest at two places, and those of them that
    are so at two places close to each other.

    Windows never leave their text; a run has at most ``_RUN`` windows. Work goes
    piece by piece, so only runs are held for the whole block.
    """
    ends = np.cumsum(sizes)
    whole = sizes >= WINDOW
    opens, closes = (ends - sizes)[whole], (ends - WINDOW + 1)[whole]
    starts, hashes, places, values = [], [], [], []
    before, last = np.zeros(_SPAN - 1, np.uint64), np.uint64(0)
    windows = max(0, len(data) - WINDOW + 1)
    for a in range(0, windows, _PIECE):
        grams = string_hashes(data[a:a + _PIECE + WINDOW - 1], GRAM)
        grams ^= grams >> np.uint64(31)
        grams *= np.uint64(0x94D049BB133111EB)
        grams |= np.uint64(1)  # 0 stands for no window
        low = _sliding(grams, _SPAN, np.minimum)
        change = np.zeros(len(low) + 1, np.int8)
        first, over = np.searchsorted(closes, a, "right"), np.searchsorted(opens, a + len(low))
        np.add.at(change, np.maximum(opens[first:over] - a, 0), 1)
        np.add.at(change, np.minimum(closes[first:over] - a, len(low)), -1)
        low = np.where(np.cumsum(change[:-1], dtype=np.int8) > 0, low, np.uint64(0))
        if len(low):
            new = np.flatnonzero(low != np.concatenate([[last], low[:-1]]))
            starts.append(new + a)
            hashes.append(low[new])
            last = low[-1]
        if points:
            near = np.concatenate([before, low, np.zeros((a + _PIECE >= windows) * (_SPAN - 1), np.uint64)])
            before = near[len(low):len(low) + _SPAN - 1]
            top = _sliding(near, _SPAN, np.maximum)[:len(grams)]
            at = np.flatnonzero((top == grams[:len(top)]) & (top > 0))
            places.append(at + a)
            values.append(top[at])
    at = np.concatenate([np.zeros(0, np.int64), *starts])
    h = np.concatenate([np.zeros(0, np.uint64), *hashes])
    n = np.diff(np.append(at, windows))
    at, h, n = at[h > 0], h[h > 0], n[h > 0]
    cuts = -(-n // _RUN)
    piece = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    runs = np.repeat(at, cuts) + piece * _RUN, np.minimum(np.repeat(n, cuts) - piece * _RUN, _RUN), np.repeat(h, cuts)
    if not points:
        return runs
    place, value = np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate([np.zeros(0, np.uint64), *values])
    close = (value[1:] == value[:-1]) & (np.diff(place) <= _SPAN)
    own, count = np.unique(value, return_counts=True)
    return *runs, own[count > 1], np.unique(value[1:][close])


def _make_blocks(batches) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", BLOCK_BYTES):
        texts = part.column("text").cast(pa.binary()).to_pylist()
        data = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
        yield pa.RecordBatch.from_arrays(
            [pa.array([uuid.uuid4().int >> 65]), *[pa.array([x]) for x in (
                part.column("doc_id").to_pylist(), part.column("tie").to_pylist(), part.column("other").to_pylist(),
                [len(t) for t in texts], data)]], ["block", "ids", "ties", "others", "sizes", "data"])


def _open(row: dict) -> tuple[np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(row["data"]) if sum(row["sizes"]) else b""
    return np.frombuffer(data, np.uint8), np.array(row["sizes"], np.int64)


def _block_hashes(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            _, _, h = window_runs(*_open(row), points=False)
            h = np.unique(h).view(np.int64)
            for a in range(0, len(h), 1 << 16):
                part = h[a:a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), row["block"]))], ["h", "block"])


def _places(doc: np.ndarray, tie: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A number for each (document, start) that orders like it."""
    order = np.lexsort((tie, doc))
    new = np.ones(len(order), np.int64)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (tie[order][1:] != tie[order][:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return (rank << 40) + start


def _numbered(texts: list[bytes], place: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct texts, number of each, first place of every distinct text)."""
    ids: dict[bytes, int] = {}
    which = np.fromiter((ids.setdefault(t, len(ids)) for t in texts), np.int64, len(texts))
    first = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(first, which, place)
    return list(ids), which, first


def _extract(shards: int):
    def extract(left: pa.Table, right: pa.Table) -> pa.Table:
        """The strings of a block that may repeat, and what is removed already."""
        out: list[tuple] = []
        told_h, told_n = right.column("h").to_numpy(), right.column("blocks").to_numpy()
        copies = told_h[told_n < 0]
        shared, blocks = told_h[told_n > 0].view(np.uint64), told_n[told_n > 0]
        order = np.argsort(shared)
        shared, blocks = shared[order], blocks[order]
        for block in left.to_pylist():
            data, sizes = _open(block)
            at, n, h, repeated, close = window_runs(data, sizes)
            spread = np.zeros(len(h), np.int64)
            if len(shared):
                slot = np.minimum(np.searchsorted(shared, h), len(shared) - 1)
                spread = np.where(shared[slot] == h, -(-blocks[slot] // BLOCKS_PER_SHARD), 0)
            row = np.searchsorted(np.cumsum(sizes), at, "right")
            take = np.flatnonzero(((spread > 0) | np.isin(h, repeated)) & ~np.isin(row, copies))
            at, n, h, row, spread = at[take], n[take], h[take].view(np.int64), row[take], np.maximum(spread[take], 1)
            near = np.isin(h.view(np.uint64), close)
            start = at - (np.cumsum(sizes) - sizes)[row]
            raw = data.tobytes()
            texts = [raw[p:z] for p, z in zip(at.tolist(), (at + n + WINDOW - 1).tolist())]
            ids, ties = np.array(block["ids"], np.int64), np.array(block["ties"], np.int64)
            place = _places(ids[row], ties[row], start)
            _, which, first = _numbered(texts, place)
            leads = place == first[which]
            late = np.flatnonzero(~leads)
            whole = np.sort(copies)
            gone = pack_arrays(np.concatenate([row[late], whole]), np.concatenate([start[late], np.zeros(len(whole), np.int64)]),
                               np.concatenate([n[late], sizes[whole] - WINDOW + 1]))
            if len(late) or len(whole):
                out.append((block["block"] % shards, -1, block["block"], gone, None))
            lead = np.flatnonzero(leads)
            salt = np.full(len(lead), -1, np.int64)
            for k in np.flatnonzero(spread[lead] > 1).tolist():
                salt[k] = xxhash.xxh64_intdigest(texts[lead[k]]) % int(spread[lead[k]])
            shard = np.where(spread[lead] > 1, h[lead], h[lead] % shards)
            order = np.lexsort((salt, shard))
            lead, shard, salt = lead[order], shard[order], salt[order]
            edges = np.flatnonzero(np.append(True, (np.diff(shard) != 0) | (np.diff(salt) != 0))) if len(lead) else []
            for k, z in zip(edges, [*edges[1:], len(lead)]):
                g = lead[k:z]
                docs, own = np.unique(row[g], return_inverse=True)
                packed = pack_arrays(h[g].view(np.uint64), spread[g], near[g], own, start[g], n[g], docs,
                                     ids[docs].view(np.uint64), ties[docs].view(np.uint64))
                joined = zstandard.ZstdCompressor(level=1).compress(b"".join([texts[i] for i in g.tolist()]))
                out.append((int(shard[k]), int(salt[k]), block["block"], packed, joined))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        columns = list(zip(*out)) if out else [()] * len(kinds)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in _RUNS.split(", ")])
    return extract


def _unpack_runs(group: pa.Table) -> tuple:
    """Columns of all packed runs of a shard, and their strings."""
    parts, texts = [], []
    for block, data, joined in zip(*(group.column(c).to_pylist() for c in ("block", "data", "texts"))):
        h, spread, near, own, start, n, docs, ids, ties = unpack_arrays(data)
        docs, ids, ties = docs.astype(np.int64), ids.astype(np.uint64).view(np.int64), ties.astype(np.uint64).view(np.int64)
        parts.append((np.full(len(h), block), docs[own], ids[own], ties[own], start, h.astype(np.uint64).view(np.int64), spread, near > 0))
        raw = zstandard.ZstdDecompressor().decompress(joined)
        ends = np.cumsum(n + WINDOW - 1)
        texts.extend(raw[a:z] for a, z in zip((ends - n - WINDOW + 1).tolist(), ends.tolist()))
    return (*(np.concatenate(c) for c in zip(*parts)), texts)


def _intervals(removed: np.ndarray, text: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first offset, length) of runs of neighbouring removed windows."""
    text, offset = text[removed], offset[removed]
    order = np.lexsort((offset, text))
    text, offset = text[order], offset[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (offset[1:] != offset[:-1] + 1)
    first = np.flatnonzero(new)
    return text[first], offset[first], np.diff(np.append(first, len(text)))


def _by_block(block: np.ndarray, row: np.ndarray, start: np.ndarray, n: np.ndarray) -> list[tuple]:
    """Removed rows: one per block, its runs packed."""
    order = np.argsort(block, kind="stable")
    edges = np.flatnonzero(np.append(True, np.diff(block[order]) != 0)) if len(block) else []
    return [(int(block[g[0]]), pack_arrays(row[g], start[g], n[g]), None, None, None) for g in np.split(order, edges[1:])] if len(block) else []


def _removed_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]
    columns = list(zip(*rows)) if rows else [()] * 5
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["block", "data", "h", "part", "firsts"])


def find_repeats(group: pa.Table) -> pa.Table:
    """The removed windows of one shard; first windows of spread hashes go on to the merge."""
    told = group.filter(pc.is_null(group.column("texts")))
    out = [(b, d, None, None, None) for b, d in zip(told.column("block").to_pylist(), told.column("data").to_pylist())]
    group = group.filter(pc.is_valid(group.column("texts")))
    if not len(group):
        return _removed_table(out)
    block, row, doc, tie, start, h, spread, near, texts = _unpack_runs(group)
    place = _places(doc, tie, start)
    ids, which, first = _numbered(texts, place)
    leads = place == first[which]
    windows = np.array([len(t) - WINDOW + 1 for t in ids], np.int64)
    late = np.flatnonzero(~leads)
    gone = [(block[late], row[late], start[late], windows[which[late]])]
    code = np.zeros(len(ids), np.int64)
    code[which] = h
    parts = np.ones(len(ids), np.int64)
    parts[which] = spread
    # A string alone with its hash shares no window, unless that hash comes again close by.
    _, inverse, count = np.unique(code, return_inverse=True, return_counts=True)
    close = np.zeros(len(ids), bool)
    close[which[near]] = True
    sizes = windows + WINDOW
    lead_rows = np.flatnonzero(leads)
    lead_rows = lead_rows[np.argsort(which[lead_rows], kind="stable")]
    chosen = np.flatnonzero((count[inverse] > 1) | (parts > 1) | close)
    chosen = chosen[np.argsort(code[chosen], kind="stable")]
    # Equal windows have one hash, so whole hashes can be sorted part by part.
    edges = np.flatnonzero(np.append(True, np.diff(code[chosen]) != 0)) if len(chosen) else np.zeros(0, np.int64)
    batch = (np.cumsum(sizes[chosen]) - sizes[chosen])[edges] // _SORT_BYTES
    for own in np.split(chosen, edges[1:][np.diff(batch) > 0]):
        if not len(own):
            continue
        symbols, begins = lay_out([ids[c] for c in own])
        order = suffix_array(symbols, WINDOW)
        common = common_prefixes(symbols, begins, order, WINDOW)
        text = np.searchsorted(begins, order, "right") - 1
        offset = order - begins[text]
        valid = offset < windows[own[text]]
        key = first[own[text]] + offset
        group_of = np.cumsum(common < WINDOW) - 1
        text, offset, key, group_of = text[valid], offset[valid], key[valid], group_of[valid]
        heads = np.flatnonzero(np.append(True, np.diff(group_of) != 0))
        lowest = np.repeat(np.minimum.reduceat(key, heads), np.diff(np.append(heads, len(key))))
        t, o, n = _intervals(key > lowest, own[text], offset)
        left, right = np.searchsorted(which[lead_rows], t, "left"), np.searchsorted(which[lead_rows], t, "right")
        many = right - left
        at = lead_rows[np.repeat(left - np.cumsum(many) + many, many) + np.arange(many.sum())]
        gone.append((block[at], row[at], start[at] + np.repeat(o, many), np.repeat(n, many)))
        going_on = (key == lowest) & (parts[own[text]] > 1)
        if going_on.any():
            raw = (np.maximum(symbols, 1) - 1).astype(np.uint8)
            ends = begins[text[going_on]] + offset[going_on]
            owner = lead_rows[np.searchsorted(which[lead_rows], own[text[going_on]])]
            out += _send_on(string_hashes(raw, WINDOW)[ends], string_hashes(raw, WINDOW, 1)[ends], h[owner], spread[owner],
                            doc[owner], tie[owner], start[owner] + offset[going_on], block[owner], row[owner])
    return _removed_table(out + _by_block(*(np.concatenate(c) for c in zip(*gone))))


def _send_on(one, two, h, spread, doc, tie, start, block, row) -> list[tuple]:
    """Rows for the merge: by hash and range, windows in the order of their fingerprints."""
    part = (two % spread.astype(np.uint64)).astype(np.int64)
    order = np.lexsort((one, part, h))
    edges = np.flatnonzero(np.append(True, (np.diff(h[order]) != 0) | (np.diff(part[order]) != 0)))
    rows = []
    for g in np.split(order, edges[1:]):
        fields = [one[g], two[g], doc[g].view(np.uint64), tie[g].view(np.uint64), start[g], block[g], row[g]]
        rows.append((None, None, int(h[g[0]]), int(part[g[0]]), pack_arrays(*fields)))
    return rows


def merge_shards(group: pa.Table) -> pa.Table:
    """Windows that come first in their shard but not over all shards.

    The merged list stays sorted by fingerprint; every further shard is looked up
    in it by binary search, the earlier window of two equal ones stays in it.
    """
    merged, gone = None, []
    for data in group.column("firsts").to_pylist():
        one, two, doc, tie, start, block, row = unpack_arrays(data)
        new = [one.astype(np.uint64), two.astype(np.uint64), doc.astype(np.uint64).view(np.int64), tie.astype(np.uint64).view(np.int64),
               start.astype(np.int64), block.astype(np.int64), row.astype(np.int64)]
        if merged is None:
            merged = new
            continue
        at = np.searchsorted(merged[0], new[0])
        slot = np.minimum(at, len(merged[0]) - 1)
        same = (merged[0][slot] == new[0]) & (merged[1][slot] == new[1])
        a, b = [m[slot[same]] for m in merged], [x[same] for x in new]
        earlier = np.zeros(len(a[0]), bool)
        equal = np.ones(len(a[0]), bool)
        for k in (2, 3, 4):
            earlier |= equal & (b[k] < a[k])
            equal &= b[k] == a[k]
        for losers, mask in ((a, earlier), (b, ~earlier & ~equal)):
            gone.append([x[mask] for x in losers[4:]])
        for k in range(2, 7):
            merged[k][slot[same][earlier]] = b[k][earlier]
        merged = [np.insert(m, at[~same], x[~same]) for m, x in zip(merged, new)]
    if not gone:
        return _removed_table([])
    start, block, row = (np.concatenate(c) for c in zip(*gone))
    return _removed_table(_by_block(block, row, start, np.ones(len(start), np.int64)))


def _cutter(whole_characters: bool):
    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        """What is left of every text of a block."""
        tables = []
        told = [unpack_arrays(d) for d in right.column("data").to_pylist()]
        for block in left.to_pylist():
            data, sizes = _open(block)
            ends = np.cumsum(sizes)
            change = np.zeros(len(data) + 1, np.int32)
            for row, start, n in told:
                at = (ends - sizes)[row.astype(np.int64)] + start.astype(np.int64)
                np.add.at(change, at, 1)
                np.add.at(change, at + n.astype(np.int64) + WINDOW - 1, -1)
            removed = np.cumsum(change[:-1]) > 0
            if whole_characters and len(data):
                heads = np.flatnonzero((data & 0xC0) != 0x80)
                removed = np.repeat(np.logical_and.reduceat(removed, heads), np.diff(np.append(heads, len(data))))
            begins = removed.copy()
            begins[1:] &= ~removed[:-1]
            text_starts = (ends - sizes)[sizes > 0]
            begins[text_starts] = removed[text_starts]
            totals = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[np.concatenate([[0], ends])])
            n_removed, n_spans = totals(removed), totals(begins)
            kept = data[~removed].tobytes()
            cuts = np.concatenate([[0], np.cumsum(sizes - n_removed)])
            tables.append(pa.table(
                [pa.array(block["ids"], pa.int64()), pa.array(block["ties"], pa.int64()), pa.array(sizes), pa.array(n_removed.astype(np.int64)),
                 pa.array(n_spans.astype(np.int64)), pa.array([kept[a:z] for a, z in zip(cuts[:-1], cuts[1:])], pa.binary())],
                ["doc_id", "tie", "n_bytes", "n_removed", "n_spans", "kept"]))
        return pa.concat_tables(tables)
    return cut


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_characters: bool = False) -> DataFrame:
    """(doc_id, tie, n_bytes, n_removed, n_spans, kept): ``kept`` are the remaining bytes.

    ``tie`` is a hash of the text. With ``whole_characters`` a character goes only
    if all its bytes are covered, so that ``kept`` stays valid UTF-8.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NO_ID)).alias("doc_id"),
                       F.xxhash64(text).alias("tie"), F.xxhash64(F.lit(WINDOW), text).alias("other"), text.alias("text"))
    blocks = materialize(rows.mapInArrow(_make_blocks, _BLOCK), "text-blocks", "zstd")
    total = blocks.select(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).agg(F.sum("n")).first()[0]
    shards = max(1, -(-(total or 0) // SHARD_BYTES))
    hashes = blocks.mapInArrow(_block_hashes, "h long, block long")
    shared = (hashes.withColumn("blocks", F.count("*").over(Window.partitionBy("h")).cast("int"))
              .where("blocks > 1").select("block", "h", "blocks"))
    # Of the copies of a text all but the first are settled: (block, row as h, -1). The join
    # is by merge: Spark's size of exploded rows is a share of the compressed blocks.
    rows_of = blocks.select("block", F.posexplode(F.arrays_zip("ids", "ties", "others", "sizes")).alias("h", "r"))
    rows_of = rows_of.where(F.col("r.sizes") >= WINDOW).select("block", F.col("h").cast("long").alias("h"), "r.*")
    same = ["ties", "others", "sizes"]
    first = rows_of.groupBy(*same).agg(F.min("ids").alias("low"), F.max("ids").alias("high")).where("low < high").drop("high")
    copies = rows_of.hint("merge").join(first, same).where("ids > low").select("block", "h", F.lit(-1).alias("blocks"))
    runs = blocks.groupBy("block").cogroup(shared.unionByName(copies).groupBy("block")).applyInArrow(_extract(shards), _RUNS)
    found = materialize(runs.groupBy("shard", "salt").applyInArrow(find_repeats, _REMOVED), "repeats")
    merged = found.where("h IS NOT NULL").groupBy("h", "part").applyInArrow(merge_shards, _REMOVED)
    removed = found.where("block IS NOT NULL").unionByName(merged).select("block", "data")
    cut = blocks.groupBy("block").cogroup(removed.groupBy("block")).applyInArrow(
        _cutter(whole_characters), "doc_id long, tie long, n_bytes long, n_removed long, n_spans long, kept binary")
    return cut.withColumn("doc_id", F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")))
