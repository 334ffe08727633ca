import numpy as np
import pytest
from samples import ODD_TEXTS, frame, prose

from tallyframe.llm import suffix_arrays, suffix_dedup


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(0)
    strings = [bytes(rng.integers(97, 99, rng.integers(1, 60)).tolist()) for _ in range(40)] + [b"", b"\0\0", b"a" * 90]
    symbols, starts = suffix_arrays.lay_out(strings)
    for depth in (3, 7, 20, 33):
        order = suffix_arrays.suffix_array(symbols, depth)
        common = suffix_arrays.common_prefixes(symbols, starts, order, depth)
        padded = [*symbols.tolist(), *[0] * depth]
        keys = [tuple(padded[i:i + depth]) for i in order]
        assert keys == sorted(keys) and sorted(order) == list(range(len(symbols)))
        for j in range(1, len(order)):
            n = next((x for x in range(depth) if keys[j][x] != keys[j - 1][x]), depth)
            assert common[j] == n


def plain(rows, window=100):
    """Rows with one id and text are one document."""
    from tallyframe.llm.suffix_dedup import _NO_ID
    seen, out = set(), {}
    for i, text in sorted(set(rows), key=lambda r: _NO_ID if r[0] is None else r[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - window + 1):
            if data[p:p + window] in seen:
                gone[p:p + window] = True
            seen.add(data[p:p + window])
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(data) else 0
        out[i, text or ""] = (len(data), int(gone.sum()), spans, bytes(np.frombuffer(data, np.uint8)[~gone]))
    return out


def check(spark, rows):
    want = plain(rows)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()]
    expected = [(i, *want[i, t or ""]) for i, t in rows]
    order = lambda r: (r[0] is not None, r[0] or 0, r[4])
    assert sorted(got, key=order) == sorted(expected, key=order)


PASSAGE = prose(60, 77)
PLANTED = [(100 + i, prose(30, 200 + i) + " " + PASSAGE[i % 3:] + (" same end " if i % 2 else "") + prose(20, 300 + i)) for i in range(60)]
CASES = ODD_TEXTS + PLANTED + [(500, "ab" * 300), (501, "xyz" + "ab" * 80), (502, (PASSAGE + "\n") * 4)]


def test_removed_bytes_match_brute_force(spark):
    check(spark, CASES)


def test_hashes_spread_over_shards_merge(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(suffix_dedup, "BLOCKS_PER_SHARD", 2)
    monkeypatch.setattr(suffix_dedup, "_PIECE", 700)
    check(spark, CASES)


def test_a_short_rest_behind_the_last_piece_hides_nothing(monkeypatch):
    text = np.frombuffer(prose(400, 6).encode(), np.uint8)
    for rest in (*range(1, 100), 100, 130, 699):
        data = np.concatenate([text[:600 + rest], text[rest:rest + 100]])  # 700 bytes and the rest, the end stands twice
        data[600:600 + rest] ^= 1
        data[-100:] = data[150:250]
        want = suffix_dedup.window_runs(data, np.array([len(data)]))
        with monkeypatch.context() as m:
            m.setattr(suffix_dedup, "_PIECE", 700)
            got = suffix_dedup.window_runs(data, np.array([len(data)]))
        assert all((a == b).all() if a.shape == b.shape else False for a, b in zip(want, got, strict=True)), rest
        assert len(want[3])


def test_merge_keeps_the_earliest_window():
    import pyarrow as pa
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 40, 90).astype(np.uint64)
    doc = np.arange(90)
    rng.shuffle(doc)
    parts = []
    for g in np.split(np.arange(90), [30, 60]):
        _, first = np.unique(keys[g], return_index=True)
        g = g[first]
        zero = np.zeros(len(g), np.int64)
        parts.append(suffix_dedup.pack_arrays(keys[g], keys[g], doc[g].view(np.uint64), zero, zero, doc[g], zero))
    sent = {int(b) for p in parts for b in suffix_dedup.unpack_arrays(p)[5]}
    gone = set(suffix_dedup.merge_shards(pa.table({"firsts": pa.array(parts, pa.binary())})).column("block").to_pylist())
    by_doc = dict(zip(doc.tolist(), keys.tolist()))
    best = {k: min(d for d in sent if by_doc[d] == k) for k in {by_doc[d] for d in sent}}
    assert gone == sent - set(best.values())


def test_whole_characters_stay_valid(spark):
    rows = [(1, "é" * 80 + "x" + "漢" * 60), (2, "q" + "é" * 80 + "y" + "漢" * 60)]
    for r in suffix_dedup.remove_repeats(frame(spark, rows), whole_characters=True).collect():
        bytes(r.kept).decode()


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, ""), (None, "")]])
def test_nothing_to_judge(spark, rows):
    check(spark, rows)


def test_rows_of_blocks_are_not_broadcast(spark, monkeypatch):
    plans, plain_write = {}, suffix_dedup.materialize

    def noting(df, label, *more):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return plain_write(df, label, *more)
    monkeypatch.setattr(suffix_dedup, "materialize", noting)
    check(spark, CASES + [(700 + i, PASSAGE) for i in range(5)])
    assert "SortMergeJoin" in plans["repeats"] and "Broadcast" not in plans["repeats"]
