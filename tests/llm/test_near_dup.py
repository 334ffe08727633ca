import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from samples import ODD_TEXTS, WORD, ascii_lower, frame, prose, shingles

from tallyframe.llm import near_dup as n
from tallyframe.llm.components import components
from tallyframe.session import materialize


def classes_by_brute_force(rows):
    ids = sorted({i for i, _ in rows}, key=lambda i: (i is not None, i or 0))
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9:
                x, y = sorted((root(i), root(j)), key=lambda r: (r is not None, r or 0))
                parent[y] = x
    return {i: root(i) for i in ids}


def edited(text, share, seed):
    rng = random.Random(seed)
    return " ".join("edit" + str(rng.randint(0, 9999)) if rng.random() < share else w for w in text.split())


def group_of_copies(seed, count, words=200):
    text = prose(words, seed)
    return [(seed * 1000 + i, edited(text, 0.004 * (i % 12), seed * 77 + i)) for i in range(count)]


ROWS = ODD_TEXTS + [(50, "THE SAME  words\nhere now yes"), (51, "the same words here now yes")]


def test_classes_match_brute_force(spark):
    rows = ROWS + group_of_copies(1, 60) + group_of_copies(2, 30, 60) + [(9000 + i, prose(100, i)) for i in range(100)]
    got = {r.doc_id: r.class_id for r in n.near_duplicates(frame(spark, rows)).collect()}
    assert got == classes_by_brute_force(rows)


def test_large_groups_are_compared_in_blocks(spark):
    rows = group_of_copies(3, 90)
    got = {r.doc_id: r.class_id for r in n.near_duplicates(frame(spark, rows), block=16).collect()}
    assert got == classes_by_brute_force(rows)


def test_repeated_passages_do_not_hide_equal_shingle_sets(spark):
    cycle, rest = prose(100, 31) + " ", prose(20, 32)
    rows = [(1, cycle * 2 + rest), (2, cycle * 1000 + rest), (3, rest * 1 + " " + prose(180, 33)), (4, (rest + " ") * 1000 + rest + " " + prose(180, 33))]
    want = classes_by_brute_force(rows)
    assert want[2] == 1
    got = {r.doc_id: r.class_id for r in n.near_duplicates(frame(spark, rows)).collect()}
    assert got == want


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(2)
    h = np.unique(rng.integers(1, 1 << 48, 400).astype(np.uint64))
    a, b = {int(x): 1 + i % 4 for i, x in enumerate(h[:300])}, {int(x): 1 + i % 3 for i, x in enumerate(h[100:])}
    want = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())
    keys = np.array([*sorted(a), *sorted(b)], np.uint64)
    weights = np.array([*(a[int(x)] for x in sorted(a)), *(b[int(x)] for x in sorted(b))], float)
    who = n.prob_min_hash(keys, weights, np.array([0, len(a), len(a) + len(b)]), registers=4096)
    assert abs((who[0] == who[1]).mean() - want) < 0.03
    scaled = n.prob_min_hash(keys, weights * np.repeat([1, 7], [len(a), len(b)]), np.array([0, len(a), len(a) + len(b)]), 4096)
    assert (scaled == who).all()


def test_one_of_each_class_stays(spark):
    rows = ROWS + group_of_copies(1, 20)
    want = classes_by_brute_force(rows)
    kept = [r.doc_id for r in n.keep_one(frame(spark, rows)).collect()]
    order = lambda i: (i is not None, i or 0)
    assert sorted(kept, key=order) == sorted(set(want.values()), key=order)


def test_rows_of_one_or_no_id_are_told_apart(spark):
    one, two = prose(80, 41), prose(80, 42)
    rows = [(None, one), (None, two), (None, prose(80, 43)), (None, prose(80, 43)), (5, one + " more"), (9, two + " more"),
            (7, prose(80, 44)), (7, prose(80, 45)), (7, prose(80, 45).upper())]
    kept = [(r.doc_id, r.text.lower()) for r in n.keep_one(frame(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(None, one), (None, two), (None, prose(80, 43)), (7, prose(80, 44)), (7, prose(80, 45))], key=str)
    classes = [(r.doc_id, r.class_id, r.class_row) for r in n.near_duplicates(frame(spark, rows)).collect()]
    assert len(classes) == 7 and len({c for *_, c in classes}) == 5
    of = {i: c for i, _, c in classes}
    assert of[5] != of[9]


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, **{i: 200 for i in range(200, 203)}}


def test_empty_table(spark):
    assert n.near_duplicates(frame(spark, [])).count() == 0
    assert n.keep_one(frame(spark, [])).columns == frame(spark, []).columns


def weighted_shingles(text, size=5):
    words = WORD.findall(ascii_lower(text))
    if len(words) < size:
        return Counter([tuple(words)] if words else [])
    return Counter(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def probability_jaccard(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    return sum(1 / sum(max(a[y] / a[x], b[y] / b[x]) for y in a.keys() | b.keys()) for x in a.keys() & b.keys())


def test_exact_similarities():
    rng = random.Random(8)
    for _ in range(60):
        a, b = (Counter(rng.choices(range(30), k=rng.choice([0, 1, 5, 40]))) for _ in range(2))
        sides = [(np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)], np.uint32)) for x in (a, b)]
        got = n.similarities(*sides[0], *sides[1])
        union = len(a.keys() | b.keys())
        assert abs(got[0] - probability_jaccard(a, b)) < 1e-9
        assert abs(got[1] - (len(a.keys() & b.keys()) / union if union else 1.0)) < 1e-9
        assert n.similarities(*sides[0], *sides[0]) == (1.0, 1.0) or abs(n.similarities(*sides[0], *sides[0])[0] - 1) < 1e-9


def test_one_minus_similarity_is_a_metric():
    rng = random.Random(9)
    for _ in range(200):
        sets = [Counter(rng.choices(range(8), k=rng.randint(1, 12))) for _ in range(3)]
        d = [1 - probability_jaccard(sets[i], sets[j]) for i, j in ((0, 1), (1, 2), (0, 2))]
        assert d[2] <= d[0] + d[1] + 1e-9


def test_weighted_sets_against_brute_force(spark):
    cycles = [prose(40, 60 + k) + " " for k in range(4)]
    rows = [(2000 + 100 * k + i, cycles[k] * (3 + i) + prose(30, 1000 * k + i)) for k in range(4) for i in range(6)]
    rows += [(900 + i, prose(120, 70) + " " + prose(4 * i, 71 + i)) for i in range(12)]
    rows += [(i, t) for i, t in ODD_TEXTS if len(t or "") < 9000]
    sets = [(i, weighted_shingles(t)) for i, t in rows]
    ids = sorted({i for i, _ in rows}, key=lambda i: (i is not None, i or 0))
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_weight_only = 0
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            union = len(a.keys() | b.keys())
            equal = len(a.keys() & b.keys()) / union if union else 1.0
            alike = probability_jaccard(a, b)
            by_weight_only += alike >= 0.8 - 1e-9 > equal
            if max(alike, equal) >= 0.8 - 1e-9:
                x, y = sorted((root(i), root(j)), key=lambda r: (r is not None, r or 0))
                parent[y] = x
    assert by_weight_only > 10
    got = {r.doc_id: r.class_id for r in n.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: root(i) for i in ids}


def test_one_short_text_a_partition(spark):
    rows = [(i, t) for i, t in enumerate(["two words", "", None, "one", "a b c", "a b c d e", "two words", "a b c d"] * 2)]
    source = frame(spark, rows).repartition(40)
    assert {r.doc_id: r.class_id for r in n.near_duplicates(source).collect()} == classes_by_brute_force(rows)


def test_each_text_of_a_large_group_is_moved_a_bounded_number_of_times(spark, monkeypatch):
    moved = []
    plain = n._shingled

    def counting(texts, nodes, placed):
        moved.append(placed.count())
        return plain(texts, nodes, placed)
    monkeypatch.setattr(n, "_shingled", counting)
    base = prose(150, 80).split()
    rows = [(i, " ".join(base[:i % 149] + [f"edit{i}"] + base[i % 149 + 1:])) for i in range(3000)]
    got = {r.class_id for r in n.near_duplicates(frame(spark, rows), block=100).collect()}
    assert got == {0} and sum(moved) < 3 * len(rows)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bands_of_all_nodes_are_not_broadcast(spark, monkeypatch):
    plans, plain_write = {}, n.materialize

    def noting(df, label, *more):
        plans[label] = plan_of(df)
        return plain_write(df, label, *more)
    monkeypatch.setattr(n, "materialize", noting)
    rows = [(i, prose(30, 5000 + i)) for i in range(40)] + group_of_copies(4, 20, 60)
    got = {r.doc_id: r.class_id for r in n.near_duplicates(frame(spark, rows)).collect()}
    assert got == classes_by_brute_force(rows)
    assert "Generate explode(bands" in plans["stars"] and "SortMergeJoin" in plans["stars"] and "Broadcast" not in plans["stars"]


def test_members_dealt_to_many_blocks_are_not_broadcast(spark):
    rows = [(i, f"text {i}") for i in range(20)]
    texts = spark.createDataFrame([(t, bytes([i])) for i, t in rows], "text string, row binary")
    nodes = spark.createDataFrame([(i, bytes([i])) for i, _ in rows], "node long, row binary")
    placed = materialize(spark.createDataFrame([(i, 0, 50) for i, _ in rows], "node long, hub long, blocks int"))
    placed = placed.select("node", "hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("first"))
    shingled = n._shingled(texts, nodes, placed)
    assert "Broadcast" not in plan_of(shingled)
    assert Counter(r.node for r in shingled.select("node").collect()) == {i: 50 for i, _ in rows}
