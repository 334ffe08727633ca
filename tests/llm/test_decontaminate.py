import math

from samples import LONG, ODD_TEXTS, frame, prose, shingles

from tallyframe.llm import decontaminate as d

ITEMS = [(1, prose(300, 2)), (2, prose(30, 50)), (3, prose(8, 51)), (4, "one"), (5, None), (6, ""), (2, prose(30, 50)), (None, prose(25, 52)),
         (7, " ".join(LONG.split()[5000:5060])), (8, prose(200, 53))]
DOCS = ODD_TEXTS + [
    (100, prose(50, 60) + " " + prose(30, 50).upper() + " " + prose(50, 61)), (101, prose(8, 51) + " " + prose(400, 62)),
    (102, " ".join(prose(30, 50).split()[:27])), (103, " ".join(prose(30, 50).split()[:24])), (None, prose(25, 52)),
    (104, prose(9, 70).join(" " + " ".join(prose(200, 53).split()[i:i + 60]) + " " for i in range(0, 200, 55)))]


def plain(docs, items, threshold=0.8):
    out = []
    for i, text in docs:
        own = shingles(text)
        for item, body in set(items):
            want = shingles(body)
            shared = len(own & want)
            if want and shared >= math.ceil(threshold * len(want) - 1e-9):
                out.append((i, item, shared, len(want)))
    return sorted(out, key=str)


def found(spark, items=ITEMS, docs=DOCS, **options):
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    return sorted(((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in d.find_items(frame(spark, docs), table, **options).collect()), key=str)


def test_pairs_match_brute_force(spark):
    assert found(spark) == plain(DOCS, ITEMS)


def test_lower_threshold_and_item_blocks(spark):
    assert found(spark, threshold=0.5, item_block=40) == plain(DOCS, ITEMS, 0.5)


def test_leaks_go_and_clean_documents_stay(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = d.decontaminate(frame(spark, DOCS), items)
    leaking = {i for i, *_ in plain(DOCS, ITEMS)}
    assert kept.columns == frame(spark, []).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, _ in DOCS if i not in leaking), key=str)


def test_clean_rows_stay_beside_a_leak_of_the_same_id(spark):
    rows = [(None, prose(30, 50)), (None, prose(40, 90)), (7, prose(30, 50) + " tail"), (7, prose(40, 91)), (7, None)]
    kept = d.decontaminate(frame(spark, rows), spark.createDataFrame(ITEMS, "item_id long, text string"), per_row=True)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)


def test_empty_tables(spark):
    assert found(spark, items=[]) == [] and found(spark, docs=[]) == []


def test_sketches_keep_the_exact_bound():
    import numpy as np
    items = [np.arange(n, dtype=np.uint64) for n in (1, 2, 5, 11, 40)]
    for c in d.size_classes(items, 0.8):
        for i in set(c.owners.tolist()):
            n = len(items[i])
            assert (c.owners == i).sum() == n - math.ceil(0.8 * n - 1e-9) + 1


def test_items_of_one_to_four_words_inside_documents(spark):
    items = [(1, "answer is blue"), (2, "Blue"), (3, "a b c d"), (4, "blue and"), (5, "a b c d e"), (6, "is answer")]
    docs = [(1, prose(50, 1) + " the answer  IS\nblue and " + prose(50, 2)), (2, "answer is"), (3, "x a b c d y"), (4, "a b c"), (5, "blue")]
    got = found(spark, items, docs)
    assert got == sorted([(1, 1, 1, 1), (1, 2, 1, 1), (1, 4, 1, 1), (3, 3, 1, 1), (5, 2, 1, 1)], key=str)
    mixed = frame(spark, docs + [(i, "two words") for i in range(10, 20)]).repartition(30)
    kept = d.decontaminate(mixed, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, *range(10, 20)]


def test_one_short_item_and_text_a_partition(spark):
    items = spark.createDataFrame([(1, "one two three"), (2, "four"), (3, None), (4, "five six")], "item_id long, text string").repartition(8)
    docs = frame(spark, [(i, t) for i, t in enumerate(["one two three", "two words", "four", "", None, "a five six"])]).repartition(20)
    assert sorted((r.doc_id, r.item_id) for r in d.find_items(docs, items).collect()) == [(0, 1), (2, 2), (5, 4)]
