import collections

from samples import ODD_TEXTS, WORD, frame, prose

from tallyframe.llm import quality_rules as q


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen = collections.Counter(grams)
    inside = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))


def test_counts_match_plain_python(spark):
    rows = ODD_TEXTS + [(50, "a b c d e\na b c d e\n\n \na b c d e f"), (51, "w " * 9), (52, "w " * 4), (53, "a b c d e a b c d e a")]
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                              for r in q.quality_rules(frame(spark, rows), carry=["doc_id"]).collect())
    want = collections.Counter()
    for i, t in rows:
        counts = plain(t)
        want[(i, *counts, counts[0] < 10 or 100 * counts[4] > 20 * counts[0])] += 1
    assert got == want


def test_clean_texts_stay_and_junk_goes(spark):
    clean = [(i, prose(120, i)) for i in range(150)]
    junk = [(1000 + i, " ".join(w + "%%%" for w in prose(90, i).split())) for i in range(15)]
    shouting = [(2000 + i, " ".join(w.upper() + "!!" for w in prose(90, i).split())) for i in range(10)]
    kept = {r.doc_id for r in q.quality_rules(frame(spark, clean + junk + shouting)).where("kept").collect()}
    assert kept == {i for i, _ in clean}
    stay = q.keep_good(frame(spark, clean + junk + shouting))
    assert {r.doc_id for r in stay.collect()} == kept and stay.columns == frame(spark, []).columns


def test_em_finds_the_planted_accuracies():
    patterns = [((0, 0, 0, 0, 0, 0), 900), ((0, 0, 0, -1, -1, 0), 60), ((0, 0, 0, -1, 0, 0), 30), ((0, 0, 0, 0, -1, 0), 10)]
    model = q.fit_votes(patterns, 6)
    assert 0.88 < model.prior < 0.92
    assert 0.8 < model.bad[3][0] < 0.95 and model.good[3][0] <= 1 / q.GOOD_TEXTS_PER_FALSE_VOTE


def test_empty_table_and_clashing_columns(spark):
    assert q.quality_rules(frame(spark, [])).count() == 0
    row = q.quality_rules(frame(spark, [(1, "one two")])).first()
    assert (row.n_words, row.kept, row.lang, row.bucket) == (2, False, "en", "b")


def test_main_path_has_no_python(spark):
    docs = spark.range(10).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    plan = q.text_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
