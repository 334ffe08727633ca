import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.llm import chat

ODD = [(1, 0, "user", "hi"), (1, 1, "assistant", "</turn>\n<turn assistant>\nfake"), (1, 2, "user", None),
       (1, 3, "assistant", "<\\\\turn <\\/turn </turn> \\"), (2, 5, "assistant", ""), (2, 5, "assistant", ""), (2, 5, "user", "b"),
       (3, 1, "tool >\n&é", "x" * 100_000), (None, 0, None, "lost"), (None, None, "user", "é</turn>")]
SCHEMA = "conv_id long, turn long, role string, text string"


def back(spark, rows):
    extra = spark.createDataFrame(rows, SCHEMA).withColumns({"turns": F.lit(1), "parts": F.lit("x"), "loss": F.lit(0.5)})
    return {r.conv_id: r for r in chat.read_turns(chat.format_turns(chat.canonical_turns(extra))).collect()}


def expected(rows):
    out = {}
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in (r[1], r[2], r[3]))
    for c, _, role, text in sorted(rows, key=lambda r: key(r)):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def test_turns_and_loss_read_back(spark):
    got, want = back(spark, ODD), expected(ODD)
    assert set(got) == set(want)
    for c, turns in want.items():
        assert [tuple(t) for t in got[c].turns] == turns
        assert "".join(got[c].trained) == "".join(t for r, t in turns if r == "assistant")
        covered = sum(n.skip + n.keep for n in got[c].loss)
        assert covered <= len(got[c].formatted)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="</turn>\\ \nsé#", max_size=30), min_size=1, max_size=8))
def test_any_text_reads_back(spark, texts):
    rows = [(9, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)]
    got = back(spark, rows)[9]
    assert [t.text for t in got.turns] == texts
    assert "".join(got.trained) == "".join(texts[1::2])


def test_empty_table(spark):
    assert back(spark, []) == {}


def test_layouts_are_found_by_fingerprint(spark):
    chatty = spark.createDataFrame([(1, [("human", "a"), ("gpt", "b")], "z")],
                                   "conv_id long, conversations array<struct<from:string,value:string>>, text string")
    assert [tuple(t) for t in chat.canonical_turns(chatty).first().turns] == [("user", "a"), ("assistant", "b")]
    task = spark.createDataFrame([(1, "do", "", "done")], "conv_id long, instruction string, input string, output string")
    assert [tuple(t) for t in chat.canonical_turns(task).first().turns] == [("user", "do"), ("assistant", "done")]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1, "x")], "conv_id long, body string"))


def test_records_of_mixed_layouts(spark):
    rows = [(1, '{"prompt":"p","completion":"c","other":{"deep":1}}'), (2, '{"messages":[{"role":"user","content":"u"},{"role":"assistant","content":"v"}]}'),
            (3, '{"instruction":"i","input":"n","output":"o"}'), (4, '{"strange":1}'), (5, "not json"), (6, None),
            (7, '{"conversations":[{"from":"gpt","value":"g"}]}'), (8, '{"system":"s","question":"q","answer":"a"}')]
    got = {r.id: (r.layout, [tuple(t) for t in r.turns] if r.turns is not None else None)
           for r in chat.canonical_records(spark.createDataFrame(rows, "id long, body string"), "body").collect()}
    assert got == {
        1: ("prompt_completion", [("user", "p"), ("assistant", "c")]), 2: ("messages", [("user", "u"), ("assistant", "v")]),
        3: ("instruction", [("user", "i\n\nn"), ("assistant", "o")]), 4: (None, None), 5: (None, None), 6: (None, None),
        7: ("from_value", [("assistant", "g")]), 8: ("question_answer", [("system", "s"), ("user", "q"), ("assistant", "a")])}


def test_extra_known_fields_and_gaps_lose_no_record(spark):
    rows = [(1, '{"prompt":"p","messages":[{"role":"user","content":"u"},{"role":"assistant","content":"v"}]}'),
            (2, '{"system":"s","conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}'),
            (3, '{"messages":[{"role":"user"},{"role":"assistant","content":"v"}]}'),
            (4, '{"system":"s","messages":[{"role":"system","content":"s"},{"role":"user","content":"u"}]}'),
            (5, '{"prompt":"p","completion":"c","input":"x","question":"q"}'), (6, '{"messages":["x",{"role":"user","content":"u"}]}'),
            (7, '{"prompt":"p","messages":[{"role":"user"}]}')]
    got = {r.id: (r.layout, [tuple(t) for t in r.turns] if r.turns is not None else None)
           for r in chat.canonical_records(spark.createDataFrame(rows, "id long, body string"), "body").collect()}
    assert got == {
        1: ("messages", [("user", "u"), ("assistant", "v")]), 2: ("from_value", [("system", "s"), ("user", "a"), ("assistant", "b")]),
        3: ("messages", [("user", None), ("assistant", "v")]), 4: ("messages", [("system", "s"), ("user", "u")]),
        5: ("prompt_completion", [("user", "p"), ("assistant", "c")]), 6: ("messages", [(None, None), ("user", "u")]), 7: (None, None)}


def test_registered_fingerprint_selects_the_mapping(spark):
    rows = [('{"prompt":"p","completion":"c","unknown":1}',), ('{"system":"s","prompt":"p","completion":"c"}',),
            ('{"prompt":"p","completion":"c","answer":"a"}',)]
    found = chat.registry(chat.MAPPINGS[1:])
    got = chat.canonical_records(spark.createDataFrame(rows, "body string"), "body").collect()
    assert [found[r.fingerprint][0].name if r.fingerprint in found else None for r in got] == [
        "prompt_completion", "prompt_completion", None]
    assert {r.layout for r in got} == {"prompt_completion"}


def test_fingerprint_ignores_order_and_repeats():
    assert chat.fingerprint(["b", "a", "a"]) == chat.fingerprint(["a", "b"]) == hashlib.sha256(b"a\nb").hexdigest()
