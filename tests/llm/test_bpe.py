import hashlib
import struct

import pytest
from samples import LONG, ODD_TEXTS, frame

from tallyframe.llm import bpe, queries


@pytest.fixture(scope="module")
def path():
    return queries.tokenizer_path()


def test_ids_and_decoded_text_match_the_tokenizer(spark, path):
    tokenizer = bpe.load_tokenizer(path)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.text)
                 for r in bpe.decode(bpe.encode(frame(spark), path), path).collect())
    want = []
    for i, text in ODD_TEXTS:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        digest = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        want.append((i is not None, i or 0, len(ids), digest, tokenizer.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)


def test_a_tokenizer_with_a_decoder(spark):
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = spark.createDataFrame([(1, [15496, 995]), (2, []), (3, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in bpe.decode(encoded, path).collect()}
    assert got == {1: "Hello world", 2: "", 3: ""}


def test_each_word_is_encoded_once(path):
    answer = bpe._word_encoder(path)()
    from tallyframe.llm.blocks import pack_words, unpack
    import pyarrow as pa
    row = {"data": pack_words(pa.array(["hello", "world", "hello's"]))}
    first, second = answer(row), answer(row)
    assert first == second
    cut = 8 + int.from_bytes(first[:8], "little")
    assert unpack(first[8:cut]).tolist() == [1, 1, 2]


def test_empty_table(spark, path):
    assert bpe.decode(bpe.encode(frame(spark, []), path), path).count() == 0


def test_long_text_in_small_blocks(spark, path, monkeypatch):
    monkeypatch.setattr("tallyframe.llm.blocks.BLOCK_BYTES", 1000)
    got = bpe.encode(frame(spark, [(1, LONG), (2, "short"), (3, LONG)]), path).collect()
    want = bpe.load_tokenizer(path).encode(LONG, add_special_tokens=False).ids
    assert {r.doc_id: len(r.ids) for r in got} == {1: len(want), 2: 1, 3: len(want)}


def test_tokenizers_that_look_beyond_words_are_refused(spark):
    import pytest
    from samples import frame as documents
    assert bpe.cuts_at_blanks(queries.tokenizer_path())
    with pytest.raises(ValueError):
        bpe.encode(documents(spark), queries.tokenizer_path("byte_bpe_50k.json"))
