import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import tokenizers
from samples import LONG, ODD_TEXTS, frame

from tallyframe.llm import cross_tokens, incidence
from tallyframe.llm.queries import tokenizer_path

PATHS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
SPACES = [(100, "a\t b \t\n  c\r\n\r\nd;\r e\x1c f\x1c\x1d g  h　i\xa0 j  k"), (101, "\n\n"), (102, " "), (103, "\t"),
          (104, "  lead and trail  "), (105, "x\ny\n\n z \n"), (106, "  a \x85 b"), (107, "a▁b"), (108, "</s> <0x41> <unk>"),
          (109, "'s don't I'll 12 34ab\n\t\tcode();\r\n"), (110, "<|endoftext|> <|endoftext|>"), (111, "é ﬁ ① \x00")]


def plain(rows):
    """Whole texts, encoded by the libraries and walked from end to end."""
    a_of, b_of = tokenizers.Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a_of.encode_special_tokens = True
    alphabet = cross_tokens.byte_alphabet()
    held, docs = Counter(), []
    for doc_id, text in rows:
        docs.append((doc_id, None))
        if not text:
            continue
        encoding = a_of.encode(" " + text, add_special_tokens=False)
        a, b = encoding.ids, b_of.encode(text)
        a_bytes = [bytes(alphabet[c] for c in t) for t in encoding.tokens]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_of.is_byte(i) else p.replace("▁", " ").encode()
                   for i, p in ((i, b_of.id_to_piece(i)) for i in b)]
        if {b"".join(a_bytes), b"".join(b_bytes)} != {(" " + text).encode()}:
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (a_bytes, b_bytes)]
        groups, links, i, j, start = [], [], 0, 0, (0, 0)
        while i < len(a) and j < len(b):
            links.append((a[i], b[j]))
            low, high = ends[0][i], ends[1][j]
            i, j = i + (low <= high), j + (high <= low)
            if low == high:
                groups.append((a[start[0]:i], b[start[1]:j]))
                start = (i, j)
        held.update(set(links))
        docs[-1] = (doc_id, (len(a), len(b), groups, links))
    most = Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for doc_id, found in docs:
        if found is None:
            out.append((doc_id, 0, 0, 0, 0, 0, "", 0, 0))
            continue
        n_a, n_b, groups, links = found
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(len(x) * len(y) for x, y in groups),
                    hashlib.sha256(text.encode()).hexdigest(), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links)))
    return sorted(out, key=str)


def aligned(spark, rows, parts=3, **options):
    return sorted((tuple(r) for r in cross_tokens.align_texts(frame(spark, rows).repartition(parts), *PATHS, **options).collect()), key=str)


@pytest.mark.parametrize("block_bytes, piece", [(8 << 20, 1 << 20), (3000, 50)])
def test_every_measure_of_odd_texts(spark, monkeypatch, block_bytes, piece):
    monkeypatch.setattr(cross_tokens, "PIECE_CHARS", piece)
    assert aligned(spark, ODD_TEXTS + SPACES, block_bytes=block_bytes) == plain(ODD_TEXTS + SPACES)


def test_one_text_a_partition(spark):
    assert aligned(spark, ODD_TEXTS + SPACES, parts=60) == plain(ODD_TEXTS + SPACES)


def test_pieces_of_long_texts_are_its_units(monkeypatch):
    pair = cross_tokens.load(*PATHS)
    for text in (LONG, *(t for _, t in SPACES + ODD_TEXTS if t)):
        whole, cut = cross_tokens.Units(pair), cross_tokens.Units(pair)
        first = np.concatenate(list(whole.codes(text)))
        monkeypatch.setattr(cross_tokens, "PIECE_CHARS", 7)
        second = np.concatenate(list(cut.codes(text)))
        monkeypatch.undo()
        names, others = list(whole.index), list(cut.index)
        assert [names[c] for c in first] == [others[c] for c in second]
        assert "".join(names[c] for c in first) == " " + text


def test_a_text_of_some_megabytes(spark):
    rows = [(1, LONG * 20), (2, LONG), (3, None)]
    assert aligned(spark, rows) == plain(rows)


def test_hot_group_and_nothing(spark):
    rows = [(i, "the same words again and again") for i in range(500)] + [(i, f"other words {i}") for i in range(500, 600)]
    assert aligned(spark, rows, block_bytes=2000) == plain(rows)
    assert aligned(spark, []) == []


def test_a_small_table_of_units_forgets_and_learns_again(spark, monkeypatch):
    monkeypatch.setattr(cross_tokens, "TABLE_UNITS", 5)
    rows = ODD_TEXTS * 2
    got = sorted(tuple(r) for batch in [cross_tokens.Units(cross_tokens.load(*PATHS))]
                 for r in [h for h in cross_tokens._block(batch, [i for i, _ in rows], [t for _, t in rows])[0]] if r[0] is not None)
    want = sorted(x[:7] for x in plain(rows) if x[0] is not None)
    assert got == want


def test_pieces_that_cross_cuts_are_refused(monkeypatch):
    class Crossing(sentencepiece.SentencePieceProcessor):
        def id_to_piece(self, i):
            return "a▁b" if i == 500 else super().id_to_piece(i)
    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Crossing)
    with pytest.raises(ValueError):
        cross_tokens.Pair(*PATHS)


def dense(m):
    out = np.zeros((m.rows, m.columns), int)
    for i in range(m.rows):
        for k in range(m.indptr[i], m.indptr[i + 1]):
            out[i, m.indices[k]] += 1 if m.data is None else m.data[k]
    return out


def test_products_and_transposes_equal_dense_ones():
    rng = np.random.default_rng(3)
    for _ in range(50):
        r, k, c = rng.integers(0, 8, 3)
        sides = []
        for rows, columns in ((r, k), (k, c)):
            lists = [sorted(rng.choice(columns, rng.integers(0, columns + 1), replace=False)) if columns else [] for _ in range(rows)]
            sides.append(incidence.Csr(np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64),
                                       np.array([x for row in lists for x in row], np.int64), int(columns)))
        left, right = sides
        assert (dense(incidence.product(left, right)) == dense(left) @ dense(right)).all()
        assert (dense(incidence.transpose(left)) == dense(left).T).all()


def test_pair_counts(spark):
    table = cross_tokens.pair_counts(cross_tokens.blocks(frame(spark, [(1, "one two"), (2, "one"), (2, "one one"), (3, "")]), *PATHS))
    counts = sorted(r.documents for r in table.collect())
    assert counts[-1] == 3 and counts[0] == 1 and all(r.best for r in table.collect() if r.documents == 3)
