import collections
import math
import zlib

import numpy as np
import pytest
from samples import ODD_TEXTS, WORD, ascii_lower, frame, prose

from tallyframe.llm import hmm


def plain_counts(model, texts):
    """Baum-Welch's expected counts by the textbook recursions."""
    k, c = model.emit.shape
    starts, moves, emits, total = np.zeros(k), np.zeros((k, k)), np.zeros((k, c)), []
    for o in texts:
        n = len(o)
        alpha, beta = np.zeros((n, k)), np.ones((n, k))
        alpha[0] = model.start * model.emit[:, o[0]]
        for t in range(1, n):
            alpha[t] = alpha[t - 1] @ model.move * model.emit[:, o[t]]
        for t in range(n - 2, -1, -1):
            beta[t] = model.move @ (model.emit[:, o[t + 1]] * beta[t + 1])
        p = alpha[-1].sum()
        total.append(math.log(p))
        gamma = alpha * beta / p
        starts += gamma[0]
        for t in range(n):
            emits[:, o[t]] += gamma[t]
        for t in range(n - 1):
            moves += np.outer(alpha[t], model.emit[:, o[t + 1]] * beta[t + 1]) * model.move / p
    return starts, moves, emits, total


@pytest.mark.parametrize("size", [1, 4, 128])
def test_segments_change_nothing(size):
    rng = np.random.default_rng(1)
    share = lambda *s: (x := rng.random(s) + 0.1) / x.sum(-1, keepdims=True)
    model = hmm.Model(share(3), share(3, 3), share(3, 7))
    lengths = [1, 5, 13, 30, 4]
    symbols, offsets = rng.integers(0, 7, sum(lengths)), np.concatenate([[0], np.cumsum(lengths)])
    segments = hmm.Segments(symbols, offsets, size)
    want = plain_counts(model, [symbols[a:z] for a, z in zip(offsets[:-1], offsets[1:])])
    got = hmm.expected_counts(model, segments)
    for a, b in zip(got[:3], want[:3]):
        assert np.allclose(a, b)
    natural, _ = hmm.log_likelihood(model, segments, *hmm.transfers(model, segments))
    assert np.allclose(natural, want[3])


def test_base_score_and_counts(spark):
    rows = ODD_TEXTS + [(100 + i, prose(50 + i, i)) for i in range(60)]
    got = collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
                              for r in hmm.score_texts(frame(spark, rows)).collect())
    fold = lambda i: 0 if i is None else zlib.crc32(str(i).encode()) % 7
    tokens = [(i, [*WORD.findall(ascii_lower(t)), None]) for i, t in rows]
    c = collections.Counter(w for i, ws in tokens if fold(i) != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    want = collections.Counter((i, fold(i) == 2, len(ws), sum(c[w] > 0 for w in ws), n,
                                round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens)
    assert got == want


def test_model_beats_the_base_on_held_out_texts(spark):
    languages = ["th an in er on".split(), "ui oa ei ue ao".split()]
    rng = np.random.default_rng(3)
    rows = [(i, " ".join("".join(rng.choice(languages[i % 2], 2)) for _ in range(80))) for i in range(200)]
    got = [r for r in hmm.score_texts(frame(spark, rows)).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 5 * len(got)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_empty_table_and_no_training_text(spark):
    assert hmm.score_texts(frame(spark, [])).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = hmm.score_texts(frame(spark, [(only, "alone here")])).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0)
