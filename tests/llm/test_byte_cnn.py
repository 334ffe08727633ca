import numpy as np
from pyspark.sql import functions as F
from samples import ODD_TEXTS, frame, prose

from tallyframe.llm import byte_cnn as c


def test_gradients_match_differences():
    net, texts, marks = c.start_network(), [b"abc def ghi" * 5, "é%%% $$$".encode() * 200, b""], np.array([1, 0, 1], np.float32)

    def loss():
        p = c.score_texts(net, texts)
        return -np.mean(marks * np.log(p) + (1 - marks) * np.log(1 - p))

    for p, g in zip(net.parameters(), c.gradients(net, texts, marks)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        p[at] += 1e-3
        up = loss()
        p[at] -= 2e-3
        down = loss()
        p[at] += 1e-3
        assert abs((up - down) / 2e-3 - g[at]) < 0.02 * abs(g[at]) + 1e-4


def test_chunks_cover_every_byte():
    texts = [b"", b"x", b"y" * 511, b"z" * 512, b"q" * 5000]
    data, starts, ends, owner = c.lay_out(texts)
    for i, t in enumerate(texts):
        covered = set()
        for a, z in zip(starts[owner == i], ends[owner == i]):
            covered.update(range(a, z))
        assert len(covered) * c.STRIDE >= len(t) and len(covered) == max(1, -(-len(t) // c.STRIDE))
    assert len(data) % c.STRIDE == 0


def test_late_junk_changes_the_score():
    clean = prose(3000, 1).encode()
    net = c.start_network()
    assert c.score_texts(net, [clean])[0] != c.score_texts(net, [clean + b"%%%$$$###" * 50])[0]


def test_held_out_accuracy(spark):
    rows = [(i, prose(80, i) if i % 3 else " ".join(w + "$$$" for w in prose(80, i).split())) for i in range(600)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)], "doc_id long, quality int")
    scored = c.score(docs, c.fit(docs, labels)).withColumn("out", c.held_out(F.col("doc_id"))).collect()
    right = [(r.score >= 0.5) == (r.doc_id % 3 > 0) for r in scored if r.out]
    assert len(scored) == 600 and sum(right) >= 0.95 * len(right) > 100


def test_labels_of_the_held_out_fold_are_not_read(spark):
    labels = spark.createDataFrame([(i, 1) for i in range(90)] + [(None, 0), (5, None)], "doc_id long, quality int")
    docs = frame(spark, [(i, f"text {i}") for i in range(90)] + [(None, "x")])
    import zlib
    sample = c.training_sample(docs, labels)
    assert sorted(t for t, _ in sample) == sorted(f"text {i}".encode() for i in range(90) if zlib.crc32(str(i).encode()) % 3 != 1)
    assert len(c.training_sample(docs, labels, rows=7)) == 7


def test_odd_texts_and_no_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = c.score(frame(spark), c.fit(frame(spark), labels)).collect()
    assert len(got) == len(ODD_TEXTS) and all(r.score == 0.5 for r in got)
    one = spark.createDataFrame([(6, 1), (14, 0)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in c.score(frame(spark), c.fit(frame(spark), one)).collect())
    assert c.score(frame(spark, []), None).count() == 0


def plain_score(net, text):
    """A forward pass written out, one chunk and one position at a time."""
    n = max(1, -(-len(text) // c.STRIDE))
    data = text + bytes((n + 1) * c.STRIDE - len(text))
    logits = []
    for first in range(0, max(1, n - c.OVERLAP), c.CHUNK - c.OVERLAP):
        best = None
        for at in range(first, min(first + c.CHUNK, n)):
            window = data[at * c.STRIDE:at * c.STRIDE + c.WIDTH]
            out = np.concatenate([net.embed[b] for b in window]) @ net.filters + net.bias
            best = out if best is None else np.maximum(best, out)
        logits.append(np.maximum(best, 0) @ net.out + net.offset[0])
    return 1 / (1 + np.exp(-np.mean(logits)))


def test_scores_match_a_plain_forward_pass(monkeypatch):
    net = c.start_network()
    texts = [b"", b"x", "é%%% ".encode() * 7, prose(60, 1).encode(), prose(900, 2).encode(), b"q" * 1793, b"r" * 1792]
    want = [plain_score(net, t) for t in texts]
    assert np.allclose(c.score_texts(net, texts), want, atol=1e-5)
    monkeypatch.setattr(c, "SEGMENT_CHUNKS", 3)
    monkeypatch.setattr(c, "_SLICE", 900)
    assert np.allclose(c.score_texts(net, texts), want, atol=1e-5)


def test_a_text_of_thirty_megabytes_takes_little_memory():
    import tracemalloc
    net, text = c.start_network(), b"some words here " * (30 << 16)
    tracemalloc.start()
    c.score_texts(net, [text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20


def test_training_reads_all_of_a_long_text(spark):
    text = "clean words " * 10_000 + "###" * 2000
    import zlib
    one, two = [i for i in range(50) if zlib.crc32(str(i).encode()) % c.FOLDS != c.HELD_OUT][:2]
    docs = frame(spark, [(one, text), (two, "short")])
    labels = spark.createDataFrame([(one, 0), (two, 1)], "doc_id long, quality int")
    sample = dict((label, data) for data, label in c.training_sample(docs, labels))
    assert sample[1] == b"short" and b"###" in sample[0] and len(sample[0]) <= c.TRAIN_BYTES + c.TRAIN_PIECES * c.WIDTH
    assert sample[0].startswith(b"clean words") and sample[0].rstrip(bytes(1)).endswith(b"###")
