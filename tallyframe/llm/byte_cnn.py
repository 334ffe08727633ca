"""Quality classifier: a convolutional network over bytes, in numpy.

A text's UTF-8 bytes are embedded and convolved with learned filters of
``WIDTH`` bytes, one position every ``STRIDE`` bytes. Chunks of ``CHUNK``
positions, each overlapping the next by ``OVERLAP``, cover the whole text; each
filter's maximum inside a chunk goes through a linear layer, and the mean over
the chunks becomes one probability.

The network is trained on a bounded sample: the ``TRAIN_ROWS`` labelled documents
of smallest id hash outside the held-out fold, ``TRAIN_BYTES`` of each. Scoring
reads every byte of every document, slice by slice.

Defined results: null and empty texts are scored as a few zero bytes; without a
labelled row every score is 0.5; repeated rows are scored one by one; a null id is
kept and is never part of the training sample; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.words import bound_batches, slices

TRAIN_ROWS = 3000
TRAIN_BYTES, TRAIN_PIECES = 1 << 15, 32
EMBED, FILTERS, STRIDE, WIDTH = 8, 32, 4, 8
CHUNK, OVERLAP = 128, 16
STEPS, BATCH, RATE = 400, 48, 0.004
FOLDS, HELD_OUT = 3, 1
_SLICE = 1 << 20
SEGMENT_CHUNKS = 2048
_HALF = STRIDE * EMBED


@dataclass
class Network:
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    offset: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.offset]


def start_network(seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    return Network(rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
                   rng.normal(0, 0.15, (WIDTH * EMBED, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
                   rng.normal(0, 0.1, FILTERS).astype(np.float32), np.zeros(1, np.float32))


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, chunk starts, chunk ends, text of chunk); positions count strides.

    Every text is padded by zero bytes to whole strides and one more.
    """
    strides = [max(1, -(-len(t) // STRIDE)) for t in texts]
    data = b"".join(t + bytes((n + 1) * STRIDE - len(t)) for t, n in zip(texts, strides))
    starts, ends, owner, base = [], [], [], 0
    for i, n in enumerate(strides):
        first = np.arange(0, max(1, n - OVERLAP), CHUNK - OVERLAP)
        starts.append(base + first)
        ends.append(base + np.minimum(first + CHUNK, n))
        owner.append(np.full(len(first), i))
        base += n + 1
    return np.frombuffer(data, np.uint8), np.concatenate(starts), np.concatenate(ends), np.concatenate(owner)


def convolve(net: Network, data: np.ndarray) -> np.ndarray:
    """Filter outputs at every stride but the last."""
    x = net.embed[data].reshape(-1, _HALF)
    out = x[:-1] @ net.filters[:_HALF]
    out += x[1:] @ net.filters[_HALF:]
    out += net.bias
    return out


def segments(texts: list[bytes]) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    """(text, bytes, chunk starts, chunk ends) of at most ``SEGMENT_CHUNKS`` chunks each, as ``lay_out`` has them."""
    for i, text in enumerate(texts):
        n = max(1, -(-len(text) // STRIDE))
        firsts = np.arange(0, max(1, n - OVERLAP), CHUNK - OVERLAP)
        for k in range(0, len(firsts), SEGMENT_CHUNKS):
            first = firsts[k:k + SEGMENT_CHUNKS]
            ends = np.minimum(first + CHUNK, n)
            piece = text[first[0] * STRIDE:(ends[-1] + 1) * STRIDE]
            yield i, piece + bytes((ends[-1] + 1 - first[0]) * STRIDE - len(piece)), first - first[0], ends - first[0]


def score_texts(net: Network, texts: list[bytes]) -> np.ndarray:
    """Probability of label 1 for each text; a long one is read in segments, never laid out whole."""
    total, chunks = np.zeros(len(texts)), np.zeros(len(texts))

    def add(held: list) -> None:
        bases = np.cumsum([0] + [len(piece) // STRIDE for _, piece, _, _ in held])
        conv = convolve(net, np.frombuffer(b"".join(piece for _, piece, _, _ in held), np.uint8))
        edges = np.concatenate([np.stack([starts, ends], 1).ravel() + base for base, (_, _, starts, ends) in zip(bases, held)])
        if edges[-1] == len(conv):
            edges = edges[:-1]
        pooled = np.maximum(np.maximum.reduceat(conv, edges, axis=0)[::2], 0)
        owner = np.repeat([i for i, *_ in held], [len(starts) for _, _, starts, _ in held])
        total[:] += np.bincount(owner, pooled @ net.out + net.offset[0], len(texts))
        chunks[:] += np.bincount(owner, minlength=len(texts))

    held, size = [], 0
    for segment in segments(texts):
        held.append(segment)
        size += len(segment[1])
        if size >= _SLICE:
            add(held)
            held, size = [], 0
    if held:
        add(held)
    return 1 / (1 + np.exp(-np.clip(total / chunks, -50, 50)))


def gradients(net: Network, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean log loss, through the positions that the maxima picked."""
    data, starts, ends, owner = lay_out(texts)
    conv = convolve(net, data)
    at = np.minimum(starts[:, None] + np.arange(CHUNK), ends[:, None] - 1)
    picked = np.take_along_axis(at, conv[at].argmax(axis=1), 1)
    best = conv[picked, np.arange(FILTERS)]
    pooled = np.maximum(best, 0)
    chunks = np.bincount(owner, minlength=len(texts))
    logits = np.bincount(owner, pooled @ net.out + net.offset[0], len(texts)) / chunks
    slope = ((1 / (1 + np.exp(-np.clip(logits, -50, 50))) - labels) / len(texts) / chunks)[owner].astype(np.float32)
    back = (slope[:, None] * net.out) * (best > 0)
    window = data[(picked * STRIDE)[:, :, None] + np.arange(WIDTH)]
    inputs = net.embed[window].reshape(*picked.shape, WIDTH * EMBED)
    d_filters = np.einsum("cf,cfi->if", back, inputs)
    to_inputs = (back[:, :, None] * net.filters.T).reshape(-1, EMBED)
    d_embed = np.stack([np.bincount(window.ravel(), to_inputs[:, e], 256) for e in range(EMBED)], 1).astype(np.float32)
    return [d_embed, d_filters, back.sum(0), (slope[:, None] * pooled).sum(0), slope.sum(keepdims=True)]


def train(texts: list[bytes], labels: np.ndarray, steps: int = STEPS) -> Network:
    """Adam over shuffled batches, as many steps whatever the sample; the same sample gives the same network."""
    net, rng = start_network(), np.random.default_rng(11)
    first, second, step = [0.0] * 5, [0.0] * 5, 0
    while step < steps:
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            step += 1
            if step > steps:
                break
            batch = order[a:a + BATCH]
            grads = gradients(net, [texts[i] for i in batch], labels[batch])
            for k, (p, g) in enumerate(zip(net.parameters(), grads)):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p -= RATE * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return net


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _spread(text: Column) -> Column:
    """All bytes of a text, or of a longer one ``TRAIN_PIECES`` pieces from its first byte to its last, zeros between."""
    piece = TRAIN_BYTES // TRAIN_PIECES
    last = F.length(text) - piece
    at = [F.floor(last * F.lit(j) / F.lit(TRAIN_PIECES - 1)).cast("int") + 1 for j in range(TRAIN_PIECES)]
    gap = F.lit(bytes(WIDTH))
    pieces = F.concat(*[x for a in at for x in (F.substr(text, a, F.lit(piece)), gap)])
    return F.when(F.length(text) <= TRAIN_BYTES, text).otherwise(pieces)


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "quality", rows: int = TRAIN_ROWS) -> list:
    """At most ``rows`` labelled (text, label) rows of the training folds; of long texts pieces spread over all of it."""
    key = F.col(f"`{id_col}`")
    chosen = (labels.select(key.alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
              .where(key.isNotNull() & F.col("label").isNotNull() & ~held_out(key))
              .orderBy(F.xxhash64("id"), "id").limit(rows))
    texts = docs.select(key.alias("id"), _spread(F.col(f"`{text_col}`").cast("binary")).alias("data"))
    found = texts.join(F.broadcast(chosen), "id").orderBy(F.xxhash64("id"), "id", "label", "data").limit(rows)
    return [(bytes(r.data or b""), r.label) for r in found.collect()]


def fit(docs: DataFrame, labels: DataFrame, **columns) -> Network | None:
    sample = training_sample(docs, labels, **columns)
    if not sample:
        return None
    texts, marks = zip(*sample)
    return train(list(texts), np.array(marks, np.float32))


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", _SLICE):
            texts = pc.fill_null(part.column("text"), "").cast(pa.binary()).to_pylist()
            scores = score_texts(net, texts) if net else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores.astype(np.float64))], ["doc_id", "score"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")
                       ).mapInArrow(run, "doc_id long, score double")
