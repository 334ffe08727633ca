"""Scoring texts with a hidden Markov language model.

Words fall into ``CLASSES`` classes by their form (the whole of a short word, the
last bytes of a long one); a hidden state emits a class, and the class emits the
word by its smoothed share of the class in the training texts. So the emission
table has ``STATES`` x ``CLASSES`` entries whatever the corpus, and word counts,
which grow with it, stay in tables joined by word.

Baum-Welch runs over all training texts: every task adds up its expected counts,
and their sum over the partitions gives the next model. The forward recursion is
exact over whole texts of any length: a text is cut into segments, each becomes
the product of its step matrices, scaled as it goes, and the products are chained.

Defined results: null and empty texts are one end token; without training texts
every count is zero and the model starts from its first guess; repeated rows
count and are scored one by one; a null id counts as training text (its crc32 is
taken as 0); other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.blocks import answer_words, by_bucket, code_blocks, finish_blocks, pack, pack_words, unpack, unpack_words
from tallyframe.llm.words import mix
from tallyframe.session import materialize

STATES, CLASSES, ROUNDS = 6, 4096, 4
END = CLASSES - 1
SMOOTHING = 200.0
SEGMENT, _CHUNK = 128, 3000
FOLDS, HELD_OUT = 7, 2
SCORED = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def first_model(states: int = STATES, classes: int = CLASSES) -> Model:
    """Lingering states that prefer different classes, by hash."""
    noise = mix(np.arange(states * classes, dtype=np.uint64) + np.uint64(1)).astype(np.float64) / 2 ** 64
    emit = np.exp(noise.reshape(states, classes))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True))


def word_classes(words: pa.Array) -> np.ndarray:
    """Class of each word: of its bytes up to four, else of its last four and 'long'."""
    raw = words.cast(pa.binary())
    ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset:raw.offset + len(raw) + 1].astype(np.int64)
    data = np.frombuffer(raw.buffers()[2] or b"\0", np.uint8)
    n = np.diff(ends)
    key = np.minimum(n, 5).astype(np.uint64)
    for j in range(4):
        key = (key << np.uint64(8)) | np.where(n > j, data[np.maximum(ends[1:] - 1 - j, 0)], 0).astype(np.uint64)
    return (mix(key) % np.uint64(CLASSES - 1)).astype(np.int64)


class Segments:
    """Sequences cut into segments, longest first; ``at`` holds positions by step."""

    def __init__(self, symbols: np.ndarray, offsets: np.ndarray, size: int = SEGMENT):
        lengths = np.diff(offsets)
        self.per_text = -(-lengths // size)
        self.text = np.repeat(np.arange(len(lengths)), self.per_text)
        firsts = np.concatenate([[0], np.cumsum(self.per_text)])[:-1]
        self.rank = np.arange(len(self.text)) - np.repeat(firsts, self.per_text)
        self.begin = offsets[:-1][self.text] + self.rank * size
        self.length = np.minimum(size, offsets[1:][self.text] - self.begin)
        self.last = self.rank == self.per_text[self.text] - 1
        self.symbols, self.texts, self.size = symbols, len(lengths), size
        self.order = np.argsort(-self.length, kind="stable")

    def chunks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(segments, symbols by step and segment, segments still going at each step)."""
        for a in range(0, len(self.order), _CHUNK):
            which = self.order[a:a + _CHUNK]
            n = self.length[which]
            steps = np.arange(n[0])
            at = np.minimum(self.begin[which] + steps[:, None], len(self.symbols) - 1)
            yield which, self.symbols[at], np.searchsorted(-n, -steps, "left")

    def rounds(self, backward: bool = False) -> Iterator[np.ndarray]:
        """Segments of equal rank, in the order that chains them."""
        by_rank = np.argsort(self.rank, kind="stable")
        edges = np.searchsorted(self.rank[by_rank], np.arange(self.rank.max(initial=-1) + 2))
        pieces = [by_rank[a:z] for a, z in zip(edges[:-1], edges[1:])]
        return iter(pieces[::-1] if backward else pieces)


def transfers(model: Model, segments: Segments) -> tuple[np.ndarray, np.ndarray]:
    """(products, log scales): product[i, j] of a segment leads from state i before it to j after it."""
    k = len(model.start)
    out, scale = np.empty((len(segments.text), k, k)), np.zeros(len(segments.text))
    emit = np.ascontiguousarray(model.emit.T)
    for which, symbols, going in segments.chunks():
        product, logs = np.tile(np.eye(k), (len(which), 1, 1)), np.zeros(len(which))
        for t, n in enumerate(going):
            step = product[:n] * emit[symbols[t, :n]][:, None, :]
            step = (step.reshape(-1, k) @ model.move).reshape(n, k, k)
            size = step.sum((1, 2))
            product[:n] = step / size[:, None, None]
            logs[:n] += np.log(size)
        out[which], scale[which] = product, logs
    return out, scale


def log_likelihood(model: Model, segments: Segments, products: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(natural log likelihood of each text, state distribution before each segment)."""
    state, total = np.tile(model.start, (segments.texts, 1)), np.zeros(segments.texts)
    before = np.empty((len(segments.text), len(model.start)))
    for which in segments.rounds():
        text = segments.text[which]
        before[which] = state[text]
        after = np.einsum("si,sij->sj", state[text], products[which])
        size = after.sum(1)
        state[text] = after / size[:, None]
        total[text] += np.log(size) + scale[which]
    return total, before


def expected_counts(model: Model, segments: Segments) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(starts, moves, emissions, log likelihood): Baum-Welch's expected counts, exact over whole texts."""
    k, classes = model.emit.shape
    products, scale = transfers(model, segments)
    total, before = log_likelihood(model, segments, products, scale)
    after, ahead = np.ones((len(segments.text), k)), np.ones((segments.texts, k))
    for which in segments.rounds(backward=True):
        text = segments.text[which]
        after[which] = ahead[text]
        back = np.einsum("sij,sj->si", products[which], ahead[text])
        ahead[text] = back / back.sum(1, keepdims=True)
    starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((k, classes))
    emit = np.ascontiguousarray(model.emit.T)
    for which, symbols, going in segments.chunks():
        steps = len(going)
        predicted, emitted = np.zeros((steps, len(which), k)), emit[symbols]
        now = before[which].copy()
        for t, n in enumerate(going):
            predicted[t, :n] = now[:n]
            seen = now[:n] * emitted[t, :n]
            now[:n] = (seen / seen.sum(1, keepdims=True)) @ model.move
        back, weights = after[which].copy(), np.zeros((steps, len(which), k))
        first = segments.rank[which] == 0
        ends = segments.last[which]
        for t in range(steps - 1, -1, -1):
            n = going[t]
            seen = predicted[t, :n] * emitted[t, :n]
            onward = back[:n] @ model.move.T
            size = (seen * onward).sum(1, keepdims=True)
            weights[t, :n] = seen * onward / size
            moving = ~(ends[:n] & (segments.length[which[:n]] == t + 1))
            moves += (seen / size * moving[:, None]).T @ back[:n]
            step = emitted[t, :n] * onward
            back[:n] = step / step.sum(1, keepdims=True)
        starts += weights[0][first].sum(0)
        for s in range(k):
            emits[s] += np.bincount(symbols.ravel(), weights[:, :, s].ravel(), classes)
    return starts, moves * model.move, emits, float(total.sum())


def next_model(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray) -> Model:
    """The model of expected counts, smoothed towards what all states emit."""
    overall = emits.sum(0) + 0.5
    overall /= overall.sum()
    emit = emits + SMOOTHING * overall
    start, move = starts + 1, moves + 1
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def fold_of(ids: pa.Array) -> np.ndarray:
    return np.array([0 if i is None else zlib.crc32(str(i).encode()) % FOLDS for i in ids.to_pylist()], np.int64)


def _training(ids: pa.Array) -> np.ndarray:
    return fold_of(ids) != HELD_OUT


def _symbols(row: dict, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(classes, offsets) of a block's texts, each closed by the end token."""
    counts = np.array(row["counts"], np.int64)
    classes = unpack(row["more"]).astype(np.int64)[unpack(row["data"])]
    symbols = np.insert(classes, np.cumsum(counts), END)
    lengths = counts + 1
    if only is not None:
        symbols, lengths = symbols[np.repeat(only, lengths)], lengths[only]
    return symbols, np.concatenate([[0], np.cumsum(lengths)])


def _count_task(model: Model):
    def run(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros(model.start.size + model.move.size + model.emit.size)
        for batch in batches:
            for row in batch.to_pylist():
                symbols, offsets = _symbols(row, _training(pa.array(row["ids"], pa.int64())))
                if len(symbols):
                    starts, moves, emits, _ = expected_counts(model, Segments(symbols, offsets))
                    total += np.concatenate([starts, moves.ravel(), emits.ravel()])
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["at", "value"])
    return run


def fit(blocks: DataFrame, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over the coded training texts; the counts of all tasks meet in one sum.

    What comes to the driver is one model: STATES x (CLASSES + STATES + 1) numbers.
    """
    model = first_model()
    k, classes = model.emit.shape
    for _ in range(rounds):
        sums = blocks.mapInArrow(_count_task(model), "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
        total = np.zeros(k + k * k + k * classes)
        for row in sums.collect():
            total[row.at] = row.value
        model = next_model(total[:k], total[k:k + k * k].reshape(k, k), total[k + k * k:].reshape(k, classes))
    return model


def _tally(batches) -> Iterator[pa.RecordBatch]:
    """One row per bucket: its distinct words and their counts, and the classes' sums."""
    def close(bucket: int, counts: dict[bytes, int]) -> pa.RecordBatch:
        known = sorted(w for w, n in counts.items() if n)
        n = np.array([counts[w] for w in known], np.int64)
        words = pa.array(known, pa.binary())
        cls = word_classes(words.cast(pa.string())) if known else np.zeros(0, np.int64)
        sums = np.stack([np.bincount(cls, n, CLASSES), np.bincount(cls, minlength=CLASSES)]).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([None], pa.int64()), pa.array([bucket], pa.int32()), pa.array([pack_words(words) if known else None], pa.binary()),
             pa.array([pack(n)], pa.binary()), pa.array([pack(sums.ravel())], pa.binary())], ["block", "bucket", "data", "more", "sums"])

    last, counts = None, {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != last:
                if last is not None:
                    yield close(last, counts)
                last, counts = row["bucket"], {}
            for word, n in zip(unpack_words(row["data"]), unpack(row["more"]).tolist()):
                counts[word] = counts.get(word, 0) + n
    if last is not None:
        yield close(last, counts)


def _make_lookup():
    """Answers for one bucket: the training count of each word; the bucket's own table comes first."""
    known: dict[bytes, int] = {}

    def answer(row: dict) -> bytes | None:
        if row["block"] is None:
            if row["data"] is not None:
                known.update(zip(unpack_words(row["data"]), unpack(row["more"]).tolist()))
            return None
        words = unpack_words(row["data"])
        return pack(np.fromiter((known.get(w, 0) for w in words), np.int64, len(words)))
    return answer


def _scorer(model: Model, class_tokens: np.ndarray, class_types: np.ndarray, tokens: int, types: int, end_count: int):
    spread = np.log10(class_tokens + class_types + 1.0)

    def finish(row: dict, codes: np.ndarray, answers: list[bytes]) -> pa.Table:
        ids = pa.array(row["ids"], pa.int64())
        counts = np.concatenate([np.zeros(0, np.int64), *[unpack(a).astype(np.int64) for a in answers]])[codes]
        lengths = np.array(row["counts"], np.int64)
        counts = np.insert(counts, np.cumsum(lengths), end_count)
        symbols, offsets = _symbols(row)
        text = np.repeat(np.arange(len(ids)), lengths + 1)
        segments = Segments(symbols, offsets)
        natural, _ = log_likelihood(model, segments, *transfers(model, segments))
        seen = np.bincount(text, np.log10(counts + 1.0), len(ids))
        base = seen - (lengths + 1) * np.log10(tokens + types + 1.0)
        score = seen - np.bincount(text, spread[symbols], len(ids)) + natural / np.log(10)
        return pa.table([ids, pa.array(fold_of(ids) == HELD_OUT), pa.array(lengths + 1),
                         pa.array(np.bincount(text, counts > 0, len(ids)).astype(np.int64)),
                         pa.array(np.full(len(ids), tokens, np.int64)), pa.array(base), pa.array(score)],
                        [f.split()[0] for f in SCORED.split(", ")])
    return finish


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Trains on the training folds and scores every whole text."""
    blocks, words = code_blocks(docs, id_col, text_col, lower=True, count_in=_training, describe=word_classes, write=True)
    model = fit(blocks, rounds)
    tables = materialize(by_bucket(words, _tally, "block long, bucket int, data binary, more binary, sums binary"), "word-counts")
    sums = np.zeros((2, CLASSES), np.int64)
    for row in tables.select("sums").collect():  # one row per bucket, of 2 x CLASSES numbers
        sums += unpack(row["sums"]).astype(np.int64).reshape(2, CLASSES)
    fold = F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % FOLDS, F.lit(0))
    ends = docs.where(fold != HELD_OUT).count()
    sums[:, END] = ends, int(ends > 0)
    answers = answer_words(tables.drop("sums").unionByName(words), _make_lookup, "block")
    finish = _scorer(model, sums[0], sums[1], int(sums[0].sum()), int(sums[1].sum()), ends)
    return finish_blocks(blocks, answers, finish, SCORED)
