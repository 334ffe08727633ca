"""Near-duplicates by ProbMinHash, banding and exact verification.

A document is the weighted set of its five-word shingles, lower-cased; a shingle
weighs as often as it occurs. Each shingle is a Poisson process whose rate is its
weight: its arrivals, drawn from its hash, fall on random registers, and a register
keeps the shingle that arrived first. Two registers agree with the probability Jaccard
similarity of the documents. A shingle stops as soon as its next arrival is later than
every register's, so most draw few. A document in which a shingle recurs draws a
second set of registers with equal weights, whose similarity is the Jaccard similarity
of the sets; without repeats the two are one. Documents are linked if either
similarity reaches the threshold: repeating a passage does not hide a copy.

Texts with the same words are one node. Registers are banded; the smallest node of a
band's bucket is its hub. Every node is first compared exactly with the smallest of its
hubs. One minus a similarity that registers agree with is a metric, so afterwards only
those pairs of a hub's members remain that are not connected yet and whose distances
to it differ by no more than a link spans. Registers estimate these pairs, each by the
measures that decide, and the exact similarities decide. Only links that join two
parts leave a task. Members meet their hub in salted parts of ``BLOCK``; remaining
ones are compared in blocks against blocks. Classes are the components of the verified
links; no link between texts that share a band is lost.

Defined results: null and empty texts have no words and are copies of each
other; a text of one to four words has one shingle, all its words; rows that
share a doc_id and their words are one document, different words under one doc_id
are documents of their own; a null doc_id is an id like any other, comes before
all others and back as null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.components import components
from tallyframe.llm.incidence import ranges
from tallyframe.llm.words import bound_batches, distinct_shingles, mix, row_key, slices, words_of
from tallyframe.session import materialize

THRESHOLD = 0.8
BANDS, ROWS = 30, 6
REGISTERS = BANDS * ROWS
BLOCK = 1000
_SLICE = 2 << 20
_EPSILON = 1e-9
_DRAW, _CHOOSE, _WORD = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, (1 << 64) - 1


def prob_min_hash(hashes: np.ndarray, weights: np.ndarray, offsets: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Register x text: the shingle hash that arrived first; 0 for a text without shingles."""
    texts = len(offsets) - 1
    first = np.full(texts * registers, np.inf)
    who = np.zeros(texts * registers, np.uint64)
    text = np.repeat(np.arange(texts), np.diff(offsets))
    h, w, time, step = hashes, weights, np.zeros(len(hashes)), 0
    while len(h):
        step += 1
        draw = mix(h + np.uint64(step * _DRAW & _WORD)) >> np.uint64(11)
        time = time - np.log((draw.astype(np.float64) + 1) / (1 << 53)) / w
        at = text * registers + (mix(h ^ np.uint64(step * _CHOOSE & _WORD)) % np.uint64(registers)).astype(np.int64)
        early = np.flatnonzero(time < first[at])
        np.minimum.at(first, at[early], time[early])
        won = early[first[at[early]] == time[early]]
        who[at[won]] = h[won]
        new = np.ones(len(text), bool)
        new[1:] = text[1:] != text[:-1]  # texts stay in order
        latest = first.reshape(texts, registers)[text[new]].max(axis=1)
        going = time < latest[np.cumsum(new) - 1]
        h, w, time, text = h[going], w[going], time[going], text[going]
    return who.reshape(texts, registers)


def _registers(h: np.ndarray, counts: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(registers of equal weights, texts with repeats, their registers of counted weights)."""
    repeats = np.flatnonzero(np.add.reduceat(np.append(counts > 1, False), offsets[:-1]) * (np.diff(offsets) > 0)) \
        if len(offsets) > 1 else np.empty(0, np.int64)
    sizes = np.diff(offsets)[repeats]
    at = ranges(offsets[repeats], sizes)
    weighted = prob_min_hash(h[at], counts[at].astype(np.float64), np.concatenate([[0], np.cumsum(sizes)]))
    return prob_min_hash(h, np.ones(len(h)), offsets), repeats, weighted


def _band_keys(who: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(who), BANDS), np.uint64)
    for row in range(ROWS):
        keys = mix(keys * np.uint64(31) + who[:, row::ROWS] + np.arange(1, BANDS + 1, dtype=np.uint64))
    return keys.view(np.int64)


def _sketch(batches) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", _SLICE):
        words = words_of(part.column("text"))
        h, counts, offsets = distinct_shingles(words)
        equal, repeats, weighted = _registers(h, counts, offsets)
        some = np.diff(offsets) > 0
        lengths = some * BANDS
        lengths[repeats] += BANDS
        ends = np.cumsum(lengths)
        flat = np.empty(ends[-1] if len(ends) else 0, np.int64)
        flat[((ends - lengths)[some, None] + np.arange(BANDS)).ravel()] = _band_keys(equal)[some].ravel()
        flat[(ends[repeats, None] - BANDS + np.arange(BANDS)).ravel()] = _band_keys(weighted).ravel()
        code = np.array([xxhash.xxh64_intdigest(w) for w in words.vocabulary.cast(pa.binary()).to_pylist()], np.uint64)[words.codes]
        same = [xxhash.xxh3_128_digest(code[a:z].tobytes()) for a, z in zip(words.offsets[:-1], words.offsets[1:])]
        bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(same, pa.binary()), bands],
                                         ["doc_id", "row", "same", "bands"])


_SETS = "hashes binary, counts binary, registers binary, weighted binary"


def _shingle_rows(keys: tuple[str, ...]):
    """Keys, shingles, their counts (nothing where none recurs) and 16 bits of each register."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", _SLICE):
            h, counts, offsets = distinct_shingles(words_of(part.column("text")))
            equal, repeats, weighted = ((mix(x) & np.uint64(0xFFFF)).astype(np.uint16) if x.dtype == np.uint64 else x
                                        for x in _registers(h, counts, offsets))
            bounds = list(zip(offsets[:-1], offsets[1:]))
            own, theirs = [b""] * len(bounds), [b""] * len(bounds)
            for i, row in zip(repeats, weighted):
                own[i], theirs[i] = row.tobytes(), counts[slice(*bounds[i])].astype(np.uint32).tobytes()
            yield pa.RecordBatch.from_arrays(
                [*(part.column(k) for k in keys), pa.array([h[a:z].tobytes() for a, z in bounds], pa.binary()),
                 pa.array(theirs, pa.binary()), pa.array([row.tobytes() for row in equal], pa.binary()), pa.array(own, pa.binary())],
                [*keys, "hashes", "counts", "registers", "weighted"])
    return run


def similarities(a: np.ndarray, a_counts: np.ndarray | None, b: np.ndarray, b_counts: np.ndarray | None) -> tuple[float, float]:
    """Exact (probability Jaccard, Jaccard) of two sets of ascending hashes; no counts mean one each.

    A shared element x adds 1 / sum over y of max(a_y / a_x, b_y / b_x); an element y is
    scaled by a where b_y / a_y is at most b_x / a_x, so sums up to each ratio suffice.
    """
    if not len(a) or not len(b):
        return (1.0, 1.0) if len(a) == len(b) else (0.0, 0.0)
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    shared = a[at] == b
    n = int(shared.sum())
    jaccard = n / (len(a) + len(b) - n)
    if a_counts is None and b_counts is None:
        return jaccard, jaccard
    x = np.ones(n) if a_counts is None else a_counts[at[shared]].astype(np.float64)
    y = np.ones(n) if b_counts is None else b_counts[shared].astype(np.float64)
    only_a = (len(a) if a_counts is None else a_counts.sum()) - x.sum()
    only_b = (len(b) if b_counts is None else b_counts.sum()) - y.sum()
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    ratio = y / x
    last = np.searchsorted(ratio, ratio, side="right")
    below = only_a + np.cumsum(np.append(0.0, x))[last]
    above = only_b + y.sum() - np.cumsum(np.append(0.0, y))[last]
    return float((1 / (below / x + above / y)).sum()), jaccard


def _sets(group: pa.Table) -> list[tuple[np.ndarray, np.ndarray | None]]:
    return [(np.frombuffer(h, np.uint64), np.frombuffer(c, np.uint32) if c else None)
            for h, c in zip(group.column("hashes").to_pylist(), group.column("counts").to_pylist())]


def _with_hub(group: pa.Table) -> pa.Table:
    """Exact similarities of every member of a part with its hub, which comes with it."""
    node, hub = group.column("node").to_numpy(), group.column("hub").to_numpy()
    sets = _sets(group)
    center = sets[int(np.flatnonzero(node == hub)[0])]
    others = np.flatnonzero(node != hub)
    alike = [similarities(*sets[i], *center) for i in others]
    return pa.table([pa.array(node[others], pa.int64()), pa.array(hub[others], pa.int64()), pa.array([x[0] for x in alike], pa.float64()),
                     pa.array([x[1] for x in alike], pa.float64())], ["node", "hub", "alike", "equal"])


def _verifier(threshold: float):
    margin = 4 * np.sqrt(threshold * (1 - threshold) / REGISTERS)
    span = 1 - threshold + _EPSILON

    def verify(group: pa.Table) -> pa.Table:
        """Verified links that join two parts of a block, or of two blocks."""
        node, side, label = (group.column(c).to_numpy() for c in ("node", "side", "label"))
        rays = [group.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("alike", "equal")]
        first, second = group.column("first")[0].as_py(), group.column("second")[0].as_py()
        sets = _sets(group)
        plain = group.column("registers").to_pylist()
        registers = [np.stack([np.frombuffer(x, np.uint16) for x in plain]),
                     np.stack([np.frombuffer(w or x, np.uint16) for w, x in zip(group.column("weighted").to_pylist(), plain)])]
        left, right = np.flatnonzero(side == first), np.flatnonzero(side == second)
        pairs = []
        for i in left:
            others = right[right > i] if first == second else right
            others = others[label[others] != label[i]]
            # Distances to the hub bound those of a pair; an unknown one (NaN) bounds nothing.
            apart = [np.abs(r[others] - r[i]) > span for r in rays]
            others = others[~(apart[0] & apart[1])]
            estimate = np.maximum(*((r[others] == r[i]).mean(axis=1) for r in registers))
            near = estimate >= threshold - margin
            pairs.extend(zip(estimate[near].tolist(), [int(i)] * int(near.sum()), others[near].tolist()))
        parent = {x: x for x in label.tolist()}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        links = []
        for _, i, j in sorted(pairs, reverse=True):
            a, b = root(int(label[i])), root(int(label[j]))
            if a != b and max(similarities(*sets[i], *sets[j])) >= threshold - _EPSILON:
                parent[a] = b
                links.append((int(node[i]), int(node[j])))
        return pa.table([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])
    return verify


def _shingled(texts: DataFrame, nodes: DataFrame, placed: DataFrame) -> DataFrame:
    """placed (node and other columns) beside the shingles of its nodes; the same plan at every size."""
    keys = tuple(placed.columns)
    # Blocks of a large hub multiply its members, which Spark's size of placed leaves out.
    rows = placed.hint("merge").join(nodes.select("node", "row"), "node").select("row", *keys)
    # Rows that repeat id and text come once; one shuffle of the texts serves both steps.
    members = texts.select("row", "text").dropDuplicates(["row"]).join(rows.hint("merge"), "row").select(*keys, "text")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema)
    return members.mapInArrow(_shingle_rows(keys), f"{kinds}, {_SETS}")


def _links(texts: DataFrame, nodes: DataFrame, threshold: float, block: int) -> DataFrame:
    """Verified links (a, b) that connect all nodes of a class."""
    banded = nodes.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub <> top")
    # Spark takes an exploded array for one number, and so would broadcast the bands of all nodes.
    stars = materialize(banded.hint("merge").join(buckets.select("band", "hub"), "band").select("node", "hub").distinct(), "stars")
    nearest = stars.groupBy("node").agg(F.min("hub").alias("hub")).where("node <> hub")
    sizes = nearest.groupBy("hub").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    members = nearest.join(sizes, "hub").select("node", "hub", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    hubs = sizes.select(F.col("hub").alias("node"), "hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rays = materialize(_shingled(texts, nodes, members.unionByName(hubs)).groupBy("hub", "part").applyInArrow(
        _with_hub, "node long, hub long, alike double, equal double"), "rays")
    found = rays.where(F.greatest("alike", "equal") >= threshold - _EPSILON).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    known = components(found)
    # All members of the hubs that are still apart from some; members of the hub's own part only if a link can span to one.
    labels = stars.join(known, "node", "left").select("node", "hub", F.coalesce("label", "node").alias("label"))
    own = labels.where("node = hub").select("hub", F.col("label").alias("hub_label"))
    apart = labels.join(own, "hub").join(rays, ["node", "hub"], "left").withColumn("far", F.col("label") != F.col("hub_label"))
    apart = materialize(apart, "apart")
    reach = apart.where("far").groupBy("hub").agg(*[F.max(F.coalesce(c, F.lit(1.0))).alias(f"far_{c}") for c in ("alike", "equal")])
    span = 1 - threshold + _EPSILON
    rest = apart.join(reach, "hub").where(F.col("far") | F.col("alike").isNull() | (F.col("alike") - F.col("far_alike") <= span)
                                          | (F.col("equal") - F.col("far_equal") <= span))
    sizes = rest.groupBy("hub").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sides = rest.join(sizes, "hub").select("node", "hub", "label", "alike", "equal", "blocks",
                                           F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("side"))
    placed = sides.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "node", "hub", "label", "alike", "equal", "side", F.least("side", "other").alias("first"), F.greatest("side", "other").alias("second"))
    more = (_shingled(texts, nodes, placed).groupBy("hub", "first", "second").applyInArrow(_verifier(threshold), "a long, b long"))
    return materialize(found.unionByName(more), "links")  # read from both ends


def _classes(texts: DataFrame, threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, same) of every row of texts (doc_id, text, row), and (same, class_id, class_row) of their distinct words."""
    bound_batches(texts.sparkSession, _SLICE)
    sketches = materialize(texts.mapInArrow(_sketch, "doc_id long, row binary, same binary, bands array<long>"), "sketches")
    # Texts with the same words are one node, the row with the smallest id stands for it.
    nodes = materialize(sketches.groupBy("same").agg(F.min(F.struct("doc_id", "row", "bands")).alias("s"))
                        .select("same", "s.*", F.monotonically_increasing_id().alias("node")), "nodes")
    labels = components(_links(texts, nodes, threshold, block))
    labelled = nodes.join(labels, "node", "left").select("same", "doc_id", "row", F.coalesce("label", "node").alias("label"))
    heads = labelled.groupBy("label").agg(F.min(F.struct("doc_id", "row")).alias("head"))
    classes = labelled.join(heads, "label").select(
        "same", F.col("head.doc_id").alias("class_id"), F.col("head.row").alias("class_row"))
    return sketches.select("doc_id", "same"), classes


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                       row_key(id_col, text_col).alias("row"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                    block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, class_row): one row per document; the class is its smallest doc_id, and
    class_row tells classes apart whose smallest doc_id is the same."""
    rows, classes = _classes(_keyed(docs, id_col, text_col), threshold, block)
    return rows.distinct().join(classes, "same").select("doc_id", "class_id", "class_row")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
             block: int = BLOCK) -> DataFrame:
    """The documents that stay: of every class, the one with the smallest doc_id."""
    _, classes = _classes(_keyed(docs, id_col, text_col), threshold, block)
    heads = classes.select(F.col("class_row").alias("_head")).distinct()
    return (docs.withColumn("_row", row_key(id_col, text_col)).join(heads, F.col("_row") == F.col("_head"), "left_semi")
            .dropDuplicates(["_row"]).drop("_row"))
