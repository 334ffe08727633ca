"""Records that cross byte ranges, without reading a file in one task.

Spark's text reader deals a file out in byte ranges, cut at a separator. What a quote
or a bracket ahead of a range does to its records is not known inside the range; but a
range can report its effect for either state it may start in (outside or inside a
quoted part). Effects are functions on two states, so a range keeps the state, swaps
it or sets it, and the state any range starts in follows from the last one that sets
it and the number of swaps since. With that state each range cuts its own records. Only
records that cross a border, one or two a range, are put together by a shuffle.

A table of ranges has one row per byte range (128 MB unless configured otherwise). It
is sorted in one task and broadcast; that is its size bound.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.session import materialize

OUTSIDE, INSIDE = 0, 1


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, block, value): the texts between separators, by file and start of the byte range."""
    text = spark.read.option("lineSep", separator).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _runs(batches, columns: tuple[str, ...]) -> Iterator[tuple[tuple, bool, list[str]]]:
    """(range, whether it begins here, values): neighbours of one byte range, batch by batch."""
    last = None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in columns)))
        values = batch.column("value").to_pylist()
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                yield keys[start], keys[start] != last, values[start:i]
                last, start = keys[start], i


# CSV ---------------------------------------------------------------------------

def line_effect(delimiter: str) -> Callable[[str], tuple[int, int]]:
    """What a line does to a reader that starts it outside or inside a quoted field.

    A quote opens a field only at its start; doubled quotes stand for one; after the
    closing quote the rest of a field is plain.
    """
    d = re.escape(delimiter)
    to_open = rf'(?:(?:[^"{d}][^{d}]*+|"(?:[^"]++|"")*+"[^{d}]*+|){d})*+"(?:[^"]++|"")*+\Z'
    opens = re.compile(to_open, re.S).match
    stays = re.compile(rf'(?:[^"]++|"")*+(?:\Z|"[^{d}]*+{d}{to_open})', re.S).match

    def effect(line: str) -> tuple[int, int]:
        if '"' not in line:
            return OUTSIDE, INSIDE
        return int(opens(line) is not None), int(stays(line) is not None)
    return effect


def _line_effects(delimiter: str):
    def run(batches) -> Iterator[pa.RecordBatch]:
        effect, at, state, starts, rows = line_effect(delimiter), None, [0, 0], [0, 0], []
        for key, new, values in _runs(batches, ("file", "block")):
            if new:
                if at is not None:
                    rows.append((*at, *state, *starts))
                at, state, starts = key, [OUTSIDE, INSIDE], [0, 0]
            for line in values:
                after = effect(line)
                for s in (0, 1):
                    starts[s] += state[s] == OUTSIDE
                    state[s] = after[state[s]]
        if at is not None:
            rows.append((*at, *state, *starts))
        if rows:
            types = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                             ["file", "block", "out0", "out1", "n0", "n1"])
    return run


def with_start_state(effects: DataFrame) -> DataFrame:
    """Adds ``state``, that each range starts in; a file starts outside."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sets = F.col("out0") == F.col("out1")
    counted = effects.withColumn("_swaps", F.sum(((F.col("out0") == INSIDE) & (F.col("out1") == OUTSIDE)).cast("long")).over(upto))
    last = F.last(F.when(sets, F.struct("out0", "_swaps")), ignorenulls=True).over(before)
    staged = counted.withColumns({"_set": last, "_now": F.coalesce(F.max("_swaps").over(before), F.lit(0))})
    state = (F.coalesce("_set.out0", F.lit(OUTSIDE)) + F.col("_now") - F.coalesce("_set._swaps", F.lit(0))) % 2
    return staged.withColumn("state", state.cast("int")).drop("_swaps", "_set", "_now")


def _cut_lines(delimiter: str, joiner: str):
    """Records of each range: whole ones, and what belongs to a record that crosses its borders."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        effect = line_effect(delimiter)
        at, state, number, parts, leading, rows = None, OUTSIDE, 0, [], False, []

        def emit(crosses: bool) -> None:
            if parts:
                if joiner != "":
                    text = joiner.join(parts)
                else:
                    text = "".join(p.removesuffix("\r") for p in parts)
                rows.append((at[0], number, at[1], text, not crosses, number == at[4]))

        def batch() -> pa.RecordBatch:
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                              ["file", "number", "block", "record", "whole", "head"])
        for key, new, values in _runs(batches, ("file", "block", "state", "first", "top")):
            if new:
                emit(leading or state == INSIDE)
                at, state, parts = key, key[2], []
                leading, number = state == INSIDE, key[3] - 1
            for line in values:
                if state == OUTSIDE:
                    emit(leading)
                    parts, leading, number = [], False, number + 1
                parts.append(line)
                state = effect(line)[state]
            if len(rows) >= 10_000:
                yield batch()
                rows.clear()
        emit(leading or state == INSIDE)
        if rows:
            yield batch()
    return run


def csv_records(spark: SparkSession, path: str, delimiter: str = ",", joiner: str = "") -> DataFrame:
    """(file, number, record, head): the records of CSV files, numbered from 0 over all files in order.

    ``head`` marks the first record of each file. Line breaks inside quotes become ``joiner``. A quote that is never closed takes the
    rest of its file, as any reader has it.
    """
    lines = pieces(spark, path, "\n")
    effects = materialize(lines.mapInArrow(_line_effects(delimiter), "file string, block long, out0 int, out1 int, n0 long, n1 long"), "effects")
    started = with_start_state(effects).withColumn("n", F.when(F.col("state") == INSIDE, F.col("n1")).otherwise(F.col("n0")))
    earlier = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # one row a byte range
    ranges = started.select("file", "block", "state", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    # A file's first range opens with its first record.
    ranges = ranges.withColumn("top", F.min("first").over(Window.partitionBy("file")))
    cut = lines.join(F.broadcast(ranges), ["file", "block"]).select("file", "block", "state", "first", "top", "value").mapInArrow(
        _cut_lines(delimiter, joiner), "file string, number long, block long, record string, whole boolean, head boolean")
    crossing = (cut.where(~F.col("whole")).groupBy("file", "number")
                .agg(F.sort_array(F.collect_list(F.struct("block", "record"))).alias("p"), F.max("head").alias("head"))
                .select("file", "number", F.array_join(F.transform("p", lambda x: x["record"]), joiner).alias("record"), "head"))
    text = F.col("record")
    ended = F.when(text.endswith("\r"), F.left(text, F.length(text) - 1)).otherwise(text)
    return cut.where("whole").select("file", "number", "record", "head").unionByName(crossing).withColumn("record", ended)


# JSON --------------------------------------------------------------------------

_REST = re.compile(r'(?:[^"\\]++|\\.)*+', re.S)
_TOKEN = re.compile(r'"(?:[^"\\]++|\\.)*+("?)|[\[\]{},]', re.S)


def structure(value: str, state: int) -> tuple[int, list[tuple[str, int]]]:
    """(state at the end, brackets and commas outside strings with their places)."""
    at = 0
    if state == INSIDE:
        at = _REST.match(value).end()
        if value[at:at + 1] != '"':
            return INSIDE, []
        at += 1
    found = []
    for token in _TOKEN.finditer(value, at):
        if token[1] is None:
            found.append((token[0], token.start()))
        elif not token[1]:
            return INSIDE, found
    return OUTSIDE, found


_STEP = {"[": 1, "{": 1, "]": -1, "}": -1, ",": 0}


def _json_effects(batches) -> Iterator[pa.RecordBatch]:
    """A range's effect for both states: the state after it, the change of depth, commas by relative depth."""
    at, runs, rows, opening = None, [], [], None

    def done() -> None:
        rows.append((*at, runs[0][0], runs[1][0], runs[0][1], runs[1][1], list(runs[0][2].items()), list(runs[1][2].items()), opening))
    for key, new, values in _runs(batches, ("file", "block")):
        if new:
            if at is not None:
                done()
            at, runs, opening = key, [[OUTSIDE, 0, {}], [INSIDE, 0, {}]], None
        for value in values:
            if opening is None and value.strip():
                opening = value.lstrip("﻿ \t\r\n")[:1]
            for run in runs:
                after, found = structure(value, run[0])
                depth, commas = run[1], run[2]
                for mark, _ in found:
                    if mark == ",":
                        commas[depth] = commas.get(depth, 0) + 1
                    depth += _STEP[mark]
                run[0], run[1] = after, depth - (after == OUTSIDE)  # the brace the pieces are cut at
    if at is not None:
        done()
    if rows:
        counts = pa.map_(pa.int64(), pa.int64())
        types = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), counts, counts, pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                         ["file", "block", "out0", "out1", "d0", "d1", "commas0", "commas1", "opening"])


def _cut_elements(batches) -> Iterator[pa.RecordBatch]:
    """Objects of the top-level array, whole or as parts of one that crosses a border."""
    at, state, depth, index, parts, whole, rows = None, OUTSIDE, 0, 0, None, True, []

    def emit(complete: bool) -> None:
        rows.append((at[0], index, at[1], "".join(parts), complete))

    def batch() -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                          ["file", "number", "block", "record", "whole"])
    for key, new, values in _runs(batches, ("file", "block", "state", "depth", "first")):
        if new:
            if parts:
                emit(False)
            at, state, depth, index = key, *key[2:]
            parts, whole = ([], False) if depth > 1 else (None, True)
        for value in values:
            start = 0
            state, found = structure(value, state)
            for mark, place in found:
                if mark == "{" and depth == 1 and parts is None:
                    parts, whole, start = [], True, place
                depth += _STEP[mark]
                if mark == "," and depth == 1:
                    index += 1
                if mark == "]" and depth == 1 and parts is not None:  # a list among the elements ends
                    parts.append(value[start:place + 1])
                    if not whole:
                        emit(False)
                    parts = None
            if parts is not None:
                parts.append(value[start:] + "}")
            if state == OUTSIDE:
                depth -= 1
                if depth == 1 and parts is not None:
                    emit(whole)
                    parts = None
        if len(rows) >= 10_000:
            yield batch()
            rows.clear()
    if parts:
        emit(False)
    if rows:
        yield batch()


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, record): the objects of JSON documents that are one array each, and their places in it.

    Documents are cut at closing braces, so one without line breaks is spread as well.
    A document that is no array, or whose brackets do not close, gives no rows.
    """
    parts = pieces(spark, path, "}")
    counts = "map<bigint, bigint>"
    effects = materialize(parts.mapInArrow(_json_effects, "file string, block long, out0 int, out1 int, d0 long, d1 long, "
                                                          f"commas0 {counts}, commas1 {counts}, opening string"), "effects")
    started = with_start_state(effects)
    inside = F.col("state") == INSIDE
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    deep = started.withColumn("d", F.when(inside, F.col("d1")).otherwise(F.col("d0"))).withColumn(
        "depth", F.coalesce(F.sum("d").over(before), F.lit(0)))
    commas = F.when(inside, F.col("commas1")).otherwise(F.col("commas0"))
    counted = deep.withColumn("commas", F.coalesce(F.try_element_at(commas, 1 - F.col("depth")), F.lit(0)))
    # A brace is counted after every piece; the last one has none, so a closed document ends one below.
    closed = counted.withColumns({
        "first": F.coalesce(F.sum("commas").over(before), F.lit(0)), "_end": F.sum("d").over(whole),
        "_opening": F.min(F.struct("block", "opening")).over(whole)["opening"],
        "_last": F.max(F.struct("block", F.when(inside, F.col("out1")).otherwise(F.col("out0")).alias("out"))).over(whole)["out"]})
    ranges = closed.where((F.col("_end") == -1) & (F.col("_opening") == "[") & (F.col("_last") == OUTSIDE)).select(
        "file", "block", "state", "depth", "first")
    cut = parts.join(F.broadcast(ranges), ["file", "block"]).select("file", "block", "state", "depth", "first", "value").mapInArrow(
        _cut_elements, "file string, number long, block long, record string, whole boolean")
    crossing = (cut.where(~F.col("whole")).groupBy("file", "number")
                .agg(F.sort_array(F.collect_list(F.struct("block", "record"))).alias("p"))
                .select("file", "number", F.array_join(F.transform("p", lambda x: x["record"]), "").alias("record")))
    return cut.where("whole").select("file", "number", "record").unionByName(crossing.where(F.col("record").startswith("{")))
