"""Conversation structure repair by grammar-compressed dynamic programming.

A conversation is a sequence of symbols, one a row: the initial of its role and its
first fault. The cheapest edits that give roles ``(s?(ua)+)?`` are a path through an
automaton of four states, so every symbol is a 4 x 4 matrix over (min, +), whose
entries carry the letters of their edits as a rope. Re-Pair replaces the symbol pairs
that recur in a block of conversations by rules; one matrix a rule, evaluated bottom-up
from those of its two symbols, serves all conversations of the block that hold it.

Two orderings by (conversation, turn) are all that is shuffled. Both read their rows as
a stream: the first keeps a 128-bit hash and a symbol a row of the conversation at hand,
the second nothing but its letters, so texts of any number and length pass through.

Defined results: null conversations are a conversation of their own; null turns come
first; null roles and texts are one space; rows of one turn stand in the order of role
and text; a conversation that is listed in ``conversations`` but has no rows is legal
and empty; a role that begins with none of s, u, a is edited like any other, but never
kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.session import materialize

DELETE, KEEP, INSERT, REROLE = "D", "K", "I", "R"
COST_DELETE, COST_INSERT, COST_REROLE, COST_TRUNCATED = 2, 5, 1, 5
#: States: nothing written, after the system row, after a user row, after an assistant row.
STATES, ACCEPTING = 4, (0, 3)
_TURN_TO_USER, _TURN_TO_ASSISTANT = (0, 1, 3), (2,)
LEGAL_PAIRS = frozenset({"su", "ua", "au"})
INITIALS = "sua"
SOUND, TRUNCATED, DEAD = 0, 1, 2
BLOCK_SYMBOLS = 1 << 18
_BASE, _PRIME = 1_000_003, (1 << 61) - 1
_WORD = re.compile(r"[^\x20\x09-\x0D]")
_LAST = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")


class Rope:
    """Letters of edits as a binary tree; parts are shared between the entries that hold them.

    A rope knows its length and a 61-bit hash of its letters, so two ropes are compared
    by going down to their first difference, past equal parts unread.
    """
    __slots__ = ("left", "right", "leaf", "size", "hash", "power")

    def __init__(self, leaf: str = "", left: Rope | None = None, right: Rope | None = None):
        self.left, self.right, self.leaf = left, right, leaf
        if left is None:
            self.size, self.hash, self.power = len(leaf), ord(leaf) if leaf else 0, _BASE if leaf else 1
        else:
            self.size, self.power = left.size + right.size, left.power * right.power % _PRIME
            self.hash = (left.hash * right.power + right.hash) % _PRIME

    def __add__(self, other: Rope) -> Rope:
        return other if not self.size else self if not other.size else Rope(left=self, right=other)

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            rope = stack.pop()
            if rope.left is None:
                out.append(rope.leaf)
            else:
                stack += (rope.right, rope.left)
        return "".join(out)

    def before(self, other: Rope) -> bool:
        """Whether these letters sort first."""
        if not self.size or not other.size:
            return self.size < other.size
        mine, theirs = [self], [other]
        while mine and theirs:
            a, b = mine.pop(), theirs.pop()
            if a.size == b.size and a.hash == b.hash:
                continue
            if a.size == 1 == b.size:
                return a.leaf < b.leaf
            if a.size >= b.size:
                mine += (a.right, a.left)
            else:
                mine.append(a)
            if b.size >= a.size:
                theirs += (b.right, b.left)
            else:
                theirs.append(b)
        return bool(theirs)


Entry = tuple[int, Rope] | None
Matrix = list[list[Entry]]


def better(a: Entry, b: Entry) -> Entry:
    """The cheaper entry; of equal ones the one whose letters sort first.

    Paths over the same rows that cost the same never are prefixes of each other, as
    the rest would be insertions, so the choice stays right whatever follows.
    """
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if b[1].before(a[1]) else a


def times(left: Matrix, right: Matrix) -> Matrix:
    out: Matrix = [[None] * len(right[0]) for _ in left]
    for i, row in enumerate(left):
        for k, first in enumerate(row):
            if first is not None:
                for j, second in enumerate(right[k]):
                    if second is not None:
                        cost, now = first[0] + second[0], out[i][j]
                        if now is None or cost <= now[0]:
                            out[i][j] = better(now, (cost, first[1] + second[1]))
    return out


def _insertions() -> Matrix:
    """Any number of inserted rows; more than a turn around the automaton never pays."""
    step: Matrix = [[None] * STATES for _ in range(STATES)]
    same: Matrix = [[(0, Rope()) if i == j else None for j in range(STATES)] for i in range(STATES)]
    for source, target in [*((s, 2) for s in _TURN_TO_USER), *((s, 3) for s in _TURN_TO_ASSISTANT)]:
        step[source][target] = (COST_INSERT, Rope(INSERT))
    once = [[better(a, b) for a, b in zip(x, y)] for x, y in zip(same, step)]
    return times(once, once)


INSERTIONS = _insertions()


def symbol(initial: str, fault: int) -> int:
    """0 to 11: the role's initial (s, u, a, other) and the fault."""
    at = INITIALS.find(initial) if initial else -1
    return (at if at >= 0 else len(INITIALS)) * 3 + fault


def symbol_matrix(sym: int) -> Matrix:
    """Insertions, then one edit of the row."""
    role, fault = divmod(sym, 3)
    out: Matrix = [[None] * STATES for _ in range(STATES)]

    def offer(source: int, target: int, cost: int, letter: str) -> None:
        out[source][target] = better(out[source][target], (cost, Rope(letter)))

    for state in range(STATES):
        offer(state, state, COST_DELETE, DELETE)
    if fault != DEAD:
        extra = COST_TRUNCATED if fault == TRUNCATED else 0
        to_user, to_assistant = [(s, 2) for s in _TURN_TO_USER], [(s, 3) for s in _TURN_TO_ASSISTANT]
        for source, target in ([(0, 1)], to_user, to_assistant, [])[role]:
            offer(source, target, extra, KEEP)
        for source, target in to_user + to_assistant:
            offer(source, target, COST_REROLE + extra, REROLE)
    return times(INSERTIONS, out)


SYMBOLS = 3 * (len(INITIALS) + 1)
SYMBOL_MATRICES = [symbol_matrix(s) for s in range(SYMBOLS)]


def re_pair(sequences: list[np.ndarray], symbols: int = SYMBOLS) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """(rules, sequences): pairs are replaced until none stands twice.

    Rule i makes symbol ``symbols + i``. A round replaces the most frequent pairs that
    share no symbol, which never overlap; in a run of one symbol every other pair goes.
    """
    rules: list[tuple[int, int]] = []
    owner = np.repeat(np.arange(len(sequences)), [len(s) for s in sequences])
    flat = np.concatenate(sequences).astype(np.int64) if len(owner) else np.empty(0, np.int64)
    while len(flat) > 1:
        size = symbols + len(rules)
        near = owner[1:] == owner[:-1]
        code = np.where(near, flat[:-1] * size + flat[1:], -1)
        # In a run of one symbol only every other place can start a pair.
        twin = near & (flat[1:] == flat[:-1])
        fresh = np.flatnonzero(~np.concatenate([[False], twin]))
        run = np.arange(len(flat)) - fresh[np.cumsum(~np.concatenate([[False], twin])) - 1]
        code[twin & (run[:-1] % 2 == 1)] = -1
        pairs, counts = np.unique(code[code >= 0], return_counts=True)
        frequent = np.flatnonzero(counts >= 2)
        if not len(frequent):
            break
        order = frequent[np.lexsort((pairs[frequent], -counts[frequent]))]
        rule_of = np.full(len(pairs), -1)
        used: set[int] = set()
        for at in order.tolist():
            x, y = divmod(int(pairs[at]), size)
            if x not in used and y not in used:
                used |= {x, y}
                rule_of[at] = symbols + len(rules)
                rules.append((x, y))
        place = np.searchsorted(pairs, code)
        made = np.where(code >= 0, rule_of[np.minimum(place, len(pairs) - 1)], -1)
        hit = np.flatnonzero(made >= 0)
        flat[hit] = made[hit]
        keep = np.ones(len(flat), bool)
        keep[hit + 1] = False
        flat, owner = flat[keep], owner[keep]
    bounds = np.searchsorted(owner, np.arange(len(sequences) + 1))
    return rules, [flat[a:z] for a, z in zip(bounds[:-1], bounds[1:])]


def rule_matrices(rules: list[tuple[int, int]]) -> list[Matrix]:
    """The matrices of all symbols, each rule's from those of its pair."""
    matrices = list(SYMBOL_MATRICES)
    for x, y in rules:
        matrices.append(times(matrices[x], matrices[y]))
    return matrices


def cheapest(sequence: np.ndarray, matrices: list[Matrix]) -> tuple[int, str]:
    """(cost, letters) of the cheapest edits of a compressed sequence."""
    row: Matrix = [[(0, Rope()), None, None, None]]
    for sym in sequence.tolist():
        row = times(row, matrices[sym])
    cost, rope = None, None
    for state in ACCEPTING:
        end = times(row, INSERTIONS)[0][state]
        best = better(None if rope is None else (cost, rope), end)
        if best is not None:
            cost, rope = best
    return cost, rope.text()


def edits(sequences: list[bytes]) -> dict[bytes, tuple[int, str]]:
    """(cost, letters) of every distinct sequence of a block."""
    distinct = list(dict.fromkeys(sequences))
    rules, short = re_pair([np.frombuffer(s, np.uint8) for s in distinct])
    matrices = rule_matrices(rules)
    return {s: cheapest(c, matrices) for s, c in zip(distinct, short)}


def fault_of(text: str, seen: bool) -> str:
    """The first fault of a row, or nothing."""
    if not _WORD.search(text):
        return "blank"
    if seen:
        return "duplicate"
    return "" if _LAST.search(text)[1] in ".!?" else "truncated"


_COUNTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, symbols binary"
_COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal"]
_AUDITED = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, rows long, cost long, audit string")


class _Conversation:
    """What is kept of the conversation at hand while its rows pass."""

    def __init__(self, conv_id):
        self.conv_id, self.symbols, self.seen, self.last = conv_id, bytearray(), set(), None
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.turns = 0
        self.low = self.high = None

    def add(self, turn, role: str, text: str) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        key = xxhash.xxh3_128_digest(f"{len(role)}:{role}{text}".encode())
        fault = fault_of(text, key in self.seen)
        self.seen.add(key)
        if fault:
            self.faults[fault] += 1
        initial = role[:1]
        self.illegal += bool(self.symbols) and self.last + initial not in LEGAL_PAIRS
        self.last = initial
        self.symbols.append(symbol(initial, SOUND if not fault else TRUNCATED if fault == "truncated" else DEAD))

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, *self.faults.values(), self.illegal, bytes(self.symbols))


def _sequences(batches) -> Iterator[pa.RecordBatch]:
    """One row a conversation, its symbols packed into bytes; rows come in order, a marker ahead of them."""
    at, done, size = None, [], 0
    schema = pa.schema([(c, pa.int64()) for c in _COLUMNS] + [("symbols", pa.binary())])

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), schema.types)], schema=schema)

    for part in batches:
        for conv_id, turn, role, text, kind in zip(*(part.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "kind"))):
            if at is None or at.conv_id != conv_id:
                if at is not None:
                    done.append(at.row())
                    size += len(at.symbols) + 100
                    if size >= BLOCK_SYMBOLS:
                        yield batch()
                        done, size = [], 0
                at = _Conversation(conv_id)
            if kind:
                at.add(turn, role, text)
    if at is not None:
        done.append(at.row())
        yield batch()


def _audits(batches) -> Iterator[pa.RecordBatch]:
    """Adds the cheapest edits; a block of conversations shares one grammar."""
    for part in batches:
        symbols = part.column("symbols").to_pylist()
        best = edits(symbols)
        yield pa.RecordBatch.from_arrays(
            [part.column(c) for c in _COLUMNS]
            + [pa.array([len(s) for s in symbols], pa.int64()), pa.array([best[s][0] for s in symbols], pa.int64()),
               pa.array([best[s][1] for s in symbols])], [*_COLUMNS, "rows", "cost", "audit"])


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text")


def _plain(rows: DataFrame) -> DataFrame:
    blank = F.lit(" ")
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", blank).alias("role"),
                       F.coalesce("text", blank).alias("text"), F.lit(1).alias("kind"))


def audit(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row a conversation of rows (conv_id, turn, role, text): its faults and its cheapest edits.

    gaps: turns missing between the smallest and the largest; illegal: neighbours whose
    initials are not su, ua or au; rows: their number; cost and audit: the edits, a letter each.
    """
    known = (rows if conversations is None else conversations).select(F.col("conv_id").cast("long")).distinct()
    nothing = F.lit(None)
    markers = known.select("conv_id", nothing.cast("long").alias("turn"), nothing.cast("string").alias("role"),
                           nothing.cast("string").alias("text"), F.lit(0).alias("kind"))
    return _ordered(_plain(rows).unionByName(markers)).mapInArrow(_sequences, _COUNTS).mapInArrow(_audits, _AUDITED)


_REPAIRED = "conv_id long, place long, role string, text string, edit string"


def _rewrite(batches) -> Iterator[pa.RecordBatch]:
    """The repaired rows; a conversation's letters stand ahead of its rows."""
    out: list[tuple] = []
    letters, at, place, last = "", 0, 0, ""

    def write(conv_id, role: str, text: str, letter: str) -> None:
        nonlocal place, last
        if letter != KEEP:
            role = "assistant" if last == "u" else "user"
        out.append((conv_id, place, role, text, letter))
        place, last = place + 1, role[0]

    for part in batches:
        for conv_id, kind, role, text in zip(*(part.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text"))):
            if not kind:
                letters, at, place, last = text, 0, 0, ""
            else:
                if letters[at] != DELETE:
                    write(conv_id, role, text, letters[at])
                at += 1
            while letters[at:at + 1] == INSERT:
                write(conv_id, "", "", INSERT)
                at += 1
        if out:
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                             ["conv_id", "place", "role", "text", "edit"])
            out.clear()


def rewrite(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit): what the edits of ``audit`` leave or insert, in order within partitions."""
    nothing = F.lit(None)
    heads = audits.select("conv_id", nothing.cast("long").alias("turn"), nothing.cast("string").alias("role"),
                          F.col("audit").alias("text"), F.lit(0).alias("kind"))
    return _ordered(_plain(rows).unionByName(heads)).mapInArrow(_rewrite, _REPAIRED)


def _digests(batches) -> Iterator[pa.RecordBatch]:
    digest, at, done = None, None, []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done])],
                                          ["conv_id", "repaired_sha256"])

    for part in batches:
        for conv_id, place, role, text in zip(*(part.column(c).to_pylist() for c in ("conv_id", "place", "role", "text"))):
            if not place:
                if digest is not None:
                    done.append((at, digest.hexdigest()))
                digest, at = hashlib.sha256(), conv_id
            digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        if done:
            yield batch()
            done.clear()
    if digest is not None:
        done.append((at, digest.hexdigest()))
        yield batch()


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """``audit`` and repaired_sha256, the digest of a conversation's repaired ``role:text`` lines."""
    audits = materialize(audit(rows, conversations), "audits")
    digests = rewrite(rows, audits).mapInArrow(_digests, "conv_id long, repaired_sha256 string")
    same = audits["conv_id"].eqNullSafe(digests["conv_id"])
    return audits.join(digests, same, "left").select(
        audits["*"], F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damage(conversations: DataFrame) -> DataFrame:
    """The contract's damage: of 20 kinds by crc32 of ``conv_id:turn``, five change a row."""
    blank = F.lit(" ")
    part = [F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")]
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
                                (F.crc32(F.concat(part[0], F.lit(":"), part[1]).cast("binary")) % 20).alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")
