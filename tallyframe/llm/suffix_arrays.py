"""Suffix arrays of many short byte strings, in numpy.

Strings are laid end to end as symbols 1 to 256, each closed by a 0. Order and
common prefixes matter up to ``depth`` symbols only.
"""

from __future__ import annotations

import numpy as np

_PACKED = 7


def lay_out(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, starts): string i begins at starts[i]."""
    sizes = np.array([len(s) + 1 for s in strings], np.int64)
    ends = np.cumsum(sizes)
    symbols = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int16) + 1
    symbols[ends - 1] = 0
    return symbols, ends - sizes


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their first ``depth`` symbols.

    Larsson-Sadakane: suffixes are grouped by a short prefix, then every group
    that still has several members is sorted by the rank of what follows, which
    doubles the length compared; finished groups are left alone.
    """
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(depth, np.int16)]).astype(np.int64)
    key = np.zeros(n, np.int64)
    for j in range(min(_PACKED, depth)):
        key = key * 257 + padded[j:j + n]
    order = np.argsort(key)
    heads = np.ones(n, bool)
    heads[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.zeros(n + depth, np.int64)
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0)) + 1
    known = min(_PACKED, depth)
    while known < depth:
        open_ = ~heads
        open_[:-1] |= ~heads[1:]
        slots = np.flatnonzero(open_)
        if not len(slots):
            break
        step = min(known, depth - known)
        members = order[slots]
        follow = rank[members + step]
        by = np.argsort(rank[members] * (n + 1) + follow)
        members, follow = members[by], follow[by]
        order[slots] = members
        old = rank[members]
        fresh = np.ones(len(slots), bool)
        fresh[1:] = (old[1:] != old[:-1]) | (follow[1:] != follow[:-1])
        heads[slots] = fresh
        rank[members] = np.maximum.accumulate(np.where(fresh, slots, 0)) + 1
        known += step
    # Suffixes alike up to ``depth`` stand in the order of their positions.
    return order[np.argsort(rank[order] * (n + 1) + order)]


def common_prefixes(symbols: np.ndarray, starts: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length, up to ``depth``, of the prefix each suffix shares with the one before it in ``order``.

    Kasai: the next position of a string shares at least one symbol less than the
    position before it, so what is known is kept. That needs the follower of the
    last neighbour to come first, which only a full match of ``depth`` symbols
    leaves open; there it is checked. All strings advance together.
    """
    n = len(symbols)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    padded = np.concatenate([symbols, np.zeros(depth + 1, np.int16)])
    sizes = np.diff(np.append(starts, n))
    by_size = np.argsort(-sizes, kind="stable")
    begin, left = starts[by_size], -sizes[by_size]
    common, shared = np.zeros(n, np.int64), np.zeros(len(starts), np.int64)
    neighbour = np.zeros(len(starts), np.int64)
    for i in range(int(-left[0]) if len(left) else 0):
        active = np.searchsorted(left, -i, "left")
        at = begin[:active] + i
        slot = place[at]
        before = order[np.maximum(slot - 1, 0)]
        follower = place[np.minimum(neighbour[:active] + 1, n - 1)]
        usable = (slot > 0) & ((shared[:active] < depth) | (follower < slot))
        h = np.where(usable, np.maximum(shared[:active] - 1, 0), 0)
        going = np.flatnonzero(slot > 0)
        while len(going):
            same = (padded[at[going] + h[going]] == padded[before[going] + h[going]]) & (h[going] < depth)
            going = going[same]
            h[going] += 1
        shared[:active], neighbour[:active] = h, before
        common[slot] = h
    return common
