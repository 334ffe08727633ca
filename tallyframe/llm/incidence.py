"""Token alignment as products of sparse incidence matrices, built by hand in CSR form.

Both tokenizers cut the same bytes. With A and B as token x byte incidence matrices,
the product of A and the transpose of B holds the bytes that two tokens share, so its
entries are the overlap links; token x group incidences give the pairs of one group
likewise. Products follow Gustavson: row i of the result is the sum of the rows of the
right matrix that row i of the left one names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Csr:
    """Rows of a sparse matrix: row i has ones (or ``data``) in columns indices[indptr[i]:indptr[i + 1]]."""
    indptr: np.ndarray
    indices: np.ndarray
    columns: int
    data: np.ndarray | None = None

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each length, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def intervals(lengths: np.ndarray) -> Csr:
    """Token x byte incidence of tokens that follow each other."""
    indptr = np.concatenate([[0], np.cumsum(lengths)])
    return Csr(indptr, np.arange(indptr[-1]), int(indptr[-1]))


def members(groups: np.ndarray, count: int) -> Csr:
    """Token x group incidence: token i belongs to groups[i]."""
    return Csr(np.arange(len(groups) + 1), groups, count)


def transpose(m: Csr) -> Csr:
    """Columns as rows, by a stable counting sort of the entries."""
    indptr = np.concatenate([[0], np.cumsum(np.bincount(m.indices, minlength=m.columns))])
    order = np.argsort(m.indices, kind="stable")
    row_of = np.repeat(np.arange(m.rows), np.diff(m.indptr))
    return Csr(indptr, row_of[order], m.rows, None if m.data is None else m.data[order])


def product(left: Csr, right: Csr) -> Csr:
    """left times right, rows of ascending columns; data counts the common places of a pair."""
    named = left.indices
    lengths = right.indptr[named + 1] - right.indptr[named]
    row = np.repeat(np.repeat(np.arange(left.rows), np.diff(left.indptr)), lengths)
    column = right.indices[ranges(right.indptr[named], lengths)]
    key = row * right.columns + column
    key.sort()  # nearly in order already: rows ascend
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    entry = key[first]
    indptr = np.concatenate([[0], np.cumsum(np.bincount(entry // right.columns, minlength=left.rows))]) if len(key) else \
        np.zeros(left.rows + 1, np.int64)
    return Csr(indptr, entry % right.columns if len(key) else entry, right.columns, np.diff(np.append(first, len(key))))
