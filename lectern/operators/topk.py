"""The best rows of each query over the batches of a task: what is held and sent is k rows a query."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Scores that a task computes at once.
CELLS = 500_000


class Best:
    """Scores are ranked after rounding to six decimals, then by id, null ids last, as the whole ranking is."""

    def __init__(self, names: list, k: int):
        self.names, self.k = names, k
        self.held: list[list[tuple]] = [[] for _ in names]
        self.least = np.full(len(names), -np.inf)

    def step(self, cells: int = CELLS) -> int:
        """Rows that may be scored at once."""
        return max(1, cells // max(1, len(self.names)))

    def take(self, score: np.ndarray, ids: list, usable: np.ndarray | None = None) -> None:
        """``score``: a row for each of ``ids``, a column for each query; ``usable`` marks the cells that count."""
        rounded = np.floor(score * 1e6 + 0.5)
        good = rounded >= self.least
        if usable is not None:
            good &= usable
        if good.sum() > 4 * self.k * len(self.names) and len(ids) > self.k:
            open_ = rounded if usable is None else np.where(usable, rounded, -np.inf)
            good &= rounded >= np.partition(open_, len(ids) - self.k, axis=0)[len(ids) - self.k]
        for i, q in zip(*(x.tolist() for x in np.nonzero(good)), strict=True):
            self.held[q].append((-rounded[i, q], ids[i] is None, ids[i], float(score[i, q])))
        for q in np.flatnonzero(good.any(0)):
            self.held[q] = sorted(self.held[q])[: self.k]
            if len(self.held[q]) == self.k:
                self.least[q] = -self.held[q][-1][0]

    def batch(self, types: list) -> pa.RecordBatch:
        """(qid, id, score) of what is held."""
        rows = [(self.names[q], r[2], r[3]) for q, rs in enumerate(self.held) for r in rs]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names=["qid", "id", "score"])
