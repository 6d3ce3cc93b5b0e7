"""The best k items of each of many queries, kept in arrays while items pass by."""

from __future__ import annotations

import numpy as np

SCORE_DIGITS = 6
#: Unrounded scores this far above a rounded one may round to more than it.
NEARLY_HALF = 0.4 * 10.0**-SCORE_DIGITS


class Best:
    """Scores and places of the best ``k`` items of ``n`` queries, by (score desc, place asc).

    Items come in the order of their places, so of equal scores those that are kept already stay. Memory is that of the
    kept rows and of one offer.
    """

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), -np.inf)
        self.at = np.full((n, k), -1, dtype=np.int64)

    def floor(self) -> np.ndarray:
        """For each query a bound that an unrounded score has to pass."""
        return self.score[:, -1] + NEARLY_HALF

    def offer(self, query: np.ndarray, at: np.ndarray, score: np.ndarray) -> None:
        """Take in rounded scores of items whose places are above all those before."""
        better = score > self.score[query, -1]
        query, at, score = query[better], at[better], score[better]
        if len(query) == 0:
            return
        k = self.score.shape[1]
        rows, n_new = np.unique(query, return_counts=True)
        query = np.concatenate([np.repeat(rows, k), query])
        at = np.concatenate([self.at[rows].ravel(), at])
        score = np.concatenate([self.score[rows].ravel(), score])
        order = np.lexsort((at, -score, query))
        begins = np.cumsum(n_new + k) - (n_new + k)
        kept = order[(begins[:, None] + np.arange(k)).ravel()]
        self.score[rows], self.at[rows] = score[kept].reshape(-1, k), at[kept].reshape(-1, k)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, score) of what is kept."""
        query, rank = np.nonzero(self.at >= 0)
        return query, self.at[query, rank], self.score[query, rank]
