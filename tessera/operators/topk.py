"""The best few of each question, kept inside a task while its rows pass by."""

from __future__ import annotations

import numpy as np

#: Scores of rows and questions that are held in one matrix.
CELLS = 1 << 22


class Best:
    """The k best (score, then name) of each question among all that were added.

    What cannot be among them any more is dropped at once, so a task holds a small multiple of k rows a
    question and passes k on, however many rows it has seen.
    """

    def __init__(self, k: int, questions: int):
        self.k, self.least = k, np.full(questions, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.most = 0, max(1 << 16, 4 * k * questions)

    def add(self, question: np.ndarray, score: np.ndarray, name: np.ndarray) -> None:
        some = score >= self.least[question]
        if some.any():
            self.parts.append((question[some], score[some], name[some]))
            self.size += int(some.sum())
            if self.size > self.most:
                self.prune()

    def prune(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        question, score, name = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((name, -score, question))
        question, score, name = question[order], score[order], name[order]
        first = np.flatnonzero(np.r_[True, question[1:] != question[:-1]])
        rank = np.arange(len(question)) - np.repeat(first, np.diff(np.r_[first, len(question)]))
        last = rank == self.k - 1
        self.least[question[last]] = score[last]
        held = rank < self.k
        self.parts = [(question[held], score[held], name[held])]
        self.size = int(held.sum())
        return self.parts[0]
