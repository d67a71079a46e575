"""Alignment of the sequences that meet in one task: pairs and profiles by dynamic programming, gap filters, distances.

These are helpers over numpy matrices inside one task, which sees the representatives of one family at one taxon.  Lines are strings
of one length with "-" for a gap.  Two profiles (columns of letter counts) are aligned at best total score of their columns, where
two columns score the mean over their letters; a gap of k columns costs OPEN + k * EXTEND.  Sequences are joined step by
step, the closest first, by the mean distance of their words.  Time is that of rows times columns for each of the joins.  Small
groups of sequences are aligned side by side, as the time of small matrices is that of the calls and not of the numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.operators.alignment import COLUMN_GAPS, GAPS, LEAST_COLUMNS, ROW_RESIDUES
from kinloom.operators.genetree import word_distance

#: Letters that often stand for each other, the scores of equal, alike and other letters, and the costs of gaps.
ALIKE = ("AGST", "ILMV", "FWY", "HKR", "DENQ", "C", "P")
SAME, NEAR, OTHER, OPEN, EXTEND = 5, 1, -2, 8, 1
#: The distance of lines that share no letter, or nothing but differences.
MOST = 5.0
#: Cells that are filled, or one-hot letters that are compared, at once.
TOGETHER = 1 << 20


@cache
def letter_scores() -> np.ndarray:
    """Score of every two bytes, whatever their case."""
    class_ = np.arange(256) + 1000
    for k, letters in enumerate(ALIKE):
        class_[[ord(c) for c in letters]] = k
    upper = np.array([ord(chr(c).upper()) if c < 128 else c for c in range(256)])
    a, b = upper[:, None], upper[None]
    return np.where(a == b, SAME, np.where(class_[a] == class_[b], NEAR, OTHER)).astype(float)


def _scores(score: np.ndarray, open_: float, extend: float, inside: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The best scores of all beginnings, and of those that end with a column of the first against a gap.  With inside the first may
    begin before the second at no cost.  Axes between the first and the last one are of matrices side by side."""
    n, *many, m = score.shape
    steps = extend * np.arange(m + 1)
    best = np.empty((n + 1, *many, m + 1))
    best[0] = -open_ - steps
    best[0, ..., 0] = 0
    down = np.full((*many, m + 1), -np.inf)  # best with the last column of the first against a gap
    downs = np.full((n + 1, *many, m + 1), -np.inf)
    for i in range(1, n + 1):
        down = np.maximum(best[i - 1] - open_, down) - extend
        if inside:
            down[..., 0] = 0
        row = down.copy()
        np.maximum(row[..., 1:], best[i - 1][..., :-1] + score[i - 1], out=row[..., 1:])
        # Gaps in the first: from the best start to the left, all at once.
        start = np.maximum.accumulate(row + steps, axis=-1)
        row[..., 1:] = np.maximum(row[..., 1:], start[..., :-1] - open_ - steps[1:])
        best[i], downs[i] = row, down
    return best, downs


def _side_by_side(scores: dict[int, np.ndarray], open_: float = OPEN, extend: float = EXTEND) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """_scores of several matrices by their keys.  Those of like size lie side by side, filled up at their ends, which no number before depends on."""
    class_ = lambda x: x >> max(x.bit_length() - 3, 0) << max(x.bit_length() - 3, 0)
    alike: dict[tuple[int, int], list[int]] = {}
    for k, score in scores.items():
        alike.setdefault((class_(score.shape[0]), class_(score.shape[1])), []).append(k)
    for keys in alike.values():
        n, m = (max(scores[k].shape[axis] for k in keys) for axis in (0, 1))
        step = max(TOGETHER // ((n + 1) * (m + 1)), 1)
        for first in range(0, len(keys), step):
            some = keys[first : first + step]
            whole = np.zeros((n, len(some), m))
            for at, k in enumerate(some):
                whole[: scores[k].shape[0], at, : scores[k].shape[1]] = scores[k]
            best, downs = _scores(whole, open_, extend)
            for at, k in enumerate(some):
                x, y = scores[k].shape
                yield k, (best[: x + 1, at, : y + 1], downs[: x + 1, at, : y + 1])


def best_path(
    score: np.ndarray, open_: float = OPEN, extend: float = EXTEND, inside: bool = False, filled: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[float, np.ndarray, np.ndarray]:
    """The best score of two sequences of columns whose columns score as given, and for each place of one best alignment the column of
    the first and of the second (-1: a gap).  Ties go to two columns, then to a gap in the second.  With inside the first may begin
    before the second and end behind it at no cost.  filled are the matrices of _scores, if they are known."""
    (n, m), (best, downs) = score.shape, filled or _scores(score, open_, extend, inside)
    end = int(best[:, m].argmax()) if inside else n
    at, i, j = [(k, -1) for k in range(n - 1, end - 1, -1)], end, m
    total = float(best[end, m])
    while i or j:
        if i and j and best[i, j] <= best[i - 1, j - 1] + score[i - 1, j - 1] + 1e-9:
            i, j = i - 1, j - 1
            at.append((i, j))
        elif inside and not j:
            at += [(k, -1) for k in range(i - 1, -1, -1)]
            i = 0
        elif i and (best[i, j] <= downs[i, j] + 1e-9 or not j):
            # Up to where the gap opens.
            while True:
                i -= 1
                at.append((i, -1))
                if not i or downs[i + 1, j] <= best[i, j] - open_ - extend + 1e-9:
                    break
        else:
            k = j - 1
            while k and best[i, j] > best[i, k] - open_ - extend * (j - k) + 1e-9:
                k -= 1
            at += [(-1, c) for c in range(j - 1, k - 1, -1)]
            j = k
    path = np.array(at[::-1], int).reshape(-1, 2)
    return total, path[:, 0], path[:, 1]


def _codes(sequence: str) -> np.ndarray:
    return np.frombuffer(sequence.encode("latin-1", "replace"), np.uint8)


def score_matrix(a: str, b: str) -> np.ndarray:
    """The scores of every two letters of two sequences."""
    return letter_scores()[_codes(a)[:, None], _codes(b)[None]]


def pair_score(a: str, b: str, open_: float = OPEN, extend: float = EXTEND) -> float:
    """The best score of two sequences."""
    return float(_scores(score_matrix(a, b), open_, extend)[0][-1, -1])


def pair_scores(a: str, b: str, open_: float = OPEN, extend: float = EXTEND) -> Column:
    """A column of the best scores of two columns of sequences; null with null."""

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        pairs = list(zip(x, y, strict=True))
        known = {p: None if None in p else pair_score(*p, open_, extend) for p in set(pairs)}
        return pd.Series([known[p] for p in pairs], dtype="float64")

    return score(a, b)


def with_scores(pairs: DataFrame, a: str, b: str, score: str = "score", open_: float = OPEN, extend: float = EXTEND) -> DataFrame:
    """Adds the best score of two columns of sequences, each two different ones scored once, dealt over all tasks of a shuffle."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The number is said, as few bytes of pairs are much work.
    each = pairs.select(a, b).distinct().repartition(n, a, b)
    return pairs.join(each.withColumn(score, pair_scores(a, b, open_, extend)), [a, b], "left")


class Profile:
    """Aligned lines (a matrix of bytes) of some of the sequences."""

    def __init__(self, lines: np.ndarray, of: list[int]):
        self.lines, self.of = lines, of

    def shares(self, letters: np.ndarray) -> np.ndarray:
        """For each column the share of lines with each letter."""
        return (self.lines[:, :, None] == letters).sum(0) / len(self.lines)

    def scores(self, other: Profile) -> np.ndarray:
        """The score of each column of this one with each of the other."""
        seen = np.zeros(256, bool)
        seen[self.lines], seen[other.lines], seen[ord("-")] = True, True, False
        letters = np.flatnonzero(seen)
        return self.shares(letters) @ letter_scores()[letters[:, None], letters[None]] @ other.shares(letters).T

    def joined(self, other: Profile, i: np.ndarray, j: np.ndarray) -> Profile:
        """Both along a path: the column of each at every place, -1 for a gap."""
        # A last column of gaps is that of -1.
        put = lambda lines, at: np.hstack([lines, np.full((len(lines), 1), ord("-"), np.uint8)])[:, at]
        return Profile(np.vstack([put(self.lines, i), put(other.lines, j)]), self.of + other.of)


def _joins(sequences: list[str]) -> Generator[np.ndarray, tuple[np.ndarray, np.ndarray], list[str]]:
    """The steps of progressive: gives the scores of the two profiles to join, is sent their filled matrices, returns the lines."""
    if not sequences:
        return []
    parts: list[Profile | None] = [Profile(_codes(s)[None], [k]) for k, s in enumerate(sequences)]
    far = word_distance(sequences)
    np.fill_diagonal(far, np.inf)
    size = np.ones(len(parts))
    for _ in range(len(parts) - 1):
        i, j = sorted(divmod(int(far.argmin()), len(parts)))
        score = parts[i].scores(parts[j])
        filled = yield score
        parts[i], parts[j] = parts[i].joined(parts[j], *best_path(score, filled=filled)[1:]), None
        mean = (far[i] * size[i] + far[j] * size[j]) / (size[i] + size[j])
        far[i], far[:, i] = mean, mean
        far[i, i] = far[j] = far[:, j] = np.inf
        size[i] += size[j]
    whole = parts[0]
    out = [""] * len(sequences)
    for k, line in zip(whole.of, whole.lines, strict=True):
        out[k] = line.tobytes().decode("latin-1")
    return out


def progressive(sequences: list[str]) -> list[str]:
    """All sequences aligned: the two closest profiles are joined, again and again; ties go to the first ones."""
    return progressive_together([sequences])[0]


def progressive_together(groups: list[list[str]]) -> list[list[str]]:
    """progressive for each of several groups: the next joins of all of them are made side by side."""
    out: list[list[str]] = [[] for _ in groups]
    runs = [_joins(g) for g in groups]
    waiting: dict[int, np.ndarray] = {}

    def go_on(k: int, filled: tuple[np.ndarray, np.ndarray] | None, to: dict[int, np.ndarray]) -> None:
        try:
            to[k] = runs[k].send(filled)
        except StopIteration as end:
            out[k] = end.value

    for k in range(len(groups)):
        go_on(k, None, waiting)
    while waiting:
        now, waiting = waiting, {}
        for k, filled in _side_by_side(now):
            go_on(k, filled, waiting)
    return out


def _matrix(lines: list[str]) -> np.ndarray:
    return np.vstack([_codes(s) for s in lines])


def _gaps(lines: np.ndarray) -> np.ndarray:
    is_gap = np.zeros(256, bool)
    is_gap[_codes(GAPS)] = True
    return is_gap[lines]


def _elbow(ratios: np.ndarray) -> float:
    """The gap ratio farthest from the share of columns with a smaller one, the least on ties."""
    order = np.unique(ratios)
    away = np.round(np.abs(order - np.searchsorted(np.sort(ratios), order) / len(ratios)), 9)
    return float(order[away.argmax()])


def gap_filter(
    lines: list[str], gap_ratio_col: float = COLUMN_GAPS, residue_ratio_row: float = ROW_RESIDUES, least_columns: int = LEAST_COLUMNS, elbow: bool = False
) -> tuple[list[bool], list[str]]:
    """Which lines stay, and all lines over the columns that stay: alignment.filter_alignment in one task.

    With elbow the columns' threshold is where gap ratios bend, gap_ratio_col at least.  Narrow alignments stay as they are.
    """
    if not lines or len(lines[0]) < least_columns:
        return [True] * len(lines), lines
    cells = _matrix(lines)
    gaps = _gaps(cells)
    ratios = gaps.mean(0)
    most = max(gap_ratio_col, _elbow(ratios)) if elbow else gap_ratio_col
    cells, gaps = cells[:, ratios < most], gaps[:, ratios < most]
    stay = (~gaps).mean(1) >= residue_ratio_row if gaps.shape[1] else np.zeros(len(lines), bool)
    if not stay.all():
        cells = cells[:, ~gaps[stay].all(0)] if stay.any() else cells
    return stay.tolist(), [r.tobytes().decode("latin-1") for r in cells]


def elbow_filter(lines: list[str]) -> tuple[list[bool], list[str]]:
    return gap_filter(lines, elbow=True)


def aligned_distance(lines: list[str], most: float = MOST) -> np.ndarray:
    """Distances of aligned lines: -ln(1 - p - p * p / 5) for the share p of differing letters where both have one, most at most."""
    if not lines:
        return np.zeros((0, 0))
    cells = _matrix(lines)
    known = ~_gaps(cells)
    both = known.astype(np.float64) @ known.T
    same = np.zeros_like(both)
    letters = np.flatnonzero(np.bincount(cells[known], minlength=256))
    step = max(TOGETHER // max(cells.size, 1), 1)  # letters at a time, for bounded memory
    for first in range(0, len(letters), step):
        has = (cells[:, :, None] == letters[first : first + step]).reshape(len(cells), -1).astype(np.float64)
        same += has @ has.T
    p = np.where(both > 0, 1 - same / np.maximum(both, 1), 1.0)
    left = 1 - p - p * p / 5
    out = np.minimum(most, -np.log(np.maximum(left, np.exp(-most))))
    np.fill_diagonal(out, 0.0)
    return out


#: What the fold takes: lines out of sequences, and which lines stay over which columns.
Align = Callable[[list[str]], list[str]]
ColumnFilter = Callable[[list[str]], tuple[list[bool], list[str]]]
