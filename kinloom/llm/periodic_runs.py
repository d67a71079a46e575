"""Operator 13: runs of words that repeat with a period, found by a suffix automaton, and their removal.

A run is a stretch of words whose smallest period is q (words q apart are identical), of at least max(LEAST, TIMES q) words, that no
neighbouring word extends with that period.

The automaton of a word sequence has a state for each set of end positions; the tree of suffix links joins these sets.  From
the longest state to the shortest, each set is merged into that of its link, the smaller one into the larger, in order.  Two end
positions that come together at a state have exactly its length of words before them in common, so if a new neighbour is
d away and d is at most that length, a square of period d is found, which goes back as far as its period does.  It is a run
if it cannot go on to the right either.  Every run comes out that way: the positions at its end and one period before meet at the
state of their common past and, the period being the smallest one, are neighbours there.  Distances that are not the smallest
period of their stretch are left out when the same stretch has a smaller one.

States shorter than max(LEAST - 1, TIMES - 1) see no run and are not merged.  Before, the sequence is cut where no run can pass: every
stretch of GRAM words inside a run comes again one period away, at most a TIMES-th of the run's length, so words that lie in no such
stretch end it.  This takes nothing from any run; most prose has no such stretch and needs no automaton.  It is done by 64-bit
hashes, which may let more pass but never less; the automaton sees the words themselves, as numbers.

A task holds the automaton of one stretch at a time, about 500 bytes a word of it.  Null and empty texts have no words and no runs.
Rows keep their number and their columns, whatever their names; no shuffle takes place.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kinloom.llm import common
from kinloom.llm.bpe import slices

#: Words and periods that a run has at least.
LEAST, TIMES = 6, 4
#: Words of the stretches that must come again (5: also a run of LEAST equal words holds two), and rounds of cutting.
GRAM, ROUNDS = 5, 8

Run = tuple[int, int, int]


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Parts (first word, end) outside of which no run has a word."""
    out, todo = [], [(0, len(ids), ROUNDS)]
    while todo:
        a, b, left = todo.pop()
        if b - a < LEAST:
            continue
        if not left:
            out.append((a, b))
            continue
        grams = common.shingle_hashes(ids[a:b], GRAM)
        order = np.argsort(grams, kind="stable")
        near = (grams[order[1:]] == grams[order[:-1]]) & (np.diff(order) <= (b - a) // TIMES)
        marked = np.zeros(len(grams) + 2, np.int8)
        marked[order[1:][near] + 1] = 1
        marked[order[:-1][near] + 1] = 1
        edges = np.flatnonzero(np.diff(marked))
        parts = [(a + s, a + e + GRAM - 1) for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
        if parts == [(a, b)]:
            out.append((a, b))
        else:
            todo += [(s, e, left - 1) for s, e in parts]
    return sorted(out)


def automaton(ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Of each state its suffix link, its length, and the end of the prefix that it stands for (-1: a clone or the root)."""
    ways: list[dict[int, int]] = [{}]
    link, length, end = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(ids):
        new = len(ways)
        ways.append({})
        length.append(i + 1)
        end.append(i)
        link.append(0)
        p = last
        while p >= 0 and c not in ways[p]:
            ways[p][c] = new
            p = link[p]
        if p >= 0:
            q = ways[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(ways)
                ways.append(ways[q].copy())
                length.append(length[p] + 1)
                end.append(-1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and ways[p].get(c) == q:
                    ways[p][c] = twin
                    p = link[p]
        last = new
    return link, length, end


def automaton_runs(ids: list[int]) -> list[Run]:
    """Start, length and period of all runs of a sequence, by start and period."""
    n, shortest = len(ids), max(LEAST - 1, TIMES - 1)
    link, length, end = automaton(ids)
    # Positions are held negative and ascending: the prefix of a state ends before all of its other positions and is appended.
    sets: list[list[int] | None] = [[-e] if e >= 0 else None for e in end]
    found: dict[tuple[int, int], int] = {}
    for v in np.argsort(-np.array(length), kind="stable").tolist():
        size = length[v]
        if size <= shortest:
            break
        to = link[v]
        common_past = length[to]
        few, sets[v] = sets[v], None
        if common_past < shortest:
            continue
        many = sets[to]
        if many is None:
            sets[to] = few
            continue
        if len(few) > len(many):
            few, many = many, few
            sets[to] = many
        farthest = common_past // (TIMES - 1)
        for x in few:
            at = bisect_left(many, x)
            many.insert(at, x)
            # A neighbour further on in the list ends earlier.
            for late, early in ((x, many[at + 1]) if at + 1 < len(many) else (0, -n), (many[at - 1], x) if at else (0, -n)):
                d = early - late
                if 0 < d <= farthest and common_past + d >= LEAST:
                    start, stop = 1 - late - common_past - d, 1 - late
                    # It goes on to the left if both ends are of the smaller set; then it was seen at a longer state.
                    if (stop == n or ids[stop] != ids[stop - d]) and (not start or ids[start - 1] != ids[start - 1 + d]):
                        found[start, stop - start] = min(d, found.get((start, stop - start), d))
    return sorted((s, k, d) for (s, k), d in found.items())


def runs_of(words: list[bytes]) -> list[Run]:
    """Start, length and period of all runs of a text's words, by start and period."""
    if len(words) < LEAST:
        return []
    numbers: dict[bytes, int] = {}
    put = numbers.setdefault
    ids = np.array([put(w, len(numbers)) for w in words], np.uint64)
    if len(numbers) > len(words) - LEAST + 1:  # a run has a word that comes three times, or LEAST
        return []
    out = []
    for a, b in stretches(ids):
        out += [(a + s, k, d) for s, k, d in automaton_runs(ids[a:b].tolist())]
    return sorted(set(out), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that are in no run behind its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, size, period in runs:
        edge[start + period] += 1
        edge[start + size] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def collapse_runs(df: DataFrame, text: str, change: Callable[[dict, list[bytes]], list[bytes]] | None = None, needs: list[str] | None = None) -> DataFrame:
    """Adds runs (an array of start, length, period, by start and period) and collapsed, the words left, joined by one space.

    change, if given, takes the values of the columns in needs and the words, and gives the words to be looked at.
    """
    names = common.free_names(df, "runs", "collapsed")
    run = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
    schema = T.StructType([*df.schema.fields, T.StructField(names[0], T.ArrayType(run, False)), T.StructField(names[1], T.StringType())])
    at, given = df.columns.index(text), [df.columns.index(c) for c in needs or []]
    struct = pa.struct([pa.field(n, pa.int64(), nullable=False) for n in ("start", "length", "period")])

    def look(batches):
        for whole in batches:
            for batch in slices(whole, at, 4 << 20):
                sizes, flat, texts = [0], [], []
                more = [batch.column(c).to_pylist() for c in given]
                for i, data in enumerate(common.byte_arrays(batch.column(at))):
                    words = data.tobytes().split() if data is not None else []
                    if change is not None:
                        words = change({c: m[i] for c, m in zip(needs, more, strict=True)}, words)
                    runs = runs_of(words)
                    flat += runs
                    sizes.append(len(flat))
                    texts.append(b" ".join(collapsed(words, runs)))
                columns = np.array(flat, np.int64).reshape(-1, 3).T
                values = pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(struct))
                listed = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values, type=pa.list_(pa.field("element", struct, nullable=False)))
                yield pa.RecordBatch.from_arrays([*batch.columns, listed, pa.array(texts, pa.binary()).cast(pa.string())], [*batch.schema.names, *names])

    return df.mapInArrow(look, schema)
