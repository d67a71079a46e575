"""Operator 6: token counts of whole texts under a sentencepiece BPE model, by rank-synchronous merging of ragged arrays.

A text is cut where no piece of the vocabulary can cross: before a run of the space mark that follows another character, and
around line ends.  The distinct pre-tokens of a batch that a worker has not met lie one behind another in a flat array.  In
each round every sequence finds its lowest rank (the merged piece with the best score, the leftmost on ties) and all sequences
apply theirs at once; finished sequences leave.  All occurrences of a sequence's rank go in one round if no merge makes a pair
of a lower or equal rank, else only the leftmost, so that the order is the library's.  What survives is counted; a
character outside the vocabulary counts the bytes of its UTF-8.

No shuffle takes place.  Null and empty texts have no tokens.  Rows keep their number; clashing names get a trailing "_".
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kinloom.llm import common
from kinloom.llm.bpe import PairTable, file_broadcast, loaded, slices

#: Most counted pre-tokens that a worker remembers.
WORD_CACHE = 500_000
_MARK = "▁"
_NEVER = np.int64(1) << 40


class PieceCounter:
    """The pieces of a model, the pairs that merge into one of them, and the merging."""

    def __init__(self, data: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = [model.id_to_piece(i) for i in plain]
        if any(_MARK in p.lstrip(_MARK) or "\n" in p for p in pieces):
            raise ValueError("a piece crosses a word or line boundary")
        if model.encode("a  a①") == model.encode("a a①") or model.encode(_MARK) != model.encode(" "):
            raise ValueError("only models that keep spaces as they are are supported")
        order = sorted(range(len(plain)), key=lambda k: (-model.get_score(plain[k]), k))
        ranks, before, rank = {}, None, -1
        for k in order:
            score = model.get_score(plain[k])
            rank += score != before
            before = score
            ranks[pieces[k]] = rank
        #: A symbol is the number of its piece, or of a character that no piece holds; only pieces merge.
        self.number = {p: n for n, p in enumerate(pieces)}
        width = len(pieces)
        keys, made = [], []
        for p in pieces:
            for cut in range(1, len(p)):
                a, b = self.number.get(p[:cut]), self.number.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a * width + b)
                    made.append(self.number[p])
        self.pairs = PairTable(keys, made)
        self.rank_of = np.array([*(ranks[p] for p in pieces), _NEVER], np.int64)  # -1 is no piece
        self.width = width
        self.seen_pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self._single = np.full(0x110000, -1, np.int64)  # the piece of each character
        for p, n in self.number.items():
            if len(p) == 1:
                self._single[ord(p)] = n
        self._cut = re.compile(f"\n+|{_MARK}*[^{_MARK}\n]+|{_MARK}+").findall
        self._known: dict[str, int] = {}

    def parts(self, text: str) -> list[str]:
        return self._cut(_MARK + text.replace(" ", _MARK)) if text else []

    def count_batch(self, texts: list[str | None]) -> list[int]:
        parts = [self.parts(t) if t else [] for t in texts]
        if len(self._known) > WORD_CACHE:
            self._known.clear()
        new = list(set().union(*parts) - self._known.keys())
        for i in range(0, len(new), 20_000):
            self._known.update(zip(new[i : i + 20_000], self.count_words(new[i : i + 20_000]), strict=True))
        get = self._known.__getitem__
        return [sum(map(get, p)) for p in parts]

    def _short(self, word: str) -> list[str]:
        """A long word, cut between characters that stand side by side in no piece."""
        if len(word) <= 64:
            return [word]
        seen, cuts = self.seen_pairs, [0]
        cuts += [i + 1 for i in range(len(word) - 1) if word[i : i + 2] not in seen]
        return [word[a:b] for a, b in zip(cuts, [*cuts[1:], len(word)], strict=True)]

    def count_words(self, words: list[str]) -> list[int]:
        parts = [self._short(w) for w in words]
        counts = self._merged([p for ps in parts for p in ps])
        ends = np.cumsum([len(ps) for ps in parts])
        return np.add.reduceat(counts, np.concatenate([[0], ends[:-1]])).tolist() if words else []

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece that each pair makes and its rank; _NEVER where it makes none."""
        made = self.pairs.find(np.where((left | right) >= 0, left * self.width + right, self.width * self.width))
        return made, self.rank_of[made]

    def _merged(self, words: list[str]) -> np.ndarray:
        """Tokens of each word."""
        text = "".join(words)
        symbols = self._single[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out = np.zeros(len(words), np.int64)
        owner = np.repeat(np.arange(len(words)), lengths)
        strange = np.flatnonzero(symbols < 0)
        if len(strange):
            np.add.at(out, owner[strange], [len(text[i].encode()) - 1 for i in strange])
        made = np.full(len(symbols), -1, np.int64)
        ranks = np.full(len(symbols), _NEVER, np.int64)
        inside = np.flatnonzero(owner[:-1] == owner[1:])  # positions with a right neighbour in their sequence
        made[inside], ranks[inside] = self._pairs(symbols[inside], symbols[inside + 1])
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(np.append(starts, len(symbols)))
            least = np.minimum.reduceat(ranks, starts)
            done = least == _NEVER
            if done.any():
                out[owner[starts[done]]] += sizes[done]
                keep = np.repeat(~done, sizes)
                symbols, owner, made, ranks = symbols[keep], owner[keep], made[keep], ranks[keep]
                starts, sizes, least = None, sizes[~done], least[~done]
                starts = np.cumsum(sizes) - sizes
                if not len(symbols):
                    break
            at = np.flatnonzero(ranks == np.repeat(least, sizes))
            at = self._together(at, symbols, owner, made, ranks)
            symbols[at] = made[at]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            to = np.cumsum(stay) - 1
            symbols, owner, made, ranks = symbols[stay], owner[stay], made[stay], ranks[stay]
            at = to[at]
            near = np.zeros(len(symbols), bool)
            near[at] = True
            near[np.maximum(at - 1, 0)] = True
            changed = np.flatnonzero(near)
            linked = changed[(changed + 1 < len(symbols))]
            linked = linked[owner[linked] == owner[linked + 1]]
            made[changed], ranks[changed] = -1, _NEVER
            made[linked], ranks[linked] = self._pairs(symbols[linked], symbols[linked + 1])
        return out

    def _together(self, at, symbols, owner, made, ranks) -> np.ndarray:
        """Of the places with their sequence's lowest rank, those that may go in this round."""
        own = owner[at]
        first = np.concatenate([[True], own[1:] != own[:-1]])
        if first.all():
            return at
        # In a run of overlapping places every other one goes, from the left.
        fresh = first | np.concatenate([[True], np.diff(at) > 1])
        run = np.cumsum(fresh) - 1
        begins = np.flatnonzero(fresh)
        chosen = (np.arange(len(at)) - begins[run]) % 2 == 0
        at, own = at[chosen], own[chosen]
        first = np.concatenate([[True], own[1:] != own[:-1]])
        new, rank = made[at], ranks[at]
        lower = np.zeros(len(at), bool)
        for side, near in ((-1, at - 1), (1, at + 2)):
            ok = (near >= 0) & (near < len(symbols))
            ok[ok] = owner[near[ok]] == own[ok]
            pair = (symbols[near[ok]], new[ok]) if side < 0 else (new[ok], symbols[near[ok]])
            lower[ok] |= self._pairs(*pair)[1] <= rank[ok]
        close = np.flatnonzero(np.concatenate([[False], (np.diff(at) == 2) & ~first[1:]]))
        if len(close):  # two merged symbols side by side
            lower[close] |= self._pairs(new[close - 1], new[close])[1] <= rank[close]
        bad = np.zeros(int(own.max()) + 1, bool)
        bad[own[lower]] = True
        return at[first | ~bad[own]]


def token_counts(df: DataFrame, text: str, path: str) -> DataFrame:
    """Adds n_bytes (UTF-8) and n_tokens of the whole text of each row."""
    file = file_broadcast(df.sparkSession, path)
    names = common.free_names(df, "n_bytes", "n_tokens")
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])
    at = df.columns.index(text)

    def run(batches):
        counter = loaded(PieceCounter, file.value)
        for whole in batches:
            for batch in slices(whole, at, 16 << 20):
                sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).cast(pa.int64())
                counts = pa.array(counter.count_batch(batch.column(at).to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns, sizes, counts], [*batch.schema.names, *names])

    return df.mapInArrow(run, schema)
