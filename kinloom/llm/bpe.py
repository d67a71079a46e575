"""Operator 3: byte-pair encoding and decoding with a published word tokenizer, merged through a pair occurrence index.

Each task gathers the distinct pre-tokens of a batch that its worker has not met, lays their symbols out in one array with
links to the neighbours, and maps every mergeable pair to all its positions.  A heap holds the ranks that are active; they are
applied in ascending order, each at all positions of its pair from left to right, and the lists of the pairs that a merge
makes are extended.  Texts are then joined from the encoded pre-tokens.

No shuffle takes place.  A worker keeps at most WORD_CACHE encoded pre-tokens, a bound on memory and not on the input.

Null text encodes as the empty text, which has no ids.  Texts of any length are encoded whole.  Ids that the vocabulary lacks
decode to nothing.  Rows, repeated ones too, keep their number; added columns get a trailing "_" where a name is taken.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from kinloom.llm import common

#: Most encoded pre-tokens that a worker remembers; the memory is emptied when they are more.
WORD_CACHE = 300_000
#: Bytes of text that are encoded together: 4 MB take about 140 MB of memory, 32 MB took 440 MB and no less time.
AT_ONCE = 4 << 20
#: A tokenizer file is broadcast; larger ones are refused.
MOST_FILE_BYTES = 64 << 20


def file_broadcast(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        data = f.read(MOST_FILE_BYTES + 1)
    if len(data) > MOST_FILE_BYTES:
        raise ValueError(f"{path} has more than {MOST_FILE_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


_LOADED: dict[tuple[type, str], object] = {}


def loaded(kind: type, data: bytes):
    """One instance for each file and worker."""
    key = (kind, hashlib.sha256(data).hexdigest())
    if key not in _LOADED:
        _LOADED[key] = kind(data)
    return _LOADED[key]


def _char_classes() -> tuple[str, str, np.ndarray]:
    """Letters and numbers as ranges for a character class, and which characters Python's own classes put elsewhere."""
    cats = [unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)]
    kinds = np.array(cats)
    alnum = np.fromiter((chr(c).isalnum() for c in range(len(cats))), bool, len(cats))
    decimal = np.fromiter((chr(c).isdecimal() for c in range(len(cats))), bool, len(cats))
    space = np.fromiter((chr(c).isspace() for c in range(len(cats))), bool, len(cats))
    blank = np.zeros(len(cats), bool)
    blank[[ord(c) for c in map(chr, range(0x3001)) if re.match(f"[{_SPACE}]", c)]] = True
    odd = ((alnum & ~decimal) != (kinds == "L")) | (decimal != (kinds == "N")) | (space != blank)
    out = []
    for kind in "LN":
        edges = np.flatnonzero(np.diff(np.concatenate([[False], kinds == kind, [False]])))
        out.append("".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2], edges[1::2], strict=True)))
    return out[0], out[1], odd


#: What the tokenizer's patterns take for white space.
_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


class PairTable:
    """A hash table from pairs of symbols to numbers that looks up whole arrays."""

    def __init__(self, keys: list[int], values: list[int]):
        self._shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        size = 1 << (64 - int(self._shift))
        self._keys, self._values = np.full(size, -2, np.int64), np.full(size, -1, np.int64)
        left, value = np.array(keys, np.int64), np.array(values, np.int64)
        at = self._home(left)
        while len(left):  # the first of those that want a place gets it if it is free; the others go one further
            _, one = np.unique(at, return_index=True)
            one = one[self._keys[at[one]] == -2]
            self._keys[at[one]], self._values[at[one]] = left[one], value[one]
            rest = np.ones(len(left), bool)
            rest[one] = False
            left, value, at = left[rest], value[rest], (at[rest] + 1) & (size - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for those that the table lacks; keys are not negative."""
        at = self._home(keys)
        held = self._keys[at]
        out = np.where(held == keys, self._values[at], -1)
        open_ = np.flatnonzero((held != keys) & (held != -2))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self._keys) - 1)
            held = self._keys[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self._values[at[open_[hit]]]
            open_ = open_[~hit & (held != -2)]
        return out


class WordBpe:
    """The tokenizer of one file: lower case, words split by a pattern, bytes as symbols, word ends marked."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model = spec["model"]
        self._check(spec, model)
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = sorted(self.added, key=len, reverse=True)
        self._added_split = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        size = max([*self.vocab.values(), *self.added.values()]) + 1
        self.tokens: list[str | None] = [None] * size
        for token, i in (*self.vocab.items(), *self.added.items()):
            self.tokens[i] = token
        letters, numbers, self._odd = _char_classes()
        self._words = re.compile(f"[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d|[{numbers}]|[^{_SPACE}{letters}{numbers}]+").findall
        # Python's own classes are faster and differ for a few characters; texts without those take them.
        self._plain_words = re.compile(r"[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d|\d|(?:[^\w\s]|_)+").findall
        end = model["end_of_word_suffix"]
        shown = self._byte_characters()
        self._inner = np.array([self.vocab[shown[b]] for b in range(256)], np.int64)
        self._last = np.array([self.vocab[shown[b] + end] for b in range(256)], np.int64)
        self._merge: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self._merge.setdefault(self.vocab[a] << 32 | self.vocab[b], (rank, self.vocab[a + b]))
        self._table = PairTable(list(self._merge), [rank for rank, _ in self._merge.values()])
        self._rule = {rank: (k >> 32, k & 0xFFFFFFFF, made) for k, (rank, made) in self._merge.items()}
        self._odd_space = re.compile("[\x1c-\x1f]")
        self._spaced = re.compile(f"[^{_SPACE}]+").findall
        self._number: dict[str, int] = {}
        self._encoded: list[bytes] = []

    @staticmethod
    def _check(spec: dict, model: dict) -> None:
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        bare = not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if model["type"] != "BPE" or not plain or steps != ["NFC", "Replace", "Lowercase"] or not bare or spec["decoder"] or not model["end_of_word_suffix"]:
            raise ValueError("only lower-case word tokenizers with word ends, without a decoder, are supported")

    @staticmethod
    def _byte_characters() -> list[str]:
        """The printable character that stands for each byte: itself, or the next free one from 256 on."""
        out, free = [], 256
        for b in range(256):
            if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
                out.append(chr(b))
            else:
                out.append(chr(free))
                free += 1
        return out

    def words(self, text: str) -> list[str]:
        """Runs between white space, in normal form; a pre-token never crosses white space."""
        if text.isascii():
            text = text.lower()
            if not ("\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text):  # split() takes them for space
                return text.split()
        else:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            if not self._odd_space.search(text):
                return text.split()
        return self._spaced(text)

    def pre_tokens(self, word: str) -> list[str]:
        """What the tokenizer's pattern finds in a run without white space."""
        codes = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        return (self._words if self._odd[codes].any() else self._plain_words)(word)

    def parts(self, text: str) -> list[str]:
        """Runs in order; an added token stands behind a space, which no run holds."""
        if self._added_split is None or not any(t in text for t in self.added):
            return self.words(text)
        out: list[str] = []
        for i, part in enumerate(self._added_split.split(text)):
            out += [" " + part] if i % 2 else self.words(part)
        return out

    def encode_batch(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self._encoded) > WORD_CACHE:
            self._number, self._encoded = {}, []
        number, rows = self._number, []
        for text in texts:
            parts = self.parts(text) if text else []
            for w in set(parts).difference(number):
                number[w] = len(number)
            rows.append(np.fromiter(map(number.__getitem__, parts), np.int32, len(parts)))
        self._encoded += self._encode_runs(list(islice(number, len(self._encoded), None)))
        get = self._encoded.__getitem__
        return [b"".join(map(get, r.tolist())) for r in rows]

    def _encode_runs(self, runs: list[str]) -> list[bytes]:
        parts = [(r,) if r.isalpha() else (r[:-1], r[-1]) if r[-1] in ".,;:!?" and r[:-1].isalpha() else () if r[0] == " " else self.pre_tokens(r) for r in runs]
        number = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(parts)))}
        made = self.merge_words(list(number))
        return [made[number[p[0]]] if len(p) == 1 else b"".join([made[number[w]] for w in p]) if p else np.array([self.added[r[1:]]], "<u4").tobytes() for r, p in zip(runs, parts, strict=True)]

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where none merges it."""
        return self._table.find(left << 32 | right)

    def merge_words(self, words: list[str]) -> list[bytes]:
        """Encodes distinct pre-tokens together, through an index from the rank of a pair to all its positions."""
        data = [w.encode() for w in words]
        starts = np.concatenate([[0], np.cumsum(list(map(len, data)), dtype=np.int64)])
        flat = np.frombuffer(b"".join(data), np.uint8)
        n = len(flat)
        symbols = self._inner[flat]
        ends = starts[1:] - 1
        symbols[ends] = self._last[flat[ends]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends] = -1
        before[ends[:-1] + 1] = -1
        places: dict[int, list] = {}
        first = np.flatnonzero(after >= 0)
        self._file(places, self._lookup(symbols[first], symbols[first + 1]), first)
        active = list(places)
        heapq.heapify(active)
        views = symbols.data, after.data, before.data
        while active:
            rank = heapq.heappop(active)
            found = places.pop(rank)
            many = sum(x.size if isinstance(x, np.ndarray) else 1 for x in found)
            if many > 24 and self._rule[rank][0] != self._rule[rank][1]:
                fresh = self._apply_many(rank, np.sort(np.hstack(found)), symbols, after, before, places)
            else:
                order = sorted(i for x in found for i in (x.tolist() if isinstance(x, np.ndarray) else (x,)))
                fresh = self._apply_few(rank, order, *views, places)
            for r in fresh:
                heapq.heappush(active, r)
        alive = symbols >= 0
        at = (np.concatenate([[0], np.cumsum(alive)])[starts] * 4).tolist()
        out = symbols[alive].astype("<u4").tobytes()
        return [out[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]

    @staticmethod
    def _file(places: dict, ranks: np.ndarray, at: np.ndarray) -> list[int]:
        """Enters positions under the ranks of their pairs; gives the ranks that become active."""
        known = ranks >= 0
        ranks, at = ranks[known], at[known]
        if not len(ranks):
            return []
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        cuts = [0, *(np.flatnonzero(np.diff(ranks)) + 1).tolist(), len(ranks)]
        fresh = []
        for a, b, r in zip(cuts[:-1], cuts[1:], ranks[cuts[:-1]].tolist(), strict=True):
            if r not in places:
                places[r] = []
                fresh.append(r)
            places[r].append(at[a:b])
        return fresh

    def _apply_many(self, rank, i, symbols, after, before, places) -> list[int]:
        """One merge at many positions; its two symbols differ, so no two positions overlap."""
        a, b, made = self._rule[rank]
        j = after[i]
        good = (symbols[i] == a) & (j >= 0)
        good[good] = symbols[j[good]] == b
        i, j = i[good], j[good]
        k = after[j]
        symbols[i], symbols[j] = made, -1
        after[i] = k
        linked = k >= 0
        before[k[linked]] = i[linked]
        h = before[i]
        right, left = i[linked], h[h >= 0]
        at = np.concatenate([right, left])
        return self._file(places, self._lookup(symbols[at], symbols[after[at]]), at)

    def _apply_few(self, rank, order, symbols, after, before, places) -> list[int]:
        """One merge at few or overlapping positions, from left to right."""
        a, b, made = self._rule[rank]
        merge, fresh = self._merge, []
        for i in order:
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue  # an overlapping or earlier merge took one of the two
            k, h = after[j], before[i]
            symbols[i], symbols[j] = made, -1
            after[i] = k
            if k >= 0:
                before[k] = i
            for at, pair in ((i, made << 32 | symbols[k] if k >= 0 else -1), (h, symbols[h] << 32 | made if h >= 0 else -1)):
                found = merge.get(pair)
                if found:
                    if found[0] not in places:
                        places[found[0]] = []
                        fresh.append(found[0])
                    places[found[0]].append(at)
        return fresh

    def decode(self, ids: bytes | None) -> str:
        """The tokens of the ids, with spaces between them, as a tokenizer without a decoder gives them."""
        tokens = self.tokens
        try:
            return " ".join(map(tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))
        except (IndexError, TypeError):
            found = (tokens[i] if i < len(tokens) else None for i in np.frombuffer(ids, "<u4").tolist())
            return " ".join(t for t in found if t is not None)


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts take about most_bytes, so that a batch of long texts does not fill a worker's memory.

    A text counts 16 bytes at least, which bounds the rows too.
    """
    sizes = np.maximum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)), 16)
    if not len(sizes):
        return
    part = np.cumsum(sizes, dtype=np.int64) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(sizes)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def _appended(df: DataFrame, column: str, added: list[tuple[str, T.DataType]], function) -> DataFrame:
    """df with columns that function(list of values) gives for a text or binary column, a batch at a time."""
    names = common.free_names(df, *(n for n, _ in added))
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, (_, t) in zip(names, added, strict=True))])
    at = df.columns.index(column)
    kinds = [pa.binary() if isinstance(t, T.BinaryType) else pa.string() if isinstance(t, T.StringType) else pa.int64() for _, t in added]

    def run(batches):
        for whole in batches:
            for batch in slices(whole, at, AT_ONCE):
                made = function(batch.column(at).to_pylist())
                arrays = [pa.array(values, kind) for values, kind in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *names])

    return df.mapInArrow(run, schema)


def bpe_encode(df: DataFrame, text: str, path: str) -> DataFrame:
    """Adds ids (binary, little-endian unsigned 32-bit) and n_tokens (long) of the whole text of each row."""
    file = file_broadcast(df.sparkSession, path)

    def encode(texts):
        ids = loaded(WordBpe, file.value).encode_batch(texts)
        return ids, [len(x) // 4 for x in ids]

    return _appended(df, text, [("ids", T.BinaryType()), ("n_tokens", T.LongType())], encode)


def bpe_decode(df: DataFrame, ids: str, path: str) -> DataFrame:
    """Adds decoded (string), what the ids of each row stand for; null ids give the empty string."""
    file = file_broadcast(df.sparkSession, path)
    return _appended(df, ids, [("decoded", T.StringType())], lambda rows: [list(map(loaded(WordBpe, file.value).decode, rows))])


def bpe_encode_decode(df: DataFrame, text: str, path: str) -> DataFrame:
    """Adds ids, n_tokens and decoded in one pass: bpe_encode and then bpe_decode, with one Python worker a task."""
    file = file_broadcast(df.sparkSession, path)

    def both(texts):
        bpe = loaded(WordBpe, file.value)
        ids = bpe.encode_batch(texts)
        return ids, [len(x) // 4 for x in ids], list(map(bpe.decode, ids))

    return _appended(df, text, [("ids", T.BinaryType()), ("n_tokens", T.LongType()), ("decoded", T.StringType())], both)

