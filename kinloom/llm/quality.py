"""Operator 10: quality of a text from weak labels.

Heuristic labellers look at a text and vote junk, clean or nothing; each kind of junk shows to more than one.  Spark counts the
vote patterns over all texts (at most 3 ** labellers of them), and expectation maximisation estimates from the counts how
often each labeller is right when it votes, for its two votes apart; that gives each pattern a posterior, with clean and junk
as likely before the votes: a share estimated along with them drifts until all texts are junk where junk is common.  A vote is
taken to be right more often than wrong, and silence to say nothing; so none calls a text clean that repeats itself, which
looks at single words cannot tell.  A linear scorer over hashed
features (words, shapes of words, repetition) is then trained on the posteriors of a sample: of the distinct texts with words,
those with the least hashes, SAMPLE at most and SAMPLE_BYTES at most (the one with the least hash at least), so neither copies of
a row nor long texts make the sample larger, and it is never empty where any text has words.  The scorer judges every whole text.

Features are shares of a text's words, so length has no weight.  Null texts, empty texts and texts without words have score 0
and are rejected.  If all texts look alike the model has one class and the scorer follows it; so it does if the table is one
row repeated.  Rows keep their number, repeated rows are judged alike, and added columns take names that the input does not have.
An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.llm import common
from kinloom.llm.bpe import slices

#: Most distinct texts to train on, and most bytes of these.
SAMPLE, SAMPLE_BYTES = 8192, 64 << 20
#: Hashed features; passes over the sample; the least score that is kept; bytes of text looked at together.
FEATURES, EPOCHS, KEEP, AT_ONCE = 1 << 16, 8, 0.5, 1 << 19
#: Fixed values of the labellers: above the first share a text is junk to it, below the second (if any) clean, else no vote.
LABELLERS = {
    "symbols": (0.05, None),  # bytes that are symbols, of all
    "shouting": (0.5, None),  # ASCII capitals, of ASCII letters
    "stutter": (0.2, None),  # words equal to the one before
    "bars": (0.08, None),  # words without letter or digit
    "exclaiming": (0.3, None),  # exclamation marks a word
    "phrases": (0.8, None),  # runs of three words seen before in the text
    "odd": (0.3, 0.1),  # words with digits, symbols or two other marks
    "poor": (0.85, None),  # words seen before in the text, of texts of 40 words and more
}
#: Labellers of repetition; where one of them votes junk, none votes clean.
REPEATING = ("stutter", "phrases")
#: Bounds of the accuracy of a labeller's vote.
RIGHT = (0.6, 0.99)


def _kind(bytes_: bytes | range) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(bytes_)] = True
    return flags


#: Which bytes are of a kind.
_KINDS = {
    "symbol": _kind(b"#$%&*@^~<>{}[]\\=+_|"),
    "upper": _kind(range(ord("A"), ord("Z") + 1)),
    "lower": _kind(range(ord("a"), ord("z") + 1)),
    "digit": _kind(range(ord("0"), ord("9") + 1)),
    "high": _kind(range(128, 256)),
    "bang": _kind(b"!"),
}
#: The features of a word equal to the one before, and of one seen before in its text.
FLAGS = (common.mix(np.arange(2, dtype=np.uint64) + np.uint64(0xF1A6)) % np.uint64(FEATURES)).astype(np.int64)


def _counts(flat: np.ndarray, *spans: tuple[np.ndarray, np.ndarray]) -> list[dict[str, np.ndarray]]:
    """For each list of spans (starts, ends) the bytes of each kind in each span, by prefix sums of two kinds at once."""
    out: list[dict[str, np.ndarray]] = [{} for _ in spans]
    names = list(_KINDS)
    for low, high in zip(names[::2], names[1::2], strict=True):
        sums = np.zeros(len(flat) + 1, np.int64)
        np.cumsum((_KINDS[low] + (_KINDS[high].astype(np.int64) << 32))[flat], out=sums[1:])
        for counts, (start, end) in zip(out, spans, strict=True):
            both = sums[end] - sums[start]
            counts[low], counts[high] = both & 0xFFFFFFFF, both >> 32
    return out


class Looks:
    """What the labellers and the features need of the texts of one batch, taken together: all its words stand in a row.

    Only texts with words count; some tells which of the batch's these are.  In the arrays by word, of says whose a word is.
    """

    def __init__(self, column: pa.Array):
        texts = common.byte_arrays(column)
        space, none = np.frombuffer(b" ", np.uint8), np.zeros(0, np.uint8)
        flat = np.concatenate([x for t in texts for x in (none if t is None else t, space)] or [none])
        begin = np.concatenate([[0], np.cumsum([1 + (0 if t is None else len(t)) for t in texts], dtype=np.int64)])
        self.hash, start, self.end = common.word_hashes(flat)
        of = np.searchsorted(begin, start, side="right") - 1
        self.some = np.bincount(of, minlength=len(texts)) > 0
        self.of = (np.cumsum(self.some) - 1)[of]
        self.n = int(self.some.sum())
        self.words = np.bincount(self.of, minlength=self.n)
        first, last = begin[:-1][self.some], begin[1:][self.some] - 1
        self.bytes = last - first
        self.in_text, self.in_word = _counts(flat, (first, last), (start, self.end))
        self.size, self.ending = self.end - start, flat[self.end - 1] if len(start) else none
        self.same = np.zeros(len(start), bool)
        self.same[1:] = (self.hash[1:] == self.hash[:-1]) & (self.of[1:] == self.of[:-1])
        self.repeated = self.words - self._distinct(self.hash, self.of)

    def _per_text(self, flags: np.ndarray) -> np.ndarray:
        return np.bincount(self.of[flags], minlength=self.n)

    def _distinct(self, hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
        """How many of 48-bit hashes differ within each text (slices of AT_ONCE bytes have 32768 texts at most)."""
        if self.n >= 1 << 16:
            raise ValueError("too many texts at once")
        keys = np.sort((of.astype(np.uint64) << np.uint64(48)) | (hashes >> np.uint64(16)))
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        return np.bincount((keys[new] >> np.uint64(48)).astype(np.int64), minlength=self.n)

    def shares(self) -> dict[str, np.ndarray]:
        w, n = self.in_word, self.words
        letters = self.in_text["upper"] + self.in_text["lower"]
        named = w["upper"] + w["lower"] + w["digit"] + w["high"]
        runs = common.shingle_hashes(self.hash, 3)
        inside = self.of[2:] == self.of[:-2] if len(self.of) > 2 else np.zeros(0, bool)
        phrases = np.maximum(n - 2, 0)
        return {
            "symbols": self.in_text["symbol"] / self.bytes,
            "shouting": self.in_text["upper"] / np.maximum(letters, 1),
            "stutter": self._per_text(self.same) / n,
            "bars": self._per_text(named == 0) / n,
            "exclaiming": self.in_text["bang"] / n,
            "odd": self._per_text((w["digit"] + w["symbol"] > 0) | (self.size - named - w["symbol"] > 1)) / n,
            "phrases": (phrases - self._distinct(runs[inside], self.of[2:][inside])) / np.maximum(phrases, 1),
            "poor": np.where(n >= 40, self.repeated / n, 0.7),
        }

    def votes(self) -> np.ndarray:
        """A digit for each labeller, base 3: 0 none, 1 clean, 2 junk."""
        code = np.zeros(self.n, np.int64)
        shares = self.shares()
        varied = ~np.any([shares[name] > LABELLERS[name][0] for name in REPEATING], axis=0)
        for name, (junk, clean) in LABELLERS.items():
            code = code * 3 + np.where(shares[name] > junk, 2, 0 if clean is None else (shares[name] < clean) & varied)
        return code

    def _by_word(self) -> tuple[np.ndarray, np.ndarray]:
        """The features of each word: itself, and its shape."""
        w = self.in_word
        shape = (w["upper"] > 0) * 1 + (w["lower"] > 0) * 2 + (w["digit"] > 0) * 4 + (w["high"] > 0) * 8 + np.minimum(w["symbol"], 3) * 16
        shape = shape + np.searchsorted([2, 5, 9], np.minimum(self.size, 12), side="right") * 64 + self.ending.astype(np.int64) * 256
        shapes = common.mix(shape.astype(np.uint64) + np.uint64(0x51A9E)) % np.uint64(FEATURES)
        return (self.hash % np.uint64(FEATURES)).astype(np.int64), shapes.astype(np.int64)

    def features(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its hashed features and the share of words that have each."""
        words, shapes = self._by_word()
        texts = np.arange(self.n)
        of = np.concatenate([self.of, self.of, self.of[self.same], np.repeat(texts, self.repeated)])
        every = np.concatenate([words, shapes, np.full(int(self.same.sum()), FLAGS[0]), np.full(int(self.repeated.sum()), FLAGS[1])])
        keys, count = np.unique(of * FEATURES + every, return_counts=True)
        cuts = np.searchsorted(keys // FEATURES, np.arange(self.n + 1))
        return [(keys[a:z] % FEATURES, count[a:z] / n) for a, z, n in zip(cuts[:-1], cuts[1:], self.words, strict=True)]

    def scores(self, weights: np.ndarray, offset: float) -> np.ndarray:
        """The linear scorer's chance of being clean: each word adds the weights of its features."""
        words, shapes = self._by_word()
        total = np.bincount(self.of, weights[words] + weights[shapes] + self.same * weights[FLAGS[0]], minlength=self.n)
        total = (total + self.repeated * weights[FLAGS[1]]) / self.words
        return 1 / (1 + np.exp(-np.clip(total + offset, -40, 40)))


def label_model(codes: np.ndarray, counts: np.ndarray, labellers: int = len(LABELLERS), rounds: int = 100) -> np.ndarray:
    """The posterior of being clean for each vote pattern, by expectation maximisation over the pattern counts."""
    votes = codes[:, None] // 3 ** np.arange(labellers - 1, -1, -1)[None] % 3
    # One accuracy for the clean votes of a labeller and one for its junk votes.
    cast = np.hstack([votes == 1, votes == 2]).astype(np.float64)
    for_clean = np.repeat([True, False], labellers)
    right = np.full(2 * labellers, 0.8)
    for _ in range(rounds):
        clean = 1 / (1 + np.exp(-(cast @ (np.log(right / (1 - right)) * np.where(for_clean, 1, -1)))))
        agree = np.where(for_clean, (counts * clean) @ cast, (counts * (1 - clean)) @ cast)
        new = np.clip((agree + 1) / (counts @ cast + 1.25), *RIGHT)
        if np.abs(new - right).max() < 1e-9:
            break
        right = new
    return clean


def train(at: list[np.ndarray], share: list[np.ndarray], label: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic scorer on soft labels, by adaptive gradient steps in the given order."""
    weights, offset = np.zeros(FEATURES), 0.0
    grown, offset_grown = np.full(FEATURES, 1e-6), 1e-6
    balance = np.clip(0.5 / np.array([max(1 - label.mean(), 0.05), max(label.mean(), 0.05)]), 0.5, 4)
    for _ in range(EPOCHS):
        for i, x, y in zip(at, share, label, strict=True):
            p = 1 / (1 + np.exp(-np.clip(weights[i] @ x + offset, -40, 40)))
            slope = (p - y) * (balance[1] * y + balance[0] * (1 - y))
            grown[i] += (slope * x) ** 2
            weights[i] -= 0.5 * slope * x / np.sqrt(grown[i])
            offset_grown += slope**2
            offset -= 0.5 * slope / np.sqrt(offset_grown)
    return weights, offset


def quality_scores(docs: DataFrame, doc_id: str, text: str, keep_from: float = KEEP) -> DataFrame:
    """Adds score (0 to 1, clean), weak_label (the label model's posterior of the text's votes) and keep."""
    spark = docs.sparkSession
    whole = common.col(docs, text)
    # Copies of a text have one draw.
    slim = docs.select(F.xxhash64(whole).alias("draw"), whole.alias("text")).where("text is not null")

    def vote(batches):
        for whole in batches:
            for b in slices(whole, 1, AT_ONCE):
                looks, sizes = Looks(b.column(1)), pa.compute.binary_length(b.column(1)).cast(pa.int64())
                some = pa.array(looks.some)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(some), sizes.filter(some), pa.array(looks.votes())], ["draw", "size", "code"])

    votes = common.stored(slim.mapInArrow(vote, "draw long, size long, code long"))
    patterns = votes.groupBy("code").count().toPandas().sort_values("code")
    added = common.free_names(docs, "score", "weak_label", "keep")
    if patterns.empty:
        return docs.select("*", F.lit(0.0).alias(added[0]), F.lit(0.0).alias(added[1]), F.lit(False).alias(added[2]))
    posterior = dict(zip(patterns["code"].tolist(), label_model(patterns["code"].to_numpy(), patterns["count"].to_numpy(np.float64)).tolist(), strict=True))

    drawn = votes.groupBy("draw").agg(F.max("size").alias("size")).orderBy("draw").limit(SAMPLE).toPandas().sort_values("draw")
    fits = drawn["draw"][(drawn["size"].cumsum() <= SAMPLE_BYTES) | (np.arange(len(drawn)) == 0)]
    sample = slim.where(F.col("draw") <= int(fits.max())).groupBy("draw").agg(F.first("text").alias("text"))

    def describe(batches):
        for whole in batches:
            for b in slices(whole, 1, AT_ONCE):
                looks = Looks(b.column(1))
                made = looks.features()
                columns = [
                    pa.array([0] * len(made), pa.int32()),
                    b.column(0).filter(pa.array(looks.some)),
                    pa.array([posterior[v] for v in looks.votes().tolist()], pa.float64()),
                    pa.array([i.tobytes() for i, _ in made], pa.binary()),
                    pa.array([v.tobytes() for _, v in made], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["model", "draw", "label", "at", "share"])

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["draw", "at"])
        weights, offset = train([np.frombuffer(v, np.int64) for v in rows["at"]], [np.frombuffer(v) for v in rows["share"]], rows["label"].to_numpy())
        return pd.DataFrame({"weights": [weights.tobytes()], "offset": [offset]})

    # The sample is bounded, so one task trains on it.
    described = sample.mapInArrow(describe, "model int, draw long, label double, at binary, share binary")
    model = described.groupBy("model").applyInPandas(fit, "weights binary, offset double").first()
    weights, offset = spark.sparkContext.broadcast(np.frombuffer(model["weights"])), model["offset"]
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(added[0], T.DoubleType()), T.StructField(added[1], T.DoubleType()), T.StructField(added[2], T.BooleanType())])

    def score(batches):
        for whole in batches:
            for b in slices(whole, at, AT_ONCE):
                looks = Looks(b.column(at))
                scores, labels = np.zeros(b.num_rows), np.zeros(b.num_rows)
                scores[looks.some] = looks.scores(weights.value, offset)
                labels[looks.some] = [posterior.get(v, 0.5) for v in looks.votes().tolist()]
                keep = pa.array(looks.some & (scores >= keep_from))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores), pa.array(labels), keep], [*b.schema.names, *added])

    return docs.mapInArrow(score, schema)
