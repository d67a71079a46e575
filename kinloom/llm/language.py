"""Operator 2: language of a text by unigrams of pieces, summed over all segmentations.

The pieces are those of a public sentencepiece vocabulary.  Each language has a probability for each piece and each single
character.  A text is a sequence of letter runs (Unicode category L) in lower case, each with the vocabulary's space mark in front.
The likelihood of a run under a language is the sum over all ways of cutting it into pieces, by the forward
algorithm, rescaled on the way so that runs of any length are scored whole; a text's is the product over its runs, and its
score is the posterior of the best language under equal priors.  The algorithm runs over all distinct runs of one length in a batch
at once, one array step for each place, and holds only the places that a piece can reach back to.  Runs are taken LETTERS at a time, or
one by one where longer, so memory is that of a run's pieces: about 100 bytes a letter.  A run of a million letters takes some ten seconds.

Probabilities are fitted by expectation maximisation (the forward-backward algorithm) on a sample of labelled rows: for each
language about SAMPLE distinct texts, drawn by a hash of the text alone, out of those that may be learnt from.  Of these, runs
of over LEARNT letters are learnt from in parts of that length, side by side.  The sample and the vocabulary
bound what is gathered and broadcast: a row of probabilities for each language, LANGUAGES of them at most (more raise an error).
Prediction covers every row and whole texts; nothing is shuffled.

Texts that are null or hold no letter are "und" with score 0.  Without a row to learn from every text is.  Ties between
languages go to the first by name.  Repeated rows are predicted alike and learnt from once.  Added columns take names
that the input does not have.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.llm import common
from kinloom.llm.bpe import file_broadcast, loaded, slices

#: Texts to learn from for each language; rounds of expectation maximisation; most languages; steps between rescalings.
SAMPLE, ROUNDS, LANGUAGES, RESCALE = 1024, 3, 1000, 16
#: Weight of the even distribution in every language; runs whose scores a worker remembers.
SMOOTH, WORD_CACHE = 1e-3, 400_000
#: Letters scored at a time, letters of a part of a run that is learnt from, places held besides those looked back to, bytes of these.
LETTERS, LEARNT, PLACES, HELD = 400_000, 512, 1024, 64 << 20
#: Runs together below which a place is one step.
FEW = 64
_MARK = "▁"
_RUNS = regex.compile(r"\p{L}+").findall


class Pieces:
    """The vocabulary: numbers of pieces in lower case; 0 stands for any other character."""

    def __init__(self, data: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        names = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        kept = dict.fromkeys(p.lower() for p in names if _RUNS(p.lstrip(_MARK)) == [p.lstrip(_MARK)] or p == _MARK)
        self.number = {p: i + 1 for i, p in enumerate(kept)}
        self.longest = max(map(len, self.number))
        self.size = len(self.number) + 1

    def lattice(self, runs: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Runs of one length together: their positions in runs, and piece numbers [run, end, length - 1], -1 for none."""
        by_length: dict[int, list[int]] = {}
        for i, r in enumerate(runs):
            by_length.setdefault(len(r), []).append(i)
        get, out = self.number.get, []
        for n, at in by_length.items():
            width = min(n, self.longest)
            table = np.full((len(at), n, width), -1, np.int32)
            for k in range(1, width + 1):
                spans = [get(runs[i][e - k : e], -1 if k > 1 else 0) for i in at for e in range(k, n + 1)]
                table[:, k - 1 :, k - 1] = np.array(spans, np.int32).reshape(len(at), n - k + 1)
            out.append((np.array(at), table))
        return out


def letter_runs(text: str) -> list[str]:
    """The letter runs of a text as the model scores them."""
    return [_MARK + run for run in _RUNS(text.lower())]


def _forward(table: np.ndarray, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """alpha[end, run, language], the summed probability of all cuts of the first end characters, and log factors that it lacks.

    prob has a zero row last.  Every RESCALE steps the places that later ones look back to are divided by their greatest value.
    """
    n, length, width = table.shape
    alpha, lacks = np.zeros((length + 1, n, prob.shape[1])), np.zeros((length + 1, n, prob.shape[1]))
    alpha[0], scale = 1, np.zeros((n, prob.shape[1]))
    for e in range(1, length + 1):
        lacks[e] = scale
        for k in range(1, min(e, width) + 1):
            alpha[e] += alpha[e - k] * prob[table[:, e - 1, k - 1]]
        if e % RESCALE == 0 and e < length:
            back = slice(max(0, e + 1 - width), e + 1)
            most = np.maximum(alpha[back].max(0), 1e-300)
            alpha[back] /= most
            scale = scale + np.log(most)
            lacks[back] += np.log(most)
    return alpha, lacks


def _log_likelihood(table: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """The log of the last row of _forward, for runs of any length: only the places that later ones look back to are held."""
    n, length, width = table.shape
    held = np.zeros((width + min(PLACES, length), n, prob.shape[1]))
    held[width - 1], at, scale = 1, width - 1, np.zeros((n, prob.shape[1]))
    for e in range(1, length + 1):
        at += 1
        if at == len(held):
            held[:width], at = held[-width:].copy(), width
        if n < FEW:  # one step for all pieces that end here
            held[at] = np.einsum("knl,nkl->nl", held[at - width : at][::-1], prob[table[:, e - 1]])
        else:
            held[at] = 0
            for k in range(1, min(e, width) + 1):
                held[at] += held[at - k] * prob[table[:, e - 1, k - 1]]
        if e % RESCALE == 0 and e < length:
            back = held[at - width + 1 : at + 1]
            most = np.maximum(back.max(0), 1e-300)
            back /= most
            scale += np.log(most)
    return np.log(np.maximum(held[at], 1e-300)) + scale


def _backward(table: np.ndarray, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """beta[start, run], the summed probability of all cuts of the characters from start on, and log factors, for one language."""
    n, length, width = table.shape
    beta, lacks, scale = np.zeros((length + 1, n)), np.zeros((length + 1, n)), np.zeros(n)
    beta[length] = 1
    for s in range(length - 1, -1, -1):
        lacks[s] = scale
        for k in range(1, min(length - s, width) + 1):
            beta[s] += beta[s + k] * prob[table[:, s + k - 1, k - 1]]
        if s % RESCALE == 0 and s:
            ahead = slice(s, min(length + 1, s + width))
            most = np.maximum(beta[ahead].max(0), 1e-300)
            beta[ahead] /= most
            scale = scale + np.log(most)
            lacks[ahead] += np.log(most)
    return beta, lacks


def fit(pieces: Pieces, runs: list[str], counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The probability of each piece (and a zero behind), from one language's runs and how often each occurs."""
    if any(len(r) > LEARNT for r in runs):
        counts = np.repeat(counts, [-(-len(r) // LEARNT) for r in runs])
        runs = [r[i : i + LEARNT] for r in runs for i in range(0, len(r), LEARNT)]
    lattice = pieces.lattice(runs)
    prob = np.full(pieces.size + 1, 1 / pieces.size)
    prob[-1] = 0
    for _ in range(rounds):
        mass = np.zeros(pieces.size + 1)
        for at, table in lattice:
            n, length, width = table.shape
            alpha, lacks = (x[:, :, 0] for x in _forward(table, prob[:, None]))
            beta, behind = _backward(table, prob)
            total = np.log(np.maximum(alpha[length], 1e-300)) + lacks[length]
            for e in range(1, length + 1):
                for k in range(1, min(e, width) + 1):
                    used = table[:, e - 1, k - 1]
                    weight = counts[at] * np.exp(np.minimum(lacks[e - k] + behind[e] - total, 700))
                    np.add.at(mass, used, alpha[e - k] * prob[used] * beta[e] * weight)
        mass[-1] = 0
        prob[:-1] = (1 - SMOOTH) * mass[:-1] / max(mass.sum(), 1e-300) + SMOOTH / pieces.size
    return prob


def learn(docs: DataFrame, text: str, lang: str, usable: Column, path: str) -> DataFrame:
    """Piece probabilities of each language: lang, prob (packed doubles), from about SAMPLE texts each."""
    file = file_broadcast(docs.sparkSession, path)
    rows = docs.where(usable & common.col(docs, lang).isNotNull() & common.col(docs, text).isNotNull())
    # A text is learnt from if its hash lies in the share that leaves about SAMPLE texts of its language: no rows are sorted, and
    # of the copies of a text those of a task count once before any row is moved.
    share = F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.approx_count_distinct(F.xxhash64("text"), 0.02))
    rows = rows.select(common.col(docs, lang).alias("lang"), common.col(docs, text).alias("text"))
    shares = common.stored(rows.groupBy("lang").agg(share.alias("share")))
    if shares.count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn")
    draw = F.shiftrightunsigned(F.xxhash64("text"), 11) / float(1 << 53)
    sample = rows.withColumn("draw", draw).join(F.broadcast(shares), "lang").where("draw < share").groupBy("lang", F.xxhash64("text", F.lit(1)).alias("name")).agg(F.first("text").alias("text"))
    sample = sample.select("lang", "text")

    def runs(batches):
        for b in batches:
            for lang_, text_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = letter_runs(text_)
                yield pa.RecordBatch.from_arrays([pa.array([lang_] * len(found), pa.string()), pa.array(found, pa.string())], ["lang", "run"])

    counted = sample.mapInArrow(runs, "lang string, run string").groupBy("lang", "run").agg(F.count("*").alias("n"))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("run")  # of the bounded sample
        prob = fit(loaded(Pieces, file.value), group["run"].tolist(), group["n"].to_numpy(np.float64))
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "prob": [prob.tobytes()]})

    return counted.groupBy("lang").applyInPandas(one, "lang string, prob binary")


def predict(docs: DataFrame, text: str, model: DataFrame, path: str) -> DataFrame:
    """Adds lang_pred and score. The model has one row for each language and is broadcast."""
    spark = docs.sparkSession
    file = file_broadcast(spark, path)
    fitted = sorted((r["lang"], r["prob"]) for r in model.collect())
    names = [n for n, _ in fitted]
    table = spark.sparkContext.broadcast(np.array([np.frombuffer(p) for _, p in fitted]).T.copy() if fitted else np.zeros((0, 0)))
    added = common.free_names(docs, "lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField(added[0], T.StringType()), T.StructField(added[1], T.DoubleType())])
    at = docs.columns.index(text)

    def run(batches):
        number: dict[str, int] = {}
        scores = np.zeros((0, len(names)))
        for whole in batches:
            for b in slices(whole, at):
                if len(number) > WORD_CACHE:
                    number, scores = {}, scores[:0]
                found = []
                for t in b.column(at).to_pylist():
                    runs = letter_runs(t) if t and names else []
                    for r in set(runs).difference(number):
                        number[r] = len(number)
                    found.append(np.fromiter(map(number.__getitem__, runs), np.int32, len(runs)))
                new = list(number)[len(scores) :]
                scores = np.vstack([scores, log_likelihoods(loaded(Pieces, file.value), new, table.value)]) if new else scores
                langs, values = [], []
                for f in found:
                    if not len(f):
                        langs.append("und")
                        values.append(0.0)
                        continue
                    total = scores[f].sum(0)
                    best = int(total.argmax())
                    langs.append(names[best])
                    values.append(float(1 / np.exp(total - total[best]).sum()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(values, pa.float64())], [*b.schema.names, *added])

    return docs.mapInArrow(run, schema)


def log_likelihoods(pieces: Pieces, runs: list[str], prob: np.ndarray) -> np.ndarray:
    """log P(run | language) for each run and language."""
    out = np.zeros((len(runs), prob.shape[1]))
    part = np.cumsum([len(r) for r in runs], dtype=np.int64) // LETTERS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(runs)]
    for start, end in zip(cuts[:-1], cuts[1:], strict=True):
        for at, table in pieces.lattice(runs[start:end]):
            # Runs together, and the places held for them, within some memory.
            width = table.shape[2] + min(PLACES, table.shape[1])
            step = max(1, HELD // (8 * width * max(1, prob.shape[1])))
            for i in range(0, len(at), step):
                out[start + at[i : i + step]] = _log_likelihood(table[i : i + step], prob)
    return out
