"""Operator 9: removal of word runs that occur more than once, by suffix automata of reference shards.

A window is WINDOW consecutive words of one text.  Every window has an anchor: the run of ANCHOR words inside it with the least
hash, the leftmost on ties.  Equal windows have equal anchors at the same place, so windows can only repeat where
anchors do.  The job counts anchors over all texts and keeps those that occur twice.  The windows of one text that share an
anchor form its context, a stretch of at most 2 * WINDOW - ANCHOR words; equal contexts collapse to one row with a count.

An anchor with more than HOT distinct contexts (a line or passage that very many texts hold in different surroundings) is taken
apart: its contexts get new anchors among their runs of words, and runs that its most frequent context holds too are only
taken where a window has no other.  Windows that reach beyond what is shared so leave for anchors of their own,
which mostly occur once and end there; windows inside collapse.  This repeats until no anchor is hot or ROUNDS are over, with
nothing but the hot contexts moved.

The distinct contexts are the reference.  They are dealt by anchor into shards of about SHARD bytes, the contexts of an anchor that
is still hot over several.  A task builds each shard's suffix automaton, over words, with the number of occurrences of each
state, and the automaton, of bounded size, is sent (by a cogroup) to the tasks with the stretches of documents that hold an anchor of
the shard.  There the stretches are streamed through it for matching statistics: the longest run ending at each word that
occurs twice (in a shard that holds the stretch itself) or at all (in another shard).  Maximal spans of WINDOW words or more are
marked.  An automaton is sent to no other task: sending every shard to every text would grow with the square of the corpus.
A context that occurs twice itself is a match from end to end, so it is marked without a pass.

Texts and contexts are told apart by 128-bit digests; anchors and their places route.  What repeats is decided on these digests where a whole
context comes again, and on the words, by an automaton, everywhere else.

Texts cross shuffles compressed.  Null and empty texts have no words; texts shorter than a window stay as they are.  Copies of a
text, repeated rows too, are occurrences of their own.  Every window is judged on the input.  An empty table gives an empty
result; columns that clash with the added ones keep their names and values.
"""

from __future__ import annotations

import io
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.llm import common
from kinloom.llm.bpe import slices

#: Words of a window and of an anchor; distinct contexts from which an anchor is taken apart; rounds of that; bytes of contexts in a shard.
WINDOW, ANCHOR, HOT, ROUNDS, SHARD = 35, 8, 1000, 6, 1 << 17
#: Stretches that pass through one automaton in one task.
STREAM = 4000


class SuffixAutomaton:
    """The suffix automaton of several word sequences, with the weighted occurrences of each state."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, link: int, next_: dict, count: int) -> int:
        self.next.append(next_)
        self.link.append(link)
        self.length.append(length)
        self.count.append(count)
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state of the shorter runs of q that p's word reaches."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), 0)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[str], weight: int) -> None:
        last, number = 0, self.number
        for name in words:
            w = number.setdefault(name, len(number))
            p = last
            q = self.next[p].get(w)
            if q is not None:  # another sequence has been here
                last = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
                self.count[last] += weight
                continue
            last = self._state(self.length[p] + 1, 0, {}, weight)
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = last
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                self.link[last] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)

    def dump(self) -> bytes:
        """Sums occurrences along suffix links, finds for each state the longest suffix that occurs twice, and packs all that matching needs."""
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        for s in reversed(order):
            self.count[self.link[s]] += self.count[s]
        repeated = [0] * len(self.link)
        for s in order:
            repeated[s] = self.length[s] if self.count[s] > 1 else repeated[self.link[s]]
        out, each = io.BytesIO(), [len(n) for n in self.next]
        words = np.fromiter(chain.from_iterable(self.next), np.int32, sum(each))
        targets = np.fromiter(chain.from_iterable(n.values() for n in self.next), np.int32, sum(each))
        names = np.frombuffer(" ".join(self.number).encode(), np.uint8)
        arrays = {"link": self.link, "length": self.length, "repeated": repeated, "each": each}
        np.savez(out, words=words, targets=targets, names=names, **{k: np.array(v, np.int32) for k, v in arrays.items()})
        return zstandard.compress(out.getbuffer(), 1)


class Matcher:
    """A packed automaton, for matching statistics."""

    def __init__(self, data: bytes):
        with np.load(io.BytesIO(zstandard.decompress(data))) as z:
            names = z["names"].tobytes().decode()
            self.number = {w: i for i, w in enumerate(names.split(" "))} if names else {}
            self.link, self.length, self.repeated = (z[k].tolist() for k in ("link", "length", "repeated"))
            state = np.repeat(np.arange(len(self.link), dtype=np.int64), z["each"])
            self.step = dict(zip((state * max(len(self.number), 1) + z["words"]).tolist(), z["targets"].tolist(), strict=True))

    def statistics(self, words: list[str], own: bool) -> list[int]:
        """For each word how long the longest run is that ends there and occurs in the shard; own: a sequence of the shard, and twice."""
        out, s, n, step, size = [], 0, 0, self.step, len(self.number)
        for w in words:
            i = self.number.get(w)
            if i is None:
                s = n = 0
            else:
                t = step.get(s * size + i)
                while t is None and s:
                    s = self.link[s]
                    n = self.length[s]
                    t = step.get(s * size + i)
                s, n = (0, 0) if t is None else (t, n + 1)
            out.append(min(n, self.repeated[s]) if own else n)
        return out


def _stretches(grams: np.ndarray, order: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of runs of anchor words, with what they are ordered by: name and place of each anchor, and the first and last window that it belongs to."""
    wide = window - anchor + 1
    at = np.lib.stride_tricks.sliding_window_view(order, wide).argmin(1) + np.arange(len(grams) - wide + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return grams[at[first]], at[first], first, np.append(first[1:], len(at)) - 1


def anchors(hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text's word hashes: hash and place of each anchor, and the first and last window that it belongs to."""
    none = np.zeros(0, np.int64)
    if len(hashes) < window:
        return none.view(np.uint64), none, none, none
    grams = common.shingle_hashes(hashes, anchor)
    return _stretches(grams, grams, window, anchor)


def _merged(spans: np.ndarray) -> np.ndarray:
    """Sorted, disjoint spans from overlapping ones, as rows of start and end."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    at = np.flatnonzero(new)
    return np.column_stack([spans[at, 0], np.append(reach[at[1:] - 1], reach[-1])])


def _spans_of(lengths: list[int], window: int) -> list[int]:
    """Starts and ends, one behind another, of the maximal marked spans of a context."""
    spans = [(e + 1 - n, e + 1) for e, n in enumerate(lengths) if n >= window]
    return _merged(np.array(spans)).ravel().tolist() if spans else []


def _grams(context: str, anchor: int) -> np.ndarray:
    return common.shingle_hashes(common.word_hashes(np.frombuffer(context.encode(), np.uint8))[0], anchor)


def _taken_apart(window: int, anchor: int):
    """New anchors of contexts: anchor0, digest0, offset, anchor, n, context, top in; the first three are of the text's own context."""

    def run(batches):
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
        for b in batches:
            out: list[list] = [[] for _ in kinds]
            tops: dict[int, np.ndarray] = {}
            for anchor0, digest0, offset, name, n, context, top in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if name not in tops:
                    tops[name] = _grams(top, anchor)
                grams, words = _grams(context, anchor), context.split(" ")
                order = (grams >> np.uint64(1)) | (np.isin(grams, tops[name]).astype(np.uint64) << np.uint64(63))
                named, place, first, last = _stretches(grams, order, window, anchor)
                with np.errstate(over="ignore"):
                    named = common.mix(named * np.uint64(0x9E3779B97F4A7C15) + np.uint64(name & (1 << 64) - 1)).view(np.int64)
                for a, p, lo, hi in zip(named.tolist(), place.tolist(), first.tolist(), (last + window).tolist(), strict=True):
                    for values, v in zip(out, (anchor0, digest0, offset + lo, a, p - lo, n, " ".join(words[lo:hi])), strict=True):
                        values.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], ["anchor0", "digest0", "offset", "anchor", "place", "n", "context"])

    return run


def _digest() -> F.Column:
    """What tells contexts apart: the words and the anchor's place among them."""
    return F.unhex(F.md5(F.concat_ws(" ", F.col("place").cast("string"), "context").cast("binary")))


def _automata(batches):
    """An automaton for each shard, from its reference (shard, context, n, hands), sorted by shard, and the tasks that ask for it."""
    for batch in common.whole_groups(batches, [0]):
        cuts = common.cuts(batch, [0])
        shard, contexts, weights, hands = (batch.column(i).to_pylist() for i in range(4))
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            automaton = SuffixAutomaton()
            for c, n in zip(contexts[a:z], weights[a:z], strict=True):
                automaton.add(c.split(" "), n)
            yield pa.RecordBatch.from_arrays([pa.array([shard[a]], pa.int64()), pa.array([max(hands[a:z])], pa.int64()), pa.array([automaton.dump()], pa.binary())], ["to", "hands", "automaton"])


def _streamed(window: int):
    """Marked spans of the stretches that meet one automaton."""

    def run(stretches: pd.DataFrame, automata: pd.DataFrame) -> pd.DataFrame:
        out: tuple[list, list, list] = ([], [], [])
        if len(stretches) and len(automata):
            matcher = Matcher(automata["automaton"].iloc[0])
            for anchor, digest, context, own in zip(stretches["anchor"], stretches["digest"], stretches["context"], stretches["own"], strict=True):
                spans = _spans_of(matcher.statistics(context.split(" "), own), window)
                if spans:
                    for values, v in zip(out, (anchor, digest, spans), strict=True):
                        values.append(v)
        return pd.DataFrame({"anchor": np.array(out[0], np.int64), "digest": pd.Series(out[1], dtype=object), "spans": pd.Series(out[2], dtype=object)})

    return run


def _matched(reference: DataFrame, window: int) -> DataFrame:
    """Marked spans (anchor, digest, spans) of contexts that occur once: anchor, digest, n, context, and contexts (of the anchor) in."""
    # A hot anchor's contexts are dealt over several shards, and so are the stretches that pass through one of its automata over tasks.
    reference = common.stored(reference.withColumn("parts", F.ceil(F.col("contexts") / HOT)).withColumn("hands", F.ceil(F.col("contexts") / STREAM)))
    size = reference.agg(F.sum(F.length("context"))).first()[0]
    shards = max(1, -(-(size or 0) // SHARD))
    shard_of = lambda part: F.pmod(F.xxhash64("anchor", part), F.lit(shards))
    own = F.pmod(F.xxhash64("digest"), F.col("parts"))
    built = reference.select(shard_of(own).alias("shard"), "context", "n", "hands").repartition("shard").sortWithinPartitions("shard")
    automata = built.mapInArrow(_automata, "to long, hands long, automaton binary").select("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("hands") - 1)).alias("hand"), "automaton")
    # Two parts of an anchor may share a shard.
    met_in = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), shard_of)))
    streams = reference.where("n = 1").select("anchor", "digest", "context", "hands", met_in.alias("shard"), shard_of(own).alias("home"))
    hand = F.pmod(F.xxhash64("digest"), F.col("hands")).alias("dealt")
    streams = streams.select("shard", hand, "anchor", "digest", "context", (F.col("shard") == F.col("home")).alias("own"))
    met = streams.groupBy("shard", "dealt").cogroup(automata.groupBy("to", "hand"))
    return met.applyInPandas(_streamed(window), "anchor long, digest binary, spans array<int>")


def _marked(distinct: DataFrame, window: int, anchor: int) -> DataFrame:
    """The marked spans of contexts: anchor, digest, n and context in; anchor, digest and spans out."""
    rest = distinct.select(F.col("anchor").alias("anchor0"), F.col("digest").alias("digest0"), F.lit(0).alias("offset"), "anchor", "digest", "n", "context")
    out = None
    for round_ in range(ROUNDS + 1):
        once = distinct if not round_ else common.stored(rest.groupBy("anchor", "digest").agg(F.sum("n").alias("n"), F.first("context").alias("context")))
        # Only anchors of several contexts, with one to be decided, need an automaton.
        sizes = common.stored(once.groupBy("anchor").agg(F.count("*").alias("contexts"), F.min("n").alias("least")).where("contexts > 1 and least = 1").drop("least"))
        hot = sizes.where(F.col("contexts") > HOT) if round_ < ROUNDS else sizes.limit(0)
        last = hot.isEmpty()
        cold = once.join(sizes if last else sizes.where(F.col("contexts") <= HOT), "anchor")
        whole = once.where("n > 1").select("anchor", "digest", F.array(F.lit(0), F.size(F.split("context", " "))).alias("spans"))
        marks = whole.unionByName(_matched(cold, window))
        if round_:
            mine = rest.select("anchor0", "digest0", "offset", "anchor", "digest").join(common.stored(marks), ["anchor", "digest"])
            marks = mine.select(F.col("anchor0").alias("anchor"), F.col("digest0").alias("digest"), F.transform("spans", lambda s: s + F.col("offset")).alias("spans"))
        marks = common.stored(marks)
        out = marks if out is None else out.unionByName(marks)
        if last:
            return out
        top = once.join(hot, "anchor").groupBy("anchor").agg(F.max_by("context", F.struct("n", "digest")).alias("top"))
        apart = rest.join(top, "anchor").select("anchor0", "digest0", "offset", "anchor", "n", "context", "top")
        apart = apart.mapInArrow(_taken_apart(window, anchor), "anchor0 long, digest0 binary, offset int, anchor long, place int, n long, context string")
        rest = common.stored(apart.withColumn("digest", _digest()).drop("place"))


def repeated_spans(docs: DataFrame, text: str, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """For each distinct text that holds a repeated window: its key (digest) and the word spans that such windows cover."""
    rows = docs.select(common.col(docs, text).alias("text")).where("text is not null").withColumn("key", common.text_digest(F.col("text")))

    def hashes(batches):
        for whole in batches:
            for b in slices(whole, 1):
                found = [anchors(common.word_hashes(t)[0], window, anchor)[0].view(np.int64) for t in common.byte_arrays(b.column(1))]
                some = np.array([len(f) > 0 for f in found], bool)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(some)), pa.array([f for f in found if len(f)], pa.list_(pa.int64()))], ["key", "anchors"])

    sampled = rows.select("key", "text").mapInArrow(hashes, "key binary, anchors array<long>")
    texts = sampled.groupBy("key").agg(F.count("*").alias("copies"), F.first("anchors").alias("anchors"))
    texts = common.stored(texts.withColumn("tid", F.monotonically_increasing_id()))
    each = texts.select("tid", "copies", F.explode("anchors").alias("anchor"))
    twice = common.stored(each.groupBy("anchor").agg(F.sum("copies").alias("n")).where("n > 1").select("anchor"))
    wanted = each.select("tid", "anchor").join(twice, "anchor").groupBy("tid").agg(F.collect_set("anchor").alias("wanted"))
    wanted = common.stored(texts.select("tid", "key", "copies").join(wanted, "tid").select("key", "copies", "wanted"))

    packed = rows.select("key", "text").mapInArrow(_pack(1), "key binary, text binary")
    with_text = packed.groupBy("key").agg(F.first("text").alias("text"))

    def contexts(batches):
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        names = ["key", "copies", "anchor", "first", "place", "context"]
        for b in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            out: list[list] = [[] for _ in kinds]
            for key, copies, want, z in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                data = zstandard.decompress(z)
                h, start, end = common.word_hashes(np.frombuffer(data, np.uint8))
                name, place, first, last = anchors(h, window, anchor)
                name = name.view(np.int64)
                spaced = b" ".join(data.split())  # the separators of words are those of bytes.split
                at = np.concatenate([[0], np.cumsum(end - start + 1)])
                k = np.flatnonzero(np.isin(name, np.array(want, np.int64)))
                lo, hi = first[k], last[k] + window
                parts = [spaced[i:j] for i, j in zip(at[lo].tolist(), (at[hi] - 1).tolist(), strict=True)]
                for values, v in zip(out, ([key] * len(k), [copies] * len(k), name[k].tolist(), lo.tolist(), (place[k] - lo).tolist(), parts), strict=True):
                    values += v
            columns = [pa.array(v, t) for v, t in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns[:5], columns[5].cast(pa.string())], names)

    found = with_text.join(wanted, "key").select("key", "copies", "wanted", "text").mapInArrow(contexts, "key binary, copies long, anchor long, first int, place int, context string")
    found = common.stored(found.withColumn("digest", _digest()))
    distinct = found.groupBy("anchor", "digest").agg(F.sum("copies").alias("n"), F.first("context").alias("context"))
    distinct = common.stored(distinct)
    marked = _marked(distinct, window, anchor)
    # Spans of a context become spans of the texts that hold it.
    held = found.select("key", "anchor", "digest", "first").join(marked, ["anchor", "digest"])
    moved = held.select("key", F.transform("spans", lambda s: s + F.col("first")).alias("spans"))
    return common.stored(moved.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans")))


def _pack(column: int):
    """Compresses the text of each row."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for whole in batches:
            for b in slices(whole, column):
                texts = [None if t is None else pack(t.tobytes()) for t in common.byte_arrays(b.column(column))]
                columns = [*b.columns]
                columns[column] = pa.array(texts, pa.binary())
                yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return run


def _kept(data: bytes, spans: list[int] | None, joined: bool) -> tuple[int, int, str]:
    """Number of words, of removed ones, and what is left of a text."""
    merged = _merged(np.array(spans).reshape(-1, 2)).tolist() if spans else []
    gone, at, parts = sum(z - a for a, z in merged), 0, []
    if joined:
        words = data.split()  # the separators of words are those of bytes.split
        for a, z in merged:
            parts += words[at:a]
            at = z
        return len(words), gone, b" ".join(parts + words[at:]).decode()
    start, _ = common.word_bounds(np.frombuffer(data, np.uint8))
    if not merged:
        return len(start), 0, data.decode()
    bound = [*start.tolist(), len(data)]  # a removed word goes with the white space behind it
    for a, z in merged:
        parts.append(data[bound[at] : bound[a]])
        at = z
    return len(start), gone, (data[: bound[0]] + b"".join(parts) + data[bound[at] :]).decode()


def remove_repeats(docs: DataFrame, text: str, window: int = WINDOW, anchor: int = ANCHOR, joined: bool = False) -> DataFrame:
    """The input's rows with their text freed of repeated windows, and n_words and n_removed.

    joined: kept words stand with one space between them in every text; else texts that lose nothing stay as they are, and
    the others keep the white space behind each kept word.  A null text stays null (joined: empty).
    """
    spans = repeated_spans(docs, text, window, anchor)
    key, cover, words, removed = common.free_names(docs, "text_key", "spans", "n_words", "n_removed")
    at = docs.columns.index(text)
    fields = list(docs.schema.fields)
    fields[at] = T.StructField(text, T.BinaryType())
    keyed = docs.withColumn(key, common.text_digest(common.col(docs, text)))
    packed = keyed.mapInArrow(_pack(at), T.StructType([*fields, T.StructField(key, T.BinaryType())]))
    met = packed.join(spans.select(F.col("key").alias(key), F.col("spans").alias(cover)), key, "left")
    met = met.select(*[common.col(docs, c) for c in docs.columns], cover)
    fields = [*docs.schema.fields, T.StructField(words, T.LongType()), T.StructField(removed, T.LongType())]
    names = [f.name for f in fields]

    def cut(batches):
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for z, s in zip(b.column(at).to_pylist(), b.column(len(names) - 2).to_pylist(), strict=True):
                n, gone, kept = (0, 0, "" if joined else None) if z is None else _kept(zstandard.decompress(z), s, joined)
                for values, v in zip(out, (n, gone, kept), strict=True):
                    values.append(v)
            columns = [*b.columns[:-1]]
            columns[at] = pa.array(out[2], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names)

    return met.mapInArrow(cut, T.StructType(fields))
