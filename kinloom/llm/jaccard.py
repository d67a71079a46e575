"""Operator 4: self-join of texts on the Jaccard similarity of their word shingles, by chosen paths.

Equal texts collapse to one row with a count.  A text's set is the distinct hashes of its runs of five words (a text of
fewer words is one shingle).  In each of RUNS runs a set enters the nodes of the shingles that it samples, each with chance
FIRST over the set's size, by a hash that all sets share; similar sets so share a node with known chance, and the number of runs
follows from the target recall.  A node with few members is compared by brute force.  A larger one is split again: each
member samples places of its one-permutation minhash sketch, each place with the same chance for all members of the node,
and enters the child of each place and value; children are split on until they are small.  What most members of a large node
share would only copy them, so places whose value is heavy in the node (by PROBES of its members, or so) are not sampled, and members
that consist of such values by half and more (CORE) become one rough group as they are.  Members within 0.3 of
that mark take both ways, so that no link is lost between the two.  What is still large after LEVELS levels becomes a rough group too.

Nodes only give rough groups, as stars and spanning forests over sketches with a margin, so that no group's pairs are sent on.
Inside a rough group links are counted exactly.  Each set x is held against a pivot set P of its group, the shingles that most
of some members have, and only the difference D(x) is kept.  Two sets differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)| shingles, so
with a(x) = (q + p) |D(x)| - (q - p) |x| for a threshold p / q they link if and only if a(x) + a(y) <= 2 (q + p) |D(x) & D(y)|.
Where a(x) + a(y) <= 0 that needs no comparison: such links are counted by a running sum over the values of a, and a star at
the member with the least a joins them.  The rest are compared by their differences, in blocks of the order of a, and only
blocks whose least values of a and largest differences can still meet the condition.  So a group of very many near copies of
one text costs one pass over its members, and nothing about its pairs is stored.

Links found are exact; a link between texts whose sketches agree in fewer places than sketch_level asks, or that share no
node in any run, would be missed (see RECALL; survival gives what the later levels add to that).  The threshold, over 0 and at most 1,
counts as the nearest fraction with a denominator up to a million.

Null texts, empty texts and texts without words link with nothing.  Equal texts link with each other whatever their id.  A
null id takes part; a class's id is its least known id, null if it has none.  Repeated rows are rows of their own.  Further
columns take no part, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm import common
from kinloom.llm.bpe import slices
from kinloom.llm.vector_dedup import _roots
from kinloom.operators.graph import connected_components

WORDS, THRESHOLD, RECALL = 5, 0.8, 1 - 1e-5
#: Mean samples of a set in a run, and of a sketch at a later level.
FIRST, LATER = 1.6, 2.5
#: Members of a node that are compared by brute force; levels; places of a sketch; deviations of a sketch's agreement below the threshold.
SMALL, LEVELS, PLACES, BELOW = 256, 8, 128, 32**0.5
#: Share of a node's members from which a value is heavy; members by which that, and a group's pivot, is judged.
HEAVY, PROBES, SHAPING = 0.15, 48, 24
#: Share of heavy values from which a member is of the core, and up to which it is split on.
CORE = (0.5, 0.8)
#: Bytes of a block of differences, and what a member counts besides its shingles.
BLOCK, ROW = 1 << 20, 1024


def text_set(data: np.ndarray, words: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    hashes, _, _ = common.word_hashes(data)
    return np.unique(common.shingle_hashes(hashes, min(words, len(hashes)) or 1))


def runs_for(threshold: float, recall: float) -> int:
    """Runs until two sets at the threshold share a first node with the chance recall."""
    return max(1, math.ceil(math.log(1 - recall) / -(FIRST * threshold)))


def survival(threshold: float, levels: int) -> float:
    """The chance that a pair at the threshold in one large node still meets in a descendant that many levels below."""
    alive = 1.0
    for _ in range(levels):
        alive = 1 - math.exp(-LATER * threshold * alive)
    return alive


def sketch_level(threshold: float) -> float:
    """The agreement of two sketches from which their sets may reach the threshold: 0.6 for 0.8 and above."""
    return min(0.6, threshold - BELOW * math.sqrt(max(threshold * (1 - threshold), 0.0) / PLACES))


def _nodes(tokens: np.ndarray, runs: int) -> np.ndarray:
    level = np.uint64(min(FIRST / len(tokens), 1.0) * ((1 << 64) - 1025))
    out = []
    with np.errstate(over="ignore"):
        for r in range(runs):
            h = common.mix(tokens * np.uint64(2 * r + 1) + np.uint64(0x632BE59BD9B4E019 * (r + 1) & (1 << 64) - 1))
            out.append(common.mix(h[h <= level] + np.uint64(r)))
    return np.concatenate(out)


def _sketch(tokens: np.ndarray) -> np.ndarray:
    """For each place 16 bits of the least hash that falls there, 0 where none does."""
    bounds = (np.arange(PLACES, dtype=np.uint64) << np.uint64(57)) if PLACES == 128 else np.linspace(0, 2**64 - 1, PLACES, endpoint=False).astype(np.uint64)
    at = np.searchsorted(tokens, bounds)
    ends = np.append(at[1:], len(tokens))
    out = np.zeros(PLACES, np.uint16)
    some = at < ends
    out[some] = np.maximum(common.mix(tokens[at[some]]) & np.uint64(0xFFFF), 1)
    return out


def _children(nodes: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and child nodes: places sampled by a hash of node and place, over the filled places."""
    filled = sketches > 0
    level = np.minimum(LATER / np.maximum(filled.sum(1), 1), 1.0)[:, None]
    with np.errstate(over="ignore"):
        h = common.mix(nodes[:, None] * np.uint64(0x9FB21C651E98DF25) + np.arange(PLACES, dtype=np.uint64)[None])
        i, j = np.nonzero(filled & (h.astype(np.float64) <= level * 2.0**64))
        return i, common.mix(h[i, j] + sketches[i, j].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the places filled on either side that agree."""
    either = ((a > 0) | (b > 0)).sum(-1)
    return ((a == b) & (a > 0)).sum(-1) / np.maximum(either, 1)


def _forest(keys: list[bytes], i: np.ndarray, j: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    root = _roots(len(keys), i, j)
    at = np.flatnonzero(root != np.arange(len(keys)))
    return [keys[x] for x in at], [keys[x] for x in root[at]]


def _small_nodes(level: float):
    """Forest edges of small nodes: node, key, sketch in, sorted by node."""

    def run(batches):
        for batch in common.whole_groups(batches, [0]):
            cuts = np.array(common.cuts(batch, [0]))
            sketches = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, PLACES)
            sizes = np.diff(cuts)
            ii, jj = [], []
            for step in range(1, int(sizes.max()) if len(sizes) else 0):  # members step places apart in one node
                starts = np.repeat(cuts[:-1][sizes > step], sizes[sizes > step] - step)
                more = sizes[sizes > step] - step
                i = starts + np.arange(len(starts)) - np.repeat(np.cumsum(more) - more, more)
                near = np.concatenate([_agree(sketches[p], sketches[p + step]) >= level for p in np.array_split(i, len(i) // 20_000 + 1)])
                ii.append(i[near])
                jj.append(i[near] + step)
            none = np.zeros(0, np.int64)
            key, root = _forest(batch.column(1).to_pylist(), np.concatenate([none, *ii]), np.concatenate([none, *jj]))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(root, pa.binary())], ["key", "root"])

    return run


def _heavy(batches):
    """For each node (node, list of sketches of some members) the value that HEAVY of them have in a place, 0 where there is none."""
    for b in batches:
        heavy = []
        for held in b.column(1).to_pylist():
            x = np.sort(np.frombuffer(b"".join(held), np.uint16).reshape(-1, PLACES), axis=0)
            most, best = np.zeros(PLACES, np.uint16), np.full(PLACES, max(2, math.ceil(HEAVY * len(x))) - 1)
            run = np.ones(PLACES, np.int64)
            for i in range(len(x)):
                run = np.where(x[i] == x[i - 1], run + 1, 1) if i else run
                more = (run > best) & (x[i] > 0)
                most[more], best[more] = x[i][more], run[more]
            heavy.append(most.tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(heavy, pa.binary())], ["node", "heavy"])


def _parted(batches):
    """What becomes of members (node, key, sketch, heavy) of large nodes: node, key, and whether this is the node's core or a child."""
    for b in batches:
        for s in (b.slice(at, 4096) for at in range(0, b.num_rows, 4096)):
            x, heavy = (np.frombuffer(b"".join(s.column(c).to_pylist()), np.uint16).reshape(-1, PLACES) for c in (2, 3))
            shared = (x == heavy) & (x > 0)
            share = shared.sum(1) / np.maximum((x > 0).sum(1), 1)
            nodes = np.asarray(s.column(0)).view(np.uint64)
            core, rest = np.flatnonzero(share >= CORE[0]), np.flatnonzero(share <= CORE[1])
            i, child = _children(nodes[rest], np.where(shared, 0, x)[rest])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([nodes[core], child]).view(np.int64)), s.column(1).take(pa.array(np.concatenate([core, rest[i]]))), pa.array(np.arange(len(core) + len(i)) < len(core))], ["node", "key", "core"]
            )


def _rough_edges(distinct: DataFrame, level: float) -> DataFrame:
    """Edges (key, root) that join all texts whose sketches meet in a node: distinct has key, sketch and nodes.

    The root of a core is no text but a name of its node."""
    sketches = distinct.select("key", "sketch")
    members = distinct.select(F.explode("nodes").alias("node"), "key")
    star = F.unhex(F.md5(F.concat(F.lit("core"), F.col("node").cast("string")).cast("binary"))).alias("root")
    small, edges = None, None
    for depth in range(LEVELS):
        sizes = members.groupBy("node").agg(F.count("*").alias("size"), F.sum(F.xxhash64("key") % (1 << 52)).alias("sign")).where("size > 1")
        sizes = common.stored(sizes)
        # Small nodes of one level with the same members need one comparison.
        once = sizes.where(F.col("size") <= SMALL).groupBy("size", "sign").agg(F.min("node").alias("node")).select("node")
        few = members.join(once, "node")
        small = few if small is None else small.unionByName(few)
        large = sizes.where(F.col("size") > SMALL).select("node", "size")
        if large.isEmpty():
            break
        if depth + 1 == LEVELS:
            cores = members.join(large, "node").select("key", star)
        else:
            many = common.stored(members.join(large, "node").join(sketches, "key").select("node", "size", "key", "sketch"))
            probes = many.where(F.pmod(F.xxhash64("key", "node"), "size") < PROBES).groupBy("node").agg(F.collect_list("sketch").alias("sketches"))
            heavy = common.stored(probes.mapInArrow(_heavy, "node long, heavy binary"))
            none = F.lit(bytes(2 * PLACES))
            met = many.join(heavy, "node", "left").select("node", "key", "sketch", F.coalesce("heavy", none))
            parted = common.stored(met.mapInArrow(_parted, "node long, key binary, core boolean"))
            cores, members = parted.where("core").select("key", star), parted.where("not core").select("node", "key")
        edges = cores if edges is None else edges.unionByName(cores)
    small = small.join(sketches, "key").select("node", "key", "sketch").repartition("node").sortWithinPartitions("node")
    found = small.mapInArrow(_small_nodes(level), "key binary, root binary")
    return found if edges is None else found.unionByName(edges)


def _pivots(batches):
    """For each group (comp, list of sets) the shingles that more than half of the sets have."""
    for b in batches:
        pivots = []
        for held in b.column(1).to_pylist():
            token, count = np.unique(np.concatenate([np.frombuffer(s, np.uint64) for s in held]), return_counts=True)
            pivots.append(token[2 * count > len(held)].tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pivots, pa.binary())], ["comp", "pivot"])


def _differences(p: int, q: int):
    """comp, key, copies and, for a set and its pivot in the last two columns, a, the size of the difference and the difference."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, 3):
                a, n, delta = [], [], []
                for s, pivot in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                    tokens = np.frombuffer(s, np.uint64)
                    d = np.setxor1d(tokens, np.frombuffer(pivot or b"", np.uint64), assume_unique=True)
                    a.append((q + p) * len(d) - (q - p) * len(tokens))
                    n.append(len(d))
                    delta.append(d.tobytes())
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(delta, pa.binary())], ["comp", "key", "copies", "a", "n", "delta"])

    return run


def _common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sets share; the diagonal means nothing."""
    n = len(sets)
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    column = np.cumsum(np.concatenate([[True], tokens[1:] != tokens[:-1]])) - 1 if len(tokens) else np.zeros(0, np.int64)
    frequency = np.bincount(column)
    out = np.zeros((n, n), np.float32)
    often = frequency[column] > 32
    rare, rare_column = owner[~often], column[~often]
    for step in range(1, 32):  # holders step places apart in one column
        at = np.flatnonzero(rare_column[step:] == rare_column[:-step])
        if not len(at):
            break
        pairs, times = np.unique(rare[at] * n + rare[at + step], return_counts=True)
        out.ravel()[pairs] += times
    names, column = np.unique(column[often], return_inverse=True)
    owner, step = owner[often], max(1, (1 << 22) // max(n, 1))
    for start in range(0, len(names), step):
        a, z = np.searchsorted(column, [start, start + step])
        m = np.zeros((n, min(step, len(names) - start)), np.float32)
        m[owner[a:z], column[a:z] - start] = 1
        out += m @ m.T
    return np.maximum(np.triu(out, 1), np.tril(out, -1).T)


def _compared(p: int, q: int):
    """Weighted counts and forest edges of the links between two blocks, or in one (the second null), that need a comparison."""

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                blocks = [c[row].values for c in (b.column(0), b.column(1)) if c[row].is_valid]
                keys, copies, a, deltas = ([v for x in blocks for v in x.field(f).to_pylist()] for f in ("key", "copies", "a", "delta"))
                copies, a, n = np.array(copies, np.int64), np.array(a, np.int64), len(keys)
                shared = _common_counts([np.frombuffer(d, np.uint64) for d in deltas]).astype(np.int64)
                score = a[:, None] + a[None]
                linked = np.triu((score > 0) & (score <= 2 * (q + p) * shared), 1)
                if len(blocks) > 1:
                    linked[: len(blocks[0]), : len(blocks[0])] = False
                    linked[len(blocks[0]) :, len(blocks[0]) :] = False
                i, j = np.nonzero(linked)
                count = np.zeros(n, np.int64)
                np.add.at(count, i, copies[j])
                np.add.at(count, j, copies[i])
                root, some = _roots(n, i, j), np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[k] for k in some], pa.binary()), pa.array(count[some]), pa.array([keys[k] for k in root[some]], pa.binary())], ["key", "links", "root"]
                )

    return run


def _exact_links(sets: DataFrame, p: int, q: int) -> DataFrame:
    """Counts of links (to copies of other texts) and edges that join what is linked: key, links, root (null: none).

    sets has comp, size (texts of the group), key, copies and tokens.
    """
    shaping = sets.where(F.pmod(F.xxhash64("key"), "size") < SHAPING).groupBy("comp").agg(F.collect_list("tokens").alias("sets"))
    pivots = shaping.mapInArrow(_pivots, "comp binary, pivot binary")
    met = sets.join(pivots, "comp", "left").select("comp", "key", "copies", "tokens", "pivot")
    members = common.stored(met.mapInArrow(_differences(p, q), "comp binary, key binary, copies long, a long, n long, delta binary"))
    # One row for each group and value of a: how many texts have at most -a, where its members begin in the order of a.
    values = members.groupBy("comp", "a").agg(F.sum("copies").alias("w"), F.sum(F.col("n") * 8 + ROW).alias("bytes"))
    mirrored = values.select("comp", (-F.col("a")).alias("a"), F.lit(0).cast("long").alias("w"), F.lit(0).cast("long").alias("bytes"))
    points = values.unionByName(mirrored).groupBy("comp", "a").agg(F.sum("w").alias("w"), F.sum("bytes").alias("bytes"))
    rising = Window.partitionBy("comp").orderBy("a")
    points = common.stored(points.select("comp", "a", "bytes", F.sum("w").over(rising).alias("upto"), (F.sum("bytes").over(rising) - F.col("bytes")).alias("before")))
    heads = members.groupBy("comp").agg(F.min(F.struct("a", "key")).alias("head"))
    mirror = points.select("comp", (-F.col("a")).alias("a"), F.col("upto").alias("facing"))
    places = points.where("bytes > 0").join(mirror, ["comp", "a"]).join(heads, "comp")
    own = F.when(F.col("a") <= 0, F.col("copies")).otherwise(0)
    head = F.when((F.col("a") + F.col("head.a") <= 0) & (F.col("key") != F.col("head.key")), F.col("head.key"))
    block = F.floor((F.col("before") + F.pmod(F.xxhash64("key"), "bytes")) / BLOCK)
    placed = members.join(places, ["comp", "a"]).select("comp", "key", "copies", "a", "n", "delta", block.alias("block"), (F.col("facing") - own).alias("easy"), head.alias("root"))
    placed = common.stored(placed)
    blocks = common.stored(placed.groupBy("comp", "block").agg(F.count("*").alias("m"), F.min("a").alias("low"), F.max("a").alias("high"), F.max("n").alias("n")))
    l, h = blocks.alias("l"), blocks.alias("h")
    worth = (F.col("l.high") + F.col("h.high") > 0) & (F.col("l.low") + F.col("h.low") <= 2 * (q + p) * F.least("l.n", "h.n"))
    worth &= (F.col("l.block") < F.col("h.block")) | (F.col("l.block") == F.col("h.block")) & (F.col("l.m") > 1)
    pairs = common.stored(l.join(h, "comp").where(worth).select("comp", F.col("l.block").alias("first"), F.when(F.col("l.block") < F.col("h.block"), F.col("h.block")).alias("second")))
    asked = pairs.select("comp", F.col("first").alias("block")).unionByName(pairs.where("second is not null").select("comp", F.col("second").alias("block"))).distinct()
    packed = placed.join(asked, ["comp", "block"]).groupBy("comp", "block").agg(F.collect_list(F.struct("key", "copies", "a", "delta")).alias("members"))
    packed = common.stored(packed)
    one = packed.select("comp", F.col("block").alias("first"), F.col("members").alias("x"))
    other = packed.select("comp", F.col("block").alias("second"), F.col("members").alias("y"))
    hard = pairs.join(one, ["comp", "first"]).join(other, ["comp", "second"], "left").select("x", "y").mapInArrow(_compared(p, q), "key binary, links long, root binary")
    return placed.select("key", F.col("easy").alias("links"), "root").unionByName(hard)


def text_classes(docs: DataFrame, doc_id: str, text: str, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """A row for each distinct text with words: key (its digest), copies, n_links (of each copy), component (a digest), class_id, leads.

    One text of each component leads: it has a row with the class's id, and of such texts the least digest."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be over 0 and at most 1")
    share = Fraction(threshold).limit_denominator(1_000_000)
    runs = runs_for(threshold, recall)
    rows = docs.select(common.col(docs, doc_id).alias("id"), common.col(docs, text).alias("text")).where("text is not null").withColumn("key", common.text_digest(F.col("text")))

    def sample(batches):
        for whole in batches:
            for b in slices(whole, 2):
                sets = [text_set(t, words) for t in common.byte_arrays(b.column(2))]
                some = np.array([len(s) > 0 for s in sets], bool)
                keep = pa.array(some)
                sets = [s for s in sets if len(s)]
                nodes = [_nodes(s, runs).view(np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).filter(keep), b.column(1).filter(keep), pa.array([_sketch(s).tobytes() for s in sets], pa.binary()), pa.array(nodes, pa.list_(pa.int64()))],
                    ["id", "key", "sketch", "nodes"],
                )

    id_type = rows.schema["id"].dataType.simpleString()
    sampled = rows.select("id", "key", "text").mapInArrow(sample, f"id {id_type}, key binary, sketch binary, nodes array<long>")
    distinct = common.stored(sampled.groupBy("key").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.first("sketch").alias("sketch"), F.first("nodes").alias("nodes")))
    edges = common.stored(_rough_edges(distinct, sketch_level(threshold)))
    rough = connected_components(edges, "key", "root").select(F.col("node").alias("key"), F.col("component").alias("comp"))
    # The names of cores have no text and go with this join; size only says how many to sample.
    sized = rough.join(rough.groupBy("comp").agg(F.count("*").alias("size")), "comp").join(distinct.select("key", "copies"), "key")

    def tokens(batches):
        for whole in batches:
            for b in slices(whole, 4):
                sets = [text_set(t, words).tobytes() for t in common.byte_arrays(b.column(4))]
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(sets, pa.binary())], ["comp", "size", "key", "copies", "tokens"])

    once = rows.groupBy("key").agg(F.first("text").alias("text"))
    sets = once.join(sized, "key").select("comp", "size", "key", "copies", "text").mapInArrow(tokens, "comp binary, size long, key binary, copies long, tokens binary")
    links = common.stored(_exact_links(common.stored(sets), share.numerator, share.denominator))
    parts = connected_components(links, "key", "root").withColumnRenamed("node", "key")
    out = distinct.select("key", "copies", "least").join(links.groupBy("key").agg(F.sum("links").alias("links")), "key", "left").join(parts, "key", "left")
    out = out.withColumn("component", F.coalesce("component", "key"))
    first = F.min_by("key", F.struct(F.col("least").isNull(), "least", "key"))
    heads = out.groupBy("component").agg(F.min("least").alias("class_id"), first.alias("first"))
    n_links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    return common.stored(out.join(heads, "component").select("key", "copies", n_links, "component", "class_id", (F.col("key") == F.col("first")).alias("leads")))


def similarity_join(docs: DataFrame, doc_id: str, text: str, **options) -> DataFrame:
    """One row for each input row: its id under the input's name, class_id and n_links (other rows linked with it)."""
    classes = text_classes(docs, doc_id, text, **options)
    name_class, name_links = common.free_names(docs.select(common.col(docs, doc_id)), "class_id", "n_links")
    rows = docs.select(common.col(docs, doc_id), common.text_digest(common.col(docs, text)).alias("key"))
    joined = rows.join(classes.select("key", "n_links", F.col("class_id").alias("head")), "key", "left")
    own = common.col(docs, doc_id)
    return joined.select(own, F.when(F.col("n_links").isNull(), own).otherwise(F.col("head")).alias(name_class), F.coalesce("n_links", F.lit(0)).cast("long").alias(name_links))


def keep_one_per_class(docs: DataFrame, doc_id: str, text: str, **options) -> DataFrame:
    """The input's rows with one of each class: a row with the class's id, of the least text digest. Texts without words all stay."""
    classes = text_classes(docs, doc_id, text, **options)
    key, component, head, copies = common.free_names(docs, "text_key", "component", "class_id", "copies")
    marked = docs.withColumn(key, common.text_digest(common.col(docs, text)))
    told = classes.select(F.col("key").alias(key), F.col("component").alias(component), F.when(F.col("leads"), F.col("class_id")).alias(head), F.when(F.col("leads"), F.col("copies")).otherwise(0).alias(copies))
    led = (F.col(copies) > 0) & common.col(docs, doc_id).eqNullSafe(F.col(head))
    joined = marked.join(told, key, "left").where(F.col(copies).isNull() | led)
    # One text of each class is left, so only its copies can hold the class's id twice.
    alone = F.coalesce(F.col(copies), F.lit(1)) == 1
    return joined.where(alone).unionByName(joined.where(~alone).dropDuplicates([component])).select(*[common.col(docs, c) for c in docs.columns])
