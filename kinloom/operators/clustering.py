"""Highly connected clusters of each component of a family graph, placement of sequences by shared words, and verified clusters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.operators.graph import materialised, unsent

#: Nodes of a component from which it is not cut, and placements of a sequence.
LARGEST, HITS = 1000, 10


def minimum_cut(nodes: list[str], edges: set[tuple[str, str]]) -> tuple[int, set[str]]:
    """The number of edges of a least cut and one of its sides, by maximum-adjacency orders; ties follow the order of nodes."""
    at = {n: i for i, n in enumerate(nodes)}
    weight = np.zeros((len(nodes), len(nodes)), np.int64)
    for a, b in edges:
        weight[at[a], at[b]] = weight[at[b], at[a]] = 1
    alive, held = np.ones(len(nodes), bool), [{n} for n in nodes]
    best, side = len(edges) + 1, set(nodes[:1])
    while alive.sum() > 1:
        rest, tied = alive.copy(), np.zeros(len(nodes), np.int64)
        last = before = tie = 0
        for _ in range(int(alive.sum())):
            before, last = last, int(np.where(rest, tied, -1).argmax())
            tie, rest[last] = int(tied[last]), False
            tied += weight[last]
        if tie < best:
            best, side = tie, set(held[last])
        held[before] |= held[last]
        weight[before] += weight[last]
        weight[:, before] = weight[before]
        weight[before, before], weight[last], weight[:, last], alive[last] = 0, 0, 0, False
    return best, side


def _connected(nodes: set[str], edges: set[tuple[str, str]]) -> list[set[str]]:
    near: dict[str, set[str]] = {n: set() for n in nodes}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out, seen = [], set()
    for n in sorted(nodes):
        if n not in seen:
            part, stack = set(), [n]
            while stack:
                x = stack.pop()
                if x not in part:
                    part.add(x)
                    stack += near[x] - part
            seen |= part
            out.append(part)
    return out


def highly_connected(nodes: set[str], edges: set[tuple[str, str]]) -> list[set[str]]:
    """Parts of several nodes whose least cut has at least half as many edges as the part has nodes."""
    out, todo = [], _connected(nodes, edges)
    while todo:
        part = todo.pop()
        if len(part) < 2:
            continue
        own = {(a, b) for a, b in edges if a in part and b in part}
        cut, side = minimum_cut(sorted(part), own)
        if cut >= len(part) / 2:
            out.append(part)
        else:
            for half in (side, part - side):
                todo += _connected(half, {(a, b) for a, b in own if a in half and b in half})
    return out


def connected_clusters(edges: DataFrame, components: DataFrame, largest: int = LARGEST) -> DataFrame:
    """Clusters of each component with fewer than largest nodes: node, cluster (its least node).  Larger components give none, so a
    group holds fewer than largest nodes and their edges."""
    sizes = components.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") < largest)
    inside = components.join(sizes.select("component"), "component").select(F.col("node").alias("family_a"), "component")
    put = edges.where("family_a <> family_b").join(inside, "family_a").select("component", F.col("family_a").cast("string").alias("a"), F.col("family_b").cast("string").alias("b"))

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        pairs = {(min(a, b), max(a, b)) for a, b in zip(rows["a"], rows["b"], strict=True)}
        parts = highly_connected({n for p in pairs for n in p}, pairs)
        found = [(n, min(p)) for p in parts for n in sorted(p)]
        return pd.DataFrame(found, columns=["node", "cluster"])

    return put.groupBy("component").applyInPandas(cut, "node string, cluster string")


def word_placements(sequences: DataFrame, references: DataFrame, seq_id: str, ref_id: str, text: str, size: int = 5, most: int = HITS) -> DataFrame:
    """The references that share most distinct runs of size words with each sequence, up to most of them: seq_id, ref_id, shared, hit_rank.

    hit_rank runs from 1, the most shared runs; ties go to the smaller id.
    """

    def grams(df: DataFrame, id_: str) -> DataFrame:
        # The generator keeps the words of a text as a value; else each run would split the text anew.
        held = df.select(id_, F.explode(F.array(F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))).alias("words"))
        words = F.col("words")
        runs = F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, size), " ")))
        return held.select(id_, F.explode(F.array_distinct(runs)).alias("gram"))

    met = grams(sequences, seq_id).join(grams(references, ref_id), "gram").groupBy(seq_id, ref_id).agg(F.count("*").alias("shared"))
    rank = F.row_number().over(Window.partitionBy(seq_id).orderBy(F.desc("shared"), ref_id))
    return met.withColumn("hit_rank", rank).where(F.col("hit_rank") <= most)


def word_clusters(sequences: DataFrame, seq_id: str, text: str, size: int = 5, least: int = 1) -> DataFrame:
    """Clusters of sequences linked by least or more shared runs of size words: seq_id, cluster (its least id), two members or more.

    A run's holders are linked to the least of them and not to each other where one shared run is enough; else to each other.
    """
    from kinloom.operators.graph import connected_components

    held = sequences.select(seq_id, F.explode(F.array(F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))).alias("words"))
    words = F.col("words")
    runs = F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, size), " ")))
    if least <= 1:
        # Runs by 128-bit digests, shuffled once for both sides of the join; explode() would make all runs twice, to ask for any.
        digests = F.array_distinct(F.transform(runs, lambda x: F.md5(x)))  # texts: bytes would be compared pair by pair
        grams = held.select(seq_id, F.explode_outer(digests).alias("gram")).select(seq_id, F.unhex("gram").alias("gram")).where("gram is not null").repartition("gram")
        roots = grams.groupBy("gram").agg(F.min(seq_id).alias("root"))
        links = grams.join(unsent(roots), "gram").select(F.col(seq_id).alias("u"), F.col("root").alias("v")).where("u <> v").distinct()
    else:
        grams = held.select(seq_id, F.explode(F.array_distinct(runs)).alias("gram")).distinct()
        met = grams.alias("a").join(grams.alias("b"), (F.col("a.gram") == F.col("b.gram")) & (F.col(f"a.{seq_id}") < F.col(f"b.{seq_id}")))
        links = met.groupBy(F.col(f"a.{seq_id}").alias("u"), F.col(f"b.{seq_id}").alias("v")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return connected_components(links, "u", "v").select(F.col("node").alias(seq_id), F.col("component").alias("cluster"))


def verified_links(sequences: DataFrame, seq_id: str, sequence: str, size: int = 8, words: int = 20, identity: float = 0.5, order: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Links from sequences to longer ones that they are like: member, centre, size (of the centre).

    Each sequence takes part with the words least by order of its distinct runs of size letters; those that share such a word are compared
    with the longest one among them (the least id on ties), not with each other, so a word held by very many gives as many candidates.
    A candidate is a link if the edits between the two are at most 1 - identity of the longer one's length, by a banded program
    that stops beyond that; so unlike sequences, and those that cover too little, do not link.
    """
    text = F.col(sequence)
    runs = F.when(F.length(text) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: order(F.substring(text, i, F.lit(size)))))).otherwise(F.array(order(text)))
    # Sequences are dealt first, as a file of many may be one task; both sides of the join below are the same shuffle.
    dealt = sequences.where(F.col(sequence).isNotNull()).select(seq_id, sequence).repartition(seq_id)
    held = dealt.select(seq_id, F.length(text).alias("n"), F.slice(F.array_sort(runs), 1, words).alias("least"))
    # No sequence is without words; explode() would ask for that before the shuffle, by making the words of a whole file there.
    each = held.select(seq_id, "n", F.explode_outer("least").alias("word")).repartition("word")
    longest = each.groupBy("word").agg(F.max_by(F.struct(F.col(seq_id).alias("centre"), F.col("n").alias("size")), F.struct("n", (-F.col(seq_id)).alias("i"))).alias("c"))
    pairs = each.join(unsent(longest), "word").select(F.col(seq_id).alias("member"), "c.centre", "c.size").where("member <> centre").distinct()
    texts = sequences.select(F.col(seq_id).alias("member"), text.alias("a"))
    met = pairs.join(unsent(texts), "member").join(unsent(texts.select(F.col("member").alias("centre"), F.col("a").alias("b"))), "centre")
    most = F.floor(F.lit(1 - identity) * F.col("size") + F.lit(1e-9))
    # The difference of lengths is a bound that needs no program.
    near = met.where(F.col("size") - F.length("a") <= most).where(F.levenshtein("a", "b") <= most)
    return near.select("member", "centre", "size")


def verified_clusters(
    sequences: DataFrame, seq_id: str, sequence: str, size: int = 8, words: int = 20, identity: float = 0.5, order: Callable[[Column], Column] = F.xxhash64, species: str | None = None
) -> DataFrame:
    """Clusters of sequences around the longest ones: seq_id, cluster (the id of its centre), two members or more.

    Sequences are taken from the longest (the least id on ties): one that is linked to an earlier centre joins the longest such
    centre, any other is a centre.  All that can be told are told at once; a round takes those whose links all lead to
    sequences already told.  So every member is like its centre; what is linked to a member only is not in the cluster.  With
    species (a column), clusters of one species are left out.
    """
    links = materialised(verified_links(sequences, seq_id, sequence, size, words, identity, order))
    told = materialised(links.select(F.col("centre").alias("node")).distinct().join(unsent(links.select(F.col("member").alias("node"))), "node", "left_anti").withColumn("head", F.col("node")))
    while True:
        known = told.select(F.col("node").alias("centre"), (F.col("head") == F.col("node")).alias("is_head"))
        open_ = links.join(unsent(told.select(F.col("node").alias("member"))), "member", "left_anti").join(unsent(known), "centre", "left")
        if open_.isEmpty():
            break
        joined = F.max_by("centre", F.when(F.col("is_head"), F.struct("size", (-F.col("centre")).alias("i"))))
        # A member of a head that is longer than all that is not yet told can be told too.
        unknown = F.max(F.when(F.col("is_head").isNull(), F.struct("size", (-F.col("centre")).alias("i"))))
        best = F.max(F.when(F.col("is_head"), F.struct("size", (-F.col("centre")).alias("i"))))
        state = open_.groupBy(F.col("member").alias("node")).agg(joined.alias("head"), unknown.alias("u"), best.alias("b"))
        now = state.where("u is null or b is not null and b > u").select("node", F.coalesce("head", "node").alias("head"))
        told = materialised(told.unionByName(now))
    sizes = told.groupBy("head").agg(F.count("*").alias("n")).where("n > 1")
    out = told.join(unsent(sizes), "head", "left_semi").select(F.col("node").alias(seq_id), F.col("head").alias("cluster"))
    if species is None:
        return out
    kinds = out.join(unsent(sequences.select(seq_id, F.col(species).alias("_s"))), seq_id).groupBy("cluster").agg(F.count_distinct("_s").alias("k")).where("k > 1")
    return out.join(unsent(kinds), "cluster", "left_semi").select(seq_id, "cluster")
