"""Ancestral groups at every taxon of the species tree, what happens to them on its edges, and histories over chains of levels.

Nested groups name only the taxa where lineages meet.  A speciation group of taxon L inside one of taxon U also stood in every taxon
between, as one gene of that ancestor; a duplication between them happened below U, so its copies stand apart in these taxa; a
gene stands in all taxa from its species up to below the group that holds it.  ancestral_groups completes the taxa by a join on the
paths of the species tree, and links each ancestral group to the one that it comes from at the taxon above.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.operators.graph import materialised


def ancestral_groups(groups: DataFrame, genes: DataFrame, up: DataFrame) -> DataFrame:
    """Groups at each taxon: level, group, parent_level, parent_group (null where the group begins); stored.

    groups: node, parent, kind (S or D), level (of S).  genes: node, gene, species.  up: the closure of the species tree (node, ancestor,
    distance).  A gene is a group of its own at its species, under its own name.
    """
    none = F.lit(None).cast("string")
    every = groups.select("node", "parent", "kind", "level").unionByName(genes.select(F.col("gene").cast("string").alias("node"), F.col("node").alias("parent"), F.lit("S").alias("kind"), F.col("species").alias("level")))
    # The speciation group around each one: a duplication stands for the one around itself.
    kinds = groups.where("kind = 'D'").select(F.col("node").alias("parent"), F.col("parent").alias("over"))
    now = materialised(every.where("kind = 'S'").select("node", "parent", "level"))
    while True:
        lifted = now.join(kinds, "parent", "left")
        if lifted.where("over is not null").isEmpty():
            break
        now = materialised(lifted.select("node", F.coalesce("over", "parent").alias("parent"), "level"))
    outer = groups.where("kind = 'S'").select(F.col("node").alias("parent"), F.col("level").alias("outer"))
    held = now.join(outer, "parent", "left").select("node", F.when(F.col("outer").isNotNull(), F.col("parent")).alias("parent"), "level", "outer")
    steps = up.select(F.col("node").alias("level"), F.col("ancestor").alias("at"), "distance")
    far = up.select(F.col("node").alias("level"), F.col("ancestor").alias("outer"), F.col("distance").alias("end"))
    above = up.where("distance = 1").select(F.col("node").alias("at"), F.col("ancestor").alias("over"))
    each = held.join(far, ["level", "outer"], "left").join(steps, "level").where("distance < coalesce(end, 1)").join(above, "at", "left")
    last = F.col("distance") + 1 == F.col("end")
    return materialised(each.select(
        F.col("at").alias("level"), F.col("node").alias("group"), F.when(F.col("end").isNotNull(), F.col("over")).alias("parent_level"), F.when(F.col("end").isNull(), none).when(last, F.col("parent")).otherwise(F.col("node")).alias("parent_group"),
    ))


def memberships(ancestral: DataFrame, below: DataFrame) -> DataFrame:
    """Genes of the groups at each taxon: level, group, gene.  below: group, gene, genes with themselves included."""
    return ancestral.select("level", "group").join(below, "group")


def genome_sizes(ancestral: DataFrame) -> DataFrame:
    """Ancestral genes of each taxon: level, n_groups."""
    return ancestral.groupBy("level").agg(F.count("*").alias("n_groups"))


def taxon_events(ancestral: DataFrame, tree: DataFrame) -> DataFrame:
    """What becomes of the ancestral groups on each edge of the species tree: node, parent, retained, duplicated, copies, lost, gained.

    copies are what the duplicated ones become, so a taxon has retained + copies + gained groups, and its parent
    retained + duplicated + lost.
    """
    edges = tree.where("parent is not null").select("node", "parent")
    kids = ancestral.where("parent_group is not null").groupBy(F.col("level").alias("node"), "parent_group").agg(F.count("*").alias("k"))
    kept = kids.groupBy("node").agg(F.count_if(F.col("k") == 1).alias("retained"), F.count_if(F.col("k") > 1).alias("duplicated"), F.sum(F.when(F.col("k") > 1, F.col("k"))).alias("copies"))
    fresh = ancestral.where("parent_group is null").groupBy(F.col("level").alias("node")).agg(F.count("*").alias("gained"))
    out = edges.join(kept, "node", "left").join(fresh, "node", "left").join(genome_sizes(ancestral).withColumnRenamed("level", "parent"), "parent", "left")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("retained", "duplicated", "copies", "gained")}
    lost = F.coalesce("n_groups", F.lit(0)) - counts["retained"] - counts["duplicated"]
    return out.select("node", "parent", counts["retained"].alias("retained"), counts["duplicated"].alias("duplicated"), counts["copies"].alias("copies"), lost.alias("lost"), counts["gained"].alias("gained"))


def lateral(ancestral: DataFrame, one: str, other: str, top: str, up: DataFrame) -> DataFrame:
    """Groups of a taxon above two others by how many groups each of the two has of it: group, n_one, n_other."""

    def under(level: str, name: str) -> DataFrame:
        now = ancestral.where(F.col("level") == level).select("group", "parent_level", "parent_group")
        for _ in range(int(up.where((F.col("node") == level) & (F.col("ancestor") == top)).first()["distance"]) - 1):
            above = ancestral.select(F.col("level").alias("parent_level"), F.col("group").alias("parent_group"), F.col("parent_level").alias("l"), F.col("parent_group").alias("g"))
            now = now.join(above, ["parent_level", "parent_group"]).select("group", F.col("l").alias("parent_level"), F.col("g").alias("parent_group"))
        return now.where("parent_group is not null").groupBy(F.col("parent_group").alias("group")).agg(F.count("*").alias(name))

    met = ancestral.where(F.col("level") == top).select("group").join(under(one, "n_one"), "group", "left").join(under(other, "n_other"), "group", "left")
    return met.select("group", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_one", "n_other")])


def level_histories(levels: list[DataFrame]) -> DataFrame:
    """What becomes of groups over a chain of levels, the most general first; each level has group, gene.

    A row for each lineage: start_level (place in the chain, from 0), start_group, end_level, end_group (null: lost) and history, a word
    for each step: at its start "present" at the first level, else "singleton" (one gene) or "novel"; then "identical" where a group has one
    group below it that shares a gene, "duplicated" where it has several (each goes on as a lineage of its own), "lost" where none.
    """
    kept = [materialised(df.select("group", "gene").distinct()) for df in levels]
    done, now = [], None
    for at, level in enumerate(kept):
        sizes = level.groupBy("group").agg(F.count("*").alias("size"))
        if now is None:
            now = sizes.select(F.lit(at).alias("start_level"), F.col("group").alias("start_group"), "group", F.array(F.lit("present")).alias("words"))
            continue
        links = kept[at - 1].select(F.col("group").alias("upper"), "gene").join(level, "gene").select("upper", "group").distinct()
        links = materialised(links.join(links.groupBy("upper").agg(F.count("*").alias("k")), "upper"))
        word = F.when(F.col("k") == 1, "identical").when(F.col("k") > 1, "duplicated").otherwise("lost")
        moved = now.withColumnRenamed("group", "upper").join(links, "upper", "left").select("start_level", "start_group", "group", F.concat("words", F.array(word)).alias("words"))
        moved = materialised(moved)
        done.append(moved.where("`group` is null").withColumn("end_level", F.lit(at)))
        fresh = sizes.join(links.select("group").distinct(), "group", "left_anti")
        begin = F.when(F.col("size") == 1, "singleton").otherwise("novel")
        fresh = fresh.select(F.lit(at).alias("start_level"), F.col("group").alias("start_group"), "group", F.array(begin).alias("words"))
        now = moved.where("`group` is not null").unionByName(fresh)
    if now is None:
        raise ValueError("a chain has one level at least")
    done.append(now.withColumn("end_level", F.lit(len(kept) - 1)))
    out = reduce(DataFrame.unionByName, done)
    return out.select("start_level", "start_group", "end_level", F.col("group").alias("end_group"), F.array_join("words", " ").alias("history"))
