"""Family assignment from ranked placements: first hits, sizes, co-occurring families, singleton rescue and size filters.

A placement table ("hits") has a row for each protein and hit: an item (protein), a rank from 1, a family and a score.  The best
hit is the one with rank 1, never the one with the best score.  Columns are named by the caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.operators.graph import connected_components, materialised, unsent

#: Scores for rescue (kept from), pairs (above) and big families (above); shared proteins (above); ratios (above).
RESCUE_SCORE, PAIR_SCORE, BIG_SCORE, LEAST_SHARED, RATIO_MAX, RATIO_MIN, BIG_FAMILY = 70.0, 70.0, 95.0, 10, 0.8, 0.9, 50_000
#: Pairs of groups that one task counts, and groups of one item in one task.
TASK_PAIRS, TASK_GROUPS = 1 << 21, 1000


def first_hits(hits: DataFrame, rank: str = "hit_rank") -> DataFrame:
    """The placement that decides a protein's family; ranks are stored at ingest, so this is a filter, not a window."""
    return hits.where(F.col(rank) == 1)


def family_members(hits: DataFrame, item: str, family: str, species: str, rank: str = "hit_rank") -> DataFrame:
    """Families by first hit: family, n_members, n_species.  Partial aggregation runs before the shuffle."""
    return first_hits(hits, rank).groupBy(family).agg(F.count("*").alias("n_members"), F.count_distinct(species).alias("n_species"))


def completeness(members: DataFrame, n_leaves: DataFrame) -> DataFrame:
    """Adds the share of a clade's species that a family covers, to 4 digits; n_leaves has one row."""
    return members.crossJoin(F.broadcast(n_leaves)).withColumn("completeness", F.round(F.col("n_species") / F.col("n_leaves"), 4)).drop("n_leaves")


def hit_family_sizes(hits: DataFrame, family: str, score: str, above: float = PAIR_SCORE) -> DataFrame:
    """Rows above the score for each family, over all hits: a protein that hits a family twice counts twice."""
    return hits.where(F.col(score) > above).groupBy(family).agg(F.count("*").alias("n_hits"))


def candidate_pairs(hits: DataFrame, item: str, family: str, score: str, rank: str = "hit_rank", above: float = PAIR_SCORE) -> DataFrame:
    """How many times two families are hit by one protein: family_a <= family_b, shared.

    Only families that are some protein's first hit take part.  A family that a protein hits twice pairs with itself.
    """
    known = first_hits(hits, rank).select(family).distinct()
    good = hits.where(F.col(score) > above).join(known, family, "left_semi")
    # A protein has few hits, so its pairs are made in the row that holds them all.  Which of its hits a pair is of does not show.
    each = good.groupBy(item).agg(F.sort_array(F.collect_list(family)).alias("h")).where(F.size("h") > 1)
    pair = lambda x, y: F.struct(x.alias("family_a"), y.alias("family_b"))
    pairs = F.flatten(F.transform("h", lambda x, i: F.transform(F.slice("h", i + 2, F.size("h")), lambda y: pair(x, y))))
    return each.select(F.explode(pairs).alias("p")).groupBy("p.family_a", "p.family_b").agg(F.count("*").alias("shared"))


def merge_edges(pairs: DataFrame, sizes: DataFrame, family: str, shared: int = LEAST_SHARED, ratio_max: float = RATIO_MAX, ratio_min: float = RATIO_MIN, big: int = BIG_FAMILY) -> DataFrame:
    """Pairs that may merge: enough shared, a high share of the larger or of the smaller family, both below a sixth of big."""
    a = sizes.select(F.col(family).alias("family_a"), F.col("n_hits").alias("size_a"))
    b = sizes.select(F.col(family).alias("family_b"), F.col("n_hits").alias("size_b"))
    met = pairs.where(F.col("shared") > shared).join(a, "family_a").join(b, "family_b")
    large, small = F.greatest("size_a", "size_b"), F.least("size_a", "size_b")
    good = (F.col("shared") / large > ratio_max) | (F.col("shared") / small > ratio_min)
    return met.where((large < big / 6) & good).select("family_a", "family_b", "shared", "size_a", "size_b")


def family_components(edges: DataFrame) -> DataFrame:
    """Connected families: node, component (the least family)."""
    return connected_components(edges, "family_a", "family_b")


def rescue_singletons(hits: DataFrame, item: str, family: str, score: str, rank: str = "hit_rank", from_: float = RESCUE_SCORE) -> DataFrame:
    """Moves of proteins alone in their family to the first alternative whose family has several members: item, family, new_family.

    A move needs a target with several first hits, so moves do not depend on each other's order.
    """
    firsts = first_hits(hits, rank).select(item, family)
    sizes = firsts.groupBy(family).agg(F.count("*").alias("n"))
    single = firsts.join(sizes.where("n = 1"), family).select(item, F.col(family).alias("own"))
    several = sizes.where("n > 1").select(family)
    other = hits.where((F.col(rank) >= 2) & (F.col(score) >= from_)).join(several, family, "left_semi").select(item, family, rank)
    moved = single.join(other, item).groupBy(item, "own").agg(F.min_by(family, rank).alias("new_family"))
    return moved.withColumnRenamed("own", family)


def cluster_singletons(hits: DataFrame, item: str, family: str, score: str, rank: str = "hit_rank", from_: float = RESCUE_SCORE) -> DataFrame:
    """Singletons left over that share an alternative family: item, family, cluster (the least own family of the group).

    Links run only through alternatives, as components of the graph of proteins and alternatives; groups of one are left out.
    """
    firsts = first_hits(hits, rank).select(item, family)
    alone = firsts.groupBy(family).agg(F.count("*").alias("n"), F.min(item).alias(item)).where("n = 1").select(item, family)
    moved = rescue_singletons(hits, item, family, score, rank, from_).select(item)
    left = materialised(alone.join(moved, item, "left_anti"))
    other = hits.where((F.col(rank) >= 2) & (F.col(score) >= from_)).select(item, F.col(family).alias("alt"))
    links = left.join(other, item).select(F.concat(F.lit("p"), F.col(item).cast("string")).alias("u"), F.concat(F.lit("f"), F.col("alt").cast("string")).alias("v"))
    parts = connected_components(links, "u", "v")
    told = left.withColumn("node", F.concat(F.lit("p"), F.col(item).cast("string"))).join(parts, "node")
    heads = told.groupBy("component").agg(F.min(family).alias("cluster"), F.count("*").alias("n")).where("n > 1")
    return told.join(heads.select("component", "cluster"), "component").select(item, family, "cluster")


def big_family_filter(hits: DataFrame, family: str, score: str, rank: str = "hit_rank", big: int = BIG_FAMILY, above: float = BIG_SCORE) -> DataFrame:
    """First hits without the weak ones of families with more than big members.

    Sizes are an aggregate joined back, not a window: a huge family is never gathered in one task.
    """
    firsts = first_hits(hits, rank)
    large = firsts.groupBy(family).agg(F.count("*").alias("n")).where(F.col("n") > big).select(family, F.lit(True).alias("is_big"))
    return firsts.join(large, family, "left").where(F.col("is_big").isNull() | (F.col(score) > above)).drop("is_big")


def capped_merge(members: DataFrame, clusters: DataFrame, family: str, cap: int = BIG_FAMILY) -> DataFrame:
    """Merges the families of a cluster into its least one while the total before adding is below cap: family, host.

    clusters: node, component.  Families are taken in order; those beyond the cap keep their own name.  The window runs over
    a row for each family, not for each member.
    """
    sizes = members.groupBy(family).agg(F.count("*").alias("n"))
    put = sizes.join(clusters.withColumnRenamed("node", family), family)
    order = Window.partitionBy("component").orderBy(family).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(order), F.lit(0))
    return put.withColumn("before", before).select(family, F.when(F.col("before") < cap, F.col("component")).otherwise(F.col(family)).alias("host"))


def merged_members(members: DataFrame, hosts: DataFrame, family: str, item: str) -> DataFrame:
    """Members under the hosts of their families, each once: host, item, is_new (whether none of the host's own families had it).

    hosts: family, host, as capped_merge gives them.  Families without a host keep their name; rows without an item or a family go.
    """
    told = members.where(F.col(item).isNotNull() & F.col(family).isNotNull()).join(hosts.select(family, "host"), family, "left")
    put = told.select(F.coalesce("host", family).alias("host"), item, (F.col(family) == F.coalesce("host", family)).alias("own"))
    return put.groupBy("host", item).agg((~F.bool_or("own")).alias("is_new"))


def best_per_item_then_target(hits: DataFrame, item: str, target: str, score: str, tie: str) -> DataFrame:
    """The lowest-scored hit of each item, then of each target among these."""
    one = hits.groupBy(item).agg(F.min_by(F.struct(target, score, tie), F.struct(score, tie)).alias("h")).select(item, "h.*")
    return one.groupBy(target).agg(F.min_by(F.struct(item, score), F.struct(score, item)).alias("h")).select(target, "h.*")


def ancestor_pairs(placed: DataFrame, item: str, species: str, path: str) -> DataFrame:
    """Pairs of an item and one placed at its own group or an ancestor's, in another species; path has groups root first."""
    above = placed.select(F.col(item).alias("item_a"), F.col(species).alias("species_a"), F.explode(path).alias("group"))
    own = placed.select(F.col(item).alias("item_b"), F.col(species).alias("species_b"), F.element_at(path, -1).alias("group"))
    return above.join(own, "group").where("species_a <> species_b").select("item_a", "item_b", "group").distinct()


def known_hits(hits: DataFrame, proteins: DataFrame, item: str) -> DataFrame:
    """Hits of proteins that passed the checks."""
    return hits.join(proteins.select(item).distinct(), item, "left_semi")


def with_sequences(members: DataFrame, proteins: DataFrame, keys: list[str], least: int = 1, family: str | None = None) -> DataFrame:
    """Members of families with the columns of their proteins, families of fewer than least such members left out."""
    met = members.join(proteins, keys)
    if family is None or least < 2:
        return met
    return met.join(met.groupBy(family).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(family), family, "left_semi")


def gene_id_mapping(isoforms: DataFrame, chosen: DataFrame, ids: DataFrame, gene: str, protein: str) -> DataFrame:
    """Each isoform with the one that stands for its gene and that one's numeric id: protein, main, numeric_id."""
    main = chosen.select(gene, F.col(protein).alias("main"))
    number = ids.select(F.col(protein).alias("main"), "numeric_id")
    return isoforms.select(gene, protein).join(main, gene, "left").join(number, "main", "left").select(protein, "main", "numeric_id")


def minor_isoforms(isoforms: DataFrame, chosen: DataFrame, gene: str, protein: str) -> DataFrame:
    """The chosen isoform of each gene with the others in order, comma between: gene, protein, minor ("" for none)."""
    rest = isoforms.select(gene, protein).join(chosen.select(gene, F.col(protein).alias("main")), gene).where(F.col(protein) != F.col("main"))
    lists = rest.groupBy(gene).agg(F.array_join(F.transform(F.sort_array(F.collect_set(protein)), lambda x: x.cast("string")), ",").alias("minor"))
    return chosen.select(gene, protein).join(lists, gene, "left").withColumn("minor", F.coalesce("minor", F.lit("")))


def singleton_counts(members: DataFrame, n_members: str) -> DataFrame:
    """One row: n_families, n_single, n_several, and the members of the latter."""
    single = F.col(n_members) == 1
    return members.agg(F.count("*").alias("n_families"), F.count_if(single).alias("n_single"), F.count_if(~single).alias("n_several"), F.coalesce(F.sum(F.when(~single, F.col(n_members))), F.lit(0)).alias("n_in_several"))


def overlapping_groups(members: DataFrame, group: str, item: str, pairs: int = TASK_PAIRS, most: int = TASK_GROUPS) -> DataFrame:
    """Pairs of groups that share items: group_a < group_b, shared.  Disjoint groups give no row.

    Items are dealt to as many tasks as hold about pairs each; the groups of an item with more than most are dealt too.
    """
    one = members.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(F.col(group).alias("g"), F.col(item).alias("i")).distinct()
    held = materialised(one.join(unsent(one.groupBy("i").agg(F.count("*").alias("n")).where("n > 1")), "i"))
    total = held.agg(F.sum((F.col("n") - 1) / 2)).first()[0] or 0
    tasks = max(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total // pairs) + 1)
    parts = F.ceil(F.col("n") / most).cast("int")
    a = held.select("i", F.col("g").alias("group_a"), F.pmod(F.xxhash64("g"), parts).cast("int").alias("part")).repartition(tasks, "i", "part")
    b = held.select("i", F.col("g").alias("group_b"), F.explode_outer(F.sequence(F.lit(0), parts - 1)).alias("part")).repartition(tasks, "i", "part")
    return a.join(unsent(b), ["i", "part"]).where("group_a < group_b").groupBy("group_a", "group_b").agg(F.count("*").alias("shared"))


def first_occurrences(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The distinct values of a key by their first place: key, first."""
    return rows.groupBy(key).agg(F.min(order).alias("first"))


def partition_distances(distances: DataFrame, parts: DataFrame, a: str, b: str, item: str, part: str, distance: str) -> DataFrame:
    """Distances between and within parts: part_a <= part_b, n, mean."""
    left, right = (parts.select(F.col(item).alias(side), F.col(part).alias(f"_{side}")) for side in (a, b))
    met = distances.join(left, a).join(right, b)
    return met.groupBy(F.least(f"_{a}", f"_{b}").alias("part_a"), F.greatest(f"_{a}", f"_{b}").alias("part_b")).agg(F.count("*").alias("n"), F.round(F.avg(distance), 6).alias("mean"))
