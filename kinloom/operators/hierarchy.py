"""Trees as tables: closures, common ancestors, and the nested groups below a family.

A tree has a row for each node: node, parent (null at a root).  Groups add fam, kind (S speciation, D duplication) and ord, the order
among siblings.  Loops run over the levels of a tree, never over its nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions.ids import letters
from kinloom.operators.graph import discard, materialised
from kinloom.operators.proteins import numbered


def paths(tree: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """The nodes from the root down to each one, itself last: node, path; stored.

    By doubling: each round puts the path of the node at the front before it, so there are as many rounds as the depth has binary digits.
    A parent that is no node itself stands at the front of a path.  A cycle is an error.
    """
    rows = tree.select(F.col(node).alias("node"), F.col(parent).alias("up"))
    known = rows.select(F.col("node").alias("up"), F.lit(True).alias("inner")).distinct()
    first = rows.join(known, "up", "left").withColumn("inner", F.coalesce("inner", F.lit(False)))
    own = F.when(F.col("up").isNotNull() & ~F.col("inner"), F.array("up", "node")).otherwise(F.array("node"))
    now = materialised(first.select("node", F.when(F.col("inner"), F.col("up")).alias("up"), own.alias("path")))
    left = now.where("up is not null")
    for _ in range(now.count().bit_length() + 1):
        if left.isEmpty():
            return now.select("node", "path")
        above = now.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("path").alias("before"))
        before, now = now, materialised(now.where("up is null").unionByName(left.join(above, "up").select("node", F.col("up2").alias("up"), F.concat("before", "path").alias("path"))))
        discard(before)
        left = now.where("up is not null")
    raise ValueError("the tree has a cycle")


def closure(tree: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """Each node with itself and its ancestors: node, ancestor, distance.  A cycle is an error."""
    each = paths(tree, node, parent).select("node", F.size("path").alias("n"), F.posexplode("path").alias("at", "ancestor"))
    return each.select("node", "ancestor", (F.col("n") - 1 - F.col("at")).alias("distance"))


def with_depth(tree: DataFrame, up: DataFrame) -> DataFrame:
    """Adds depth, 0 at a root."""
    return tree.join(up.groupBy("node").agg(F.max("distance").alias("depth")), "node")


def leaf_counts(tree: DataFrame, up: DataFrame) -> DataFrame:
    """Leaves below each node: node, n_leaves."""
    leaves = tree.select("node").join(tree.select(F.col("parent").alias("node")), "node", "left_anti")
    return leaves.join(up, "node").groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("n_leaves"))


def common_ancestor(members: DataFrame, group: str, leaf: str, up: DataFrame) -> DataFrame:
    """The deepest node above all leaves of each group: group, mrca.

    Nodes are numbered in the order of their paths from the root, so what is above the first and the last leaf of a group is above
    all between: a group is two numbers, and its leaves are not shuffled with their ancestors.  mrca is null for leaves of several trees.
    """
    steps = F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), "ancestor")))
    paths = up.groupBy("node").agg(F.transform(steps, lambda x: x["ancestor"]).alias("path"))
    order = materialised(numbered(paths, "path").select("node", F.col("number").alias("k")))
    one = members.select(F.col(group).alias("g"), F.col(leaf).alias("node")).join(order, "node")
    ends = one.groupBy("g").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    numbers = order.join(up, "node").select("k", "ancestor", "distance")
    # As many pairs as there are different ends.
    found = ends.select("first", "last").distinct().join(numbers.withColumnRenamed("k", "first"), "first")
    found = found.join(numbers.select(F.col("k").alias("last"), "ancestor"), ["last", "ancestor"])
    best = found.groupBy("first", "last").agg(F.min_by("ancestor", "distance").alias("mrca"))
    return ends.join(best, ["first", "last"], "left").select(F.col("g").alias(group), "mrca")


def prune(tree: DataFrame, up: DataFrame, keep: DataFrame) -> DataFrame:
    """The tree over the leaves in keep (node), nodes with one child contracted: node, parent."""
    alive = keep.select("node").distinct().join(up, "node").select(F.col("ancestor").alias("node")).distinct()
    left = tree.select("node", "parent").join(alive, "node")
    fork = left.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n")).where("n > 1").select("node")
    stay = fork.where("node is not null").unionByName(keep.select("node")).distinct()
    above = up.where("distance > 0").join(stay.withColumnRenamed("node", "ancestor"), "ancestor").groupBy("node").agg(F.min_by("ancestor", "distance").alias("parent"))
    return stay.join(above, "node", "left")


def species_overlap(children: DataFrame, node: str, child: str, species: str, threshold: float = 0.0) -> DataFrame:
    """Overlap of the children's species at each node with two children or more: node, n_inter, n_union, overlap, kind.

    The overlap is the species in all of them over the species in any; above the threshold it is D.  Nodes with one child are left out.
    """
    n = children.select(node, child).distinct().groupBy(node).agg(F.count("*").alias("k")).where("k > 1")
    each = children.select(node, child, species).distinct().groupBy(node, species).agg(F.count("*").alias("m"))
    sums = each.join(n, node).groupBy(node).agg(F.count_if(F.col("m") == F.col("k")).alias("n_inter"), F.count("*").alias("n_union"))
    overlap = F.col("n_inter") / F.col("n_union")
    return sums.select(node, "n_inter", "n_union", F.round(overlap, 4).alias("overlap"), F.when(overlap > threshold, "D").otherwise("S").alias("kind"))


def group_sizes(genes: DataFrame, up: DataFrame) -> DataFrame:
    """Genes below each group (genes: node, gene): node, n_genes."""
    return genes.groupBy("node").agg(F.count("*").alias("n")).join(up, "node").groupBy(F.col("ancestor").alias("node")).agg(F.sum("n").alias("n_genes"))


def group_statistics(groups: DataFrame, genes: DataFrame, up: DataFrame) -> DataFrame:
    """A row for each group with genes: node, n_genes, is_root."""
    return groups.join(group_sizes(genes, up), "node").select("node", "n_genes", F.col("parent").isNull().alias("is_root"))


def root_groups(genes: DataFrame, groups: DataFrame, up: DataFrame, least: int = 2) -> DataFrame:
    """Genes by the root above them, roots with least genes or more: root, gene."""
    top = groups.where("parent is null").select(F.col("node").alias("ancestor"))
    all_ = genes.join(up, "node").join(top, "ancestor").select(F.col("ancestor").alias("root"), "gene")
    return all_.join(all_.groupBy("root").count().where(F.col("count") >= least).select("root"), "root", "left_semi")


def groups_at_level(genes: DataFrame, groups: DataFrame, up: DataFrame, is_level: Column, label: Column | None = None) -> DataFrame:
    """Genes by the group above them at a level (a predicate on groups): node, gene, and label if an expression over groups is given."""
    more = [] if label is None else [label.alias("label")]
    level = groups.where(is_level).select(F.col("node").alias("ancestor"), *more)
    return genes.join(up, "node").join(level, "ancestor").select(F.col("ancestor").alias("node"), "gene", *["label"] * len(more))


def marker_groups(groups: DataFrame, genes: DataFrame, up: DataFrame, weight: Column | None = None) -> DataFrame:
    """Genes that stay if every duplication keeps its heaviest child, from the bottom up: root, gene.

    groups: node, parent, kind, ord.  Weight is the number of genes left below, or an aggregate over the columns of genes, as
    the number of species; ties go to the first by ord.
    """
    weight = F.count("*") if weight is None else weight
    tree = materialised(with_depth(groups, up))
    deepest = tree.agg(F.max("depth")).first()[0]
    if deepest is None:
        return genes.select(F.col("node").alias("root"), "gene").limit(0)
    left = genes.join(tree.select("node", "parent", "depth"), "node").select(F.col("node").alias("at"), "depth", *[c for c in genes.columns if c != "node"])
    for d in range(deepest, 0, -1):
        here = left.where(F.col("depth") == d)
        weights = here.groupBy(F.col("at").alias("node")).agg(weight.alias("w")).join(tree.select("node", "parent", "ord"), "node")
        kinds = tree.select(F.col("node").alias("parent"), F.col("kind").alias("above"))
        best = weights.groupBy("parent").agg(F.max_by("node", F.struct("w", -F.col("ord"))).alias("best"))
        kept = weights.join(kinds, "parent").join(best, "parent").where("above <> 'D' or node = best").select(F.col("node").alias("at"), "parent")
        up_one = here.join(kept, "at").select(F.col("parent").alias("at"), F.lit(d - 1).alias("depth"), *[c for c in genes.columns if c != "node"])
        left = materialised(left.where(F.col("depth") < d).unionByName(up_one))
    sizes = left.groupBy("at").count().where("count > 1")
    return left.join(sizes, "at", "left_semi").select(F.col("at").alias("root"), "gene")


def pairwise_relations(groups: DataFrame, genes: DataFrame, up: DataFrame, kind: str | Column) -> DataFrame:
    """Pairs of genes whose lowest common group is of a kind, or meets a predicate on groups: gene_a < gene_b.

    Output is quadratic in a group's genes by its meaning; the join is on the common group and children, which adaptive
    execution splits where a group is large.
    """
    path = genes.join(up, "node").select("gene", F.col("ancestor").alias("at"), "node", "distance")
    # The child below each ancestor on a gene's way; a gene hangs itself below its own node.
    below = path.select("gene", "node", F.col("at").alias("child"), (F.col("distance") + 1).alias("distance"))
    way = path.join(below, ["gene", "node", "distance"], "left").select("gene", "at", F.coalesce(F.col("child").cast("string"), F.concat(F.lit("gene "), F.col("gene").cast("string"))).alias("child"))
    way = way.join(groups.where(F.col("kind") == kind if isinstance(kind, str) else kind).select(F.col("node").alias("at")), "at")
    met = way.alias("a").join(way.alias("b"), (F.col("a.at") == F.col("b.at")) & (F.col("a.child") < F.col("b.child")))
    return met.select(F.least("a.gene", "b.gene").alias("gene_a"), F.greatest("a.gene", "b.gene").alias("gene_b"))


def duplication_ids(groups: DataFrame, up: DataFrame, taxon: str | None = None) -> DataFrame:
    """Ids of nested speciation groups: node, hog_id.

    A root is HOG:0000001 by fam; below the n-th duplication of its duplication depth in a family the children add .n and a
    letter.  A column taxon, if named, is appended behind an underscore.  groups: fam, node, parent, kind, ord (pre-order in the family),
    place (from 0 among siblings, genes included).
    """
    tree = materialised(with_depth(groups, up))
    kinds = tree.select(F.col("node").alias("ancestor"), F.col("kind").alias("above"))
    dup_depth = up.join(kinds, "ancestor").groupBy("node").agg(F.count_if(F.col("above") == "D").alias("dup_depth"))
    dups = tree.where("kind = 'D'").join(dup_depth, "node")
    number = F.row_number().over(Window.partitionBy("fam", "dup_depth").orderBy("ord"))
    numbered = dups.select(F.col("node").alias("parent"), number.alias("n"))
    part = F.when(F.col("n").isNull(), "").otherwise(F.concat(F.lit("."), F.col("n").cast("string"), letters(F.col("place"))))
    step = tree.join(numbered, "parent", "left").select("node", "fam", part.alias("part"))
    parts = up.join(step.select(F.col("node").alias("ancestor"), "part"), "ancestor")
    joined = parts.groupBy("node").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), "part"))), lambda x: x["part"]), "").alias("suffix"))
    end = F.coalesce(F.concat(F.lit("_"), F.col(taxon).cast("string")), F.lit("")) if taxon else F.lit("")
    held = tree.where("kind = 'S'").select("node", "fam", end.alias("end"))
    return joined.join(held, "node").select("node", F.concat(F.format_string("HOG:%07d", "fam"), "suffix", "end").alias("hog_id"))


def with_taxon_ids(groups: DataFrame, taxa: DataFrame, level: str = "level") -> DataFrame:
    """Adds taxon, the id of a group's level by name, null where the table of names lacks it.

    taxa: name, id; a name with two ids is an error, as the groups of that level would be doubled.
    """
    one = taxa.where("name is not null").groupBy("name").agg(F.min("id").alias("taxon"), F.count_distinct("id").alias("n"))
    fault = F.raise_error(F.concat(F.lit("several ids for the taxon "), F.col("name")))
    ids = one.select(F.col("name").alias("_name"), F.when(F.col("n") <= 1, F.col("taxon")).otherwise(fault.cast(taxa.schema["id"].dataType)).alias("taxon"))
    return groups.join(ids, groups[level] == F.col("_name"), "left").drop("_name")


def filter_cascade(groups: DataFrame, value: str, threshold: float) -> DataFrame:
    """Groups that stay if those with value below the threshold go, and then parents that lose all of their child groups.

    Each round takes away some groups, or it is the last.
    """
    now = materialised(groups)
    had = now.where("parent is not null").select(F.col("parent").alias("node")).distinct().withColumn("had", F.lit(True))
    now = now.join(had, "node", "left")
    now = materialised(now.where(~(F.lit(threshold) > F.col(value))))
    n = now.count()
    while True:
        has = now.select(F.col("parent").alias("node")).where("node is not null").distinct().withColumn("has", F.lit(True))
        now = materialised(now.join(has, "node", "left").where("had is null or has").drop("has"))
        before, n = n, now.count()
        if n == before:
            return now.drop("had")


def level_comparison(parent: DataFrame, child: DataFrame) -> DataFrame:
    """What becomes of groups between two levels, each with group, gene: group, n_children, event.

    A group of the upper level is lost, identical or duplicated by how many lower groups share a gene with it; a lower group without
    an upper one is novel, or a singleton if it holds one gene.
    """
    a, b = parent.select(F.col("group").alias("up"), "gene"), child.select(F.col("group").alias("down"), "gene")
    met = a.join(b, "gene", "full_outer").select("up", "down").distinct()
    kept = met.where("up is not null").groupBy(F.col("up").alias("group")).agg(F.count("down").alias("n_children"))
    event = F.when(F.col("n_children") == 0, "lost").when(F.col("n_children") == 1, "identical").otherwise("duplicated")
    sizes = b.groupBy("down").agg(F.count_distinct("gene").alias("size"))
    fresh = met.join(sizes, "down").groupBy(F.col("down").alias("group")).agg(F.count("up").alias("n"), F.first("size").alias("size")).where("n = 0")
    return kept.withColumn("event", event).unionByName(fresh.select("group", F.lit(0).cast("long").alias("n_children"), F.when(F.col("size") == 1, "singleton").otherwise("novel").alias("event")))


def traversals(tree: DataFrame, up: DataFrame, order: str = "node") -> DataFrame:
    """Places of nodes (from 1) in three orders, siblings by a column: node, pre, post, by_level.

    For one small tree, as that of the species: the windows run over all its nodes.
    """
    names = tree.select(F.col("node").alias("ancestor"), F.col(order).cast("string").alias("name"))
    steps = F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), "name")))
    paths = up.join(names, "ancestor").groupBy("node").agg(F.transform(steps, lambda x: x["name"]).alias("path"), F.max("distance").alias("depth"))
    # Behind its descendants in post-order: the end of a path sorts after every name.
    last = F.concat("path", F.array(F.lit("\U0010ffff")))
    number = lambda *by: F.row_number().over(Window.orderBy(*by))
    return paths.select("node", number("path").alias("pre"), number(last).alias("post"), number("depth", "path").alias("by_level"))


def groups_in_clade(genes: DataFrame, groups: DataFrame, up: DataFrame, clade: DataFrame) -> DataFrame:
    """Genes by the highest speciation group all of whose genes are of a clade's species: node, gene.

    genes: node, gene, species.  groups: node, parent, kind.  clade: species.
    """
    told = genes.join(clade.select("species").distinct().withColumn("inside", F.lit(True)), "species", "left")
    whole = told.join(up, "node").groupBy(F.col("ancestor").alias("node")).agg(F.bool_and(F.coalesce("inside", F.lit(False))).alias("whole")).where("whole")
    whole = materialised(groups.where("kind = 'S'").join(whole, "node").select("node"))
    # The highest: no other such group above.
    lower = up.where("distance > 0").join(whole, "node").join(whole.withColumnRenamed("node", "ancestor"), "ancestor").select("node").distinct()
    top = whole.join(lower, "node", "left_anti").withColumnRenamed("node", "ancestor")
    return genes.join(up, "node").join(top, "ancestor").select(F.col("ancestor").alias("node"), "gene")


def maximal_groups(genes: DataFrame, groups: DataFrame, up: DataFrame) -> DataFrame:
    """Genes that stay if every duplication keeps its child with most species, judged on the whole tree: root, gene.

    genes: node, gene, species; ties go to the first child by ord.
    """
    width = genes.join(up, "node").groupBy(F.col("ancestor").alias("node")).agg(F.count_distinct("species").alias("w"))
    twice = groups.where("kind = 'D'").select(F.col("node").alias("parent"))
    rivals = groups.select("node", "parent", "ord").join(twice, "parent").join(width, "node")
    best = rivals.groupBy("parent").agg(F.max_by("node", F.struct("w", -F.col("ord"))).alias("node"))
    less = rivals.join(best, "node", "left_anti").select(F.col("node").alias("ancestor"))
    gone = genes.join(up, "node").join(less, "ancestor").select("gene").distinct()
    top = groups.where("parent is null").select(F.col("node").alias("ancestor"))
    return genes.join(gone, "gene", "left_anti").join(up, "node").join(top, "ancestor").select(F.col("ancestor").alias("root"), "gene")


def root_levels(groups: DataFrame) -> DataFrame:
    """The level of each root: node, level."""
    return groups.where("parent is null").select("node", "level")


def named_pairs(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs of genes (gene_a, gene_b) by names (gene, name), the lesser name first: name_a, name_b."""
    a, b = names.select(F.col("gene").alias("gene_a"), F.col("name").alias("a")), names.select(F.col("gene").alias("gene_b"), F.col("name").alias("b"))
    return pairs.join(a, "gene_a").join(b, "gene_b").select(F.least("a", "b").alias("name_a"), F.greatest("a", "b").alias("name_b"))


def level_of_interest(tree: DataFrame, up: DataFrame, share: float = 0.4) -> str:
    """The taxon reached from the root by going to the largest clade below (first by order) while it has the share of all leaves, two at least."""
    sizes = leaf_counts(tree, up)
    walk = up.where("distance > 0").join(sizes, "node").join(traversals(tree, up).select("node", "by_level"), "node")
    below = walk.select(F.col("ancestor").alias("at"), "node", "n_leaves", "by_level").groupBy("at").agg(F.max_by(F.struct("node", "n_leaves"), F.struct("n_leaves", -F.col("by_level"))).alias("best"))
    # One row for each taxon of the species tree.
    step = {r["at"]: (r["best"]["node"], r["best"]["n_leaves"]) for r in below.collect()}
    at = tree.where("parent is null").first()["node"]
    least = max(2, int(share * sizes.agg(F.max("n_leaves")).first()[0]))
    while at in step and step[at][1] >= least:
        at = step[at][0]
    return at


def taxonomy_of(pairs: DataFrame) -> DataFrame:
    """A tree out of pairs seen in nested groups (node, ancestor, any number of steps apart): node, parent; the pairs that others imply go.

    Raises an error if there is not one root.
    """
    steps = materialised(pairs.select("node", "ancestor").where("node <> ancestor").distinct())
    whole = steps
    while True:
        more = whole.alias("a").join(whole.alias("b"), F.col("a.ancestor") == F.col("b.node")).select("a.node", "b.ancestor")
        wider = materialised(whole.unionByName(more).distinct())
        if wider.join(whole, ["node", "ancestor"], "left_anti").isEmpty():
            break
        whole = wider
    implied = whole.alias("a").join(whole.alias("b"), F.col("a.ancestor") == F.col("b.node")).select("a.node", "b.ancestor").distinct()
    direct = whole.join(implied, ["node", "ancestor"], "left_anti").select("node", F.col("ancestor").alias("parent"))
    tops = whole.select(F.col("ancestor").alias("node")).distinct().join(whole.select("node"), "node", "left_anti")
    found = [r["node"] for r in tops.limit(2).collect()]
    if len(found) != 1:
        raise ValueError("the levels do not have one root")
    return direct.unionByName(tops.select("node", F.lit(None).cast(direct.schema["parent"].dataType).alias("parent")))


def level_range(members: DataFrame, group: str, taxon: str, up: DataFrame) -> DataFrame:
    """The most specific and the most general taxon of each group (ties: the least by name), and the taxa: group, specific, general, n_taxa."""
    depth = up.groupBy(F.col("node").alias(taxon)).agg(F.max("distance").alias("depth"))
    each = members.select(group, taxon).distinct().join(depth, taxon)
    return each.groupBy(group).agg(F.min_by(taxon, F.struct(-F.col("depth"), taxon)).alias("specific"), F.min_by(taxon, F.struct("depth", taxon)).alias("general"), F.count("*").alias("n_taxa"))


def younger(up: DataFrame, level: str) -> DataFrame:
    """The taxa below a level: node."""
    return up.where((F.col("ancestor") == level) & (F.col("distance") > 0)).select("node")


def edge_events(memberships: DataFrame, tree: DataFrame) -> DataFrame:
    """What becomes of groups on each edge of the species tree: node, parent, retained, duplicated, lost, gained.

    memberships: level, group, gene: the groups at each taxon.  A group of the parent with one group below it in the child that shares a
    gene is retained, with several duplicated, with none lost; a group of the child that shares none is gained.
    """
    edges = tree.where("parent is not null").select("node", "parent")
    upper = memberships.select(F.col("level").alias("parent"), F.col("group").alias("upper"), "gene").join(edges, "parent")
    lower = memberships.select(F.col("level").alias("node"), F.col("group").alias("lower"), "gene")
    met = upper.join(lower, ["node", "gene"]).select("node", "upper", "lower").distinct()
    kept = upper.select("node", "upper").distinct().join(met, ["node", "upper"], "left").groupBy("node", "upper").agg(F.count("lower").alias("k"))
    one = kept.groupBy("node").agg(F.count_if(F.col("k") == 1).alias("retained"), F.count_if(F.col("k") > 1).alias("duplicated"), F.count_if(F.col("k") == 0).alias("lost"))
    fresh = lower.select("node", "lower").distinct().join(met.select("node", "lower").distinct(), ["node", "lower"], "left_anti").groupBy("node").agg(F.count("*").alias("gained"))
    out = edges.join(one, "node", "left").join(fresh, "node", "left")
    return out.select("node", "parent", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("retained", "duplicated", "lost", "gained")])
