"""Nested groups as intervals: pre-order numbers, with which ancestors, sizes and levels need no table of all ancestors.

A forest has a row for each node: a family, node, parent (null or unknown at a root), and ord, the order among siblings.  encode gives
each node pre, its place in its family from 0, and last, the place of the last node below it, so a node is above another one
if its interval holds the other's.  Sums over what is below are differences of one running sum; which groups of a level hold a gene is
told by carrying the last opened group along.  Running sums and carried values go over ranges of a global sort, so no
family meets in one task there.

Families of up to IN_TASK nodes are numbered in a task each.  Larger ones go along their Euler tour: each node is entered and left, the
tour is a linked list, and its ranks come by doubling the steps, in as many rounds as the length has binary digits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom.functions.ids import letters
from kinloom.operators.graph import discard, materialised

#: Nodes of a family that one task numbers.
IN_TASK = 1 << 18


def _places(parent: np.ndarray, ord_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pre, last and depth of nodes with the number of each one's parent (-1: a root), level by level."""
    n = len(parent)
    depth, at, level = np.full(n, -1), np.flatnonzero(parent < 0), 0
    order = np.lexsort((ord_, parent))
    kids = parent[order]
    begin, end = np.searchsorted(kids, np.arange(n)), np.searchsorted(kids, np.arange(n), side="right")
    levels = []
    while len(at):
        depth[at] = level
        levels.append(at)
        sizes = end[at] - begin[at]
        first = np.repeat(begin[at] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        at, level = order[first + np.arange(len(first))], level + 1
    if (depth < 0).any():
        raise ValueError("the tree has a cycle")
    size = np.ones(n, np.int64)
    for at in reversed(levels[1:]):
        np.add.at(size, parent[at], size[at])
    # Sizes of the siblings before, from running sums in sibling order.
    sums = np.cumsum(size[order])
    before = np.empty(n, np.int64)
    before[order] = sums - size[order]
    first = np.where(parent >= 0, begin[parent], np.searchsorted(kids, -1))
    before -= np.where(first > 0, sums[first - 1], 0)
    pre = np.zeros(n, np.int64)
    for at in levels:
        pre[at] = before[at] + np.where(parent[at] >= 0, pre[parent[at]] + 1, 0)
    return pre, pre + size - 1, depth


def encode(groups: DataFrame, family: str = "fam", order: str = "ord", in_task: int = IN_TASK) -> DataFrame:
    """Adds pre, last and depth (0 at a root); stored.  Siblings with equal order stand by node.  A cycle is an error."""
    held = materialised(groups)
    sizes = held.groupBy(family).count()
    names = [("pre", T.LongType()), ("last", T.LongType()), ("depth", T.IntegerType())]
    schema = T.StructType([*held.schema.fields, *(T.StructField(n, t) for n, t in names)])

    def number(rows: pa.Table) -> pa.Table:
        node = rows["node"].combine_chunks()
        parent = pc.index_in(rows["parent"].combine_chunks(), value_set=node, skip_nulls=True).fill_null(-1)
        rank = np.empty(len(rows), np.int64)
        rank[np.asarray(pc.sort_indices(rows, sort_keys=[(order, "ascending"), ("node", "ascending")]))] = np.arange(len(rows))
        for (name, _), values in zip(names, _places(np.asarray(parent), rank), strict=True):
            rows = rows.append_column(name, pa.array(values, pa.int32() if name == "depth" else pa.int64()))
        return rows

    if (sizes.agg(F.max("count")).first()[0] or 0) <= in_task:
        return materialised(held.groupBy(family).applyInArrow(number, schema))
    large = sizes.where(F.col("count") > in_task).select(family)
    small = held.join(large, family, "left_anti").groupBy(family).applyInArrow(number, schema)
    return materialised(small.unionByName(_by_tour(held.join(large, family, "left_semi"), family, order).select(*schema.names)))


def _by_tour(rows: DataFrame, family: str, order: str) -> DataFrame:
    """encode for families of any size.  Nodes have names of their own in all families."""
    from kinloom.operators.proteins import numbered

    known = rows.select(F.col("node").alias("parent"), F.lit(True).alias("inner"))
    rooted = rows.join(known, "parent", "left").withColumn("up", F.when(F.col("inner"), F.col("parent"))).drop("inner")
    # Siblings stand one behind another; roots are the siblings of their family.
    keyed = rooted.withColumn("sib", F.coalesce(F.col("up").cast("string"), F.lit(""))).withColumn("_f", F.col(family).cast("string"))
    placed = materialised(numbered(keyed.select("_f", "sib", order, "node", "up"), "_f", "sib", order, "node"))
    after = placed.select((F.col("number") - 1).alias("number"), F.col("node").alias("next"), F.col("_f").alias("f2"), F.col("sib").alias("s2"))
    told = placed.join(after, "number", "left").withColumn("next", F.when((F.col("f2") == F.col("_f")) & (F.col("s2") == F.col("sib")), F.col("next")))
    first = placed.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.min_by("node", "number").alias("child"))
    told = materialised(told.select("_f", "node", "up", "next").join(first, "node", "left"))
    name = lambda side, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(side), F.col(c).cast("string")))
    enter = told.select(name("(", "node").alias("e"), F.coalesce(name("(", "child"), name(")", "node")).alias("to"), F.lit(1).cast("long").alias("opens"))
    leave = told.select(name(")", "node").alias("e"), F.coalesce(name("(", "next"), name(")", "up")).alias("to"), F.lit(0).cast("long").alias("opens"))
    # Of what lies from here to the end of the list: steps, and nodes entered.
    now = materialised(enter.unionByName(leave).select("e", "to", F.lit(1).cast("long").alias("steps"), "opens"))
    rounds = now.count().bit_length() + 1
    for _ in range(rounds):
        if now.where("`to` is not null").isEmpty():
            break
        further = now.select(F.col("e").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("s2"), F.col("opens").alias("o2"))
        joined = now.join(further, "to", "left")
        spent, now = now, materialised(joined.select("e", F.col("to2").alias("to"), (F.col("steps") + F.coalesce("s2", F.lit(0))).alias("steps"), (F.col("opens") + F.coalesce("o2", F.lit(0))).alias("opens")))
        discard(spent)
    else:
        if not now.where("`to` is not null").isEmpty():
            raise ValueError("the tree has a cycle")
    total = placed.groupBy("_f").agg(F.count("*").alias("n"))
    back = now.select("e", "steps", "opens")
    ends = told.select("_f", "node").join(back.select(F.col("e").alias("i"), F.col("steps").alias("s1"), F.col("opens").alias("o1")), F.concat(F.lit("("), F.col("node").cast("string")) == F.col("i"))
    ends = ends.join(back.select(F.col("e").alias("o"), F.col("opens").alias("o3")), F.concat(F.lit(")"), F.col("node").cast("string")) == F.col("o")).join(total, "_f")
    # o1 nodes are entered from here on, so n - o1 before; o3 behind the end; what is open stands for the depth.
    pre = F.col("n") - F.col("o1")
    done = ends.select("node", pre.alias("pre"), (F.col("n") - F.col("o3") - 1).alias("last"), (F.col("s1") - 2 * F.col("o1")).cast("int").alias("depth"))
    if done.count() < placed.count():
        raise ValueError("the tree has a cycle")
    return rows.join(done, "node")


def running(rows: DataFrame, order: list[str], sums: dict[str, str] | None = None, lasts: dict[str, str] | None = None) -> DataFrame:
    """Adds running sums (name: column), and the last value that is not null up to here (name: column), over all rows in an order
    without ties.  Rows are sorted by range, and each range goes on from what those before it come to."""
    sums, lasts = sums or {}, lasts or {}
    dealt = materialised(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    key = F.struct(*order)
    whole = [F.sum(c).alias(f"_{n}") for n, c in sums.items()] + [F.max_by(c, F.when(F.col(c).isNotNull(), key)).alias(f"_{n}") for n, c in lasts.items()]
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ranges = dealt.groupBy("_range").agg(*whole).select("_range", *[F.sum(f"_{n}").over(earlier).alias(f"_{n}") for n in sums], *[F.last(f"_{n}", ignorenulls=True).over(earlier).alias(f"_{n}") for n in lasts])
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = dealt.select("*", *[F.sum(c).over(within).alias(n) for n, c in sums.items()], *[F.last(c, ignorenulls=True).over(within).alias(n) for n, c in lasts.items()])
    out = here.join(ranges, "_range")
    added = [(F.coalesce(n, F.lit(0)) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in sums] + [F.coalesce(n, f"_{n}").alias(n) for n in lasts]
    return out.select(*rows.columns, *added)


def sums_below(encoded: DataFrame, weights: DataFrame, family: str = "fam") -> DataFrame:
    """For each node the sum of the weights (node, weight) of the nodes of its subtree: the encoded columns and total."""
    put = encoded.join(weights, "node", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    run = materialised(running(put, [family, "pre"], sums={"upto": "weight"}))
    end = run.select(family, F.col("pre").alias("last"), F.col("upto").alias("end"))
    return run.join(end, [family, "last"]).select(*encoded.columns, (F.col("end") - F.col("upto") + F.col("weight")).alias("total"))


def group_sizes(encoded: DataFrame, genes: DataFrame, family: str = "fam") -> DataFrame:
    """Genes below each group that has any (genes: node, gene): the encoded columns and n_genes."""
    counts = genes.groupBy("node").agg(F.count("*").alias("weight"))
    return sums_below(encoded, counts, family).where("total > 0").withColumnRenamed("total", "n_genes")


def group_statistics(encoded: DataFrame, genes: DataFrame, *more: str) -> DataFrame:
    """A row for each group with genes: node, n_genes, is_root, and further columns of groups, as level and score."""
    return group_sizes(encoded, genes).select("node", "n_genes", (F.col("depth") == 0).alias("is_root"), *more)


def nesting(encoded: DataFrame, is_level: Column, family: str = "fam") -> DataFrame:
    """Adds level (whether the predicate holds) and within, the number of such groups that hold a node, itself included; stored."""
    told = encoded.withColumn("level_", F.coalesce(is_level, F.lit(False)))
    # A group is closed behind its last node, before what stands there is opened.
    open_ = told.select("*", F.col("pre").alias("at"), F.lit(1).alias("side"), F.col("level_").cast("int").alias("step"))
    close = told.where("level_").select("*", (F.col("last") + 1).alias("at"), F.lit(0).alias("side"), F.lit(-1).alias("step"))
    run = running(open_.unionByName(close), [family, "at", "side", "pre"], sums={"within": "step"})
    return materialised(run.where("side = 1").select(*encoded.columns, "level_", "within"))


def holders(encoded: DataFrame, is_level: Column, nodes: DataFrame, family: str = "fam") -> DataFrame:
    """Each of some nodes (node) with every group of a level (a predicate on groups) that holds it, itself included:
    node, holder, within (how many of the level hold that holder, itself included)."""
    told = nesting(encoded, is_level, family)
    asked = told.join(nodes.select("node").distinct(), "node", "left_semi").where("within > 0")
    asked = asked.select(F.explode(F.sequence(F.lit(1).cast("long"), "within")).alias("rank"), family, "pre", F.lit(1).alias("side"), "node", F.lit(None).cast(encoded.schema["node"].dataType).alias("opened"))
    # Groups of one rank do not hold each other, so the last one opened is the one that holds a node.
    opened = told.where("level_").select(F.col("within").alias("rank"), family, "pre", F.lit(0).alias("side"), "node", F.col("node").alias("opened"))
    run = running(asked.unionByName(opened), ["rank", family, "pre", "side"], lasts={"holder": "opened"})
    return run.where("side = 1").select("node", "holder", F.col("rank").alias("within"))


def groups_at_level(encoded: DataFrame, genes: DataFrame, is_level: Column, label: Column | None = None) -> DataFrame:
    """Genes by the groups above them at a level: node, gene, and label if an expression over groups is given."""
    held = genes.join(holders(encoded, is_level, genes), "node").select(F.col("holder").alias("node"), "gene")
    return held if label is None else held.join(encoded.select("node", label.alias("label")), "node")


def root_groups(encoded: DataFrame, genes: DataFrame, least: int = 2) -> DataFrame:
    """Genes by the root above them, roots with least genes or more: root, gene."""
    sizes = group_sizes(encoded, genes).where(F.col("depth") == 0).where(F.col("n_genes") >= least).select(F.col("node").alias("root"))
    held = groups_at_level(encoded, genes, F.col("depth") == 0).withColumnRenamed("node", "root")
    return held.join(sizes, "root", "left_semi")


def _forks(encoded: DataFrame) -> DataFrame:
    """Adds above, the kind of a group's parent (null at a root)."""
    return encoded.join(encoded.select(F.col("node").alias("parent"), F.col("kind").alias("above")), "parent", "left")


def marker_groups(encoded: DataFrame, genes: DataFrame, weight: Column | None = None) -> DataFrame:
    """Genes that stay if every duplication keeps its heaviest child, from the bottom up: root, gene; roots of two genes or more.

    Weight is the number of genes left below, or an aggregate over the columns of genes; ties go to the first by ord.  Duplications
    in the same number of others are no part of each other, so there is a round for each depth of duplications.
    """
    weight = F.count("*") if weight is None else weight
    children = materialised(_forks(encoded))
    held = materialised(holders(children, F.col("above") == "D", genes))
    rival = held.join(children.select(F.col("node").alias("holder"), "parent", "ord"), "holder").select("node", "holder", "parent", "ord", "within")
    rival = materialised(rival)
    left = genes
    for rank in range(int(rival.agg(F.max("within")).first()[0] or 0), 0, -1):
        here = left.join(rival.where(F.col("within") == rank), "node")
        weights = here.groupBy("parent", "holder", "ord").agg(weight.alias("w"))
        best = weights.groupBy("parent").agg(F.max_by("holder", F.struct("w", -F.col("ord"))).alias("best"))
        less = weights.join(best, "parent").where("holder <> best").select("holder")
        gone = rival.where(F.col("within") == rank).join(less, "holder", "left_semi").select("node")
        left = materialised(left.join(gone, "node", "left_anti"))
    return root_groups(encoded, left)


def maximal_groups(encoded: DataFrame, genes: DataFrame) -> DataFrame:
    """Genes that stay if every duplication keeps its child with most species, judged on the whole tree: root, gene.

    genes: node, gene, species; ties go to the first child by ord.
    """
    children = materialised(_forks(encoded))
    held = materialised(holders(children, F.col("above") == "D", genes).select("node", "holder"))
    width = genes.join(held, "node").groupBy("holder").agg(F.count_distinct("species").alias("w"))
    rivals = width.join(children.select(F.col("node").alias("holder"), "parent", "ord"), "holder")
    best = rivals.groupBy("parent").agg(F.max_by("holder", F.struct("w", -F.col("ord"))).alias("holder"))
    gone = held.join(rivals.join(best, ["parent", "holder"], "left_anti"), "holder").select("node")
    return root_groups(encoded, genes.join(gone, "node", "left_anti"), least=1)


def groups_in_clade(encoded: DataFrame, genes: DataFrame, clade: DataFrame) -> DataFrame:
    """Genes by the highest speciation group all of whose genes are of a clade's species (species): node, gene."""
    told = genes.join(clade.select("species").distinct().withColumn("inside", F.lit(True)), "species", "left")
    counts = told.groupBy("node").agg(F.count("*").alias("n"), F.count_if(F.col("inside").isNull()).alias("out"))
    # One sum for both: a group with any gene outside has 2 ** 40 or more.
    both = sums_below(encoded, counts.select("node", (F.col("n") + F.col("out") * F.lit(1 << 40)).alias("weight")))
    whole = nesting(both, (F.col("kind") == "S") & (F.col("total") > 0) & (F.col("total") < F.lit(1 << 40))).where("level_ and within = 1").select("node")
    top = encoded.join(whole.withColumn("top", F.lit(True)), "node", "left")
    return groups_at_level(top, genes, F.col("top"))


def duplication_ids(encoded: DataFrame, taxon: str | None = None) -> DataFrame:
    """Ids of nested speciation groups, as hierarchy.duplication_ids: node, hog_id.  The parts of an id are put together by doubling."""
    depth = nesting(encoded, F.col("kind") == "D")
    number = F.row_number().over(Window.partitionBy("fam", "within").orderBy("ord"))
    dups = depth.where("kind = 'D'").select(F.col("node").alias("parent"), number.alias("n"))
    part = F.when(F.col("n").isNull(), "").otherwise(F.concat(F.lit("."), F.col("n").cast("string"), letters(F.col("place"))))
    now = materialised(encoded.join(dups, "parent", "left").select("node", F.col("parent").alias("up"), part.alias("suffix")))
    for _ in range(int(encoded.agg(F.max("depth")).first()[0] or 0).bit_length()):
        above = now.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("suffix").alias("before"))
        now = materialised(now.join(above, "up", "left").select("node", F.col("up2").alias("up"), F.concat(F.coalesce("before", F.lit("")), "suffix").alias("suffix")))
    end = F.coalesce(F.concat(F.lit("_"), F.col(taxon).cast("string")), F.lit("")) if taxon else F.lit("")
    held = encoded.where("kind = 'S'").select("node", "fam", end.alias("end"))
    return now.join(held, "node").select("node", F.concat(F.format_string("HOG:%07d", "fam"), "suffix", "end").alias("hog_id"))


def pairwise_relations(encoded: DataFrame, genes: DataFrame, kind: str | Column) -> DataFrame:
    """Pairs of genes whose lowest common group is of a kind, or meets a predicate on groups: gene_a < gene_b.

    Output is quadratic in a group's genes by its meaning; the join is on the common group and children, which adaptive execution splits
    where a group is large.
    """
    wanted = (F.col("kind") == kind) if isinstance(kind, str) else kind
    tops = encoded.where(wanted).select(F.col("node").alias("parent"), F.lit(True).alias("wanted"))
    under = holders(encoded.join(tops, "parent", "left"), F.col("wanted"), genes).select("node", F.col("holder").alias("child"))
    under = genes.join(under, "node").join(encoded.select(F.col("node").alias("child"), "parent"), "child").select("gene", F.col("parent").alias("at"), F.col("child").cast("string").alias("child"))
    # A gene hangs itself below its own group.
    own = genes.join(encoded.where(wanted).select("node"), "node").select("gene", F.col("node").alias("at"), F.concat(F.lit("gene "), F.col("gene").cast("string")).alias("child"))
    way = materialised(under.unionByName(own))
    met = way.alias("a").join(way.alias("b"), (F.col("a.at") == F.col("b.at")) & (F.col("a.child") < F.col("b.child")))
    return met.select(F.least("a.gene", "b.gene").alias("gene_a"), F.greatest("a.gene", "b.gene").alias("gene_b"))
