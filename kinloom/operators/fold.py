"""The fold of families over the species tree: nested groups out of genes, from the species up to the root.

At a species every gene is a group of its own.  At each taxon above, the groups of its children meet: a gene tree of their
representatives is built, rooted and labelled with speciations and duplications, and what stays together below its first speciations
becomes a group of the taxon, with a few representatives that stand for all.  State is three tables, of groups, of links
from a group to the groups that it is made of, and of representatives; a loop over the depths of the species tree handles all
families at once, and only the gene tree of one family at one taxon is local to a task.  Its leaves are the representatives of the
groups that meet, so a family's size does not bound it, but very many groups of one family in one taxon do.

Aligning and building trees are strategies.  align takes the sequences that meet to aligned lines, column_filter tells which
lines are good enough and which columns count, distance takes what is left to a matrix, root takes an unrooted tree to a rooted
one.  With align=None sequences are compared by their words; keep then tells which are good enough (all, by default).  A group
none of whose sequences is kept is frozen: it goes up as it is and is a group of its own.  Sequences that are equal in one species
are one leaf until the tree stands.  Genes with a null family, species or id, and genes of species that the tree does not have, take
no part; an empty table gives empty tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.operators import aligner, genetree, hierarchy
from kinloom.operators.graph import discard, materialised
from kinloom.operators.proteins import numbered
from kinloom.sources.trees import write_newick

#: Representatives of a group, and the share of species from which an overlap is a duplication.
REPRESENTATIVES, OVERLAP = 5, 0.1
_OUT = "fam long, taxon string, kind string, hog string, sub string, gene string, seq string, n long, species array<string>"


_SCHEMA = pa.schema([(c.split(" ")[0], {"long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}[c.split(" ")[1]]) for c in _OUT.split(", ")])


class _Level:
    """One family at one taxon: rows of representatives (hog, via, gene, seq, n, species)."""

    def __init__(
        self, rows: pd.DataFrame | list[dict], most: int, overlap: float, distance: Callable | None, root: Callable, keep: Callable | None,
        align: aligner.Align | None = None, column_filter: aligner.ColumnFilter | None = None, aligned: list[str] | None = None,
    ):
        # aligned: the lines of the rows by hog and gene, if they are known.
        self.most, self.overlap = most, overlap
        if isinstance(rows, pd.DataFrame):
            rows = rows.to_dict("records")
        rows = sorted(rows, key=lambda r: (r["hog"], r["gene"]))
        lines, kept = [r["seq"] for r in rows], [True] * len(rows)
        if align is not None:
            lines = align(lines) if aligned is None else aligned
        if column_filter is not None:
            kept, lines = column_filter(lines)
        if keep is not None:
            kept = [bool(a and b) for a, b in zip(kept, keep(lines), strict=True)]
        good = [r for r, k in zip(rows, kept, strict=True) if k]
        lines = [x for x, k in zip(lines, kept, strict=True) if k]
        self.frozen = sorted({r["hog"] for r in rows} - {r["hog"] for r in good})
        self.via, self.seq, self.n = ({r["gene"]: r[c] for r in good} for c in ("via", "seq", "n"))
        self.species = species = {r["gene"]: frozenset(r["species"]) for r in good}
        # Parts of a group: it is one part until it must be split; a part is a set of the groups that it is made of.
        self.part_of = {r["gene"]: (r["hog"], 0) for r in good}
        made: dict[str, set[str]] = {}
        for r in good:
            made.setdefault(r["hog"], set()).add(r["via"])
        self.parts = {hog: [sorted(via)] for hog, via in made.items()}
        # Equal lines of one species are one leaf while the tree is built.
        first: dict[tuple, str] = {}
        copies: dict[str, list[str]] = {}
        apart: list[str] = []
        for gene, line in zip(species, lines, strict=True):
            one = first.setdefault((line, species[gene]) if len(species[gene]) == 1 else (gene,), gene)
            if one == gene:
                apart.append(line)
            else:
                copies.setdefault(one, []).append(gene)
        self.lines = dict(zip(species, lines, strict=True))
        genes = list(first.values())
        if len(genes) > 1:
            self.tree = root(genetree.neighbour_joining(genes, (distance or (aligner.aligned_distance if align else genetree.word_distance))(apart)))
        else:
            self.tree = genetree.Node(genes[0]) if genes else None
        if self.tree is not None and len(species) > 1:
            self.tree = genetree.with_copies(self.tree, copies)
            genetree.species_overlap(self.tree, species, overlap)

    def _split_or_drop(self, part: tuple[str, int], pieces: list[list[str]]) -> set[str]:
        """Splits a part along what it is made of; where the pieces share that, the lesser pieces' representatives are to go."""
        via = [{self.via[g] for g in p} for p in pieces]
        hog, _ = part
        if all(a.isdisjoint(b) for i, a in enumerate(via) for b in via[:i]):
            # What no piece represents stays with the largest one.
            largest = max(range(len(pieces)), key=lambda i: (len(pieces[i]), -i))
            rest = set(self.parts[hog][part[1]]) - set().union(*via)
            for i, piece in enumerate(pieces):
                made = sorted(via[i] | rest if i == largest else via[i])
                if i == 0:
                    self.parts[hog][part[1]], number = made, part[1]
                else:
                    self.parts[hog].append(made)
                    number = len(self.parts[hog]) - 1
                for gene in piece:
                    self.part_of[gene] = (hog, number)
            return set()
        weight = lambda p: (-sum(self.n[g] for g in p), -len(p), min(p))
        return {g for p in sorted(pieces, key=weight)[1:] for g in p}

    def settled(self) -> list[genetree.Node]:
        """The subtrees that become groups, once no part has representatives in two of them."""
        while True:
            found = genetree.candidates(self.tree)
            where: dict[tuple[str, int], dict[int, list[str]]] = {}
            for k, sub in enumerate(found):
                for leaf in sub.leaves():
                    where.setdefault(self.part_of[leaf.name], {}).setdefault(k, []).append(leaf.name)
            torn = {p: list(w.values()) for p, w in where.items() if len(w) > 1}
            if not torn:
                return found
            gone = set().union(*(self._split_or_drop(p, pieces) for p, pieces in sorted(torn.items())))
            self.tree = genetree.without(self.tree, gone)

    def found(self, fam: int, taxon: str, shown: bool = False) -> list[tuple]:
        """Rows as _OUT has them: frozen groups, links, representatives and parts of split groups; with shown also the gene tree
        (Newick) and the lines over the columns that counted, both in place of a sequence."""
        out = [(fam, taxon, "frozen", hog, None, None, None, None, None) for hog in self.frozen]
        if shown and self.tree is not None:
            out.append((fam, taxon, "tree", None, None, None, write_newick(genetree.to_rows(self.tree)), None, None))
            out += [(fam, taxon, "line", self.part_of[g][0], None, g, line, self.n[g], sorted(self.species[g])) for g, line in sorted(self.lines.items())]
        for sub in self.settled() if self.tree is not None else []:
            used = sorted({self.part_of[leaf.name] for leaf in sub.leaves()})
            names = {p: p[0] if len(self.parts[p[0]]) == 1 else f"{p[0]}~{p[1]}" for p in used}
            new = f"{taxon}:{min(names.values())}"
            out += [(fam, taxon, "link", new, names[p], None, None, None, None) for p in used]
            for gene, stands in genetree.representatives(sub, self.most):
                species = sorted(frozenset.union(*(self.species[g] for g in stands)))
                part = names[self.part_of[gene]]
                out.append((fam, taxon, "rep", new, part, gene, self.seq[gene], sum(self.n[g] for g in stands), species))
        for hog, parts in self.parts.items():
            if len(parts) > 1:
                for k, part in enumerate(parts):
                    out += [(fam, taxon, "split", f"{hog}~{k}", via, hog, None, None, None) for via in part]
        return out

    def result(self, fam: int, taxon: str) -> pd.DataFrame:
        return pd.DataFrame(self.found(fam, taxon), columns=[c.split(" ")[0] for c in _OUT.split(", ")])


def _meetings(batches: Iterator[pa.RecordBatch], most: int = aligner.TOGETHER) -> Iterator[list[tuple[int, str, list[dict]]]]:
    """Families at taxa (fam, taxon, rows by hog and gene) out of rows that come sorted by these, as many together as have about most cells."""
    met, cells = [], 0
    for (fam, taxon), rows in groupby((r for b in batches for r in b.to_pylist()), key=lambda r: (r["fam"], r["taxon"])):
        met.append((fam, taxon, sorted(rows, key=lambda r: (r["hog"], r["gene"]))))
        cells += max(len(r["seq"]) for r in met[-1][2]) ** 2
        if cells >= most:
            yield met
            met, cells = [], 0
    if met:
        yield met


def fold(
    genes: DataFrame, tree: DataFrame, most: int = REPRESENTATIVES, overlap: float = OVERLAP, distance: Callable | None = None,
    root: Callable = genetree.midpoint, keep: Callable | None = None, align: aligner.Align | None = aligner.progressive,
    column_filter: aligner.ColumnFilter | None = aligner.gap_filter, show: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Groups (fam, hog, level, frozen) and links (fam, hog, sub) of families.

    show, if given, is a folder that gets the gene trees and alignments of all levels as Parquet, by turn (the depth): fam, taxon, kind (tree
    or line), hog, gene, text (Newick, or the line over the columns that counted), n (genes stood for), species.

    genes: fam, gene, species, seq.  tree: node, parent, with species as leaves.  A gene's own group has the name of the gene.
    """
    up = materialised(hierarchy.closure(tree))
    depth = materialised(hierarchy.with_depth(tree.select("node", "parent"), up))
    above = depth.select(F.col("node").alias("at"), F.col("parent").alias("taxon"), (F.col("depth") - 1).alias("turn"))
    known = genes.where("fam is not null and gene is not null and species is not null").join(tree.select(F.col("node").alias("species")), "species")
    known = known.select(F.col("fam").cast("long"), F.col("gene").cast("string"), "species", F.coalesce("seq", F.lit("")).alias("seq"))
    state = materialised(known.select("fam", F.col("gene").alias("hog"), F.col("species").alias("at"), F.lit(False).alias("frozen")))
    reps = materialised(known.select("fam", F.col("gene").alias("hog"), F.col("gene").alias("via"), "gene", "seq", F.lit(1).cast("long").alias("n"), F.array("species").alias("species")))
    groups = [known.select("fam", F.col("gene").alias("hog"), F.col("species").alias("level"))]
    links, splits = [], []

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met in _meetings(batches):
            # The aligner of this library takes many small families at once.
            together = aligner.progressive_together([[r["seq"] for r in rows] for _, _, rows in met]) if align is aligner.progressive else [None] * len(met)
            out = []
            for (fam, taxon, rows), lines in zip(met, together, strict=True):
                whole = _Level(rows, most, overlap, distance, root, keep, align, column_filter if align else None, lines)
                out += whole.found(fam, taxon, show is not None)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    # The number of tasks is said, as few bytes of genes are much work.
    tasks = int(genes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deepest = depth.agg(F.max("depth")).first()[0] or 0
    for turn in range(deepest - 1, -1, -1):
        moved = state.join(above.where(F.col("turn") == turn), "at")
        meeting = moved.groupBy("fam", "taxon").agg(F.count("*").alias("many"))
        moved = materialised(moved.join(meeting, ["fam", "taxon"]).select("fam", "taxon", "hog", "frozen", "many"))
        active = moved.where("not frozen and many > 1")
        meet = reps.join(active.select("fam", "taxon", "hog"), ["fam", "hog"]).repartition(tasks, "fam", "taxon").sortWithinPartitions("fam", "taxon")
        made = materialised(meet.mapInArrow(levels, _OUT))
        if show is not None:
            seen = made.where("kind in ('tree', 'line')").select("fam", "taxon", "kind", "hog", "gene", F.col("seq").alias("text"), "n", "species")
            seen.write.mode("overwrite").parquet(f"{show}/turn={turn}")
        passed = moved.where("frozen or many = 1").select("fam", "hog", F.col("taxon").alias("at"), "frozen")
        cold = made.where("kind = 'frozen'").select("fam", "hog", F.col("taxon").alias("at"), F.lit(True).alias("frozen"))
        new = made.where("kind = 'link'").select("fam", "hog", F.col("taxon").alias("at"), F.lit(False).alias("frozen")).distinct()
        rest = state.join(above.where(F.col("turn") == turn).select("at"), "at", "left_anti").select("fam", "hog", "at", "frozen")
        still = reps.join(active.select("fam", "hog"), ["fam", "hog"], "left_anti")
        fresh = made.where("kind = 'rep'").select("fam", "hog", F.col("sub").alias("via"), "gene", "seq", "n", "species")
        spent = (state, reps, moved)
        state, reps = materialised(rest.unionByName(passed).unionByName(cold).unionByName(new)), materialised(still.unionByName(fresh))
        discard(*spent)
        groups.append(made.where("kind = 'link'").select("fam", "hog", F.col("taxon").alias("level")).distinct())
        links.append(made.where("kind = 'link'").select("fam", "hog", "sub"))
        splits.append(made.where("kind = 'split'").select("fam", F.col("hog").alias("part"), F.col("sub").alias("via"), F.col("gene").alias("whole")))
    return _with_splits(groups, links, splits, state)


def _with_splits(groups: list[DataFrame], links: list[DataFrame], splits: list[DataFrame], state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Puts the parts of split groups in their place: each takes over what it is made of, the first what none names."""
    all_groups = groups[0]
    for g in groups[1:]:
        all_groups = all_groups.unionByName(g)
    frozen = state.where("frozen").select("fam", "hog").withColumn("frozen", F.lit(True))
    if not links:
        return all_groups.withColumn("frozen", F.lit(False)), all_groups.select("fam", "hog", F.lit(None).cast("string").alias("sub")).where("false")
    all_links, all_splits = links[0], splits[0]
    for more, parts in zip(links[1:], splits[1:], strict=True):
        all_links, all_splits = all_links.unionByName(more), all_splits.unionByName(parts)
    all_splits = materialised(all_splits)
    levels = all_groups.withColumnRenamed("hog", "whole").join(all_splits.select("fam", "part", "whole").distinct(), ["fam", "whole"])
    first = all_splits.groupBy("fam", "whole").agg(F.min("part").alias("first"))
    moved = all_links.withColumnRenamed("hog", "whole").join(first, ["fam", "whole"], "left")
    named = all_splits.withColumnRenamed("via", "sub")
    moved = moved.join(named, ["fam", "whole", "sub"], "left").select("fam", F.coalesce("part", "first", "whole").alias("hog"), "sub")
    left = all_groups.join(all_splits.select("fam", F.col("whole").alias("hog")).distinct(), ["fam", "hog"], "left_anti")
    out = left.unionByName(levels.select("fam", F.col("part").alias("hog"), "level")).join(frozen, ["fam", "hog"], "left")
    return materialised(out.withColumn("frozen", F.coalesce("frozen", F.lit(False)))), materialised(moved)


def group_tree(groups: DataFrame, links: DataFrame, genes: DataFrame, tree: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """The nested groups of a fold, for export: groups (fam, node, parent, kind, level, score, ord, place) and genes (node, gene, place).

    Groups of one group that stand for the same taxon come under a duplication (kind D); a group with one member in all is that
    member.  level is the lowest taxon above a group's species, score the share of that taxon's species.  A family whose
    top is a duplication gets a speciation group over it.  Tops with fewer than least genes are left out.  ord is the order in the
    family from the top, place that among siblings, from 0.
    """
    below = links.join(groups.select("fam", F.col("hog").alias("sub"), F.col("level").alias("clade")), ["fam", "sub"])
    alike = below.groupBy("fam", "hog", "clade").agg(F.count("*").alias("n"), F.min("sub").alias("one"))
    name = lambda *c: F.concat_ws("\t", F.col("fam").cast("string"), *c)
    joint = F.concat_ws("\t", "hog", "clade")
    doubles = alike.where("n > 1").select("fam", name(joint).alias("node"), name("hog").alias("parent"), F.lit("D").alias("kind"))
    inner = below.join(alike.select("fam", "hog", "clade", "n"), ["fam", "hog", "clade"]).select("fam", name("sub").alias("node"), F.when(F.col("n") > 1, name(joint)).otherwise(name("hog")).alias("parent"))
    nodes = groups.join(genes.select("fam", F.col("gene").alias("hog")).distinct().withColumn("leaf", F.lit(True)), ["fam", "hog"], "left")
    nodes = nodes.select("fam", name("hog").alias("node"), F.when(F.col("leaf"), "L").otherwise("S").alias("kind"))
    whole = nodes.join(inner.select("node", "parent"), "node", "left").select("fam", "node", "parent", "kind").unionByName(doubles)
    whole = materialised(whole)
    members = whole.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("k"))
    single = whole.join(members, "node", "left").where("kind = 'S' and coalesce(k, 0) < 2").select("node")
    up = materialised(hierarchy.closure(whole))
    forks = whole.join(single, "node", "left_anti").select("node")
    # Where a duplication has only groups with one member above it, the top of these stays as the speciation over it.
    above = up.where("distance > 0").join(forks.withColumnRenamed("node", "ancestor"), "ancestor").select("node").distinct()
    tops = whole.where("parent is null").select(F.col("node").alias("ancestor"))
    bare = whole.where("kind = 'D'").select("node").join(above, "node", "left_anti").join(up, "node").join(tops, "ancestor").select(F.col("ancestor").alias("node")).distinct()
    bare = materialised(bare)
    stay = materialised(forks.unionByName(bare).distinct())
    near = up.where("distance > 0").join(stay.withColumnRenamed("node", "ancestor"), "ancestor").groupBy("node").agg(F.min_by("ancestor", "distance").alias("parent"))
    tight = materialised(whole.select("fam", "node", "kind").join(stay, "node").join(near, "node", "left"))
    # The first by depth-first order: a path of the names down from the top.
    up = materialised(hierarchy.closure(tight))
    leaf = tight.where("kind = 'L'").join(genes.select(name("gene").alias("node"), "gene", "species").distinct(), "node")
    under = up.join(leaf.select("node", "gene", "species"), "node").select(F.col("ancestor").alias("node"), "gene", "species")
    sizes = under.groupBy("node").agg(F.count("*").alias("n"), F.count_distinct("species").alias("n_species"))
    taxa = hierarchy.closure(tree)
    mrca = hierarchy.common_ancestor(under.select("node", "species").withColumnRenamed("node", "of"), "of", "species", taxa)
    leaves = hierarchy.leaf_counts(tree.select("node", "parent"), taxa).select(F.col("node").alias("mrca"), "n_leaves")
    # Such a top stands for its own taxon.
    own = groups.select(name("hog").alias("of"), F.col("level").alias("own")).join(bare.withColumnRenamed("node", "of"), "of")
    mrca = mrca.join(own, "of", "left").select("of", F.coalesce("own", "mrca").alias("mrca"))
    scored = mrca.join(leaves, "mrca").join(sizes.withColumnRenamed("node", "of"), "of")
    scored = scored.select(F.col("of").alias("node"), F.col("mrca").alias("level"), F.round(F.col("n_species") / F.col("n_leaves"), 4).alias("score"), "n")
    big = up.join(scored.select(F.col("node").alias("ancestor"), F.col("n").alias("of_top")), "ancestor").join(tight.where("parent is null").select(F.col("node").alias("ancestor")), "ancestor")
    big = big.where(F.col("of_top") >= least).select("node", F.col("ancestor").alias("top"))
    path = up.groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "ancestor"))), lambda x: x["ancestor"]), chr(1)).alias("path"))
    kept = materialised(tight.join(big, "node").join(path, "node"))

    # Windows run over one family's groups, or one group's members.
    place = F.row_number().over(Window.partitionBy("parent").orderBy("node")) - 1
    placed = kept.where("parent is not null").withColumn("place", place).unionByName(kept.where("parent is null").withColumn("place", F.lit(0)))
    groups_ = placed.where("kind <> 'L'").join(scored.select("node", "level", "score"), "node", "left")
    ord_ = F.row_number().over(Window.partitionBy("top").orderBy("path"))
    numbers = numbered(kept.where("parent is null").select("top"), "top").select("top", F.col("number").alias("family"))
    groups_ = groups_.join(numbers, "top").select(F.col("family").alias("fam"), "node", "parent", "kind", F.when(F.col("kind") == "S", F.col("level")).alias("level"), F.when(F.col("kind") == "S", F.col("score")).alias("score"), ord_.alias("ord"), "place")
    out = placed.where("kind = 'L'").join(leaf.select("node", "gene"), "node").select(F.col("parent").alias("node"), "gene", "place")
    return materialised(groups_), materialised(out)
