"""Selections from documents of nested groups: by level, by group, by gene, by species and by score.

groups: rows as read_groups gives them (fam, node, parent, kind S, D or L, level, score, gene, ord).  genes: species, id, prot.  A gene of
groups is named by what their column gene holds, id by default.  What lies below a group is found by intervals, so a selection
costs a sort and not a path for each row.  Keys that are null select nothing, and asking for what is not there gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.operators import intervals


def top_groups(groups: DataFrame) -> DataFrame:
    """The groups that no other holds."""
    return groups.where("parent is null and kind <> 'L'")


def groups_at_levels(groups: DataFrame, levels: DataFrame) -> DataFrame:
    """The groups of some levels (level)."""
    return groups.where("kind <> 'L'").join(levels.select("level").distinct(), "level", "left_semi").select(*groups.columns)


def level_counts(groups: DataFrame) -> DataFrame:
    """The levels that occur: level, n_groups, n_families; groups without a level go."""
    return groups.where("kind <> 'L' and level is not null").groupBy("level").agg(F.count("*").alias("n_groups"), F.count_distinct("fam").alias("n_families"))


def below(groups: DataFrame, tops: DataFrame, kinds: str = "SDL", direct: bool = False) -> DataFrame:
    """The rows of some kinds that lie below some groups (node), at any depth or right below them: holder and the columns of groups.

    A row below several of the groups comes once for each.
    """
    wanted = tops.select(F.col("node").alias("holder")).distinct()
    if direct:
        return groups.where(F.col("kind").isin(*kinds)).join(wanted, groups["parent"] == wanted["holder"]).select("holder", *groups.columns)
    marked = groups.join(wanted.select(F.col("holder").alias("node"), F.lit(True).alias("wanted_")), "node", "left")
    encoded = intervals.encode(marked.select("fam", "node", "parent", "kind", "ord", "wanted_"))
    held = intervals.holders(encoded, F.col("wanted_"), groups.where(F.col("kind").isin(*kinds))).where("holder <> node")
    return held.select("holder", "node").join(groups, "node").select("holder", *groups.columns)


def genes_by_id(genes: DataFrame, ids: DataFrame) -> DataFrame:
    """The genes of some ids (id); an id that several genes have is an error."""
    found = genes.join(ids.select("id").distinct(), "id", "left_semi")
    often = found.groupBy("id").agg(F.count("*").alias("n"))
    one = F.when(F.col("n") == 1, True).otherwise(F.raise_error(F.concat(F.lit("several genes have the id "), F.col("id").cast("string"))).cast("boolean"))
    return found.join(often, "id").where(one).select(*genes.columns)


def input_genes(genes: DataFrame, species: str | None = None) -> DataFrame:
    """All genes that a document describes, of one species if that is given."""
    return genes if species is None else genes.where(F.col("species") == species)


def gene_uses(groups: DataFrame, genes: DataFrame, key: str = "id") -> DataFrame:
    """Every described gene with the number of places where groups name it, and of families: the columns of genes, n_places, n_families."""
    uses = groups.where("kind = 'L' and gene is not null").groupBy("gene").agg(F.count("*").alias("n_places"), F.count_distinct("fam").alias("n_families"))
    told = genes.join(uses, genes[key].cast("string") == uses["gene"], "left").drop("gene")
    return told.fillna(0, ["n_places", "n_families"])


def grouped_genes(groups: DataFrame, genes: DataFrame, species: str | None = None, key: str = "id") -> DataFrame:
    """The described genes that some group names, of one species if that is given."""
    return gene_uses(groups, input_genes(genes, species), key).where("n_places > 0").drop("n_places", "n_families")


def ungrouped_genes(groups: DataFrame, genes: DataFrame, species: str | None = None, key: str = "id") -> DataFrame:
    """The described genes that no group names."""
    return gene_uses(groups, input_genes(genes, species), key).where("n_places = 0").drop("n_places", "n_families")


def groups_of_genes(groups: DataFrame, wanted: DataFrame) -> DataFrame:
    """All groups around some genes (gene), the innermost last: gene, node, kind, level, rank (from 1 at the top)."""
    leaves = groups.where("kind = 'L'").join(wanted.select("gene").distinct(), "gene", "left_semi").select("node", "gene")
    around = intervals.holders(intervals.encode(groups.select("fam", "node", "parent", "kind", "ord")), F.col("kind") != "L", leaves)
    named = groups.where("kind <> 'L'").select(F.col("node").alias("holder"), "kind", "level")
    return around.join(leaves, "node").join(named, "holder").select("gene", F.col("holder").alias("node"), "kind", "level", F.col("within").alias("rank"))


def scored_groups(groups: DataFrame, least: float | None = None) -> DataFrame:
    """Groups that have a score, of least or more if that is given."""
    scored = groups.where("kind <> 'L' and score is not null")
    return scored if least is None else scored.where(F.col("score") >= least)


def families_of_species(groups: DataFrame, genes: DataFrame, species: DataFrame, every: bool = False, key: str = "id") -> DataFrame:
    """Families with genes of some species (species), or of every one of them: fam, n_species (of those asked for), n_genes (of these).

    The result can be given to select_families, write_families and genes_of, for documents about these species.
    """
    asked = species.select("species").where("species is not null").distinct()
    mine = genes.join(asked, "species", "left_semi").select("species", F.col(key).cast("string").alias("gene"))
    held = groups.where("kind = 'L'").select("fam", "gene").join(mine, "gene")
    told = held.groupBy("fam").agg(F.count_distinct("species").alias("n_species"), F.count("*").alias("n_genes"))
    return told.join(asked.agg(F.count("*").alias("asked")), F.col("n_species") == F.col("asked"), "left_semi") if every else told
