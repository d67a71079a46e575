"""Checks of the inputs: files, species trees, splice lists, and tables of what was mapped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Extensions of sequence files, and the least number of them.
EXTENSIONS, LEAST_FILES = ("fa", "fasta"), 3
#: Sizes in bytes from which a family's job belongs to a larger class.
SIZE_CLASSES = ((1_000_000, "small"), (2_000_000, "medium"), (5_000_000, "large"))


def file_checks(files: DataFrame, name: str) -> DataFrame:
    """One row about sequence files: n_files, n_extensions, passes (three files or more, of one extension)."""
    extension = F.regexp_extract(name, r"\.([^.]+)$", 1)
    known = files.where(extension.isin(*EXTENSIONS))
    out = known.agg(F.count("*").alias("n_files"), F.count_distinct(extension).alias("n_extensions"))
    return out.withColumn("passes", (F.col("n_files") >= LEAST_FILES) & (F.col("n_extensions") == 1))


def tree_checks(tree: DataFrame, species: DataFrame) -> DataFrame:
    """What is wrong with a species tree (node, parent, name) for the given species (species): problem, name, n.

    unnamed: an inner node without a name; repeated: a name of several inner nodes, or of several leaves; missing: a species that is
    no leaf, an error; extra: a leaf that is no species, which pruning takes away.
    """
    inner = tree.select(F.col("parent").alias("node")).where("node is not null").distinct()
    above, leaves = tree.join(inner, "node", "left_semi"), tree.join(inner, "node", "left_anti")
    none = F.coalesce(F.col("name"), F.lit("")) == ""
    parts = [above.where(none).groupBy(F.lit("unnamed").alias("problem"), F.lit(None).cast("string").alias("name")).agg(F.count("*").alias("n"))]
    for rows, what in ((above.where(~none), "repeated inner"), (leaves, "repeated leaf")):
        parts.append(rows.groupBy(F.lit(what).alias("problem"), "name").agg(F.count("*").alias("n")).where("n > 1"))
    own, had = species.select(F.col("species").alias("name")).distinct(), leaves.select("name").distinct()
    parts.append(own.join(had, "name", "left_anti").select(F.lit("missing").alias("problem"), "name", F.lit(1).cast("long").alias("n")))
    parts.append(had.join(own, "name", "left_anti").select(F.lit("extra").alias("problem"), "name", F.lit(1).cast("long").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def splice_counts(isoforms: DataFrame, species: str, gene: str) -> DataFrame:
    """By species the genes with several isoforms, and these isoforms: n_genes, n_isoforms."""
    each = isoforms.groupBy(species, gene).agg(F.count("*").alias("k"))
    several = F.col("k") > 1
    return each.groupBy(species).agg(F.count_if(several).alias("n_genes"), F.coalesce(F.sum(F.when(several, F.col("k"))), F.lit(0)).alias("n_isoforms"))


def mapping_counts(proteins: DataFrame, hits: DataFrame, protein: str, species: str) -> DataFrame:
    """By species: n_proteins, n_mapped (with a hit), n_unmapped, n_hits."""
    per = hits.groupBy(protein).agg(F.count("*").alias("k"))
    met = proteins.select(protein, species).join(per, protein, "left")
    mapped = F.count_if(F.col("k").isNotNull())
    return met.groupBy(species).agg(F.count("*").alias("n_proteins"), mapped.alias("n_mapped"), (F.count("*") - mapped).alias("n_unmapped"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_hits"))


def size_classes(files: DataFrame, group: str, size: str, classes: tuple = SIZE_CLASSES, last: str = "huge") -> DataFrame:
    """By group the largest file and its class: largest, size_class.  classes: (below, name) in ascending order."""
    out: Column | None = None
    largest = F.max(size)
    for below, name in classes:
        out = F.when(largest < below, name) if out is None else out.when(largest < below, name)
    return files.groupBy(group).agg(largest.alias("largest"), out.otherwise(last).alias("size_class"))


def splice_lists(headers: DataFrame, species: str, protein: str, description: str) -> DataFrame:
    """Genes of several proteins out of descriptions with gene:NAME: species, gene, n, proteins (in order, with semicolons)."""
    gene = F.regexp_extract(description, r"gene:(\S+)", 1).alias("gene")
    named = headers.select(species, protein, gene).where("gene <> ''")
    return named.groupBy(species, "gene").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(F.col(protein).cast("string"))), ";").alias("proteins")).where("n > 1")
