"""Proteins, isoforms and their checks: best isoform, numeric ids, residue composition, header and id functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.operators.graph import materialised

#: Amino-acid letters, and the limits of the input checks.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
LONGEST_ID, LEAST_SHARE, FIRST_ID, PER_SPECIES = 60, 0.2, 1_000_000_000, 1_000_000


def best_isoforms(isoforms: DataFrame, scores: DataFrame, gene: str, protein: str, order: str) -> DataFrame:
    """The isoform that stands for each gene: gene, protein.

    scores: protein, score over all its hits.  The best score wins, ties go to the last in order; a gene without a mapped isoform
    takes its first.
    """
    scored = isoforms.join(scores, protein, "left")
    best = F.max_by(protein, F.when(F.col("score").isNotNull(), F.struct("score", order)))
    return scored.groupBy(gene).agg(F.coalesce(best, F.min_by(protein, order)).alias(protein))


def drop_minor_isoforms(hits: DataFrame, isoforms: DataFrame, chosen: DataFrame, protein: str) -> DataFrame:
    """Hits without those of isoforms that were not chosen; proteins without isoforms stay."""
    minor = isoforms.select(protein).join(chosen.select(protein), protein, "left_anti")
    return hits.join(minor, protein, "left_anti")


def unmapped_and_single(proteins: DataFrame, mapped: DataFrame, singles: DataFrame, protein: str) -> DataFrame:
    """Proteins without a family, by reason: those without a hit and those alone in theirs."""
    none = proteins.select(protein).join(mapped.select(protein), protein, "left_anti").withColumn("reason", F.lit("unmapped"))
    return none.unionByName(singles.select(protein).withColumn("reason", F.lit("singleton")))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds number, from 1 in the order of columns without nulls, over all rows.

    Rows are sorted by range, so no task holds them all; each range's numbers follow those of the ranges before it.
    """
    # Stored, as a second pass could draw other ranges.
    dealt = materialised(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = dealt.groupBy("_range").agg(F.count("*").alias("_size")).select("_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_at", within).join(before, "_range").withColumn("number", (F.col("_at") + F.col("_before")).cast("long")).drop("_range", "_at", "_before")


def species_index(proteins: DataFrame, species: str) -> DataFrame:
    """Adds species_index, the place of a row's species among all by name, from 0; rows without a species go."""
    names = proteins.select(F.col(species).alias("_name")).where("_name is not null").distinct()
    placed = numbered(names, "_name").withColumn("species_index", F.col("number") - 1).drop("number")
    return proteins.join(placed, F.col(species) == F.col("_name")).drop("_name")


def numeric_ids(proteins: DataFrame, species: str, species_index: str, order: str) -> DataFrame:
    """Adds numeric_id: FIRST_ID + species index * PER_SPECIES + running number from 1 in order within the species.

    A row's number in its species is its number in all less that of the species' first row, so a species may span many tasks.  A species of
    more than PER_SPECIES proteins is an error, as its ids would be those of the next.
    """
    all_ = numbered(proteins, species, order)
    first = all_.groupBy(F.col(species).alias("_species")).agg(F.min("number").alias("_first"))
    joined = all_.join(first, F.col(species).eqNullSafe(F.col("_species")))
    running = F.col("number") - F.col("_first") + 1
    fault = F.raise_error(F.concat(F.lit(f"more than {PER_SPECIES} proteins in species "), F.col(species).cast("string")))
    id_ = F.lit(FIRST_ID) + F.col(species_index) * PER_SPECIES + F.when(running <= PER_SPECIES, running).otherwise(fault.cast("long"))
    return joined.withColumn("numeric_id", id_.cast("long")).select(*proteins.columns, "numeric_id")


def residue_histogram(sequences: DataFrame, group: str, sequence: str) -> DataFrame:
    """Occurrences of each character by group: group, residue, n."""
    letters = F.regexp_extract_all(F.col(sequence), F.lit("(?s)."), F.lit(0))
    return sequences.select(group, F.explode(letters).alias("residue")).groupBy(group, "residue").agg(F.count("*").alias("n"))


def composition(sequences: DataFrame, group: str, sequence: str, letters: str = AMINO_ACIDS) -> DataFrame:
    """Share of characters out of letters by group, and whether it passes: group, n_chars, share, passes."""
    inside = F.length(F.regexp_replace(F.col(sequence), f"[^{letters}]", ""))
    sums = sequences.groupBy(group).agg(F.sum(F.length(sequence)).alias("n_chars"), F.sum(inside).alias("n_in"))
    share = F.round(F.col("n_in") / F.col("n_chars"), 4)
    return sums.select(group, "n_chars", share.alias("share"), (F.col("n_in") / F.col("n_chars") >= LEAST_SHARE).alias("passes"))


def length_filter(sequences: DataFrame, sequence: str, least: int) -> DataFrame:
    return sequences.where(F.length(sequence) >= least)


def id_checks(proteins: DataFrame, species: str, protein: str) -> DataFrame:
    """By species: n, n_duplicates, longest_id and whether the proteome passes."""
    id_ = F.col(protein).cast("string")
    out = proteins.groupBy(species).agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct(protein)).alias("n_duplicates"), F.max(F.length(id_)).alias("longest_id"))
    return out.withColumn("passes", (F.col("n") > 2) & (F.col("n_duplicates") == 0) & (F.col("longest_id") <= LONGEST_ID))


def set_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: key, side.  Empty means that the sets are equal."""
    # One aggregation of both sides, in place of four and two joins.  A null equals nothing, so it is told on each side that has it.
    both = left.select(key, F.lit(True).alias("is_left")).unionByName(right.select(key, F.lit(False).alias("is_left")))
    held = both.groupBy(key).agg(F.bool_or("is_left").alias("l"), F.bool_or(~F.col("is_left")).alias("r"))
    alone = lambda own, other, side: F.when(F.col(own) & (~F.col(other) | F.col(key).isNull()), side)
    sides = held.select(key, F.explode(F.array(alone("l", "r", "left"), alone("r", "l", "right"))).alias("side"))
    return sides.where("side is not null")
