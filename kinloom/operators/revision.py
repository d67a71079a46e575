"""Changes of members that go through all levels of a fold: fragments of one gene put together, stray genes taken out.

A fold has three tables: genes (fam, gene, species, seq), groups (fam, hog, level, frozen) and links (fam, hog, sub), where a gene's own group
has the name of the gene.  A change is a table update at the genes' groups, and what it empties goes level by level; each change is
kept in a table of provenance.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.operators import aligner, alignment
from kinloom.operators.graph import materialised

#: Letters that two parts of a gene may share, as a share of the shorter one.
OVERLAP = alignment.MARGIN


def _on_anchor(anchor: str, sequence: str) -> str:
    """A sequence as a line over an anchor's letters: its letter where the two are aligned, else a gap; insertions go."""
    _, at, of = aligner.best_path(aligner.score_matrix(anchor, sequence), inside=True)
    line = ["-"] * len(anchor)
    for i, j in zip(at.tolist(), of.tolist(), strict=True):
        if i >= 0 and j >= 0:
            line[i] = sequence[j]
    return "".join(line)


def find_fragments(genes: DataFrame, margin: float = OVERLAP) -> DataFrame:
    """Genes that look like parts of one: fam, species, kept (the least of the genes), gene, seq (a line over the family's anchor).

    Where a species has several genes in a family, each is aligned with the family's anchor, its longest gene (the least id on
    ties), a pair at a time.  They are parts of one gene if no two neighbours by their first place overlap by more than margin of the
    shorter one.  Null and empty sequences take no part.
    """
    known = genes.where("fam is not null and gene is not null and species is not null and length(seq) > 0").select("fam", "gene", "species", "seq")
    anchor = known.groupBy("fam").agg(F.min_by("seq", F.struct((-F.length("seq")).alias("n"), "gene")).alias("anchor"))
    several = known.groupBy("fam", "species").agg(F.count("*").alias("k")).where("k > 1").select("fam", "species")

    @F.pandas_udf("string")
    def line(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_on_anchor(s, t) for s, t in zip(x, y, strict=True)], dtype=object)

    asked = known.join(several, ["fam", "species"], "left_semi").join(anchor, "fam")
    told = materialised(asked.select("fam", "species", "gene", line("anchor", "seq").alias("line")).where("line rlike '[^-]'"))
    told = told.withColumn("of", F.concat_ws("\t", F.col("fam").cast("string"), "species"))
    met = told.join(alignment.fragment_groups(alignment.spans(told, "of", "gene", "line"), "of", "gene", margin), "of", "left_semi")
    return met.join(met.groupBy("of").agg(F.min("gene").alias("kept")), "of").select("fam", "species", "kept", "gene", F.col("line").alias("seq"))


def _without(groups: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups and links without some groups (fam, hog), and without those that have nothing left below, up to the top."""
    groups, links = materialised(groups), materialised(links)
    while True:
        had = links.select("fam", "hog").distinct()
        links = materialised(links.join(gone.select("fam", F.col("hog").alias("sub")), ["fam", "sub"], "left_anti").join(gone.select("fam", "hog"), ["fam", "hog"], "left_anti"))
        groups = materialised(groups.join(gone.select("fam", "hog"), ["fam", "hog"], "left_anti"))
        gone = materialised(had.join(gone.select("fam", "hog"), ["fam", "hog"], "left_anti").join(links.select("fam", "hog").distinct(), ["fam", "hog"], "left_anti"))
        if gone.isEmpty():
            return groups, links.select("fam", "hog", "sub")


def remove_members(groups: DataFrame, links: DataFrame, genes: DataFrame, strays: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """groups, links and genes without some genes (fam, gene), and what was done: fam, gene, action, into."""
    known = materialised(strays.select("fam", "gene").distinct().join(genes.select("fam", "gene"), ["fam", "gene"], "left_semi"))
    left, tied = _without(groups, links, known.select("fam", F.col("gene").alias("hog")))
    done = known.select("fam", "gene", F.lit("removed").alias("action"), F.lit(None).cast("string").alias("into"))
    return left, tied, genes.join(known, ["fam", "gene"], "left_anti"), done


def merge_fragments(groups: DataFrame, links: DataFrame, genes: DataFrame, fragments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """groups, links and genes with the fragments (as find_fragments gives them) as one gene, and what was done: fam, gene, action, into.

    The kept gene takes the consensus of the parts' aligned lines, gaps left out: a place shows the only letter there, or X.
    """
    fragments = materialised(fragments)
    cells = alignment.long_form(fragments.withColumn("of", F.concat_ws("\t", F.col("fam").cast("string"), "kept")), "of", "gene", "seq")
    letters = alignment.consensus(cells).where("residue <> '-'").groupBy("group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "residue"))), lambda x: x["residue"]), "").alias("whole"))
    whole = fragments.select("fam", F.col("kept").alias("gene"), F.concat_ws("\t", F.col("fam").cast("string"), "kept").alias("group")).distinct().join(letters, "group").select("fam", "gene", "whole")
    rest = materialised(fragments.where("gene <> kept").select("fam", "gene", "kept"))
    left, tied = _without(groups, links, rest.select("fam", F.col("gene").alias("hog")))
    kept = genes.join(rest.select("fam", "gene"), ["fam", "gene"], "left_anti").join(whole, ["fam", "gene"], "left")
    kept = kept.withColumn("seq", F.coalesce("whole", "seq")).select(*genes.columns)
    done = rest.select("fam", "gene", F.lit("merged").alias("action"), F.col("kept").alias("into"))
    return left, tied, kept, done
