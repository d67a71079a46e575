"""Alignments in long form (group, member, place, residue): gap filters, identity, fragments, consensus, distance outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Gap characters, the greatest gap share of a column, the least share of residues in a row, columns from which to filter.
GAPS, COLUMN_GAPS, ROW_RESIDUES, LEAST_COLUMNS = "-?.~", 0.5, 0.3, 50
#: Fixed value: the overlap of two fragments over the shorter one's length.
MARGIN = 0.15


def long_form(msa: DataFrame, group: str, member: str, aligned: str) -> DataFrame:
    """Aligned strings as one row for each character: group, member, place (from 0), residue, is_gap."""
    each = msa.select(F.col(group).alias("group"), F.col(member).alias("member"), F.posexplode(F.split(aligned, "")).alias("place", "residue"))
    return each.where("residue <> ''").withColumn("is_gap", F.instr(F.lit(GAPS), F.col("residue")) > 0)


def column_gaps(cells: DataFrame) -> DataFrame:
    return cells.groupBy("group", "place").agg(F.avg(F.col("is_gap").cast("int")).alias("gap_ratio"))


def row_residues(cells: DataFrame) -> DataFrame:
    """Share of residues (not of gaps) of each row."""
    return cells.groupBy("group", "member").agg(F.avg((~F.col("is_gap")).cast("int")).alias("residue_ratio"))


def elbow(columns: DataFrame, least: float = 0.0) -> DataFrame:
    """For each group the gap ratio farthest from the share of columns with a smaller one, least or more: group, elbow."""
    order = Window.partitionBy("group").orderBy("gap_ratio")
    n = columns.groupBy("group", "gap_ratio").agg(F.count("*").alias("n"))  # a row for each distinct ratio, not for each column
    total = columns.groupBy("group").agg(F.count("*").alias("total"))
    less = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    away = n.withColumn("less", less).join(total, "group").withColumn("away", F.round(F.abs(F.col("gap_ratio") - F.col("less") / F.col("total")), 9))
    return away.groupBy("group").agg(F.greatest(F.min_by("gap_ratio", F.struct(-F.col("away"), "gap_ratio")), F.lit(least)).alias("elbow"))


def filter_alignment(cells: DataFrame, gap_ratio_col: float = COLUMN_GAPS, residue_ratio_row: float = ROW_RESIDUES, least_columns: int = LEAST_COLUMNS) -> DataFrame:
    """The cells that stay: columns with a smaller gap ratio, then rows with enough residues, then columns that are not all gaps.

    Groups with fewer columns than least_columns stay as they are; the last step is left out where no row went.
    """
    columns = column_gaps(cells)
    wide = columns.groupBy("group").agg((F.count("*") >= least_columns).alias("wide"))
    told = cells.join(columns, ["group", "place"]).join(wide, "group")
    one = told.where(~F.col("wide") | (F.col("gap_ratio") < gap_ratio_col)).drop("gap_ratio")
    rows = row_residues(one)
    two = one.join(rows, ["group", "member"]).where(~F.col("wide") | (F.col("residue_ratio") >= residue_ratio_row)).drop("residue_ratio")
    went = rows.groupBy("group").agg(F.min(F.col("residue_ratio") >= residue_ratio_row).alias("all_rows"))
    empty = column_gaps(two).where("gap_ratio = 1").select("group", "place", F.lit(True).alias("empty"))
    last = two.join(empty, ["group", "place"], "left").join(went, "group")
    return last.where("not wide or all_rows or empty is null").select(*cells.columns)


def removed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rows of alignments that a filter took away: group, member."""
    return before.select("group", "member").distinct().join(after.select("group", "member").distinct(), ["group", "member"], "left_anti")


def identity(a: Column, b: Column, gap: str = "-") -> tuple[Column, Column]:
    """Share of equal characters of two aligned strings over the places where the first, and the second, has no gap."""
    pairs = F.arrays_zip(F.split(a, "").alias("a"), F.split(b, "").alias("b"))

    def share(side: str) -> Column:
        known = F.filter(pairs, lambda p: p[side] != gap)
        return F.size(F.filter(known, lambda p: p["a"] == p["b"])) / F.nullif(F.size(known), F.lit(0))

    return share("a"), share("b")


def spans(rows: DataFrame, group: str, member: str, aligned: str) -> DataFrame:
    """First and last place (from 0) that is not a gap, and residues of each row."""
    start = F.length(F.regexp_extract(aligned, "^[-?.~]*", 0))
    end = F.length(aligned) - F.length(F.regexp_extract(aligned, "[-?.~]*$", 0)) - 1
    return rows.select(group, member, start.alias("start"), end.alias("end"), F.length(F.regexp_replace(aligned, "[-?.~]", "")).alias("n_residues"))


def fragment_neighbours(spans_: DataFrame, group: str, member: str, start: str, end: str) -> DataFrame:
    """Each row with the next of its group by start: group, member, next_member, overlap (of this end over the next start)."""
    order = Window.partitionBy(group).orderBy(start, member)
    out = spans_.withColumn("next_member", F.lead(member).over(order)).withColumn("overlap", F.col(end) - F.lead(start).over(order))
    return out.where("next_member is not null").select(group, member, "next_member", "overlap")


def fragment_groups(spans_: DataFrame, group: str, member: str, margin: float = MARGIN) -> DataFrame:
    """Groups of several rows of which no two neighbours overlap by more than margin of either length: group."""
    order = Window.partitionBy(group).orderBy("start", member)
    length = F.col("end") - F.col("start") + 1
    met = spans_.withColumn("over", F.col("end") - F.lead("start").over(order)).withColumn("least", F.least(length, F.lead(length).over(order)))
    ok = F.col("over").isNull() | (F.col("over") <= F.col("least") * margin)
    return met.groupBy(group).agg(F.count("*").alias("n"), F.bool_and(ok).alias("ok")).where("n > 1 and ok").select(group)


def consensus(cells: DataFrame) -> DataFrame:
    """One character for each place: the gap, the only residue, or X: group, place, residue."""
    # Distinct residues first: keys alone are hashed, and the greatest is taken among few.
    each = cells.select("group", "place", F.when(~F.col("is_gap"), F.col("residue")).alias("residue")).distinct()
    kinds = F.count("residue")
    return each.groupBy("group", "place").agg(F.when(kinds == 0, "-").when(kinds == 1, F.max("residue")).otherwise("X").alias("residue"))


def concatenate(blocks: DataFrame, part: str, member: str, aligned: str, fill: str = "X") -> DataFrame:
    """Every member's blocks one behind another, absent ones filled: member, aligned.  parts and their lengths are few."""
    lengths = blocks.groupBy(part).agg(F.max(F.length(aligned)).alias("n"))
    grid = blocks.select(member).distinct().crossJoin(F.broadcast(lengths))  # a row for each part
    put = grid.join(blocks.select(part, member, aligned), [part, member], "left").withColumn("text", F.coalesce(aligned, F.repeat(F.lit(fill), F.col("n"))))
    ordered = F.sort_array(F.collect_list(F.struct(part, "text")))
    return put.groupBy(member).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias(aligned))


def distance_outliers(distances: DataFrame, group: str, member: str, other: str, distance: str) -> DataFrame:
    """Members whose summed distance lies above the third quartile by more than 1.5 quartile ranges: group, member, total."""
    # Where a distance is the difference of two values, value_outliers() needs no pairs.
    both = distances.select(group, F.col(member).alias("m"), distance).unionByName(distances.select(group, F.col(other).alias("m"), distance))
    sums = both.groupBy(group, "m").agg(F.round(F.sum(distance), 6).alias("total"))
    quartiles = sums.groupBy(group).agg(F.percentile("total", 0.25).alias("q1"), F.percentile("total", 0.75).alias("q3"))
    return sums.join(quartiles, group).where("total > q3 + 1.5 * (q3 - q1)").select(group, F.col("m").alias(member), "total")


def value_outliers(values: DataFrame, group: str, member: str, value: str) -> DataFrame:
    """distance_outliers() where two members are as far apart as their values differ: group, member, total.

    Totals are made of running sums over a row for each distinct value of a group, without pairs.  values has a row for each
    member; null values take no part.
    """
    x = F.col(value)
    each = values.where(x.isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(group).orderBy(value)
    all_n, all_x = (F.sum(c).over(Window.partitionBy(group)) for c in (F.col("n"), F.col("n") * x))
    n, upto = (F.sum(c).over(order) for c in (F.col("n"), F.col("n") * x))
    told = each.withColumn("total", F.round((x * (2 * n - all_n) + all_x - 2 * upto).cast("double"), 6))
    quartiles = told.groupBy(group).agg(F.percentile("total", 0.25, F.col("n")).alias("q1"), F.percentile("total", 0.75, F.col("n")).alias("q3"))
    far = told.join(quartiles, group).where("total > q3 + 1.5 * (q3 - q1)").select(group, value, "total")
    return values.join(far, [group, value]).select(group, member, "total")


def bootstrap_columns(cells: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """Resampled alignments: replicate, group, member, place, residue, is_gap.  Every place of a replicate shows a column drawn by a hash."""
    width = cells.groupBy("group").agg((F.max("place") + 1).alias("n"))
    draws = width.select("group", "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    draws = draws.select("group", "replicate", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"), "n")
    draws = draws.withColumn("place", F.pmod(F.xxhash64(F.lit(seed), "group", "replicate", "at"), "n").cast("int"))
    return draws.join(cells, ["group", "place"]).select("replicate", "group", "member", F.col("at").alias("place"), "residue", "is_gap")


def back_translate(residues: DataFrame, codons: DataFrame, sequence: str, place: str, seed: int = 0) -> DataFrame:
    """A codon for each residue, drawn by a hash with the weights of a usage table: sequence, place, residue, codon.

    residues: sequence, place, residue.  codons: residue, codon, weight; a row for each codon.  Residues that the table lacks go.
    """
    upto = F.sum("weight").over(Window.partitionBy("residue").orderBy("codon"))
    ranges = codons.select("residue", "codon", "weight").withColumn("upto", upto)
    total = codons.groupBy("residue").agg(F.sum("weight").alias("total"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), sequence, place), 11) / float(1 << 53)
    asked = residues.withColumn("residue", F.upper("residue")).join(total, "residue").withColumn("draw", draw * F.col("total"))
    met = asked.join(ranges, "residue").where("upto - weight <= draw and draw < upto")
    return met.select(sequence, place, "residue", "codon")
