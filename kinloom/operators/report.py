"""Tables of the report: species, distributions, compositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def species_summary(proteins: DataFrame, species: str, in_group: Column) -> DataFrame:
    """By species: n_proteins, n_in_group, n_not_in_group, fraction (4 digits)."""
    n, inside = F.count("*"), F.count_if(in_group)
    return proteins.groupBy(species).agg(n.alias("n_proteins"), inside.alias("n_in_group"), (n - inside).alias("n_not_in_group"), F.round(inside / n, 4).alias("fraction"))


def describe(values: DataFrame, column: str) -> DataFrame:
    """One row: n, mean, stddev, least, quartiles with linear interpolation, greatest."""
    c = F.col(column).cast("double")
    q = [F.round(F.percentile(c, p), 4).alias(f"q{int(100 * p)}") for p in (0.25, 0.5, 0.75)]
    return values.agg(F.count(c).alias("n"), F.round(F.avg(c), 4).alias("mean"), F.round(F.stddev(c), 4).alias("stddev"), F.min(c).alias("least"), *q, F.max(c).alias("greatest"))


def cumulative_share(values: DataFrame, column: str) -> DataFrame:
    """Share of rows up to each distinct value: value, share.  The window runs over distinct values only."""
    n = values.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    total = n.agg(F.sum("n").alias("total"))
    return n.withColumn("upto", upto).crossJoin(F.broadcast(total)).select("value", F.round(F.col("upto") / F.col("total"), 6).alias("share"))


def composition_counts(members: DataFrame, group: str, species: str, names: list) -> DataFrame:
    """A row for each group, a column n_<name> with its members of each species."""
    return members.groupBy(group).agg(*[F.count_if(F.col(species) == n).alias(f"n_{n}") for n in names])


def percentiles(values: DataFrame, column: str, shares: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """One row: a column p<share> for each share, with linear interpolation, to 6 digits."""
    return values.agg(*[F.round(F.percentile(F.col(column).cast("double"), p), 6).alias(f"p{round(100 * p)}") for p in shares])


def mismatches(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of both tables whose values differ: key, left, right."""
    a, b = left.select(key, F.col(value).alias("left")), right.select(key, F.col(value).alias("right"))
    return a.join(b, key).where(~F.col("left").eqNullSafe(F.col("right")))


def species_table(proteins: DataFrame, species: str, in_group: Column, minor: Column) -> DataFrame:
    """By species: n_proteins, n_in_group, n_minor (isoforms that stand for no gene), n_single (neither), fraction of the genes in a group."""
    n, inside, less = F.count("*"), F.count_if(in_group & ~minor), F.count_if(minor)
    fraction = F.round(inside / F.nullif(n - less, F.lit(0)), 4)
    return proteins.groupBy(species).agg(n.alias("n_proteins"), inside.alias("n_in_group"), less.alias("n_minor"), (n - inside - less).alias("n_single"), fraction.alias("fraction"))


def composition_members(members: DataFrame, group: str, species: str, member: str, names: list) -> DataFrame:
    """A row for each group, a column of_<name> with its members of each species, comma between, NA for none."""
    listed = lambda n: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col(species) == n, F.col(member)))), lambda x: x.cast("string")), ",")
    return members.groupBy(group).agg(*[F.coalesce(F.nullif(listed(n), F.lit("")), F.lit("NA")).alias(f"of_{n}") for n in names])


def lateral_comparison(genes: DataFrame, group: str, species: str, one: str, other: str) -> DataFrame:
    """Groups of two species side by side: group, n_one, n_other, event (both, lost: only in one, gained: only in the other)."""
    counts = genes.groupBy(F.col(group).alias("group")).agg(F.count_if(F.col(species) == one).alias("n_one"), F.count_if(F.col(species) == other).alias("n_other"))
    event = F.when(F.col("n_other") == 0, "lost").when(F.col("n_one") == 0, "gained").otherwise("both")
    return counts.where("n_one + n_other > 0").withColumn("event", event)
