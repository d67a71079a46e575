"""Readers and writers of sequence files, placement tables, splice lists and group tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom.functions.ids import root_id
from kinloom.operators.graph import materialised
from kinloom.operators.intervals import running
from kinloom.operators.proteins import numbered

#: The columns of a placement table, in file order.
PLACEMENT = (
    "qseqid string, hogid string, hoglevel string, family_p double, family_count int, family_normcount double, subfamily_score double, "
    "subfamily_count int, qseqlen int, subfamily_medianseqlen int, qseq_overlap double"
)


def _stem(column: str = "_metadata.file_name"):
    return F.regexp_replace(F.col(column), r"\.[^.]*$", "")


def read_fasta(spark: SparkSession, path: str, least_length: int = 0) -> DataFrame:
    """species (file stem), prot_id, description, seq, seq_len.  A record is a row, so large files are split."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(_stem().alias("species"), F.regexp_replace("value", r"^>|\r", "").alias("r"))
    head = F.split_part("r", F.lit("\n"), F.lit(1))
    seq = F.regexp_replace(F.expr("substring(r, length(split_part(r, '\n', 1)) + 1)"), r"\s", "")
    out = raw.select("species", F.regexp_extract(head, r"^(\S+)", 1).alias("prot_id"), head.alias("description"), seq.alias("seq"))
    return out.where("prot_id <> ''").withColumn("seq_len", F.length("seq")).where(F.col("seq_len") >= least_length)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files with the file's stem, the start of the file's part and a number that rises within it; large files are split."""
    lines = spark.read.text(path).select(_stem().alias("f"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", "\r$", "").alias("value"))
    return lines.withColumn("at", F.monotonically_increasing_id())


def read_placements(spark: SparkSession, path: str) -> DataFrame:
    """Placement rows with species, root_id and hit_rank (file order within a protein; N/A is null)."""
    lines = _lines(spark, path).where("value <> '' and value not like '!%' and value not like 'qseqid\t%'")
    fields = [f.strip().split(" ") for f in PLACEMENT.split(",")]
    parts = F.split("value", "\t")
    columns = [F.nullif(F.get(parts, F.lit(i)), F.lit("N/A")).cast(kind).alias(name) for i, (name, kind) in enumerate(fields)]
    rows = lines.select(F.regexp_replace("f", r"\.(fa|fasta)$", "").alias("species"), "block", "at", *columns)
    rank = F.row_number().over(Window.partitionBy("species", "qseqid").orderBy("block", "at"))
    return rows.withColumn("hit_rank", rank).withColumn("root_id", root_id(F.col("hogid"))).drop("block", "at").withColumnRenamed("qseqid", "prot_id")


def read_splice(spark: SparkSession, path: str) -> DataFrame:
    """species, gene (a number that rises in file order), iso_rank, prot_id; empty ids of a trailing separator are left out."""
    lines = _lines(spark, path).select(F.col("f").alias("species"), (F.col("block") + F.col("at") % (1 << 33)).alias("gene"), "value")
    return lines.select("species", "gene", F.posexplode(F.split("value", ";")).alias("iso_rank", "prot_id")).where("prot_id <> ''")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """The files below a path, as those of families: stem, path, size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))
    return files.select(F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1).alias("stem"), "path", "size")


def read_clusters(spark: SparkSession, path: str, least: int = 2, species: Column | None = None) -> DataFrame:
    """Clusters of a clustering tool's sequence file: cluster (a number), member (header), least members or more.

    A header line that follows another header line begins a cluster; the first header of a cluster is its name, not a member.
    Lines are numbered and added up over ranges of a sort, so no file meets in one task.  With species, an expression over
    member, clusters of one species are left out.
    """
    lines = _lines(spark, path).where("value <> ''").withColumn("header", F.col("value").startswith(">"))
    placed = materialised(numbered(lines, "f", "block", "at").select("f", "number", "header", "value"))
    after = placed.select("f", (F.col("number") - 1).alias("number"), F.col("header").alias("next"))
    told = placed.join(after, ["f", "number"], "left").withColumn("begins", (F.col("header") & F.coalesce("next", F.lit(False))).cast("int"))
    summed = running(told, ["number"], sums={"cluster": "begins"})
    members = summed.where("header and begins = 0").select(F.concat_ws("/", "f", F.col("cluster").cast("string")).alias("cluster"), F.substring("value", 2, 1_000_000).alias("member"))
    kinds = F.count("*") if species is None else F.count_distinct("_species")
    told = members if species is None else members.withColumn("_species", species)
    kept = told.groupBy("cluster").agg(F.count("*").alias("n"), kinds.alias("k")).where((F.col("n") >= least) & (F.lit(species is None) | (F.col("k") > 1)))
    return members.join(kept.select("cluster"), "cluster", "left_semi")


def write_fasta(proteins: DataFrame, path: str, by: list[str], compression: str = "none", description: str | None = None) -> None:
    """Records below a folder for each value of by; description is a column that follows the species in the header, as a list of minor isoforms."""
    more = F.lit("") if description is None else F.when(F.coalesce(F.col(description), F.lit("")) != "", F.concat(F.lit(" "), F.col(description))).otherwise("")
    record = F.concat(F.lit(">"), "prot_id", F.lit(" ["), F.coalesce("species", F.lit("")), F.lit("]"), more, F.lit("\n"), "seq")
    proteins.select(*by, record.alias("value")).write.partitionBy(*by).option("compression", compression).text(path)


def write_table(rows: DataFrame, path: str, header: bool = True, compression: str = "none") -> None:
    """Tab-separated."""
    rows.write.option("sep", "\t").option("header", header).option("compression", compression).csv(path)
