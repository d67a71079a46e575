"""The relational tables seen as biological data, for the registered queries.

hits: a row for each placement; protein = order, species = nation of its customer, families = supplier and part with supplier.
tree: WORLD over regions over nations.  alignments: embeddings, with negative components as gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom.operators.graph import shared_folder
from kinloom.operators.proteins import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Where the placements of a table folder are kept, by application and by the files that they were made of.
_STORED: dict[tuple, str] = {}


def _files(spark: SparkSession, sf_dir: str, *names: str) -> tuple:
    """Name, size and time of change of the files of some tables."""
    out = []
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        out += sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in system.listStatus(path))
    return tuple(out)


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The placements, with their ranks, as ingest would keep them: computed once for an application and the same files."""
    key = (spark.sparkContext.applicationId, sf_dir, _files(spark, sf_dir, "lineitem", "orders", "customer"))
    if key not in _STORED:
        path = shared_folder(spark)
        _hits(spark, sf_dir).write.option("compression", "zstd").parquet(path)
        _STORED[key] = path
    root_f = (F.col("part") * 5 + F.col("root_s") % 5).alias("root_f")
    return spark.read.parquet(_STORED[key]).select("prot", "species", "hit_rank", "part", "root_s", root_f, "score")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Lines that are equal so far differ in no column that is kept, so the further ones of HITS_SQL are not shuffled.
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").withColumn("hit_rank", F.row_number().over(order))
    owner = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    met = lines.join(owner.select("o_orderkey", F.col("c_nationkey").alias("species")), F.col("l_orderkey") == F.col("o_orderkey"))
    return met.select(
        F.col("l_orderkey").alias("prot"), "species", "hit_rank", F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("root_s"),
        (F.col("l_extendedprice") / 1000.0).alias("score"),
    )


HITS_SQL = """hits AS (
    SELECT l_orderkey AS prot, c_nationkey AS species, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS hit_rank,
        l_partkey AS part, l_suppkey AS root_s, l_partkey * 5 + l_suppkey % 5 AS root_f, l_extendedprice / 1000.0 AS score
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def species_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("node"), F.lit("WORLD").alias("parent"))
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("node"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("parent"))
    top = spark.range(1).select(F.lit("WORLD").alias("node"), F.lit(None).cast("string").alias("parent"))
    return top.unionByName(regions).unionByName(nations)


TREE_SQL = """tree AS (
    SELECT 'WORLD' AS node, CAST(NULL AS VARCHAR) AS parent UNION ALL SELECT 'R' || r_regionkey, 'WORLD' FROM region
    UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation)"""


def part_groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nested groups and their genes: brands (S) over halves of sizes (D) over types (S) over thirds of sizes (D) over sizes (S)
    over parts; the species of a part is its container of 25, by number.  A node's name is its path."""
    half, third = F.col("p_size") % 2, F.col("p_size") % 3
    steps = [F.col("p_brand"), half.cast("string"), F.col("p_type"), third.cast("string"), F.col("p_size").cast("string")]
    part = table(spark, sf_dir, "part")
    name = lambda k: F.concat_ws("/", *steps[:k]) if k else F.lit(None).cast("string")
    levels = [("S", "brand"), ("D", None), ("S", "type"), ("D", None), ("S", "size")]
    rows = [part.select(F.col("p_brand").alias("brand"), name(k).alias("node"), name(k - 1).alias("parent"), F.lit(kind).alias("kind"), F.lit(level).alias("level")).distinct() for k, (kind, level) in enumerate(levels, 1)]
    groups = rows[0]
    for r in rows[1:]:
        groups = groups.unionByName(r)
    brands = numbered(part.select(F.col("p_brand").alias("brand")).distinct(), "brand").withColumnRenamed("number", "fam")
    ord_ = F.row_number().over(Window.partitionBy("fam").orderBy("node"))
    place = F.row_number().over(Window.partitionBy("parent").orderBy("node")) - 1
    groups = groups.join(brands, "brand").withColumn("ord", ord_).withColumn("place", F.when(F.col("parent").isNull(), 0).otherwise(place))
    genes = part.select(name(5).alias("node"), F.col("p_partkey").alias("gene"), (F.col("p_partkey") % 25).alias("species"))
    return groups.select("fam", "node", "parent", "kind", "level", "ord", "place"), genes


#: The same in SQL: p has a row for each part and the names of the groups above it, g a row for each group.
PARTS_SQL = """p AS (SELECT p_partkey AS gene, p_partkey % 25 AS species, p_brand AS n1, p_brand || '/' || p_size % 2 AS n2, p_brand || '/' || p_size % 2 || '/' || p_type AS n3,
        p_brand || '/' || p_size % 2 || '/' || p_type || '/' || p_size % 3 AS n4, p_brand || '/' || p_size % 2 || '/' || p_type || '/' || p_size % 3 || '/' || p_size AS n5 FROM part),
    g0 AS (SELECT DISTINCT n1, n1 AS node, CAST(NULL AS VARCHAR) AS parent, 'S' AS kind, 'brand' AS level FROM p UNION ALL SELECT DISTINCT n1, n2, n1, 'D', NULL FROM p
        UNION ALL SELECT DISTINCT n1, n3, n2, 'S', 'type' FROM p UNION ALL SELECT DISTINCT n1, n4, n3, 'D', NULL FROM p UNION ALL SELECT DISTINCT n1, n5, n4, 'S', 'size' FROM p),
    g AS (SELECT dense_rank() OVER (ORDER BY n1) AS fam, node, parent, kind, level, row_number() OVER (PARTITION BY n1 ORDER BY node) AS ord,
        CASE WHEN parent IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY parent ORDER BY node) - 1 END AS place FROM g0)"""


def customer_groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Families of 30 customers: a root (S) over regions (D) over nations (S)."""
    who = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    fam = F.floor(F.col("c_custkey") / 30).cast("long")
    root, region = F.concat(F.lit("f"), fam.cast("string")), F.concat_ws("/", F.concat(F.lit("f"), fam.cast("string")), F.col("n_regionkey").cast("string"))
    nation = F.concat_ws("/", region, F.col("c_nationkey").cast("string"))
    none = F.lit(None).cast("string")
    levels = [(root, none, "S"), (region, root, "D"), (nation, region, "S")]
    groups = [who.select(fam.alias("fam"), n.alias("node"), p.alias("parent"), F.lit(k).alias("kind"), n.alias("ord")).distinct() for n, p, k in levels]
    return groups[0].unionByName(groups[1]).unionByName(groups[2]), who.select(nation.alias("node"), F.col("c_custkey").alias("gene"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as alignments in long form: group = label, member = vec_id, negative components are gaps."""
    each = table(spark, sf_dir, "embeddings").select(F.col("label").alias("group"), F.col("vec_id").alias("member"), F.posexplode("embedding").alias("place", "x"))
    return each.select("group", "member", "place", F.when(F.col("x") < 0, "-").otherwise("A").alias("residue"), (F.col("x") < 0).alias("is_gap"))


CELLS_SQL = """cells AS (
    SELECT label AS "group", vec_id AS member, i - 1 AS place, embedding[i] < 0 AS is_gap
    FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"""
