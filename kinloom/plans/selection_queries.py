"""Registered queries of documents of nested groups: written, read again, merged and selected from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.operators import alignment, families, hierarchy, intervals, proteins, selections
from kinloom.operators.graph import materialised, shared_folder
from kinloom.plans import domain
from kinloom.plans.domain import CELLS_SQL, PARTS_SQL, table
from kinloom.plans.queries import COMPONENTS, capped_merge, query
from kinloom.sources import trees


def part_rows(spark: SparkSession, d: str) -> DataFrame:
    """The groups of parts with their genes, as rows of a document; the score of a size is the share of 50 that it is."""
    groups, genes = domain.part_groups(spark, d)
    leaves = genes.join(groups.select("node", "fam"), "node").select("fam", F.concat(F.lit("L"), F.col("gene").cast("string")).alias("node"), F.col("node").alias("parent"), F.lit("L").alias("kind"), F.col("gene").alias("ord"), F.col("gene").cast("string").alias("gene"))
    size = F.when(F.col("level") == "size", F.substring_index("node", "/", -1).cast("double") / 50)
    inner = groups.select("fam", "node", "parent", "kind", "level", size.alias("score"), F.col("ord").cast("long").alias("ord"))
    return materialised(inner.unionByName(leaves.withColumn("ord", F.col("ord").cast("long")), allowMissingColumns=True).select("fam", "node", "parent", "kind", "level", "score", "gene", "ord"))


def part_genes(spark: SparkSession, d: str) -> DataFrame:
    """All parts as genes, of 25 species; their names need entities."""
    key = F.col("p_partkey")
    return table(spark, d, "part").select(F.concat(F.lit("s"), (key % 25).cast("string")).alias("species"), key.alias("id"), F.concat(F.lit('P<&"'), key.cast("string")).alias("prot"))


#: A row for each place of the document, by what holds it: the place of a group is its rank among its siblings by name, that of a gene by number.
ROWS = f"""WITH {PARTS_SQL}, f AS (SELECT DISTINCT n1, n2, n3, n4, n5, gene, species FROM p),
    q AS (SELECT f.*, g1.fam, CAST(g1.fam AS VARCHAR) AS d1, g2.place AS b2, g3.place AS b3, g4.place AS b4, g5.place AS b5, row_number() OVER (PARTITION BY n5 ORDER BY gene) - 1 AS b6 FROM f
        JOIN g g1 ON g1.node = n1 JOIN g g2 ON g2.node = n2 JOIN g g3 ON g3.node = n3 JOIN g g4 ON g4.node = n4 JOIN g g5 ON g5.node = n5),
    r AS (SELECT *, d1 || '/' || b2 AS d2, d1 || '/' || b2 || '/' || b3 AS d3, d1 || '/' || b2 || '/' || b3 || '/' || b4 AS d4, d1 || '/' || b2 || '/' || b3 || '/' || b4 || '/' || b5 AS d5 FROM q)"""


@query(f"""{ROWS} SELECT DISTINCT fam, d1 AS node, CAST(NULL AS VARCHAR) AS parent, 'S' AS kind, 'brand' AS level, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS VARCHAR) AS gene FROM r
    UNION ALL SELECT DISTINCT fam, d2, d1, 'D', NULL, NULL, NULL FROM r UNION ALL SELECT DISTINCT fam, d3, d2, 'S', 'type', NULL, NULL FROM r UNION ALL SELECT DISTINCT fam, d4, d3, 'D', NULL, NULL, NULL FROM r
    UNION ALL SELECT DISTINCT fam, d5, d4, 'S', 'size', CAST(split_part(n5, '/', 5) AS DOUBLE) / 50, NULL FROM r UNION ALL SELECT fam, d5 || '/g' || b6, d5, 'L', NULL, NULL, 'P<&"' || gene FROM r""")
def document_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """All groups of parts written as one document of several files, and read from it again."""
    folder = shared_folder(spark)
    lines = trees.group_document(part_genes(spark, d), trees.group_xml(part_rows(spark, d)), "<taxonomy></taxonomy>")
    trees.write_document(lines, folder)
    return trees.read_groups(spark, folder, whole=True).select("fam", "node", "parent", "kind", "level", "score", "gene")


@query("""WITH a AS (SELECT CAST(p_size % 2 AS INTEGER) AS file, p_partkey // 2 AS id, 'P' || p_partkey // CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS prot FROM part),
    b AS (SELECT DISTINCT file, id, prot FROM a), o AS (SELECT id, arg_min(prot, (file, prot)) AS owner FROM b GROUP BY id),
    n AS (SELECT file, prot, (SELECT max(id) FROM b) + row_number() OVER (ORDER BY file, prot) AS fresh FROM (SELECT DISTINCT file, prot FROM b JOIN o USING (id) WHERE prot <> owner))
    SELECT file, id, prot, CAST(CASE WHEN prot = owner THEN id ELSE fresh END AS BIGINT) AS new_id FROM b JOIN o USING (id) LEFT JOIN n USING (file, prot)""")
def merged_gene_ids(spark: SparkSession, d: str) -> DataFrame:
    """Parts of even and of odd size as two files that use the same ids for other proteins."""
    key, size = F.col("p_partkey"), F.col("p_size")
    prot = F.concat(F.lit("P"), F.floor(key / F.when(key % 3 == 0, 2).otherwise(1)).cast("string"))
    files = [table(spark, d, "part").where(size % 2 == k).select(F.floor(key / 2).cast("long").alias("id"), prot.alias("prot")).distinct() for k in (0, 1)]
    return trees.merge_genes(files)


@query(f"""WITH {PARTS_SQL}, h AS (SELECT n3 AS holder, n4, n5, gene FROM p) SELECT DISTINCT holder, n4 AS node, 'D' AS kind FROM h UNION ALL SELECT DISTINCT holder, n5, 'S' FROM h UNION ALL SELECT holder, 'L' || gene, 'L' FROM h""")
def rows_below_types(spark: SparkSession, d: str) -> DataFrame:
    rows = part_rows(spark, d)
    return selections.below(rows, selections.groups_at_levels(rows, spark.createDataFrame([("type",)], "level string"))).select("holder", "node", "kind")


@query(f"""WITH {PARTS_SQL}, w AS (SELECT unnest([n1, n2, n3, n4, n5]) AS node, unnest(['S', 'D', 'S', 'D', 'S']) AS kind, unnest(['brand', NULL, 'type', NULL, 'size']) AS level, unnest([1, 2, 3, 4, 5]) AS rank, gene FROM p WHERE gene % 7 = 3)
    SELECT CAST(gene AS VARCHAR) AS gene, node, kind, level, CAST(rank AS BIGINT) AS rank FROM w""")
def groups_of_genes(spark: SparkSession, d: str) -> DataFrame:
    """All groups around the parts whose number leaves 3 by 7."""
    wanted = table(spark, d, "part").where("p_partkey % 7 = 3").select(F.col("p_partkey").cast("string").alias("gene"))
    return selections.groups_of_genes(part_rows(spark, d), wanted)


@query(f"""WITH {PARTS_SQL} SELECT fam, count(DISTINCT species) AS n_species, count(*) AS n_genes FROM p JOIN g ON g.node = n1 WHERE species IN (1, 4, 9) AND p.gene % 2 = 1 GROUP BY fam HAVING count(DISTINCT species) = 3""")
def families_of_species(spark: SparkSession, d: str) -> DataFrame:
    """Families with described genes (odd numbers) of three species."""
    asked = spark.createDataFrame([("s1",), ("s4",), ("s9",), (None,)], "species string")
    return selections.families_of_species(part_rows(spark, d), part_genes(spark, d).where("id % 2 = 1"), asked, every=True)


@query("""SELECT 's' || p_partkey % 25 AS species, p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 0 ELSE 1 END AS n_places FROM part WHERE p_partkey % 25 = 6""")
def gene_uses(spark: SparkSession, d: str) -> DataFrame:
    """The genes of a species, and how often groups name them, where groups of sizes that 3 divides are left out."""
    rows = part_rows(spark, d)
    kept = rows.where("kind <> 'L' or cast(substring_index(parent, '/', -1) as int) % 3 <> 0")
    return selections.gene_uses(kept, selections.input_genes(part_genes(spark, d), "s6")).select("species", "id", F.col("n_places").cast("int").alias("n_places"))


@query(f"""{COMPONENTS}, n AS (SELECT root_s, count(*) AS n FROM hits WHERE hit_rank = 1 GROUP BY root_s), put AS (
    SELECT root_s, component, coalesce(sum(n) OVER (PARTITION BY component ORDER BY root_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM n JOIN parts ON node = root_s),
    w AS (SELECT root_s, CASE WHEN b < 300 THEN component ELSE root_s END AS host FROM put), m AS (SELECT coalesce(host, root_s) AS host, prot, root_s FROM hits LEFT JOIN w USING (root_s))
    SELECT host, prot, NOT bool_or(host = root_s) AS is_new FROM m GROUP BY host, prot""")
def merged_members(spark: SparkSession, d: str) -> DataFrame:
    """All hits of proteins under the families that these are merged into, each protein once a family."""
    return families.merged_members(domain.hits(spark, d), capped_merge(spark, d), "root_s", "prot")


@query("""SELECT c_custkey, n_name, 1000000000 + (dense_rank() OVER (ORDER BY n_name) - 1) * 1000000 + row_number() OVER (PARTITION BY n_name ORDER BY c_custkey) AS numeric_id FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def species_numeric_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of customers whose species are numbered by the names of nations."""
    who = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return proteins.numeric_ids(proteins.species_index(who, "n_name"), "n_name", "species_index", "c_custkey").select("c_custkey", "n_name", "numeric_id")


@query(f"""WITH {PARTS_SQL}, d1 AS (SELECT node, row_number() OVER (PARTITION BY fam ORDER BY ord) AS n FROM g WHERE kind = 'D' AND parent NOT IN (SELECT node FROM g WHERE level = 'type')),
    l3 AS (SELECT g.node, printf('HOG:%07d', fam) || '.' || n || chr(CAST(97 + place AS INTEGER)) AS id FROM g JOIN d1 ON g.parent = d1.node)
    SELECT node, printf('HOG:%07d', fam) || '_' || (SELECT r_regionkey FROM region WHERE r_regionkey = 1) AS hog_id FROM g WHERE level = 'brand' UNION ALL SELECT node, id FROM l3""")
def taxon_named_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of brands and types with the ids of their levels, of which the table of names has only that of brands."""
    groups, _ = domain.part_groups(spark, d)
    taxa = table(spark, d, "region").where("r_regionkey = 1").select(F.lit("brand").alias("name"), F.col("r_regionkey").alias("id"))
    upper = hierarchy.with_taxon_ids(groups, taxa)
    return intervals.duplication_ids(intervals.encode(upper), "taxon").join(groups.where("level <> 'size'").select("node"), "node", "left_semi")


@query(f"""WITH {CELLS_SQL}, n AS (SELECT * FROM cells WHERE "group" % 2 = 0 OR place < 40), c AS (SELECT "group", place, avg(CAST(is_gap AS INTEGER)) AS g FROM n GROUP BY 1, 2), one AS (
    SELECT n.* FROM n JOIN c USING ("group", place) WHERE "group" % 2 = 1 OR g < 0.5), r AS (SELECT "group", member, avg(1 - CAST(is_gap AS INTEGER)) AS v FROM one GROUP BY 1, 2), two AS (
    SELECT one.* FROM one JOIN r USING ("group", member) WHERE "group" % 2 = 1 OR v >= 0.45), w AS (SELECT "group", bool_and(v >= 0.45) AS w FROM r GROUP BY 1), e AS (
    SELECT "group", place, bool_and(is_gap) AS e FROM two GROUP BY 1, 2)
    SELECT "group", member, count(*) AS n_columns, CAST(sum(place) AS BIGINT) AS places FROM two JOIN w USING ("group") JOIN e USING ("group", place) WHERE "group" % 2 = 1 OR w OR NOT e GROUP BY 1, 2""")
def narrow_alignments(spark: SparkSession, d: str) -> DataFrame:
    """Alignments of 64 columns, which are filtered, beside alignments of 40, which are too narrow for that."""
    cells = domain.cells(spark, d).where("group % 2 = 0 or place < 40")
    kept = alignment.filter_alignment(cells, residue_ratio_row=0.45)
    return kept.groupBy("group", "member").agg(F.count("*").alias("n_columns"), F.sum("place").alias("places"))
