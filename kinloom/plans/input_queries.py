"""Registered queries of input checks, ids, isoforms, joins with sequences, and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions import ids
from kinloom.operators import checks, families, hierarchy, proteins, report
from kinloom.plans import domain, queries
from kinloom.plans.domain import HITS_SQL, TREE_SQL, table
from kinloom.plans.queries import FIRST, ISOFORMS, query


@query("""SELECT count(*) AS n_files, count(DISTINCT regexp_extract(f, '\\.([^.]+)$', 1)) AS n_extensions, count(*) >= 3 AND count(DISTINCT regexp_extract(f, '\\.([^.]+)$', 1)) = 1 AS passes
    FROM (SELECT n_name || CASE WHEN n_nationkey % 7 = 3 THEN '.txt' ELSE '.fa' END AS f FROM nation) WHERE regexp_extract(f, '\\.([^.]+)$', 1) IN ('fa', 'fasta')""")
def file_checks(spark: SparkSession, d: str) -> DataFrame:
    ending = F.when(F.col("n_nationkey") % 7 == 3, ".txt").otherwise(".fa")
    return checks.file_checks(table(spark, d, "nation").select(F.concat("n_name", ending).alias("f")), "f")


@query(f"""WITH {TREE_SQL}, t AS (SELECT node, parent, CASE WHEN node = 'R1' THEN NULL WHEN node = 'R2' THEN 'R0' WHEN node = 'N3' THEN 'N2' ELSE node END AS name FROM tree),
    i AS (SELECT * FROM t WHERE node IN (SELECT parent FROM t)), l AS (SELECT * FROM t WHERE node NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL)), s AS (SELECT DISTINCT 'N' || s_nationkey % 30 AS name FROM supplier)
    SELECT 'unnamed' AS problem, CAST(NULL AS VARCHAR) AS name, count(*) AS n FROM i WHERE name IS NULL HAVING count(*) > 0 UNION ALL SELECT 'repeated inner', name, count(*) FROM i WHERE name IS NOT NULL GROUP BY name HAVING count(*) > 1
    UNION ALL SELECT 'repeated leaf', name, count(*) FROM l GROUP BY name HAVING count(*) > 1 UNION ALL SELECT 'missing', name, 1 FROM s WHERE name NOT IN (SELECT name FROM l)
    UNION ALL SELECT DISTINCT 'extra', name, 1 FROM l WHERE name NOT IN (SELECT name FROM s)""")
def tree_checks(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("node") == "R2", "R0").when(F.col("node") == "N3", "N2").when(F.col("node") != "R1", F.col("node"))
    species = table(spark, d, "supplier").select(F.concat(F.lit("N"), (F.col("s_nationkey") % 30).cast("string")).alias("species"))
    return checks.tree_checks(domain.species_tree(spark, d).withColumn("name", name), species)


@query("""WITH g AS (SELECT c_nationkey, o_custkey, count(*) AS k FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
    SELECT c_nationkey, count(*) FILTER (k > 1) AS n_genes, CAST(coalesce(sum(k) FILTER (k > 1), 0) AS BIGINT) AS n_isoforms FROM g GROUP BY 1""")
def splice_counts(spark: SparkSession, d: str) -> DataFrame:
    owned = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return checks.splice_counts(owned, "c_nationkey", "o_custkey")


@query(f"""WITH {HITS_SQL}, k AS (SELECT prot, count(*) AS k FROM hits GROUP BY prot) SELECT c_nationkey, count(*) AS n_proteins, count(k) AS n_mapped, count(*) - count(k) AS n_unmapped,
    CAST(coalesce(sum(k), 0) AS BIGINT) AS n_hits FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN k ON prot = o_orderkey GROUP BY 1""")
def mapping_counts(spark: SparkSession, d: str) -> DataFrame:
    owned = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumnRenamed("o_orderkey", "prot")
    return checks.mapping_counts(owned, domain.hits(spark, d), "prot", "c_nationkey")


@query("""SELECT source, max(n_chars) AS largest, CASE WHEN max(n_chars) < 5000 THEN 'small' WHEN max(n_chars) < 20000 THEN 'medium' ELSE 'huge' END AS size_class FROM documents GROUP BY source""")
def size_classes(spark: SparkSession, d: str) -> DataFrame:
    return checks.size_classes(table(spark, d, "documents"), "source", "n_chars", ((5000, "small"), (20000, "medium")))


@query("""SELECT p_partkey, 'P' || p_partkey AS protein, substr(p_type, 1, 5) AS species, CAST(p_size AS VARCHAR) AS number, left('P' || p_partkey || '||' || substr(p_type, 1, 5) || '||' || p_size, 230) AS short,
    NOT regexp_matches(upper(p_name), '[^ACGTRYSWKMBDHVN?X-]') AS dna, regexp_matches(p_type, '^[A-Z][A-Z0-9]{4}') AS code FROM part""")
def header_parts(spark: SparkSession, d: str) -> DataFrame:
    header = F.concat(F.lit("P"), F.col("p_partkey").cast("string"), F.lit("||"), F.substring("p_type", 1, 5), F.lit("||"), F.col("p_size").cast("string"))
    parts = [c.alias(n) for n, c in ids.header_parts(header).items()]
    return table(spark, d, "part").select("p_partkey", *parts, ids.is_dna(F.col("p_name")).alias("dna"), ids.is_species_code(F.col("p_type")).alias("code"))


@query("""SELECT p_brand, 'G' || p_size AS gene, count(*) AS n, string_agg(CAST(p_partkey AS VARCHAR), ';' ORDER BY CAST(p_partkey AS VARCHAR)) AS proteins FROM part WHERE p_size % 5 <> 0 GROUP BY p_brand, p_size HAVING count(*) > 1""")
def splice_lists(spark: SparkSession, d: str) -> DataFrame:
    named = F.when(F.col("p_size") % 5 != 0, F.concat(F.lit("pep chromosome:1 gene:G"), F.col("p_size").cast("string"), F.lit(" transcript:T"))).otherwise("pep chromosome:1")
    return checks.splice_lists(table(spark, d, "part").withColumn("description", named), "p_brand", "p_partkey", "description")


@query(f"WITH {HITS_SQL} SELECT prot, hit_rank, root_f FROM hits WHERE prot IN (SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000)")
def known_hits(spark: SparkSession, d: str) -> DataFrame:
    passed = table(spark, d, "orders").where("o_totalprice >= 100000").select(F.col("o_orderkey").alias("prot"))
    return families.known_hits(domain.hits(spark, d), passed, "prot").select("prot", "hit_rank", "root_f")


@query(f"""{FIRST}, m AS (SELECT prot, root_f, o_totalprice FROM firsts JOIN orders ON o_orderkey = prot)
    SELECT prot, root_f, o_totalprice FROM m WHERE root_f IN (SELECT root_f FROM m GROUP BY root_f HAVING count(*) >= 2)""")
def member_sequences(spark: SparkSession, d: str) -> DataFrame:
    sequences = table(spark, d, "orders").select(F.col("o_orderkey").alias("prot"), "o_totalprice")
    return families.with_sequences(families.first_hits(domain.hits(spark, d)).select("prot", "root_f"), sequences, ["prot"], 2, "root_f")


@query(f"""{ISOFORMS}, ids AS (SELECT o_orderkey AS main, 1000000000 + c_nationkey * 1000000 + row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderkey) AS numeric_id FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT i.prot, r.prot AS main, numeric_id FROM i JOIN r ON i.gene = r.gene AND r.r = 1 JOIN ids ON main = r.prot""")
def gene_id_mapping(spark: SparkSession, d: str) -> DataFrame:
    owned = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    numbers = proteins.numeric_ids(owned.select("c_nationkey", F.col("o_orderkey").alias("prot")), "c_nationkey", "c_nationkey", "prot")
    forms = owned.select(F.col("o_custkey").alias("gene"), F.col("o_orderkey").alias("prot"))
    return families.gene_id_mapping(forms, queries.best_isoform(spark, d), numbers, "gene", "prot")


@query(f"""{ISOFORMS} SELECT gene, max(prot) FILTER (r = 1) AS prot, coalesce(string_agg(CAST(prot AS VARCHAR), ',' ORDER BY prot) FILTER (r > 1), '') AS minor FROM r GROUP BY gene""")
def minor_isoforms(spark: SparkSession, d: str) -> DataFrame:
    forms = table(spark, d, "orders").select(F.col("o_custkey").alias("gene"), F.col("o_orderkey").alias("prot"))
    return families.minor_isoforms(forms, queries.best_isoform(spark, d), "gene", "prot")


@query(f"""{FIRST}, n AS (SELECT root_f, count(*) AS n FROM firsts GROUP BY root_f) SELECT count(*) AS n_families, count(*) FILTER (n.n = 1) AS n_single, count(*) FILTER (n.n <> 1) AS n_several,
    CAST(coalesce(sum(n.n) FILTER (n.n <> 1), 0) AS BIGINT) AS n_in_several FROM n""")
def singleton_counts(spark: SparkSession, d: str) -> DataFrame:
    return families.singleton_counts(queries.first_hit_families(spark, d), "n_members")


@query(f"""WITH {HITS_SQL}, m AS (SELECT DISTINCT root_s, part FROM hits) SELECT a.root_s AS group_a, b.root_s AS group_b, count(*) AS shared FROM m a JOIN m b ON a.part = b.part AND a.root_s < b.root_s GROUP BY 1, 2""")
def overlapping_groups(spark: SparkSession, d: str) -> DataFrame:
    return families.overlapping_groups(domain.hits(spark, d), "root_s", "part")


@query(f"WITH {HITS_SQL} SELECT part, min(prot) AS first FROM hits GROUP BY part")
def first_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return families.first_occurrences(domain.hits(spark, d), "part", "prot").withColumnRenamed("first", "first")


@query("""WITH c AS (SELECT c_custkey AS g, c_custkey // 30 AS f, c_nationkey AS n, c_acctbal AS v FROM customer)
    SELECT least(a.n, b.n) AS part_a, greatest(a.n, b.n) AS part_b, count(*) AS n, round(avg(abs(a.v - b.v)), 6) AS mean FROM c a JOIN c b ON a.f = b.f AND a.g < b.g GROUP BY 1, 2""")
def partition_distances(spark: SparkSession, d: str) -> DataFrame:
    who = table(spark, d, "customer").select(F.col("c_custkey").alias("g"), F.floor(F.col("c_custkey") / 30).alias("f"), F.col("c_nationkey").alias("n"), F.col("c_acctbal").alias("v"))
    met = who.alias("a").join(who.alias("b"), (F.col("a.f") == F.col("b.f")) & (F.col("a.g") < F.col("b.g")))
    met = met.select(F.col("a.g").alias("a"), F.col("b.g").alias("b"), F.abs(F.col("a.v") - F.col("b.v")).alias("far"))
    return families.partition_distances(met, who, "a", "b", "g", "n", "far")


@query(f"""{FIRST}, n AS (SELECT root_f, CAST(count(*) AS DOUBLE) AS n FROM firsts GROUP BY root_f)
    SELECT {", ".join(f"round(quantile_cont(n.n, {p / 100}), 6) AS p{p}" for p in (10, 25, 50, 75, 90))} FROM n""")
def size_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return report.percentiles(queries.first_hit_families(spark, d), "n_members")


@query(f"""{FIRST}, a AS (SELECT root_f, count(*) AS v FROM firsts GROUP BY root_f), b AS (SELECT root_f, count(DISTINCT species) AS v FROM firsts GROUP BY root_f)
    SELECT root_f, a.v AS "left", b.v AS "right" FROM a JOIN b USING (root_f) WHERE a.v <> b.v""")
def count_mismatches(spark: SparkSession, d: str) -> DataFrame:
    both = queries.first_hit_families(spark, d)
    return report.mismatches(both.select("root_f", F.col("n_members").alias("v")), both.select("root_f", F.col("n_species").alias("v")), "root_f", "v")


@query(f"""{ISOFORMS}, f AS (SELECT root_f, prot FROM hits WHERE hit_rank = 1), big AS (SELECT prot FROM f WHERE root_f IN (SELECT root_f FROM f GROUP BY root_f HAVING count(*) > 1)), t AS (
    SELECT c_nationkey, r.r > 1 AS minor, b.prot IS NOT NULL AS grouped FROM r JOIN customer ON c_custkey = gene LEFT JOIN big b ON b.prot = r.prot)
    SELECT c_nationkey, count(*) AS n_proteins, count(*) FILTER (grouped AND NOT minor) AS n_in_group, count(*) FILTER (minor) AS n_minor, count(*) FILTER (NOT grouped AND NOT minor) AS n_single,
        round(count(*) FILTER (grouped AND NOT minor) / nullif(count(*) FILTER (NOT minor), 0), 4) AS fraction FROM t GROUP BY 1""")
def species_table(spark: SparkSession, d: str) -> DataFrame:
    firsts = families.first_hits(domain.hits(spark, d)).select("prot", "root_f")
    several = firsts.groupBy("root_f").count().where("count > 1").select("root_f")
    big = firsts.join(several, "root_f").select("prot").withColumn("grouped", F.lit(True))
    main = queries.best_isoform(spark, d).select("prot").withColumn("main", F.lit(True))
    owned = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", F.col("o_orderkey").alias("prot"))
    told = owned.join(big, "prot", "left").join(main, "prot", "left")
    return report.species_table(told, "c_nationkey", F.col("grouped").isNotNull(), F.col("main").isNull())


@query(f"""{FIRST} SELECT root_s, {", ".join(f"coalesce(string_agg(CAST(prot AS VARCHAR), ',' ORDER BY prot) FILTER (n_regionkey = {i}), 'NA') AS of_{i}" for i in range(5))}
    FROM firsts JOIN nation ON n_nationkey = species GROUP BY root_s""")
def composition_members(spark: SparkSession, d: str) -> DataFrame:
    firsts = families.first_hits(domain.hits(spark, d)).join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("species"))
    return report.composition_members(firsts, "root_s", "n_regionkey", "prot", list(range(5)))


@query(f"""{FIRST}, c AS (SELECT root_s AS "group", count(*) FILTER (species = 3) AS n_one, count(*) FILTER (species = 7) AS n_other FROM firsts GROUP BY 1)
    SELECT *, CASE WHEN n_other = 0 THEN 'lost' WHEN n_one = 0 THEN 'gained' ELSE 'both' END AS event FROM c WHERE n_one + n_other > 0""")
def lateral_comparison(spark: SparkSession, d: str) -> DataFrame:
    return report.lateral_comparison(families.first_hits(domain.hits(spark, d)), "root_s", "species", 3, 7)


@query(f"""WITH {TREE_SQL}, p AS (SELECT 'WORLD' AS node, ['WORLD'] AS path, 0 AS depth UNION ALL SELECT 'R' || r_regionkey, ['WORLD', 'R' || r_regionkey], 1 FROM region
    UNION ALL SELECT 'N' || n_nationkey, ['WORLD', 'R' || n_regionkey, 'N' || n_nationkey], 2 FROM nation)
    SELECT node, CAST(row_number() OVER (ORDER BY path) AS INTEGER) AS pre, CAST(row_number() OVER (ORDER BY list_append(path, chr(1114111))) AS INTEGER) AS post, CAST(row_number() OVER (ORDER BY depth, path) AS INTEGER) AS by_level FROM p""")
def traversals(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.traversals(domain.species_tree(spark, d), queries.taxon_closure(spark, d))


@query("SELECT min(c) AS level FROM (SELECT 'R' || n_regionkey AS c, count(*) AS n FROM nation GROUP BY 1) WHERE n = (SELECT max(k) FROM (SELECT count(*) AS k FROM nation GROUP BY n_regionkey))")
def level_of_interest(spark: SparkSession, d: str) -> DataFrame:
    level = hierarchy.level_of_interest(domain.species_tree(spark, d), queries.taxon_closure(spark, d), share=0.2)
    return spark.range(1).select(F.lit(level).alias("level"))


@query(f"WITH {TREE_SQL} SELECT node, parent FROM tree")
def taxonomy_of(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.taxonomy_of(queries.taxon_closure(spark, d))
