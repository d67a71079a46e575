"""File formats: readers of split files, trees, documents of groups and what goes with them."""

import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from kinloom.operators import alignment, checks, clustering, families, hierarchy
from kinloom.sources import text, trees


def test_split_placement_files_keep_their_order(spark, tmp_path):
    lines = ["!comment", "qseqid\thogid\thoglevel\tfamily_p"] + [f"p{i % 50}\tHOG:E{i}.1a\tL\t{i}" for i in range(3000)]
    (tmp_path / "X.fa.hogmap").write_text("\r\n".join(lines) + "\r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        read = text.read_placements(spark, str(tmp_path / "X.fa.hogmap"))
        assert spark.read.text(str(tmp_path / "X.fa.hogmap")).rdd.getNumPartitions() > 1
        got = {(r["prot_id"], r["hit_rank"]): r["root_id"] for r in read.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {(f"p{i % 50}", i // 50 + 1): f"E{i}" for i in range(3000)}


def test_listing_and_clusters(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "HOG_1.fa").write_text(">a\nMK\n")
    assert [(r["stem"], r["size"]) for r in text.list_files(spark, str(tmp_path)).collect()] == [("HOG_1", 6)]
    (tmp_path / "c.txt").write_text(">a\n>a x\nMK\n>b\nMV\n>c\n>c\nMM\n")
    got = sorted((r["cluster"], r["member"]) for r in text.read_clusters(spark, str(tmp_path / "c.txt")).collect())
    assert got == [("c/1", "a x"), ("c/1", "b")]


def test_names_and_pruning():
    table = trees.newick_rows("((A:1,B:2)in:1,((C:1,D:1)same node:1,(E:1,F:1)same:2)samenode:1)ab;")
    named = trees.checked_names(table)
    assert [r[2] for r in named] == ["internal_1", "internal_0", "A", "B", "samenode", "samenode_1", "C", "D", "same", "E", "F"] or [r[2] for r in named][0].startswith("internal_")
    assert len({r[2] for r in named}) == len(named) and all(len(r[2]) >= 3 for r in named if any(x[1] == r[0] for x in named))
    cut = trees.pruned(table, {"A", "E", "F"})
    assert trees.write_newick(cut) in ("(A:2,(E:1,F:1)same:3)ab:0;", "(A:2,(E:1,F:1)same:3)ab;")
    assert trees.pruned(table, set()) == []
    assert trees.taxonomy_xml(trees.newick_rows("((A,B)x,C)r;")).count("<taxon ") == 5


def test_comments_and_phyloxml(spark, tmp_path):
    notes = {}
    assert [r[2] for r in trees.newick_rows("((A:1[&&NHX:S=a:B=9],B:1)[&&NHX:Ev=D]:2[plain],C)r;", notes)] == ["r", None, "A", "B", "C"]
    assert notes == {3: {"S": "a", "B": "9"}, 2: {"Ev": "D"}}
    xml = "<phyloxml xmlns='http://x'><phylogeny><clade><name>r</name><clade branch_length='2'><taxonomy><code>A</code></taxonomy></clade><clade><name>x</name><branch_length>1.5</branch_length><clade><name>B</name></clade></clade></clade></phylogeny></phyloxml>"
    (tmp_path / "t.xml").write_text(xml)
    got = [tuple(r) for r in trees.read_newick(spark, str(tmp_path / "t.xml")).orderBy("node").collect()]
    assert got == [(1, None, "r", None, 0), (2, 1, "A", 2.0, 0), (3, 1, "x", 1.5, 1), (4, 3, "B", None, 0)]


GROUPS = [
    (7, "t", None, "S", "root", 0.75, None, 1), (7, "d", "t", "D", None, None, None, 0), (7, "g1", "d", "L", None, None, "1", 0), (7, "g2", "d", "L", None, None, "2", 1), (7, "g3", "t", "L", None, None, "3", 1),
    (8, "u", None, "S", None, None, None, 2), (8, "h1", "u", "L", None, None, "4", 0), (8, "h2", "u", "L", None, None, "5", 1),
]


def test_documents_of_groups(spark, tmp_path):
    groups = spark.createDataFrame(GROUPS, trees.GROUPS)
    genes = spark.createDataFrame([(f"s{i % 2}", i, f'p"{i}<&') for i in range(1, 7)], "species string, id long, prot string")
    newick = {r["fam"]: r["newick"] for r in trees.group_newick(groups).collect()}
    assert newick == {7: "((1,2)[&&NHX:Ev=duplication],3)[&&NHX:S=root];", 8: "(4,5);"}
    kept = trees.genes_of(trees.select_families(groups, spark.createDataFrame([(7,)], "fam long")), genes)
    assert sorted(r["id"] for r in kept.collect()) == [1, 2, 3]
    taxonomy = trees.taxonomy_xml(trees.newick_rows("(s0,s1)root;"))
    trees.write_document(trees.group_document(genes, trees.group_xml(groups), taxonomy), str(tmp_path / "doc"))
    whole = "\n".join(p.read_text() for p in sorted((tmp_path / "doc").glob("part-*")))
    document = ET.fromstring(whole.strip().encode())
    tags = [e.tag.rpartition("}")[2] for e in document]
    assert tags == ["species", "species", "taxonomy", "scores", "groups"] and len(document.findall(".//{*}gene")) == 6
    (tmp_path / "one.xml").write_text(whole.strip())
    back = trees.read_groups(spark, str(tmp_path / "one.xml"))
    assert sorted(r["gene"] for r in back.where("kind = 'L'").collect()) == [f'p"{i}<&' for i in range(1, 6)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        split = trees.read_groups(spark, str(tmp_path / "one.xml"))
        assert sorted(map(str, split.collect())) == sorted(map(str, back.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    kinds = {(r["fam"], r["node"], r["parent"], r["kind"], r["level"], r["score"]) for r in back.where("kind <> 'L'").collect()}
    assert kinds == {(1, "1", None, "S", "root", 0.75), (1, "1/0", "1", "D", None, None), (2, "2", None, "S", None, None)}
    (tmp_path / "old.xml").write_text('<orthoXML version="0.3"><groups></groups></orthoXML>')
    with pytest.raises(ValueError, match="0.3"):
        trees.read_groups(spark, str(tmp_path / "old.xml"))
    trees.write_families(groups, str(tmp_path / "by"))
    assert sorted(p.name for p in (tmp_path / "by").glob("fam=*")) == ["fam=7", "fam=8"]
    merged = trees.merge_groups([back, back])
    assert merged.select("fam").distinct().count() == 4 and merged.select("node").distinct().count() == 2 * back.count()


def test_merged_genes_keep_ids_apart(spark):
    one, two = ([(1, "a"), (2, "b")], [(1, "a"), (2, "c"), (3, "d")])
    got = trees.merge_genes([spark.createDataFrame(x, "id long, prot string") for x in (one, two)]).collect()
    new = {(r["file"], r["prot"]): r["new_id"] for r in got}
    assert new[0, "a"] == new[1, "a"] == 1 and new[0, "b"] == 2 and new[1, "d"] == 3 and new[1, "c"] == 4


def test_written_families_and_tables(spark, tmp_path):
    members = spark.createDataFrame([("F1", "p1", "s"), ("F1", "p2", "s"), ("F2", "p3", "s")], "root_id string, prot_id string, species string")
    proteins = spark.createDataFrame([(f"p{i}", "MKV") for i in range(1, 4)], "prot_id string, seq string")
    kept = families.with_sequences(members, proteins, ["prot_id"], 2, "root_id")
    text.write_fasta(kept, str(tmp_path / "fa"), ["root_id"], "gzip")
    back = spark.read.text(str(tmp_path / "fa"))
    assert {(r["root_id"], r["value"]) for r in back.collect()} == {("F1", ">p1 [s]"), ("F1", ">p2 [s]"), ("F1", "MKV")}
    text.write_table(members, str(tmp_path / "t"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).count() == 3


def test_bootstrap_and_back_translation(spark):
    msa = spark.createDataFrame([("g", "a", "ACDE"), ("g", "b", "AC-E")], "g string, m string, s string")
    cells = alignment.long_form(msa, "g", "m", "s")
    drawn = alignment.bootstrap_columns(cells, 30, seed=3)
    assert drawn.count() == 30 * 8 and sorted(map(str, drawn.collect())) == sorted(map(str, alignment.bootstrap_columns(cells, 30, seed=3).collect()))
    own = {(r["member"], r["place"]): r["residue"] for r in cells.collect()}
    pairs = {}
    for r in drawn.collect():
        pairs.setdefault((r["replicate"], r["place"]), {})[r["member"]] = r["residue"]
    assert all((p["a"], p["b"]) in {(own["a", i], own["b", i]) for i in range(4)} for p in pairs.values())
    residues = spark.range(4000).select(F.lit("s").alias("seq"), F.col("id").alias("at"), F.lit("k").alias("residue"))
    codons = spark.createDataFrame([("K", "AAA", 3.0), ("K", "AAG", 1.0), ("M", "ATG", 1.0)], "residue string, codon string, weight double")
    counts = {r["codon"]: r["count"] for r in alignment.back_translate(residues, codons, "seq", "at").groupBy("codon").count().collect()}
    assert sum(counts.values()) == 4000 and 0.7 < counts["AAA"] / 4000 < 0.8
    assert sorted((r["group"], r["member"]) for r in alignment.removed_rows(cells, cells.where("member = 'a'")).collect()) == [("g", "b")]
    assert alignment.elbow(alignment.column_gaps(cells), 0.5).first()["elbow"] == 0.5


def test_levels_and_events(spark):
    tree = spark.createDataFrame([("r", None), ("x", "r"), ("A", "x"), ("B", "x"), ("C", "r")], "node string, parent string")
    up = hierarchy.closure(tree)
    assert hierarchy.level_of_interest(tree, up) == "x"
    assert {(r["node"], r["parent"]) for r in hierarchy.taxonomy_of(up).collect()} == {(r["node"], r["parent"]) for r in tree.collect()}
    labelled = hierarchy.groups_at_level(spark.createDataFrame([("A", 1)], "node string, gene int"), tree, up, F.col("node") == "x", F.upper("node"))
    assert [tuple(r) for r in labelled.collect()] == [("x", 1, "X")]
    try:
        hierarchy.closure(spark.createDataFrame([("a", "b"), ("b", "a")], "node string, parent string"))
    except ValueError:
        pass
    else:
        raise AssertionError("a cycle went unnoticed")
    one = hierarchy.species_overlap(spark.createDataFrame([("n", 1, "A"), ("m", 1, "A"), ("m", 2, "A")], "node string, child int, species string"), "node", "child", "species")
    assert [(r["node"], r["kind"]) for r in one.collect()] == [("m", "D")]
    linked = clustering.word_clusters(spark.createDataFrame([(1, "a b c d e f g"), (2, "b c d e f x y"), (3, "c d e f x q")], "id int, t string"), "id", "t", size=4, least=2)
    assert {(r["id"], r["cluster"]) for r in linked.collect()} == {(1, 1), (2, 1), (3, 1)}


def test_tree_problems_of_empty_tables(spark):
    tree = spark.createDataFrame([], "node string, parent string, name string")
    assert checks.tree_checks(tree, spark.createDataFrame([("A",)], "species string")).collect()[0]["problem"] == "missing"
