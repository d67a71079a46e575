"""Deep documents, merged files with new ids, cluster files in parts, headers with descriptions, placements of changed tables."""

import pytest
from pyspark.sql import functions as F

from kinloom.plans import domain
from kinloom.sources import text, trees

GROUPS = "fam long, node string, parent string, kind string, level string, score double, gene string, ord long"


def test_deep_groups_are_written(spark):
    rows = [(1, f"n{i}", f"n{i - 1}" if i else None, "S", None, None, None, i) for i in range(3000)] + [(1, "leaf", "n2999", "L", None, None, "g<1>", 3000)]
    xml = trees.group_xml(spark.createDataFrame(rows, GROUPS)).first()["xml"]
    assert xml.count("<orthologGroup>") == xml.count("</orthologGroup>") == 3000 and '<geneRef id="g&lt;1&gt;"/>' in xml


def test_merged_files_have_new_ids_and_families(spark):
    file = lambda genes: spark.createDataFrame([(7, "a", None, "S", "r", 1.0, None, 1), (9, "b", None, "S", "r", 1.0, None, 1), *[(7, f"l{k}", "a", "L", None, None, g, k + 2) for k, g in enumerate(genes)]], GROUPS)
    one, two = file(["p", "q"]), file(["q", "z"])
    ids = trees.merge_genes([spark.createDataFrame(x, "id long, prot string") for x in ([(1, "p"), (2, "q")], [(2, "q"), (1, "z")])])
    new = {(r["file"], r["prot"]): r["new_id"] for r in ids.collect()}
    assert new[0, "p"] == 1 and new[0, "q"] == new[1, "q"] == 2 and new[1, "z"] not in (1, 2)
    many = [spark.createDataFrame([(i, f"{k}-{i}") for i in range(50)] + [(50, None)], "id long, prot string") for k in range(3)]
    all_ = trees.merge_genes(many).collect()
    assert len(all_) == 153 and sorted({r["new_id"] for r in all_}) == list(range(151)) and {r["new_id"] for r in all_ if r["prot"] is None} == {50}
    out = trees.merge_groups([one, two], ids)
    assert out.columns == one.columns
    assert {(r["fam"], r["gene"]) for r in out.where("kind = 'L'").collect()} == {(1, "1"), (1, "2"), (3, "2"), (3, str(new[1, "z"]))}
    assert sorted(r["fam"] for r in out.where("kind = 'S'").collect()) == [1, 2, 3, 4]
    plain = trees.merge_groups([one, two])
    assert {r["gene"] for r in plain.where("kind = 'L'").collect()} == {"p", "q", "z"}


def plain_clusters(lines):
    out, number = [], 0
    for i, x in enumerate(lines):
        if x.startswith(">"):
            if i + 1 < len(lines) and lines[i + 1].startswith(">"):
                number += 1
            else:
                out.append((number, x[1:]))
    return out


@pytest.mark.parametrize("part", ["128m", "40"])
def test_cluster_files_are_read_in_parts(spark, tmp_path, part):
    lines = []
    for c in range(12):
        lines += [f">c{c}m0"] + [x for m in range(c % 4 + 1) for x in (f">c{c}m{m}|s{(c * m) % 3}", "ACDEFG" * (m + 1))]
    (tmp_path / "all.txt").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", part)
    try:
        want = plain_clusters(lines)
        sizes = {c: sum(x == c for x, _ in want) for c, _ in want}
        got = text.read_clusters(spark, str(tmp_path / "all.txt")).collect()
        assert sorted((r["cluster"], r["member"]) for r in got) == sorted((f"all/{c}", m) for c, m in want if sizes[c] > 1)
        several = {c for c in sizes if len({m.split("|")[1] for x, m in want if x == c}) > 1}
        kept = text.read_clusters(spark, str(tmp_path / "all.txt"), species=F.split("member", r"\|")[1]).collect()
        assert {r["cluster"] for r in kept} == {f"all/{c}" for c in several} and several != set(sizes)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_headers_list_minor_isoforms(spark, tmp_path):
    rows = [("p1", "A", "ACD", "p2,p3", 1), ("p4", "A", "AC", "", 1), ("p5", None, "A", None, 1)]
    text.write_fasta(spark.createDataFrame(rows, "prot_id string, species string, seq string, minor string, fam int"), str(tmp_path / "out"), ["fam"], description="minor")
    lines = [r[0] for r in spark.read.text(str(tmp_path / "out")).select("value").collect()]
    assert sorted(x for x in lines if x.startswith(">")) == [">p1 [A] p2,p3", ">p4 [A]", ">p5 []"]


def test_placements_follow_the_files(spark, tmp_path):
    def write(prices):
        spark.createDataFrame([(1, k, 5, 3, p, 1.0, "1998-01-01") for k, p in enumerate(prices)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_shipdate string").write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")

    spark.createDataFrame([(1, 2)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(2, 4)], "c_custkey long, c_nationkey long").write.parquet(f"{tmp_path}/customer.parquet")
    write([1000.0])
    assert [r["score"] for r in domain.hits(spark, str(tmp_path)).collect()] == [1.0]
    write([3000.0, 2000.0])
    assert sorted(r["score"] for r in domain.hits(spark, str(tmp_path)).collect()) == [2.0, 3.0]


def test_spent_tables_are_deleted_and_others_stay(spark, tmp_path):
    import os

    from kinloom.operators.graph import discard, materialised

    kept, spent = materialised(spark.range(5)), materialised(spark.range(7))
    folder = lambda df: df.inputFiles()[0].rpartition("/")[0].partition("://")[2].replace("//", "/")
    where = folder(spent)
    spark.range(3).write.parquet(f"{tmp_path}/own")
    discard(spent, spark.read.parquet(f"{tmp_path}/own"))
    assert not os.path.exists(where) and kept.count() == 5 and spark.read.parquet(f"{tmp_path}/own").count() == 3
