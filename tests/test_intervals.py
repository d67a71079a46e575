"""Nested groups as intervals against the same operators over closures, on random forests, by both ways of numbering."""

import random

import pytest
from pyspark.sql import functions as F

from kinloom.operators import hierarchy, intervals
from kinloom.operators.graph import materialised

SCHEMA = "fam long, node string, parent string, kind string, level string, ord int, place int"


def forest(seed, n=60, families=4):
    """Random families; the last is a chain."""
    r = random.Random(seed)
    rows, genes = [], []
    for fam in range(1, families + 1):
        size = 1 if fam == 2 else 12 if fam == families else n
        kids = {}
        for i in range(size):
            up = None if i == 0 else (i - 1 if fam == families else r.randrange(i))
            kids.setdefault(up, []).append(i)
        order, stack = {}, [0]
        while stack:
            i = stack.pop()
            order[i] = len(order) + 1
            stack += reversed(kids.get(i, []))
        for up, below in kids.items():
            for place, i in enumerate(below):
                kind = "S" if i == 0 else r.choice("SSD")
                rows.append((fam, f"f{fam}n{i:03}", None if up is None else f"f{fam}n{up:03}", kind, r.choice("xyz"), order[i], place))
    for k in range(3 * n):
        fam, node, *_ = r.choice(rows)
        genes.append((node, f"g{k:04}", r.randrange(12)))
    return rows, genes


@pytest.fixture(scope="module", params=[1 << 18, 10], ids=["in a task", "by the tour"])
def case(spark, request):
    rows, genes = forest(3)
    groups = spark.createDataFrame(rows, SCHEMA).repartition(5)
    members = spark.createDataFrame(genes, "node string, gene string, species int").repartition(3)
    return rows, groups, members, materialised(hierarchy.closure(groups)), intervals.encode(groups, in_task=request.param)


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_intervals_are_ancestors(case):
    rows, groups, _, up, encoded = case
    got = {r["node"]: r for r in encoded.collect()}
    assert len(got) == len(rows) and set(encoded.columns) == {*groups.columns, "pre", "last", "depth"}
    above = {(r["node"], r["ancestor"]): r["distance"] for r in up.collect()}
    for a in got.values():
        for b in got.values():
            assert ((a["node"], b["node"]) in above) == (a["fam"] == b["fam"] and b["pre"] <= a["pre"] <= b["last"])
    for r in got.values():
        assert r["depth"] == max(d for (n, _), d in above.items() if n == r["node"])
        # Pre-order with siblings by ord is the order that the rows were made in.
        assert r["pre"] == r["ord"] - 1


def test_operators_agree_with_those_over_closures(case):
    _, groups, genes, up, encoded = case
    assert rows_of(intervals.group_statistics(encoded, genes), "node", "n_genes", "is_root") == rows_of(hierarchy.group_statistics(groups, genes, up), "node", "n_genes", "is_root")
    assert rows_of(intervals.root_groups(encoded, genes), "root", "gene") == rows_of(hierarchy.root_groups(genes, groups, up), "root", "gene")
    nested = F.col("level").isin("x", "z")
    assert rows_of(intervals.groups_at_level(encoded, genes, nested, F.col("level")), "node", "gene", "label") == rows_of(hierarchy.groups_at_level(genes, groups, up, nested, F.col("level")), "node", "gene", "label")
    assert rows_of(intervals.marker_groups(encoded, genes), "root", "gene") == rows_of(hierarchy.marker_groups(groups, genes, up), "root", "gene")
    by_species = F.count_distinct("species")
    assert rows_of(intervals.marker_groups(encoded, genes, by_species), "root", "gene") == rows_of(hierarchy.marker_groups(groups, genes, up, by_species), "root", "gene")
    assert rows_of(intervals.maximal_groups(encoded, genes), "root", "gene") == rows_of(hierarchy.maximal_groups(genes, groups, up), "root", "gene")
    clade = groups.sparkSession.range(9).select(F.col("id").cast("int").alias("species"))
    assert rows_of(intervals.groups_in_clade(encoded, genes, clade), "node", "gene") == rows_of(hierarchy.groups_in_clade(genes, groups, up, clade), "node", "gene")


def test_ids_and_pairs_agree_with_those_over_closures(case):
    _, groups, genes, up, encoded = case
    assert rows_of(intervals.duplication_ids(encoded, "level"), "node", "hog_id") == rows_of(hierarchy.duplication_ids(groups, up, "level"), "node", "hog_id")
    for kind in ("S", F.col("level") == "y"):
        assert rows_of(intervals.pairwise_relations(encoded, genes, kind), "gene_a", "gene_b") == rows_of(hierarchy.pairwise_relations(groups, genes, up, kind), "gene_a", "gene_b")


def test_odd_forests(spark):
    none = intervals.encode(spark.createDataFrame([], SCHEMA))
    genes = spark.createDataFrame([], "node string, gene string, species int")
    assert none.count() == 0 and intervals.root_groups(none, genes).count() == 0 and intervals.marker_groups(none, genes).count() == 0
    loop = spark.createDataFrame([(1, "a", "b", "S", None, 1, 0), (1, "b", "a", "S", None, 2, 0), (1, "c", None, "S", None, 3, 0)], SCHEMA)
    for bound in (10, 1):
        with pytest.raises(Exception, match="cycle"):
            intervals.encode(loop, in_task=bound).count()
    # Several roots, an unknown parent, equal order: siblings by node.
    many = spark.createDataFrame([(1, "b", None, "S", None, 1, 0), (1, "a", "gone", "S", None, 1, 0), (1, "c", "a", "S", None, 1, 0)], SCHEMA)
    for bound in (10, 1):
        assert rows_of(intervals.encode(many, in_task=bound), "node", "pre", "last", "depth") == [("a", 0, 1, 0), ("b", 2, 2, 0), ("c", 1, 1, 1)]
