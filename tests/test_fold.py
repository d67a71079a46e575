"""Gene trees and the fold over the species tree: known trees, expected values, planted families."""

import random

import numpy as np
import pyarrow as pa
import pytest

from kinloom.operators import fold, genetree, hierarchy
from kinloom.operators.genetree import Node
from kinloom.sources import trees

#: Fixed value: a gene tree of 31 leaves with its branch lengths.
TREE = (
    "(((((G00100_SE001||SE001:153.567,G00100_SE008||SE008:153.567)1:39.499,(G00100_SE006||SE006:173.507,G00100_SE007||SE007:173.507)1:19.5597)1:14.0196,(G00100_SE003||SE003:198.481,"
    "((((G00100_SE011||SE011:136.533,G00100_SE012||SE012:136.533)1:7.60673,(G00100_SE010||SE010:36.1782,G00342_SE010||SE010:36.1782)1:107.961)1:8.49419,G00100_SE009||SE009:152.634)1:13.723,"
    "(((G00186_SE004||SE004:143.819,(G00186_SE011||SE011:136.533,(G00186_SE012||SE012:116.411,G00242_SE012||SE012:116.411)1:20.1214)1:7.28662)1:0.32011,(G00186_SE010||SE010:31.4887,"
    "G00350_SE010||SE010:31.4887)1:112.651)1:8.49419,G00186_SE009||SE009:152.634)1:13.723)1:32.1245)1:8.60492)1:36.2336,(((G00110_SE001||SE001:153.567,G00110_SE008||SE008:153.567)1:39.499,"
    "(G00110_SE006||SE006:173.507,G00110_SE007||SE007:173.507)1:19.5597)1:14.0196,(G00110_SE003||SE003:198.481,(((G00110_SE004||SE004:143.819,(G00110_SE011||SE011:136.533,"
    "G00110_SE012||SE012:136.533)1:7.28662)1:0.32011,G00110_SE010||SE010:144.139)1:8.49419,G00110_SE009||SE009:152.634)1:45.8474)1:8.60492)1:36.2336)1:6.68041,(G00100_SE002||SE002:119.545,"
    "(G00100_SE013||SE013:97.4899,(G00100_SE014||SE014:87.2367,G00100_SE015||SE015:87.2367)1:10.2532)1:22.055)1:130.455);"
)


def test_labels_and_representatives_of_a_known_tree():
    tree = genetree.from_rows(trees.newick_rows(TREE))
    assert len(tree.leaves()) == 31
    genetree.species_overlap(tree, {n.name: frozenset([n.name.split("||")[1]]) for n in tree.leaves()}, 0.0)
    kinds = [n.kind for n in tree.postorder() if n.children and n is not tree]
    assert (kinds.count("S"), kinds.count("D")) == (24, 5)
    assert tree.inter == 0 and tree.children[0].inter == tree.children[0].union
    chosen = genetree.representatives(tree, 5)
    assert len(chosen) == 5 and sorted(n for _, part in chosen for n in part) == sorted(n.name for n in tree.leaves())
    assert chosen[-1][0] in ("G00100_SE013||SE013", "G00100_SE015||SE015", "G00100_SE014||SE014", "G00100_SE002||SE002")
    assert genetree.representatives(Node("x"), 5) == [("x", ["x"])]


def random_tree(r, names, clock=False):
    nodes = [Node(n, 1.0) for n in names]
    height = {n: 0.0 for n in nodes}
    t = 0.0
    while len(nodes) > 1:
        t += r.uniform(0.5, 2)
        a, b = (nodes.pop(r.randrange(len(nodes))) for _ in range(2))
        for c in (a, b):
            c.length = t - height[c] if clock else r.uniform(0.5, 3)
        nodes.append(Node(None, 0.0, [a, b]))
        height[nodes[-1]] = t
    return nodes[0]


def leaf_distances(graph):
    at, d = genetree.distances(graph)
    return [graph[0][i] for i in at], d[np.ix_(at, at)]


def clades(root):
    return {frozenset(m.name for m in n.leaves()) for n in root.postorder()}


@pytest.mark.parametrize("seed", range(6))
def test_joining_finds_the_tree_again_and_roots_agree_on_clocks(seed):
    r = random.Random(seed)
    names = [f"g{i}" for i in range(r.randrange(2, 12))]
    plain = random_tree(r, names)
    found, d = leaf_distances(genetree.unrooted(plain))
    again, e = leaf_distances(genetree.neighbour_joining(found, d))
    order = [again.index(n) for n in found]
    assert np.allclose(e[np.ix_(order, order)], d)
    clock = random_tree(r, names, clock=True)
    graph = genetree.unrooted(clock)
    methods = [genetree.midpoint, genetree.least_deviation] + [genetree.trimmed_midpoint] * (not genetree.outliers(graph))
    for method in methods:
        assert clades(method(graph)) == clades(clock)


def test_rooting_by_lineages_and_outliers():
    tree = genetree.from_rows(trees.newick_rows("((A1:1,B1:1):1,(C1:1,(A2:1,B2:9):1):1);"))
    lineages = {n: frozenset(x) for n, x in {"A1": ("A", "x", "r"), "A2": ("A", "x", "r"), "B1": ("B", "x", "r"), "B2": ("B", "x", "r"), "C1": ("C", "r")}.items()}
    best = genetree.by_lineage(lineages)(genetree.unrooted(tree))
    scores = [genetree.lineage_score(genetree.rooted(genetree.unrooted(tree), u, v, 0.1), lineages) for u, v in genetree._branches(genetree.unrooted(tree))]
    assert genetree.lineage_score(best, lineages) == max(scores)
    far = genetree.neighbour_joining([f"n{i}" for i in range(8)] + ["far"], np.array([[0 if i == j else 2.0 + 30 * (8 in (i, j)) for j in range(9)] for i in range(9)]))
    assert genetree.outliers(far) == {"far"}


def test_reconciliation_by_common_ancestor():
    tree = genetree.from_rows(trees.newick_rows("(((a1,b1),(a2,b2)),c1);"))
    stands = genetree.by_common_ancestor(tree, {n.name: n.name[0].upper() for n in tree.leaves()}, {"A": "x", "B": "x", "x": "r", "C": "r", "r": None})
    assert stands[tree] == "r" and tree.kind == "S" and tree.children[0].kind == "D" and tree.children[0].children[0].kind == "S"


def test_deep_trees_are_written():
    deep = "(" * 3000 + "a" + "".join(f",b{i})" for i in range(3000)) + ";"
    assert trees.write_newick(trees.newick_rows(deep)) == deep


SPECIES = [("r", None), ("x", "r"), ("C", "r"), ("A", "x"), ("B", "x")]


def mutate(r, seq, share):
    return "".join(r.choice("ACDEFGHIKLMNPQRSTVWY") if r.random() < share else c for c in seq)


def planted(seed):
    """1: one gene a species.  2: two copies from before the root.  3: a duplication in x.  4: genes of B doubled.  5: one gene."""
    r = random.Random(seed)
    new = lambda: mutate(r, "A" * 240, 1.0)
    out = []

    def spread(fam, seq, tag, species="ABC"):
        clade = mutate(r, seq, 0.03)
        for s in species:
            out.append((fam, f"{s}{fam}{tag}", s, mutate(r, clade if s != "C" else seq, 0.02)))

    spread(1, new(), "a")
    two = new()
    spread(2, mutate(r, two, 0.3), "a")
    spread(2, mutate(r, two, 0.3), "b")
    three = new()
    spread(3, mutate(r, three, 0.25), "a", "C")
    inside = mutate(r, three, 0.25)
    spread(3, mutate(r, inside, 0.08), "a", "AB")
    spread(3, mutate(r, inside, 0.08), "b", "AB")
    four = new()
    spread(4, four, "a", "ABC")
    b = next(s for f, g, _, s in out if g == "B4a")
    out.append((4, "B4b", "B", mutate(r, b, 0.02)))
    out.append((5, "A5a", "A", new()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_finds_planted_groups(spark, seed):
    genes = spark.createDataFrame([*planted(seed), (None, "q", "A", "AC"), (1, "z", "none", "AC"), (1, None, "A", "AC")], "fam long, gene string, species string, seq string").repartition(3)
    tree = spark.createDataFrame(SPECIES, "node string, parent string")
    groups, links = fold.fold(genes, tree)
    out, members = fold.group_tree(groups, links, genes.where("fam is not null and gene is not null"), tree)
    up = hierarchy.closure(out)
    below = {}
    for r in members.join(up, "node").collect():
        below.setdefault(r["ancestor"], set()).add(r["gene"])
    rows = {r["node"]: r for r in out.collect()}
    kinds = {(r["kind"], r["level"], r["score"], frozenset(below[n])) for n, r in rows.items()}
    s, want = frozenset, set()
    for fam, tag in ((1, "a"), (2, "a"), (2, "b")):
        want |= {("S", "r", 1.0, s(f"{x}{fam}{tag}" for x in "ABC")), ("S", "x", 1.0, s(f"{x}{fam}{tag}" for x in "AB"))}
    want |= {("S", "r", 1.0, s(["A3a", "B3a", "A3b", "B3b", "C3a"])), ("D", None, None, s(["A3a", "B3a", "A3b", "B3b"])), ("S", "x", 1.0, s(["A3a", "B3a"])), ("S", "x", 1.0, s(["A3b", "B3b"]))}
    want |= {("S", "r", 1.0, s(["A4a", "B4a", "B4b", "C4a"])), ("S", "x", 1.0, s(["A4a", "B4a", "B4b"])), ("D", None, None, s(["B4a", "B4b"]))}
    assert kinds == want
    ids = {frozenset(below[r["node"]]): r["hog_id"] for r in hierarchy.duplication_ids(out, up, "level").collect()}
    assert len(set(ids.values())) == len(ids) and sorted(v for v in ids.values() if "." not in v and v.endswith("_r")) == [f"HOG:000000{i}_r" for i in range(1, 6)]
    assert {ids[s(["A3a", "B3a"])][11:], ids[s(["A3b", "B3b"])][11:]} == {".1a_x", ".1b_x"}
    assert sorted(r["ord"] for r in rows.values() if r["fam"] == 1)[0] == 1


def test_fold_of_nothing(spark):
    tree = spark.createDataFrame(SPECIES, "node string, parent string")
    genes = spark.createDataFrame([], "fam long, gene string, species string, seq string")
    groups, links = fold.fold(genes, tree)
    out, members = fold.group_tree(groups, links, genes, tree)
    assert groups.count() == links.count() == out.count() == members.count() == 0


def level(rows, **options):
    import pandas as pd

    df = pd.DataFrame(rows, columns=["hog", "via", "gene", "seq", "n", "species"])
    distance = lambda seqs: np.array([[abs(float(a) - float(b)) for b in seqs] for a in seqs])
    made = fold._Level(df, 5, 0.1, distance, genetree.midpoint, options.get("keep")).result(1, "t")
    return {k: sorted((r["hog"], r["sub"], r["gene"]) for _, r in made[made["kind"] == k].iterrows()) for k in ("link", "rep", "split", "frozen")}


def test_a_torn_group_is_split_along_its_parts():
    # h stands in both copies of a duplication: a1 with b1, a2 with b2.
    rows = [("h", "s1", "a1", "0", 1, ["A"]), ("h", "s2", "a2", "10", 1, ["A"]), ("b1", "b1", "b1", "1", 1, ["B"]), ("b2", "b2", "b2", "11", 1, ["B"])]
    got = level(rows)
    assert got["link"] == [("t:b1", "b1", None), ("t:b1", "h~0", None), ("t:b2", "b2", None), ("t:b2", "h~1", None)]
    assert got["split"] == [("h~0", "s1", "h"), ("h~1", "s2", "h")]


def test_what_cannot_be_split_stays_with_its_larger_side():
    rows = [("h", "s", "a1", "0", 3, ["A"]), ("h", "s", "a2", "10", 1, ["A"]), ("b1", "b1", "b1", "1", 1, ["B"]), ("b2", "b2", "b2", "11", 1, ["B"])]
    got = level(rows)
    assert got["split"] == [] and got["link"] == [("t:b1", "b1", None), ("t:b1", "h", None), ("t:b2", "b2", None)]
    assert sorted(g for _, _, g in got["rep"]) == ["a1", "b1", "b2"]


def test_groups_without_a_good_sequence_are_frozen():
    rows = [("h", "h", "a1", "0", 1, ["A"]), ("b", "b", "b1", "99", 1, ["B"]), ("c", "c", "c1", "1", 1, ["C"])]
    got = level(rows, keep=lambda seqs: [float(s) < 50 for s in seqs])
    assert got["frozen"] == [("b", None, None)] and got["link"] == [("t:c", "c", None), ("t:c", "h", None)]
    assert level(rows[:1], keep=lambda seqs: [False])["frozen"] == [("h", None, None)]


def test_trees_and_alignments_of_the_levels_can_be_kept(spark, tmp_path):
    genes = spark.createDataFrame(planted(3), "fam long, gene string, species string, seq string")
    tree = spark.createDataFrame(SPECIES, "node string, parent string")
    fold.fold(genes, tree, show=f"{tmp_path}/seen")
    seen = spark.read.parquet(f"{tmp_path}/seen").collect()
    text = {(r["fam"], r["taxon"]): r["text"] for r in seen if r["kind"] == "tree"}
    assert set(text) == {(f, t) for f in (1, 2, 3, 4) for t in "xr"}
    for (fam, taxon), newick in text.items():
        lines = [r for r in seen if r["kind"] == "line" and (r["fam"], r["taxon"]) == (fam, taxon)]
        leaves = [n.name for n in genetree.from_rows(trees.newick_rows(newick)).leaves()]
        assert sorted(leaves) == sorted(r["gene"] for r in lines) and len({len(r["text"]) for r in lines}) == 1


def test_levels_are_dealt_to_all_tasks_however_few_bytes_they_have(spark, monkeypatch):
    tree = spark.createDataFrame([("A", "W"), ("B", "W"), ("W", None)], "node string, parent string")
    genes = spark.createDataFrame([(f, f"{s}{f}", s, "MKVLAWDE" + "ACDE"[f % 4]) for f in range(40) for s in "AB"], "fam long, gene string, species string, seq string")
    tasks = []
    write = fold.materialised

    def seen(df):
        if "kind" in df.columns:
            tasks.append(df.rdd.getNumPartitions())
        return write(df)

    monkeypatch.setattr(fold, "materialised", seen)
    groups, links = fold.fold(genes, tree)
    assert tasks == [4]
    assert groups.where("level = 'W'").count() == 40 and links.count() == 80


def test_meetings_hold_each_family_at_a_taxon_whole_across_batches():
    rows = [{"fam": f, "taxon": "W", "hog": f"h{9 - i}", "gene": "g", "seq": "A" * 3} for f in range(5) for i in range(f + 1)]
    batches = [pa.RecordBatch.from_pylist(rows[i : i + 4]) for i in range(0, len(rows), 4)]
    for most, sizes in ((1, [1] * 5), (18, [2, 2, 1]), (1000, [5])):
        met = list(fold._meetings(iter(batches), most))
        assert [len(m) for m in met] == sizes
        flat = [x for m in met for x in m]
        assert [(f, t, len(r)) for f, t, r in flat] == [(f, "W", f + 1) for f in range(5)]
        assert all([x["hog"] for x in r] == sorted(x["hog"] for x in r) for _, _, r in flat)
