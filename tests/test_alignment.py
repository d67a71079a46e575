"""Alignment of sequences that meet in one task, gap filters, distances, trees of many leaves, and the fold over diverged families."""

import random
import time

import numpy as np
import pytest

from kinloom.operators import aligner, alignment, fold, genetree, hierarchy

AMINO = "ACDEFGHIKLMNPQRSTVWY"


def plain_score(a, b, open_, extend):
    """Three tables, cell by cell."""
    scores, low = aligner.letter_scores(), -1e18
    n, m = len(a), len(b)
    x, y, z = (np.full((n + 1, m + 1), low) for _ in range(3))
    x[0, 0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if i and j:
                x[i, j] = max(x[i - 1, j - 1], y[i - 1, j - 1], z[i - 1, j - 1]) + scores[ord(a[i - 1]), ord(b[j - 1])]
            if i:
                y[i, j] = max(max(x[i - 1, j], z[i - 1, j]) - open_, y[i - 1, j]) - extend
            if j:
                z[i, j] = max(max(x[i, j - 1], y[i, j - 1]) - open_, z[i, j - 1]) - extend
    return max(x[n, m], y[n, m], z[n, m])


def path_score(a, b, i, j, open_, extend):
    total, scores = 0.0, aligner.letter_scores()
    for k, (p, q) in enumerate(zip(i, j, strict=True)):
        if p >= 0 and q >= 0:
            total += scores[ord(a[p]), ord(b[q])]
        else:
            same = k and ((p < 0) == (i[k - 1] < 0)) and ((q < 0) == (j[k - 1] < 0))
            total -= extend + (0 if same else open_)
    return total


@pytest.mark.parametrize(("open_", "extend"), [(8, 1), (0, 2), (3, 0.5)])
def test_pairs_against_a_plain_program(open_, extend):
    r = random.Random(4)
    for _ in range(120):
        a = "".join(r.choice("ACDI") for _ in range(r.randrange(0, 14)))
        b = "".join(r.choice("ACDIL") for _ in range(r.randrange(0, 14))) if r.random() < 0.5 else "".join(c for c in a if r.random() < 0.7)
        score = aligner.letter_scores()[np.frombuffer(a.encode(), np.uint8)[:, None], np.frombuffer(b.encode(), np.uint8)[None]]
        best, i, j = aligner.best_path(score, open_, extend)
        assert best == pytest.approx(plain_score(a, b, open_, extend))
        assert [p for p in i if p >= 0] == list(range(len(a))) and [q for q in j if q >= 0] == list(range(len(b)))
        assert path_score(a, b, i, j, open_, extend) == pytest.approx(best)


def test_a_part_lies_inside_at_no_cost():
    r = random.Random(8)
    for _ in range(60):
        whole = "".join(r.choice("ACDEIKLMW") for _ in range(r.randrange(1, 25)))
        a = r.randrange(len(whole))
        part = mutate(r, whole[a : a + 1 + r.randrange(12)], 0.2)
        best, i, j = aligner.best_path(aligner.score_matrix(whole, part), 8, 1, inside=True)
        assert best == pytest.approx(max(plain_score(whole[x:y], part, 8, 1) for x in range(len(whole) + 1) for y in range(x, len(whole) + 1)))
        assert [p for p in i if p >= 0] == list(range(len(whole))) and [q for q in j if q >= 0] == list(range(len(part)))
        used = np.flatnonzero(j >= 0)
        assert path_score(whole, part, i[used[0] : used[-1] + 1], j[used[0] : used[-1] + 1], 8, 1) == pytest.approx(best)


def test_pair_scores_of_columns(spark):
    rows = [("ACD", "ACD"), ("ACD", None), ("", ""), ("MKV", "MV")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(aligner.pair_scores("a", "b")).collect()]
    assert got == [15.0, None, 0.0, 10.0 - aligner.OPEN - aligner.EXTEND]


def test_scores_of_pairs_in_one_task(spark):
    """pairs that lie in one task are scored in several, each two sequences once; nulls and repeated pairs stay."""
    texts = [("ACD" * (i % 3 + 1), None if i == 5 else "MKV" * (i % 4)) for i in range(24)]
    got = aligner.with_scores(spark.createDataFrame([(i, *p) for i, p in enumerate(texts)], "i long, x string, y string").coalesce(1), "x", "y")
    want = {i: None if None in p else aligner.pair_score(*p) for i, p in enumerate(texts)}
    assert {r["i"]: r["score"] for r in got.collect()} == want
    assert "RepartitionByExpression" in got._jdf.queryExecution().optimizedPlan().toString()


def mutate(r, seq, share, gaps=0.0):
    out = []
    for c in seq:
        if r.random() < gaps:
            if r.random() < 0.5:
                continue
            out.append(r.choice(AMINO))
        out.append(r.choice(AMINO) if r.random() < share else c)
    return "".join(out)


def test_progressive_alignment_keeps_sequences_and_finds_homologous_columns():
    r = random.Random(2)
    base = "".join(r.choice(AMINO) for _ in range(150))
    seqs = [mutate(r, base, 0.3, 0.02) for _ in range(9)] + [base[:60], base[80:]]
    lines = aligner.progressive(seqs)
    assert len({len(x) for x in lines}) == 1 and [x.replace("-", "") for x in lines] == seqs
    assert len(lines[0]) < 190
    first, last = lines[9], lines[10]
    assert sum(a != "-" and b != "-" for a, b in zip(first, last, strict=True)) < 10
    assert aligner.progressive([]) == [] and aligner.progressive(["AC"]) == ["AC"] and aligner.progressive(["", "AC"]) == ["--", "AC"]


def test_gap_filter_is_that_of_the_long_form(spark):
    r = random.Random(9)
    for least, elbow in ((50, False), (4, False), (4, True)):
        for _ in range(2):
            lines = ["".join("-" if r.random() < (0.6 if k % 4 == 0 else 0.15) or j % 7 == 0 and k != 1 else r.choice("ACD") for j in range(40)) for k in range(9)]
            lines[5] = "-" * 40
            stay, out = aligner.gap_filter(lines, least_columns=least, elbow=elbow)
            cells = alignment.long_form(spark.createDataFrame([("g", k, x) for k, x in enumerate(lines)], "g string, m int, line string"), "g", "m", "line")
            most = alignment.elbow(alignment.column_gaps(cells), alignment.COLUMN_GAPS).first()["elbow"] if elbow else alignment.COLUMN_GAPS
            want = alignment.filter_alignment(cells, gap_ratio_col=most, least_columns=least).orderBy("member", "place").collect()
            rows = {}
            for c in want:
                rows[c["member"]] = rows.get(c["member"], "") + c["residue"]
            assert {k: x for k, (s, x) in enumerate(zip(stay, out, strict=True)) if s} == rows
    assert aligner.gap_filter([]) == ([], [])


def test_distances_of_aligned_lines():
    d = aligner.aligned_distance(["ACDE", "ACDF", "----", "AC--", "WWWW"])
    assert d[0, 1] == pytest.approx(-np.log(1 - 0.25 - 0.25**2 / 5)) and d[0, 3] == 0.0
    assert d[0, 2] == d[2, 4] == d[0, 4] == aligner.MOST and (d == d.T).all() and (np.diag(d) == 0).all()


def plain_joining(names, distance):
    """The whole matrix looked at for every pair: leaves below each joined node."""
    parts, d = [frozenset([n]) for n in names], np.array(distance, float)
    out = set()
    while len(parts) > 3:
        n, sums = len(parts), d.sum(1)
        q = (n - 2) * d - sums[:, None] - sums[None]
        np.fill_diagonal(q, np.inf)
        i, j = sorted(divmod(int(q.argmin()), n))
        row = (d[i] + d[j] - d[i, j]) / 2
        keep = [k for k in range(n) if k not in (i, j)]
        d = np.vstack([np.hstack([d[np.ix_(keep, keep)], row[keep][:, None]]), np.append(row[keep], 0)[None]])
        parts = [parts[k] for k in keep] + [parts[i] | parts[j]]
        out.add(parts[-1])
    return out


def splits(graph, all_names):
    tree = genetree.rooted(graph, 0, next(iter(graph[1][0])), 0.0)
    below = [frozenset(m.name for m in n.leaves()) for n in tree.postorder()]
    return {min(s, all_names - s, key=lambda x: (len(x), sorted(x))) for s in below if 1 < len(s) < len(all_names) - 1}


@pytest.mark.parametrize("seed", range(5))
def test_bounded_joining_is_plain_joining(seed):
    r = np.random.default_rng(seed)
    x = r.standard_normal((40, 5))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) + r.random((40, 40)) * 0.1
    d = (d + d.T) / 2
    np.fill_diagonal(d, 0)
    names = [f"n{i}" for i in range(40)]
    all_names = frozenset(names)
    want = {min(s, all_names - s, key=lambda x: (len(x), sorted(x))) for s in plain_joining(names, d)}
    assert splits(genetree.neighbour_joining(names, d), all_names) == {s for s in want if 1 < len(s) < 39}


def test_a_tree_of_thousands_of_leaves():
    r = np.random.default_rng(1)
    x = np.cumsum(r.standard_normal((3000, 8)), 0)
    d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T, 0))
    began = time.time()
    label, near = genetree.neighbour_joining([str(i) for i in range(3000)], d)
    assert len(label) == 5998 and time.time() - began < 60
    assert len(genetree.midpoint((label, near)).leaves()) == 3000


def test_word_distance_is_that_of_sets():
    r = random.Random(3)
    seqs = ["".join(r.choice("ACD") for _ in range(r.randrange(0, 12))) for _ in range(30)]
    d = genetree.word_distance(seqs)
    sets = [{s[i : i + 3] for i in range(max(len(s) - 2, 1))} for s in seqs]
    for i, a in enumerate(sets):
        for k, b in enumerate(sets):
            j = len(a & b) / len(a | b)
            assert d[i, k] == pytest.approx(min(5, -np.log(2 * j / (1 + j)) / 3) if j else 5.0, abs=1e-6)


def test_fold_finds_diverged_families(spark):
    """Two copies from before the root at about 40 % identity: words say nothing there, aligned columns do."""
    r = random.Random(12)
    rows = []
    for fam in range(1, 4):
        old = "".join(r.choice(AMINO) for _ in range(220))
        for tag in "ab":
            copy = mutate(r, old, 0.45, 0.01)
            clade = mutate(r, copy, 0.25, 0.01)
            for s in "ABC":
                rows.append((fam, f"{s}{fam}{tag}", s, mutate(r, clade if s != "C" else copy, 0.3, 0.01)))
    genes = spark.createDataFrame(rows, "fam long, gene string, species string, seq string").repartition(3)
    tree = spark.createDataFrame([("r", None), ("x", "r"), ("C", "r"), ("A", "x"), ("B", "x")], "node string, parent string")
    out, members = fold.group_tree(*fold.fold(genes, tree), genes, tree)
    below = {}
    for x in members.join(hierarchy.closure(out), "node").collect():
        below.setdefault(x["ancestor"], set()).add(x["gene"])
    found = {(x["kind"], x["level"], frozenset(below[x["node"]])) for x in out.collect()}
    want = {("S", level, frozenset(f"{s}{fam}{tag}" for s in species)) for fam in range(1, 4) for tag in "ab" for level, species in (("r", "ABC"), ("x", "AB"))}
    assert found == want


def test_copies_in_one_species_are_one_leaf_until_the_tree_stands():
    import pandas as pd

    r = random.Random(1)
    seq = "".join(r.choice(AMINO) for _ in range(80))
    rows = [(f"a{i}", f"a{i}", f"a{i}", seq, 1, ["A"]) for i in range(400)] + [("b", "b", "b", mutate(r, seq, 0.1), 1, ["B"]), ("c", "c", "c", mutate(r, seq, 0.5), 1, ["C"])]
    seen = []

    def align(seqs):
        seen.append(len(seqs))
        return seqs

    level = fold._Level(pd.DataFrame(rows, columns=["hog", "via", "gene", "seq", "n", "species"]), 5, 0.1, None, genetree.midpoint, None, align, aligner.gap_filter)
    made = level.result(1, "t")
    assert len(level.tree.leaves()) == 402
    links = made[made["kind"] == "link"].groupby("hog")["sub"].apply(set)
    assert len(links) == 1 and len(links.iloc[0]) == 402
    assert made[made["kind"] == "rep"]["n"].sum() == 402


def test_outliers_without_pairs(spark):
    """the same as over all pairs, and groups whose pairs would never end."""
    r = random.Random(4)
    rows = [(g, i, r.choice([None, -3, 0, 1, 1, 2, 2, 2, 3, 40])) for g in range(6) for i in range((1, 2, 9, 30, 31, 50)[g])] + [(None, 1, 5), (None, 2, 6)]
    values = spark.createDataFrame(rows, "g int, m int, v long")
    known = [x for x in rows if None not in x]
    pairs = [(a[0], a[1], b[1], float(abs(a[2] - b[2]))) for a in known for b in known if a[0] == b[0] and a[1] < b[1]]
    want = alignment.distance_outliers(spark.createDataFrame(pairs, "g int, a int, b int, d double"), "g", "a", "b", "d").collect()
    got = alignment.value_outliers(values, "g", "m", "v").collect()
    assert {tuple(x) for x in got} == {tuple(x) for x in want} and len(got) == len(want) > 3
    many = spark.range(1_000_000).selectExpr("0 as g", "id as m", "if(id < 2, 1000, id % 3) as v")
    assert {x["m"] for x in alignment.value_outliers(many, "g", "m", "v").collect()} == {0, 1}


def test_consensus_holds_few_keys(spark):
    """distinct residues come by hashed keys, not by states of texts for each place."""
    rows = [("g", 1, "AC-?"), ("g", 2, "AD--"), ("h", 3, "-K")]
    cells = alignment.long_form(spark.createDataFrame(rows, "group string, member int, line string"), "group", "member", "line")
    got = alignment.consensus(cells)
    assert {tuple(r) for r in got.collect()} == {("g", 0, "A"), ("g", 1, "X"), ("g", 2, "-"), ("g", 3, "-"), ("h", 0, "-"), ("h", 1, "K")}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "count(distinct" not in plan


def test_groups_aligned_side_by_side_are_as_each_alone(monkeypatch):
    r = random.Random(5)
    letter = lambda n: "".join(r.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n))
    groups = [[letter(r.choice([0, 1, 2, 7, 20, 21, 60])) for _ in range(r.randrange(7))] for _ in range(60)]
    alone = []
    for g in groups:
        # Every join by its own matrix.
        run, filled = aligner._joins(g), None
        try:
            while True:
                score = run.send(filled)
                filled = aligner._scores(score, aligner.OPEN, aligner.EXTEND)
        except StopIteration as end:
            alone.append(end.value)
    for cells in (1, 2000, 1 << 20):
        monkeypatch.setattr(aligner, "TOGETHER", cells)
        assert aligner.progressive_together(groups) == alone
        assert [[x.replace("-", "") for x in g] for g in alone] == groups
