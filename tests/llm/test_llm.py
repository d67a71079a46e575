"""Operators of the training-data pipeline against brute force, the libraries themselves, and odd inputs."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from kinloom.llm import bpe, jaccard, language, mixing, quality, substring_dedup, token_counts, token_file, topk, vector_dedup

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", "   ", "a", "Hello,  World!\n\nnew\tline", "naïve café 北京 🙂🙂", "x" * 3000, "aaaa " * 700, "<|endoftext|> <s> </s>", "▁▁ a▁b", "ÀÉ İstanbul ß", "'s 're 12345 can't", "\x00\x01 zero"]
SCHEMA = "doc_id long, text string, n_words string, key string"


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    passage = [r.choice(words) for _ in range(60)]
    out = list(ODD)
    for _ in range(30):
        base = [r.choice(words) for _ in range(r.randrange(5, 150))]
        out.append(" ".join(base))
        if r.random() < 0.5:
            near = list(base)
            near[r.randrange(len(near))] = "changed"
            out += [" ".join(near)] * r.randrange(1, 3)
        if r.random() < 0.4:
            out.append(" ".join(base[:20] + passage + base[20:]))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", None) for i, t in enumerate(texts)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_equals_the_library(docs, texts, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    t.no_truncation()
    t.no_padding()
    got = {r["doc_id"]: r for r in bpe.bpe_encode_decode(docs, "text", WORD).collect()}
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(got[i]["ids"]), "<u4").tolist() == ids, x
        assert got[i]["decoded"] == t.decode(ids, skip_special_tokens=False)
    assert bpe.bpe_encode_decode(none, "text", WORD).count() == 0


def test_token_counts_equal_the_library(docs, texts, none):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, "text", PIECE).collect()}
    assert got == {i: len(p.encode(x or "")) for i, x in enumerate(texts)}
    assert token_counts.token_counts(none, "text", PIECE).count() == 0


def test_token_files_come_back(spark, docs, texts, none, tmp_path):
    manifest = token_file.write_token_files(docs, "doc_id", "text", WORD, 2, f"file://{tmp_path}/a")
    back = {r["key"]: r for r in token_file.read_token_files(manifest).collect()}
    want = {r["doc_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() + [2] for r in bpe.bpe_encode_decode(docs, "text", WORD).collect()}
    start = 0
    for i in range(len(texts)):
        assert np.frombuffer(bytes(back[i]["ids"]), "<u4").tolist() == want[i] and back[i]["start"] == start
        start += len(want[i])
    asked = spark.createDataFrame([(3,), (4,), (10**9,)], "k long")
    assert sorted(r["key"] for r in token_file.lookup_token_files(manifest, asked, "k").collect()) == [3, 4]
    empty = token_file.write_token_files(none, "doc_id", "text", WORD, 2, f"file://{tmp_path}/b")
    assert token_file.read_token_files(empty).count() == 0


def brute_links(texts):
    sets = []
    for t in texts:
        w = SPLIT.findall(t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    links = {i: set() for i in range(len(texts))}
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
                links[i].add(j)
                links[j].add(i)
    return links


def heads(links):
    out = {}
    for i in links:
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = i
                todo += links[x]
    return out


def test_similarity_join_is_whole(docs, texts, none):
    links = brute_links(texts)
    head = heads(links)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.similarity_join(docs, "doc_id", "text").collect()}
    assert got == {i: (head[i], len(links[i])) for i in links}
    assert jaccard.similarity_join(none, "doc_id", "text").count() == 0
    kept = {r["doc_id"] for r in jaccard.keep_one_per_class(docs, "doc_id", "text").collect()}
    assert kept == {i for i in links if head[i] == i}


def test_a_dense_group_is_compared_whole(spark):
    r = random.Random(1)
    base = [f"w{r.randrange(5000)}" for _ in range(120)]
    many = []
    for _ in range(250):
        w = list(base)
        for _ in range(r.randrange(5)):
            w[r.randrange(120)] = f"x{r.randrange(10**6)}"
        many.append(" ".join(w))
    links = brute_links(many)
    head = heads(links)
    got = jaccard.similarity_join(spark.createDataFrame(list(enumerate(many)), "doc_id long, text string"), "doc_id", "text").collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == {i: (head[i], len(links[i])) for i in links}


def many_with_a_common_passage(n, seed=11):
    """Texts that share a passage, and in each of ten groups another one, and little else; some have near copies."""
    r = random.Random(seed)
    passage = [f"common{i}" for i in range(25)]
    out = []
    while len(out) < n:
        own = [f"w{r.randrange(4000)}" for _ in range(r.randrange(40, 60))]
        group = r.randrange(10)
        out.append(" ".join([*own[:20], *passage, *own[20:], *[f"group{group}x{i}" for i in range(25)]]))
        base = out[-1].split(" ")
        for _ in range(r.choice([0, 0, 1, 3])):
            near = list(base)
            for _ in range(r.choice([1, 1, 2])):
                near[r.randrange(len(near))] = f"x{r.randrange(10**6)}"
            out.append(" ".join(near))
    return out


@pytest.mark.parametrize("small", [jaccard.SMALL, 12])
def test_sparse_large_nodes_are_split_without_loss(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    levels = []
    many = many_with_a_common_passage(1100)
    stored = jaccard.common.stored

    def noted(df):
        if df.columns == ["node", "key", "core"]:
            levels.append(1)
        return stored(df)

    monkeypatch.setattr(jaccard.common, "stored", noted)
    links = brute_links(many)
    head = heads(links)
    got = jaccard.similarity_join(spark.createDataFrame(list(enumerate(many)), "doc_id long, text string"), "doc_id", "text").collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == {i: (head[i], len(links[i])) for i in links}
    assert len(levels) >= (2 if small == 12 else 1)


def test_short_near_copies_need_comparisons(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 40_000)
    r = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    many = []
    for _ in range(400):
        w = list(base)
        for _ in range(r.choice([1, 1, 2])):
            w[r.randrange(60)] = f"x{r.randrange(8)}"
        many += [" ".join(w)] * r.choice([1, 1, 2])
    links = brute_links(many)
    head = heads(links)
    got = jaccard.similarity_join(spark.createDataFrame(list(enumerate(many)), "doc_id long, text string"), "doc_id", "text").collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == {i: (head[i], len(links[i])) for i in links}


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.75, 1.0])
def test_other_thresholds(spark, texts, threshold):
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set() for w in (SPLIT.findall(t or "") for t in texts)]
    want = [sum(1 for j, b in enumerate(sets) if i != j and a and len(a & b) / len(a | b) >= threshold) for i, a in enumerate(sets)]
    got = jaccard.similarity_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", threshold=threshold).collect()
    assert [r["n_links"] for r in sorted(got)] == want


def test_the_pair_rule_equals_the_similarity():
    r = np.random.default_rng(3)
    for p, q in ((4, 5), (1, 2), (1, 1), (7, 10)):
        sets = [np.unique(r.integers(0, 60, r.integers(1, 60)).astype(np.uint64)) for _ in range(60)]
        pivot = np.arange(40, dtype=np.uint64)
        deltas = [np.setxor1d(s, pivot) for s in sets]
        shared = jaccard._common_counts(deltas)
        a = [(q + p) * len(d) - (q - p) * len(s) for s, d in zip(sets, deltas, strict=True)]
        for i in range(60):
            for j in range(i):
                assert shared[j, i] == len(np.intersect1d(deltas[i], deltas[j]))
                both = len(np.intersect1d(sets[i], sets[j]))
                near = both / (len(sets[i]) + len(sets[j]) - both) >= p / q
                assert near == (a[i] + a[j] <= 2 * (q + p) * shared[j, i])


def test_recall_of_paths_is_as_stated():
    """First nodes are shared as runs_for counts, and a split keeps a pair as survival says."""
    r = np.random.default_rng(17)
    met = kept = 0
    trials, runs = 400, 2
    for _ in range(trials):
        both, a, b = np.split(r.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2), [240, 270])
        one, two = np.sort(np.concatenate([both, a])), np.sort(np.concatenate([both, b]))  # 240 of 300 shared
        met += len(np.intersect1d(jaccard._nodes(one, runs), jaccard._nodes(two, runs))) > 0
        nodes = np.repeat(r.integers(0, 1 << 63, 1).astype(np.uint64), 2)
        i, child = jaccard._children(nodes, np.array([jaccard._sketch(one), jaccard._sketch(two)]))
        kept += len(np.intersect1d(child[i == 0], child[i == 1])) > 0
    assert met / trials > 1 - np.exp(-jaccard.FIRST * 0.8 * runs) - 0.04
    assert abs(kept / trials - jaccard.survival(0.8, 1)) < 0.06
    assert jaccard.survival(0.8, 2) < jaccard.survival(0.8, 1) and jaccard.runs_for(0.8, 1 - 1e-5) == 9


def test_similarity_join_of_odd_rows(spark):
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(None, words, 1, "a"), (5, words, 2, "b"), (5, words + " end", 3, None), (5, "alone", 4, "d"), (9, "alone", 5, "e"), (7, None, 6, "f"), (7, "", 7, "g"), (None, " ", 8, "h"), (8, "x " * 200_000, 9, "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_links int, key string")
    got = sorted(((r[0], r[1], r[2]) for r in jaccard.similarity_join(df, "doc_id", "text").collect()), key=str)
    assert got == sorted([(None, 5, 2), (5, 5, 2), (5, 5, 2), (5, 5, 1), (9, 5, 1), (7, 7, 0), (7, 7, 0), (None, None, 0), (8, 8, 0)], key=str)
    kept = jaccard.keep_one_per_class(df, "doc_id", "text")
    assert kept.columns == df.columns and kept.count() == 6


def test_links_at_a_lower_threshold_are_found(spark):
    pairs = [([f"p{k}w{i}" for i in range(304)], k) for k in range(40)]
    # 300 shingles, of which 15 changed words, far apart, spoil 75: 225 shared of 375, a similarity of 0.6.
    texts = [t for w, k in pairs for t in (" ".join(w), " ".join(f"new{i}" if i % 20 == 10 else x for i, x in enumerate(w)))]
    got = jaccard.similarity_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", threshold=0.6).collect()
    assert sum(r["n_links"] for r in got) == 80


def test_one_of_each_class_is_kept_whatever_the_ids(spark):
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join([*words[:k], f"x{k}", *words[k + 1 :]]) for k in (0, 1, 99)]
    other = " ".join(f"y{i}" for i in range(30))
    for ids in ([7, 7, 7], [None, None, None], [9, 7, 7], [None, 7, None]):
        rows = [*zip(ids, texts, strict=True), (ids[0], texts[0]), (ids[1], texts[1]), (7, other), (None, ""), (None, None)]
        got = jaccard.keep_one_per_class(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
        kept = [r for r in got if r["text"] in texts]
        assert len(got) == 4 and len(kept) == 1, ids
        assert kept[0]["doc_id"] == min((i for i in ids if i is not None), default=None)


def brute_removal(texts, window=35):
    words = [SPLIT.findall(t or "") for t in texts]
    count = {}
    for w in words:
        for i in range(len(w) - window + 1):
            count[tuple(w[i : i + window])] = count.get(tuple(w[i : i + window]), 0) + 1
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def test_repeated_windows_go(docs, texts, none):
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs, "text", window=35, joined=True).collect()}
    for n, want in enumerate(brute_removal(texts)):
        assert (got[n]["n_words_"], got[n]["n_removed"], got[n]["text"]) == want
        assert got[n]["n_words"] == "clash"
    assert substring_dedup.remove_repeats(none, "text").count() == 0


@pytest.mark.parametrize(("hot", "rounds"), [(substring_dedup.HOT, substring_dedup.ROUNDS), (25, 6), (25, 0), (25, 1)])
def test_a_passage_in_very_many_contexts(spark, monkeypatch, hot, rounds):
    for name, value in (("HOT", hot), ("ROUNDS", rounds), ("SHARD", 20_000), ("STREAM", 50)):
        monkeypatch.setattr(substring_dedup, name, value)
    r = random.Random(9)
    passage, line = [f"p{i}" for i in range(50)], [f"l{i}" for i in range(20)]
    texts = []
    for k in range(1150 if hot > 25 else 300):
        # few other words, so that windows over the passage's ends repeat by chance too
        before, after = ([r.choice("ab" if k % 2 else "abcdefgh") for _ in range(r.randrange(30))] for _ in range(2))
        middle = passage if k % 3 else passage[: r.randrange(30, 50)]
        texts.append(" ".join([*before, *middle, *after, *line, *[f"u{k}x{i}" for i in range(25)]]))
    texts += [texts[0], texts[1], None, "", texts[2] + " " + texts[2]]
    got = {x["doc_id"]: x for x in substring_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "text", window=35, joined=True).collect()}
    for n, want in enumerate(brute_removal(texts)):
        assert (got[n]["n_words"], got[n]["n_removed"], got[n]["text"]) == want


def test_matching_statistics_equal_brute_force():
    r = random.Random(2)
    held = [[r.choice("abc") for _ in range(r.randrange(1, 30))] for _ in range(20)]
    weights = [r.choice([1, 1, 2]) for _ in held]
    automaton = substring_dedup.SuffixAutomaton()
    for w, n in zip(held, weights, strict=True):
        automaton.add(w, n)
    matcher = substring_dedup.Matcher(automaton.dump())

    def occurs(run):
        return sum(n for w, n in zip(held, weights, strict=True) for i in range(len(w) - len(run) + 1) if w[i : i + len(run)] == run)

    for own, seen in ((True, held), (False, [[r.choice("abcd") for _ in range(25)] for _ in range(20)])):
        for w in seen:
            want = [max(n for n in range(e + 1) if not n or occurs(w[e - n : e]) >= 1 + own) for e in range(1, len(w) + 1)]
            assert matcher.statistics(w, own) == want


def vectors(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((300, 16))
    x[100:200] = x[:100] + r.standard_normal((100, 16)) * 0.08
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(300, rows[0][1]), (301, None), (302, [0.0] * 16), (303, [float("nan")] + [1.0] * 15), (304, [None] + [1.0] * 15)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_top_k_is_exact(spark):
    rows, df = vectors(spark)
    whole = [(i, np.floor(256 * np.array(v, float))) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    want = set()
    for i, q in whole:
        if i % 50 == 0:
            best = sorted(((-int(q @ v), j) for j, v in whole if j != i))[:5]
            want |= {(i, k, j, -s) for k, (s, j) in enumerate(best, 1)}
    assert {tuple(r) for r in topk.top_k(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5, 256.0).collect()} == want
    assert topk.top_k(df.limit(0), "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5, 256.0).count() == 0


def test_near_vectors(spark):
    rows, df = vectors(spark)
    good = {i: np.array(v, float) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    links = {i: set() for i, _ in rows}
    for i in good:
        links[i] = {j for j in good if j != i and good[i] @ good[j] / np.sqrt(good[i] @ good[i] * (good[j] @ good[j])) >= 0.95}
    got = {r["vec_id"]: r for r in vector_dedup.near_duplicate_vectors(df, "vec_id", "embedding").collect()}
    found, all_ = sum(r["n_links"] for r in got.values()), sum(map(len, links.values()))
    assert len(got) == len(rows) and 0.9 * all_ <= found <= all_
    assert all(r["n_links"] <= len(links[i]) and r["kept"] == (r["component_id"] == i) for i, r in got.items())
    assert vector_dedup.near_duplicate_vectors(df.limit(0), "vec_id", "embedding").count() == 0


@pytest.mark.parametrize(("width", "rows"), [(16, 10**5), (64, 10**6)])
def test_vector_filters_keep_recall_as_tables_grow(width, rows):
    listed, tables = vector_dedup.plan(width, rows, 0.95)
    a, b = vector_dedup.pairs_at(width, 0.95, 1000, 5)
    met, each = np.zeros(len(a), bool), 0
    for seed in range(tables):
        code = vector_dedup.ProductCode(width, rows, seed, listed)
        assert len(np.unique(code.decode(a)[0])) == len(a)
        found, n = vector_dedup.meeting(code, a, b)
        met, each = met | found, each + n / len(a)
    assert met.mean() >= 0.99 and each < rows / vector_dedup.GROUP
    assert vector_dedup.meeting(vector_dedup.ProductCode(width, rows, 0, listed), a, a * 3.7 / 3.7)[0].all()


def brute_vector_links(x, threshold):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return [set(np.flatnonzero(row >= threshold).tolist()) - {i} for i, row in enumerate(unit @ unit.T)]


def vector_links(spark, x, threshold):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    return {r["vec_id"]: r for r in vector_dedup.near_duplicate_vectors(df, "vec_id", "embedding", threshold).collect()}


@pytest.mark.parametrize("rows", [1, 40, 500, 2000])
def test_tables_of_any_size_go_by_filters(rows):
    for width in (4, 8, 64):
        assert vector_dedup.plan(width, rows, 0.95)[1] >= 1
    assert vector_dedup.plan(3, rows, 0.95)[1] == vector_dedup.plan(64, rows, 0.0)[1] == 0


def test_small_tables_of_vectors(spark):
    x = np.random.default_rng(3).standard_normal((400, 8))
    want, got = brute_vector_links(x, 0.8), vector_links(spark, x, 0.8)
    assert all(got[i]["n_links"] <= len(want[i]) for i in got)
    assert sum(r["n_links"] for r in got.values()) >= 0.99 * sum(map(len, want))


@pytest.mark.parametrize(("centres", "each", "near"), [(2000, 3, 0.03), (3, 1500, 0.02)])
def test_clustered_vectors_go_by_filters(spark, centres, each, near):
    """Many small groups of near vectors; and a few that are larger than a filter's block."""
    r = np.random.default_rng(11)
    middle = r.standard_normal((centres, 24))
    x = np.repeat(middle, each, axis=0) + near * r.standard_normal((centres * each, 24))
    assert vector_dedup.plan(24, len(x), 0.95)[1] >= 1 and (each < vector_dedup.SPLIT or centres == 3)
    want, got = brute_vector_links(x, 0.95), vector_links(spark, x, 0.95)
    head = heads(dict(enumerate(want)))
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == {i: (len(want[i]), head[i]) for i in range(len(x))}


def plain_targets(sizes, weights, epochs=3.0):
    """Water-filling one source at a time: the fullest goes to its cap first."""
    target, open_, rest = {}, set(sizes), float(sum(sizes.values()))
    while open_:
        level = rest / sum(weights[s] for s in open_)
        over = [s for s in open_ if weights[s] * level > epochs * sizes[s]]
        if not over:
            return target | {s: weights[s] * level for s in open_}
        s = min(over, key=lambda s: epochs * sizes[s] / weights[s])
        target[s] = epochs * sizes[s]
        open_.remove(s)
        rest -= target[s]
    return target


def held_against_plain(rows, got, copies):
    """rows: id, text, source; got: the report; copies: the mix itself."""
    size = [len(SPLIT.findall(t or "")) for _, t, _ in rows]
    sizes = {}
    for n, (_, _, s) in zip(size, rows, strict=True):
        sizes[s] = sizes.get(s, 0) + n
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    target = plain_targets(sizes, {s: i % 3 + 1 for i, s in enumerate(names)})
    assert sorted((r[0] is None, r[0] or 0, r[1], r[2]) for r in got) == sorted((i is None, i or 0, n, sizes[s]) for n, (i, _, s) in zip(size, rows, strict=True))
    known = {}
    for n, (i, t, s) in zip(size, rows, strict=True):
        known.setdefault((i, n), set()).add(s)
    taken = {}
    for r in got:
        assert r[4] <= 3 * r[1]
        (s,) = known[r[0], r[1]]
        assert abs(r[3] - target[s]) < 1e-6
        taken[s] = taken.get(s, 0) + r[4]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max((n for n, (_, _, x) in zip(size, rows, strict=True) if x == s), default=0)
    assert sum(len(SPLIT.findall(t or "")) for (t,) in copies) == sum(taken.values())


def test_mix_reaches_targets(spark, docs, texts, none):
    rows = [(i, t, [None, "a", "b", "c", "é"][i % 5 if i % 7 else 1]) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "clash", 5, "kept") for r in rows], "doc_id long, text string, source string, size string, whole int, `mix hash` string").repartition(3)
    got = mixing.mix_report(df, "doc_id", "text", "source", mixing.cyclic_weights(3))
    copies = mixing.mix(df, "doc_id", "text", "source", mixing.cyclic_weights(3))
    assert copies.columns == df.columns and {tuple(r) for r in copies.select("size", "whole", "mix hash").distinct().collect()} == {("clash", 5, "kept")}
    held_against_plain(rows, got.collect(), copies.select("text").collect())
    assert sorted(got.collect(), key=str) == sorted(got.collect(), key=str)
    for empty in (none.withColumn("source", F.lit("a")), df.limit(0)):
        assert mixing.mix_report(empty, "doc_id", "text", "source", mixing.cyclic_weights(3)).count() == 0
        assert mixing.mix(empty, "doc_id", "text", "source", mixing.cyclic_weights(3)).count() == 0


def test_repeated_rows_reach_targets(spark):
    ten = "one two three four five six seven eight nine ten"
    rows = [(1, ten, "a")] * 100 + [(i, ten, "b") for i in range(2, 42)] + [(None, None, "c"), (None, "x", None), (None, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix_report(df, "doc_id", "text", "source", mixing.cyclic_weights(3)).collect()
    held_against_plain(rows, got, mixing.mix(df, "doc_id", "text", "source", mixing.cyclic_weights(3)).select("text").collect())


def test_languages_held_out(spark, none):
    r = random.Random(4)
    parts = {"xx": "the and of to in that is was he for it with as his on be at by".split(), "yy": "der die und in den von zu das mit sich des auf für ist im dem nicht ein".split()}
    rows = [(i, k, " ".join(r.choice(parts[k]) for _ in range(25))) for i in range(80) for k in [r.choice(list(parts))]]
    rows += [(1000, "xx", None), (1001, None, "123 !!"), (1002, None, "")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language.learn(df, "text", "lang", F.col("doc_id") % 2 == 0, PIECE)
    got = {x["doc_id"]: x for x in language.predict(df, "text", model, PIECE).collect()}
    assert all(got[i]["lang_pred"] == k for i, k, _ in rows if i < 1000)
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3
    assert language.predict(df.limit(0), "text", model, PIECE).count() == 0
    odd = spark.createDataFrame([(1, "²½ 12", "a"), (1, "²½ 12", "b"), (2, "the " * 50_000, None), (3, "x" * 5000 + " the and of", "c"), (None, "der die und", "d")], "doc_id long, text string, score string")
    seen = language.predict(odd, "text", model, PIECE)
    assert seen.columns == ["doc_id", "text", "score", "lang_pred", "score_"]
    by = {r["score"]: r for r in seen.collect()}
    assert [by[k]["lang_pred"] for k in ("a", "b", None, "d")] == ["und", "und", "xx", "yy"] and all(0 <= r["score_"] <= 1 for r in by.values())
    untaught = language.learn(df.where("false"), "text", "lang", F.lit(True), PIECE)
    assert {r["lang_pred"] for r in language.predict(df, "text", untaught, PIECE).collect()} == {"und"}


def segmentations(run):
    if not run:
        yield []
    for k in range(1, len(run) + 1):
        for rest in segmentations(run[k:]):
            yield [run[:k], *rest]


def test_forward_sums_all_segmentations():
    pieces = language.Pieces(open(PIECE, "rb").read())
    r = np.random.default_rng(4)
    prob = r.random((pieces.size + 1, 3)) / pieces.size
    prob[-1] = 0
    runs = ["▁the", "▁streams", "▁über", "▁北京", "▁qxzj", "▁a", "▁andthe"]
    got = language.log_likelihoods(pieces, runs, prob)
    for run, values in zip(runs, got, strict=True):
        want = np.zeros(3)
        for cut in segmentations(run):
            numbers = [pieces.number.get(p, 0 if len(p) == 1 else -1) for p in cut]
            if -1 not in numbers:
                want += np.prod(prob[numbers], axis=0)
        assert np.allclose(values, np.log(want))


def test_long_runs_are_scored_whole():
    pieces = language.Pieces(open(PIECE, "rb").read())
    prob = np.random.default_rng(5).random((pieces.size + 1, 2)) / pieces.size
    prob[-1] = 0
    run = "▁" + "".join(random.Random(1).choice(["the", "and", "stream", "q", "北"]) for _ in range(60))
    got = language.log_likelihoods(pieces, [run], prob)[0]
    # the forward pass with exact fractions
    from fractions import Fraction

    for j in range(2):
        alpha = [Fraction(1)]
        for e in range(1, len(run) + 1):
            numbers = [(k, pieces.number.get(run[e - k : e], 0 if k == 1 else -1)) for k in range(1, min(e, pieces.longest) + 1)]
            alpha.append(sum(alpha[e - k] * Fraction(float(prob[m, j])) for k, m in numbers if m >= 0))
        top, bottom = alpha[-1].numerator, alpha[-1].denominator
        want = (top.bit_length() - bottom.bit_length()) * np.log(2) + np.log((top >> max(top.bit_length() - 60, 0)) / 2.0 ** min(top.bit_length(), 60)) - np.log((bottom >> max(bottom.bit_length() - 60, 0)) / 2.0 ** min(bottom.bit_length(), 60))
        assert abs(got[j] - want) < 1e-6


def test_fit_equals_expectation_maximisation_over_all_segmentations():
    pieces = language.Pieces(open(PIECE, "rb").read())
    runs, counts = ["▁the", "▁then", "▁over", "▁ove"], np.array([3.0, 1, 2, 1])
    prob = np.full(pieces.size + 1, 1 / pieces.size)
    for _ in range(2):
        mass = np.zeros(pieces.size + 1)
        for run, n in zip(runs, counts, strict=True):
            cuts = [[pieces.number.get(p, 0 if len(p) == 1 else -1) for p in cut] for cut in segmentations(run)]
            cuts = [c for c in cuts if -1 not in c]
            weight = np.array([np.prod(prob[c]) for c in cuts])
            for c, w in zip(cuts, weight / weight.sum(), strict=True):
                np.add.at(mass, c, n * w)
        prob = (1 - language.SMOOTH) * mass / mass.sum() + language.SMOOTH / pieces.size
    assert np.allclose(language.fit(pieces, runs, counts, rounds=2)[:-1], prob[:-1])


def test_quality_rejects_junk(spark, none):
    r = random.Random(6)
    words = "house river stone walks under bright morning people learn about small gardens when summer comes with quiet rain".split()
    clean = [" ".join(r.choice(words) for _ in range(30)).capitalize() + "." for _ in range(120)]
    junk = [" ".join(r.choice(["$$$", "BUY", "###", "WIN!!!", "||", "1234%"]) for _ in range(30)) for _ in range(40)]
    rows = list(enumerate(clean + junk + [None, "", "  "]))
    got = {x["doc_id"]: x for x in quality.quality_scores(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert sum(got[i]["keep"] for i in range(120)) >= 118
    assert sum(got[i]["keep"] for i in range(120, 160)) <= 2
    assert not any(got[i]["keep"] for i in range(160, 163))
    assert quality.quality_scores(none, "doc_id", "text").count() == 0


@pytest.mark.parametrize("share", [0.03, 0.6])
def test_quality_rejects_repetition(spark, share):
    r = random.Random(8)
    words = [f"{a}{b}{c}" for a in "bdfglm" for b in "aeiou" for c in ("n", "rst", "lo", "ke")]
    n = round(400 * share)
    clean = [" ".join(r.choice(words) for _ in range(60)).capitalize() + "." for _ in range(400 - n - 20)]
    symbols = [" ".join(r.choice(["$$$", "BUY", "###", "WIN!!!", "||", "1234%"]) for _ in range(30)) for _ in range(20)]
    again = [" ".join([r.choice(words).capitalize()] * 60) if i % 2 else "\n".join([" ".join(r.choice(words) for _ in range(9))] * 12) for i in range(n)]
    rows = list(enumerate(clean + symbols + again))
    got = {x["doc_id"]: x["keep"] for x in quality.quality_scores(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert sum(got[i] for i in range(len(clean))) >= 0.98 * len(clean)
    assert sum(got[i] for i in range(len(clean), 400)) <= 0.1 * (n + 20)


def draws(spark, texts):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return {r["t"]: r["d"] for r in df.select("t", F.xxhash64("t").alias("d")).collect()}


@pytest.mark.parametrize("high", [False, True])
def test_quality_of_one_row_many_times(spark, high):
    """Copies of a row have one draw, low or high; they are one text of the sample."""
    drawn = draws(spark, [f"The river runs below the old bridge number {k} of the town." for k in range(50)])
    text = (max if high else min)(drawn, key=drawn.get)
    df = spark.createDataFrame([(7, text)], "doc_id long, text string").selectExpr("doc_id", "text", "explode(sequence(1, 10000)) AS score")
    got = quality.quality_scores(df, "doc_id", "text")
    assert got.columns == ["doc_id", "text", "score", "score_", "weak_label", "keep"]
    assert [(r["score_"] > 0, r["n"]) for r in got.groupBy("score_").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()] == [(True, 10000)]


def test_quality_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 20)
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 3000)
    texts = [f"Some words of text {i} and {i * i} more." for i in range(200)] + [None, "", " \t"] * 30 + ["word " * 60_000]
    df = spark.createDataFrame(list(enumerate(texts * 3)), "doc_id long, text string").repartition(4)
    got = quality.quality_scores(df, "doc_id", "text").collect()
    assert len(got) == len(texts) * 3 and not any(r["keep"] for r in got if not (r["text"] or "").split())
    # A long text alone is still taken.
    alone = spark.createDataFrame([(1, "word " * 60_000), (2, "")], "doc_id long, text string")
    assert [r["score"] > 0 for r in quality.quality_scores(alone, "doc_id", "text").orderBy("doc_id").collect()] == [True, False]
    blank = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert [r["keep"] for r in quality.quality_scores(blank, "doc_id", "text").collect()] == [False, False]


def test_top_k_of_odd_vectors(spark):
    """Ties, repeated ids, unequal widths, empty vectors, fewer than k candidates, scores beyond the long range, clashing names."""
    rows = [(0, [1.0, 2.0], 1), (50, [1.0], 2), (50, [0.0, 1.0], 3), (3, [1.0, 2.0], 4), (2, [1.0, 2.0], 5), (9, [], 6), (None, [1.0], 7), (7, [5.0, 5.0, 5.0], 8), (8, [1e16, -1e16], 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(3)

    def clamp(v):
        return min(max(v, -(1 << 63)), (1 << 63) - 1)

    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in rows if i is not None]
    want = set()
    for q in (0, 50):
        best = {}
        for i, v in whole:
            for j, w in whole:
                if i == q and j != q:
                    score = clamp(sum(a * b for a, b in zip(v, w, strict=False)))
                    best[j] = max(best.get(j, score), score)
        want |= {(q, k, j, s) for k, (s, j) in enumerate(sorted(((s, j) for j, s in best.items()), key=lambda x: (-x[0], x[1]))[:5], 1)}
    got = topk.top_k(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5, 256.0)
    assert {tuple(r) for r in got.collect()} == want
    few = df.where("vec_id in (0, 3)")
    assert [tuple(r) for r in topk.top_k(few, "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5, 256.0).collect()] == [(0, 1, 3, 5 * 256 * 256)]


def test_top_k_prunes_by_length_without_loss(spark, monkeypatch):
    for name, value in (("BLOCK", 40), ("QUERIES", 3)):
        monkeypatch.setattr(topk, name, value)
    r = np.random.default_rng(12)
    x = r.standard_normal((600, 6)) * r.choice([0.05, 1, 9], (600, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    whole = [(i, np.floor(256 * np.array(v))) for i, v in rows]
    want = {(i, k, j, -s) for i, q in whole if i % 50 == 0 for k, (s, j) in enumerate(sorted((-int(q @ v), j) for j, v in whole if j != i)[:5], 1)}
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5, 256.0)
    assert {tuple(x) for x in got.collect()} == want


def test_near_vectors_of_odd_rows(spark):
    r = np.random.default_rng(6)
    base = r.standard_normal(12)
    rows = [(i, (base * (1 + i)).tolist(), "a") for i in range(40)] + [(40 + i, base.tolist(), "b") for i in range(60)]
    rows += [(100, [*base.tolist(), 0.0, 0.0], "c"), (101, base[:3].tolist(), "d"), (None, base.tolist(), "e"), (None, None, "f"), (102, [], "g"), (7, base.tolist(), "h")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links string").repartition(4)
    got = vector_dedup.near_duplicate_vectors(df, "vec_id", "embedding")
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    out = sorted((tuple(x) for x in got.collect()), key=lambda t: (t[0] is None, t[0] or 0, t[1]))
    alike = [t for t in out if t[0] is not None and t[0] <= 100]
    assert all(t[1:3] == (101, 0) and t[3] == (t[0] == 0) for t in alike) and len(alike) == 102
    assert [t for t in out if t[0] in (101, 102)] == [(101, 0, 101, True), (102, 0, 102, True)]
    assert [t for t in out if t[0] is None] == [(None, 0, None, False)] * 2


def test_tokens_of_tables_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "Hello there", 5, "x", None), (1, "Hello there", 5, "x", None), (None, None, None, None, 3)], "doc_id long, text string, n_tokens int, ids string, n_bytes int")
    one = bpe.bpe_encode_decode(df, "text", WORD)
    assert one.columns[:5] == df.columns and len(set(map(str.lower, one.columns))) == len(one.columns)
    assert {(r[0], r[2], r[3]) for r in one.collect()} == {(1, 5, "x"), (None, None, None)} and one.count() == 3
    two = token_counts.token_counts(df, "text", PIECE)
    assert two.columns[:5] == df.columns and {r["n_tokens"] for r in two.collect()} == {5, None}


def test_token_files_of_odd_keys(spark, tmp_path):
    rows = [(None, "first"), (None, "second"), (5, "b"), (5, "a"), (5, None), (-3, "x " * 5000), (1 << 62, "last")]
    df = spark.createDataFrame(rows, "k long, keys string").repartition(3)
    folder = f"file://{tmp_path}/odd"
    manifest = token_file.write_token_files(df, "k", "keys", WORD, 2, folder)
    back = sorted(token_file.read_token_files(manifest).collect(), key=lambda r: r["start"])
    assert [r["key"] for r in back] == [None, None, -3, 5, 5, 5, 1 << 62]
    want = {r["k"]: [] for r in df.collect()}
    for r in bpe.bpe_encode_decode(df, "keys", WORD).collect():
        want[r["k"]].append(bytes(r["ids"]) + (2).to_bytes(4, "little"))
    start, got = 0, {k: [] for k in want}
    for r in back:
        assert r["start"] == start
        start += len(r["ids"]) // 4
        got[r["key"]].append(bytes(r["ids"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    asked = spark.createDataFrame([(5,), (-3,), (6,), (None,), (1 << 62,)], "keys long")
    found = {(r["key"], bytes(r["ids"])) for r in token_file.lookup_token_files(manifest, asked, "keys").collect()}
    assert {k for k, _ in found} == {5, -3, 1 << 62} and all(i in got[k] for k, i in found)
    # A task that runs again replaces its shard with the same bytes.
    before = {p.name: p.read_bytes() for p in (tmp_path / "odd").glob("shard-*.*")}
    for p in (tmp_path / "odd").glob("shard-*.*"):
        p.write_bytes(b"torn")
    token_file.write_token_files(df, "k", "keys", WORD, 2, folder + "-again")
    after = {p.name: p.read_bytes() for p in (tmp_path / "odd-again").glob("shard-*.*")}
    assert before == after


def test_token_file_shards_are_bounded(spark, tmp_path):
    rows = [(i // 3 if i % 11 else None, "word " * (i % 17)) for i in range(400)] + [(7, "hot")] * 300
    df = spark.createDataFrame(rows, "k long, t string")
    whole = token_file.write_token_files(df, "k", "t", WORD, 2, f"file://{tmp_path}/whole")
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "attempt-0-99-0.bin").write_bytes(b"of a lost executor")
    cut = token_file.write_token_files(df, "k", "t", WORD, 2, f"file://{tmp_path}/cut", shard_ids=40, shard_docs=9)
    shards = cut.orderBy("shard").collect()
    assert len(shards) > 60 and [r["shard"] for r in shards] == list(range(len(shards)))
    # The document that fills a shard is its last.
    assert all(r["n_docs"] <= 9 and r["n_ids"] < 40 + 20 for r in shards)
    assert not list((tmp_path / "cut").glob("attempt-*"))
    told = [sorted(((r["start"], r["key"], bytes(r["ids"])) for r in token_file.read_token_files(m).collect()), key=lambda r: r[0]) for m in (whole, cut)]
    assert told[0] == told[1] and len(told[0]) == 700
    # A key's documents may lie in several shards, each of which gives its first.
    found = token_file.lookup_token_files(cut, spark.createDataFrame([(7,), (50,), (10**6,)], "k long"), "k").collect()
    assert {r["key"] for r in found} == {7, 50} and len({r["shard"] for r in found if r["key"] == 7}) > 30
    assert {(r["start"], r["key"], bytes(r["ids"])) for r in found} <= set(told[0])


def test_perfect_hash_finds_every_key():
    keys = np.unique(np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 20_000))
    index = token_file.ShardIndex.build(keys, np.ones(len(keys), bool), np.arange(len(keys) + 1))
    again = token_file.ShardIndex.load(index.dump())
    assert (again.lookup(keys) == np.arange(len(keys))).all() and len(set(again.hash.find(keys.view(np.uint64)).tolist())) == len(keys)
    assert (again.lookup(keys[:-1] + 1) >= 0).sum() <= 3


def test_digests_agree(docs):
    out = bpe.bpe_encode_decode(docs, "text", WORD).select("ids", F.sha2("ids", 256).alias("h")).collect()
    assert all(r["h"] == hashlib.sha256(bytes(r["ids"])).hexdigest() for r in out)


def test_runs_are_scored_with_few_places_held(monkeypatch):
    """The same likelihoods as with all places, whatever is held; runs of very many letters in bounded time."""
    import time

    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        pieces = language.Pieces(f.read())
    r = np.random.default_rng(4)
    prob = np.vstack([r.dirichlet(np.ones(pieces.size), 3).T, np.zeros(3)])
    words = ["".join(r.choice(list("abcdeorstnié日")) for _ in range(r.integers(1, 60))) for _ in range(200)]
    words += ["".join(r.choice(list("aeorstn")) for _ in range(n)) for n in (16, 17, 33, 2500)]
    want = np.zeros((len(words), 3))
    for at, table in pieces.lattice(words):
        alpha, lacks = language._forward(table, prob)
        want[at] = np.log(np.maximum(alpha[-1], 1e-300)) + lacks[-1]
    for places, letters, held, few in ((1024, 400_000, 64 << 20, 64), (1024, 400_000, 64 << 20, 0), (3, 50, 1, 64), (3, 50, 1, 0), (1, 1, 10_000, 1)):
        monkeypatch.setattr(language, "FEW", few)
        monkeypatch.setattr(language, "PLACES", places)
        monkeypatch.setattr(language, "LETTERS", letters)
        monkeypatch.setattr(language, "HELD", held)
        assert np.allclose(language.log_likelihoods(pieces, words, prob), want, rtol=1e-9)
    monkeypatch.undo()
    long = "".join(r.choice(list("aeorstnlmdu"), 200_000))
    began = time.time()
    assert np.isfinite(language.log_likelihoods(pieces, [long], prob)).all() and time.time() - began < 60
    began = time.time()
    fitted = language.fit(pieces, [long], np.ones(1), rounds=1)
    assert fitted[:-1].sum() == pytest.approx(1) and time.time() - began < 60
