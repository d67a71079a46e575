"""The corpus pipeline, stage by stage against plain versions, and its odd inputs."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinloom.llm import quality
from test_llm import brute_links, brute_removal, heads, plain_targets

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep string, row int, spans string"


def corpus():
    r = random.Random(21)
    words = [f"{a}{b}{c}" for a in "bdfglmnprst" for b in "aeiou" for c in ("n", "rst", "lo", "ke", "st")]
    text = lambda n: " ".join(r.choice(words) for _ in range(n)).capitalize() + "."
    passage = text(50)
    out = []
    for i in range(120):
        base = text(r.randrange(30, 90))
        if i % 9 == 0:
            base += "\n" + passage + "  " + text(20)
        out += [base] * r.choice([1, 1, 1, 2])
        if i % 4 == 0:
            w = base.split(" ")
            w[-2] = "changed"
            out.append(" ".join(w))
    junk = [" ".join(r.choice(["$$$", "BUY", "###", "WIN!!!", "||", "1234%"]) for _ in range(30)) for _ in range(25)]
    again = [" ".join([r.choice(words).capitalize()] * 60) for _ in range(10)]
    rows = [(i, t, "xx", "abc"[i % 3] if i % 7 else None, len(t), "mine", 7, None) for i, t in enumerate(out + junk + again)]
    return rows + [(None, text(40), None, None, None, None, None, "x"), (900, None, "xx", "a", 0, "mine", 7, None), (901, "", "xx", "a", 0, "mine", 7, None), rows[0], rows[0]], len(out)


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_stages_equal_plain_versions(spark, rows):
    rows, clean = rows
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["quality_classifier"](spark, docs, "").collect()
    assert {tuple(k) for k in kept} <= set(rows)
    ids = [k["doc_id"] for k in kept]
    assert not any(i is not None and i >= clean for i in ids) and len(set(ids)) >= 0.98 * clean

    docs = spark.createDataFrame(kept, SCHEMA)
    links = brute_links([k["text"] for k in kept])
    head = heads(links)
    one = stages["ngram_jaccard_join"](spark, docs, "").collect()
    classes = {}
    for i, k in enumerate(kept):
        classes.setdefault(head[i], []).append(k)
    assert len(one) == len(classes)
    for members in classes.values():
        (left,) = [o for o in one if o in members]
        assert left["doc_id"] == min((m["doc_id"] for m in members if m["doc_id"] is not None), default=None)

    docs = spark.createDataFrame(one, SCHEMA)
    cut = stages["substring_dedup"](spark, docs, "").collect()
    want = brute_removal([o["text"] for o in one])
    assert len(cut) == len(one)
    by = {(o["doc_id"], o["keep"]): (o, w) for o, w in zip(one, want, strict=True)}
    for c in cut:
        o, (n, gone, words) = by[c["doc_id"], c["keep"]]
        assert " ".join(SPLIT.findall(c["text"])) == words and c["n_chars"] == len(c["text"])
        assert gone or c["text"] == o["text"]
        assert [c[k] for k in ("lang", "source", "row", "spans")] == [o[k] for k in ("lang", "source", "row", "spans")]

    docs = spark.createDataFrame(cut, SCHEMA)
    mixed = stages["mix_sources"](spark, docs, "").collect()
    size = lambda r: len(SPLIT.findall(r["text"] or ""))
    sizes, taken = {}, {}
    for c in cut:
        sizes[c["source"]] = sizes.get(c["source"], 0) + size(c)
    for m in mixed:
        taken[m["source"]] = taken.get(m["source"], 0) + size(m)
    names = sorted(s for s in sizes if s) + [None]
    target = plain_targets(sizes, {s: i % 3 + 1 for i, s in enumerate(names)})
    assert set(mixed) <= set(cut) and all(mixed.count(c) <= 3 for c in cut)
    assert all(abs(taken.get(s, 0) - target[s]) <= max(size(c) for c in cut) for s in sizes)

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    for b in stages["bpe_encode_decode"](spark, spark.createDataFrame(mixed, SCHEMA), "").collect():
        ids = t.encode(b["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(b["ids"]), "<u4").tolist() == ids and b["n_tokens"] == len(ids)
        assert b["decoded"] == t.decode(ids, skip_special_tokens=False)


def test_run_takes_whole_and_empty_tables(spark, rows, tmp_path):
    rows, _ = rows
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert [c for c in out.columns if c in docs.columns] == docs.columns and 0 < out.count()
    assert sorted(map(str, out.drop("ids").collect())) == sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).drop("ids").collect()))
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([(1, None, None, None, None, None, None, None)], SCHEMA), "").count() <= 1


def plain_posterior(codes, counts, labellers, rounds=100):
    """Expectation maximisation over every single text, vote by vote."""
    votes = [[c // 3 ** (labellers - 1 - k) % 3 for k in range(labellers)] for c, n in zip(codes, counts, strict=True) for _ in range(int(n))]
    right = {(k, v): 0.8 for k in range(labellers) for v in (1, 2)}
    for _ in range(rounds):
        clean = []
        for v in votes:
            yes = no = 1.0
            for k, x in enumerate(v):
                if x:
                    yes *= right[k, x] if x == 1 else 1 - right[k, x]
                    no *= 1 - right[k, x] if x == 1 else right[k, x]
            clean.append(yes / (yes + no))
        for k, x in right:
            cast = [p if x == 1 else 1 - p for v, p in zip(votes, clean, strict=True) if v[k] == x]
            right[k, x] = min(max((sum(cast) + 1) / (len(cast) + 1.25), quality.RIGHT[0]), quality.RIGHT[1])
    return {tuple(v): p for v, p in zip(votes, clean, strict=True)}


def test_label_model_equals_a_plain_one():
    r = np.random.default_rng(7)
    truth = r.random(4000) < 0.6
    accuracy = [0.95, 0.9, 0.8, 0.7]
    votes = np.array([np.where(r.random(4000) < 0.8, np.where((r.random(4000) < a) == truth, 1, 2), 0) for a in accuracy]).T
    codes, counts = np.unique(votes @ 3 ** np.arange(3, -1, -1), return_counts=True)
    got = quality.label_model(codes, counts.astype(float), 4)
    plain = plain_posterior(codes, counts, 4)
    for c, p in zip(codes, got, strict=True):
        assert abs(p - plain[tuple(int(c) // 3 ** (3 - k) % 3 for k in range(4))]) < 1e-3
    by = dict(zip(codes.tolist(), got, strict=True))
    judged = np.array([by[int(v @ 3 ** np.arange(3, -1, -1))] for v in votes])
    # One accuracy for each vote and an even prior favour the larger class, so this is less than the best labeller alone would reach.
    assert ((judged > 0.5) == truth)[np.abs(judged - 0.5) > 1e-6].mean() > 0.8


def test_scorer_learns_what_its_labels_say():
    r = np.random.default_rng(8)
    at = [np.sort(r.choice(50, 6, replace=False)) for _ in range(600)]
    label = np.array([float((a < 25).sum() >= 3) for a in at])
    weights, offset = quality.train(at, [np.full(6, 1 / 6)] * 600, label)
    score = np.array([weights[a].sum() / 6 + offset for a in at])
    assert ((score > 0) == (label > 0.5)).mean() > 0.95


def test_quality_of_odd_tables(spark):
    long = "Quiet rivers bend slowly under old stone bridges while people walk home. "
    one = spark.createDataFrame([(i, long * (1 + i % 3), i, "x") for i in range(30)], "doc_id long, text string, score int, keep string")
    out = quality.quality_scores(one, "doc_id", "text")
    assert out.columns == ["doc_id", "text", "score", "keep", "score_", "weak_label", "keep_"] and out.count() == 30
    assert {(r["score"], r["keep"]) for r in out.collect()} == {(i, "x") for i in range(30)}
    words = [f"w{i}ord" for i in range(500)]
    r = random.Random(3)
    huge = " ".join(r.choice(words) for _ in range(150_000))
    rows = [(None, huge), (1, "$$$ ### !!! " * 50_000), (1, None), (2, "\t\n"), (2, "\t\n")] + [(i, "") for i in range(70_000)]
    got = quality.quality_scores(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "doc_id", "text")
    assert got.count() == len(rows) and got.where("text is null or trim(text) = '' or text rlike '^\\\\s+$'").where("keep or score > 0").count() == 0
