"""Exact duplicates, source divergence and periodic runs against plain versions, on odd rows too."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kinloom.llm import divergence, exact_dedup, periodic_runs, queries


# Exact duplicates.

BLANK = re.compile(r"[\x20\x09-\x0D]")


def plain_groups(rows):
    """(key, text) -> sorted (key, keep, copies, kept, digest); of rows equal in key and text one stays."""
    by = defaultdict(list)
    for n, (key, text) in enumerate(rows):
        by[BLANK.sub("", text or "")].append((-len(text or ""), key is None, key if key is not None else 0, n, key))
    out = []
    for t, group in by.items():
        best = min(group)
        out += [(g[4], best[4], len(group), g is best, hashlib.sha256(t.encode()).hexdigest()) for g in group]
    return sorted(out, key=repr)


def found_groups(df, **more):
    return sorted(((r.key, r.keep, r.copies, r.kept, r.digest.hex()) for r in exact_dedup.exact_groups(df, "id", "text", **more).collect()), key=repr)


def test_exact_groups_on_odd_rows(spark):
    rows = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \t\n\x0b\x0c\r"), (7, "é 🙂"), (8, "é🙂"), (None, "a  b"), (2, "ab"), (9, "a b"), (3, "a  b"), (10, "x" * 200_000), (11, "x " * 100_000 + "x" * 100_000)]
    rows += [(100 + i, "many  copies" if i % 7 else "many copies ") for i in range(3000)] + [(5000 + i, f"text {i % 900}") for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, text string").withColumns({"digest": F.lit("clash"), "key": F.lit(1), "row": F.lit(2), "copies": F.lit(0)}).repartition(5)
    want = plain_groups(rows)
    assert found_groups(df) == want
    for history in (F.lit(True), F.lit(False), F.col("key") % 3 == 0):
        assert found_groups(df, historical=history) == want
    kept = exact_dedup.drop_repeats(df, "id", "text")
    assert kept.columns == df.columns
    assert sorted((r.id for r in kept.collect()), key=repr) == sorted((w[0] for w in want if w[3]), key=repr)


def test_exact_groups_of_empty_and_single_tables(spark):
    none = spark.createDataFrame([], "id long, text string")
    assert found_groups(none) == [] and exact_dedup.drop_repeats(none, "id", "text").count() == 0
    one = spark.createDataFrame([(None, None)], "id long, text string")
    assert found_groups(one) == plain_groups([(None, None)])
    words = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "x")], "id string, text string")
    assert {r.keep for r in exact_dedup.exact_groups(words, "id", "text", historical=F.col("key") == "b").collect()} == {"a"}


def test_index_compares_whole_digests(spark):
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    rows = pa.table({"digest": pa.array(digests[:3000], pa.binary()), "copies": np.ones(3000, np.int64), "points": np.arange(3000), "key": np.arange(3000), "row": np.arange(3000)})
    index = exact_dedup.DigestIndex.load({k: v for k, v in exact_dedup.DigestIndex.build(rows).dump().items()})
    slots = index.find(pa.array(digests, pa.binary()))
    assert sorted(slots[:3000]) == list(range(3000))  # minimal and perfect
    assert (slots[3000:] == -1).all()
    held = index.slots["digest"].to_pylist()
    assert all(held[s] == d for s, d in zip(slots[:3000], digests, strict=False))
    # The same first, second, third and last eight bytes in one digest each: another seed is taken.
    near = [b"a" * 8 + bytes([i]) * 24 for i in range(200)]
    again = exact_dedup.DigestIndex.build(pa.table({**{c: np.zeros(200, np.int64) for c in ("copies", "points", "key", "row")}, "digest": pa.array(near, pa.binary())}))
    assert sorted(again.find(pa.array(near, pa.binary()))) == list(range(200))


# Source divergence.


def plain_divergence(rows, least, most):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs, counts, groups = Counter(), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(divergence.TERM_PATTERN, (text or "").translate(lower))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs.update((lang, t) for t in set(terms))
    kept = defaultdict(list)
    for (lang, t), n in docs.items():
        if n >= least:
            kept[lang].append(t)
    p, q = {}, {}
    for lang in {g[0] for g in groups}:
        v, own = len(kept[lang]), [g for g in groups if g[0] == lang]
        for g in own:
            n = sum(counts[g][t] for t in kept[lang])
            p[g] = {t: 1 + 10**9 * (counts[g][t] + 5) // (n + 5 * v) for t in kept[lang]}
        n = sum(counts[g][t] for g in own for t in kept[lang])
        q[lang] = {t: 1 + 10**9 * (sum(counts[g][t] for g in own) + 5) // (n + 5 * v) for t in kept[lang]}
    out = []
    for lang, source in groups:
        mine = p[lang, source]
        pairs = [(sum(abs(mine[t] - x) for t, x in p[g].items()), g[1]) for g in groups if g[0] == lang and g[1] != source]
        terms = [(mine[t] - q[lang][t], t) for t in kept[lang] if counts[lang, source][t] and mine[t] > q[lang][t]]
        for part, items in (("pair", pairs), ("term", terms)):
            ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, i) for i, (value, item) in enumerate(ranked, 1) if part == "pair" or i <= most]
    return sorted(out)


def test_source_divergence(spark):
    rng = random.Random(3)
    words = ["the", "The", "THE", "été", "ÉTÉ", "straße", "x1y", "don't", "日本", "a", "b", "c", "d", " ", "e_f"]
    rows = []
    for i in range(600):
        lang = rng.choice(["en", "de", None, ""])
        source = rng.choice(["s1", "s2", "s10", None, "S1"]) if i % 3 else "hot"
        some = words[rng.randrange(8) :]
        rows.append((" ".join(rng.choice(some) for _ in range(rng.randrange(30))), lang, source))
    rows += [(None, "en", "empty"), ("", "fr", "alone"), ("rare words only", "fr", "two"), ("solo", "it", "one"), ("the " * 20_000, "en", "long")] + [("same row", "de", "s1")] * 50
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit("x"), "n": F.lit(1), "doc": F.lit(2), "shard": F.lit(0)}).repartition(6)
    out = divergence.source_divergence(df, "text", "lang", "source", least=30, most=5)
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in out.collect()) == plain_divergence(rows, 30, 5)
    assert out.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert divergence.source_divergence(df.limit(0), "text", "lang", "source").count() == 0


def test_counting_in_small_steps(spark, monkeypatch):
    """Counts given out before a task ends add up to the same."""
    rows = [(f"w{chr(97 + i % 26)} both w{chr(97 + i % 7)}", "en", f"s{i % 4}") for i in range(500)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1)
    monkeypatch.setattr(divergence, "HELD_ROWS", 10)
    monkeypatch.setattr(divergence, "TEXT_BYTES", 400)
    counts = divergence.term_counts(df, "text", "lang", "source").groupBy("term").agg(F.sum("n"), F.sum("docs")).collect()
    want, docs = Counter(), Counter()
    for t, _, _ in rows:
        want.update(re.findall("[a-z]+", t))
        docs.update(set(re.findall("[a-z]+", t)))
    assert {r[0]: (r[1], r[2]) for r in counts} == {t: (n, docs[t]) for t, n in want.items()}


# Periodic runs.


def plain_runs(words):
    """For every period the maximal stretches; those whose smallest period it is."""
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and not any(all(words[x] == words[x + d] for x in range(i, j + q - d)) for d in range(1, q)):
                out.append((i, j + q - i, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_every_period():
    rng = random.Random(5)
    for k in range(1500):
        letters = [b"a", b"b", b"c", b"d"][: 1 + k % 4]
        words = [rng.choice(letters) for _ in range(rng.randrange(60))]
        for _ in range(k % 4):
            unit = [rng.choice(letters) for _ in range(rng.randrange(1, 9))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = (unit * 7)[: rng.randrange(1, 7 * len(unit) + 1)]
        assert periodic_runs.runs_of(words) == plain_runs(words), words
        ids = {w: i for i, w in enumerate(sorted(set(words)))}
        assert periodic_runs.automaton_runs([ids[w] for w in words]) == plain_runs(words), words


def test_runs_in_prose_with_planted_periods():
    rng = random.Random(6)
    for _ in range(20):
        words = [b"w%d" % min(int(rng.expovariate(0.02)), 400) for _ in range(1500)]
        planted = queries.with_planted_period({"doc_id": 6}, words)  # a document that the contract changes
        assert planted != words and len(planted) == len(words)
        some = [*words[:300], *[b"again"] * 9, *words[300:700], *words[300:320] * 5, *words[700:]]
        for text in (words, planted, some):
            assert periodic_runs.runs_of(text) == plain_runs(text)


def test_automaton_has_the_states_of_the_end_sets():
    rng = random.Random(7)
    for _ in range(50):
        ids = [rng.randrange(3) for _ in range(25)]
        ends = defaultdict(set)
        for a in range(25):
            for b in range(a + 1, 26):
                ends[tuple(ids[a:b])].add(b - 1)
        longest = {}
        for s, e in ends.items():
            longest[frozenset(e)] = max(longest.get(frozenset(e), 0), len(s))
        _, length, _ = periodic_runs.automaton(ids)
        assert sorted(length[1:]) == sorted(longest.values())


def test_long_equal_words_take_little_time():
    assert periodic_runs.runs_of([b"x"] * 100_000) == [(0, 100_000, 1)]
    unit = [b"u%d" % i for i in range(1000)]
    assert periodic_runs.runs_of(unit * 60 + [b"end"]) == [(0, 60_000, 1000)]


def test_collapse_runs_on_odd_rows(spark):
    texts = [None, "", " \t ", "one two", "a " * 6, "a b " * 4 + "c", "x y " * 8, "a b c d e " * 4 + "f " * 5, "a " * 20_000]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts * 2)], "doc_id long, text string, runs long").repartition(3)
    out = periodic_runs.collapse_runs(df, "text")
    assert out.columns == ["doc_id", "text", "runs", "runs_", "collapsed"]
    for r in out.collect():
        words = (r.text or "").encode().split()
        runs = plain_runs(words) if len(words) < 1000 else [(0, len(words), 1)]
        gone = {i for s, k, q in runs for i in range(s + q, s + k)}
        assert [tuple(x) for x in r.runs_] == runs
        assert r.collapsed == b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
    assert periodic_runs.collapse_runs(df.limit(0), "text").count() == 0


def test_periodic_runs_query(spark, tmp_path):
    rng = random.Random(8)
    texts = [None, "", *[" ".join(rng.choice("abcd") for _ in range(rng.randrange(80))) for _ in range(150)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect():
        words = queries.with_planted_period({"doc_id": r.doc_id}, (texts[r.doc_id] or "").encode().split())
        runs = plain_runs(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        gone = {i for s, k, q in runs for i in range(s + q, s + k)}
        assert r.n_runs == len(runs) and (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
