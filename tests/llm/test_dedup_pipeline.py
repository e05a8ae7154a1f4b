"""Near-dedup against brute force, components, edge cases, and the pipeline's stages."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import minmax_dedup
from tessera.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, band long, component long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, 2) for i, t in rows], DOCS)


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    by_shingle = {}
    for i, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    seen = set()
    for ids in by_shingle.values():
        for n, a in enumerate(ids):
            for b in ids[n + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                        x, y = sorted((find(a), find(b)))
                        top[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(spark, rows):
    got = minmax_dedup.deduplicated(docs_of(spark, rows)).collect()
    want = brute([r for r in rows if r[0] is not None])
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])
        else:
            assert r["component_id"] is None and r["kept"]


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check(spark, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(n)]


def test_edges(spark):
    rng = random.Random(0)
    base = words(rng, 60)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE\ttwo"), (6, "one two three four five"), (7, "É one two three four"), (8, "é one two three four"), (None, "one two"), (None, " ".join(base))]
    rows += [(20, " ".join(base)), (21, " ".join(base).upper()), (22, " ".join([*base, "extra"])), (23, " ".join(base * 2)), (24, " ".join(base + words(rng, 60)))]
    check(spark, rows)
    assert minmax_dedup.deduplicated(docs_of(spark, [])).count() == 0
    twice = minmax_dedup.deduplicated(docs_of(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")])).collect()
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in twice) == {(1, 1, True): 2, (2, 1, False): 1}


def test_rows_that_share_an_id(spark):
    """A hot id, ids with several texts and with an empty one: one document each, the same on every run."""
    rng = random.Random(4)
    base = words(rng, 40)
    rows = [(1, " ".join(base))] * 50 + [(2, " ".join(base[:-1])), (2, "something else entirely and long enough"), (3, None), (3, " ".join([*base, "x"])), (4, " "), (4, None)]
    got = minmax_dedup.deduplicated(docs_of(spark, rows))
    first = Counter(tuple(r) for r in got.collect())
    assert Counter(tuple(r) for r in minmax_dedup.deduplicated(docs_of(spark, rows[::-1])).collect()) == first
    component = {r[0]: r[2] for r in first}
    assert len({(r[0], r[2], r[3]) for r in first}) == 4 and component[1] == 1 and component[3] == 1 and component[4] == 4
    assert component[2] in (1, 2) and sum(n for r, n in first.items() if r[0] == 1) == 50


def test_long_texts_and_bytes_by_block(spark, monkeypatch):
    """Texts of many words, compared in blocks that their bytes bound."""
    monkeypatch.setattr(minmax_dedup, "BLOCK_BYTES", 20_000)
    rng, rows = random.Random(5), []
    now = words(rng, 3000)
    for i in range(12):
        rows.append((rng.randrange(10**6), " ".join(now)))
        now = [*now]
        for _ in range(90):
            now[rng.randrange(len(now))] = words(rng, 1)[0]
    check(spark, list(dict(rows).items()) + [(10**7, "ab " * 700_000)])


def test_exactly_at_the_limit(spark):
    """Sets of 7 and 7 with 6 in common are exactly 0.75; one less is not linked."""
    w = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(w[:11])), (2, " ".join(w[1:12])), (3, " ".join(w[20:31])), (4, " ".join(w[22:33]))]
    check(spark, rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_and_large_groups(spark, seed, monkeypatch):
    """Many drifting copies: links between members must not be lost when neither is a hub."""
    monkeypatch.setattr(minmax_dedup, "BLOCK", 16)
    rng, rows = random.Random(seed), []
    for g in range(4):
        now = words(rng, 50)
        for i in range(60):
            rows.append((1000 * rng.randint(0, 900) + g * 100 + i, " ".join(now)))
            now = [*now]
            for _ in range(rng.choice((1, 1, 2))):
                now[rng.randrange(len(now))] = words(rng, 1)[0]
    passage = words(rng, 30)
    rows += [(10**6 + i, " ".join([*words(rng, 12), *passage, *words(rng, 12)])) for i in range(60)]
    check(spark, list(dict(rows).items()))


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(60):
        pool = rng.integers(0, 1 << 63, 400, np.uint64)
        a, b = np.unique(pool[:300]), np.unique(pool[100:])
        errors.append((minmax_dedup.signature(a) == minmax_dedup.signature(b)).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    top = {}
    for a, b in edges:
        if a != b:
            top.setdefault(a, a), top.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and top[a] != top[b]:
                top[a] = top[b] = min(top[a], top[b])
                changed = True
    assert got == top
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- pipeline ---------------------------------------------------------------------------


def test_pipeline_stages(spark, small, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("key", F.lit(1)).withColumn("copies", F.lit("c")).withColumn("extra", F.col("doc_id"))
    before = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, small).write.parquet(str(tmp_path / f"{i}"))
        after = spark.read.parquet(str(tmp_path / f"{i}"))
        if i < 4:
            assert after.columns == docs.columns
            assert after.exceptAll(before).count() == 0 or name == "mixing"
            assert 0 < after.count()
        if name == "near-dedup":
            want = brute([(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()])
            assert {r["doc_id"] for r in after.collect()} == {i for i, (_, c) in want.items() if c == i}
        if name == "packing":
            assert Counter(r["doc_id"] for r in after.filter("piece = 0").collect()) == Counter(r["doc_id"] for r in before.collect())
        before = after


def test_pipeline_edges(spark, small):
    import corpus_pipeline

    docs = docs_of(spark, [(None, None), (1, ""), (1, ""), (2, "short")])
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, table, small).count()
