"""Packing, sharding and mixing against brute force, and their edge cases."""

from __future__ import annotations

import array
import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import mixing, packing, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, shard string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "x", "y") for i, t, s in rows], DOCS)


EDGE = [(1, None, "a"), (2, "", "a"), (3, "  \n\t ", None), (4, "word", "b"), (4, "word", "b"), (None, "no id here", "b"), (5, "x " * 9000, "a"), (6, "Ünïcödé  double  spaces\r\n\x85 \xa0 end ", None), (7, "word", "a")]


# --- packing ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoder_equals_the_tokenizer(tokenizer, spark, tiny):
    texts = [r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").select("text").collect()]
    rng = random.Random(3)
    texts += ["".join(rng.choice("ab'sé 1.\n\t  \xa0\u3000\x1c<|>") for _ in range(200)) for _ in range(300)]
    texts += ["", " ", "  a", "a ", "a  b", " a b", "a \nb", "it's  we'll", "<|endoftext|> a", "a <|endoftext|><|endoftext|>\n b <|endoftext", "\x85a b\x85 c"]
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, packing.SPECIAL)
    for t in texts:
        assert list(array.array("I", encode(t))) == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)]
    assert packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(5, 4) == [(0, 1), (1, 4)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]


def check_packed(rows, texts, tokenizer, capacity):
    """Every document is there once, whole; every sequence is gapless and fits."""
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, text in texts.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in own] == packing.cut(len(ids), capacity)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(array.array("I", ids[r["start"] : r["start"] + r["length"]]).tobytes())
    return len(by_sequence)


def test_packed_whole_table(spark, tiny, tokenizer):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = packing.packed(docs).collect()
    n = check_packed(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, tokenizer, 2048)
    total = sum(r["length"] for r in rows)
    assert n <= -(-total // 2048) * 1.02 + 1


def test_the_added_token_is_matched_inside_texts(spark):
    path, mark = public_tokenizers.path("byte_bpe_50k.json"), "<|endoftext|>"
    t = Tokenizer.from_file(path)
    with open(path) as f:
        assert [(a["content"], a["id"]) for a in json.load(f)["added_tokens"]] == [packing.SPECIAL]
    rng = random.Random(8)
    texts = [f"end of page {mark} next page", mark, mark * 3, f" {mark} ", f"a {mark}b", f"it's{mark}'s", f"\n{mark}\n\n  x", "<|endoftext|", "<|ENDOFTEXT|>", f"<|endof{mark}text|>", f"x{mark} " * 900]
    texts += ["".join(rng.choice(["ab", "'s", "é", " ", "  ", "1", ".", "\n", "\t", "\xa0", "<|", "|>", mark]) for _ in range(60)) for _ in range(300)]
    docs = [(i, text, None) for i, text in enumerate(texts)]
    rows = packing.packed(docs_of(spark, docs), capacity=256).collect()
    check_packed(rows, {i: text for i, text, _ in docs}, t, 256)
    assert len(rows) > len(docs)


def test_packing_edges(spark, tokenizer):
    rows = packing.packed(docs_of(spark, EDGE), capacity=64, open_bins=2).collect()
    once = {i: t for i, t, _ in EDGE if i not in (4, None)}
    check_packed([r for r in rows if r["doc_id"] in once] + [r for r in rows if r["doc_id"] not in once], {}, tokenizer, 64)
    assert Counter(r["doc_id"] for r in rows if r["doc_id"] in (4, None)) == {4: 2, None: 1}
    assert {r["doc_id"]: r["length"] for r in rows if r["doc_id"] in (1, 2)} == {1: 1, 2: 1}
    assert packing.packed(docs_of(spark, [])).count() == 0


def test_bins_are_bounded_and_tight():
    rng, bins, fill = random.Random(1), packing.Bins(100, 4), Counter()
    for _ in range(5000):
        n = rng.randint(1, 100)
        bin_, offset = bins.place(n)
        assert fill[bin_] == offset
        fill[bin_] += n
        assert fill[bin_] <= 100 and bins.opened <= 4
    assert bins.made <= 1.25 * sum(fill.values()) / 100


# --- sharding ---------------------------------------------------------------------------


def test_capacity_is_the_smallest():
    rng = random.Random(2)
    for _ in range(200):
        sizes, k = [rng.randint(1, 50) for _ in range(rng.randint(1, 12))], rng.randint(1, 4)
        found = sharding.smallest_capacity(sizes, k, 0)

        def parts(cap, sizes=sizes):
            n, used = 1, 0
            for s in sizes:
                if used + s > cap:
                    n, used = n + 1, 0
                used += s
            return n

        assert found == min(c for c in range(max(sizes), sum(sizes) + 1) if parts(c) <= k)


def key_of(text):
    return int(hashlib.md5((text or "").encode()).hexdigest()[:15], 16)


def least_capacity(sizes, shards):
    """By trying every capacity that some run of groups has."""
    runs = sorted({sum(sizes[i:j]) for i in range(len(sizes)) for j in range(i + 1, len(sizes) + 1)}) or [0]

    def fits(cap):
        n, used = 1, 0
        for s in sizes:
            if s > cap:
                return False
            if used + s > cap:
                n, used = n + 1, 0
            used += s
        return n <= shards

    return next(c for c in runs if fits(c))


def check_shards(texts, rows, shards=8):
    """Groups whole, heavy ones alone, the others contiguous in hash order within the least capacity."""
    groups = Counter()
    for r in texts:
        groups[key_of(r["text"])] += len((r["text"] or "").encode()) + 1
    crc = {zlib.crc32((r["text"] or "").encode()): key_of(r["text"]) for r in texts}
    shard_of = defaultdict(set)
    for r in rows:
        shard_of[crc[r["text_crc32"]]].add(r["shard"])
    assert all(len(v) == 1 for v in shard_of.values()) and set(shard_of) == set(groups)
    left, total, n = sorted(groups.items(), key=lambda g: (-g[1], g[0])), sum(groups.values()), 0
    while left and shards - n > 1 and left[0][1] * (shards - n) >= total:
        key, size = left.pop(0)
        assert shard_of[key] == {n}
        total, n = total - size, n + 1
    order = sorted(left)
    places = [min(shard_of[k]) for k, _ in order]
    assert places == sorted(places) and all(n <= p < shards for p in places)
    loads = Counter()
    for (_, size), place in zip(order, places, strict=True):
        loads[place] += size
    if order:
        whole = sharding.smallest_capacity([s for _, s in order], shards - n)
        assert max(loads.values()) == whole
        if len(order) < 60:
            assert whole == least_capacity([s for _, s in order], shards - n)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return loads


@pytest.mark.parametrize("which", ["small", "edge", "hot", "few"])
def test_sharding_is_minimax(spark, small, which):
    if which == "small":
        docs = spark.read.parquet(f"{small}/documents.parquet")
    else:
        rows = {"edge": EDGE, "hot": [(i, "same text again" if i % 3 else f"text {i} " * (i % 9), "s") for i in range(600)], "few": [(i, f"text {i:02}", "s") for i in range(10)]}
        docs = docs_of(spark, rows[which])
    texts = docs.select("doc_id", "text").collect()
    rows = sharding.sharded(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in texts)
    loads = check_shards(texts, rows)
    if which in ("small", "few"):
        assert max(loads.values()) <= 2 * min(loads.values()) and len(loads) == 8


def test_repeated_rows_overfill_no_bucket(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)
    docs = docs_of(spark, [(i, f"text {i}", "s") for i in range(300)] + [(7, "again", "s")] * 1500 + [(None, "nobody's", "s")] * 700)
    rows = sharding.sharded(docs).collect()
    check_shards(docs.select("doc_id", "text").collect(), rows)
    assert Counter(r["doc_id"] for r in rows)[7] == 1501
    again = sorted(r["slot"] for r in rows if r["text_crc32"] == zlib.crc32(b"again"))
    assert again == list(range(again[0], again[0] + 1500))


def cut_by_entries(keys, sizes, shards, step, monkeypatch):
    """(loads, entries read) of boundaries over sorted keys, without Spark."""
    monkeypatch.setattr(sharding, "STEP_BITS", step)
    read = []

    def entries(inside, shift):
        k, s = keys[inside], sizes[inside]
        prefix, start = np.unique(k >> shift, return_index=True)
        end = np.append(start[1:], len(k))
        upto = np.append(0, np.cumsum(s))
        read.append(len(prefix))
        return [sharding.Entry(int(k[a]), int(x), shift, int(upto[b] - upto[a]), b - a == 1) for x, a, b in zip(prefix, start, end, strict=True)]

    def refine(which):
        out = []
        for shift in {e.shift for e in which}:
            out += entries(np.isin(keys >> shift, [e.prefix for e in which if e.shift == shift]), max(0, shift - step))
        return out

    cuts = sharding.boundaries(entries(np.ones(len(keys), bool), sharding.KEY_BITS - sharding.FIRST_BITS), refine, shards)
    at = [0, *np.searchsorted(keys, cuts).tolist(), len(keys)]
    return [int(sizes[a:b].sum()) for a, b in zip(at, at[1:])], sum(read)


@pytest.mark.parametrize("large", [[], [4], [9], [7, 7, 7], [20] * 9, [3, 12]])
def test_the_driver_holds_few_entries(large, monkeypatch):
    """400,000 groups and groups of a third, a quarter, a ninth of all: least capacity, bounded entries."""
    rng = np.random.default_rng(len(large))
    sizes = rng.integers(50, 4000, 400_000)
    sizes = np.append(sizes, [sizes.sum() // part for part in large]).astype(np.int64)
    rng.shuffle(sizes)
    keys = np.unique(rng.integers(0, 1 << 60, len(sizes) + 99))[: len(sizes)]
    top = np.argsort(-sizes, kind="stable")[:8]
    heavy = sharding.heavy_groups([(int(keys[i]), int(sizes[i])) for i in top], int(sizes.sum()), 8)
    rest = ~np.isin(keys, heavy)
    loads, read = cut_by_entries(keys[rest], sizes[rest], 8 - len(heavy), 6, monkeypatch)
    assert read < 10_000
    assert max(loads) == sharding.smallest_capacity(sizes[rest].tolist(), 8 - len(heavy))
    if len(large) < 2:
        assert max(loads) < 1.2 * min(loads)


@pytest.mark.parametrize("step", [1, 3, 12])
def test_refinement_steps_agree(step, monkeypatch):
    rng = np.random.default_rng(4)
    for n in (1, 5, 40, 3000):
        keys = np.unique(rng.integers(0, 1 << 60, n + 5))[:n]
        sizes = rng.integers(1, 60, n) ** 2
        loads, _ = cut_by_entries(keys, sizes, 5, step, monkeypatch)
        assert sum(loads) == sizes.sum() and max(loads) == sharding.smallest_capacity(sizes.tolist(), 5)


# --- mixing -----------------------------------------------------------------------------


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        level = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else level * weight[s] for s in order}
        capped |= over


@pytest.mark.parametrize("which", ["small", "edge"])
def test_mixing(spark, small, which):
    docs = spark.read.parquet(f"{small}/documents.parquet") if which == "small" else docs_of(spark, EDGE + [(100 + i, f"w{i} " * (i % 40), ("a", "b", None, "d", "e")[i * i % 5]) for i in range(200)])
    rows = mixing.mixed(docs).collect()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    sizes, taken, target = Counter(), Counter(), {}
    assert len(rows) == docs.count()
    for r in rows:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["copies"]
    want = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s], rel=1e-9, abs=1e-6)
        biggest = max(r["size"] for r in rows if source[r["doc_id"]] == s)
        assert abs(taken[s] - target[s]) <= biggest
    again = mixing.mixed(docs.repartition(7)).collect()
    assert Counter((r["doc_id"], r["taken"]) for r in rows) == Counter((r["doc_id"], r["taken"]) for r in again)


def test_mixing_empty(spark):
    assert mixing.mixed(docs_of(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mixed(docs_of(spark, [(1, None, None)])).collect()] == [0]
