"""WARC packages, URL rules and cover-tree search against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import io
import itertools
import random
import re
import struct
import time
import zipfile
from collections import Counter

import numpy as np
import pytest

from tessera.llm import covertree, url_rules, warc_zip

PAGES = "page_id long, url string, html string, host string, digest string"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], PAGES)


# --- WARC -------------------------------------------------------------------------------


def test_stored_zip_equals_zipfile():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a.txt", b"hello")
        z.writestr("ünï.bin", bytes(range(256)))
        z.writestr("empty", b"")
        z.comment = b"a note"
    found = warc_zip.StoredZip(raw, len(raw.getvalue()))
    with zipfile.ZipFile(raw) as z:
        assert {n: found.read(n) for n in found.members} == {n: z.read(n) for n in z.namelist()}
    assert found.read("ünï.bin", 10, 5) == bytes(range(10, 15))
    marked = raw.getvalue()[:-8] + struct.pack("<H", 30) + b"a PK\5\6 that is not the end...."[:30]
    assert warc_zip.StoredZip(io.BytesIO(marked), len(marked)).read("a.txt") == b"hello"
    with pytest.raises(ValueError):
        found.read("a.txt", 3, 9)


def zip64(name: bytes, body: bytes) -> bytes:
    """A one-member archive whose sizes and offsets are only in ZIP64 fields."""
    crc = 0
    local = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0, 0, 0, 0, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(body), len(body)) + body
    extra = struct.pack("<HHQQQ", 1, 24, len(body), len(body), 0)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0, 0, 0, 0, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    at = len(local)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    locator = struct.pack("<4sIQI", b"PK\6\7", 0, at + len(central), 1)
    return local + central + end64 + locator + struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)


def test_zip64_and_broken_files():
    raw = zip64(b"m", b"payload")
    assert warc_zip.StoredZip(io.BytesIO(raw), len(raw)).read("m") == b"payload"
    for bad in (b"", b"PK", raw[:-30], b"x" * 100):
        with pytest.raises(ValueError):
            warc_zip.StoredZip(io.BytesIO(bad), len(bad))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"a" * 100)
    with pytest.raises(ValueError, match="compressed"):
        warc_zip.StoredZip(packed, len(packed.getvalue())).read("a")


def test_round_trip_edges(spark):
    long_ = "é" * 600
    rows = [(1, "http://a/\r\nWARC-Type: evil", None), (2, None, ""), (3, "u", long_), (9, "u", long_), (5, "u", long_), (6, "u", "x" * 999), (7, "u", "x" * 999), (8, "u", "x" * 1000), (8, "u", "x" * 1000), (None, "u", long_), (10, "u", "a\r\n\r\nb\x00")]
    got = warc_zip.round_trip(pages_of(spark, rows)).collect()
    assert len(got) == len(rows)
    want = Counter()
    first = {long_: 9, "x" * 1000: 8}
    for i, _, h in rows:
        body = (h or "").encode()
        other = first.get(h) if len(body) >= 1000 else None
        other = None if other == i else other
        want[i, len(body), hashlib.sha1(body).hexdigest(), "response" if other is None else "revisit", other] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert warc_zip.round_trip(pages_of(spark, [])).count() == 0


def test_many_packages(spark, tiny):
    pages = spark.read.parquet(f"{tiny}/pages.parquet")
    folder = warc_zip.scratch_path(spark, "warc-test")
    manifest = warc_zip.write_packages(warc_zip.plan_records(pages), folder, package_bytes=20_000).cache()
    assert manifest.count() > 3
    got = warc_zip.read_packages(manifest)
    assert got.select("page_id", "payload_bytes").exceptAll(pages.selectExpr("page_id", "CAST(octet_length(html) AS BIGINT)")).count() == 0
    assert got.count() == pages.count()


# --- URL rules --------------------------------------------------------------------------


def brute_rule(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


URLS = [None, "", "nothing", "http://", "http://NET/", "http://a.NET", "http://a.net/x?y#z", "x://www.Example.net/en/1", "http://example.net/en", "http://notexample.com/de/1", "http://example.com/de/?q=://b/", "http://a.org/fr/ü", "http://É.org/fr/", "://org/fr/x", "http://a.com\n/de/", "http://example.com#/de/"]


def test_fixed_rules(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = url_rules.judged(pages_of(spark, [(i, u, "") for i, u in enumerate(URLS)] + [(0, None, "")]), labels).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path, rule, verdict = brute_rule(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow"), URLS[r["page_id"]]
    assert url_rules.judged(pages_of(spark, []), labels).count() == 0


def test_mined_rules_block(spark):
    rows = [(i, f"http://{'bad' if i % 4 == 0 else 'good'}{i % 8}.example.io/{'ads' if i % 4 == 0 else 'news'}/{i}", "") for i in range(400)]
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i in range(200)] + [(None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = url_rules.judged(pages_of(spark, rows), labels).collect()
    assert all((r["verdict"] == "block") == (r["page_id"] % 4 == 0) and (r["mined"] is None) == (r["page_id"] % 4 != 0) for r in got)


def test_rules_need_all_their_tokens(spark):
    rules = spark.createDataFrame([(["dir:a", "dir:b"], 0.9, 0.1, 2.0, "dir:b")], url_rules.RULE_SCHEMA)
    urls = pages_of(spark, [(1, "http://h/a/b", ""), (2, "http://h/a", ""), (3, None, ""), (4, "http://h/b/x/a?q=1", "")])
    assert {r["url"] for r in url_rules.matches(urls, rules).collect()} == {"http://h/a/b", "http://h/b/x/a?q=1"}


def brute_tokens(url):
    """(base tokens, the others in order) of one url."""
    host, path = brute_rule(url)[:2]
    zero = lambda x: "0" if re.fullmatch(r"[0-9]+", x) else x
    ext = re.search(r"\.([A-Za-z0-9]+)$", path)
    words = [x for x in (path[: ext.start()] if ext else path).split("/") if x]
    labels = ["name:" + zero(x) for x in reversed(host.split(".")) if x]
    base = dict.fromkeys([f"host:{host}", f"depth:{len(words)}", f"ext:{ext[1] if ext else ''}", "fragment" if "#" in url else "whole", *labels[:2]])
    rest = dict.fromkeys([*labels[2:], *("dir:" + zero(x) for x in words), *("query:" + zero(x) for x in re.findall(r"[?&]([^=&#]+)", url))])
    return list(base), [t for t in rest if t not in base]


def brute_rules(rows, least, sure):
    """{tokens: (confidence, support)} by counting every set that a blocked url offers."""
    known = [(*brute_tokens(u), b) for u, b in rows if u is not None and b is not None]
    sets = set()
    for base, rest, blocked in known:
        if blocked:
            for at in range(0, max(1, len(rest)), url_rules.TOGETHER):
                some = sorted(base + rest[at : at + url_rules.TOGETHER])
                sets |= {c for n in range(1, len(some) + 1) for c in itertools.combinations(some, n)}
    rules = {}
    for c in sets:
        fits = [b for base, rest, b in known if set(c) <= {*base, *rest}]
        if sum(fits) >= least and sum(fits) / len(fits) >= sure:
            rules[c] = (sum(fits) / len(fits), sum(fits) / len(known))
    return {c: v for c, v in rules.items() if not any(rules.get(c[:i] + c[i + 1 :], (0,))[0] >= v[0] for i in range(len(c)))}


def test_rules_are_all_there_with_their_counts(spark):
    rng = random.Random(6)
    rows = [(None, True), ("http://a/b", None)]
    for _ in range(260):
        bad = rng.random() < 0.4
        host = rng.choice(["b.c.example", "spam.example" if bad else "a.example"])
        words = [rng.choice(["x", "y", "12", "win" if bad else "z", "a b"]) for _ in range(rng.randint(0, 7))]
        rows.append((f"http://{host}/{'/'.join(words)}{rng.choice(['', '.html', '?id=1&buy=2'])}", bad if rng.random() < 0.95 else not bad))
    got = url_rules.mine(spark.createDataFrame(rows, "url string, blocked boolean")).collect()
    want = brute_rules(rows, url_rules.MIN_COUNT, url_rules.MIN_CONFIDENCE)
    assert len(want) > 3 and {tuple(r["antecedent"]) for r in got} == set(want)
    for r in got:
        assert (r["confidence"], r["support"]) == pytest.approx(want[tuple(r["antecedent"])]) and r["token"] in r["antecedent"]


def test_a_hot_deep_url(spark):
    """60 copies of a url of 24 words among 1000, and one of 3000 words: seconds, not minutes."""
    deep = "http://deep.example/" + "/".join(f"w{i}" for i in range(24))
    longest = "http://long.example/" + "/".join(f"v{i}" for i in range(3000))
    rows = [(deep, True)] * 60 + [(f"http://h{i % 9}.example/p/{i}", False) for i in range(940)]
    began = time.perf_counter()
    rules = url_rules.mine(spark.createDataFrame(rows, "url string, blocked boolean"))
    mined = url_rules.matches(spark.createDataFrame([(deep,), (longest,), (deep + "/more",), ("http://h1.example/p/1",)], "url string"), rules).collect()
    assert {r["url"] for r in mined} == {deep, deep + "/more"} and time.perf_counter() - began < 90
    assert all(len(r["antecedent"]) == 1 for r in rules.collect())


def test_rules_join_tokens_far_apart(spark):
    """The first and the last of nine words block together, neither alone."""
    rows = []
    for i in range(400):
        first, last = i % 2, i // 2 % 2
        middle = "/".join(f"m{k}" for k in range(7))
        rows.append((f"http://far.example/{'a' if first else 'b'}/{middle}/{'y' if last else 'z'}", bool(first and last)))
    rules = url_rules.mine(spark.createDataFrame(rows, "url string, blocked boolean")).collect()
    assert {(tuple(r["antecedent"]), r["confidence"]) for r in rules} == {(("dir:a", "dir:y"), 1.0)}


# --- search -----------------------------------------------------------------------------


def brute_top(rows, k=20, every=20):
    ints = {}
    out = set()
    usable = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for i, v in usable:
        if i % every == 0:
            ints[i] = min(ints.get(i, v), v)
    for q, v in ints.items():
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in usable if j != q)[:k]
        out |= {(q, n + 1, j, -s) for n, (s, j) in enumerate(found)}
    return out


@pytest.mark.parametrize("blocks", [(1024, 8192), (7, 60), (3, 33)])
def test_search_equals_brute_force(spark, blocks):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] + 0.2 * rng.standard_normal(8)]) for i in range(300)]
    rows += [(1000 + i, [0.5] * 8) for i in range(60)]  # ties
    rows += [(2000, None), (2020, [None] * 8), (2040, [float("nan")] * 8), (None, [1.0] * 8), (2060, [float("inf")] + [0.0] * 7), (2080, [1.0, 2.0]), (2081, [])]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = covertree.top_k(df, query_block=blocks[0], data_block=blocks[1])
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == brute_top(rows)


def test_search_small_and_large_numbers(spark):
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert covertree.top_k(df([])).count() == 0
    assert covertree.top_k(df([(0, [1.0])])).count() == 0
    rows = [(0, [1e7, 3.0]), (1, [2e7, -1.0]), (2, [-3e7, 1.0]), (20, [1e7, 3.0]), (20, [1e7, 3.0])]
    got = {tuple(r) for r in covertree.top_k(df(rows)).collect()}
    q = [640000000, 192]
    assert {(r[2], r[3]) for r in got if r[0] == 0} == {(1, q[0] * 1280000000 - 64 * 192), (2, -q[0] * 1920000000 + 64 * 192), (20, q[0] ** 2 + 192**2)}
    assert sum(r[0] == 0 for r in got) == 4


def tree_nodes(points, tree):
    """(centre, radius, rows, children's rows) of every node."""
    for i in range(len(tree.centre)):
        rows = tree.order[tree.start[i] : tree.end[i]]
        below = range(tree.child[i], tree.child[i] + tree.children[i]) if tree.children[i] else ()
        yield points[tree.centre[i]], tree.radius[i], rows, [tree.order[tree.start[c] : tree.end[c]] for c in below]


def clusters(n, spread, seed=1):
    """n integer vectors of 64 dimensions around 64 centres."""
    rng = np.random.default_rng(seed)
    return rng.integers(-400, 400, (64, 64))[rng.integers(0, 64, n)] + rng.integers(-spread, spread + 1, (n, 64))


@pytest.mark.parametrize("points", [np.random.default_rng(0).integers(-99, 99, (900, 3)), clusters(900, 9), np.ones((300, 2), np.int64)])
def test_cover_tree_covers(points):
    tree = covertree.build(points, 32)
    for centre, radius, rows, below in tree_nodes(points, tree):
        assert (np.linalg.norm(points[rows] - centre, axis=1) <= radius + 1e-9).all()
        assert len(rows) <= 32 or radius == 0 or below
        if below:
            assert sorted(np.concatenate(below)) == sorted(rows)
    assert sorted(tree.order) == list(range(len(points)))


def test_nets_cover_and_keep_apart():
    points = np.random.default_rng(3).standard_normal((700, 4))
    centres, owner = covertree.net(points, 5, 0.8)
    assert (np.linalg.norm(points - points[centres[owner]], axis=1) <= 0.8 + 1e-9).all()
    between = np.linalg.norm(points[centres][:, None] - points[centres][None], axis=2) + 9 * np.eye(len(centres))
    assert between.min() > 0.8 and (owner[centres] == np.arange(len(centres))).all()


def best_pairs(v, asked, k):
    scores = v[asked] @ v.T
    scores[np.arange(len(asked)), asked] = np.iinfo(np.int64).min // 2
    return {(i, int(j), int(scores[i, j])) for i in range(len(asked)) for j in np.lexsort((np.arange(len(v)), -scores[i]))[:k]}


def walked(v, every, k=20):
    asked, walk = np.arange(0, len(v), every), covertree.Walk()
    found = covertree.search(v[asked], asked, v, np.arange(len(v)), k, np.full(len(asked), covertree.NOTHING + 1), None, walk)
    assert set(found) == best_pairs(v, asked, k)
    return walk


def test_dual_tree_prunes_clusters():
    walk = walked(clusters(4000, 12), 20)
    assert min(walk.nodes) > 10
    assert walk.products < 0.3 * walk.pairs


def test_trees_are_grown_on_the_given_vectors(spark):
    rows = covertree.integer_vectors(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).orderBy("vec_id").collect()
    walk = walked(np.array([r["v"] for r in rows]), 20)
    assert min(walk.nodes) > 1


def test_cell_pairs_are_pruned_before_the_shuffle(spark):
    v = clusters(3000, 4, seed=2)
    df = spark.createDataFrame([(i, [float(x) / 64 for x in row]) for i, row in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    met = []
    searched = covertree._searched

    def counted(asked, data, k, tasks):
        met.append(asked.count())
        return searched(asked, data, k, tasks)

    covertree._searched = counted
    try:
        got = {tuple(r) for r in covertree.top_k(df, k=10, data_block=256, query_block=64).select("query_id", "vec_id", "score").collect()}
    finally:
        covertree._searched = searched
    asked = np.arange(0, 3000, 20)
    assert got == {(int(asked[i]), j, s) for i, j, s in best_pairs(v, asked, 10)}
    blocks = -(-3000 // 256)
    assert sum(met) < 0.5 * len(asked) * blocks


def test_a_hot_vector_and_uneven_widths(spark):
    rows = [(i, [0.5, 0.25] if i % 3 else [float(i % 7), 1.0, float(i % 5)][: 1 + i % 3]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in covertree.top_k(df, k=5, data_block=32, query_block=8).select("query_id", "vec_id", "score").collect()}
    v = np.zeros((400, 3), np.int64)
    for i, x in rows:
        v[i, : len(x)] = np.floor(64 * np.array(x))
    asked = np.arange(0, 400, 20)
    assert got == {(int(asked[i]), j, s) for i, j, s in best_pairs(v, asked, 5)}
